from siltstone.llm import main_body, placeholders, residue
from siltstone.llm.html_blocks import blocks, is_linked, plain, title_of, without_code


def texts(html):
    return [(b.tag, " ".join(plain(b.raw).split())) for b in blocks(html)]


def test_blocks():
    html = """<!DOCTYPE html><head><title>T &amp; x</title><style>p>b{}</style><script>var t="<p>no</p>";</script></head><body>
    <!-- <p>old</p> --><P data-note="a > b">one <b>two</b><img src=x><h1>head</h1><ul><li>a<li><a href="/x">b &lt;c</a></li></ul>
    <noscript><p>no</p></noscript><template><p>row</p></template><table><tr><td>1<td>2</table><pre><code>if a &lt; b</code></pre><p>end <a hr"""
    assert texts(html) == [("p", "one two"), ("h1", "head"), ("li", "a"), ("li", "b <c"), ("td", "1"), ("td", "2"), ("pre", "if a < b"), ("p", "end")]
    assert title_of(html) == "T & x"


def test_a_block_ends_at_its_end_tag_even_behind_other_tags():
    assert texts("<p>a<br>b</p>c<p>d<div>e</div><p>f") == [("p", "ab"), ("p", "d"), ("p", "f")]


def test_empty_pages():
    assert blocks(None) == [] and blocks("") == [] and blocks("text only") == [] and blocks("<p") == []


def test_links_and_code():
    found = blocks("<li><a href='/x'>all</a><li><a>part</a> of it<li>see <code>{{ x }}</code> here")
    assert [is_linked(b.raw) for b in found] == [True, False, False]
    assert "{{" not in without_code(found[2].raw)


PROSE = ["the cat sat near the river and watched several boats drift slowly past", "winter mornings bring quiet streets with thin ice over every puddle", "bakers knead dough before sunrise while ovens warm the narrow room", "farmers count sheep twice whenever clouds gather behind the northern hills"]


def page(n, body=None):
    prose = body or "".join(f"<p>{PROSE[(n + k) % 4]} {'abcdefghij'[n % 10] * 3}{'klmnopqrst'[k]} number {n}" for k in range(4))
    return f"<header><ul><li><a href='/'>Home</a></ul></header><div><p>Cookies help us, accept them all</div><h1>Story {'abcdefghij'[n % 10] * 4}{n}</h1>{prose}<div><p>Share this page with friends</div><footer><p>Copyright the authors, no warranty given</footer>"


PAGES = [(f"https://h{n}.example/x", page(n)) for n in range(40)]


def test_main_body_leaves_boilerplate_out():
    extractor = main_body.Extractor(main_body.fit((u, blocks(p)) for u, p in PAGES))
    found = blocks(page(7))
    body = extractor.body(found, "https://h7.example/x")
    assert [found[i].tag for i in body] == ["h1", "p", "p", "p", "p"]
    assert extractor.body([], None) == []


def test_residue():
    models = residue.fit_models([(u, p, 200) for u, p in PAGES])
    extractor = main_body.Extractor(models.weights)

    def judge(html):
        return residue.is_residue(html, "https://h.example/", models, extractor)

    assert not judge(page(3))
    assert judge(page(3, "<p>Page not found. The page you requested could not be found on this server."))
    assert judge(page(3, "<p>Lorem ipsum dolor sit amet, consectetur adipiscing elit sed do eiusmod"))
    assert judge("<body><noscript>Please enable JavaScript</noscript><div id='root'></div></body>")
    assert judge(page(3).replace("<h1>", "<h1>{{ page.title }} "))
    assert not judge(page(3).replace("number", "<code>{{ page.title }}</code> number"))


def test_residue_outside_blocks():
    models = residue.fit_models([(u, p, 200) for u, p in PAGES])
    extractor = main_body.Extractor(models.weights)

    def judge(html):
        return residue.is_residue(html, "https://h.example/", models, extractor)

    for text in ("<div>{{ author }}</div>", "<figure><figcaption>Made by <span>${name}</span></figcaption></figure>", "<button>%%LABEL_X%%</button>", "{{ bare }}"):
        assert judge(page(3) + text) and judge(text + page(3)), text
    assert not judge(page(3) + "<div>see <code><span>{{ x }}</span></code></div><script>{{ x }}</script><div title='{{ x }}'>a</div>{<b>x</b>")
    article = " <br> ".join(PROSE)
    assert not judge(f"<body><div>{article}</div></body>")
    assert judge(f"<body><div>{'Lorem ipsum dolor sit amet, consectetur adipiscing elit sed do eiusmod. ' * 5}</div></body>")
    assert judge(f"<ul><li><a href='/'>Home</a></ul><div>{'Lorem ipsum dolor sit amet, consectetur adipiscing elit sed do eiusmod. ' * 5}</div>")
    assert judge("<body><div>Loading</div></body>")


def test_placeholders():
    for text in ("${name}", "{{ a.b }}", "%%TAG_X%%", "<%= a.b %>", "TODO: describe this", "[Your name here]", "NaN of undefined", "[object Object]", "&&x_y&&", "(title to be written)"):
        assert placeholders.has_placeholder("x " + text + " y"), text
    for text in ("a plain line", "cost 5 % sold", "see [the guide] and {a, b}", "x < y and y > z", "key: value"):
        assert not placeholders.has_placeholder(text), text
