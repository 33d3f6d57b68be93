import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import pages, paths, urls
from siltstone.operators import rules


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "u string").select(expression(F.col("u")).alias("x")).first()[0]


NORMAL = [
    ("HTTPS://Www.Quarry.Example:443/Slate/Bed?layer=3#top", "https://www.quarry.example/Slate/Bed?layer=3"),
    ("https://Mason:Chisel@Quarry.EXAMPLE/", "https://Mason:Chisel@quarry.example/"),
    ("https://a.example:443/x/", "https://a.example/x/"),
    ("https://a.example:8443/x", "https://a.example:8443/x"),
    ("http://a.example//docs//page", "http://a.example//docs//page"),
    ("http://a.example/docs/docs/docs/x", "http://a.example/docs/x"),
    ("http://a.example/api/v1/users/api/", "http://a.example/api/v1/users/api/"),
    ("  http://a.example/%7Ex ", "http://a.example/%7Ex"),
    ("http://a.example/x\n", "http://a.example/x"),
    ("http://a.example/x?p=/a/a", "http://a.example/x?p=/a/a"),
    ("   ", None),
    (None, None),
]


@pytest.mark.parametrize(("raw", "expected"), NORMAL)
def test_normalize(spark, raw, expected):
    assert one(spark, raw, urls.normalize) == expected


def test_normalize_is_idempotent(spark):
    words = st.text("abAB:/?#@.%1", max_size=20)

    @settings(max_examples=5, deadline=None)
    @given(st.lists(words, min_size=20, max_size=40))
    def check(tails):
        rows = spark.createDataFrame([("HTTP://h.Example/" + t,) for t in tails], "u string")
        once = rows.select(urls.normalize(F.col("u")).alias("a")).select("a", urls.normalize(F.col("a")).alias("b"))
        assert all(a == b for a, b in once.collect())

    check()


JOINS = [
    ("http://a.example/b/c", "d", "http://a.example/b/d"),
    ("http://a.example/b/c", "../d", "http://a.example/d"),
    ("http://a.example/b/c", "../../../d", "http://a.example/d"),
    ("http://a.example/b/c", "./", "http://a.example/b/"),
    ("http://a.example", "d", "http://a.example/d"),
    ("http://a.example/b?x=1", "?y=2", "http://a.example/b?y=2"),
    ("http://a.example/b?x=1#f", "#g", "http://a.example/b?x=1#g"),
    ("https://a.example/b", "//c.example/d", "https://c.example/d"),
    ("http://a.example/b", "mailto:x@y", "mailto:x@y"),
    ("http://a.example/b", "", "http://a.example/b"),
]


@pytest.mark.parametrize(("base", "ref", "expected"), JOINS)
def test_join(spark, base, ref, expected):
    assert spark.createDataFrame([(base, ref)], "b string, r string").select(urls.join(F.col("b"), F.col("r"))).first()[0] == expected


@pytest.mark.parametrize(("raw", "safe"), [("http://x", True), ("HTTPS://x", True), ("javascript:alert(1)", False), ("/rooted", False), ("ftp://x", False)])
def test_safe(spark, raw, safe):
    assert one(spark, raw, urls.is_safe_scheme) is safe


def test_base_tag(spark):
    html = "<base href='/docs/'><base href='/other/'>"
    assert one(spark, html, lambda c: pages.base_url(c, F.lit("http://a.example/x"))) == "http://a.example/docs/"
    assert one(spark, "<base href=''>", lambda c: pages.base_url(c, F.lit("http://a.example/x"))) == "http://a.example/x"


@pytest.mark.parametrize(("url", "prefix", "expected"), [("https://e.example/doc/guide/install/", "/doc", "docs/guide/install/index.md"), ("https://e.example/doc/overview", "/doc", "docs/overview.md"), ("https://e.example/", "", "docs/index.md"), ("https://e.example/../../etc/x", "", "docs/etc/x.md")])
def test_document_path(spark, url, prefix, expected):
    assert one(spark, url, lambda c: paths.document_path(c, prefix)) == expected


@pytest.mark.parametrize(("source", "target", "expected"), [("docs/a/b.md", "docs/a/c.md", "c.md"), ("docs/a/b.md", "docs/d.md", "../d.md"), ("docs/b.md", "assets/x.png", "../assets/x.png"), ("a.md", "b/c.md", "b/c.md")])
def test_relative_path(spark, source, target, expected):
    assert spark.createDataFrame([(source, target)], "s string, t string").select(paths.relative_path(F.col("s"), F.col("t"))).first()[0] == expected


def test_patterns(spark):
    row = spark.createDataFrame([("/docs/x",)], "p string")
    cases = [("/docs/", "prefix", True), ("docs/*", "glob", False), ("/docs/*", "glob", True), ("/d", "regex", True), ("ocs", "regex", False)]
    for pattern, kind, expected in cases:
        assert row.select(rules.PathPattern(pattern, kind).matches(F.col("p"))).first()[0] is expected


def test_follow_excluding_wins(spark):
    own = rules.Rules(("example.com",), (rules.PathPattern("/docs"),), (rules.PathPattern("/docs/private"),), 2)
    data = [("http://sub.example.com/docs/a", 1, True), ("http://example.com/docs/private/a", 1, False), ("http://badexample.com/docs", 1, False), ("http://example.com/docs", 3, False), (None, 1, False)]
    for url, depth, expected in data:
        row = spark.createDataFrame([(url, depth)], "u string, d int")
        assert row.select(rules.follow(F.col("u"), own, F.col("d"))).first()[0] is expected


def test_robots(spark):
    text = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /*.pdf$\n"
    parsed = rules.robots_rules(spark.createDataFrame([("http://h.example", text), ("http://n.example", None)], "origin string, text string"))
    addresses = [("http://h.example/a/x", False), ("http://h.example/a/b/x", True), ("http://h.example/c.pdf", False), ("http://h.example/c.pdfx", True), ("http://n.example/a", True), ("http://new.example/", True)]
    got = {r["url"]: r["robots_allowed"] for r in rules.robots_allowed(spark.createDataFrame([(u,) for u, _ in addresses], "url string"), parsed).collect()}
    assert got == dict(addresses)
