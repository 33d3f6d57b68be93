import numpy as np

from siltstone.llm import main_body, residue, whole_fit
from siltstone.llm.html_blocks import blocks


def word(n):
    return "".join(chr(97 + int(d)) for d in f"{n:05d}")


def pages_of_two_sites():
    """More pages than a sample held: a large site, four pages of a small one, messages, and rows without a page."""
    rows = []
    for n in range(main_body.SAMPLE_PAGES + 100):
        own = " ".join(word(n * 7 + k % 9) for k in range(45))
        rows.append((n, f"https://big.example/{n}", f"<h1>{word(n)} big</h1><p>{own}" + "<p>rarely again" * (n < 4) + "<li>often around" * (n % 9 == 0), 200))
    rows += [(5000 + n, f"https://small.example/{n}", f"<h1>{word(n)} small</h1><p>{' '.join(word(90_000 - n * 50 - k) for k in range(45))}<p>always below<h2>in small</h2>", None) for n in range(4)]
    rows += [(6000 + n, f"https://big.example/m{n}", f"<h1>gone</h1><p>nothing at {word(n)}", 404) for n in range(3)]
    # Equal titles on several sites, equal rows, and no row that must be a page.
    rows += [(7000, "https://a.example/", rows[0][2], 200), (7000, "https://a.example/", rows[0][2], 200), (None, None, rows[1][2], 200), (7001, "u", None, 200), (7002, "u", "", None)]
    return rows


def test_models_are_fitted_on_all_pages(spark):
    rows = pages_of_two_sites()
    results = spark.createDataFrame(rows, "result_id long, url string, html string, status_code int")
    expected = residue.fit_models([(url, html, status) for _, url, html, status in rows])
    for table in (results, results.repartition(7)):
        models = residue.fit_models_on(table)
        assert models.weights == expected.weights
        assert all(np.array_equal(a, b) for a, b in zip(models[1:], expected[1:], strict=True))


def test_a_task_that_forgets_counts_the_same(spark, monkeypatch):
    rows = [r for r in pages_of_two_sites() if r[2]][-300:]
    monkeypatch.setattr(whole_fit, "KNOWN_LINES", 40)
    results = spark.createDataFrame(rows, "result_id long, url string, html string, status_code int")
    number, weights = whole_fit.fit_on_all(results)
    assert number == len(rows)
    assert weights == main_body.fit(((url, blocks(html)) for _, url, html, _ in rows), by_site=True)


def test_lines_of_large_sites_need_more_titles():
    assert [main_body.titles_needed(n) for n in (0, 1, 2000, 2001, 60_000)] == [4, 4, 4, 5, 120]
    weights = main_body.fit(((url, blocks(html)) for _, url, html, _ in pages_of_two_sites() if html), by_site=True)
    assert weights["often"] < 0 and weights["below"] < 0 < weights.get("rarely", main_body.unseen_weight())


def test_texts_without_notation_are_left_out():
    extractor = main_body.Extractor({})
    assert residue.shown_of("<title>a</title><h1>b</h1><p>c  d", None, extractor) == (None, "\tb\nc d", None)
    assert residue.shown_of("<title>a</title><h1>b</h1><p>{{ name }}", None, extractor).fields is not None
    assert residue.shown_of("<p>fine<p>todo:", None, extractor).fields is not None
    assert residue.shown_of("<title>a</title><div>one <b>two</b></div>", None, extractor) == (None, None, "one two")
