import datetime as dt

import pytest
from pyspark.sql import functions as F

from siltstone.functions import markdown, pages
from siltstone.operators import crawl, orphans, reports, sitemaps, state, transforms
from siltstone.operators.rules import Rules
from siltstone.plans.components import connected_components
from siltstone.sources import auth, checkpoints
from siltstone.sources.fetch import PageReader
from siltstone.streaming import pipeline

T = dt.datetime(2025, 1, 1, tzinfo=dt.UTC)


def test_breadth_first_takes_least_depth_and_stops_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), (None,)], "url string")
    got = {r["url"]: (r["depth"], r["parent"]) for r in crawl.breadth_first(seeds, edges, 2).collect()}
    assert got == {"a": (0, None), "b": (1, "a"), "c": (1, "a"), "d": (2, "c")}
    assert crawl.breadth_first(seeds.where("false"), edges, 3).count() == 0


def test_crawl_limit(spark):
    results = spark.createDataFrame([("http://a.example/1", ["http://a.example/2", "ftp://a.example/3", "http://b.test/"])], "url string, links array<string>")
    seeds = spark.createDataFrame([("http://a.example/1",)], "url string")
    rows = crawl.crawl(results, seeds, Rules(("example",), depth_limit=1))
    assert {r["url"] for r in rows.collect()} == {"http://a.example/1", "http://a.example/2"}
    assert crawl.crawl(results, seeds, Rules(("example",), depth_limit=1), 1).count() == 1


def test_queue_positions(spark):
    frontier = spark.createDataFrame([("b", 1, None), ("a", 1, "x"), ("z", 0, None)], "url string, depth int, parent string")
    assert [(r["position"], r["url"]) for r in crawl.queue_positions(frontier).orderBy("position").collect()] == [(0, "z"), (1, "a"), (2, "b")]


def test_upsert_and_staleness(spark):
    schema = "url string, last_scraped timestamp, content_hash string"
    old = spark.createDataFrame([("a", T, "1"), ("b", T, "1"), (None, T, "x")], schema)
    new = spark.createDataFrame([("a", T, "2"), ("c", None, "3")], schema)
    got = {r["url"]: r["content_hash"] for r in state.upsert(old, new).collect()}
    assert got == {"a": "2", "b": "1", "c": "3"}
    wanted = spark.createDataFrame([("a",), ("c",), ("new",)], "url string")
    now = F.lit(T + dt.timedelta(days=10))
    assert {r["url"]: r["fetch"] for r in state.staleness(wanted, state.upsert(old, new), now, 30).collect()} == {"a": False, "c": True, "new": True}
    assert {r["url"]: r["fetch"] for r in state.staleness(wanted, state.upsert(old, new), now, None).collect()} == {"a": False, "c": False, "new": True}


def test_orphans(spark):
    day = dt.timedelta(days=1)
    refs = spark.createDataFrame([("ok", T, 1), ("late", T, 2), ("gone", T + 40 * day, 3), ("back", T + 40 * day, 4), ("none", T, 5), ("ok", None, 6), (None, T, 7), ("ok", T, 1)], "target string, t timestamp, id int")
    parents = spark.createDataFrame(
        [("ok", T - 90 * day, 1, True), ("late", T + 8 * day, 2, True), ("gone", T, 3, True), ("gone", T + day, 4, False), ("back", T, 5, False), ("back", T + day, 6, True), ("x", None, 7, True)],
        "target string, time timestamp, rank long, good boolean",
    )
    assert sorted({r["id"] for r in orphans.orphan_references(refs, parents).collect()}) == [2, 3, 5]
    assert orphans.orphan_references(refs.where("false"), parents).count() == 0
    assert {r["id"] for r in orphans.orphan_references(refs, parents.where("false")).collect()} == {1, 2, 3, 4, 5}


def test_orphans_at_the_boundary_and_within_a_day(spark):
    hour = dt.timedelta(hours=1)
    week = dt.timedelta(days=7)
    refs = spark.createDataFrame([("a", T, 1), ("a", T + hour, 2), ("a", T + 3 * hour, 3)], "target string, t timestamp, id int")
    parents = spark.createDataFrame([("a", T + week, 1, True), ("a", T + week + 2 * hour, 2, False)], "target string, time timestamp, rank long, good boolean")
    assert {r["id"] for r in orphans.orphan_references(refs, parents).collect()} == {3}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10)] + [(20, 22), (22, 20), (5, 5), (None, 1)], "u long, v long")
    got = dict(connected_components(edges).collect())
    assert got == {**dict.fromkeys(range(11), 0), 20: 20, 22: 20}
    assert connected_components(edges.where("false")).count() == 0


SITEMAP = """<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://a.example/1?x=1&amp;y=2 </loc><lastmod>2024-01-15T10:30:00Z</lastmod><changefreq>daily</changefreq><priority>1.0</priority></url>
<url><loc>https://a.example/2</loc><priority>7</priority></url><url><priority>0.5</priority></url><url><loc>https://a.example/3</loc><changefreq>sometimes</changefreq><lastmod>2024-01-15</lastmod></url></urlset>"""


def test_sitemap_is_read_leniently(spark):
    rows = sitemaps.parse(spark.createDataFrame([("s", SITEMAP), ("n", None), ("b", "<urlset><url><loc>x")], "source string, xml string")).orderBy("pos").collect()
    assert [(r["loc"], r["changefreq"], r["priority"]) for r in rows] == [("https://a.example/1?x=1&y=2", "daily", 1.0), ("https://a.example/2", None, None), ("https://a.example/3", None, None)]
    assert rows[0]["lastmod"] == dt.datetime(2024, 1, 15, 10, 30) and rows[2]["lastmod"] is not None


def test_sitemap_index_and_load(spark):
    index = "<sitemapindex><sitemap><loc>b</loc></sitemap><sitemap><loc>a</loc></sitemap></sitemapindex>"
    found = sitemaps.resolve_index(spark.createDataFrame([("a", index), ("b", SITEMAP)], "source string, xml string"), spark.createDataFrame([("a",)], "source string"))
    assert {(r["source"], r["depth"]) for r in found.collect()} == {("a", 0), ("b", 1)}
    entries = spark.createDataFrame([("http://A.example/x", None, "daily", 0.2), ("http://a.example/x", None, None, None), (None, None, None, 1.0)], "loc string, lastmod timestamp, changefreq string, priority double")
    assert [tuple(r) for r in sitemaps.load(entries).collect()] == [("http://a.example/x", 0.5, 0)]


def test_quality(spark):
    def judge(html):
        row = spark.createDataFrame([(html,)], "h string").select(pages.quality(F.col("h")).alias("q"))
        return row.select(pages.needs_js(F.col("q")), pages.quality_points(F.col("q"))).first()

    shell = judge("<html><body><noscript>You need to enable JavaScript</noscript><div id='root'></div></body></html>")
    assert shell[0] is True and shell[1] < 30
    article = judge("<main><h1>a</h1><h2>b</h2><h3>c</h3>" + "<p>text of some length here</p>" * 100 + "<a href='/x'>y</a>" * 6 + "</main>")
    assert article[0] is False and article[1] == 100
    assert judge("")[1] == 0 and judge(None)[1] == 0


def test_markdown():
    html = "<nav><a href='/x'>menu</a></nav><h1>T &amp; U</h1><p>a <b>bold</b> <a href='/l'>link</a><p>c<ul><li>one<li>two</ul><pre><code>x\n y</code></pre><table><tr><th>h<td>v</table><script>no</script>"
    text = markdown.to_markdown(html, [], [markdown.selector("nav")])
    assert text == "# T & U\n\na **bold** [link](/l)\n\nc\n\n- one\n- two\n\n```\nx\n y\n```\n\n| h | v |\n| --- | --- |\n"
    assert markdown.to_markdown("<div class='a b'><p id=p1>x</p></div><p>y</p>", [markdown.selector("div.a p[id=p1]")]) == "x\n"
    assert markdown.to_markdown("<p>x</p>", [markdown.selector(".none")]) == "\n"
    assert markdown.to_markdown("<main><p>a</p><div><p>b</p></div></main>", [markdown.selector("main > p")]) == "a\n"
    assert markdown.to_markdown("<main><p>a</p><div><p>b</p></div></main>", [markdown.selector("main p, h1")]) == "a\n\nb\n"


def test_markdown_of_nested_and_broken_markup():
    text = markdown.to_markdown("<ul><li>a<ul><li>b<li>c</ul><li><p>d<p>e</ul><blockquote><p>q<p>r</blockquote>t <b>x <i>y</i></b><ol><li>1<li>2</ol><p><b>open<p>still</b> end<pre class='language-py'>k</pre><p>cut <a hr")
    assert text == "- a\n  - b\n  - c\n- d\n\n  e\n\n> q\n>\n> r\n\nt **x *y***\n\n1. 1\n2. 2\n\n**open**\n\n**still** end\n\n```py\nk\n```\n\ncut\n"
    assert markdown.to_markdown("<div>" * 30_000 + "deep" + "</div>" * 30_000) == "deep\n"
    with pytest.raises(ValueError):
        markdown.selector("a + b")


def test_markdown_cleaning(spark):
    row = spark.createDataFrame([("a  \r\n\n\n\nb\n\n",)], "t string").select(pages.clean_markdown(F.col("t")), pages.frontmatter(F.col("t"), F.lit("It's"), F.lit("http://x"), F.lit("2025")))
    cleaned, headed = row.first()
    assert cleaned == "a\n\nb\n" and "title: 'It''s'" in headed


def test_reports_of_nothing(spark):
    results = spark.createDataFrame([], "result_id long, url string, html string, status_code int, assets array<string>, queue_size int, fetched_at timestamp")
    assert reports.crawl_stats(results).first()["pages_crawled"] == 0
    assert reports.error_examples(results).count() == 0
    assert reports.path_collisions(results).count() == 0


def test_checkpoint_documents(spark):
    good = '{"version": 1, "config_name": "c", "config_hash": "h", "created_at": "2025-01-01T00:00:00Z", "pages": {"u": {"content_hash": "x", "last_scraped": "bad"}}, "queue": [["a", null], ["b", "a"]], "stats": {}}'
    rows = checkpoints.read_json(spark.createDataFrame([("good", good), ("old", good.replace('"version": 1', '"version": 0')), ("broken", "{"), ("none", None)], "name string, json string"))
    assert [r["name"] for r in rows.collect()] == ["good"]
    assert checkpoints.pages(rows).first()["last_scraped"] is None
    assert [(r["position"], r["url"], r["parent_url"]) for r in checkpoints.queue(rows).orderBy("position").collect()] == [(0, "a", None), (1, "b", "a")]
    assert checkpoints.config_hash({"start_urls": ["b", "a"]}) == checkpoints.config_hash({"start_urls": ["a", "b"]})


def test_checkpoint_versions(spark, tmp_path):
    rows = spark.createDataFrame([("u", 1)], "url string, n int")
    at = checkpoints.save(str(tmp_path), 3, rows, rows, rows)
    assert [x.count() for x in checkpoints.load(spark, at)] == [1, 1, 1]


def test_auth():
    assert auth.headers("Basic", username="u", password="p") == {"Authorization": "Basic dTpw"}
    assert auth.headers("cookie", cookies={"a": "1", "b": "2"}) == {"Cookie": "a=1; b=2"}
    assert auth.Token("t", 0, 100).expired(40) and not auth.Token("t", 0, 100).expired(39) and not auth.Token("t", 0).expired(1e9)


def test_fetch_keeps_hosts_together():
    reader = PageReader({"urls": "http://a.example/1\nhttp://b.example/1\nhttp://a.example/2", "partitions": "4"})
    assert sorted(sorted(p.addresses) for p in reader.partitions() if any("a.example" in u for u in p.addresses))[0][:2] == ["http://a.example/1", "http://a.example/2"]
    assert reader.fetch("http://127.0.0.1:9/")[-1] is not None


def test_transforms(spark):
    own = transforms.Registry()
    own.add("post_convert", "a", lambda c: F.concat(c, F.lit("a")))
    own.add("post_convert", "b", lambda c: F.concat(c, F.lit("b")))
    own.load(["no_such_module_here"])
    assert spark.createDataFrame([("x",)], "t string").select(own.markdown(F.col("t"))).first()[0] == "xab" and len(own.errors) == 1
    documents = spark.createDataFrame([(1, "docs/a.md", "[x](docs/b) [y](docs/c.md) [w](http://z) ![i](p.png) [f](#f)"), (2, "docs/b.md", None)], "doc_id long, path string, text string")
    assert [tuple(r) for r in transforms.broken_links(documents).collect()] == [(1, "docs/c.md")]


def test_rates():
    allowed, _, _ = pipeline.token_bucket([0, 0, 0, 1], rate=1, burst=2)
    assert allowed == [True, True, False, True]
    assert pipeline.adaptive_rate([(429, 1.0)]) == 5.0
    assert pipeline.adaptive_rate([(200, 0.1)] * 20) == 11.0
    assert pipeline.adaptive_rate([(429, 1.0)] * 20) == 0.5


def test_stream_upsert(spark, tmp_path):
    schema = "url string, html string, status_code int, fetched_at timestamp, etag string, last_modified string"
    land = str(tmp_path / "land")
    for i, html in enumerate(("one", "two")):
        spark.createDataFrame([("http://a.example/x", html, 200, T + dt.timedelta(days=i), None, None)], schema).coalesce(1).write.mode("append").parquet(land)
    rows = pipeline.saved_pages(pipeline.landing(spark, land, spark.read.parquet(land).schema, 1))
    pipeline.upsert_into(rows, str(tmp_path / "state"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    final = pipeline.current_state(spark, str(tmp_path / "state"), 1).collect()
    assert len(final) == 1 and final[0]["last_scraped"] == (T + dt.timedelta(days=1)).replace(tzinfo=None)


def test_rate_limited_stream(spark, tmp_path):
    at = str(tmp_path / "events")
    spark.createDataFrame([(1, T), (1, T), (1, T), (2, T)], "user_id long, ts timestamp").coalesce(1).write.parquet(at)
    events = spark.readStream.schema("user_id long, ts timestamp").parquet(at)
    query = pipeline.rate_limited(events, 1.0, 2.0).writeStream.outputMode("update").format("memory").queryName("limited").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("limited").collect()} == {(1, 3, 2), (2, 1, 1)}
