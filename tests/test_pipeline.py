"""Configuration, conversion, rewriting, sinks, fetching, state and streams."""

import datetime as dt
import gzip
import json
import os
import sqlite3
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from siltstone import cli, config
from siltstone.errors import ConfigError
from siltstone.functions import pages, rewriting
from siltstone.operators import convert, crawl, network, reports, sitemaps, transforms
from siltstone.sources import auth, checkpoints, fetch, files
from siltstone.streaming import pipeline

T = dt.datetime(2025, 1, 1, tzinfo=dt.UTC)
RAW = {"name": "quarry", "site": {"start_urls": ["https://q.example/"], "allowed_domains": ["q.example"]}}
RESULTS = "result_id long, url string, final_url string, html string, status_code int, content_type string, links array<string>, assets array<string>, fetched_at timestamp, etag string, last_modified string, queue_size int"


def result(n, url, html, status=200, kind="text/html", links=(), at=T):
    return (n, url, url, html, status, kind, list(links), [], at, None, None, 0)


SITE = [
    result(1, "https://q.example/", "<title>Start</title><main><h1>Start</h1><p><a href='https://q.example/a/'>a</a> <a href='https://other.example/'>o</a></main><footer>f</footer>", links=["https://q.example/a/", "https://other.example/"]),
    result(2, "https://q.example/a/", "<title>A's page</title><main><p>text <img src='/img/x.png' alt=''></main>", links=["https://q.example/b", "https://q.example/deep/1"]),
    result(3, "https://q.example/b", None, 404),
    result(4, "https://q.example/deep/1", "", 200),
    result(5, "https://q.example/never", "<p>unreached"),
    result(6, "https://q.example/file", "x", 200, "text/plain"),
]


def test_config():
    own = config.parse(RAW | {"crawling": {"include_patterns": [{"pattern": "/a", "type": "prefix"}], "depth_limit": 2}, "javascript": {"enabled": True}, "output": {"site_dir": "s"}})
    assert own.rules.depth_limit == 2 and own.js_mode == "enabled" and own.folders == {"root": "output/s", "docs": "output/s/docs", "assets": "output/s/assets"}
    assert checkpoints.config_hash(own.identity()) != checkpoints.config_hash(config.parse(RAW).identity())


@pytest.mark.parametrize(
    "raw",
    [None, [], {}, {"name": "x"}, RAW | {"name": "a/b"}, RAW | {"name": ".."}, RAW | {"name": " a"}, RAW | {"site": {"start_urls": [], "allowed_domains": ["x"]}}, RAW | {"crawling": {"depth_limit": -1}}, RAW | {"crawling": {"include_patterns": [{"pattern": "("}]}}, RAW | {"authentication": {"enabled": True}},
     RAW | {"authentication": {"enabled": True, "auth_type": "basic", "username": "u"}}, RAW | {"output": {"markdown": {"content_filtering": {"enabled": True}}}}, RAW | {"javascript": {"mode": "sometimes"}}],
)
def test_bad_config(raw):
    with pytest.raises(ConfigError):
        config.parse(raw)


def test_config_files(tmp_path):
    (tmp_path / "b.yml").write_text(config.generated("b", "https://b.example/", "b.example", "second"))
    (tmp_path / "a.yaml").write_text("name: [")
    rows = config.catalogue(str(tmp_path))
    assert [(r["file"], r["name"]) for r in rows] == [("a.yaml", None), ("b.yml", "b")] and rows[0]["error"]
    assert cli.main(["validate", str(tmp_path / "b.yml")]) == 0 and cli.main(["validate", str(tmp_path / "none.yml")]) == 2
    assert cli.main(["run", str(tmp_path / "b.yml"), "x", "--resume"]) == 2


def test_whole_run(spark, tmp_path):
    results = spark.createDataFrame(SITE, RESULTS)
    raw = RAW | {"output": {"base_dir": str(tmp_path / "out"), "markdown": {"content_filtering": {"enabled": True, "keep_selectors": ["main"]}}}}
    own = config.parse(raw)
    state = str(tmp_path / "state")
    dry = cli.run(spark, own, results, dry=True)
    assert dry["files"] == {"planned": 2} and not os.path.exists(tmp_path / "out")
    got = cli.run(spark, own, results, state=state, preview=None)
    assert got["files"] == {"written": 2} and got["errors"] == {"http/HTTP 404": 1, "empty/empty": 1}
    text = (tmp_path / "out/docs/index.md").read_text()
    assert text.startswith("---\nscraped_at: '2025-01-01T00:00:00Z'\ntitle: Start\nurl: https://q.example/\n---\n\n# Start\n") and "[a](a/index.md) [o](https://other.example/)" in text and "\nf" not in text
    assert (tmp_path / "out/docs/a/index.md").read_text().endswith("text ![](../../assets/img/x.png)\n")
    backend = checkpoints.TableBackend(spark, state, own.identity())
    assert backend.versions() == [1] and {r[0] for r in backend.urls().collect()} == {"https://q.example/", "https://q.example/a/"}
    assert checkpoints.TableBackend(spark, state, {"name": "other"}).load() is None
    again = cli.run(spark, own, results, state=state, resume=True, now=F.lit(T))
    assert again["files"] == {} and backend.versions() == [1, 2]


def test_rewriting(spark):
    layout = rewriting.Layout(("q.example",))
    cases = {
        "[x](https://q.example/b) and [y](/c/#f)": "[x](b.md) and [y](c/index.md)",
        "[x](https://sub.q.example/b) [m](mailto:a@b) [r](rel)": "[x](https://sub.q.example/b) [m](mailto:a@b) [r](rel)",
        "![i](/img/x.png) ![j](img/y.JPG) ![k](../z.png) ![l](page)": "![i](../assets/img/x.png) ![j](../assets/img/y.JPG) ![k](../z.png) ![l](page)",
        "no links": "no links",
        "": "",
    }
    rows = spark.createDataFrame([(t, "https://q.example/start") for t in cases] + [(None, "https://q.example/start"), ("[x](/b)", None)], "t string, u string")
    got = [r[0] for r in rows.select(rewriting.rewrite(F.col("t"), F.col("u"), layout)).collect()]
    assert got == [*cases.values(), None, "[x](/b)"]


def test_hooks_fail_by_row(spark):
    own = transforms.Registry()

    @transforms.python_transform
    def picky(text):
        if "bad" in text:
            raise ValueError("no")
        return text + "!"

    own.add("post_convert", "picky", picky)
    own.add("post_convert", "upper", lambda c: F.upper(c))
    rows = spark.createDataFrame([(1, "ok", None, None), (2, "bad", None, None), (3, None, "http", "HTTP 404")], "result_id long, text string, category string, error string")
    got = {r["result_id"]: (r["text"], r["category"], r["error"]) for r in own.convert(rows).collect()}
    assert got == {1: ("OK!", None, None), 2: ("BAD", "plugin", "picky: ValueError: no"), 3: (None, "http", "HTTP 404")}


def test_plugin_files_links_and_code(spark, tmp_path):
    at = tmp_path / "own.py"
    at.write_text("from pyspark.sql import functions as F\ndef register(r):\n    r.add('post_save', 'one', lambda df: df.limit(1))\n")
    own = transforms.Registry()
    own.load([str(at), str(tmp_path / "none.py")])
    assert own.table("post_save", spark.range(5)).count() == 1 and len(own.errors) == 1
    documents = spark.createDataFrame([(1, "docs/a.md", "[x](docs/b.md) [y](docs/none.md)"), (2, "docs/b.md", None)], "doc_id long, path string, text string")
    assert {r["doc_id"]: r["text"] for r in transforms.mark_broken(documents).collect()} == {1: "[x](docs/b.md) [y](docs/none.md) <!-- BROKEN LINK: docs/none.md -->", 2: None}
    pytest.importorskip("pygments")
    code = spark.createDataFrame([("a\n```python\nx = 1\n```\n```nolang\ny\n```",)], "t string").select(transforms.highlighted(F.col("t"))).first()[0]
    assert '<div class="highlight">' in code and "```nolang\ny\n```" in code


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "docs/a.md", "old"), (2, "docs/a.md", "new"), (3, "../out.md", "x"), (4, "docs/n.md", None)], "result_id long, path string, text string")
    got = {r["path"]: r["state"] for r in files.save_texts(rows, str(tmp_path)).collect()}
    assert got == {"docs/a.md": "written", "../out.md": "permission"} and (tmp_path / "docs/a.md").read_text() == "new" and not (tmp_path.parent / "out.md").exists()

    def get(url):
        if "bad" in url:
            raise TimeoutError("slow")
        return b"x" * (3 << 20 if "big" in url else 3)

    assets = spark.createDataFrame([("u/1", "docs/a.md"), ("u/2", "assets/2"), ("u/bad", "assets/3"), ("u/big", "assets/4"), (None, "assets/5")], "asset_url string, path string")
    written = files.save_assets(assets, str(tmp_path), get, 2.0)
    assert {r["path"]: r["state"] for r in written.collect()} == {"docs/a.md": "present", "assets/2": "written", "assets/3": "fetch", "assets/4": "too_large"}
    assert files.writer_summary(spark.createDataFrame([("a", 4, "written", None), ("b", 0, "io", "x")], files.WRITTEN)).first().asDict() == {"files": 1, "bytes": 4, "failures": 1, "mean_bytes": 4.0}
    files.save_document({"a": T}, str(tmp_path / "d/x.json"))
    assert json.loads((tmp_path / "d/x.json").read_text()) == {"a": str(T)}


class _Server(BaseHTTPRequestHandler):
    tries: dict = {}

    def do_GET(self):
        status, body, head = 200, b"<base href='/sub/'><a href='x#f'>l</a><img src=i.png><LINK rel='stylesheet' href=\"c.css\">", {"ETag": '"e"', "Content-Type": "text/html; charset=utf-8"}
        _Server.tries[self.path] = _Server.tries.get(self.path, 0) + 1
        if self.path == "/robots.txt":
            body, head = b"User-agent: *\nDisallow: /private", {"Content-Type": "text/plain"}
        elif self.path == "/flaky" and _Server.tries[self.path] == 1:
            status, body, head = 503, b"", {"Retry-After": "0"}
        elif self.path == "/missing":
            status, body = 404, b""
        elif self.path == "/big":
            body = b"x" * 2_000_000
        elif self.path == "/loop":
            status, body, head = 302, b"", {"Location": "/loop"}
        elif self.headers.get("If-None-Match") == '"e"':
            status, body = 304, b""
        self.send_response(status)
        for k, v in head.items():
            self.send_header(k, v)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture()
def server():
    own = ThreadingHTTPServer(("127.0.0.1", 0), _Server)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    _Server.tries.clear()
    yield f"http://127.0.0.1:{own.server_port}"
    own.shutdown()


def render():
    return lambda url: (url + "#shown", "<a href='/js'>x</a>")


def test_fetch(server):
    names = [f.split()[0] for f in fetch.SCHEMA.split(", ")]
    wanted = [{"url": server + "/page"}, {"url": server + "/page", "etag": '"e"'}, {"url": server + "/flaky"}, {"url": server + "/missing"}, {"url": server + "/big"}, {"url": server + "/private/x"}, {"url": server + "/loop"}]
    reader = fetch.PageReader({"requests": json.dumps(wanted), "maxMegabytes": "1", "backoff": "1", "jitter": "0", "retries": "1", "redirects": "2"})
    rows = [dict(zip(names, r, strict=True)) for p in reader.partitions() for r in reader.read(p)]
    page, unchanged, flaky, missing, big, loop = rows
    assert page["links"] == [server + "/sub/x"] and page["assets"] == [server + "/sub/c.css", server + "/sub/i.png"] and page["etag"] == '"e"' and page["attempts"] == 1
    assert unchanged["status_code"] == 304 and unchanged["not_modified"] and unchanged["html"] is None and unchanged["etag"] == '"e"'
    assert flaky["status_code"] == 200 and flaky["attempts"] == 2 and missing["error"] == "HTTP 404" and big["error"] == "FileTooLarge" and loop["html"] is None
    shown = fetch.RenderedReader({"urls": server + "/page", "renderer": "tests.test_pipeline:render", "robots": "false"})
    shown.renderer = (__name__, "render")
    row = dict(zip(names, next(shown.read(shown.partitions()[0])), strict=True))
    assert row["rendered"] and row["status_code"] == 200 and row["final_url"].endswith("#shown") and row["links"] == [server + "/js"]
    assert fetch.delay_before(3, 2.0, None) == 4.0 and fetch.delay_before(2, 2.0, "7") == 7.0 and fetch.delay_before(20, 2.0, None) == 120.0


def test_tokens():
    asked = []

    def post(url, fields):
        asked.append(fields)
        return {"access_token": f"t{len(asked)}", "expires_in": 100}

    session = auth.Session({"auth_type": "OAuth2", "token_url": "u", "client_id": "i", "client_secret": "s"}, post)
    assert [session.headers(t)["Authorization"] for t in (0, 39, 40)] == ["Bearer t1", "Bearer t1", "Bearer t2"]
    assert auth.Session({"enabled": False}).headers() == {}
    with pytest.raises(ValueError):
        auth.fetch_token("u", "i", "s", post=lambda *_: {})


def test_links_by_base_tag(spark):
    html = "<base href='/docs/'><a href=\"x\">1</a><a href='X/../x'>2</a><A HREF=mailto:a@b>3</A><a href=' '>4</a>"
    assert spark.createDataFrame([(html,)], "h string").select(pages.links(F.col("h"), F.lit("https://q.example/a"))).first()[0] == ["https://q.example/docs/x"]


def test_quality_looks_for_notices_in_noscript_only(spark):
    text = "<p>Your browser may not support this, so enable it in JavaScript settings</p>"
    rows = spark.createDataFrame([(text,), ("<noscript>Please\nenable JavaScript</noscript>",), ("<noscript>Please enable\nJS</noscript>",), (None,)], "h string")
    assert [r[0] for r in rows.select(pages.quality(F.col("h"))["has_noscript_warning"]).collect()] == [False, True, False, False]


def test_deep_graphs_and_indexes(spark):
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(14)], "src string, dst string")
    got = crawl.breadth_first(spark.createDataFrame([("n000",)], "url string"), chain)
    assert got.agg(F.max("depth"), F.count("*")).first() == (14, 15)
    documents = spark.createDataFrame([(f"s{i}", f"<sitemapindex><sitemap><loc>s{i + 1}</loc></sitemap></sitemapindex>") for i in range(12)], "source string, xml string")
    assert sitemaps.resolve_index(documents, spark.createDataFrame([("s0",)], "source string")).count() == 13
    assert sitemaps.load(spark.createDataFrame([("http://a.example/1", None, None, 0.2, 7), ("http://a.example/2", None, None, 0.9, 9), ("http://a.example/3", None, None, 0.9, 8)], "loc string, lastmod timestamp, changefreq string, priority double, pos int"), position="pos").orderBy("place").select("url").collect()[0][0].endswith("/3")


def test_packed_sitemaps(spark):
    xml = b"<urlset><url><loc>https://q.example/1</loc></url></urlset>"
    rows = spark.createDataFrame([("https://q.example/s.xml.gz", gzip.compress(xml)), ("https://q.example/bad.gz", b"no gzip"), ("https://q.example/s.xml", xml), (None, None)], "source string, content binary")
    got = {r["source"]: r["xml"] for r in sitemaps.decompressed(rows).collect()}
    assert got == {"https://q.example/s.xml.gz": xml.decode(), "https://q.example/bad.gz": "no gzip", "https://q.example/s.xml": xml.decode(), None: None}
    assert sitemaps.strict(sitemaps.parse(sitemaps.decompressed(rows))).count() == 2


def test_sqlite_and_legacy(spark, tmp_path):
    at = str(tmp_path / "c.db")
    with sqlite3.connect(at) as db:
        db.execute("CREATE TABLE pages (url TEXT PRIMARY KEY, content_hash TEXT, last_scraped TEXT, status_code INTEGER, file_path TEXT)")
        db.executemany("INSERT INTO pages VALUES (?, 'h', '2025-01-01T00:00:00', 200, 'f')", [(f"u{i}",) for i in range(25)])
    rows = checkpoints.read_sqlite(spark, at, "pages", 10)
    assert rows.count() == 25 and rows.agg(F.sum("status_code")).first()[0] == 5000
    with pytest.raises(ValueError):
        checkpoints.read_sqlite(spark, at, "sqlite_master")
    old = spark.createDataFrame([("c", '{"version": 1, "config_name": "c", "config_hash": "h", "created_at": "2025-01-01T00:00:00Z", "pages": {"u": {"status_code": 200}}, "queue": []}')], "name string, json string")
    assert checkpoints.pages(checkpoints.read_legacy(old)).first()["etag"] is None and checkpoints.read_legacy(old).first()["stats"] == {}


def test_network_tables_of_nothing(spark):
    empty = spark.createDataFrame([], "hit boolean, ms double")
    assert network.lookup_summary(empty).first().asDict() == {"lookups": 0, "hits": 0, "hit_percent": 0.0, "mean_ms": 0.0}
    assert network.progress(spark.createDataFrame([], "queue_size int"), F.col("queue_size")).first()["percent"] == 100.0
    assert reports.summary(spark.createDataFrame([], RESULTS)).first()["pages_per_second"] is None
    assert [spark.range(1).select(network.memory_state(F.lit(x).cast("double"))).first()[0] for x in (0.5, 0.9, 0.99, None)] == ["go", "warn", "stop", "go"]
    assert convert.expanded(spark.createDataFrame([("a", 2), ("b", 0), ("c", None)], "type string, errors long")).count() == 2


def test_late_rows_are_left_out(spark, tmp_path):
    land = str(tmp_path / "land")
    hour = dt.timedelta(hours=1)
    for times in ([T, T + 6 * hour], [T + 7 * hour], [T + hour / 2, T + 12 * hour], [T + 20 * hour]):
        spark.createDataFrame([(1, t, "view", 1.0) for t in times], "user_id long, ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(land)
    stream = spark.readStream.schema("user_id long, ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(land)
    out = str(tmp_path / "out")
    pipeline.tumbling_counts(stream).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).orderBy("start").collect()
    assert [r["events"] for r in rows][:1] == [1] and sum(r["events"] for r in rows) == 4


def test_adaptive_limits_of_a_stream(spark, tmp_path):
    at = str(tmp_path / "answers")
    rows = [("a", T + dt.timedelta(seconds=i), 200, 0.1) for i in range(25)] + [("b", T, 429, 0.1), ("b", T, None, None)]
    spark.createDataFrame(rows, "host string, t timestamp, status int, seconds double").coalesce(1).write.parquet(at)
    stream = spark.readStream.schema("host string, t timestamp, status int, seconds double").parquet(at)
    query = pipeline.adaptive_limits(stream).writeStream.outputMode("update").format("memory").queryName("limits").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r[0], r[1], round(r[2], 6)) for r in spark.table("limits").collect()} == {("a", 25, 11.0), ("b", 2, 4.75)}
