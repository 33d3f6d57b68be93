"""Fetching pages as a Python data source; batch reads of a list of addresses, spread over partitions by host."""

from __future__ import annotations

import hashlib
import importlib
import json
import random
import re
import time
from collections import defaultdict
from collections.abc import Callable, Iterator
from html import unescape
from urllib.error import HTTPError, URLError
from urllib.parse import urljoin, urlsplit
from urllib.request import HTTPRedirectHandler, Request, build_opener
from urllib.robotparser import RobotFileParser

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siltstone.sources.auth import Session

SCHEMA = (
    "url string, final_url string, html string, status_code int, content_type string, links array<string>, assets array<string>, content_hash string, "
    "etag string, last_modified string, not_modified boolean, rendered boolean, attempts int, error string"
)
RETRYABLE = (429, 500, 502, 503, 504)
_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(style|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"""<(a|img|link|script|base)\s((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.I)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def links_and_assets(html: str, base: str) -> tuple[list[str], list[str]]:
    """Sorted distinct absolute http(s) links, and images, style sheets and scripts of any scheme; the first base tag counts."""
    found: list[tuple[str, str]] = []
    own_base = None
    for tag, attrs in _TAG.findall(_RAW.sub("", html)):
        tag = tag.lower()
        values = {}
        for name, a, b, c in _ATTR.findall(attrs):
            values.setdefault(name.lower(), unescape(a or b or c).strip())
        if tag == "base":
            own_base = values.get("href") or None if own_base is None else own_base
        elif tag == "link":
            if values.get("rel", "").lower() == "stylesheet":
                found.append(("asset", values.get("href", "")))
        else:
            found.append(("link" if tag == "a" else "asset", values.get("href" if tag == "a" else "src", "")))
    base = urljoin(base, own_base) if own_base else base
    out: dict[str, set[str]] = {"link": set(), "asset": set()}
    for kind, target in found:
        if target:
            try:
                whole = urljoin(base, target)
            except ValueError:
                continue
            if kind == "asset" or urlsplit(whole).scheme.lower() in ("http", "https"):
                out[kind].add(whole.partition("#")[0] if kind == "link" else whole)
    return sorted(out["link"]), sorted(out["asset"])


def delay_before(attempt: int, backoff: float, retry_after: str | None, longest: float = 120.0, jitter: float = 0.0) -> float:
    """Seconds to wait before attempt ``attempt`` (from 2): what the server asks for, else growing by ``backoff``."""
    if retry_after and retry_after.strip().isdigit():
        return min(longest, float(retry_after))
    return min(longest, backoff ** (attempt - 1)) * (1 + random.uniform(-jitter, jitter))


class _Redirects(HTTPRedirectHandler):
    def __init__(self, most: int):
        self.max_redirections = most
        self.max_repeats = most


class _Hosts(InputPartition):
    def __init__(self, rows: list[dict]):
        super().__init__(0)
        self.rows = rows

    @property
    def addresses(self) -> list[str]:
        return [r["url"] for r in self.rows]


class PageReader(DataSourceReader):
    """Options: ``urls`` (one a line) or ``requests`` (a JSON list of url, etag, last_modified), partitions, delay, timeout, maxMegabytes, retries, backoff, jitter, redirects, robots, userAgent, auth (JSON)."""

    rendered = False

    def __init__(self, options: dict[str, str]):
        self.requests = json.loads(options["requests"]) if options.get("requests") else [{"url": u} for u in options.get("urls", "").split("\n") if u.strip()]
        self.delay = float(options.get("delay", "0"))
        self.timeout = float(options.get("timeout", "30"))
        self.limit = int(float(options.get("maxMegabytes", "10")) * 1048576)
        self.parts = int(options.get("partitions", "8"))
        self.tries = 1 + int(options.get("retries", "3"))
        self.backoff = float(options.get("backoff", "2"))
        self.jitter = float(options.get("jitter", "0.3"))
        self.redirects = int(options.get("redirects", "10"))
        self.robots = options.get("robots", "true").lower() == "true"
        self.agent = options.get("userAgent", "Mozilla/5.0 (compatible)")
        self.auth = json.loads(options.get("auth", "{}"))

    def partitions(self) -> list[InputPartition]:
        """All addresses of a host are in one partition, so its delay is kept."""
        parts = defaultdict(list)
        for row in self.requests:
            host = (urlsplit(row["url"]).hostname or "").encode()
            parts[int.from_bytes(hashlib.sha256(host).digest()[:4], "big") % self.parts].append(row)
        return [_Hosts(x) for x in parts.values()]

    def read(self, partition: _Hosts) -> Iterator[tuple]:
        rules: dict[str, RobotFileParser | None] = {}
        session = Session(self.auth)
        for number, row in enumerate(partition.rows):
            if number and self.delay:
                time.sleep(self.delay)
            if self.robots and not self._allowed(row["url"], rules):
                continue  # not fetched, and no failure
            yield self.fetch(row["url"], row.get("etag"), row.get("last_modified"), session)

    def _allowed(self, url: str, rules: dict[str, RobotFileParser | None]) -> bool:
        """By the robots file of the address's origin; one that cannot be read allows all."""
        at = urlsplit(url)
        origin = f"{at.scheme}://{at.netloc}"
        if origin not in rules:
            parser = RobotFileParser()
            try:
                with build_opener().open(Request(origin + "/robots.txt", headers={"User-Agent": self.agent}), timeout=self.timeout) as answer:
                    parser.parse(answer.read(1 << 19).decode("utf-8", "replace").splitlines())
                rules[origin] = parser
            except (OSError, ValueError):
                rules[origin] = None
        found = rules[origin]
        return found is None or found.can_fetch(self.agent, url)

    def fetch(self, url: str, etag: str | None = None, last_modified: str | None = None, session: Session | None = None) -> tuple:
        """One row; what was fetched before is asked for under its marks, and an answer 304 has no html. Answers that may pass are asked for again."""
        attempt = 1
        while True:
            row, again = self._once(url, etag, last_modified, session, attempt)
            if again is None or attempt >= self.tries:
                return row
            attempt += 1
            time.sleep(delay_before(attempt, self.backoff, again, jitter=self.jitter))

    def _once(self, url: str, etag: str | None, last_modified: str | None, session: Session | None, attempt: int) -> tuple[tuple, str | None]:
        """(row, what to wait for before another attempt; None for no other)."""

        def failed(final: str | None, status: int | None, kind: str | None, error: str | None, unchanged: bool = False) -> tuple:
            return (url, final, None, status, kind, [], [], None, etag if unchanged else None, last_modified if unchanged else None, unchanged, self.rendered, attempt, error)

        try:
            asked = {"User-Agent": self.agent} | (session.headers() if session else {})
            asked |= {k: v for k, v in (("If-None-Match", etag), ("If-Modified-Since", last_modified)) if v}
            with build_opener(_Redirects(self.redirects)).open(Request(url, headers=asked), timeout=self.timeout) as answer:
                kind = answer.headers.get("Content-Type", "")
                stated = answer.headers.get("Content-Length", "")
                if stated.isdigit() and int(stated) > self.limit:
                    return failed(answer.url, answer.status, kind, "FileTooLarge"), None
                body = answer.read(self.limit + 1)
                if len(body) > self.limit:
                    return failed(answer.url, answer.status, kind, "FileTooLarge"), None
                if "text/html" not in kind.lower():
                    return failed(answer.url, answer.status, kind, None), None
                html = body.decode(answer.headers.get_content_charset() or "utf-8", "replace")
                return self._row(url, answer.url, html, answer.status, kind, answer.headers.get("ETag"), answer.headers.get("Last-Modified"), attempt), None
        except HTTPError as e:
            if e.code == 304:
                return failed(e.url, 304, e.headers.get("Content-Type"), None, True), None
            return failed(e.url, e.code, e.headers.get("Content-Type"), f"HTTP {e.code}"), (e.headers.get("Retry-After") or "") if e.code in RETRYABLE else None
        except (URLError, OSError, ValueError, LookupError) as e:
            return failed(None, None, None, f"{type(e).__name__}: {e}"), "" if isinstance(e, OSError) else None

    def _row(self, url: str, final: str, html: str, status: int, kind: str, etag: str | None, modified: str | None, attempt: int) -> tuple:
        links, assets = links_and_assets(html, final)
        return (url, final, html, status, kind, links, assets, hashlib.sha256(html.encode("utf-8", "replace")).hexdigest(), etag, modified, False, self.rendered, attempt, None)


class RenderedReader(PageReader):
    """Pages as a browser shows them. ``renderer`` names a function ("module:function") that starts what renders and gives a function from an address to (final address, html), optionally with a method ``close``; one is started a task."""

    rendered = True

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        module, _, name = options["renderer"].partition(":")
        self.renderer = (module, name)

    def read(self, partition: _Hosts) -> Iterator[tuple]:
        start: Callable = getattr(importlib.import_module(self.renderer[0]), self.renderer[1])
        render = start()
        rules: dict[str, RobotFileParser | None] = {}
        try:
            for row in partition.rows:
                if self.robots and not self._allowed(row["url"], rules):
                    continue
                try:
                    final, html = render(row["url"])
                    yield self._row(row["url"], final, html, 200, "text/html", None, None, 1)  # a browser tells no status
                except Exception as e:  # noqa: BLE001 - whatever a browser raises
                    yield (row["url"], None, None, None, None, [], [], None, None, None, False, True, 1, f"{type(e).__name__}: {e}")
        finally:
            getattr(render, "close", lambda: None)()


class PageSource(DataSource):
    """``spark.dataSource.register(PageSource)``, then ``spark.read.format("pages").option("urls", ...)``; with an option ``renderer`` pages are rendered."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return RenderedReader(self.options) if "renderer" in self.options else PageReader(self.options)


def requests_of(wanted) -> str:
    """The option ``requests`` of a frontier with headers (``state.conditional_headers``): a list that fits one read of the source."""
    rows = wanted.selectExpr("url", "headers['If-None-Match'] AS etag", "headers['If-Modified-Since'] AS last_modified").toLocalIterator()
    return json.dumps([r.asDict() for r in rows])
