"""Configuration of a crawl: a YAML file to frozen values, checked as a whole."""

from __future__ import annotations

import glob
import os
import re
from dataclasses import dataclass, field

from siltstone.errors import ConfigError
from siltstone.functions.rewriting import Layout
from siltstone.operators.rules import PathPattern, Rules

# Signs that no folder's name may have, and what each kind of authentication needs.
FORBIDDEN = '/\\:*?"<>|'
NEEDED = {"basic": ("username", "password"), "cookie": ("cookies",), "header": ("headers",), "oauth2": ("client_id", "client_secret", "token_url")}
JS_MODES = ("disabled", "enabled", "auto")


@dataclass(frozen=True)
class Config:
    name: str
    start_urls: tuple[str, ...]
    allowed_domains: tuple[str, ...]
    description: str = ""
    include: tuple[PathPattern, ...] = ()
    exclude: tuple[PathPattern, ...] = ()
    depth_limit: int | None = None
    max_pages: int | None = None
    delay: float = 0.1
    retries: int = 3
    backoff: float = 2.0
    page_limit_mb: float | None = 10.0
    asset_limit_mb: float | None = 50.0
    respect_robots: bool = True
    link_selectors: tuple[str, ...] = ("a[href]",)
    js_mode: str = "disabled"
    js_least_points: int = 30
    sitemap: dict = field(default_factory=dict)
    checkpoint: dict = field(default_factory=dict)
    authentication: dict = field(default_factory=dict)
    base_dir: str = "output"
    site_dir: str | None = None
    docs_dir: str = "docs"
    assets_dir: str = "assets"
    strip_prefix: str = ""
    index_file: str = "index.md"
    frontmatter: bool = True
    keep_selectors: tuple[str, ...] = ()
    remove_selectors: tuple[str, ...] = ()
    download_assets: bool = True
    plugins: tuple[str, ...] = ()

    @property
    def rules(self) -> Rules:
        return Rules(self.allowed_domains, self.include, self.exclude, self.depth_limit)

    @property
    def layout(self) -> Layout:
        return Layout(self.allowed_domains, self.docs_dir, self.assets_dir, self.strip_prefix, self.index_file)

    @property
    def folders(self) -> dict[str, str]:
        return self.layout.folders(self.base_dir, self.site_dir)

    def identity(self) -> dict:
        """What decides which pages are visited; see ``checkpoints.config_hash``."""
        pattern = lambda p: {"pattern": p.pattern, "type": p.kind}
        return {"name": self.name, "start_urls": list(self.start_urls), "allowed_domains": list(self.allowed_domains), "include": [pattern(p) for p in self.include], "exclude": [pattern(p) for p in self.exclude], "depth_limit": self.depth_limit, "link_selectors": list(self.link_selectors)}


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigError(message)


def check_name(name: str) -> str:
    """A name that can be a folder's."""
    _check(isinstance(name, str) and bool(name), "name is missing")
    _check(not any(c in name for c in FORBIDDEN), f"name has signs that no folder's name may have: {name!r}")
    _check(name not in (".", ".."), f"name is no folder's: {name!r}")
    _check(name == name.strip(), f"name begins or ends with blanks: {name!r}")
    return name


def check_authentication(own: dict) -> dict:
    """Fields of the chosen kind; nothing is needed while it is switched off."""
    if own.get("enabled"):
        kind = str(own.get("auth_type") or "").lower()
        _check(kind in NEEDED, f"auth_type must be one of {', '.join(NEEDED)}")
        missing = [k for k in NEEDED[kind] if not own.get(k)]
        _check(not missing, f"{kind} authentication needs {', '.join(missing)}")
    return own


def _patterns(rows: list | None) -> tuple[PathPattern, ...]:
    out = []
    for row in rows or ():
        _check(isinstance(row, dict) and "pattern" in row, f"not a pattern: {row!r}")
        kind = row.get("type", "regex")
        _check(kind in ("regex", "glob", "prefix"), f"unknown kind of pattern: {kind}")
        if kind == "regex":
            try:
                re.compile(row["pattern"])
            except re.error as e:
                raise ConfigError(f"pattern {row['pattern']!r}: {e}") from e
        out.append(PathPattern(row["pattern"], kind))
    return tuple(out)


def _number(own: dict, key: str, default, least):
    value = own.get(key, default)
    _check(value is None or (isinstance(value, (int, float)) and not isinstance(value, bool) and value >= least), f"{key} must be a number from {least} on")
    return value


def parse(raw: object) -> Config:
    """Config of a parsed document; what is wrong or missing is a ConfigError."""
    _check(isinstance(raw, dict) and bool(raw), "the configuration must be a mapping")
    part = lambda name, of=raw: of.get(name) or {}
    for name in ("site", "crawling", "output", "javascript", "assets", "plugins", "sitemap", "checkpoint", "authentication"):
        _check(isinstance(part(name), dict), f"{name} must be a mapping")
    site, crawling, output, js = part("site"), part("crawling"), part("output"), part("javascript")
    _check(bool(site.get("start_urls")), "site.start_urls needs one address at least")
    _check(bool(site.get("allowed_domains")), "site.allowed_domains needs one domain at least")
    written, paths = output.get("markdown") or {}, output.get("path_mapping") or {}
    filtering = written.get("content_filtering") or {}
    keep, remove = tuple(filtering.get("keep_selectors") or ()), tuple(filtering.get("remove_selectors") or ())
    if filtering.get("enabled"):
        _check(bool(keep or remove), "content_filtering needs keep_selectors or remove_selectors")
    mode = js.get("mode", "disabled")
    if js.get("enabled") and mode == "disabled":
        mode = "enabled"  # an older way to say so
    _check(mode in JS_MODES, f"javascript.mode must be one of {', '.join(JS_MODES)}")
    plugins = part("plugins")
    on = bool(filtering.get("enabled"))
    return Config(
        name=check_name(raw.get("name")),
        description=raw.get("description") or "",
        start_urls=tuple(site["start_urls"]),
        allowed_domains=tuple(site["allowed_domains"]),
        include=_patterns(crawling.get("include_patterns")),
        exclude=_patterns(crawling.get("exclude_patterns")),
        depth_limit=_number(crawling, "depth_limit", None, 0),
        max_pages=_number(crawling, "max_pages", None, 1),
        delay=_number(crawling, "delay_between_requests", 0.1, 0),
        retries=_number(crawling, "max_retries", 3, 0),
        backoff=_number(crawling, "retry_backoff", 2.0, 1),
        page_limit_mb=_number(crawling, "max_page_size_mb", 10.0, 0),
        asset_limit_mb=_number(crawling, "max_asset_size_mb", 50.0, 0),
        respect_robots=bool(crawling.get("respect_robots_txt", True)),
        link_selectors=tuple(crawling.get("link_selectors") or ("a[href]",)),
        js_mode=mode,
        js_least_points=round(100 * _number(js, "auto_quality_threshold", 0.3, 0)),
        sitemap=part("sitemap"),
        checkpoint=part("checkpoint"),
        authentication=check_authentication(part("authentication")),
        base_dir=output.get("base_dir") or "output",
        site_dir=output.get("site_dir"),
        docs_dir=output.get("docs_dir") or "docs",
        assets_dir=output.get("assets_dir") or "assets",
        strip_prefix=paths.get("strip_prefix") or "",
        index_file=paths.get("index_file") or "index.md",
        frontmatter=bool(written.get("add_frontmatter", True)),
        keep_selectors=keep if on else (),
        remove_selectors=remove if on else (),
        download_assets=bool(part("assets").get("download", True)),
        plugins=tuple(plugins.get("plugins") or ()) if plugins.get("enabled") else (),
    )


def load(path: str) -> Config:
    """Config of a YAML file."""
    import yaml

    try:
        with open(path, encoding="utf-8") as f:
            raw = yaml.safe_load(f)
    except (OSError, yaml.YAMLError) as e:
        raise ConfigError(f"{path}: {e}") from e
    return parse(raw)


def generated(name: str, start_url: str, domain: str, description: str = "") -> str:
    """Text of a new configuration file."""
    import yaml

    own = {"name": check_name(name), "description": description, "site": {"start_urls": [start_url], "allowed_domains": [domain]}, "crawling": {"depth_limit": 3, "respect_robots_txt": True}, "output": {"base_dir": "output"}}
    parse(own)
    return yaml.safe_dump(own, sort_keys=False)


def catalogue(folder: str) -> list[dict]:
    """(file, name, description) of the configuration files of a folder, in order of their names; what cannot be read has its error."""
    out = []
    for path in sorted([*glob.glob(os.path.join(folder, "*.yaml")), *glob.glob(os.path.join(folder, "*.yml"))], key=os.path.basename):
        try:
            own = load(path)
            out.append({"file": os.path.basename(path), "name": own.name, "description": own.description})
        except ConfigError as e:
            out.append({"file": os.path.basename(path), "name": None, "description": None, "error": str(e)})
    return out
