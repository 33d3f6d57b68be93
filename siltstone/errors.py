"""Errors of the engine."""


class EngineError(Exception):
    """Any error that the engine raises itself."""


class ConfigError(EngineError):
    """A configuration that cannot be used."""


class SitemapError(EngineError):
    """A sitemap that cannot be read, where reading is strict."""


class ConversionError(EngineError):
    """A page that cannot be converted."""


class StatusError(EngineError):
    """An answer with a status of 400 or more."""

    def __init__(self, status: int, url: str):
        super().__init__(f"HTTP {status}: {url}")
        self.status, self.url = status, url
