"""Request headers of the kinds of authentication; secrets stay on the driver and in source options."""

from __future__ import annotations

import base64
import json
import time
from dataclasses import dataclass
from urllib.parse import urlencode
from urllib.request import Request, urlopen

#: Seconds before its end at which a token counts as expired.
EXPIRY_BUFFER = 60


@dataclass(frozen=True)
class Token:
    value: str
    obtained_at: float
    expires_in: float | None = None

    def expired(self, now: float) -> bool:
        return self.expires_in is not None and now - self.obtained_at >= self.expires_in - EXPIRY_BUFFER


def headers(kind: str, *, username: str = "", password: str = "", cookies: dict[str, str] | None = None, extra: dict[str, str] | None = None, token: Token | None = None) -> dict[str, str]:
    """Headers for kind "basic", "cookie", "header" or "oauth2"; case does not matter."""
    kind = kind.lower()
    if kind == "basic":
        return {"Authorization": "Basic " + base64.b64encode(f"{username}:{password}".encode()).decode()}
    if kind == "cookie":
        return {"Cookie": "; ".join(f"{k}={v}" for k, v in (cookies or {}).items())}
    if kind == "header":
        return dict(extra or {})
    if kind == "oauth2":
        if token is None:
            raise ValueError("oauth2 needs a token")
        return {"Authorization": f"Bearer {token.value}"}
    raise ValueError(f"unknown kind of authentication: {kind}")


def fetch_token(token_url: str, client_id: str, client_secret: str, scope: str = "", now: float | None = None, post=None) -> Token:
    """Token of the client-credentials flow; ``post(url, fields)`` gives the answer's parsed body and can be replaced in tests."""
    fields = {"grant_type": "client_credentials", "client_id": client_id, "client_secret": client_secret} | ({"scope": scope} if scope else {})
    answer = (post or _post)(token_url, fields)
    if not isinstance(answer, dict) or not answer.get("access_token"):
        raise ValueError("the token address gave no access_token")
    ends = answer.get("expires_in")
    return Token(str(answer["access_token"]), time.time() if now is None else now, None if ends is None else float(ends))


def _post(url: str, fields: dict[str, str]) -> dict:
    with urlopen(Request(url, data=urlencode(fields).encode(), headers={"Accept": "application/json"}), timeout=30) as answer:  # noqa: S310
        return json.loads(answer.read())


class Session:
    """Headers of one configuration over time: a token is fetched when there is none that holds."""

    def __init__(self, config: dict, post=None):
        self.config, self.post = config, post
        self.token: Token | None = None

    def headers(self, now: float | None = None) -> dict[str, str]:
        own = self.config
        if not own or not own.get("enabled", True):
            return {}
        kind = str(own.get("auth_type", "")).lower()
        now = time.time() if now is None else now
        if kind == "oauth2" and (self.token is None or self.token.expired(now)):
            self.token = fetch_token(own["token_url"], own["client_id"], own["client_secret"], own.get("scope", ""), now, self.post)
        return headers(kind, username=own.get("username", ""), password=own.get("password", ""), cookies=own.get("cookies"), extra=own.get("headers"), token=self.token)
