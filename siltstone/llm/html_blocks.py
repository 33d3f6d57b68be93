"""Text blocks of an HTML page, found in one pass without a document tree.

A block is an element of ``BLOCK_TAGS``; blocks are numbered from 1 by the
order of their start tags. Tags inside comments, raw-text elements and
attribute values do not count. A block ends at its end tag; if that is
missing, at the next tag that is not inline. Blocks do not nest.

NULL and empty html have no blocks.
"""

from __future__ import annotations

import html as _html
import re
from typing import NamedTuple

# Fixed values of the block definition.
BLOCK_TAGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "pre", "td", "th", "dt", "dd"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
LINE_TAGS = HEADINGS | {"p", "li"}

# Marks that stand for inline tags while a page is cut into blocks. They are
# control characters, which HTML forbids in text; stray ones are removed first.
LINK_ON, LINK_OFF, CODE_ON, CODE_OFF = "\x01", "\x02", "\x03", "\x04"
_MARKS = re.compile("[\x01-\x04]")

_ATTRS = r"""[^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+"""
_DROPPED = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b" + _ATTRS + r">.*?(?:</\1\s*>|\Z)|<[!?][^>]*>",
    re.S | re.I,
)
_ANCHOR = re.compile(r"<a(?:\s" + _ATTRS + r")?>", re.I)
_ANCHOR_END = re.compile(r"</a\s*>", re.I)
_CODE = re.compile(r"<code(?:\s" + _ATTRS + r")?>", re.I)
_CODE_END = re.compile(r"</code\s*>", re.I)
_INLINE = re.compile(r"</?(?:b|em|strong)(?:\s" + _ATTRS + r")?>", re.I)
_TAG = re.compile(r"<(/?[a-zA-Z][a-zA-Z0-9-]*)(?:[\s/]" + _ATTRS + r")?>")
_CUT_TAG = re.compile(r"<[/a-zA-Z!][^<>]*\Z")
_MARKED = re.compile("[\x01-\x04]")
_LINKED = re.compile("\\s*\x01[^\x01\x02]*\x02\\s*\\Z")
_CODED = re.compile("\x03[^\x04]*(?:\x04|\\Z)")


class Block(NamedTuple):
    """``raw`` keeps the marks and character references; ``before`` is the text between the last block and this one."""

    tag: str
    raw: str
    before: str


def split_tags(page: str) -> list[str]:
    """Alternating text and tag names (``/name`` for end tags), inline tags replaced by marks."""
    if _MARKS.search(page):
        page = _MARKS.sub("", page)
    if "<!" in page or "<?" in page or "<s" in page or "<S" in page or "<n" in page or "<N" in page or "<t" in page or "<T" in page:
        page = _DROPPED.sub("", page)
    page = _ANCHOR.sub(LINK_ON, page)
    page = _ANCHOR_END.sub(LINK_OFF, page)
    page = _CODE.sub(CODE_ON, page)
    page = _CODE_END.sub(CODE_OFF, page)
    page = _INLINE.sub("", page)
    parts = _TAG.split(page)
    if "<" in parts[-1]:
        parts[-1] = _CUT_TAG.sub("", parts[-1])
    return parts


def blocks_of_parts(parts: list[str]) -> list[Block]:
    """Blocks of what :func:`split_tags` gives."""
    return blocks_and_rest(parts)[0]


def blocks_and_rest(parts: list[str]) -> tuple[list[Block], str]:
    """Blocks of what :func:`split_tags` gives, and the text after the last one."""
    out: list[Block] = []
    block_tags = BLOCK_TAGS
    count = len(parts)
    outside: list[str] = [parts[0]] if parts else []
    i = 1
    while i < count:
        name = parts[i].lower()
        if name not in block_tags:
            outside.append(parts[i + 1])
            i += 2
            continue
        text = parts[i + 1]
        j = i + 2
        if j < count:
            end = "/" + name
            found = parts[j].lower()
            if found != end and found not in block_tags:
                # Another tag comes first: look for the end tag before the next block.
                k, more = j, [text]
                while k < count:
                    found = parts[k].lower()
                    if found == end:
                        text = "".join(more)
                        j = k
                        break
                    if found in block_tags:
                        break
                    more.append(parts[k + 1])
                    k += 2
        out.append(Block(name, text, "\n".join(outside)))
        outside = []
        if j < count and parts[j].lower() not in block_tags:
            outside.append(parts[j + 1])
            j += 2
        i = j
    return out, "\n".join(outside)


def blocks(page: str | None) -> list[Block]:
    """All blocks of a page in order; none for NULL or empty html."""
    return blocks_of_parts(split_tags(page)) if page else []


def plain(raw: str) -> str:
    """Text of a block: marks dropped, character references decoded; white space stays."""
    if "\x01" in raw or "\x03" in raw or "\x02" in raw or "\x04" in raw:
        raw = _MARKED.sub("", raw)
    return _html.unescape(raw) if "&" in raw else raw


def without_code(raw: str) -> str:
    """Text of a block without what stands in code marks."""
    return plain(_CODED.sub(" ", raw) if CODE_ON in raw else raw)


def is_linked(raw: str) -> bool:
    """Is the whole block one link?"""
    return _LINKED.match(raw) is not None


_TITLE = re.compile(r"<title(?:\s" + _ATTRS + r")?>(.*?)(?:</title\s*>|\Z)", re.S | re.I)


def title_of(page: str) -> str:
    """The first title, decoded; empty if there is none."""
    found = _TITLE.search(page)
    return _html.unescape(found[1]) if found else ""


_NOSCRIPT = re.compile(r"<noscript\b" + _ATTRS + r">(.*?)(?:</noscript\s*>|\Z)", re.S | re.I)
_ANY_TAG = re.compile(r"<[a-zA-Z/!?]" + _ATTRS + r">")


def without_title(page: str) -> str:
    """The page without its titles."""
    return _TITLE.sub("", page)


def noscript_of(page: str) -> list[str]:
    """What the page shows where scripts do not run, without tags."""
    return [_ANY_TAG.sub(" ", x) for x in _NOSCRIPT.findall(page)]
