"""HTML to Markdown with content selectors, in one pass over a page's tags.

No document tree is built: the stack of open elements is enough for the
selectors (which look upwards only) and for the Markdown, so the depth of a
page does not matter. Counts, links and titles stay column expressions.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.plans.shipping import map_arrow

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSED_BY = {"p": frozenset("p div ul ol dl table pre h1 h2 h3 h4 h5 h6 section article header footer nav aside main blockquote hr".split()), "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"])}
DROPPED = frozenset(["script", "style", "noscript", "template", "head", "title"])
EMPHASIS = {"b": "**", "strong": "**", "i": "*", "em": "*"}
INLINE = frozenset("a b strong i em code img br span small sub sup u label abbr mark kbd time".split())
HEADING_LEVEL = {f"h{n}": n for n in range(1, 7)}

_ATTRS = r"""[^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+"""
_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b" + _ATTRS + r">.*?(?:</\1\s*>|\Z)|<[!?][^>]*>", re.S | re.I)
_TAG = re.compile(r"<(/?[a-zA-Z][^\s/>]*)(" + _ATTRS + r")>")
_CUT = re.compile(r"<[/a-zA-Z!][^<>]*\Z")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_BLANKS = re.compile(r"\s+")
_LANGUAGE = re.compile(r"\blang(?:uage)?-([\w+#-]+)")


def attributes(text: str) -> dict[str, str]:
    """Attributes of a start tag; the first of equal names counts."""
    out: dict[str, str] = {}
    for name, double, single, bare in _ATTR.findall(text):
        out.setdefault(name.lower(), _html.unescape(double or single or bare))
    return out


Element = tuple[str, dict[str, str]]
_STEP = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[#.][\w-]+|\[[^\]]+\])*)")
_MARK = re.compile(r"([#.])([\w-]+)|\[([\w-]+)(?:\s*([~^$*|]?=)\s*[\"']?([^\"'\]]*)[\"']?)?\]")
_PIECES = re.compile(r"((?:\[[^\]]*\]|[^\s>\[])+)|(>)")


def selector(text: str) -> Callable[[list[Element]], bool]:
    """Test of the last of a stack of open elements, for a selector of tag names, ids, classes, attributes, descendants, children (``>``) and commas."""
    alternatives = []
    for one in re.split(r",(?![^\[]*\])", text):
        steps: list[tuple[bool, str, list]] = []
        child = False
        for part, arrow in _PIECES.findall(one):
            if arrow:
                child = True
                continue
            found = _STEP.fullmatch(part)
            if not found or (child and not steps):
                raise ValueError(f"selector not understood: {text}")
            steps.append((child, (found[1] or "*").lower(), _MARK.findall(found[2])))
            child = False
        if child:
            raise ValueError(f"selector not understood: {text}")
        if steps:
            alternatives.append(steps)

    def fits(element: Element, tag: str, marks: list) -> bool:
        if tag not in ("*", element[0]):
            return False
        own = element[1]
        for kind, name, attr, op, value in marks:
            if kind == "#":
                ok = own.get("id") == name
            elif kind == ".":
                ok = name in own.get("class", "").split()
            else:
                has = own.get(attr.lower())
                ok = has is not None and (not op or {"=": has == value, "~=": value in has.split(), "^=": has.startswith(value), "$=": has.endswith(value), "*=": value in has, "|=": has == value or has.startswith(value + "-")}[op])
            if not ok:
                return False
        return True

    def reaches(stack: list[Element], top: int, steps: list, last: int) -> bool:
        """Does the element at ``top`` fit step ``last`` and some elements above it the steps before?"""
        child, tag, marks = steps[last]
        if not fits(stack[top], tag, marks):
            return False
        if last == 0:
            return True
        if child:
            return top > 0 and reaches(stack, top - 1, steps, last - 1)
        return any(reaches(stack, k, steps, last - 1) for k in range(top - 1, -1, -1))

    def test(stack: list[Element]) -> bool:
        return any(reaches(stack, len(stack) - 1, steps, len(steps) - 1) for steps in alternatives)

    test.tags = frozenset(steps[-1][1] for steps in alternatives)
    test.reads_attributes = any(marks for steps in alternatives for _, _, marks in steps)
    return test


class _Writer:
    """Markdown as it grows: ``line`` is the text of the block at hand, ``boxes`` the quotes and list items around it."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.line: list[str] = []
        self.marks: list[tuple[str, int, str]] = []
        self.heading = 0
        self.boxes: list[list] = []
        self.lists: list[list] = []
        self.loose = False

    def emit(self, lines: list[str]) -> None:
        """Writes one block with the prefixes of its boxes; a blank line before it, unless it begins an item of a list that goes on."""
        first, rest, quote = "", "", ""
        begins = False
        for box in self.boxes:
            if box[0] == ">":
                quote = rest + ">" if box[1] else quote
                first, rest = first + "> ", rest + "> "
                box[1] = True
            elif box[1]:
                first, rest = first + " " * len(box[0]), rest + " " * len(box[0])
            else:
                first, rest = first + box[0], rest + " " * len(box[0])
                box[1] = begins = True
        if self.out and (not begins or self.loose):
            self.out.append(quote)
        self.loose = False
        self.out.append((first + lines[0]) if lines[0] else first.rstrip())
        self.out += [(rest + x).rstrip() if not x.endswith("  ") else rest + x for x in lines[1:]]

    def close_marks(self, down_to: int) -> list[tuple[str, int, str]]:
        open_ = self.marks[down_to:]
        for tag, start, target in reversed(open_):
            inner = "".join(self.line[start:])
            core = inner.strip()
            if tag == "a":
                new = f"[{core}]({target})" if core else ""
            elif tag == "code":
                new = f"`{core}`" if core else ""
            else:
                new = inner.replace(core, EMPHASIS[tag] + core + EMPHASIS[tag], 1) if core else inner
            self.line[start:] = [new]
        del self.marks[down_to:]
        return open_

    def flush(self) -> None:
        if self.line:
            open_ = self.close_marks(0)
            text = "".join(self.line).strip()
            self.line.clear()
            if text:
                if self.heading:
                    self.emit(["#" * self.heading + " " + _BLANKS.sub(" ", text)])
                else:
                    self.emit(text.split("\n"))
            self.marks = [(tag, 0, target) for tag, _, target in open_]
        self.heading = 0


def to_markdown(page: str, keep: list[Callable] | None = None, remove: list[Callable] | None = None) -> str:
    """CommonMark of headings, paragraphs, lists, code, quotes, tables, links, images and emphasis.

    With ``keep`` only of the outermost elements that one of its tests accepts; without those of ``remove``.
    """
    parts = _TAG.split(_RAW.sub("", page))
    if "<" in parts[-1]:
        parts[-1] = _CUT.sub("", parts[-1])
    w = _Writer()
    stack: list[Element] = []
    open_tags: dict[str, int] = {}
    tests = bool(keep or remove)
    named = frozenset().union(DROPPED, *(t.tags for t in (*(keep or ()), *(remove or ()))))
    reads_all = any(t.reads_attributes for t in (*(keep or ()), *(remove or ())))
    #: Depth of the element in which all is dropped, kept or verbatim; 0 for none.
    skipped, kept, pre = 0, 0, 0
    code: list[str] = []
    language = ""
    rows: list[list[str]] | None = None
    table_depth = 0
    cell = False

    def end_cell() -> None:
        nonlocal cell
        if cell:
            w.close_marks(0)
            rows[-1].append(_BLANKS.sub(" ", "".join(w.line)).strip().replace("|", "\\|"))
            w.line.clear()
            cell = False

    def end_table() -> None:
        nonlocal rows
        end_cell()
        found = [r for r in rows if r]
        rows = None
        if found:
            width = max(map(len, found))
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in found]
            w.emit([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])

    def leave(tag: str) -> None:
        nonlocal skipped, kept, pre, language, table_depth
        depth = len(stack) + 1
        if skipped:
            if depth <= skipped:
                skipped = 0
            return
        if pre:
            if depth <= pre:
                pre = 0
                w.emit(["```" + language, *"".join(code).strip("\n").split("\n"), "```"])
                code.clear()
            return
        if tag in EMPHASIS or tag in ("a", "code"):
            for k in range(len(w.marks) - 1, -1, -1):
                if w.marks[k][0] == tag:
                    inner = w.close_marks(k)
                    w.marks += [(t, len(w.line), target) for t, _, target in inner[1:]]
                    break
        elif rows is not None:
            if tag in ("td", "th", "tr"):
                end_cell()
            elif tag == "table" and depth <= table_depth:
                end_table()
        elif tag not in INLINE:
            w.flush()
            if tag == "li" and w.boxes and w.boxes[-1][0] != ">":
                w.boxes.pop()
            elif tag in ("ul", "ol") and w.lists:
                w.lists.pop()
            elif tag == "blockquote" and w.boxes and w.boxes[-1][0] == ">":
                w.boxes.pop()
        if kept and depth <= kept:
            w.flush()
            kept = 0

    def pop() -> None:
        tag = stack.pop()[0]
        open_tags[tag] -= 1
        leave(tag)

    def say(text: str) -> None:
        if not text or skipped or (keep and not kept):
            return
        if "&" in text:
            text = _html.unescape(text)
        if pre:
            code.append(text)
        elif rows is None or cell:
            w.line.append(_BLANKS.sub(" ", text))

    say(parts[0])
    for i in range(1, len(parts), 3):
        name, attrs, text = parts[i], parts[i + 1], parts[i + 2]
        tag = name.lower()
        if tag[0] == "/":
            tag = tag[1:]
            if open_tags.get(tag):
                at = len(stack) - 1
                while stack[at][0] != tag:
                    at -= 1
                if tag in INLINE and at >= max(skipped, kept, pre):
                    # Blocks that were opened inside stay open.
                    del stack[at]
                    open_tags[tag] -= 1
                    leave(tag)
                else:
                    while len(stack) > at:
                        pop()
            say(text)
            continue
        while stack and tag in CLOSED_BY.get(stack[-1][0], ()):
            pop()
        element = (tag, attributes(attrs) if attrs and (reads_all or tag in ("a", "img", "pre", "code")) else {})
        if tag not in VOID:
            stack.append(element)
            open_tags[tag] = open_tags.get(tag, 0) + 1
        depth = len(stack)
        if skipped:
            continue
        if tests and (tag in named or "*" in named):
            at = stack if tag not in VOID else [*stack, element]
            if keep and not kept and any(t(at) for t in keep):
                kept = depth if tag not in VOID else 0
            if tag in DROPPED or (remove and any(t(at) for t in remove)):
                if tag not in VOID:
                    skipped = depth
                else:
                    say(text)
                continue
        elif tag in DROPPED:
            skipped = depth
            continue
        if keep and not kept:
            continue
        if pre:
            if tag == "code" and not language:
                found = _LANGUAGE.search(element[1].get("class", ""))
                language = found[1] if found else ""
            say("\n" if tag == "br" else "")
        elif tag in EMPHASIS or tag == "code" or (tag == "a" and element[1].get("href")):
            w.marks.append((tag, len(w.line), element[1].get("href", "")))
        elif tag == "img":
            w.line.append(f"![{element[1].get('alt', '')}]({element[1].get('src', '')})")
        elif tag == "br":
            w.line.append("  \n" if rows is None else " ")
        elif tag in INLINE:
            pass
        elif rows is not None:
            if tag == "tr":
                end_cell()
                rows.append([])
            elif tag in ("td", "th"):
                end_cell()
                if not rows:
                    rows.append([])
                cell = True
            elif cell:
                w.line.append(" ")
        elif tag == "pre":
            w.flush()
            pre = depth
            found = _LANGUAGE.search(element[1].get("class", ""))
            language = found[1] if found else ""
        elif tag == "table":
            w.flush()
            rows, table_depth = [], depth
        elif tag == "hr":
            w.flush()
            w.emit(["---"])
        else:
            w.flush()
            if tag in HEADING_LEVEL:
                w.heading = HEADING_LEVEL[tag]
            elif tag in ("ul", "ol"):
                w.lists.append([tag, 0])
                w.loose = not any(box[0] != ">" for box in w.boxes)
            elif tag == "li":
                if not w.lists:
                    w.lists.append(["ul", 0])
                    w.loose = True
                w.lists[-1][1] += 1
                w.boxes.append([f"{w.lists[-1][1]}. " if w.lists[-1][0] == "ol" else "- ", False])
            elif tag == "blockquote":
                w.boxes.append([">", False])
        say(text)
    while stack:
        pop()
    w.flush()
    return "\n".join(w.out).strip() + "\n"


def convert(results: DataFrame, keep: tuple[str, ...] = (), remove: tuple[str, ...] = ()) -> DataFrame:
    """(result_id, markdown, error) of ``results(result_id, html)`` with html; of what cannot be converted the Markdown is NULL and the error says why."""
    kept, removed = [selector(s) for s in keep], [selector(s) for s in remove]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str | None] = []
            errors: list[str | None] = []
            for page in batch.column(1).to_pylist():
                try:
                    texts.append(to_markdown(page, kept, removed))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - one page must not end the run
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["result_id", "markdown", "error"])

    return map_arrow(results.where("html <> ''").select("result_id", "html"), make, "result_id long, markdown string, error string")


def link_targets(text: Column) -> Column:
    """Targets of the Markdown links that are no images."""
    return F.regexp_extract_all(text, F.lit(r"(?<!!)\[[^\]]+\]\(([^)]+)\)"), F.lit(1))


def image_targets(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1))


def code_languages(text: Column) -> Column:
    """Languages of the fenced code blocks, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?ms)^```(\w+)\n.*?^```"), F.lit(1))
