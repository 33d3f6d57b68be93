"""Text decoded with the wrong character encoding: detection and restoration.

A multinomial model over hashed byte bigrams (of the UTF-8 form, pairs with at
least one byte of a non-ASCII character) is trained for clean text and for
each encoding chain on synthetically garbled records: lines of a bounded
sample of documents (``SAMPLE_DOCUMENTS``), encoded as they were and decoded
wrongly. Every document is then scored whole, token by token: all tokens
that are strange in clean text, or that the classifier gives to some chain, are collected, every chain that explains any of
them better is inverted and verified by strict decoding, and of the chains that
pass the one with the most evidence is chosen. What is restored may be garbled
again, so the steps repeat (``ROUNDS``).

Code spans and blocks are quotations and are not looked at. U+FFFD outside
them means that characters were lost for good.

Results for special input: NULL and empty text is not garbled and stays as it
is; text of ASCII alone cannot be judged and counts as clean; equal documents
get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.sampling import smallest_hashes
from siltstone.plans.shipping import map_arrow

#: Documents for fitting: those with the smallest hash of their id. Sampled lines per document, and characters of a line; they bound the fitting only.
SAMPLE_DOCUMENTS = 2000
SAMPLE_LINES = 12
SAMPLE_CHARACTERS = 400
#: Clean lines that are garbled synthetically for each chain.
CHAIN_LINES = 3000
#: Weight of the lines in capitals in the model of clean text.
CAPITALS = 0.05
ROUNDS = 3
SPREAD = 0.02
#: Log-probability under which a pair is strange in clean text, and how strange a token must be to be looked at.
STRANGE = -9.5
TOKEN_EVIDENCE = 1.0
#: Nats by which some chain must explain a token better than clean text, if it is not strange by itself.
CHAIN_EVIDENCE = 7.0
#: Tokens whose first look is remembered.
KNOWN_TOKENS = 200_000
#: At most so much of a token may be lost for good.
LOST_SHARE = 0.34
#: What a token that does not decode strictly counts for, so that chains which decode all tokens come first; nats for each lost character.
LOST_WEIGHT = 0.25
LOST_COST = 2.0
#: Nats by which a restored token must be likelier, and the tokens together: if their characters stand elsewhere in
#: the text or are common in clean text, if several characters became one (hardly any clean text decodes like that), and in any case.
GAIN = 2.0
EVIDENCE = 10.0
PACKED_EVIDENCE = 5.0
SURE_EVIDENCE = 60.0
#: A character is common if it stands in one of so many clean lines.
COMMON_LINES = 1000
#: Pairs that are scored at once; it bounds memory, not what is looked at.
SCORED = 1 << 16

# Fixed values: (encoding of the text, encoding it was read in); a chain may hold several such steps, the first applied first.
_FROM = {
    "utf-8": ["cp1252", "latin-1", "cp1250", "cp1251", "koi8-r", "cp866", "cp437", "cp850", "mac-roman", "iso8859-2", "gb18030"],
    "cp1252": ["cp1250", "cp1251", "cp437", "cp850", "mac-roman", "koi8-r", "iso8859-2"],
    "mac-roman": ["cp1252", "latin-1"],
    "cp850": ["cp1252", "latin-1"],
    "cp437": ["cp1252"],
    "cp1250": ["cp1252", "latin-1", "cp1251"],
    "iso8859-2": ["cp1252", "latin-1", "cp1250"],
    "cp852": ["cp1252", "cp1250"],
    "cp1251": ["cp1252", "latin-1", "koi8-r", "cp866", "mac-roman"],
    "koi8-r": ["cp1252", "latin-1", "cp1251", "cp866"],
    "cp866": ["cp1252", "latin-1", "cp1251", "koi8-r"],
    "gb18030": ["cp1252", "latin-1", "cp1251"],
    "big5": ["cp1252", "latin-1"],
    "shift_jis": ["cp1252", "latin-1", "mac-roman"],
    "euc_jp": ["cp1252", "latin-1"],
}
Chain = tuple[tuple[str, str], ...]
CHAINS: list[Chain] = [((true, wrong),) for true, read in _FROM.items() for wrong in read]
CHAINS += [(("utf-8", "cp1252"), ("utf-8", "cp1252")), (("utf-8", "latin-1"), ("utf-8", "latin-1")), (("utf-8", "cp1251"), ("utf-8", "cp1251")), (("utf-8", "cp1252"),) * 3]
CHAINS += [((true, "cp1252"), ("utf-8", "cp1252")) for true in ("cp1251", "cp1250", "shift_jis", "gb18030")]

_FENCE = re.compile(r"^(```|~~~).*?(?:^\1|\Z)", re.S | re.M)
_CODE = re.compile(r"(`+)(?!`).*?(?<!`)\1(?!`)", re.S)
_UNSHOWN = re.compile("[\x00-\x1f\x7f-\x9f\ue000-\uf8ff]")
_CONTROL = re.compile("[\x80-\x9f]")
#: A token's part that was lost can be judged only if the token has so many pairs.
LOST_PAIRS = 8
# Punctuation that stands around words.
_EDGES = "\xa0“”„‟‘’‚‹›«»…—–·•¿¡" + "".join(map(chr, range(33, 48))) + ":;<=>?@[]^_`{|}~"
#: A Latin letter of ASCII beside a Greek, Cyrillic or Armenian one, or one East Asian sign between two: no word, whatever the chain.
_MIXED = re.compile("[A-Za-z][\u0370-\u058f]|[\u0370-\u058f][A-Za-z]|[A-Za-z][\u2e80-\u9fff\uac00-\ud7af][A-Za-z]")
# A no-break space ends a token, unless it follows what may be the first byte of a wrongly read pair.
_TOKEN = re.compile("(?:[^ \\t\\r\\n\xa0]|(?<=[^\x00-\x7f])\xa0)+")

_WIDE = frozenset(["utf-8", "gb18030", "shift_jis", "euc_jp", "big5"])
_TABLES: dict[str, tuple[str, object]] = {}


def _tables(encoding: str) -> tuple[str, object]:
    """Decoding and encoding table of a one-byte encoding; bytes without a character stand for the control of that number."""
    if encoding not in _TABLES:
        read = ""
        for b in range(256):
            try:
                read += bytes([b]).decode(encoding)
            except UnicodeDecodeError:
                read += chr(b)
        _TABLES[encoding] = (read, codecs.charmap_build(read))
    return _TABLES[encoding]


def _decode(data: bytes, encoding: str, errors: str = "strict") -> str:
    return data.decode(encoding, errors) if encoding in _WIDE else codecs.charmap_decode(data, errors, _tables(encoding)[0])[0]


def _encode(text: str, encoding: str, errors: str = "strict") -> bytes:
    return text.encode(encoding, errors) if encoding in _WIDE else codecs.charmap_encode(text, errors, _tables(encoding)[1])[0]


def garble(text: str, chain: Chain) -> str | None:
    """The text as it looks after the chain; None if it cannot come to be."""
    try:
        for true, wrong in chain:
            text = _decode(_encode(text, true), wrong)
    except UnicodeError:
        return None
    return text


def invert(text: str, chain: Chain, errors: str = "strict") -> str | None:
    """The text before the chain; None if it does not decode strictly. With errors="replace", what does not decode becomes U+FFFD."""
    try:
        for true, wrong in reversed(chain):
            text = _decode(_encode(text, wrong, errors), true, errors)
    except UnicodeError:
        return None
    return text


def without_code(text: str) -> str:
    """Code blocks and spans become blanks of the same length."""
    if "```" in text or "~~~" in text:
        text = _FENCE.sub(lambda m: " " * len(m[0]), text)
    if "`" in text:
        text = _CODE.sub(lambda m: " " * len(m[0]), text)
    return text


def bigrams(text: str) -> np.ndarray:
    data = np.frombuffer((" " + text + " ").encode("utf-8", "replace"), np.uint8)
    pair = data[:-1].astype(np.uint16) << 8 | data[1:]
    return pair[(data[:-1] | data[1:]) >= 128]


class Models(NamedTuple):
    """``clean`` log-probabilities, ``ratios`` of each chain against them, ``first`` how strange a pair is in clean text, ``common`` characters of clean text."""

    clean: np.ndarray
    ratios: np.ndarray
    first: np.ndarray
    chains: list[Chain]
    common: frozenset[str] = frozenset()


def _model(counts: np.ndarray) -> np.ndarray:
    return np.log((1 - SPREAD) * counts / max(1.0, counts.sum()) + SPREAD / len(counts)).astype(np.float32)


def _count(texts: Iterable[str]) -> np.ndarray:
    return np.bincount(bigrams("\n".join(texts)), minlength=65536).astype(float)


def _count_tokens(own: list[str], times: list[int]) -> np.ndarray:
    if not own:
        return np.zeros(65536)
    pairs_of = [bigrams(t) for t in own]
    return np.bincount(np.concatenate(pairs_of), np.repeat(np.array(times, float), list(map(len, pairs_of))), minlength=65536)


def _clean_model(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    clean = _model(_count(lines) + CAPITALS * _count(line.upper() for line in lines))
    first = (STRANGE - clean).astype(np.float32)
    first.reshape(256, 256)[:128, :128] = 0
    return clean, first


def _common(lines: list[str]) -> frozenset[str]:
    """Characters outside ASCII that stand in many of the lines."""
    on: Counter = Counter()
    for line in lines:
        on.update({c for c in line if c > "\x7f"})
    return frozenset(c for c, n in on.items() if n * COMMON_LINES >= len(lines))


def tokens(line: str) -> list[str]:
    """Tokens with characters outside ASCII."""
    return [m[0] for m in _TOKEN.finditer(line) if not m[0].isascii() and m[0].strip("\xa0")]


def _signs() -> re.Pattern:
    """Signs of wrong decoding: controls, runs of Latin-1 letters and signs, and UTF-8's byte pairs as cp1252 and Latin-1 show them."""
    follow = "".join(sorted(set(_tables("cp1252")[0][0x80:0xC0] + _tables("latin-1")[0][0x80:0xC0])))
    return re.compile(f"[\x80-\x9f]|[\xa1-\xff]{{3}}|[\xc2-\xf4][{re.escape(follow)}]")


_SIGNS = _signs()


def _is_doubly_encoded(token: str) -> bool:
    """Is the token UTF-8 that was read in another encoding? Its bytes then decode strictly, which hardly any clean token's do."""
    if _CONTROL.search(token) or re.search("[\xa1-\xff]{3}", token):
        return True
    for wrong in _FROM["utf-8"]:
        before = invert(token, (("utf-8", wrong),))
        if before is not None and before != token and not before.isascii() and not _CONTROL.search(before):
            return True
    return False


def fit_models(texts: Iterable[str | None]) -> Models:
    """Trains on lines of the texts; lines that a first model of clean text finds strange are left out of the second."""
    lines = []
    for text in texts:
        if not text or text.isascii() or "�" in text:
            continue
        own = [x for x in without_code(text).splitlines() if not x.isascii()]
        lines += [x[:SAMPLE_CHARACTERS] for x in own[:: max(1, len(own) // SAMPLE_LINES)][:SAMPLE_LINES]]
    kept = [line for line in lines if not any(_is_doubly_encoded(t) or is_oddly_cased(t) for t in tokens(line))]
    clean, first = _clean_model(kept)
    for _ in range(2):
        kept = [line for line in kept if all(first[bigrams(t)].sum() < TOKEN_EVIDENCE and not _CONTROL.search(t) for t in tokens(line))]
        clean, first = _clean_model(kept)
    # Chains are learnt from an even choice of the clean lines, whose pairs are few and frequent, and of those from the tokens that they change.
    ratios, chains = [], []
    times = Counter(t for line in kept[:: max(1, len(kept) // CHAIN_LINES)] for t in tokens(line))
    for chain in CHAINS:
        changed = [(g, n) for g, t, n in ((garble(t, chain), t, n) for t, n in times.items()) if g is not None and g != t and "�" not in g]
        counts = _count_tokens([g for g, _ in changed], [n for _, n in changed])
        if counts.sum() >= 200:
            ratios.append(_model(counts) - clean)
            chains.append(chain)
    return Models(clean, np.stack(ratios) if ratios else np.zeros((0, 65536), np.float32), first, chains, _common(kept))


class Verdict(NamedTuple):
    garbled: bool
    chain: Chain | None
    evidence: float
    restored: str
    complete: bool


def judge(text: str, models: Models, rounds: int = ROUNDS, looker: Looker | None = None) -> Verdict:
    """Is the text garbled outside code? Restores what decodes strictly and becomes likelier, in up to ``rounds`` rounds."""
    lost = False
    chains_seen: Chain | None = None
    total = 0.0
    current = text
    loose = False
    for _ in range(rounds):
        shown = without_code(current)
        lost = lost or "�" in shown
        found = _one_round(current, shown, models, looker)
        if found is None:
            break
        chain, evidence, replaced, failed = found
        chains_seen = chains_seen or chain
        total += evidence
        loose = loose or failed
        if replaced == current:
            break
        current = replaced
    return Verdict(lost or chains_seen is not None, chains_seen, total, current, not lost and not loose and current != text)


def _gain(token: str, pairs: np.ndarray, chain: Chain, models: Models, lenient: bool) -> tuple[float, str | None, bool]:
    """(nats by which the token before the chain is likelier as clean text, that token, whether it decodes strictly)."""
    fixed = invert(token, chain)
    whole = fixed is not None
    if not whole:
        if not lenient or len(pairs) < LOST_PAIRS:
            return 0.0, None, False
        fixed = invert(token, chain, "replace") or ""
        lost = fixed.count("\ufffd") + max(0, fixed.count("?") - token.count("?"))
        if lost > LOST_SHARE * len(fixed):
            return 0.0, None, False
    if not fixed or _UNSHOWN.search(fixed) or (_MIXED.search(fixed) and not _MIXED.search(token)):
        return 0.0, None, False
    if is_oddly_cased(fixed) and not is_oddly_cased(token):
        return 0.0, None, False
    if len(fixed) == len(token) and is_quoted_ascii(token):
        return 0.0, None, False  # quotation marks around a word are no letters of it
    after = bigrams(fixed)
    gain = float(models.clean[after].sum() - models.clean[pairs].sum())
    return gain if whole else LOST_WEIGHT * gain - LOST_COST * lost, fixed, whole


def _evidence(pairs_of: list[np.ndarray], times: np.ndarray, models: Models) -> np.ndarray:
    """For each chain, the nats by which it explains tokens better than clean text, over all tokens that it explains better."""
    out = np.zeros(len(models.chains))
    sizes = np.array([len(pairs) for pairs in pairs_of])
    start = 0
    while start < len(sizes):
        end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), SCORED, side="right")))
        flat = np.concatenate(pairs_of[start:end])
        starts = np.concatenate(([0], np.cumsum(sizes[start : end - 1])))
        scores = np.add.reduceat(models.ratios[:, flat], starts, axis=1)
        out += np.maximum(scores, 0) @ times[start:end]
        start = end
    return out


class Gains(NamedTuple):
    """Nats that tokens gain by a chain: words of two letters or more (a lone sign fits some letter of many chains), and tokens that got shorter."""

    words: float
    packed: float


def _is_sure(gains: Gains, signs: set[str], known: set[str]) -> bool:
    """Is a chain accepted? ``signs`` are the characters that it restores, ``known`` those of the text's other tokens and of clean text."""
    return gains.words >= SURE_EVIDENCE or gains.packed >= PACKED_EVIDENCE or (gains.words >= EVIDENCE and signs <= known)


def _one_round(text: str, shown: str, models: Models, looker: Looker | None = None) -> tuple[Chain, float, str, bool] | None:
    spans = [m.span() for m in _TOKEN.finditer(shown) if not m[0].isascii() and "\ufffd" not in m[0]]
    verdicts = (looker or Looker(models)).look(shown[a:b] for a, b in spans)
    strange = [verdicts[shown[a:b]] or _SIGNS.search(shown[a:b]) is not None for a, b in spans]
    # Equal tokens are judged once and count as often as they stand there.
    times: Counter = Counter(shown[a:b] for (a, b), x in zip(spans, strange, strict=True) if x)
    if not times or not len(models.chains):
        return None
    looked = list(times)
    pairs_of = [bigrams(token) for token in looked]
    evidence = _evidence(pairs_of, np.array(list(times.values())), models)
    # No chain gives a token more than it costs as clean text, so a chain that cannot exceed the best one is left early.
    limits = [-float(models.clean[pairs].sum()) * times[token] for token, pairs in zip(looked, pairs_of, strict=True)]
    order = sorted(range(len(looked)), key=lambda i: -limits[i])
    rest = {c for (a, b), x in zip(spans, strange, strict=True) if not x for c in shown[a:b]}
    known = rest | models.common
    best, top = None, None
    for k in np.argsort(-evidence, kind="stable"):
        if evidence[k] <= 0:
            break
        chain = models.chains[k]
        total, all_gains, gains, signs = 0.0, Gains(0.0, 0.0), Gains(0.0, 0.0), set()
        left = sum(limits)
        for i in order:
            if best is not None and total + left <= best[1]:
                break
            left -= limits[i]
            token = looked[i]
            gain, fixed, _ = _gain(token, pairs_of[i], chain, models, True)
            if fixed is not None and gain >= GAIN:
                word = gain if sum(map(str.isalpha, fixed)) > 1 else 0.0
                packed = gain if len(fixed) < len(token) else 0.0
                total += gain * times[token]
                gains = Gains(gains.words + word, gains.packed + packed)
                all_gains = Gains(all_gains.words + word * times[token], all_gains.packed + packed * times[token])
                signs.update(c for c in fixed if c > "\x7f")
        if top is None or total > top[1]:
            top = (chain, total, all_gains, signs)
        if (best is None or total > best[1]) and _is_sure(gains, signs, known):
            best = (chain, total)
    # Repeats of one token, and lone signs that stand elsewhere, speak for the likeliest chain only: one odd sign fits many chains.
    if top is not None and (best is None or top[1] > best[1]) and (_is_sure(top[2], top[3], rest) or (top[1] >= EVIDENCE and top[3] <= rest)):
        best = top[:2]
    if best is None:
        return None
    chain, total = best
    pieces, last, failed = [], 0, False
    gain_of: dict[str, tuple[float, str | None, bool]] = {}
    for a, b in spans:
        token = shown[a:b]
        if token not in gain_of:
            gain_of[token] = _gain(token, bigrams(token), chain, models, True)
        gain, fixed, whole = gain_of[token]
        if fixed is None or gain < GAIN:
            continue
        if not whole:
            failed = True
            continue
        pieces += [text[last:a], fixed]
        last = b
    return chain, total, "".join([*pieces, text[last:]]), failed


def is_oddly_cased(token: str) -> bool:
    """Does a capital stand behind a small letter, at least one of them outside ASCII?"""
    return any(b.isupper() and a.islower() and not (a.isascii() and b.isascii()) for a, b in zip(token, token[1:], strict=False))


def is_quoted_ascii(token: str) -> bool:
    """Is all that is not ASCII in the token punctuation around it?"""
    return token.strip(_EDGES).isascii()


class Looker:
    """First look at tokens: is one strange in clean text, or does the classifier find it likelier under some chain? Verdicts of short tokens are remembered."""

    def __init__(self, models: Models):
        self.models = models
        self.by_pair = np.ascontiguousarray(models.ratios.T)  # one row of all chains for each pair is read faster
        self.known: dict[str, bool] = {}

    def look(self, wanted: Iterable[str]) -> dict[str, bool]:
        """Verdict of each token with characters outside ASCII."""
        known = self.known
        if len(known) > KNOWN_TOKENS:
            known.clear()
        wanted = set(wanted)
        new = [t for t in wanted if t not in known]
        fresh: dict[str, bool] = {}
        start = 0
        while start < len(new):
            pairs_of, size = [], 0
            while start + len(pairs_of) < len(new) and (not pairs_of or size < SCORED):
                pairs_of.append(bigrams(new[start + len(pairs_of)]))
                size += len(pairs_of[-1])
            flat = np.concatenate(pairs_of)
            edges = np.concatenate(([0], np.cumsum([len(x) for x in pairs_of[:-1]]))).astype(np.int64)
            strange = np.add.reduceat(self.models.first[flat], edges) >= TOKEN_EVIDENCE
            if len(self.models.chains):
                likelier = np.add.reduceat(self.by_pair[flat], edges, axis=0).max(axis=1) >= CHAIN_EVIDENCE
                strange |= likelier & [not is_quoted_ascii(t) for t in new[start : start + len(pairs_of)]]
            fresh.update(zip(new[start : start + len(pairs_of)], strange.tolist(), strict=True))
            start += len(pairs_of)
        known.update((t, x) for t, x in fresh.items() if len(t) <= 64)
        return {t: fresh[t] if t in fresh else known[t] for t in wanted}


def looks_garbled(texts: list[str], looker: Looker) -> list[bool]:
    """First look at many texts at once: whether any token could be garbled. It only spares :func:`judge` clean texts."""
    parts = [{t for t in text.split() if not t.isascii()} for text in texts]
    verdicts = looker.look(set().union(*parts))
    return [any(map(verdicts.__getitem__, own)) or _SIGNS.search(text) is not None for text, own in zip(texts, parts, strict=True)]


def fit_models_on(documents: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> Models:
    """Fits on at most ``sample`` documents of ``documents(doc_id, text)``."""
    rows = smallest_hashes(documents, "text <> ''", "doc_id", sample, "text").toArrow()
    return fit_models(rows.column("text").to_pylist())


def garbled(documents: DataFrame, models: Models) -> DataFrame:
    """One row (doc_id) for each garbled document of ``documents(doc_id, text)``."""
    return restore(documents, models, rounds=1).select("doc_id")


_SCHEMA = "doc_id long, chain string, evidence double, restored string, complete boolean"


def restore(documents: DataFrame, models: Models, rounds: int = ROUNDS) -> DataFrame:
    """One row for each garbled document of ``documents(doc_id, text)``: chain, evidence, restored text, and whether nothing is left garbled or lost."""
    shared = documents.sparkSession.sparkContext.broadcast(models)  # 65,536 numbers for each chain

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        looker = Looker(models)
        for batch in batches:
            pairs = [(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t and not t.isascii()]
            likely = looks_garbled([without_code(t) for _, t in pairs], looker) if pairs else []
            rows = []
            for (i, t), look in zip(pairs, likely, strict=True):
                if look or "�" in t:
                    v = judge(t, models, rounds, looker)
                    if v.garbled:
                        rows.append((i, "; ".join(f"{a} read as {b}" for a, b in v.chain) if v.chain else "lost characters", v.evidence, v.restored, v.complete))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "chain", "evidence", "restored", "complete"])

    return map_arrow(documents.where("text <> ''").select("doc_id", "text"), find, _SCHEMA)
