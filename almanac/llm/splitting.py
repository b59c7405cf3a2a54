"""Splitting oversized texts at natural boundaries by agglomerative merging, with exact token overlaps."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.tokens import ByteTokenizer
from almanac.session import ship

TOKEN, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)
KINDS = ("token", "word", "clause", "sentence", "line", "paragraph")
_BITS = 32  # for a boundary's number, and as many for a size: texts have fewer bytes than 2^31
_BLANK, _STOP, _COMMA, _CLOSE = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _BLANK
_CLASS[[ord(c) for c in ".!?"]] = _STOP
_CLASS[[ord(c) for c in ",;:"]] = _COMMA
_CLASS[[ord(c) for c in "\"')]"]] = _CLOSE
#: Stops, closing marks and commas of scripts that put no blank after them.
_STANDING = ("。．！？｡।॥።؟۔։", "」』）】〉》”’", "、，；：､،؛")
_RUN = re.compile(b"(?:%b)+(?:%b)*|((?:%b)+)" % tuple(b"|".join(c.encode() for c in marks) for marks in _STANDING))
_FIRST = np.zeros(256, bool)
_FIRST[[c.encode()[0] for c in _STANDING[0] + _STANDING[2]]] = True
_MARKS = [np.array(sorted(int.from_bytes(x) for c in _STANDING[0] + _STANDING[2] if len(x := c.encode()) == n)) for n in (2, 3)]
#: Words whose stop ends no sentence, besides single capitals; a parameter of ``Splitter``.
ABBREVIATIONS = frozenset(b"st sts fr frs co rev revd msgr mr mrs ms dr sr br jr prof hon capt vs cf tel ext approx dept ave rd esp incl jan feb mar apr aug sept oct nov dec".split())


def merge(sizes: list[int], strengths: list[int], limit: int, first: int | None = None) -> list[int]:
    """Indices of the boundaries that stay. Boundary i lies between segments i and i+1.

    Adjacent pairs are held in a heap; the weakest boundary goes first, among equals that with the least
    combined size, then the first; a boundary goes if the combined size is within ``limit``, or within ``first`` (at least ``limit``) for the
    segment at the beginning. Sizes only grow, so a boundary that can't go once stays, unless the segment before it becomes part of the
    first: then it is tried again.
    """
    first = limit if first is None else first
    n = len(sizes)
    size = sizes[:]
    left, end = list(range(-1, n - 1)), list(range(n))
    gone, waits = bytearray(n), bytearray(n)
    heap = []
    for i in range(n - 1):
        s = size[i] + size[i + 1]
        if s <= (limit if i else first):
            heap.append((((strengths[i] << _BITS) | s) << _BITS) | i)
        else:
            waits[i] = 1
    heapify(heap)
    stay = bytearray(b"\1") * (n - 1)
    mask = (1 << _BITS) - 1
    while heap:
        e = heappop(heap)
        i = e & mask  # boundary i belongs to the segment that ends at it
        owner = i
        while gone[owner]:
            owner = left[owner]
        if owner != i:
            left[i] = owner
        nxt = i + 1
        s = size[owner] + size[nxt]
        if s != (e >> _BITS) & mask:
            if s <= (limit if owner else first):
                heappush(heap, (((strengths[i] << _BITS) | s) << _BITS) | i)
            else:
                waits[i] = 1
            continue
        stay[i] = 0
        gone[nxt] = 1
        left[nxt] = owner
        size[owner] = s
        last = end[owner] = end[nxt]
        if not owner and waits[last] and s + size[last + 1] <= first:
            waits[last] = 0
            heappush(heap, (((strengths[last] << _BITS) | (s + size[last + 1])) << _BITS) | last)
    return [i for i in range(n - 1) if stay[i]]


def _line_ends(raw: np.ndarray) -> np.ndarray:
    """Line feeds, form feeds, and carriage returns that no line feed follows."""
    cr = np.flatnonzero(raw == 13)
    if len(cr):
        cr = cr[raw[np.minimum(cr + 1, len(raw) - 1)] != 10]
    lf = np.flatnonzero((raw == 10) | (raw == 12))
    return np.sort(np.concatenate([lf, cr])) if len(cr) else lf


def _abbreviated(raw: np.ndarray, buffer: bytes, at: np.ndarray, words: frozenset[bytes]) -> np.ndarray:
    """Of the places of full stops, those after an abbreviation or a single capital."""
    back = raw[np.maximum(at[:, None] - np.arange(1, 8), 0)]
    other = ~((back >= 0x80) | ((back | 32) - 97 < 26)) | (at[:, None] <= np.arange(7))
    size = np.where(other.any(1), other.argmax(1), 7)
    out = np.zeros(len(at), bool)
    short = np.flatnonzero((size > 0) & (size <= 6))
    for k, e, n in zip(short.tolist(), at[short].tolist(), size[short].tolist(), strict=True):
        w = buffer[e - n : e]
        out[k] = w.lower() in words or (n == 1 and w.isupper())
    return out


def _standing(raw: np.ndarray, buffer: bytes) -> np.ndarray:
    """Places after runs of stops or commas that need no blank, with their strengths."""
    lead = np.flatnonzero(_FIRST[raw[:-1]])
    if not len(lead):
        return np.empty((0, 2), np.int64)
    two = raw[lead].astype(np.int64) << 8 | raw[lead + 1]
    three = two << 8 | raw[np.minimum(lead + 2, len(raw) - 1)]
    out, done = [], 0
    for e in lead[np.isin(two, _MARKS[0]) | np.isin(three, _MARKS[1])].tolist():
        if e >= done:
            m = _RUN.match(buffer, e)
            done = m.end()
            out.append((done, CLAUSE if m[1] else SENTENCE))
    return np.array(out, np.int64).reshape(-1, 2)


def boundaries(raw: np.ndarray, starts: np.ndarray, abbreviations: frozenset[bytes] = ABBREVIATIONS) -> tuple[list[int], list[int]]:
    """Natural boundaries as token indices (ascending, inside the text) with their strengths.

    In the text's UTF-8: after the last of several line ends with only blanks between them (paragraph), after a
    line's end, after a stop and closing marks before a blank (sentence), after a comma, colon or semicolon
    before a blank (clause); after the stops and commas of scripts without blanks wherever they stand. The stop of an abbreviation is none.
    Where a boundary isn't a token's beginning, or the token begins inside a character, the next one counts.
    """
    buffer = raw.tobytes()
    kind = _CLASS[raw]
    blank = kind == _BLANK
    blanks = np.flatnonzero(blank)

    def solid(at: np.ndarray) -> np.ndarray:
        """Bytes up to a place that are no blanks."""
        return at + 1 - np.searchsorted(blanks, at, "right")

    lines = _line_ends(raw)
    level = np.full(len(lines), LINE)
    if len(lines) > 1:
        n = solid(lines)
        same = n[1:] == n[:-1]
        last = np.append(~same, True)
        level[1:][same] = PARAGRAPH
        lines_end, level = lines[last], level[last]
    else:
        lines_end = lines
    before = np.flatnonzero(blank[1:] & ~blank[:-1])
    end = before.copy()
    for _ in range(2):  # closing marks after a stop: of one byte, or a quotation mark of three
        one = (kind[end] == _CLOSE) & (end > 0)
        three = ((raw[end] == 0x99) | (raw[end] == 0x9D)) & (end > 2)
        three[three] = (raw[end[three] - 1] == 0x80) & (raw[end[three] - 2] == 0xE2)
        end = end - one - 3 * three
    dots = (raw[end] == 0xA6) & (end > 1)
    dots[dots] = (raw[end[dots] - 1] == 0x80) & (raw[end[dots] - 2] == 0xE2)
    stop = kind[end] == _STOP
    full = np.flatnonzero(stop & (raw[end] == 46))
    if len(full):
        stop[full[_abbreviated(raw, buffer, end[full], abbreviations)]] = False
    stop |= dots
    comma = kind[before] == _COMMA
    some = stop | comma
    at, strength = before[some] + 1, np.where(stop[some], SENTENCE, CLAUSE)
    if len(lines) and len(at):  # not where only blanks come before the line's end
        k = np.searchsorted(lines, at)
        own = (k == len(lines)) | (solid(lines[np.minimum(k, len(lines) - 1)]) > solid(at))
        at, strength = at[own], strength[own]
    at, strength = np.concatenate([at, lines_end + 1]), np.concatenate([strength, level])
    standing = _standing(raw, buffer)
    if len(standing):
        at, strength = np.concatenate([at, standing[:, 0]]), np.concatenate([strength, standing[:, 1]])
    order = np.argsort(at, kind="stable")
    pos, strength = np.searchsorted(starts, at[order]), strength[order]
    while len(pos) and (inner := (raw[starts[np.minimum(pos, len(starts) - 1)]] & 0xC0 == 0x80) & (pos < len(starts))).any():
        pos = pos + inner
    inside = (pos < len(starts)) & (pos > 0)
    pos, strength = pos[inside], strength[inside]
    if len(pos) > 1 and (pos[1:] == pos[:-1]).any():
        pos, first = np.unique(pos, return_index=True)
        strength = np.maximum.reduceat(strength, first)
    return pos.tolist(), strength.tolist()


class _Cutter:
    """Cut positions from which merging starts.

    A run between stronger boundaries that fits as a whole would be merged whole whatever the order, so
    its weaker boundaries are left out at once. A clause above the limit is cut at words; a word above it between
    tokens that begin a character, in atoms of an eighth of the limit.
    """

    def __init__(self, raw: np.ndarray, starts: np.ndarray, pos: list[int], strength: list[int]):
        self.raw, self.starts, self.pos, self.strength = raw, starts, pos, strength
        self._words: list[int] | None = None
        self._chars: list[int] | None = None

    def atoms(self, a: int, b: int, limit: int) -> tuple[list[int], list[int]]:
        """Edges, the tokens ``a`` and ``b`` included, and the strengths of those between."""
        self.limit, self.edges, self.kinds = limit, [a], []
        if b - a > limit:
            self._cut(a, b, bisect_right(self.pos, a), bisect_left(self.pos, b))
        return [*self.edges, b], self.kinds

    def _cut(self, a: int, b: int, lo: int, hi: int) -> None:
        """The run from ``a`` to ``b``, above the limit: at its strongest boundaries, its pieces above the limit at theirs."""
        pos, strength, limit, edges, kinds = self.pos, self.strength, self.limit, self.edges, self.kinds
        if lo < hi:
            level = max(strength[lo:hi])
            for j in range(lo, hi):
                if strength[j] == level:
                    at = pos[j]
                    if at - a > limit:
                        self._cut(a, at, lo, j)
                    edges.append(at)
                    kinds.append(level)
                    a, lo = at, j + 1
            if b - a > limit:
                self._cut(a, b, lo, hi)
            return
        if self._words is None:
            first = _CLASS[self.raw[self.starts]]
            self._words = np.flatnonzero(first == _BLANK).tolist()
        for w in self._words[bisect_right(self._words, a) : bisect_left(self._words, b)]:
            if w - a > limit:
                self._tokens(a, w)
            edges.append(w)
            kinds.append(WORD)
            a = w
        if b - a > limit:
            self._tokens(a, b)

    def _tokens(self, a: int, b: int) -> None:
        if self._chars is None:
            self._chars = np.flatnonzero((self.raw[self.starts] & 0xC0) != 0x80).tolist()
        step, last = max(1, self.limit // 8), a
        for c in self._chars[bisect_right(self._chars, a) : bisect_left(self._chars, b)]:
            if c - last >= step:
                self.edges.append(c)
                self.kinds.append(TOKEN)
                last = c


COLUMNS = ("profile", "piece", "first_token", "end_token", "tokens", "overlap", "first_char", "overlap_chars", "cut", "text")


class Splitter:
    """Splits many texts at a time: what can be found for all their bytes or tokens at once is."""

    def __init__(self, tokenizer: ByteTokenizer, abbreviations: frozenset[bytes] = ABBREVIATIONS):
        self.tokenizer, self.abbreviations = tokenizer, abbreviations

    def split(self, texts: list[str], profiles: list[tuple[str, int, int]]) -> tuple[np.ndarray, list]:
        """Index of the text and the ``COLUMNS`` of each piece. The texts lie in one buffer, with a byte between them that is no token."""
        texts_b = [t.encode("utf-8", "surrogatepass") for t in texts]
        sizes = [self.tokenizer.sizes(t) for t in texts]
        buffer = b"\0".join(texts_b)
        raw = np.frombuffer(buffer, np.uint8)
        first = np.concatenate([[0], np.cumsum([len(x) for x in sizes])]).astype(np.int64)
        size = np.concatenate(sizes)
        ends = np.cumsum(size) + np.repeat(np.arange(len(texts)), np.diff(first))
        starts = ends - size
        cutter = _Cutter(raw, starts, *boundaries(raw, starts, self.abbreviations))
        bounds = first.tolist()
        rows: list[list] = [[], [], [], [], [], [], []]
        text_of, profile_of, piece_of, own_of, end_of, begin_of, kind_of = rows
        for d, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            for profile, most, overlap in profiles:
                if b - a <= most:
                    continue
                edges, kinds = cutter.atoms(a, b, most - overlap)
                kept = merge([y - x for x, y in zip(edges, edges[1:], strict=False)], kinds, most - overlap, most)
                n = len(kept) + 1
                cuts = [edges[i + 1] for i in kept]
                text_of += [d] * n
                profile_of += [profile] * n
                piece_of += range(n)
                own_of += [a, *cuts]
                end_of += [*cuts, b]
                begin_of += [a, *[max(a, c - overlap) for c in cuts]]
                kind_of += [*[KINDS[kinds[i]] for i in kept], "end"]
        if not text_of:
            return np.empty(0, np.int64), [[] for _ in COLUMNS]
        text, own, end, begin = (np.array(x, np.int64) for x in (text_of, own_of, end_of, begin_of))
        while (inner := (raw[starts[begin]] & 0xC0 == 0x80) & (begin < own)).any():
            begin += inner
        inner = np.flatnonzero(raw & 0xC0 == 0x80)
        char = [x - np.searchsorted(inner, x) for x in (starts[begin], starts[own], starts[first[text]])]
        at = zip(starts[begin].tolist(), ends[end - 1].tolist(), strict=True)
        return text, [
            profile_of, piece_of, begin - first[text], end - first[text], end - begin, own - begin,
            char[0] - char[2], char[1] - char[0], kind_of, [buffer[x:y] for x, y in at],
        ]

    def pieces(self, text: str, profiles: list[tuple[str, int, int]]) -> list[tuple]:
        """The rows of one text."""
        cols = self.split([text], profiles)[1]
        return [(*r[:-1], r[-1].decode("utf-8", "replace")) for r in zip(*[c.tolist() if isinstance(c, np.ndarray) else c for c in cols], strict=True)]


def bounded_profiles(limits: DataFrame, limit: int = 1000) -> list[tuple[str, int, int]]:
    """Profiles on the driver. Without a positive ``max_tokens`` a profile is ignored; an overlap is at least 0 and below ``max_tokens``."""
    rows = limits.where("profile IS NOT NULL AND max_tokens > 0").select("profile", "max_tokens", "overlap_tokens").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} profiles")
    return sorted((r[0], r[1], min(max(r[2] or 0, 0), r[1] - 1)) for r in rows)


def split_texts(docs: DataFrame, id_col: str, text_col: str, profiles: list[tuple[str, int, int]], tokenizer: ByteTokenizer) -> DataFrame:
    """Pieces of every text longer than a profile's ``max_tokens``.

    Returns ``<id_col>, profile, piece, first_token, end_token, tokens, overlap, first_char, overlap_chars, cut, text``. Pieces are ranges of the
    text's own tokens: at most ``max_tokens``, the first too, each other sharing exactly ``overlap_tokens`` with the one before
    (fewer by up to three only where the shared part would begin inside a character, fewer too at a text's
    beginning). Without the shared parts (the first ``overlap_chars`` characters) they add up to the text; ``first_char`` is a piece's place in it. ``cut`` says at which kind of boundary a piece ends.

    Defined cases: null and empty texts, and texts within the limit, give no rows; a text without any blank is
    cut between tokens that begin a character; a single character of more tokens than the limit stays whole;
    repeated documents each come out; other columns are ignored; no profiles or no documents give an empty result.

    Scale: one pass without a shuffle, each text tokenized once for all profiles. A text of n tokens takes O(n log n).
    """
    ship(docs.sparkSession)
    splitter = Splitter(tokenizer)
    kinds = [pa.string(), *[pa.int32()] * 7, pa.string(), pa.string()]
    schema = pa.schema([("id", pa.int64()), *zip(COLUMNS, kinds, strict=True)])
    least = min((m for _, m, _ in profiles), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(text) * 4 <= least:  # no more bytes than tokens allowed
                    continue
                ids.append(i)
                texts.append(text)
                size += len(text)
                if size > 1 << 20:
                    yield made(ids, texts)
                    ids, texts, size = [], [], 0
            if texts:
                yield made(ids, texts)

    def made(ids: list[int], texts: list[str]) -> pa.RecordBatch:
        of, cols = splitter.split(texts, profiles)
        arrays = [pa.array(np.array(ids, np.int64)[of])]
        for c, t in zip(cols, kinds, strict=True):
            arrays.append(pa.array(c, pa.binary()).cast(pa.string()) if c is cols[-1] else pa.array(c, t))
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    texts = docs.where(F.length(text_col) > 0).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if not profiles:
        texts = texts.limit(0)
        profiles = [("", 1, 0)]
    out = texts.mapInArrow(run, "id long, profile string, piece int, first_token int, end_token int, tokens int, overlap int, first_char int, overlap_chars int, cut string, text string")
    return out.withColumnRenamed("id", id_col)
