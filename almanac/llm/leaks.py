"""Evaluation texts leaking into training text: generalised suffix automaton over words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.confusables import LookAlikes, TextForm
from almanac.session import ship

WORD = re.compile(r"[^\W_]+")


def words_of(text: str, form: TextForm) -> list[str]:
    """Longest runs of letters and digits, in the consistent form and lower case."""
    return WORD.findall(form.fold_text(text).lower())


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the items of every state."""

    def __init__(self, items: Iterable[tuple[int, list[str]]], least: int):
        self.least = least
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = [(item, [self.ids.setdefault(w, len(self.ids)) for w in words]) for item, words in items]
        for _, seq in coded:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        self.items: list[set[int]] = [set() for _ in self.link]
        for item, seq in coded:
            s = 0
            for w in seq:
                s = self.next[s][w]
                t = s
                while t > 0 and item not in self.items[t]:
                    self.items[t].add(item)
                    t = self.link[t]

    def _new(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(nxt)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        cur = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return cur

    def stream(self, words: list[str]) -> list[tuple[int, int, int]]:
        """``(end, state, length)`` of every position at which the longest match has ``least`` words or more."""
        nxt, link, length, least = self.next, self.link, self.length, self.least
        hits = []
        state = run = 0
        for i, w in enumerate(map(self.ids.get, words)):
            if w is None:
                state = run = 0
                continue
            to = nxt[state].get(w)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = nxt[state].get(w)
                if to is None:
                    run = 0
                    continue
                run = length[state]
            state = to
            run += 1
            if run >= least:
                hits.append((i + 1, state, run))
        return hits

    def matches(self, hits: list[tuple[int, int, int]]) -> dict[int, list[tuple[int, int]]]:
        """Spans ``(start, end)`` of words by item; each is the longest at its end."""
        spans: dict[int, dict[int, int]] = {}
        for end, state, run in hits:
            while state > 0 and (n := min(run, self.length[state])) >= self.least:
                for item in self.items[state]:
                    own = spans.setdefault(item, {})
                    own[end] = max(n, own.get(end, 0))
                state = self.link[state]
        return {item: [(e - n, e) for e, n in sorted(own.items())] for item, own in spans.items()}


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class LeakFinder:
    """Holds the items; their automaton is built once in each Python worker and shared by its tasks."""

    _built: dict[str, SuffixAutomaton] = {}

    def __init__(self, items: list[tuple[int, str]], form: TextForm, least: int = 12):
        self.texts, self.tf, self.least = items, form, least
        self.mark = hashlib.sha256(repr((least, items)).encode("utf-8", "replace")).hexdigest()

    @property
    def automaton(self) -> SuffixAutomaton:
        got = self._built.get(self.mark)
        if got is None:
            got = SuffixAutomaton(((i, words_of(t, self.tf)) for i, t in self.texts), self.least)
            self._built.clear()  # a worker holds one
            self._built[self.mark] = got
        return got

    def find(self, text: str) -> tuple[list[str], dict[int, list[tuple[int, int]]]]:
        words = words_of(text, self.tf)
        if len(words) < self.least:
            return words, {}
        hits = self.automaton.stream(words)
        return words, self.automaton.matches(hits) if hits else {}

    def without(self, text: str, spans: list[tuple[int, int]]) -> str:
        """The text without the pieces between blanks that contain words of the spans."""
        out, at, k, last = [], 0, 0, 0
        for m in re.finditer(r"\S+", text):
            n = len(words_of(m.group(), self.tf))
            while k < len(spans) and spans[k][1] <= at:
                k += 1
            if n and k < len(spans) and spans[k][0] < at + n:
                out.append(text[last : m.start()])
                last = m.end()
            at += n
        return "".join([*out, text[last:]])


def bounded_items(items: DataFrame, id_col: str, text_col: str, group_words: int = 250_000, most_bytes: int = 1 << 28) -> list[list[tuple[int, str]]]:
    """The held-out items on the driver, in groups of ``group_words`` words (a longer item is a group by itself); an error beyond ``most_bytes`` of text.

    A worker holds the automaton of one group: some 0.9 kB a word, so about 220 MB. Each group costs a pass over the documents.
    """
    known = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col)
    size = known.agg(F.sum(F.octet_length(text_col) + 32)).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"the items have {size} bytes, more than {most_bytes}; split them and take the union of the results")
    groups: list[list[tuple[int, str]]] = [[]]
    room = group_words
    for i, text in sorted((r[0], r[1]) for r in known.collect()):
        n = len(WORD.findall(text))
        if n > room and groups[-1]:
            groups.append([])
            room = group_words
        groups[-1].append((i, text))
        room -= n
    return groups if groups[0] else []


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


def leaked(docs: DataFrame, id_col: str, text_col: str, groups: list[list[tuple[int, str]]], table: LookAlikes, least: int = 12) -> DataFrame:
    """Documents with the items of which they contain ``least`` consecutive words or more. ``groups`` as ``bounded_items`` gives them.

    Returns ``<id_col>, item_id, longest, words, doc_share``: the longest match, the document's words in
    matches with the item and their share of the document.

    Defined cases: null and empty texts, and items shorter than ``least`` words, match nothing; a passage that
    several items share counts for each; repeated documents each come out; other columns are ignored; no
    items or no documents give an empty result.

    Scale: one pass over the two columns for each group of items, without any shuffle; a worker holds one automaton and one Arrow batch.
    The time per word doesn't depend on the number of items of a group.
    """
    ship(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("item_id", pa.int64()), ("longest", pa.int32()), ("words", pa.int32()), ("doc_share", pa.float64())])

    def found_by(finder: LeakFinder):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words, found = finder.find(text)
                    for item, spans in found.items():
                        n = sum(b - a for a, b in merged(spans))
                        rows.append((i, item, max(b - a for a, b in spans), n, n / len(words)))
                yield _batch(rows, schema)

        return run

    texts = docs.where(F.col(text_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    form = TextForm(table)
    parts = [texts.mapInArrow(found_by(LeakFinder(g, form, least)), "id long, item_id long, longest int, words int, doc_share double") for g in groups or [[]]]
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("id", id_col)


def decontaminated(
    docs: DataFrame, id_col: str, text_col: str, groups: list[list[tuple[int, str]]], table: LookAlikes, least: int = 12, most_share: float = 0.5
) -> DataFrame:
    """``<id_col>, text, removed_words, dropped``: the texts without leaked spans.

    Of a document whose leaked words exceed ``most_share`` of its words nothing is kept (``dropped``, null
    text). Null texts stay null and texts without leaks are unchanged. One pass per group of items, without a shuffle; the spans
    of all but the last are carried along with the text.
    """
    ship(docs.sparkSession)
    form = TextForm(table)
    spans_type = pa.list_(pa.list_(pa.int32()))
    carried = pa.schema([("id", pa.int64()), ("text", pa.string()), ("spans", spans_type)])
    schema = pa.schema([("id", pa.int64()), ("text", pa.string()), ("removed_words", pa.int32()), ("dropped", pa.bool_())])

    def clean(finder: LeakFinder, text: str | None, earlier: list) -> tuple[str | None, int, bool]:
        if not text:
            return text, 0, False
        words, found = finder.find(text)
        spans = merged([*map(tuple, earlier), *(s for own in found.values() for s in own)])
        if not spans:
            return text, 0, False
        n = sum(b - a for a, b in spans)
        if n > most_share * len(words):
            return None, n, True
        return finder.without(text, spans), n, False

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        return zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def marking(finder: LeakFinder):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _batch([(i, t, [*e, *(s for own in (finder.find(t)[1] if t else {}).values() for s in own)]) for i, t, e in rows_of(batch)], carried)

        return run

    def cleaning(finder: LeakFinder):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _batch([(i, *clean(finder, t, e)) for i, t, e in rows_of(batch)], schema)

        return run

    *first, last = [LeakFinder(g, form, least) for g in groups or [[]]]
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.array().cast("array<array<int>>").alias("spans"))
    for finder in first:
        df = df.mapInArrow(marking(finder), "id long, text string, spans array<array<int>>")
    out = df.mapInArrow(cleaning(last), "id long, text string, removed_words int, dropped boolean")
    return out.withColumnsRenamed({"id": id_col, "text": text_col} if text_col != "text" else {"id": id_col})
