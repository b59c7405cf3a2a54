"""Mapping free-entered names to a reference list: trie of entries and aliases, searched with a Levenshtein automaton."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.confusables import LookAlikes, TextForm
from almanac.session import ship, spread


@dataclass(frozen=True)
class NameRules:
    """What is known of the names of a list, all parameters; the defaults know nothing.

    ``decoration``: patterns of what people put round a name and means nothing by itself; ``tails``: the same at the end, as run-together letters, whole
    or broken off after four; ``heads``: at the beginning. ``short``: abbreviations of words. ``alike``: characters of which the second stands for the first
    too. ``spellings``: of the same part of a name. ``prefixes``: first parts typed as one or two letters. ``turned``: last words that are also typed first,
    or as one letter. ``titles``: a qualifier that begins with one is shortened in it only. ``weak``: greatest distance from a weak path, which says less of its entry than a whole name.
    """

    decoration: tuple[str, ...] = ()
    heads: tuple[str, ...] = ()
    tails: tuple[str, ...] = ()
    short: tuple[tuple[str, str], ...] = ()
    alike: tuple[str, str] = ("", "")
    spellings: tuple[tuple[str, str], ...] = ()
    prefixes: tuple[str, ...] = ()
    turned: tuple[str, ...] = ()
    titles: tuple[str, ...] = ()
    weak: int = 2


def allowed(length: int) -> int:
    """Greatest distance for a text of this many letters."""
    return 0 if length < 4 else 1 if length < 8 else 2 if length < 16 else 3


class Spelling:
    """Texts as the letters that are compared, and what is typed for an entry, by the rules."""

    def __init__(self, rules: NameRules = NameRules()):
        self.rules, self.short, self.alike = rules, dict(rules.short), str.maketrans(*rules.alike)
        tails = {self.letters([t])[:n] for t in rules.tails for n in range(4, len(t) + 1)}
        self.tail = re.compile("(?:" + "|".join(sorted(tails, key=lambda t: (-len(t), t))) + ")$") if tails else None
        self.head = re.compile("^(?:" + "|".join(self.letters([h]) for h in rules.heads) + ")") if rules.heads else None
        self.initial = re.compile("^(?:" + "|".join(self.letters([p]) for p in rules.prefixes) + ")") if rules.prefixes else None

    def words_of(self, text: str) -> list[str]:
        """Words without accents, apostrophes and case; ``&`` becomes ``and``."""
        t = unicodedata.normalize("NFD", text.lower())
        t = "".join(c for c in t if not unicodedata.combining(c) and c not in "'’‘`")
        return [self.short.get(w, w) for w in re.findall(r"[^\W_]+", t.replace("&", " and "))]

    def bare(self, text: str) -> str:
        """The text without decoration; a nought counts as the letter there."""
        t = text.lower().replace("0", "o")
        while True:
            before = t
            for pattern in self.rules.decoration:
                t = re.sub(pattern, "", t).strip()
            if t == before:
                return t

    def letters(self, words: Iterable[str]) -> str:
        return "".join(words).translate(self.alike)

    def without_tail(self, compact: str) -> str:
        """Letters without the decoration at their end, and the same run together in front."""
        if self.head:
            compact = self.head.sub("", compact)
        while self.tail and (m := self.tail.search(compact)):
            compact = compact[: m.start()]
        return compact

    def _begun(self, name: str) -> Iterator[str]:
        """The letters with their first part as one or two letters."""
        if self.initial and (m := self.initial.match(name)):
            yield from (name[:n] + name[m.end() :] for n in (1, 2))

    def paths(self, name: str) -> Iterator[tuple[str, bool]]:
        """What is typed for an entry: its words, a qualifier in front or doubled, its parts in turn; shortened words as weak paths."""
        words_of, letters = self.words_of, self.letters
        t = name.lower()
        m = re.fullmatch(r"(.*?)\s*\(([^()]*)\)\s*", t)
        if m and (q := words_of(m[2])):
            base = words_of(m[1])
            weak = []
            if q[0] in self.rules.titles:
                weak = [[q[0][0], *q[1:]]]
            elif len(q) > 1:
                weak = [[q[0][0], *q[1:]], [*q[:-1], q[-1][0]], [w[0] for w in q], [w[:3] for w in q], [w[:4] for w in q]]
                weak.append([q[0][0] + re.sub("[aeiou]", "", q[0][1:]), *[w[:3] for w in q[1:]]])
            for x in [q, *weak]:
                yield letters(base + x), x is not q
                yield letters(x + base), x is not q
            yield letters(q + base + q), False
            return
        parts = [words_of(p) for p in re.split(r"\s[&–—-]\s|/", t)]
        if len(parts) == 2:
            a, b = parts
            for x, y in ((a, b), (b, a)):
                yield letters(x + y), False
                yield letters([*x, "and", *y]), False
                for rest in self._begun(letters(y)):
                    yield letters([*x, rest]), True
                    yield letters([*x, "and", rest]), True
            return
        w = words_of(t)
        yield letters(w), False
        if len(w) > 1 and w[-1] in self.rules.turned:
            yield letters([w[-1], *w[:-1]]), False
            yield letters([*w[:-1], w[-1][0]]), True

    def alias_paths(self, name: str) -> Iterator[tuple[str, bool]]:
        """``paths`` in all spellings, with a weak path for a shortened first part."""
        for p, weak in self.paths(name):
            yield p, weak
            for a, b in self.rules.spellings:
                if self.letters([a]) in p:
                    yield p.replace(self.letters([a]), self.letters([b])), weak
            for x in self._begun(p):
                yield x, True


#: Marks a node below which the paths of several entries end.
MANY = -1


class Trie:
    """Trie of alias paths; a node is ``[children, {id: weak}, the one entry with whole names below or MANY]``. Built once from a bounded reference list."""

    def __init__(self, entries: Iterable[tuple[int, str]], spelling: Spelling | None = None):
        self.spelling = spelling or Spelling()
        self.weak = self.spelling.rules.weak
        self.root: list = [{}, None, None]
        paths: dict[str, dict[int, bool]] = {}
        for ref, name in entries:
            for x, w in self.spelling.alias_paths(name):
                own = paths.setdefault(x, {})
                own[ref] = w and own.get(ref, True)
        self.longest = max(map(len, paths), default=0)
        for p, refs in paths.items():
            whole = [r for r, weak in refs.items() if not weak]
            only = None if not whole else whole[0] if len(whole) == 1 else MANY
            node = self.root
            self._mark(node, only)
            for c in p:
                node = node[0].setdefault(c, [{}, None, None])
                self._mark(node, only)
            node[1] = refs

    @staticmethod
    def _mark(node: list, only: int | None) -> None:
        if only is not None:
            node[2] = only if node[2] in (None, only) else MANY

    def search(self, text: str, most: int, beginning: bool = False) -> dict[int, int]:
        """All entries within ``most`` edits, with their distances.

        The automaton is run bit-parallel: bit i of state d says that the path so far equals the first i
        letters of ``text`` up to d edits. A branch is left as soon as no state is alive. Weak paths count up to
        ``weak`` edits. With ``beginning``, the entries of whose whole names the text is a beginning within ``most`` edits; ``MANY``
        among them where a node belongs to several.
        """
        m = len(text)
        if m > self.longest + most:
            return {}
        full, goal = (1 << (m + 1)) - 1, 1 << m
        masks: dict[str, int] = {}
        for i, c in enumerate(text):
            masks[c] = masks.get(c, 0) | (2 << i)
        found: dict[int, int] = {}
        stack = [(self.root, tuple(((2 << d) - 1) & full for d in range(most + 1)))]
        while stack:
            (children, refs, only), states = stack.pop()
            if states[-1] & goal:
                d = next(d for d, s in enumerate(states) if s & goal)
                if beginning:
                    if only is not None and d < found.get(only, most + 1):
                        found[only] = d
                elif refs is not None:
                    for r, weak in refs.items():
                        if d < found.get(r, most + 1) and not (weak and d > self.weak):
                            found[r] = d
            low = states[0]
            for c, child in children.items():
                mask = masks.get(c, 0)
                last = (low << 1) & mask
                new = [last]
                below = low
                for s in states[1:]:
                    last = (((s << 1) & mask) | below | (below << 1) | (last << 1)) & full
                    new.append(last)
                    below = s
                if last:
                    stack.append((child, tuple(new)))
        return found


class Matcher:
    """Finds the entries of single texts; the form of equal-looking characters comes first. The trie is built once in each Python worker."""

    _tries: dict[str, Trie] = {}

    def __init__(self, entries: list[tuple[int, str]], form: TextForm, rules: NameRules = NameRules()):
        self.entries, self.tf, self.rules = entries, form, rules
        self.mark = hashlib.sha256(repr((entries, rules)).encode("utf-8", "replace")).hexdigest()

    @property
    def trie(self) -> Trie:
        got = self._tries.get(self.mark)
        if got is None:
            got = Trie(self.entries, Spelling(self.rules))
            self._tries.clear()  # a worker holds one
            self._tries[self.mark] = got
        return got

    def variants(self, text: str) -> list[str]:
        """The letters of the text without and with its decoration; none if it is decoration only."""
        sp = self.trie.spelling
        t = " ".join(self.tf.form(text).split())
        undecorated = sp.letters(sp.words_of(sp.bare(t)))
        core = sp.without_tail(undecorated)
        return [v for v in dict.fromkeys((core, undecorated, sp.letters(sp.words_of(t)))) if v] if core else []

    def candidates(self, text: str) -> list[tuple[int, int]]:
        """``(distance, ref)`` of all entries within the distance for the text's length, nearest first."""
        seen: dict[int, int] = {}
        for v in self.variants(text):
            for ref, d in self.trie.search(v, allowed(len(v))).items():
                seen[ref] = min(d, seen.get(ref, d))
        return sorted((d, r) for r, d in seen.items())

    def begun(self, text: str) -> list[tuple[int, int]]:
        """``(distance, ref)`` of the one entry of whose whole names the text is a beginning, to within one edit less than a whole text may have; else nothing."""
        for v in self.variants(text):
            near = self.trie.search(v, allowed(len(v)) - 1, True) if allowed(len(v)) else {}
            least = [r for r, d in near.items() if d == min(near.values())]
            if len(least) == 1 and least[0] != MANY:
                return [(near[least[0]], least[0])]
        return []

    def nearest(self, text: str) -> list[tuple[int, int]]:
        """The candidates at the least distance: the automaton is run for growing distances and stops at the first that reaches an entry."""
        vs = self.variants(text)
        for most in range(max((allowed(len(v)) for v in vs), default=-1) + 1):
            if near := {r for v in vs if most <= allowed(len(v)) for r in self.trie.search(v, most)}:
                return sorted((most, r) for r in near)
        return []

    def found(self, text: str, every: bool = True) -> tuple[list[tuple[int, int]], bool]:
        """The candidates, or only the nearest; where there are none, the entry of which the text is a beginning, and whether it is that."""
        near = self.candidates(text) if every else self.nearest(text)
        return (near, False) if near else (self.begun(text), True)

    def best(self, text: str) -> int:
        """The nearest entry; 0 if there is none, or several are equally near."""
        near, _ = self.found(text, every=False)
        return near[0][1] if len(near) == 1 else 0


def bounded_entries(refs: DataFrame, id_col: str, name_col: str, limit: int = 200_000) -> list[tuple[int, str]]:
    """The reference list on the driver; an error beyond ``limit`` entries, since every worker holds the trie."""
    rows = refs.where(F.col(id_col).isNotNull() & F.col(name_col).isNotNull()).select(id_col, name_col).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the reference list has more than {limit} entries")
    return sorted((r[0], r[1]) for r in rows)


def _searched(rows: DataFrame, text: str, entries: list[tuple[int, str]], table: LookAlikes, rules: NameRules, every: bool) -> DataFrame:
    """``__text, __c``: each distinct text that isn't blank with its candidates, nearest first, or with the nearest only."""
    ship(rows.sparkSession)
    m = Matcher(entries, TextForm(table), rules)

    @F.pandas_udf("array<struct<distance:int,ref_id:long,beginning:boolean>>")
    def search(s: pd.Series) -> pd.Series:
        return pd.Series([[{"distance": d, "ref_id": r, "beginning": b} for d, r in near] for near, b in (m.found(x, every) for x in s)])

    distinct = rows.select(F.col(text).alias("__text")).where(F.col("__text").rlike(r"(?U)[^\s]")).distinct()
    search = search.asNondeterministic()  # else a filter on its result would run it twice
    return spread(distinct, "__text").withColumn("__c", search("__text"))


def candidates_in_list(rows: DataFrame, text: str, entries: list[tuple[int, str]], table: LookAlikes, rules: NameRules = NameRules()) -> DataFrame:
    """``text, ref_id, distance, beginning``: of each distinct text all entries within the distance for its length.

    A text without any gets the one entry of which it is a beginning (``beginning``). Null and blank texts, and those without entries, come out nowhere.
    """
    return _searched(rows, text, entries, table, rules, True).select(F.col("__text").alias(text), F.inline("__c")).select(text, "ref_id", "distance", "beginning")


def map_to_list(rows: DataFrame, text: str, entries: list[tuple[int, str]], table: LookAlikes, rules: NameRules = NameRules()) -> DataFrame:
    """``rows`` whose text is neither null nor blank, with ``ref_id`` (0: no entry), ``distance`` and the number of ``nearest`` entries.

    Distinct texts are searched once each (partial aggregation collapses a text that a third of the rows share
    before any Python runs) for the nearest of the entries within the distance for their length (``candidates_in_list`` gives all), and joined back to the rows.

    Defined cases: null and blank texts (also of other blanks) come out nowhere; texts equally near to two
    entries, or near to none, get 0; an empty list gives 0 everywhere; texts longer
    than any path by more than the distance get 0 without a search; repeated rows each come out; columns that
    already have the names of the three are replaced, others stay.
    """
    near, first = F.size("__c"), F.get("__c", F.lit(0))
    mapped = _searched(rows, text, entries, table, rules, False).select(
        "__text", F.when(near == 1, first["ref_id"]).otherwise(F.lit(0)).alias("ref_id"), first["distance"].alias("distance"), near.alias("nearest")
    )
    rows = rows.drop("ref_id", "distance", "nearest")
    return rows.join(mapped, rows[text] == mapped["__text"]).drop(mapped["__text"])
