"""Visually identical text with different characters: confusables skeleton and one consistent form."""

from __future__ import annotations

import re
import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.session import ship, spread, written

#: Typographic characters that count as plainly typed.
TYPOGRAPHIC = "’‘“”–—"
#: Prototypes that differ from the public confusables data. The palochka is drawn as a bar.
OVERRIDES = {0x4CF: "l", 0x4C0: "I"}
_IGNORABLE = ((0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF))


@lru_cache(maxsize=1 << 16)
def script(ch: str) -> str:
    return unicodedata.name(ch, "?").split()[0]


@lru_cache(maxsize=1 << 16)
def invisible(ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" or any(a <= ord(ch) <= b for a, b in _IGNORABLE)


@dataclass(frozen=True)
class LookAlikes:
    """``prototypes`` of all look-alike characters, for skeletons; ``typed``: those that a plainly typed character stands for, for forms."""

    prototypes: dict[int, str]
    typed: dict[int, str]


def lookalike_table(spark: SparkSession) -> LookAlikes:
    """Prototype of every look-alike character, from the public confusables data in the ICU library that Spark ships.

    All assigned letters, numbers, punctuation and symbols outside ASCII are asked for, and all prototypes kept. ASCII characters are
    their own prototypes, so spelling with plainly typed characters (1 for l, 0 for O) stays apart. A character drawn as one or two ASCII
    characters, letters as letters, is also ``typed``; an upper-case letter drawn as a bar as I, not l. Composed Latin letters are typed as
    they are. The table has some ten thousand entries.
    """
    cached = getattr(spark, "_almanac_lookalikes", None)
    if cached is not None:
        return cached
    points = [cp for cp in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(cp))[0] in "LPSN" and chr(cp) not in TYPOGRAPHIC]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    skeletons = checker.getSkeleton("\n".join(map(chr, points))).split("\n")
    prototypes, typed = {}, dict(OVERRIDES)
    for cp, proto in zip(points, skeletons, strict=True):
        ch, proto = chr(cp), unicodedata.normalize("NFKD", proto)
        if proto != unicodedata.normalize("NFKD", ch):
            prototypes[cp] = proto
        if cp not in typed and not _plain_latin(ch) and proto.isascii() and 0 < len(proto) <= 2 and (proto.isalpha() or not ch.isalpha()):
            typed[cp] = "I" if proto == "l" and ch.isupper() else "m" if proto == "rn" else proto
    got = LookAlikes(prototypes | typed, typed)
    spark._almanac_lookalikes = got
    return got


@lru_cache(maxsize=1 << 16)
def _plain_latin(ch: str) -> bool:
    """A composed letter of the Latin alphabet as keyboards give it."""
    cp = ord(ch)
    return (0xC0 <= cp <= 0x24F or 0x1E00 <= cp <= 0x1EFF) and ch.isalpha() and unicodedata.normalize("NFKC", ch) == ch


class TextForm:
    """Skeleton, consistent form and disguise test of single texts. Picklable; the table is its only state."""

    def __init__(self, table: LookAlikes):
        self.looks = table
        self.table = table.typed
        self.fold = table.prototypes | {ord(a): b for a, b in zip(TYPOGRAPHIC, "''\"\"--", strict=True)}
        foreign = [chr(cp) for cp, p in self.table.items() if chr(cp).isalpha() and script(chr(cp)) != "LATIN"]
        self.foreign = frozenset(foreign)
        self.back: dict[tuple[str, str], str] = {}
        for ch in sorted(foreign):
            self.back.setdefault((script(ch), self.table[ord(ch)]), ch)
        #: Look-alikes whose compatibility decomposition would lead away from their prototype (the lunate sigma).
        self.early = {cp: p for cp, p in self.table.items() if not (k := unicodedata.normalize("NFKD", chr(cp))).isascii() and k != chr(cp)}
        self._other = frozenset(chr(cp) for cp in self.table) - self.foreign
        self._words: dict[str, str] = {}
        self._letters = re.compile("[^\\W\\d_]+(?:[\u0300-\u036f]+[^\\W\\d_]*)*")

    def __getstate__(self):
        return {"table": self.looks}

    def __setstate__(self, state):
        self.__init__(state["table"])

    def clean(self, text: str) -> str:
        """Compatibility decomposed, invisible characters dropped, every blank an ordinary one."""
        return "".join(
            " " if unicodedata.category(c) == "Zs" else c for c in unicodedata.normalize("NFKD", text.translate(self.early)) if not invisible(c)
        )

    def skeleton(self, text: str) -> str:
        """Decompose, replace every character by its prototype, decompose again; runs of blanks count as one."""
        if text.isascii():
            return " ".join(text.split())
        return " ".join(unicodedata.normalize("NFKD", self.clean(text).translate(self.fold)).split())

    def _truly_foreign(self, word: str) -> bool:
        return any(c.isalpha() and c not in self.foreign and script(c) != "LATIN" for c in word)

    def _word(self, w: str) -> str:
        """A word (decomposed) with the letters of one alphabet; marked where every letter has a Latin look-alike."""
        if w.isascii():
            return w
        got = self._words.get(w)
        if got is None:
            if self._truly_foreign(w):
                own = max((script(c) for c in w if c.isalpha() and script(c) != "LATIN"), key=[script(c) for c in w].count)
                got = "".join(self.back.get((own, c), c) if c.isascii() else c for c in w)
            else:
                got = w.translate(self.table)
                if got != w and all(c in self.foreign or not c.isalpha() for c in w):
                    got = "\0" + got
            if len(self._words) < 200_000:
                self._words[w] = got
        return got

    def _spelt(self, s: str) -> str:
        """``s`` (decomposed) with every word in one alphabet; where either would do, the words next to it decide."""
        words = list(self._letters.finditer(s))
        out, last = [], 0
        for i, m in enumerate(words):
            w = m.group()
            got = self._word(w)
            if got[:1] == "\0":
                near = [x.group() for x in (*words[max(0, i - 1) : i], *words[i + 1 : i + 2])]
                got = w if any(self._truly_foreign(x) for x in near) else got[1:]
            if got is not w:
                out += s[last : m.start()], got
                last = m.end()
        return "".join([*out, s[last:]])

    def form(self, text: str) -> str:
        """The text in plainly typed characters: the words keep their alphabet, everything drawn alike becomes the same."""
        if text.isascii():
            return text
        s = self._spelt(self.clean(text))
        s = "".join(self.table.get(ord(c), c) if c in self._other else c for c in s)
        return unicodedata.normalize("NFC", s)

    def plain(self, text: str) -> bool:
        """Made of plainly typed characters only."""
        if text.isascii():
            return True
        if unicodedata.normalize("NFC", text) != text:
            return False
        foreign = None
        for c in text:
            if c.isascii() or c in TYPOGRAPHIC or _plain_latin(c):
                continue
            if not c.isalpha() or script(c) == "LATIN" or unicodedata.normalize("NFKC", c) != c:
                return False
            foreign = True
        return foreign is None or self.form(text) == text

    def fold_text(self, text: str) -> str:
        """``form`` for long texts: characters are looked at one by one only where the text has unusual ones."""
        if text.isascii():
            return text
        for cp in {ord(c) for c in set(text)} & self.early.keys():
            text = text.replace(chr(cp), self.early[cp])
        t = unicodedata.normalize("NFKC", text)
        seen = {c for c in set(t) if not c.isascii()}
        for c in seen:
            if invisible(c):
                t = t.replace(c, "")
            elif c in self._other:
                t = t.replace(c, self.table[ord(c)])
        if seen & self.foreign or any(unicodedata.combining(c) for c in seen):
            t = unicodedata.normalize("NFC", self._spelt(unicodedata.normalize("NFKD", t)))
        return t


def name_forms(names: DataFrame, table: LookAlikes, text: str = "display_name") -> DataFrame:
    """Per distinct text: ``skeleton``, the ``form`` of its group of equal skeletons and whether it is ``disguised``.

    ``names`` has the column ``text`` and may have others. The texts are made distinct first (a text that a
    third of all rows share becomes one row before any Python runs), described once, and grouped by equal skeleton. The
    group's form is its commonest plainly typed member; a member rewritten in plainly typed characters, of the same skeleton, is one too, of no
    weight. Ties go to the smallest. Without any the smallest rewritten text is the form. A text is
    disguised if it isn't plainly typed and its group has a plainly typed form. Null texts come out nowhere; empty and blank ones have the empty skeleton.

    Returns ``text, n, skeleton, disguised, form``. The descriptions are written to the shared folder.
    """
    ship(names.sparkSession)
    tf = TextForm(table)

    @F.pandas_udf("skeleton string, own string, plain boolean, typed boolean")
    def describe(s: pd.Series) -> pd.DataFrame:
        own = [" ".join(tf.form(x).split()) for x in s]
        skeleton, plain = [tf.skeleton(x) for x in s], [tf.plain(x) for x in s]
        typed = [p or (tf.plain(o) and tf.skeleton(o) == k) for p, o, k in zip(plain, own, skeleton, strict=True)]
        return pd.DataFrame({"skeleton": skeleton, "own": own, "plain": plain, "typed": typed})

    distinct = names.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("_t")).agg(F.count("*").alias("n"))
    each = written(spread(distinct, "_t").withColumn("_d", describe("_t")).select("_t", "n", "_d.*"), "forms")
    groups = (
        each.groupBy("skeleton", "own").agg(F.sum(F.when(F.col("plain"), F.col("n")).otherwise(0)).alias("w"), F.bool_or("typed").alias("typed"))
        .groupBy("skeleton").agg(F.min_by("own", F.struct(~F.col("typed"), -F.col("w"), F.col("own"))).alias("form"), F.bool_or("typed").alias("typed"))
    )
    met = each.drop("own", "typed").join(groups, "skeleton")
    return met.select(F.col("_t").alias(text), "n", "skeleton", (~F.col("plain") & F.col("typed")).alias("disguised"), "form")


def consistent_names(rows: DataFrame, table: LookAlikes, text: str = "display_name") -> DataFrame:
    """``rows`` with ``<text>_form`` and ``<text>_disguised``; null texts keep null forms and are not disguised.

    Columns that already have these two names are replaced, all others stay; repeated rows each come out.

    The rows meet their forms by an equi-join on the text, whose hot values adaptive execution splits; the
    side of the forms has one row per distinct text. Rows without a text, which a join would send to one
    task, pass it by.
    """
    own = [f"{text}_form", f"{text}_disguised"]
    forms = name_forms(rows, table, text).select(F.col(text).alias("__text"), F.col("form").alias(own[0]), F.col("disguised").alias(own[1]))
    rows = rows.drop(*own)
    said = rows.where(F.col(text).isNotNull())
    met = said.join(forms, said[text] == forms["__text"]).drop(forms["__text"])
    silent = rows.where(F.col(text).isNull()).withColumns({own[0]: F.lit(None).cast("string"), own[1]: F.lit(False)})
    return met.unionByName(silent)
