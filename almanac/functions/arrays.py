"""Arrays, maps and JSON: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanac.functions.text import lines

EVENT = "array<struct<title:string,date_iso:string,time_24h_or_null:string,location_or_null:string,description:string,category:string>>"
#: Kinds of events, and words that hint at them.
CATEGORIES = ("mass", "confession", "meeting", "fundraiser", "sacrament", "social", "youth", "other")
SOCIAL = (
    "bingo", "ceili", "céili", "dance", "raffle", "coffee morning", "fundraiser", "quiz night", "table quiz", "whist drive", "concert",
    "walk of hope", "car wash", "bring and buy", "jumble sale",
)


def json_span(raw: Column) -> Column:
    """From the first opening to the last closing bracket, code fences aside; null without."""
    first = F.instr(raw, F.lit("["))
    last = F.length(raw) - F.instr(F.reverse(raw), F.lit("]")) + 1
    return F.when((first > 0) & raw.contains("]") & (last > first), F.substring(raw, first, last - first + 1))


def events_of(raw: Column) -> Column:
    """Valid events of a free-form answer: a day that exists, a title, a known kind; what isn't said is null."""
    items = F.coalesce(F.from_json(json_span(raw), EVENT), F.array().cast(EVENT))

    def clean(e: Column) -> Column:
        kind = F.lower(F.trim(F.coalesce(e["category"], F.lit("other"))))
        return F.struct(
            F.trim(e["title"]).alias("title"), F.trim(e["date_iso"]).alias("date_iso"),
            F.nullif(e["time_24h_or_null"], F.lit("")).alias("time_24h_or_null"), F.nullif(e["location_or_null"], F.lit("")).alias("location_or_null"),
            F.trim(F.coalesce(e["description"], F.lit(""))).alias("description"),
            F.when(kind.isin(*CATEGORIES), kind).otherwise("other").alias("category"),
        )

    ok = lambda e: F.try_to_date(F.trim(e["date_iso"]), "yyyy-M-d").isNotNull() & (F.length(F.trim(F.coalesce(e["title"], F.lit("")))) > 0)
    return F.transform(F.filter(items, ok), clean)


def bullets(text: Column, wanted: int = 3) -> Column:
    """Non-blank lines without their marks; null unless there are exactly so many."""
    out = F.filter(F.transform(lines(text), lambda x: F.trim(x)), lambda x: x != "")
    out = F.transform(out, lambda x: F.when(F.left(x, F.lit(1)).isin("-", "*", "•"), F.trim(F.substring(x, 2, 1 << 20))).otherwise(x))
    return F.when(F.size(out) == wanted, out)


def keyword_hits(text: Column, words: tuple[str, ...] = SOCIAL, most: int = 8) -> Column:
    t = F.lower(F.left(text, F.lit(12_000)))
    return F.slice(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w)), 1, most)


def overlay_defaults(defaults: Column, own: Column) -> Column:
    """Map with the own values over the defaults."""
    keys = F.coalesce(F.map_keys(own), F.array().cast("array<string>"))
    return F.map_concat(F.map_filter(defaults, lambda k, v: ~F.array_contains(keys, k)), F.coalesce(own, F.map_filter(defaults, lambda k, v: F.lit(False))))


def first_int(*values: Column) -> Column:
    return F.coalesce(*[v.try_cast("int") for v in values])


def step_timeout(timeout_ms: Column, timeout: Column, default: int = 15_000) -> Column:
    """Milliseconds within 1,000 and 120,000; the default where nothing readable is given."""
    given = F.coalesce(timeout_ms, timeout).try_cast("int")
    return F.when(given.isNull(), default).otherwise(F.least(F.greatest(given, F.lit(1000)), F.lit(120_000)))


def capped_union(known: Column, item: Column, most: int = 12) -> Column:
    return F.slice(F.array_union(F.coalesce(known, F.array().cast("array<string>")), F.array(item)), 1, most)


def clamped_int(value: Column, drop_bad: bool = False) -> Column:
    """The two readings of a counter: what is no number is dropped (null), or is 0 and never below."""
    n = value.try_cast("int")
    return n if drop_bad else F.greatest(F.lit(0), F.coalesce(n, F.lit(0)))


def last_terminal_only(actions: Column, terminal: tuple[str, ...] = ("download", "image", "html")) -> Column:
    """Steps without all but the last of the terminal ones."""
    n = F.size(actions)
    last = n - F.array_position(F.transform(F.reverse(actions), lambda a: a.isin(*terminal)), F.lit(True)) + 1
    return F.filter(actions, lambda a, i: ~a.isin(*terminal) | (i + 1 == last))
