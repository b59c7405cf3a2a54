"""Dates in urls, labels and file names: Column in, Column out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names and their abbreviations.
MONTHS = "january february march april may june july august september october november december".split()
MONTH_NUMBERS = {m: i for i, m in enumerate(MONTHS, 1)} | {m[:3]: i for i, m in enumerate(MONTHS, 1)} | {"sept": 9}

#: The shapes of dates. Groups are numbered in the order of the text.
ISO = r"(\d{4})-(\d{2})-(\d{2})"
YMD8 = r"(?<!\d)(\d{4})(\d{2})(\d{2})(?!\d)"
DMY8 = r"(?<!\d)(\d{2})(\d{2})(\d{4})(?!\d)"
DMY6 = r"(?<!\d)(\d{2})(\d{2})(\d{2})(?!\d)"
DOTTED = r"(?<!\d)(\d{2})\.(\d{2})\.(\d{2})(?!\d)"
SLUG = r"(?i)(\d{1,2})(?:st|nd|rd|th)?[_-]([a-z]+)[_-](\d{4})"
LOOSE_YMD = r"(?<!\d)(20\d{2})[-_/](0?[1-9]|1[0-2])[-_/](0?[1-9]|[12]\d|3[01])(?!\d)"
LOOSE_DMY = r"(?<!\d)(0?[1-9]|[12]\d|3[01])[-_/](0?[1-9]|1[0-2])[-_/]((?:19|20)\d{2})(?!\d)"
CENTURY_DMY8 = r"(?<!\d)(\d{2})(\d{2})((?:19|20)\d{2})(?!\d)"

#: The shapes of dates that may be said in part, in the order in which they are tried.
PART_ISO = r"\b(20\d{2})-(0[1-9]|1[0-2])-([0-2]\d|3[01])\b"
PART_FOLDERS = r"/(20\d{2})/(0[1-9]|1[0-2])/([0-2]\d|3[01])/"
PART_SLUG = r"\b(\d{1,2})(?:st|nd|rd|th)?[-_]([a-z]{3,9})[-_](20\d{2})\b"
PART_WORDS = r"\b(\d{1,2})(?:st|nd|rd|th)?\s+([a-z]{3,9})\s+(20\d{2})\b"
PART_SIX = r"(?:^|/)(\d{2})(\d{2})(\d{2})\.pdf\b"
PART_YMD8 = r"(?<!\d)(20\d{2})(0[1-9]|1[0-2])([0-2]\d|3[01])(?!\d)"
PART_DMY8 = r"(?<!\d)([0-2]\d|3[01])(0[1-9]|1[0-2])(20[2-3]\d)(?!\d)"
PART_FOLDER = r"/(20\d{2})/(0[1-9]|1[0-2])/"
PART_MONTH = r"\b(" + "|".join([*MONTHS, *[m[:3] for m in MONTHS]]) + r")\s+(20\d{2})\b"
PART_YEAR = r"\b(20\d{2})\b"

#: Fixed value: days for which a date still counts as fresh.
GRACE_DAYS = 8


def valid_date(y: Column, m: Column, d: Column) -> Column:
    """Null instead of an error for days that don't exist. The cast reads the parts without a formatter, whose failures are dear."""
    return F.concat(y.cast("string"), F.lit("-"), m.cast("string"), F.lit("-"), d.cast("string")).try_cast("date")


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def _first(text: Column, pattern: str, order: str, sep: int = 0) -> Column:
    """The first hit only; if it's no date, none. ``order`` has a letter per digit, ``sep`` the letters between parts: one match, then cuts."""
    hit = _group(text, pattern, 0)

    def cut(letter: str) -> Column:
        at = order.index(letter)
        parts_before = len({c for c in order[:at]})
        return F.substring(hit, at + 1 + parts_before * sep, order.count(letter))

    year = cut("y")
    return valid_date(F.concat(F.lit("20"), year) if order.count("y") == 2 else year, cut("m"), cut("d"))


def _any(text: Column, pattern: str, y: int, m: int, d: int, two_digit: bool = False) -> Column:
    """The first hit that is a date. Two-digit years are 1969 to 2068."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def parse(x: Column) -> Column:
        year = F.regexp_extract(x, pattern, y)
        if two_digit:
            year = F.concat(F.when(year.cast("int") >= 69, F.lit("19")).otherwise(F.lit("20")), year)
        return valid_date(year, F.regexp_extract(x, pattern, m), F.regexp_extract(x, pattern, d))

    return F.get(F.filter(F.transform(hits, parse), lambda x: x.isNotNull()), F.lit(0))


def date_in_text(text: Column) -> Column:
    """Strict order: dashed, eight digits (year first, then day first), six digits, dotted year first; the first hit of each."""
    return F.coalesce(
        _first(text, ISO, "yyyymmdd", 1), _first(text, YMD8, "yyyymmdd"), _first(text, DMY8, "ddmmyyyy"), _first(text, DMY6, "ddmmyy"), _first(text, DOTTED, "yymmdd", 1)
    )


def month_number(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MONTH_NUMBERS.items() for x in kv])
    return F.try_element_at(table, F.lower(name))


def date_in_slug(text: Column) -> Column:
    """Day, month name and year, as in ``5th-april-2026`` or ``5_april_2026``."""
    hit = _group(text, SLUG, 0)
    return valid_date(F.right(hit, F.lit(4)), month_number(F.regexp_extract(hit, SLUG, 2)), F.regexp_extract(hit, r"^\d+", 0))


def bulletin_date(text: Column) -> Column:
    """``date_in_text``, else any hit of the loose shapes."""
    return F.coalesce(
        date_in_text(text), _any(text, ISO, 1, 2, 3), _any(text, LOOSE_DMY, 3, 2, 1),
        _any(text, DMY6, 3, 2, 1, True), _any(text, DMY8, 3, 2, 1),
    )


def url_date(text: Column) -> Column:
    """The order of the run log: year first, day first, six digits, eight digits; any hit of each."""
    return F.coalesce(
        _any(text, LOOSE_YMD, 1, 2, 3), _any(text, LOOSE_DMY, 3, 2, 1), _any(text, DMY6, 3, 2, 1, True), _any(text, CENTURY_DMY8, 3, 2, 1)
    )


def candidate_date(text: Column) -> Column:
    return F.coalesce(date_in_text(text), date_in_slug(text))


def partial_date(text: Column) -> Column:
    """``struct<year, month, day>`` with 0 for what isn't said; null without a year.

    The shapes are tried inside a lambda: as plain expressions their generated code would be too large to compile together with others.
    """
    return F.get(F.transform(F.array(text), _partial), F.lit(0))


def _partial(text: Column) -> Column:
    t = F.lower(F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text))
    word = F.create_map(*[F.lit(x) for m, i in MONTH_NUMBERS.items() if len(m) == 3 for x in (m, i)])

    def num(p: str, i: int) -> Column:
        return F.nullif(F.regexp_extract(t, p, i), F.lit("")).cast("int")

    def ymd(y: Column, m: Column, d: Column, ok: Column) -> Column:
        return F.when(ok, F.struct(y.alias("year"), m.alias("month"), d.alias("day")))

    def numeric(p: str, y: int, m: int, d: int) -> Column:
        return ymd(num(p, y), num(p, m), num(p, d), t.rlike(p))

    def named(p: str) -> Column:
        m = F.try_element_at(word, F.left(F.regexp_extract(t, p, 2), F.lit(3)))
        return ymd(num(p, 3), m, num(p, 1), t.rlike(p) & m.isNotNull())

    return F.coalesce(
        numeric(PART_ISO, 1, 2, 3), numeric(PART_FOLDERS, 1, 2, 3), named(PART_SLUG), named(PART_WORDS),
        ymd(num(PART_SIX, 3) + 2000, num(PART_SIX, 2), num(PART_SIX, 1), t.rlike(PART_SIX) & num(PART_SIX, 2).between(1, 12) & num(PART_SIX, 1).between(1, 31)),
        numeric(PART_YMD8, 1, 2, 3), numeric(PART_DMY8, 3, 2, 1),
        ymd(num(PART_FOLDER, 1), num(PART_FOLDER, 2), F.lit(0), t.rlike(PART_FOLDER)),
        ymd(num(PART_MONTH, 2), F.try_element_at(word, F.left(F.regexp_extract(t, PART_MONTH, 1), F.lit(3))), F.lit(0), t.rlike(PART_MONTH)),
        ymd(num(PART_YEAR, 1), F.lit(0), F.lit(0), t.rlike(PART_YEAR)),
    )


def date_score(parts: Column) -> Column:
    """Sortable number of a partial date; 0 for none."""
    return F.coalesce(parts["year"] * 10000 + parts["month"] * 100 + parts["day"], F.lit(0))


def dotted(d: Column) -> Column:
    return F.date_format(d, "yy.MM.dd")


def dotted_date(text: Column) -> Column:
    return _first(text, DOTTED, "yymmdd", 1)


def target_sunday(d: Column) -> Column:
    """The day itself if a Sunday, else the Sunday before."""
    return F.next_day(F.date_sub(d, 7), "SU")


def coming_sunday(d: Column) -> Column:
    """The day itself if a Sunday, else the Sunday after (as the browser side counts)."""
    return F.next_day(F.date_sub(d, 1), "SU")


def next_sunday(d: Column) -> Column:
    """Strictly after the day."""
    return F.next_day(d, "SU")


def week_range(d: Column) -> Column:
    monday = F.date_trunc("WEEK", d).cast("date")
    return F.struct(monday.alias("first"), F.date_add(monday, 6).alias("last"))


def in_week(d: Column, target: Column) -> Column:
    """Within the seven days that end with the target, both included."""
    return d.between(F.date_sub(target, 6), target)


def freshness(d: Column, target: Column) -> Column:
    """``struct<status, reason, date, days>`` of an edition's date: fresh within the week or the days of grace, stale beyond, unknown without a date."""
    days = F.datediff(d, target)
    reason = (
        F.when(d.isNull(), "no_date_in_url").when(in_week(d, target), "in_bulletin_week").when(F.abs(days) <= GRACE_DAYS, "within_grace_days")
        .when(days > 0, "date_ahead_of_target").otherwise("date_behind_of_target")
    )
    status = F.when(d.isNull(), "unknown").when(in_week(d, target) | (F.abs(days) <= GRACE_DAYS), "fresh").otherwise("stale")
    return F.struct(status.alias("status"), reason.alias("reason"), d.alias("date"), days.alias("days"))


def date_variants(target: Column) -> Column:
    """The seven days up to the target, four spellings each, day by day."""
    days = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.date_sub(target, i))
    return F.flatten(F.transform(days, lambda d: F.array(*[F.date_format(d, f) for f in ("ddMMyy", "ddMMyyyy", "yyyy-MM-dd", "yyyyMMdd")])))


def link_tokens(target: Column) -> Column:
    """What a link to the target's edition contains: ten spellings, with the bare month."""
    f = lambda p: F.lower(F.date_format(target, p))
    return F.array(*[f(p) for p in ("ddMMyy", "ddMMyyyy", "yyyy-MM-dd", "yyyyMMdd", "d-M-yy", "d-MMMM-yyyy", "dMMMMyyyy", "dMMMyyyy", "MMMM", "MMM")])


def page_tokens(target: Column) -> Column:
    """The eleven spellings of the page scan, without the bare month and with dotted labels."""
    f = lambda p: F.lower(F.date_format(target, p))
    spelt = [f(p) for p in ("ddMMyy", "ddMMyyyy", "yyyy-MM-dd", "yyyyMMdd", "d-M-yy", "d-MM-yy", "d-MMMM-yyyy", "dMMMMyyyy", "dMMMyyyy")]
    return F.array(*spelt, F.concat(dotted(target), F.lit(".pdf")), dotted(target))


def easter(year: Column) -> Column:
    """Easter Sunday by the anonymous Gregorian computus; integer columns only."""
    a, b, c = year % 19, F.floor(year / 100), year % 100
    d, e = F.floor(b / 4), b % 4
    g = F.floor((b - F.floor((b + 8) / 25) + 1) / 3)
    h = (19 * a + b - d - g + 15) % 30
    k = (32 + 2 * e + 2 * F.floor(c / 4) - h - c % 4) % 7
    m = F.floor((a + 11 * h + 22 * k) / 451)
    n = h + k - 7 * m + 114
    return F.make_date(year.cast("int"), F.floor(n / 31).cast("int"), (n % 31 + 1).cast("int"))


def ordinal(n: Column) -> Column:
    end = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def day_month_year(text: Column) -> Column:
    """Dashed year-first text turned to day first by its shape; other text unchanged."""
    return F.regexp_replace(text, r"^(\d{4})-(\d{2})-(\d{2})$", "$3-$2-$1")


def day_month_year_checked(text: Column) -> Column:
    """The same for days that exist only."""
    d = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(d.isNotNull(), F.date_format(d, "dd-MM-yyyy")).otherwise(text)


def long_date(d: Column) -> Column:
    return F.date_format(d, "d MMMM yyyy")


def duration(seconds: Column) -> Column:
    m, s = F.floor(seconds / 60).cast("int"), (seconds % 60).cast("int")

    def unit(n: Column, word: str) -> Column:
        return F.concat(n.cast("string"), F.lit(" " + word), F.when(n == 1, "").otherwise("s"))

    return F.when(m > 0, F.concat_ws(" ", unit(m, "minute"), F.when(s > 0, unit(s, "second")))).otherwise(unit(s, "second"))


def last_success_day(text: Column) -> Column:
    t = F.nullif(F.trim(text), F.lit(""))
    return F.left(t, F.lit(10))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
