"""Exact semantics that built-in functions lack, as Arrow UDFs over whole batches."""

from __future__ import annotations

import difflib
import html
import re
import unicodedata
from collections.abc import Callable
from datetime import date, timedelta
from html.parser import HTMLParser
from urllib.parse import quote, unquote, urljoin, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.functions.dates import MONTH_NUMBERS, MONTHS
from almanac.functions.urls import next_newsletter

_SPACE = re.compile(r"\s+")


@F.pandas_udf(T.StringType())
def fold_marks(s: pd.Series) -> pd.Series:
    """Case folded, compatibility decomposed, combining marks dropped."""
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(c))
    return s.map(fold, na_action="ignore")


@F.pandas_udf(T.StringType())
def unescape4(s: pd.Series) -> pd.Series:
    """Character references undone up to four times."""

    def one(t: str) -> str:
        for _ in range(4):
            if (u := html.unescape(t)) == t:
                break
            t = u
        return t

    return s.map(one, na_action="ignore")


class _Links(HTMLParser):
    ATTR = {"a": "href", "iframe": "src", "embed": "src", "object": "data"}

    def __init__(self):
        super().__init__()
        self.found: list[list] = []
        self.inside: list[list] = []

    def handle_starttag(self, tag, attrs):
        attr = self.ATTR.get(tag)
        value = dict(attrs).get(attr) if attr else None
        if value:
            self.found.append([value, "", tag])
            if tag == "a":
                self.inside.append(self.found[-1])

    def handle_endtag(self, tag):
        if tag == "a" and self.inside:
            self.inside.pop()

    def handle_data(self, data):
        for x in self.inside:
            x[1] += data


LINK_TYPE = T.ArrayType(
    T.StructType([T.StructField("idx", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("href", "text", "tag")]])
)


@F.pandas_udf(LINK_TYPE)
def html_links(pages: pd.Series, base: pd.Series) -> pd.Series:
    """Links, frames and embedded objects in order, resolved against the page's address."""

    def one(page: str | None, url: str | None) -> list[dict]:
        if not page:
            return []
        p = _Links()
        p.feed(page)
        return [
            {"idx": i, "href": urljoin(url or "", h.strip()), "text": _SPACE.sub(" ", t).strip()[:240], "tag": tag} for i, (h, t, tag) in enumerate(p.found)
        ]

    return pd.Series([one(a, b) for a, b in zip(pages, base, strict=True)], dtype=object)


_LINES = T.ArrayType(T.StringType())
DIFF_TYPE = T.StructType(
    [T.StructField("added", _LINES), T.StructField("removed", _LINES), T.StructField("kept", T.IntegerType()), T.StructField("note", T.StringType())]
)


def compared_lines(text: str | None, least: int = 20) -> list[str]:
    out = (_SPACE.sub(" ", x.strip().lower()) for x in (text or "").splitlines())
    return [x for x in out if len(x) >= least]


def line_diff(new: str | None, old: str | None, most: int = 30) -> dict:
    """Added, removed and kept lines of two editions.

    Lines that themselves begin with two dashes (removed) or pluses (added) are taken for headers of the
    diff and lost; of more than ``most`` lines on a side the longest stay.
    """
    a, b = compared_lines(old), compared_lines(new)
    match = difflib.SequenceMatcher(a=a, b=b)
    added, removed = [], []
    kept = 0
    for op, i1, i2, j1, j2 in match.get_opcodes():
        if op == "equal":
            kept += i2 - i1
        else:
            removed += [x for x in a[i1:i2] if not x.startswith("--")]
            added += [x for x in b[j1:j2] if not x.startswith("++")]
    note = None
    if max(len(added), len(removed)) > most:
        note = f"truncated_to_{most}_lines_per_side"
        added, removed = (sorted(x, key=len, reverse=True)[:most] if len(x) > most else x for x in (added, removed))
    return {"added": added, "removed": removed, "kept": kept, "note": note}


@F.pandas_udf(DIFF_TYPE)
def diff_lines(new: pd.Series, old: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([line_diff(a, b) for a, b in zip(new, old, strict=True)], columns=["added", "removed", "kept", "note"]).astype({"kept": "int32"})


def _day(y: str | int, m: str | int | None, d: str | int) -> date | None:
    try:
        return date(int(y), int(m), int(d))
    except (ValueError, TypeError):
        return None


class DateShape:
    """A spelling of a date in a path: how to find, read and write it."""

    def __init__(self, pattern: str, read: Callable[[re.Match], date | None], write: Callable[[date, re.Match], str], folders: bool = False, any_year: bool = False):
        self.re, self.read, self.write, self.folders, self.any_year = re.compile(pattern, re.I), read, write, folders, any_year

    def moved(self, path: str, target: date, days: int) -> str | None:
        """All dates near the target rewritten; null if none is."""
        first = next((d for m in self.re.finditer(path) if (d := self.read(m))), None) if self.folders else None
        near = lambda d: d is not None and (self.any_year or abs((d - target).days) < days)
        hit = False

        def sub(m: re.Match) -> str:
            nonlocal hit
            if near(self.read(m)):
                hit = True
                return self.write(target, m)
            return m.group()

        out = self.re.sub(sub, path)
        if hit and first:
            out = out.replace(f"/{first:%Y/%m}/", f"/{target:%Y/%m}/")
        return out if hit and (out != path or self.folders) else None


def _slug_text(t: date, m: re.Match) -> str:
    sep, word = m.group(2), m.group(3)
    month = MONTHS[t.month - 1] if sep == "_" or word.islower() else MONTHS[t.month - 1].capitalize()
    return f"{t.day}{sep}{month}{m.group(4)}{t.year}" if sep == m.group(4) else f"{t.day}{sep}{month}{sep}{t.year}"


#: The order in which the spellings are tried.
SHAPES = (
    DateShape(r"(?<!\d)(\d{2})(\d{2})(\d{4})(?!\d)", lambda m: _day(m[3], m[2], m[1]), lambda t, m: f"{t:%d%m%Y}"),
    DateShape(r"(?<!\d)(\d{2})(\d{2})(\d{2})(?!\d)", lambda m: _day(2000 + int(m[3]), m[2], m[1]), lambda t, m: f"{t:%d%m%y}"),
    DateShape(r"(\d{4})-(\d{2})-(\d{2})", lambda m: _day(m[1], m[2], m[3]), lambda t, m: f"{t:%Y-%m-%d}", folders=True),
    DateShape(r"(?<!\d)(\d{1,2})-(\d{1,2})-(\d{2})(?!\d)", lambda m: _day(2000 + int(m[3]), m[2], m[1]), lambda t, m: f"{t.day}-{t.month}-{t:%y}"),
    DateShape(r"(\d{1,2})(?:st|nd|rd|th)?([_-])([a-z]+)([_-])(\d{4})", lambda m: _day(m[5], MONTH_NUMBERS.get(m[3].lower()), m[1]), _slug_text, folders=True, any_year=True),
    DateShape(r"\[(\d{4})-(\d{1,2})-(\d{1,2})\]", lambda m: _day(m[1], m[2], m[3]), lambda t, m: f"[{t.year}-{t.month}-{t.day}]"),
)


def moved_url(url: str | None, target: date | None, days: int = 365) -> str | None:
    """The url with its date moved to the target, by the first spelling that changes it; else a dated post's archive a week on, else its month folder."""
    if url is None or target is None:
        return url
    parts = urlparse(url)
    path = unquote(parts.path)
    for shape in SHAPES:
        if (new := shape.moved(path, target, days)) is not None:
            return parts._replace(path=new).geturl()
    post = re.search(r"/(\d{4})/(\d{2})/(\d{2})/[^/]+/", path)
    if post and (d := _day(post[1], post[2], post[3])) and abs((d - target).days) < days:
        return parts._replace(path=f"{path[: post.start()]}/{d + timedelta(days=7):%Y/%m/%d}/").geturl()
    new = re.sub(r"/(\d{4})/(\d{2})/", lambda m: f"/{target:%Y/%m}/" if abs(int(m[1]) - target.year) <= 1 else m.group(), path)
    return url if new == path else parts._replace(path=new).geturl()


def other_spellings(url: str | None, target: date | None, most: int = 10) -> list[str]:
    """The url with its date, if within two weeks of the target, spelt in every other way."""
    if url is None or target is None:
        return []
    parts = urlparse(url)
    path = unquote(parts.path)
    token = next((m.group() for s in SHAPES for m in s.re.finditer(path) if (d := s.read(m)) and abs((d - target).days) < 14), None)
    if token is None:
        return []
    t = target
    spelt = [f"{t:%d%m%y}", f"{t:%d%m%Y}", f"{t:%Y-%m-%d}", f"{t.day}-{t.month}-{t:%y}", f"{t:%d}-{MONTHS[t.month - 1].capitalize()}-{t.year}", f"[{t.year}-{t.month}-{t.day}]"]
    new = [parts._replace(path=path.replace(token, x, 1)).geturl() for x in spelt if x != token]
    return [x for x in dict.fromkeys(new) if x != url][:most]


@F.pandas_udf(T.StringType())
def rewrite_date_url(url: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([moved_url(u, t) for u, t in zip(url, target, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def url_variants(url: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([other_spellings(u, t) for u, t in zip(url, target, strict=True)], dtype=object)


_DOCX_STEM = re.compile(r"(?i)/onewebmedia/newsletter\s+\d{1,2}-\d{1,2}-\d{2}")
#: How the file's name may end.
DOCX_ENDS = (".docx", " .docx", " -.docx")


def docx_spellings(url: str | None, target: date | None) -> list[str]:
    """The url moved to the target, then its file's name with every ending, each once."""
    if not url or target is None:
        return []
    moved = moved_url(url, target)
    parts = urlparse(moved)
    stem = _DOCX_STEM.search(unquote(parts.path))
    if stem:
        more = [parts._replace(path=quote(stem.group() + end)).geturl() for end in DOCX_ENDS]
    elif moved.lower().endswith(".docx"):
        more = [moved[: -len(DOCX_ENDS[0])] + end for end in DOCX_ENDS[1:]]
    else:
        more = []
    return list(dict.fromkeys([moved.strip(), *more]))


@F.pandas_udf(T.ArrayType(T.StringType()))
def docx_variants(url: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([docx_spellings(u, t) for u, t in zip(url, target, strict=True)], dtype=object)


def calculated_url(pattern: Column, url: Column, target: Column) -> Column:
    """This week's address of an entry by its pattern: links and static files stay, numbered ones count on, all others are moved to the target's date."""
    return F.when(pattern.isin("html_link", "F"), url).when(pattern == "H", F.coalesce(next_newsletter(url, target), url)).otherwise(rewrite_date_url(url, target))
