"""Text: normal forms, lines, extraction, snippets, escapes. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and the plain letters they fold to.
MARKED = "àáâãäåāăąçćčďèéêëēęěìíîïīłñńňòóôõöøōřśšşťùúûüūůýÿźżž"
PLAIN = "a" * 9 + "ccc" + "d" + "e" * 7 + "i" * 5 + "l" + "nnn" + "o" * 7 + "r" + "sss" + "t" + "u" * 6 + "yy" + "zzz"
#: Shapes of addresses, links and phone numbers.
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
LINK = r"(?:https?://|www\.)[^\s<>\"]+"
PHONE = r"(?:\+353|0)[\s-]?\d{1,3}[\s-]?\d{3}[\s-]?\d{3,4}"
#: What the words of a link say about it, with their points.
STRONG = r"(?i)\b(?:this week|current|latest)\b.{0,40}\b(?:bulletin|newsletter)\b|\b(?:bulletin|newsletter)\b.{0,40}\b(?:this week|current|latest)\b"
GOOD = r"(?i)\b(?:bulletin|newsletter|weekly)\b"
POOR = r"(?i)\b(?:gift ?aid|donat\w*|privacy|gdpr|safeguarding|standing ?order|application|registration|volunteer)\b"

assert len(MARKED) == len(PLAIN)


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


def safe_name(prefix: Column, suffix: str) -> Column:
    return F.concat(F.regexp_replace(F.lower(prefix), "[^a-z0-9_-]", "_"), F.lit(suffix))


def folded(c: Column) -> Column:
    """Lower case without the marks of the letters listed in ``MARKED``; exact folding is ``pyudf.fold_marks``."""
    return F.translate(F.lower(c), MARKED, PLAIN)


def without_brackets(c: Column, depth: int = 3) -> Column:
    """Text outside round brackets, nested up to ``depth``."""
    for _ in range(depth):
        c = F.regexp_replace(c, r"\([^()]*\)", "")
    return c


def name_text(c: Column) -> Column:
    t = F.regexp_replace(F.replace(folded(c), F.lit("&"), F.lit(" and ")), "[’'`]", "")
    return squeezed(F.regexp_replace(t, "[^a-z0-9]+", " "))


def name_forms(c: Column) -> Column:
    """The distinct forms of a name: with and without brackets, saint short and long."""
    base = F.array(name_text(c), name_text(without_brackets(c)))
    more = F.flatten(F.transform(base, lambda f: F.array(f, F.regexp_replace(f, r"\bst\b", "saint"), F.regexp_replace(f, r"\bsaint\b", "st"))))
    return F.array_distinct(F.filter(more, lambda f: F.length(f) > 0))


def slug(c: Column, most: int = 40) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(folded(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(most))


def display_name(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def lines(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), r"\r\n|\n|\r")


def compared_lines(c: Column, least: int = 20) -> Column:
    """Lines as a comparison sees them: lower case, blanks collapsed, short ones left out."""
    return F.filter(F.transform(lines(c), lambda x: squeezed(F.lower(x))), lambda x: F.length(x) >= least)


def html_text(html: Column, panel: str | None = None) -> Column:
    """Tags become line ends; blank lines go. With ``panel`` only what its first group holds."""
    inner = F.regexp_extract(html, panel, 1) if panel else html
    cleaned = F.filter(F.transform(F.split(F.regexp_replace(inner, "<[^>]+>", "\n"), "\n"), squeezed), lambda x: F.length(x) > 0)
    return F.array_join(cleaned, "\n")


def found_names(html: Column, pattern: str) -> Column:
    """All first groups, each normal form once, first spelling kept."""
    names = F.filter(F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    keys = F.transform(names, norm_key)
    return F.filter(names, lambda x, i: F.array_position(keys, norm_key(x)) == i + 1)


def mails(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(MAIL), F.lit(0)))


def links(c: Column) -> Column:
    """Addresses without trailing punctuation or an unbalanced closing bracket."""
    raw = F.transform(F.regexp_extract_all(c, F.lit(LINK), F.lit(0)), lambda x: F.regexp_replace(x, r"[.,;:!?]+$", ""))
    return F.array_distinct(F.transform(raw, lambda x: F.when(x.contains("("), x).otherwise(F.regexp_replace(x, r"\)+$", ""))))


def phones(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(PHONE), F.lit(0)))


def linkified(c: Column) -> Column:
    """Text as HTML with its mail addresses, web addresses and phone numbers as links.

    Trailing punctuation and an unbalanced closing bracket are no part of an address. Phone numbers get the country's prefix; what is
    inside a link already is left alone.
    """
    out = F.replace(xml_escape(c), F.lit("'"), F.lit("&#x27;"))
    out = F.regexp_replace(out, r"\b" + MAIL + r"\b", '<a href="mailto:$0">$0</a>')
    rest = r"(?:\([^\s<>\"()]*\)|[^\s<>\"()])*(?<![.,;:!?])(?![^<]*</a>)"
    out = F.regexp_replace(out, r"(?i)(?<!@)\bhttps?://" + rest, '<a href="$0">$0</a>')
    out = F.regexp_replace(out, r"(?i)(?<![@/\w.])www\." + rest, '<a href="https://$0">$0</a>')
    outside = r"(?!\w)(?![^<]*</a>)"
    out = F.regexp_replace(out, r"(?<!\w)0(74|87)[\s-]*(\d{3})[\s-]*(\d{4})" + outside, '<a href="tel:+353$1$2$3">$0</a>')
    out = F.regexp_replace(out, r"(?<!\w)0(28)[\s-]*(\d{3})[\s-]*(\d{4,5})" + outside, '<a href="tel:+353$1$2$3">$0</a>')
    return F.regexp_replace(out, r"(?<!\w)\+353[\s-]*(\d{2})[\s-]*(\d{3})[\s-]*(\d{4})" + outside, '<a href="tel:+353$1$2$3">$0</a>')


def _inline(c: Column) -> Column:
    """A line as HTML: links, then strong and emphasised words."""
    out = linkified(c)
    for pattern, tag in ((r"\*\*(.+?)\*\*", "strong"), (r"__(.+?)__", "strong"), (r"(?<![*\w])\*([^*\n]+)\*(?![*\w])", "em")):
        out = F.regexp_replace(out, pattern, f"<{tag}>$1</{tag}>")
    return out


def rendered(c: Column) -> Column:
    """Lightly marked-up text as HTML: rules, headings to the fourth level, paragraphs, and runs of table rows as one table."""

    def one(line: Column) -> Column:
        t, kind = F.trim(line), line_kind(line)
        marks = F.length(F.regexp_extract(t, "^(#{1,6})", 1))
        level = F.concat(F.lit("h"), F.least(marks, F.lit(4)).cast("string"))
        cells = F.transform(F.split(F.substring(t, F.lit(2), F.length(t) - 2), r"\|"), lambda x: F.concat(F.lit("<td>"), _inline(F.trim(x)), F.lit("</td>")))
        return (
            F.when(kind == "table", F.concat(F.lit("<tr>"), F.array_join(cells, ""), F.lit("</tr>"))).when(kind == "rule", "<hr>")
            .when(kind == "heading", F.concat(F.lit("<"), level, F.lit(">"), _inline(F.trim(F.regexp_replace(t, "^#{1,6}", ""))), F.lit("</"), level, F.lit(">")))
            .otherwise(F.concat(F.lit("<p>"), _inline(t), F.lit("</p>")))
        )

    html = F.array_join(F.transform(F.filter(lines(c), lambda x: F.trim(x) != ""), one), "\n")
    return F.regexp_replace(F.regexp_replace(html, r"(?<=</tr>)\n(?=<tr>)", ""), r"<tr>.*</tr>", "<table>$0</table>")


def page_slug(c: Column) -> Column:
    """Slug of any length."""
    return slug(c, 1 << 30)


def plain_slug(c: Column, default: str) -> Column:
    """Slug of unfolded letters: what isn't a plain letter or digit separates; ``default`` where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit(default)).otherwise(s)


def line_kind(line: Column) -> Column:
    """Kind of a line of lightly marked-up text."""
    return (
        F.when(F.trim(line) == "", "blank").when(line.rlike(r"^\s*\|.*\|\s*$"), "table").when(line.rlike(r"^\s*(?:-{3,}|\*{3,}|_{3,})\s*$"), "rule")
        .when(line.rlike(r"^#{1,6}\s"), "heading").otherwise("paragraph")
    )


def snippet(c: Column, query: Column, around: int = 75, else_first: int = 150) -> Column:
    """Text round the first hit of the query, case aside; the beginning without a hit."""
    at = F.instr(F.lower(c), F.lower(query))
    first = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, F.substring(c, first, at + F.length(query) + around - first)).otherwise(F.left(c, F.lit(else_first)))


def has_text(c: Column, query: str) -> Column:
    """Search condition; an empty query finds nothing."""
    q = query.strip().lower()
    return F.lower(c).contains(q) if q else F.lit(False)


def undated_word(c: Column) -> Column:
    """A link's word that stays the same every week: a known one, else the first of three letters that is no month or number."""
    t = F.regexp_replace(c, r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\b|\b\d{1,4}(?:st|nd|rd|th)?\b", " ")
    known = F.regexp_extract(F.lower(c), "bulletin|newsletter|download|weekly|parish", 0)
    order = [F.when(F.lower(c).contains(w), F.lit(w.title())) for w in ("bulletin", "newsletter", "download", "weekly", "parish")]
    words = F.filter(F.split(t, "[^a-zA-Z]+"), lambda w: F.length(w) >= 3)
    return F.when(known != "", F.coalesce(*order)).otherwise(F.coalesce(F.get(words, F.lit(0)), F.lit("")))


def phrase_points(url: Column, label: Column) -> Column:
    """Points for what a link says: 80 for the current edition or 20 for an edition, −120 for other documents, 8 for a PDF."""
    blob = F.trim(F.concat_ws(" ", url, label))
    bonus = F.when(blob.rlike(STRONG), 80).when(blob.rlike(GOOD), 20).otherwise(0) + F.when(blob.rlike(r"(?i)\.pdf(?:\?|$)"), 8).otherwise(0)
    return F.struct(bonus.alias("bonus"), F.when(blob.rlike(POOR), 120).otherwise(0).alias("penalty"))


def ics_escape(c: Column) -> Column:
    """The order matters: backslash first, carriage returns dropped last."""
    out = F.coalesce(c, F.lit(""))
    for a, b in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n"), ("\r", "")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def selector_escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
