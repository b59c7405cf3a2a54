"""Template residue and error-page text: values that are leftovers instead of content."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.session import norm_key, written

NUMBER = "0"
ADDRESS = "addr"

_NAME = r"[a-z][a-z_.]{0,40}"
#: Unfilled placeholders, on masked lower-case text.
PLACEHOLDERS = (
    r"\{\{[^{}]{0,80}\}\}",
    r"\{%[^%]{0,80}%\}",
    r"<%=?[^%]{0,80}%>",
    r"<<[^<>]{1,60}>>",
    r"\[\[[^\[\]]{1,60}\]\]",
    r"@@[a-z0_]{1,60}@@",
    r"[$#]\{[^{}]{0,80}\}",
    r"\$" + _NAME + r"\$",
    r"(?:^|[^a-z0])__" + _NAME + r"__|[a-z0]___[a-z][a-z_.]{0,40}?__(?:[^a-z0_]|$)",
    r"%\(" + _NAME + r"\)[sdr]",
    r"(?:^|[^0-9a-z%])%[sd](?:[^a-z0]|$)|[a-z0]%[sd](?:[^a-z0]|$)",
    r"(?<![\[a-z0='\"])\{" + _NAME + r"\}",
    r"(?<![a-z0])\[" + _NAME + r"\]",
    r"[a-z0]_\[" + _NAME + r"\]|_\{" + _NAME + r"\}",
    r"<(?!(?:html|head|body|title|h[0-9]|p|br|div|span|a|noscript|script|!doctype)\b)" + _NAME + r">",
    r"\[object object\]",
    r"(?<![a-z])(?:yyyy-?mm-?dd|dd-?mm-?yy(?:yy)?)(?![a-z])",
    r"(?<![a-z])(?:changeme|change_me|fixme)(?![a-z])",
    r"(?<![a-z])your-(?:file|type|text|name|title|url|message)-here",
    r"(?:^|[/\\])path[/\\]to[/\\]",
    r"^(?:undefined|nan|none|null|todo|tbd|tba)$",
    r"(?:^|: )todo\b",
    r"[/\\_](?:undefined|nan|none|null|todo|tbd)\.[a-z0]{1,5}$",
)
#: Dummy and filler text.
FILLERS = (
    r"^x{2,}$|^[x ]{3,}$",
    r"lorem[ -]?ipsum",
    r"\bfoo bar\b",
    r"\bdummy (?:content|text)\b",
    r"\bplaceholder text\b",
    r"^(?:sample|example) text\b",
    r"\btext to be supplied\b",
    r"^(?:add|insert|enter) (?:your|a|the)?\s?\w* ?(?:text|description|title|content|here)\b",
    r"^your (?:text|message|title|content|description) (?:goes )?here\b",
    r"\bgoes here\b",
    r"\bedit or delete (?:it|this)\b",
    r"^welcome to your new site\b",
)
#: Words that are typed for want of any; a text of two or more of them and nothing else is filler.
JUNK_WORDS = ("test", "asdf", "blah", "qwerty", "foo", "bar", "baz")
#: The words of filler text in a dead language; a text of two words or more, three fifths of them these, is filler.
FILLER_WORDS = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim "
    "veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse "
    "cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "finibus vestibulum porta mauris vitae nunc pellentesque maecenas fusce donec praesent"
).split()
#: The notices of web pages, in the languages of the sources.
PAGES = (
    r"<!doctype\b|<html\b|<head\b|<body\b|<title\b|<noscript\b|<script\b|<h[0-9]>|<div\b",
    r"\bit works!",
    r"\bindex of /",
    r"\bparent directory\b",
    r"\bcoming soon\b",
    r"\bunder construction\b",
    r"^just a moment\b|\bchecking your browser\b",
    r"\bverify (?:that )?you are (?:a )?human\b",
    r"^access denied\b|^account suspended\b|^forbidden\b",
    r"\b(?:this )?domain (?:has|is) expired\b",
    r"\bthis site can['’]t be reached\b",
    r"^oops!|\bthat page can['’]t be found\b",
    r"\bsorry, we could ?n['’]t find\b",
    r"^internal server error\b|^bad gateway\b|^service (?:temporarily )?unavailable\b|^gateway time-?out\b",
    r"^(?:error )?0(?: -)? (?:page )?not found\b|^error 0\b(?! [a-z]+ing)|^0 (?:forbidden|bad gateway|gone|internal server error|unauthorized)\b",
    r"^(?:page|file) not found\b",
    r"^seite nicht gefunden\b|^page introuvable\b|^nie znaleziono strony\b|^leathanach gan aimsiú\b|^página não encontrada\b|^сторінку не знайдено",
    r"\b(?:return to the homepage|go back \| home)\b",
    r"\bthe page you requested\b|\bnothing was found at this location\b|\bthe server is temporarily unable\b|\bcontact the site owner\b",
    r"\bthis is an example page\b|\bthis is your first post\b",
    r"\b(?:enable|activer|aktivieren sie|requires|does not support|need to enable) (?:javascript|js|scripts?|scripting)\b",
    r"\b(?:javascript|js|scripts?|scripting) (?:seems?|is|are|must|to be)\b.{0,40}\b(?:disabled|switched off|allowed|enabled)\b",
    r"\byour browser does not support\b",
    r"\bdetected that (?:javascript|js|scripts?|scripting)\b",
    r"\bsome parts of this page will not work\b|\bturn it on in your browser\b",
)


#: Judged templates up to which they are broadcast (some 200 bytes each).
BROADCAST_TEMPLATES = 100_000


@dataclass(frozen=True)
class ResidueRules:
    """Patterns over masked lower-case text, all parameters.

    ``quoting`` says what a message quotes: pairs of a pattern and its replacement, for messages whose gaps hold a selector, a name or
    a server's reply, which are not content of the message. ``recurring`` is the number of sources from which a template counts as widely recurring.
    """

    placeholders: tuple[str, ...] = PLACEHOLDERS
    fillers: tuple[str, ...] = FILLERS
    pages: tuple[str, ...] = PAGES
    filler_words: tuple[str, ...] = tuple(FILLER_WORDS)
    junk_words: tuple[str, ...] = JUNK_WORDS
    quoting: tuple[tuple[str, str], ...] = ()
    recurring: int = 5


def masked(value: Column, source: Column | None = None) -> Column:
    """The value as a template: lower case, blanks collapsed, the source's own key, addresses, dates and numbers masked.

    Dates consist of numbers and separators and so become equal with them. Percent escapes of paths become
    blanks first, so that they are not taken for format placeholders.
    """
    v = F.lower(value)
    if source is not None:
        k = F.lower(F.trim(source))
        v = F.when(F.length(k) > 3, F.replace(v, k, F.lit("key"))).otherwise(v)
    v = F.regexp_replace(v, r"(?:https?://|www\.)[^\s\"'<>]+|(?<![a-z0-9-])[a-z0-9-]{1,63}+(?:\.[a-z0-9-]{1,63}+){0,8}?\.(?:example|test|invalid|com|org|net|ie|uk)\b", ADDRESS)
    v = F.regexp_replace(v, r"%(?:2[0-9a-f]|3[a-f]|[57][b-f]|c[23]%[0-9a-f]{2})", " ")
    v = F.regexp_replace(F.regexp_replace(v, r"[0-9]+", NUMBER), r"0(?:[.,:/-]0)++", NUMBER)
    return F.trim(F.regexp_replace(v, r"\s+", " "))


def _any(text: Column, rules: tuple[str, ...]) -> Column:
    return text.rlike("|".join(f"(?:{r})" for r in rules))


def verdict(template: Column, rules: ResidueRules = ResidueRules()) -> Column:
    """``placeholder``, ``filler``, ``page`` or null for a masked template."""
    t = template
    for pattern, by in rules.quoting:
        t = F.regexp_replace(t, pattern, by)
    words = F.filter(F.split(F.regexp_replace(t, r"[^a-z ]", ""), " "), lambda w: w != "")
    known = F.size(F.filter(words, lambda w: w.isin(*rules.filler_words)))
    dead = (F.size(words) >= 2) & ((known * 5 >= F.size(words) * 3) | F.forall(words, lambda w: w.isin(*rules.junk_words)))
    return (
        F.when(_any(t, rules.placeholders), F.lit("placeholder"))
        .when(_any(t, rules.fillers) | dead, F.lit("filler"))
        .when(_any(t, rules.pages), F.lit("page"))
    )


def _long(df: DataFrame, id_col: str, fields: list[str], source: str) -> DataFrame:
    """``_id, _src, field, h, template``: one row per non-null value; the source as it is compared."""
    values = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in fields])
    long = df.select(F.col(id_col).alias("_id"), F.col(source).alias("_src"), F.explode(F.filter(values, lambda x: x["v"].isNotNull())).alias("x"))
    long = long.select("_id", norm_key("_src").alias("_src"), F.col("x.f").alias("field"), masked(F.col("x.v"), F.col("_src")).alias("template"))
    return long.select("_id", "_src", "field", F.xxhash64("field", "template").alias("h"), "template")


def _judged(long: DataFrame, rules: ResidueRules) -> DataFrame:
    each = long.groupBy("field", "h", "template", "_src").agg(F.count("*").alias("n"))
    # the template comes out as an aggregate: a filter on its verdict, pushed below the grouping, would judge every row
    grouped = (
        each.groupBy("field", "h", F.col("template").alias("_t"))
        .agg(F.min("template").alias("template"), F.sum("n").alias("n_rows"), F.count("_src").alias("n_sources"))
        .select("field", "h", "template", "n_rows", "n_sources", (F.col("n_sources") >= rules.recurring).alias("widely"))
    )
    return grouped.withColumn("verdict", verdict(F.col("template"), rules))


def templates(df: DataFrame, fields: list[str], source: str, rules: ResidueRules = ResidueRules(), id_col: str | None = None) -> DataFrame:
    """Distinct templates: ``field, h, template, n_rows, n_sources, widely, verdict``.

    The values are grouped by the hash of their masked form (and the form itself, so that no two share a hash), with partial aggregation
    before the shuffle; a template that a third of all rows share is one row per task and source. ``widely`` marks those of at least
    ``rules.recurring`` sources. They are counted exactly, keys trimmed and in lower case: first rows per template and
    source, then sources per template, so that a hot template needs no set of its sources. Null is no source.
    A template is judged once, however many rows have it.
    """
    return _judged(_long(df, id_col or df.columns[0], fields, source), rules)


def residue_values(df: DataFrame, id_col: str, fields: list[str], source: str, rules: ResidueRules = ResidueRules()) -> DataFrame:
    """Values that are residue: ``<id_col>, field, verdict, widely``, each (id, field) once.

    A template judged residue condemns all its values, wherever they occur; ``widely`` says whether it recurs widely. Rare templates
    are judged by the same rules, since a leftover need not recur.

    Defined cases: null values are no residue; an empty or blank value is not either; of repeated ids one row
    per field comes out if any of their values is residue; several verdicts of one (id, field) give the smallest;
    a null source masks nothing; an empty table gives an empty result; other columns are ignored.

    Scale: values are masked once and written to the shared folder as (id, source, field, hash, template), whose columns repeat so much that they
    take little room. The few judged templates are written too, joined back by hash and verified by the template itself: by broadcast
    up to ``BROADCAST_TEMPLATES`` of them, beyond that both sides are shuffled by hash and adaptive execution splits hot ones.
    """
    long = written(_long(df, id_col, fields, source), "masked")
    bad = written(_judged(long, rules).where("verdict IS NOT NULL").select("h", F.col("field").alias("_f"), F.col("template").alias("_t"), "verdict", "widely"), "judged")
    if bad.limit(BROADCAST_TEMPLATES + 1).count() <= BROADCAST_TEMPLATES:
        bad = F.broadcast(bad)
    hits = long.join(bad, (long["h"] == bad["h"]) & (F.col("field") == F.col("_f")) & (F.col("template") == F.col("_t")))
    return hits.groupBy(F.col("_id").alias(id_col), "field").agg(F.min("verdict").alias("verdict"), F.bool_or("widely").alias("widely"))


def without_residue(df: DataFrame, id_col: str, fields: list[str], source: str, rules: ResidueRules = ResidueRules()) -> DataFrame:
    """``df`` with residue values set to null, so that statistics do not count them. ``id_col`` must identify values."""
    bad = residue_values(df, id_col, fields, source, rules).groupBy(F.col(id_col).alias("__bad_id")).agg(F.collect_set("field").alias("__bad"))
    joined = df.join(bad, df[id_col] == bad["__bad_id"], "left")
    found = F.coalesce(bad["__bad"], F.array().cast("array<string>"))
    return joined.select(*[F.when(~F.array_contains(found, c), df[c]).alias(c) if c in fields else df[c] for c in df.columns])
