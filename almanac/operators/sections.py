"""Ordered lines and steps: sections under headers, slices between markers, steps of a recorded chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions import text as X
from almanac.functions import urls as U

#: A section's header, and what comments of a section declare.
HEADER = r"^#\s*[-–—]{2,}\s*(.+?)\s*[-–—]{2,}\s*$"
PATTERN_LETTER = r"pattern\s+([abcdefh])\b"


def numbered_lines(files: DataFrame, text: str = "value", file: str = "file") -> DataFrame:
    """``file, pos, line``: the trimmed lines of whole files with their places."""
    return files.select(file, F.posexplode(X.lines(F.col(text))).alias("pos", "line")).withColumn("line", F.trim(F.replace("line", F.lit("﻿"), F.lit(""))))


def sectioned(lines: DataFrame, header: str = HEADER, file: str = "file") -> DataFrame:
    """Lines with their section's number and name; those before the first header are in section 0. A file is one window."""
    w = Window.partitionBy(file).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    name = F.nullif(F.regexp_extract("line", header, 1), F.lit(""))
    return lines.withColumn("_h", name).withColumn("section", F.count("_h").over(w).cast("int")).withColumn("name", F.last("_h", True).over(w)).withColumn("is_header", F.col("_h").isNotNull()).drop("_h")


def _declared(ll: Column) -> Column:
    """Kind of a comment line; the first that fits."""
    return (
        F.when(F.startswith(ll, F.lit("# key:")), "key").when(F.startswith(ll, F.lit("# page:")), "page").when(ll.rlike(PATTERN_LETTER), "pattern")
        .when(ll.contains("static") & ll.contains("pattern"), "pattern").when(ll.contains("html_link") | (ll.contains("html only") & ~ll.contains("pattern")), "html")
        .when(ll.contains("jpeg") | (ll.contains("image") & ll.contains("bulletin")), "image").when(ll.contains("docx") | ll.contains("word document"), "docx")
    )


def source_entries(lines: DataFrame, file: str = "file") -> DataFrame:
    """Sources declared in sectioned text: ``file, section, key, display_name, pattern, content_type, example_url, bulletin_page, all_urls``.

    The last pattern, key and page comment of a section win; the first address is the example; sections
    without addresses give nothing.
    """
    s = sectioned(lines, file=file).where("NOT is_header AND line <> ''")
    ll = F.lower("line")
    comment = F.startswith("line", F.lit("#"))
    url = F.regexp_replace("line", r"^[-*•]\s+", "")
    said = F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))
    letter = F.coalesce(F.nullif(F.upper(F.regexp_extract(ll, PATTERN_LETTER, 1)), F.lit("")), F.lit("F"))
    s = s.withColumn("_c", F.when(comment, _declared(ll))).withColumn("_u", F.when(~comment & F.startswith(url, F.lit("http")), url))
    last = lambda kind, value: F.max_by(F.when(F.col("_c") == kind, value), F.when(F.col("_c") == kind, F.col("pos")))
    g = s.groupBy(file, "section").agg(
        F.first("name").alias("name"), last("key", said).alias("_key"), last("page", said).alias("_page"), last("pattern", letter).alias("_p"),
        F.bool_or(F.coalesce(F.col("_c") == "html", F.lit(False))).alias("_html"), F.bool_or(F.coalesce(F.col("_c") == "image", F.lit(False))).alias("_image"),
        F.bool_or(F.coalesce(F.col("_c") == "docx", F.lit(False))).alias("_docx"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_u").isNotNull(), F.struct("pos", "_u")))), lambda x: x["_u"]).alias("all_urls"),
    ).where("size(all_urls) > 0")
    example = F.get("all_urls", F.lit(0))
    path = F.lower(F.split_part(example, F.lit("?"), F.lit(1)))
    kind = F.when(F.col("_html"), "html_link").when(F.col("_image") | path.rlike(r"\.(?:jpe?g|png)$"), "image").when(F.col("_docx") | F.endswith(path, F.lit(".docx")), "docx").otherwise("pdf")
    default = F.when(kind == "html_link", "html_link").when(kind == "image", "F").when(kind == "docx", "B").otherwise("A")
    key = F.coalesce(F.nullif(F.col("_key"), F.lit("")), U.url_key(example, F.coalesce("name", F.lit(""))))
    return g.select(file, "section", key.alias("key"), F.coalesce("name", key).alias("display_name"), F.coalesce("_p", default).alias("pattern"), kind.alias("content_type"),
                    example.alias("example_url"), F.coalesce("_page", F.lit("")).alias("bulletin_page"), "all_urls")


def name_links(lines: DataFrame, file: str = "file") -> DataFrame:
    """``file, section, name, url``: each named section with its first address."""
    s = sectioned(lines, file=file).where("section > 0 AND NOT is_header")
    u = F.regexp_replace("line", r"^[-*•]\s+", "")
    return s.where(F.startswith(u, F.lit("http"))).groupBy(file, "section").agg(F.first("name").alias("name"), F.min_by(u, "pos").alias("url"))


def declared_sections(lines: DataFrame, file: str = "file") -> DataFrame:
    """All named sections, those without addresses too: ``file, section, name, key, page_url, urls, disabled``; the last page and key comment win.

    A section's key is what it declares, else that of its first address or page, else empty.
    """
    s = sectioned(lines, file=file).where("section > 0")
    line, ll = F.col("line"), F.lower("line")
    said = F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))
    last = lambda sign: F.max_by(F.when(ll.rlike(sign), said), F.when(ll.rlike(sign), F.col("pos")))
    entry = ~F.col("is_header") & ~F.startswith(line, F.lit("#")) & (line != "")
    urls = F.transform(F.array_sort(F.collect_list(F.when(entry, F.struct("pos", "line")))), lambda x: x["line"])
    g = s.groupBy(file, "section").agg(
        F.first("name").alias("name"), last(r"^#\s*key:").alias("_key"), last(r"^#\s*page:").alias("page_url"), urls.alias("urls"), F.bool_or(ll.rlike(r"^#\s*disabled")).alias("disabled")
    )
    first = F.coalesce(F.get("urls", F.lit(0)), F.col("page_url"))
    key = F.coalesce(F.nullif(F.col("_key"), F.lit("")), F.when(first.isNotNull(), U.url_key(first, F.col("name"))), F.lit(""))
    return g.select(file, "section", "name", key.alias("key"), "page_url", "urls", "disabled")


def disabled_sections(lines: DataFrame, names: DataFrame, mark: str = "# DISABLED", file: str = "file") -> DataFrame:
    """Sectioned lines with a mark after the headers of the named sections, unless it stands there already. ``names``: ``file, name``."""
    wanted = names.select(file, F.lower("name").alias("_n")).distinct()
    heads = lines.where("is_header").join(wanted, (lines[file] == wanted[file]) & (F.lower(lines["name"]) == F.col("_n")), "left_semi")
    marked = lines.where(F.col("line").contains("DISABLED")).select(file, F.col("pos").alias("_at")).distinct()
    new = heads.join(marked, (heads[file] == marked[file]) & (F.col("pos") + 1 == F.col("_at")), "left_anti")
    cols = [file, "section", "name", "is_header", "line"]
    more = new.withColumn("line", F.lit(mark)).withColumn("is_header", F.lit(False))
    return lines.select(*cols, F.col("pos").cast("double").alias("pos")).unionByName(more.select(*cols, (F.col("pos") + 0.5).alias("pos")))


def section_block(lines: DataFrame, file: str = "file") -> DataFrame:
    """``file, section, name, block``: each named section as text, header included, blank lines at its end left out."""
    g = lines.where("section > 0").groupBy(file, "section").agg(F.first("name").alias("name"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("_l"))
    return g.select(file, "section", "name", F.rtrim(F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), F.lit(" \n")).alias("block"))


def marker_spans(docs: DataFrame, names: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``<id_col>, key, pos, length``: the lines of each key, from the first that is its name and nothing else to the next key's.

    Lines meet names by an equi-join on their normal form. ``names``: ``key, display_name``. Windows hold one
    document's markers.
    """
    form = lambda c: X.squeezed(F.lower(c))
    n = F.col("display_name")
    short = F.trim(F.regexp_replace(n, r"\s*\(.*\)\s*", ""))
    plain = F.when(F.endswith(F.lower(n), F.lit(" parish")), F.left(n, F.length(n) - 7))
    wanted = names.select("key", F.explode(F.array_distinct(F.filter(F.array(form(n), form(plain), form(short)), lambda x: F.length(x) >= 3))).alias("_form")).distinct()
    whole = docs.where(F.col(text).isNotNull()).select(id_col, F.split(F.trim(text), "\n").alias("_l"))
    lines = whole.select(id_col, F.size("_l").alias("_n"), F.posexplode("_l").alias("pos", "line"))
    marks = lines.withColumn("_form", form(F.col("line"))).join(wanted, "_form").groupBy(id_col, "key").agg(F.min("pos").alias("pos"), F.first("_n").alias("_n"))
    w = Window.partitionBy(id_col).orderBy("pos", "key")
    return marks.select(id_col, "key", "pos", (F.coalesce(F.lead("pos").over(w), F.col("_n")) - F.col("pos")).alias("length"))


def split_by_markers(docs: DataFrame, names: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``<id_col>, key, chunk``: a document cut at the lines that are a name and nothing else."""
    spans = marker_spans(docs, names, id_col, text)
    parts = spans.join(docs.select(id_col, F.split(F.trim(text), "\n").alias("_l")), id_col)
    chunk = F.array_join(F.slice("_l", F.col("pos") + 1, F.col("length")), "\n")
    return parts.select(id_col, "key", F.trim(chunk, F.lit(" \n\r\t")).alias("chunk"))


def with_gotos(clicks: DataFrame, chain: str = "chain", seq: str = "seq") -> DataFrame:
    """Recorded clicks with a step to go to the page before each click on another page than the one before: ``chain, step, action, url``."""
    w = Window.partitionBy(chain).orderBy(seq)
    moved = ~F.col("url").eqNullSafe(F.lag("url").over(w)) & F.col("url").isNotNull()
    steps = F.filter(F.array(F.when(F.col("_moved"), F.lit("goto")), F.lit("click")), lambda a: a.isNotNull())
    out = clicks.withColumn("_moved", moved).select(chain, seq, "url", F.posexplode(steps).alias("_k", "action"))
    return out.withColumn("step", F.row_number().over(Window.partitionBy(chain).orderBy(seq, "_k"))).select(chain, "step", "action", "url")


def text_density(pages: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """``by, pages, chars, mean, usable``: text enough to need no recognition — 200 characters, 80 a page."""
    g = pages.groupBy(*by).agg(F.count("*").alias("pages"), F.sum(F.length(F.coalesce(text, F.lit("")))).alias("chars"))
    return g.withColumn("mean", F.col("chars") / F.col("pages")).withColumn("usable", (F.col("chars") >= 200) & (F.col("mean") >= 80))
