"""Documents that a pipeline publishes: report, feeds, calendars, search index. Each is a DataFrame of texts, written by Spark's own commit protocol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import predicates as P
from almanac.functions import text as X
from almanac.operators.order import byte_budget


def report_json(rows: DataFrame, by: list[str], seq: str = "row_id") -> DataFrame:
    """``by, json``: per report the summary and its five lists in order. A report is one group; its rows are few."""
    fields = [c for c in ("parish", "display_name", "url", "file", "file_type", "error", "reason", "retry_strategy") if c in rows.columns]
    item = F.struct(F.col(seq).alias("_s"), F.struct(*fields).alias("r"))
    lists = [
        F.transform(F.array_sort(F.collect_list(F.when(F.col("bucket") == b, item))), lambda x: x["r"]).alias(b) for b in P.BUCKETS
    ]
    summary = F.struct(*[F.count_if(F.col("bucket") == b).alias(b) for b in P.BUCKETS]).alias("summary")
    g = rows.groupBy(*by).agg(summary, *lists)
    return g.select(*by, F.to_json(F.struct("summary", *P.BUCKETS)).alias("json"))


def report_text(counts: DataFrame, by: list[str]) -> DataFrame:
    """``by, text``: a fixed-layout summary."""
    width = max(map(len, P.BUCKETS)) + 2
    lines = [F.concat(F.rpad(F.lit(b.replace("_", " ")), width, " "), F.lpad(F.col(b).cast("string"), 8, " ")) for b in P.BUCKETS]
    return counts.select(*by, F.concat_ws("\n", F.concat_ws(" / ", *[F.col(c).cast("string") for c in by]), F.repeat(F.lit("="), F.lit(width + 8)), *lines).alias("text"))


def rss(groups: DataFrame, published: Column) -> DataFrame:
    """``name, xml``: one feed with one item per group. ``groups``: ``name, title, link, day, rate``."""
    e = X.xml_escape
    stamp = F.date_format(published, "EEE, dd MMM yyyy HH:mm:ss +0000")

    def tag(name: str, c: Column) -> Column:
        return F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))

    title, link, day = e(F.col("title")), e(F.col("link")), F.col("day").cast("string")
    item = F.concat(
        tag("title", F.concat(title, F.lit(" bulletin for "), day)), tag("link", link), tag("guid", F.concat(link, F.lit("#"), day)), tag("pubDate", stamp),
        tag("description", F.concat(F.lit("Latest edition ("), e(F.col("rate")), F.lit(" success rate)"))),
    )
    channel = F.concat(tag("title", F.concat(title, F.lit(" Bulletins"))), tag("link", link), tag("description", F.concat(F.lit("Latest bulletin feed for "), title)), tag("lastBuildDate", stamp), tag("item", item))
    return groups.select("name", F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>\n<rss version="2.0">'), tag("channel", channel), F.lit("</rss>")).alias("xml"))


def vevents(events: DataFrame, stamp: Column, domain: str = "almanac") -> DataFrame:
    """Events with ``vevent``, their calendar text; days that don't exist are left out."""
    day = F.try_to_date("date_iso", "yyyy-M-d")
    ymd = F.date_format(day, "yyyyMMdd")
    t = F.split(F.nullif(F.col("time_24h_or_null"), F.lit("")), ":")
    hhmm = F.concat(F.lpad(F.get(t, F.lit(0)), 2, "0"), F.lpad(F.coalesce(F.get(t, F.lit(1)), F.lit("00")), 2, "0"), F.lit("00"))
    start = F.when(F.size(t) > 0, F.concat(F.lit("DTSTART:"), ymd, F.lit("T"), hhmm)).otherwise(F.concat(F.lit("DTSTART;VALUE=DATE:"), ymd))
    opt = lambda name, c: F.when(F.length(c) > 0, F.concat(F.lit(name + ":"), X.ics_escape(c)))
    lines = F.concat_ws(
        "\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("key"), F.lit("-"), F.col("date_iso"), F.lit("-"), X.slug(F.col("title")), F.lit("@" + domain)),
        F.concat(F.lit("DTSTAMP:"), F.date_format(stamp, "yyyyMMdd'T'HHmmss'Z'")), start, F.concat(F.lit("SUMMARY:"), X.ics_escape(F.col("title"))),
        opt("LOCATION", F.col("location_or_null")), opt("DESCRIPTION", F.col("description")), opt("CATEGORIES", F.upper("category")), F.lit("END:VEVENT"),
    )
    return events.where(day.isNotNull()).withColumn("vevent", lines)


def calendars(events: DataFrame, stamp: Column, domain: str = "almanac") -> DataFrame:
    """``group, place, key, seq, text``: the parts of a calendar per group and of one of all, in the order of ``place, key, seq``: head, events, end.

    No calendar is one row: those of a group may be any number. ``write_calendars`` writes them in order, in as many files as they need.
    """
    v = vevents(events, stamp, domain)
    both = v.select("group", "key", "seq", "vevent").unionByName(v.select(F.lit("all").alias("group"), "key", "seq", "vevent"))
    head = F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), F.concat(F.lit(f"PRODID:-//{domain}//"), F.col("group"), F.lit("//EN")),
                       F.concat(F.lit("X-WR-CALNAME:"), X.display_name(F.col("group")), F.lit(" Events")), F.lit("CALSCALE:GREGORIAN"), F.lit("METHOD:PUBLISH"))
    frame = F.inline(F.array(F.struct(F.lit(0).alias("place"), head.alias("text")), F.struct(F.lit(2).alias("place"), F.lit("END:VCALENDAR").alias("text"))))
    ends = both.select("group").distinct().select("group", frame)
    seq = F.lit(None).cast(events.schema["seq"].dataType)
    return both.select("group", F.lit(1).alias("place"), "key", "seq", F.col("vevent").alias("text")).unionByName(
        ends.select("group", "place", F.lit(None).cast("string").alias("key"), seq.alias("seq"), "text")
    )


def write_calendars(parts: DataFrame, path: str) -> None:
    """A folder per group whose files, put together in the order of their names, are its calendar; sorted by range, so that no task has more than its part."""
    order = ["group", "place", "key", "seq"]
    rows = parts.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select("group", "text").write.mode("overwrite").partitionBy("group").option("lineSep", "\r\n").text(path)


def search_documents(docs: DataFrame, text_chars: int = 4000) -> DataFrame:
    """Rows of a search index: ``id, parish, diocese, date, text``. ``docs``: ``diocese, day, key, parish, text``."""
    return docs.where(F.length("text") > 0).select(
        F.concat_ws("-", "diocese", F.col("day").cast("string"), "key").alias("id"), "parish", "diocese", F.col("day").cast("string").alias("date"), F.left("text", F.lit(text_chars)).alias("text")
    )


def search_index(rows: DataFrame, cap: int = 5 * 1024 * 1024, envelope: int = 64) -> DataFrame:
    """The newest rows whose JSON lines fit ``cap`` bytes. Sizes are summed per date first; only the dates that the cap reaches are sorted."""
    size = F.octet_length(F.to_json(F.struct("id", "parish", "diocese", "date", "text"))) + 4
    return byte_budget(rows.withColumn("bytes", size.cast("long")), [F.desc("date"), F.col("id")], "bytes", cap - envelope, "date").drop("running")


def write_per_group(df: DataFrame, path: str, group: str) -> None:
    """JSON files in one folder per group."""
    df.write.mode("overwrite").partitionBy(group).json(path)


def write_texts(df: DataFrame, path: str, name: str, text: str) -> None:
    """One text per row under a folder of its name."""
    df.select(name, F.col(text).alias("value")).write.mode("overwrite").partitionBy(name).option("lineSep", "\n").text(path)
