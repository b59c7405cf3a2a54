"""Lookup, fuzzy and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import text as X
from almanac.functions import urls as U
from almanac.operators.order import first_rows


def count_of_keys(rows: DataFrame, keys: DataFrame, by: list[str], key: str) -> DataFrame:
    """Per group the rows whose key is among the group's keys; groups without such keys have 0."""
    wanted = keys.select(*by, key).distinct()
    hits = rows.join(wanted, [*by, key], "left_semi").groupBy(*by).agg(F.count("*").alias("n"))
    return wanted.select(*by).distinct().join(hits, by, "left").na.fill(0, ["n"])


def alias_map(sources: DataFrame, key: str, name: str, seq: str) -> DataFrame:
    """``alias, key``: normal forms of key, name and name without its last word parish; a later row's alias overwrites an earlier's."""
    short = F.when(F.endswith(F.lower(name), F.lit(" parish")), F.left(F.col(name), F.length(name) - 7))
    aliases = F.filter(F.array(X.norm_key(F.col(key)), X.norm_key(F.col(name)), X.norm_key(short)), lambda a: F.length(a) > 0)
    return sources.where(F.col(key).isNotNull()).select(F.explode(F.array_distinct(aliases)).alias("alias"), F.col(key).alias("_key"), F.col(seq).alias("_seq")).groupBy("alias").agg(
        F.max_by("_key", F.struct("_seq", "_key")).alias("resolved")
    )


def resolved_names(rows: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """Rows with ``resolved``: the key of the alias, else the normal form itself."""
    j = rows.withColumn("_a", X.norm_key(F.col(name))).join(aliases, F.col("_a") == F.col("alias"), "left")
    return j.withColumn("resolved", F.coalesce("resolved", "_a")).drop("_a", "alias")


def host_settings(rows: DataFrame, profiles: DataFrame, url: str, defaults: dict[str, int]) -> DataFrame:
    """Settings of the url's host, as given or with and without www, over the defaults."""
    h = U.hostname(F.col(url))
    bare = F.regexp_replace(h, r"^www\.", "")
    cols = list(defaults)

    def named(i: int) -> DataFrame:
        return profiles.select(F.col("host").alias(f"_h{i}"), *[F.col(c).alias(f"_{c}{i}") for c in cols]).dropDuplicates([f"_h{i}"])

    out = rows.withColumn("_host", h).withColumn("_bare", bare).withColumn("_www", F.concat(F.lit("www."), F.col("_bare")))
    for i, c in enumerate(("_host", "_bare", "_www")):
        out = out.join(named(i), F.col(c) == F.col(f"_h{i}"), "left")
    hit = lambda c: F.when(F.col("_h0").isNotNull(), F.col(f"_{c}0")).when(F.col("_h1").isNotNull(), F.col(f"_{c}1")).when(F.col("_h2").isNotNull(), F.col(f"_{c}2"))
    return out.select(*rows.columns, *[F.coalesce(hit(c), F.lit(defaults[c])).alias(c) for c in cols])


def name_match(queries: DataFrame, entries: DataFrame, limit: int = 100_000) -> DataFrame:
    """``query, outcome, name, n``: exact by a shared name form, else partly by containment; several make it ambiguous.

    Exact matches are an equi-join of exploded forms. Only queries without one meet the entries, which
    must be at most ``limit`` rows, by containment.
    """
    q = queries.select("query").distinct().withColumn("_f", X.name_forms(F.col("query")))
    e = entries.select("name").distinct().withColumn("_g", X.name_forms(F.col("name")))
    if e.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} names to match against")
    exact = (
        q.select("query", F.explode("_f").alias("form")).join(e.select("name", F.explode("_g").alias("form")), "form")
        .groupBy("query").agg(F.count_distinct("name").alias("n"), F.min("name").alias("name"), F.lit("exact").alias("how"))
    )
    rest = q.join(exact, "query", "left_anti")
    inside = F.exists("_f", lambda a: F.exists("_g", lambda b: a.contains(b) | b.contains(a)))
    partly = rest.join(F.broadcast(e), inside).groupBy("query").agg(F.count("*").alias("n"), F.min("name").alias("name"), F.lit("partial").alias("how"))
    hits = exact.unionByName(partly)
    out = q.select("query").join(hits, "query", "left")
    return out.select("query", F.when(F.col("n").isNull(), "none").when(F.col("n") > 1, "ambiguous").otherwise(F.col("how")).alias("outcome"),
                      F.when(F.col("n") == 1, F.col("name")).alias("name"), F.coalesce("n", F.lit(0)).alias("n"))


def section_score_match(sections: DataFrame, registry: DataFrame, limit: int = 100_000) -> DataFrame:
    """``section, key, score``: three points if a name contains the section or the section the name's first word, two per word found in name or key; the first best of two points or more.

    The registry must be at most ``limit`` rows; it is the broadcast side, sections stay where they are.
    """
    if registry.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} registry rows")
    needle = X.squeezed(F.regexp_replace(F.replace(F.regexp_replace(F.lower("section"), r"\([^)]*\)", " "), F.lit("&"), F.lit("and")), "[^a-z0-9]+", " "))
    s = sections.select("section").distinct().withColumn("_n", needle).where("_n <> ''").withColumn("_w", F.filter(F.split("_n", " "), lambda w: F.length(w) >= 3))
    r = registry.select("key", F.lower("name").alias("_d"), "seq")
    score = (
        F.when(F.contains("_d", F.col("_n")) | F.contains("_n", F.split_part("_d", F.lit(" "), F.lit(1))), 3).otherwise(0)
        + F.aggregate("_w", F.lit(0), lambda a, w: a + F.when(F.contains(F.col("_d"), w), 2).otherwise(0) + F.when(F.contains(F.col("key"), w), 2).otherwise(0))
    )
    scored = s.crossJoin(F.broadcast(r)).withColumn("score", score).where("score >= 2")
    return scored.groupBy("section").agg(F.max_by(F.struct("key", "score"), F.struct(F.col("score"), -F.col("seq"))).alias("b")).select("section", "b.*")


def previous_edition(editions: DataFrame, by: list[str], day: str, keep: str) -> DataFrame:
    """Each edition with the one a week before, or up to three days off that, nearest first and earlier before later.

    An equi-join on the seven possible days; no range join is needed.
    """
    offsets = [0, -1, 1, -2, 2, -3, 3]
    asked = editions.select(*by, day, F.posexplode(F.array(*[F.date_add(day, -7 + o) for o in offsets])).alias("_pref", "_day"))
    prev = editions.select(*by, F.col(day).alias("_day"), F.col(keep).alias(f"previous_{keep}")).dropDuplicates([*by, "_day"])
    hits = asked.join(prev, [*by, "_day"]).groupBy(*by, day).agg(
        F.min_by(F.struct(F.col("_day").alias("previous_day"), F.col(f"previous_{keep}")), "_pref").alias("p")
    )
    return editions.select(*by, day).distinct().join(hits, [*by, day], "left").select(*by, day, "p.*")


def status_of_keys(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """Bucket that tells a key's state, downloaded before failed before the rest."""
    rank = F.when(F.col("bucket") == "downloaded", 0).when(F.col("bucket") == "failed", 1).otherwise(2)
    return rows.groupBy(*by, key).agg(F.min_by("bucket", F.struct(rank, "bucket")).alias("bucket"))


def best_variant(candidates: DataFrame, results: DataFrame, by: list[str]) -> DataFrame:
    """The first candidate in order that answered with 200. ``candidates``: ``by, idx, url``; ``results``: ``url, code``."""
    fine = results.where("code = 200").select("url").distinct()
    return first_rows(candidates.join(fine, "url", "left_semi"), by, [F.col("idx")])


def effective_url(rows: DataFrame, *columns: str) -> Column:
    """First column with a web address."""
    return F.coalesce(*[F.when(F.col(c).rlike("(?i)^https?://"), F.col(c)) for c in columns])


def similar_patterns(pattern: DataFrame, library: DataFrame, n: int = 5) -> DataFrame:
    """Library rows of the same page type: 50 points and 20 for the same flow, or 40 and up to 10 successes; the best n distinct ones."""
    j = pattern.select("page_type", F.col("flow").alias("_flow")).distinct().join(library, "page_type")
    points = F.when(F.col("kind") == "site", 50 + F.when(F.col("flow") == F.col("_flow"), 20).otherwise(0)).otherwise(40 + F.least(F.lit(10), F.col("success_count")))
    best = j.withColumn("score", points).groupBy("page_type", "_flow", "id").agg(F.max("score").alias("score"))
    return first_rows(best, ["page_type", "_flow"], [F.desc("score"), F.col("id")], n).withColumnRenamed("_flow", "flow")
