"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.canonical import NameRules, bounded_entries, candidates_in_list, map_to_list
from almanac.llm.confusables import consistent_names, lookalike_table, name_forms
from almanac.llm.leaks import bounded_items, decontaminated, leaked
from almanac.llm.mixing import mix
from almanac.llm.residue import ResidueRules, residue_values, templates, without_residue
from almanac.llm.splitting import bounded_profiles, split_texts
from almanac.llm.tokens import ByteTokenizer
from almanac.session import table


def _named_rows(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        table(spark, sf, t).select(F.lit(t).alias("table_name"), "row_id", "display_name") for t in ("report_long", "stale_bulletins")
    ]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = _named_rows(spark, sf)
    return consistent_names(rows, lookalike_table(spark)).where("display_name_disguised").select("table_name", "row_id")


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of different originals with equal skeletons, and the form that all of them get."""
    forms = name_forms(_named_rows(spark, sf), lookalike_table(spark))
    return forms.groupBy("skeleton", "form").agg(
        F.count("*").alias("originals"), F.sum("n").alias("n_rows"), F.count_if("disguised").alias("disguised")
    ).where("originals > 1")


RESIDUE_FIELDS = ["file_path", "error", "file_type"]
#: What the harvester's own messages quote, once numbers and addresses are masked.
HARVEST_RULES = ResidueRules(quoting=(
    (r"^(selector ).+( matched nothing on addr)", "$1quoted$2"),
    (r"^(unexpected response )\{.+\}", "$1quoted"),
    (r"^(recipe for ).+( no longer fits the site; start the trainer with ).+", "$1quoted$2quoted"),
    (r"^(recipe )(?:switched off)$", "$1off"),
    (r"^(page not found)( while following step 0 of the recipe)", "missing$2"),
))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "fetch_results").select("result_id", "key", *RESIDUE_FIELDS)
    return residue_values(df, "result_id", RESIDUE_FIELDS, "key", HARVEST_RULES).select("result_id", "field")


def p2_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Recurring templates with their verdicts, rows and sources."""
    df = table(spark, sf, "fetch_results").select("result_id", "key", *RESIDUE_FIELDS)
    return templates(df, RESIDUE_FIELDS, "key", HARVEST_RULES, id_col="result_id").where("widely").select("field", "template", "n_rows", "n_sources", "verdict")


def p2_run_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Per run: results, and file paths, errors and file types that are real content."""
    df = table(spark, sf, "fetch_results").select("result_id", "run_id", "key", *RESIDUE_FIELDS).distinct()
    clean = without_residue(df, "result_id", RESIDUE_FIELDS, "key", HARVEST_RULES)
    return clean.groupBy("run_id").agg(F.count("*").alias("results"), *[F.count(f).alias(f"with_{f}") for f in RESIDUE_FIELDS])


#: What is known of parish names and of how people type them. A one stands for either of two letters, which thereby become one.
PARISH_NAMES = NameRules(
    decoration=(
        r"[\[(_ ,-]+(?:co|county)[. _-]+\w+[\])]*(?=$|[\s_-])",
        r"[\[(_ -]+(?:new|old)[ _-](?:web)?site[\])]*",
        r"^\s*(?:the[ _])?(?:parish(?:es)?|church)[ _]of[ _](?:the[ _])?",
        r"[\s_–—-]+(?:rc[ _]church|catholic[ _]church|bulletin[ _]page|weekly[ _]bulletin|sunday[ _]bulletin|newsletter|parish(?:es)?)(?=[\s_]+[–—-][\s_])",
    ),
    heads=("theparishofthe", "theparishof", "parishofthe", "parishof"),
    tails=("newsletter", "weekly", "bulletinpage", "page", "newsite", "oldsite", "sunday", "rcchurch", "catholicchurch", "catholic", "church", "parish", "parishes", "website"),
    short=(("nth", "north"), ("sth", "south"), ("lwr", "lower"), ("lr", "lower"), ("upr", "upper"), ("uppr", "upper"), ("saint", "st"), ("est", "east"), ("wst", "west"), ("agus", "and")),
    alike=("01i", "oll"),
    spellings=(("lough", "loch"), ("clon", "cloon"), ("kil", "kill")),
    prefixes=tuple("bally knock derry carrow castle temple tully inish aghna kil clon corr drum doon dun fenn glen lis mag rath ard".split()),
    turned=("north", "south", "east", "west", "upper", "lower", "urban", "rural"),
    titles=("st",),
)


def _typed_names(spark: SparkSession, sf: str) -> tuple[DataFrame, list[tuple[int, str]]]:
    rows = [
        table(spark, sf, t).select(F.lit(t).alias("table_name"), "row_id", "display_name") for t in ("report_long", "contacts")
    ]
    refs = table(spark, sf, "parish_names")
    names = refs.select(F.col("canonical_name").alias("display_name"))
    return rows[0].unionByName(rows[1]).join(names, "display_name", "left_anti"), bounded_entries(refs, "ref_id", "canonical_name")


def _mapped_names(spark: SparkSession, sf: str) -> DataFrame:
    typed, entries = _typed_names(spark, sf)
    return map_to_list(typed, "display_name", entries, lookalike_table(spark), PARISH_NAMES)


def p3_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Of each typed text all entries within the distance for its length."""
    typed, entries = _typed_names(spark, sf)
    return candidates_in_list(typed, "display_name", entries, lookalike_table(spark), PARISH_NAMES)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mapped_names(spark, sf).select("table_name", "row_id", "ref_id")


def p3_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that mean no entry, or none decidedly, with the rows that have them."""
    return _mapped_names(spark, sf).where("ref_id = 0").groupBy("display_name", "nearest").agg(F.count("*").alias("n_rows"))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    items = bounded_items(table(spark, sf, "eval_items"), "item_id", "text")
    return leaked(table(spark, sf, "documents"), "doc_id", "text", items, lookalike_table(spark))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("doc_id", "item_id")


def p6_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items that leaked, with the documents that have them and the longest passage."""
    return _leaks(spark, sf).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("longest").alias("longest"))


def p6_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    items = bounded_items(table(spark, sf, "eval_items"), "item_id", "text")
    return decontaminated(table(spark, sf, "documents"), "doc_id", "text", items, lookalike_table(spark))


def p7_selection(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), ByteTokenizer())[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), ByteTokenizer())[1]


def p7_audit(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the selection, per mix and source: real documents of the source only, each at most so often, quotas met, places without gaps."""
    docs = table(spark, sf, "documents")
    targets = table(spark, sf, "mix_targets")
    selection, report = mix(docs, targets, ByteTokenizer())
    real = docs.where(F.length("text") > 0).select("doc_id", F.col("source").alias("own"))
    chosen = selection.join(real, "doc_id", "left").withColumn("right", F.coalesce(F.col("own") == F.col("source"), F.lit(False)))
    by_doc = chosen.groupBy("mix_id", "source", "doc_id").agg(
        F.count("*").alias("uses"), F.count_distinct("copy").alias("copies"), F.bool_and("right").alias("right"), F.max("tokens").alias("largest")
    )
    held = by_doc.groupBy("mix_id", "source").agg(
        F.bool_and("right").alias("right"), F.bool_and(F.col("uses") == F.col("copies")).alias("once"), F.max("uses").alias("uses"), F.max("largest").alias("largest"), F.count("*").alias("n")
    )
    places = selection.groupBy("mix_id", "shard").agg((F.max("position") == F.count("*")).alias("dense")).groupBy("mix_id").agg(F.bool_and("dense").alias("dense"))
    caps = targets.groupBy("mix_id", "source").agg(F.min("max_repeats").alias("cap"))
    has = docs.where(F.length("text") > 0).groupBy("source").agg(F.count("*").alias("n_docs"))
    j = caps.join(report.select("mix_id", "source", "quota", "tokens"), ["mix_id", "source"]).join(held, ["mix_id", "source"], "left").join(places, "mix_id", "left").join(has, "source", "left")
    return j.select(
        "mix_id", "source", F.coalesce("right", F.lit(True)).alias("own_documents"), F.coalesce("once", F.lit(True)).alias("each_copy_once"), F.coalesce(F.col("uses") <= F.col("cap"), F.lit(True)).alias("within_repeats"),
        (F.abs(F.col("tokens") - F.col("quota")) <= F.coalesce("largest", F.lit(0)) / 2 + 1).alias("quota_met"), F.coalesce("dense", F.lit(True)).alias("dense_places"),
        (F.coalesce("n", F.lit(0)) > 0).alias("is_used"), (F.coalesce("n", F.lit(0)) <= F.coalesce("n_docs", F.lit(0))).alias("no_more_than_there_are"),
    )


def p8_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_texts(table(spark, sf, "documents"), "doc_id", "text", bounded_profiles(table(spark, sf, "split_limits")), ByteTokenizer())


def p8_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Per profile and kind of boundary: pieces that end there, their mean and greatest size."""
    return p8_pieces(spark, sf).groupBy("profile", "cut").agg(
        F.count("*").alias("pieces"), F.avg("tokens").alias("mean_tokens"), F.max("tokens").alias("most_tokens")
    )


def p8_audit(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the pieces, for every document and profile: without overlaps they add up to the text, and sizes, order and overlaps are as wanted."""
    docs, limits = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "split_limits")
    pieces = p8_pieces(spark, sf).join(F.broadcast(limits), "profile")
    overlap, inner = F.col("overlap"), F.col("piece") > 0
    sound = (F.col("tokens") <= F.col("max_tokens")) & F.when(inner, (overlap <= F.col("overlap_tokens")) & ((overlap > F.col("overlap_tokens") - 4) | (F.col("first_token") == 0))).otherwise(overlap == 0)
    own = F.struct("piece", "first_token", "end_token", F.substring("text", F.col("overlap_chars") + 1, F.length("text")).alias("t"))
    by_doc = pieces.groupBy("doc_id", "profile").agg(F.array_sort(F.collect_list(own)).alias("p"), F.bool_and(sound).alias("sound"))
    order = F.forall(F.sequence(F.lit(0), F.size("p") - 1), lambda i: (F.get("p", i)["piece"] == i) & ((i == 0) | (F.get("p", i)["first_token"] <= F.get("p", i - 1)["end_token"])))
    whole = F.array_join(F.transform("p", lambda x: x["t"]), "")
    by_doc = by_doc.select("doc_id", "profile", F.md5(whole).alias("whole"), (F.col("sound") & order).alias("sound"), F.size("p").alias("n"))
    profiles = F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(m).alias("max_tokens")) for p, m, _ in bounded_profiles(limits)])
    j = docs.select("*", F.inline(profiles)).join(by_doc, ["doc_id", "profile"], "left")
    split = F.col("n").isNotNull()
    words = F.size(F.filter(F.split("text", r"[^a-zA-Z0-9]+"), lambda w: w != ""))
    return j.select(
        "doc_id", "profile", F.when(split, F.col("whole")).otherwise(F.md5("text")).alias("text_md5"), F.coalesce("sound", F.lit(True)).alias("sound"),
        (~split | (F.col("n") > 1) & (F.octet_length("text") > F.col("max_tokens"))).alias("only_if_long"), F.coalesce(split | (words <= F.col("max_tokens")), F.lit(True)).alias("always_if_long"),
    )


QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_templates": p2_templates,
    "p2_run_stats": p2_run_stats,
    "p3_found": p3_found,
    "p3_unmatched": p3_unmatched,
    "p3_candidates": p3_candidates,
    "p6_found": p6_found,
    "p6_items": p6_items,
    "p6_cleaned": p6_cleaned,
    "p7_selection": p7_selection,
    "p7_shares": p7_shares,
    "p7_audit": p7_audit,
    "p8_pieces": p8_pieces,
    "p8_cuts": p8_cuts,
    "p8_audit": p8_audit,
}
#: Sizes depend on the tokenizer, so SQL states what must hold of every selection and of every set of pieces.
ORACLE: dict[str, str] = {
    "p7_audit": """SELECT mix_id, source, true AS own_documents, true AS each_copy_once, true AS within_repeats, true AS quota_met, true AS dense_places, coalesce(max(n) > 0, false) AS is_used, true AS no_more_than_there_are
 FROM mix_targets LEFT JOIN (SELECT source, count(*) AS n FROM documents WHERE length(text) > 0 GROUP BY 1) USING (source) GROUP BY 1, 2""",
    "p8_audit": """SELECT doc_id, profile, md5(text) AS text_md5, true AS sound, true AS only_if_long, true AS always_if_long FROM documents, split_limits""",
}
