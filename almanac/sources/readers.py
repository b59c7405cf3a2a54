"""Readers of the formats that collection pipelines leave behind. Schemas are explicit; what can't be read becomes empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.functions.arrays import clamped_int
from almanac.operators.order import first_rows


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """``file, value``: whole text files."""
    return spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_name"))


def json_map(spark: SparkSession, path: str, value: T.DataType | str = "string") -> DataFrame:
    """``file, key, value`` of files that hold one object; keys trimmed, blank keys and other content dropped."""
    kind = value if isinstance(value, str) else value.simpleString()
    m = F.from_json("value", f"map<string,{kind}>")
    out = whole_texts(spark, path).where(F.startswith(F.ltrim("value"), F.lit("{"))).select("file", F.explode(F.map_entries(m)).alias("e"))
    return out.select("file", F.trim("e.key").alias("key"), F.col("e.value").alias("value")).where("key <> ''")


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that hold one array of objects, with ``seq``, their place; other content gives none."""
    kind = items_type(schema)
    items = F.coalesce(F.from_json("value", kind), F.array().cast(kind))
    return whole_texts(spark, path).select("file", F.posexplode(items).alias("seq", "e")).select("file", "seq", "e.*")


def items_type(schema: str) -> str:
    return f"array<{T.StructType.fromDDL(schema).simpleString()}>"


def json_file_per_key(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a file; ``key`` is the file's stem. Of several folders the first by name counts, files outside folders last."""
    df = spark.read.schema(schema).json(path, multiLine=True).withColumn("_p", F.col("_metadata.file_path"))
    df = df.withColumn("key", F.regexp_extract("_p", r"([^/]+)\.json$", 1)).withColumn("folder", F.regexp_extract("_p", r"([^/]+)/[^/]+$", 1))
    return first_rows(df, ["key"], [F.desc(F.length(F.regexp_replace("_p", "[^/]", ""))), F.col("folder")]).drop("_p")


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, modified`` of files, without reading them."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def named_files(files: DataFrame, pattern: str, columns: list[str]) -> DataFrame:
    """Columns taken from the groups of the file's name; files that don't fit are left out."""
    name = F.regexp_extract("path", "[^/]+$", 0)
    return files.where(name.rlike(pattern)).select("*", *[F.regexp_extract(name, pattern, i + 1).alias(c) for i, c in enumerate(columns)])


def clean_counters(rows: DataFrame, drop_bad: bool) -> DataFrame:
    """``key, failures`` of a raw map in either of the two readings of a counter."""
    out = rows.select(F.trim("key").alias("key"), clamped_int(F.col("value"), drop_bad).alias("failures")).where("key <> ''")
    return out.where("failures IS NOT NULL") if drop_bad else out
