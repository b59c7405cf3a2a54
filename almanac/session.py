"""Session, table and lineage helpers shared by all operators."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """Session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("almanac")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ALMANAC_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per context, so that executors need no installation of it."""
    sc = spark.sparkContext
    if getattr(sc, "_almanac_shipped", False):
        return
    root = Path(__file__).resolve().parent
    files = sorted(root.rglob("*.py"))
    mark = hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()[:16]
    path = Path(tempfile.mkdtemp(prefix="almanac-")) / f"almanac_{mark}.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(path, "w") as z:
        for f in files:
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._almanac_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder for cut lineage: the cluster's ``spark.checkpoint.dir``; one of our own only where that is unset in local mode (tests).

    On a cluster a machine's own folder would lose what other executors write, so there an unset one is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if configured:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(configured)
        return configured
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="almanac-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def written(df: DataFrame, label: str = "stage") -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet under the shared folder and reads it back (columnar, prunable, survives lost executors).

    The table stays until ``discard``, or until Python ends: results are evaluated later and read it.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, label: str) -> str:
    """A name for a table of our own in the shared folder; it is noted for ``discard``."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    if not hasattr(sc, "_almanac_tables"):
        sc._almanac_tables = []
        atexit.register(_discard_quietly, spark)
    sc._almanac_tables.append(path)
    return path


def discard(spark: SparkSession) -> int:
    """Deletes the intermediate tables of this session, once its results have been written; their number."""
    sc = spark.sparkContext
    paths, sc._almanac_tables = getattr(sc, "_almanac_tables", []), []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def _discard_quietly(spark: SparkSession) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            discard(spark)
    except Exception:  # noqa: BLE001 - the session is gone
        pass


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partitioned for work that is dear per row: adaptive execution would gather few bytes in one task, however long they take."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *cols)


def utc_date(ts: Column) -> Column:
    """Calendar day of an instant in UTC, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / 86400).cast("int"))


def norm_key(c: Column | str) -> Column:
    """Source keys are compared trimmed and lower-cased."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
