"""Spark session helpers.

The library never creates a session behind the caller's back: operators take
DataFrames. ``local_session`` is for tests and the benchmark only.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Vocabulary-sized tables (at most a few 10k rows) are broadcast explicitly.
# Other small-looking sides are left to AQE, which converts a join to a
# broadcast only after it has measured the side at runtime.
AQE_BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "chronotok") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", str(AQE_BROADCAST_BYTES))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CHRONOTOK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint directory; set a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is. Only local test sessions get a fresh scratch folder.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder: checkpoints must survive executor loss")
    local = tempfile.mkdtemp(prefix="chronotok-ckpt-", dir="/tmp")  # local mode only (tests)
    sc.setCheckpointDir(local)
    return local


def bucket_labels(spark: SparkSession, n: int) -> list[int]:
    """``n`` ascending integers that Spark's bucketing by ``n`` puts into ``n`` different buckets."""
    key = (spark.sparkContext.applicationId, n)
    if key not in _LABELS:
        most, found = 16 * n + 64, []
        while len(found) < n:
            ids = spark.range(most).select(F.col("id").cast("int").alias("id"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("b"))
            found, most = [r.id for r in ids.groupBy("b").agg(F.min("id").alias("id")).collect()], 4 * most
        _LABELS[key] = sorted(found)
    return _LABELS[key]


_LABELS: dict[tuple[str, int], list[int]] = {}


def clustered_table(df: DataFrame, by: str, buckets: int, order: list[str]) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder, bucketed by ``by`` and sorted in each bucket.

    Spark knows the layout of the table that is returned, so windows, aggregates and joins on keys that
    include ``by`` take no exchange. The table is entered in the session's catalog for that.
    """
    spark = df.sparkSession
    name = f"clustered_{uuid.uuid4().hex}"
    (df.write.format("parquet").option("path", f"{ensure_checkpoint_dir(spark)}/{name}")
     .bucketBy(buckets, by).sortBy(*order).saveAsTable(name))
    return spark.table(name)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder, read back.

    Later plans scan the files, so columns are pruned and filters pushed down, and a lost
    executor costs a re-read instead of a recomputation.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    void = [F.col(f.name).cast("string").alias(f.name) if f.dataType.typeName() == "void" else F.col(f.name)
            for f in df.schema.fields]
    df.select(*void).write.parquet(path)
    return spark.read.parquet(path)
