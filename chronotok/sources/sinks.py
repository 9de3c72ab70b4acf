"""Sinks (K1-K9): partitioned events, sequences per split, vocabulary, splits,
tokenization spec, CSV/TSV/text reports and JSON results.

A dataset carries a manifest (K9): written first as unfinished and again as the last act, with
the inputs' state, the parameters and the rows of every part. Reuse and reload look at it, so a
dataset whose job died in between, or that was made from other inputs, counts as absent.

All writers are DataFrame writers; nothing is collected to the driver. Output
folders are plain paths (local, HDFS or object store) chosen by the caller.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.events import with_bucket


def write_events_partitioned(events: DataFrame, path: str, n_buckets: int = 1024, files: int | None = None,
                             mode: str = "overwrite") -> None:
    """K1: Hive-style ``pid_bucket=N`` folders with ``pid_bucket = pmod(person_id, n)``.

    Rows are range-partitioned on ``(pid_bucket, person_id)`` first, so each task
    writes one contiguous slice of buckets (few files per bucket) and a hot
    bucket is split over several tasks instead of landing in one.
    """
    n = files or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    b = with_bucket(events, n_buckets)
    (b.repartitionByRange(n, "pid_bucket", "person_id")
     .sortWithinPartitions("pid_bucket", "person_id", "ts")
     .write.mode(mode).partitionBy("pid_bucket").parquet(path))


def write_sequences(sequences: DataFrame, splits: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2: token sequences (one row per person, or chunks of them) partitioned by split; the combined set is the whole
    folder."""
    sequences.join(splits, "person_id").write.mode(mode).partitionBy("split").parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2/K3: vocabulary, decile cuts, split lists as Parquet."""
    df.write.mode(mode).parquet(path)


def write_spec(vocab: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K4: tokenization spec as one JSON document: special tokens, age and time maps,
    number of deciles, prefixes and the vocabulary map."""
    spec = vocab.agg(F.map_from_entries(F.collect_list(F.struct("token", "token_id"))).alias("vocab")).select(
        F.to_json(F.struct(
            F.create_map(*[x for k, v in zip(("pad", "unk", "eos", "sos"), K.SPECIAL_TOKENS) for x in (F.lit(k), F.lit(v))]).alias("special_tokens"),
            F.create_map(*[x for i, b in enumerate(K.AGE_BANDS) for x in (F.lit(b), F.lit(i))]).alias("age_mappings"),
            F.create_map(*[x for i, (lab, _) in enumerate(K.TIME_INTERVALS) for x in (F.lit(lab), F.lit(i))]).alias("time_interval_mappings"),
            F.lit(K.N_QUANTILES).alias("max_quantile_tokens"),
            F.create_map(*[x for k, v in K.CONCEPT_PREFIX.items() for x in (F.lit(k), F.lit(v))]).alias("event_type_prefix"),
            F.col("vocab"),
        )).alias("value"))
    spec.coalesce(1).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    """K5/K6: report tables with a header line (TSV with ``sep='\\t'``)."""
    df.write.mode(mode).option("header", True).option("sep", sep).csv(path)


def write_vocab_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K6: the vocabulary report as one TSV file with a header, ordered by category and id.
    The vocabulary is bounded, so it is ordered in one partition."""
    rows = report.select("category", "token_id", "token", "count").coalesce(1).sortWithinPartitions("category", "token_id")
    write_csv(rows, path, sep="\t", mode=mode)


def write_vocab_text(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K6: text variant in ``[category]`` sections of ``id<TAB>token<TAB>count`` lines."""
    line = F.concat_ws("\t", F.col("token_id").cast("string"), "token", F.col("count").cast("string"))
    rows = report.select("category", "token_id", line.alias("value"))
    heads = report.select("category").distinct().select(
        "category", F.lit(-1).alias("token_id"), F.concat(F.lit("["), "category", F.lit("]")).alias("value"))
    rows.unionByName(heads).coalesce(1).sortWithinPartitions("category", "token_id").select("value") \
        .write.mode(mode).text(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K7: per-patient predictions, metrics, simulations and truth as JSON lines."""
    df.write.mode(mode).json(path)


def dataset_path(base: str, tag: str | None) -> str:
    """K8: dataset namespace ``processed_data_<tag>``."""
    return os.path.join(base, f"processed_data_{tag}" if tag else "processed_data")


def has_output(spark, path: str) -> bool:
    """K9: whether a table is there and holds rows. Only absence counts as "no"; a table that
    cannot be read raises."""
    from .parts import part_paths

    return part_paths(spark, path) is not None and not spark.read.parquet(path).isEmpty()


MANIFEST = "manifest"


def folder_state(spark: SparkSession, path: str) -> dict:
    """Parquet parts below ``path``, their bytes and the newest change, as listed by Spark."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.parquet").load(path))
    r = found.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"),
                  F.max(F.unix_micros("modificationTime")).alias("newest")).first()
    return r.asDict()


def row_counts(spark: SparkSession, root: str, names: list[str]) -> dict[str, int]:
    """Rows of each Parquet table (from its footers) or lines of each report below ``root``."""
    from .parts import part_paths

    out = {}
    for name in names:
        path = f"{root}/{name}"
        out[name] = spark.read.parquet(path).count() if part_paths(spark, path) is not None else spark.read.text(path).count()
    return out


def write_manifest(spark: SparkSession, root: str, finished: bool, parameters: dict, inputs: dict | None = None,
                   names: list[str] | None = None) -> None:
    """K9: ``finished=False`` before anything else is written; at the end with the rows of the parts ``names``."""
    doc = {"finished": finished, "parameters": parameters, "inputs": inputs,
           "rows": row_counts(spark, root, names or []) if finished else {}}
    spark.createDataFrame([(json.dumps(doc, sort_keys=True),)], "value string").coalesce(1).write.mode(
        "overwrite").text(f"{root}/{MANIFEST}")


def read_manifest(spark: SparkSession, root: str) -> dict | None:
    """The manifest of a dataset, or None where there is none."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.text(f"{root}/{MANIFEST}").first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e.getCondition()):
            return None
        raise
    return json.loads(row[0]) if row is not None else None


def is_finished(spark: SparkSession, root: str, parameters: dict | None = None, inputs: dict | None = None) -> bool:
    """K9: whether the dataset below ``root`` was written to its end, from these parameters and inputs, has sequences
    and still holds the rows its manifest names."""
    m = read_manifest(spark, root)
    if m is None or not m["finished"] or not m["rows"].get("sequences"):
        return False
    if parameters is not None and m["parameters"] != json.loads(json.dumps(parameters)):
        return False
    if inputs is not None and m["inputs"] != json.loads(json.dumps(inputs)):
        return False
    return row_counts(spark, root, list(m["rows"])) == m["rows"]


def load_processed(spark, path: str, name: str) -> DataFrame:
    """Reload a saved artifact (sequences, vocabulary, decile cuts, splits) of a finished dataset; one whose job
    did not end, or that lacks rows, is an error."""
    m = read_manifest(spark, path)
    if m is None or not m["finished"]:
        raise ValueError(f"{path} has no finished dataset")
    table = spark.read.parquet(os.path.join(path, name))
    if table.count() != m["rows"].get(name):
        raise ValueError(f"{path}/{name} does not hold the {m['rows'].get(name)} rows of its manifest")
    return table
