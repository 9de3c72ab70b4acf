"""Mergeable statistics (A1, A2, Z5): counts per part, added up instead of rescanned.

Deciles, concept frequencies and the vocabulary all follow from how often each (type, concept,
value) and each categorical value occurs. A new part of the events is counted once and its counts
are stored under the part's own name; statistics over everything are sums over the stored counts,
so earlier events are not read again, and a part that is counted twice (a replay) replaces itself.
The counts are exact, so the merged results equal those over all events.

Vocabulary ids are stable: known tokens keep their ids and new ones are appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.tokens import concept_token, token_category
from ..session import cut_lineage
from .stats import category_values, deciles_of_counts
from .vocab import CATEGORY_GROUP_ORDER

VALUES, CATEGORIES = "values", "categories"


def value_counts(events: DataFrame) -> DataFrame:
    """``(et, cid, v, n)`` of the clinical events; ``v`` is the value of a measurement, else NULL."""
    v = F.when(F.col("et") == "measurement", F.col("value_as_number"))
    return events.where(F.col("et").isin(K.CLINICAL_TYPES)).groupBy("et", "cid", v.alias("v")).agg(F.count(F.lit(1)).alias("n"))


def category_counts(events: DataFrame, demo: DataFrame) -> DataFrame:
    """``(category, value, n)`` of the categorical values."""
    return category_values(events, demo).groupBy("category", "value").agg(F.count(F.lit(1)).alias("n"))


def add_part(store: str, part: str, events: DataFrame, demo: DataFrame) -> None:
    """Store the counts of one part of the events, and of the persons that came with it."""
    for name, counts in ((VALUES, value_counts(events)), (CATEGORIES, category_counts(events, demo))):
        counts.write.mode("overwrite").parquet(f"{store}/{name}/part={part}")


def merged(spark: SparkSession, store: str, name: str) -> DataFrame:
    """Counts over all stored parts."""
    counts = spark.read.parquet(f"{store}/{name}")
    return counts.groupBy(*[c for c in counts.columns if c not in ("n", "part")]).agg(F.sum("n").alias("n"))


def compact(spark: SparkSession, store: str, target: str, part: str = "base") -> None:
    """Merge all parts of a store into one part of a new store, so that the number of parts stays small."""
    for name in (VALUES, CATEGORIES):
        merged(spark, store, name).write.mode("overwrite").parquet(f"{target}/{name}/part={part}")


def concept_frequency(spark: SparkSession, store: str) -> DataFrame:
    """A1 over all stored parts: ``(et, cid, n, token)``."""
    return merged(spark, store, VALUES).groupBy("et", "cid").agg(F.sum("n").alias("n")).withColumn(
        "token", concept_token("et", "cid"))


def measurement_deciles(spark: SparkSession, store: str, min_values: int = K.MIN_VALUES_FOR_QUANTILES) -> DataFrame:
    """A2 over all stored parts: ``(cid, n, cuts)``."""
    counts = merged(spark, store, VALUES).where((F.col("et") == "measurement") & F.col("v").isNotNull())
    return deciles_of_counts(counts.select("cid", "v", F.col("n").alias("freq")), min_values)


def distinct_categories(spark: SparkSession, store: str) -> DataFrame:
    """A3/A4 over all stored parts."""
    return merged(spark, store, CATEGORIES).select("category", "value")


def extended_vocabulary(old: DataFrame, categories: DataFrame, concept_counts: DataFrame,
                        vocab_size: int = K.VOCAB_SIZE) -> DataFrame:
    """Z5 with stable ids: every token of ``old`` keeps its id; new categorical tokens follow by group and text, then new
    concepts by (frequency, text) as far as the capacity goes. The counts of all concepts are brought up to date."""
    counts = concept_counts.groupBy("token").agg(F.sum("n").alias("n"))
    kept = old.select("token", "token_id").join(counts, "token", "left")
    group = F.create_map(*[x for i, g in enumerate(CATEGORY_GROUP_ORDER) for x in (F.lit(g), F.lit(i))])
    named = categories.select(F.concat_ws("_", "category", "value").alias("token"), group[F.col("category")].alias("g"),
                              F.lit(None).cast("long").alias("n")).distinct()
    fresh = cut_lineage(named.unionByName(counts.withColumn("g", F.lit(len(CATEGORY_GROUP_ORDER)))).join(
        old.select("token"), "token", "left_anti").orderBy("g", F.col("n").desc(), "token").limit(vocab_size))
    last = old.agg((F.max("token_id") + 1).alias("next"), F.count(F.lit(1)).alias("size")).first()
    order = Window.orderBy("g", F.col("n").desc(), "token")  # bounded by the capacity
    new = fresh.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max(0, vocab_size - last["size"])).select(
        "token", (F.col("_r") - 1 + last["next"]).cast("int").alias("token_id"), "n")
    return cut_lineage(kept.unionByName(new).withColumn("category", token_category("token")).repartition(1))
