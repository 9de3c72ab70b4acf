"""Unified event stream (P1-P16, T6, J1) and demographics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources import omop
from .ranking import Slices, slices_for

# Order of events of one person on equal timestamps: rows still
# tied after these keys produce identical tokens.
EVENT_ORDER = ["ts", "table_rank", "ev_id", "cid", "value_as_number", "unit_concept_id"]


def build_events(tables: dict[str, DataFrame], include_visits: bool = True,
                 include_death: bool = True) -> DataFrame:
    """Union of every event table present, in the unified schema.

    ``include_visits=False, include_death=False`` reproduces the five-table stream.
    """
    parts: list[DataFrame] = []
    if include_visits and "visit_occurrence" in tables:
        parts.append(omop.scan_visits(tables["visit_occurrence"]))
    for spec in omop.CLINICAL_TABLES:
        if spec.table in tables:
            parts.append(omop.scan_clinical(tables[spec.table], spec))
    if include_death and "death" in tables:
        parts.append(omop.scan_death(tables["death"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_bucket(events: DataFrame, n_buckets: int = 1024) -> DataFrame:
    """``pid_bucket = pmod(person_id, n)`` (non-negative for negative ids)."""
    return events.withColumn("pid_bucket", F.pmod(F.col("person_id"), F.lit(n_buckets)).cast("int"))


def demographics(person: DataFrame) -> DataFrame:
    """One row per person with ``birth_year``.

    Duplicate person rows are resolved deterministically (latest birth time,
    then highest concept ids) because file order is not a Spark notion.
    """
    p = omop.scan_person(person)
    w = Window.partitionBy("person_id").orderBy(
        F.col("birth_datetime").desc_nulls_last(),
        F.col("gender_concept_id").desc_nulls_last(),
        F.col("race_concept_id").desc_nulls_last(),
        F.col("ethnicity_concept_id").desc_nulls_last(),
    )
    return (
        p.withColumn("_rn", F.row_number().over(w))
        .where("_rn = 1")
        .drop("_rn")
        .withColumn("birth_year", F.year("birth_datetime"))
    )


def events_of_known_persons(events: DataFrame, person: DataFrame) -> DataFrame:
    """Events of persons absent from ``person`` are dropped (left semi join).

    A shuffled join on ``person_id`` (AQE broadcasts the person side when it is
    measured small, and splits a skewed person partition otherwise).
    """
    return events.join(person.select("person_id"), "person_id", "left_semi")


def clustered_events(events: DataFrame, num_partitions: int | None = None) -> Slices:
    """K1: the events stored by person and order, in slices with a bucket each. Orders, positions and cuts at an index
    time read them without a shuffle; a person with most of all events lies in many slices."""
    return Slices(events, ["person_id"], EVENT_ORDER, num_partitions or slices_for(events), clustered=True)


def by_slice(s: Slices, per_person: DataFrame) -> DataFrame:
    """A table of one row per person as ``(_slice, ...)``, one row for each slice that the person lies in, so that it
    joins the clustered events on (slice, person): only this table moves."""
    where = s.rows.select("_slice", "person_id").distinct()
    return where.join(per_person, "person_id")


def events_until(s: Slices, index: DataFrame) -> DataFrame:
    """P20/J11 over clustered events: events with ``ts <= index_time``; persons without an index time drop out."""
    j = s.rows.join(by_slice(s, index.select("person_id", "index_time")), ["_slice", "person_id"])
    return j.where(F.col("ts") <= F.col("index_time")).drop("index_time")


def positions(s: Slices) -> DataFrame:
    """Clustered events with ``_rn`` (0-based position of the person's events), and the person's ``_n`` (events),
    ``_first`` and ``_last`` time."""
    spans = s.spanning(F.count(F.lit(1)).alias("_c"), F.min("ts").alias("_f"), F.max("ts").alias("_l"))
    spans = cut_lineage(spans.select(
        "_slice", "person_id", F.coalesce(F.sum("_c").over(s.earlier), F.lit(0)).alias("_before"),
        F.sum("_c").over(s.all).alias("_c"), F.min("_f").over(s.all).alias("_f"), F.max("_l").over(s.all).alias("_l")))
    rows = (s.rows.withColumn("_at", F.row_number().over(s.window)).withColumn("_own", F.count(F.lit(1)).over(s.whole))
            .withColumn("_lo", F.min("ts").over(s.whole)).withColumn("_hi", F.max("ts").over(s.whole)))
    rows = s.join(rows, spans)
    return (rows.withColumn("_rn", F.col("_at") - 1 + F.coalesce("_before", F.lit(0)))
            .withColumn("_n", F.coalesce("_c", "_own")).withColumn("_first", F.coalesce("_f", "_lo"))
            .withColumn("_last", F.coalesce("_l", "_hi")).drop("_at", "_own", "_lo", "_hi", "_before", "_c", "_f", "_l"))


def ordered_events(events: DataFrame | Slices) -> DataFrame:
    """Per-person sequence number (1-based) and minutes since the previous event.

    Windows run inside slices of the (person, order) range, so a person with most of all events
    is spread over many tasks; the first event of a later slice takes the last time of the
    slice before it from the small table of spanning persons. Clustered events take no shuffle.
    """
    from ..functions.tokens import gap_minutes

    s = events if isinstance(events, Slices) else Slices(events, ["person_id"], EVENT_ORDER)
    spans = s.spanning(F.count(F.lit(1)).alias("_rows"), F.max("ts").alias("_last_ts"))
    spans = (spans.withColumn("_before", F.coalesce(F.sum("_rows").over(s.earlier), F.lit(0)))
             .withColumn("_prev_slice_ts", F.lag("_last_ts").over(s.along)).drop("_rows", "_last_ts"))
    rows = (s.rows.withColumn("_rn", F.row_number().over(s.window))
            .withColumn("_lag_ts", F.lag("ts").over(s.window)))
    rows = s.join(rows, cut_lineage(spans))
    return (rows.withColumn("ev_seq", (F.col("_rn") + F.coalesce("_before", F.lit(0))).cast("int"))
            .withColumn("prev_ts", F.when(F.col("_rn") == 1, F.col("_prev_slice_ts")).otherwise(F.col("_lag_ts")))
            .withColumn("gap_minutes", gap_minutes("prev_ts", "ts"))
            .drop("_slice", "_rn", "_lag_ts", "_before", "_prev_slice_ts"))
