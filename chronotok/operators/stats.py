"""Statistics over the event stream: concept frequencies (A1), decile cut points
(A2) and the categorical values that enter the vocabulary (A3, A4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.tokens import concept_token, year_band
from .ranking import exclusive_running_sum


def concept_frequency(events: DataFrame) -> DataFrame:
    """A1: ``count(*)`` by (et, cid) for clinical events, with the concept token."""
    return (
        events.where(F.col("et").isin(K.CLINICAL_TYPES))
        .groupBy("et", "cid")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("token", concept_token("et", "cid"))
    )


def measurement_deciles(events: DataFrame, min_values: int = K.MIN_VALUES_FOR_QUANTILES,
                        num_partitions: int | None = None) -> DataFrame:
    """A2: exact linear-interpolation deciles p0, p10, .., p90 per measurement concept
    with at least ``min_values`` non-null values -> ``(cid, n, cuts array<double>)``.

    Values are first collapsed to ``(cid, value) -> freq`` (map-side combine) and then
    ranked with the skew-proof running sum, so a concept holding most of the measurements
    is spread over many tasks and only the rows at the 20 needed ranks survive. The cuts
    keep full precision.
    """
    vals = (
        events.where((F.col("et") == "measurement") & F.col("value_as_number").isNotNull())
        .groupBy("cid", F.col("value_as_number").alias("v"))
        .agg(F.count(F.lit(1)).alias("freq"))
    )
    return deciles_of_counts(vals, min_values, num_partitions)


def deciles_of_counts(vals: DataFrame, min_values: int = K.MIN_VALUES_FOR_QUANTILES,
                      num_partitions: int | None = None) -> DataFrame:
    """A2 from distinct values with their frequency ``(cid, v, freq)``."""
    ranked = exclusive_running_sum(vals, ["cid"], ["v"], "freq", out="before", total="n",
                                   num_partitions=num_partitions)
    ranked = ranked.where(F.col("n") >= min_values)
    # target positions: h_j = j/10 * (n-1); need ranks floor(h_j) and floor(h_j)+1 (capped)
    js = F.sequence(F.lit(0), F.lit(K.N_QUANTILES - 1))
    h = lambda j: (j.cast("double") / F.lit(float(K.N_QUANTILES))) * (F.col("n") - 1)
    lo = lambda j: F.floor(h(j))
    hi = lambda j: F.least(lo(j) + 1, F.col("n") - 1)
    start, stop = F.col("before"), F.col("before") + F.col("freq")
    hits = ranked.select(
        "cid", "v", "n",
        F.filter(js, lambda j: (lo(j) >= start) & (lo(j) < stop)).alias("lo_js"),
        F.filter(js, lambda j: (hi(j) >= start) & (hi(j) < stop)).alias("hi_js"),
    ).where((F.size("lo_js") > 0) | (F.size("hi_js") > 0))
    lo_rows = hits.select("cid", "n", F.explode("lo_js").alias("j"), F.col("v").alias("v_lo"))
    hi_rows = hits.select("cid", F.explode("hi_js").alias("j"), F.col("v").alias("v_hi"))
    per_j = lo_rows.join(hi_rows, ["cid", "j"])
    frac = h(F.col("j")) - F.floor(h(F.col("j")))
    q = F.col("v_lo") + frac * (F.col("v_hi") - F.col("v_lo"))
    per_j = per_j.select("cid", "n", "j", q.alias("q"))
    return per_j.groupBy("cid").agg(
        F.max("n").alias("n"),
        F.transform(F.sort_array(F.collect_list(F.struct("j", "q"))), lambda s: s["q"]).alias("cuts"),
    )


def distinct_categories(events: DataFrame, demo: DataFrame) -> DataFrame:
    """A3/A4: distinct (category, value) for genders, races, birth-year bands, units and visit types."""
    return category_values(events, demo).distinct()


def category_values(events: DataFrame, demo: DataFrame) -> DataFrame:
    """(category, value) of every person and event that has one."""
    cat = lambda name, col: col.cast("string").alias("value")
    g = demo.where(F.col("gender_concept_id").isNotNull()).select(F.lit("GENDER").alias("category"), cat("g", F.col("gender_concept_id")))
    r = demo.where(F.col("race_concept_id").isNotNull()).select(F.lit("RACE").alias("category"), cat("r", F.col("race_concept_id")))
    y = demo.where(F.col("birth_year").isNotNull()).select(F.lit("YEAR").alias("category"), cat("y", year_band("birth_year")))
    u = events.where((F.col("et") == "measurement") & F.col("unit_concept_id").isNotNull()).select(
        F.lit("UNIT").alias("category"), cat("u", F.col("unit_concept_id")))
    v = events.where(F.col("et") == "admission").select(
        F.lit("VISIT_TYPE").alias("category"),
        F.coalesce(F.col("visit_type").cast("string"), F.lit("None")).alias("value"))
    return g.unionByName(r).unionByName(y).unionByName(u).unionByName(v)


def top_concepts(events: DataFrame, et: str = "measurement", k: int = 200) -> DataFrame:
    """O2: the ``k`` most frequent concepts of one event type (count desc, id asc)."""
    return (events.where(F.col("et") == et).groupBy("cid").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col("cid").asc()).limit(k))


def keep_top_concepts(events: DataFrame, et: str = "measurement", k: int = 200) -> DataFrame:
    """O2: drop events of type ``et`` whose concept is outside the top ``k`` (semi join
    against the broadcast top-k list, which is bounded by ``k``)."""
    top = F.broadcast(top_concepts(events, et, k).select("cid"))
    other = events.where(F.col("et") != et)
    kept = events.where(F.col("et") == et).join(top, "cid", "left_semi")
    return other.unionByName(kept.select(*events.columns))


def stays(events: DataFrame) -> DataFrame:
    """Stays (admission to the discharge of the same visit, not before it) with their length in days."""
    from ..functions.tokens import wall_micros

    adm = events.where(F.col("et") == "admission").select(
        "person_id", F.col("ev_id").alias("visit_id"), F.col("ts").alias("start"))
    dis = events.where(F.col("et") == "discharge").select(F.col("ev_id").alias("visit_id"), F.col("ts").alias("end"))
    return adm.join(dis, "visit_id").where(F.col("end") >= F.col("start")).withColumn(
        "los_days", (wall_micros("end") - wall_micros("start")) / 86_400_000_000.0)


def stay_summary(events: DataFrame) -> DataFrame:
    """Per stay (admission to its discharge, same visit id), min / q1 / median / q3 /
    max of the measurement values recorded during the stay, per concept."""
    meas = events.where((F.col("et") == "measurement") & F.col("value_as_number").isNotNull()).select(
        "person_id", "ts", "cid", "value_as_number")
    # one row per four weeks of a stay, so a measurement meets only the stays around its own day
    weeks = lambda c: F.floor(F.unix_date(F.col(c).cast("date")) / 28)
    spread = stays(events).select("person_id", "visit_id", "start", "end").withColumn(
        "_weeks", F.explode(F.sequence(weeks("start"), weeks("end"))))
    j = meas.withColumn("_weeks", weeks("ts")).join(spread, ["person_id", "_weeks"]).where(
        (F.col("ts") >= F.col("start")) & (F.col("ts") <= F.col("end")))
    q = F.percentile("value_as_number", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)]))
    return j.groupBy("visit_id", "cid").agg(
        F.count(F.lit(1)).alias("n"), F.min("value_as_number").alias("min"), q.alias("_q"),
        F.max("value_as_number").alias("max")).select(
        "visit_id", "cid", "n", F.round("min", 6).alias("min"), F.round(F.col("_q")[0], 6).alias("q1"),
        F.round(F.col("_q")[1], 6).alias("median"), F.round(F.col("_q")[2], 6).alias("q3"), F.round("max", 6).alias("max"))


def los_decile_tokens(events: DataFrame) -> DataFrame:
    """Length of stay (admission to the discharge of the same visit, in days) and its
    decile token among all stays, with the measurement decile rules (first cut not below
    the value; above p90 -> 0). Stays whose discharge precedes the admission are skipped."""
    from ..functions.tokens import decile_index

    each = stays(events).select("visit_id", "los_days")
    as_values = each.select(F.lit(0).cast("bigint").alias("cid"), F.lit("measurement").alias("et"),
                             F.col("los_days").alias("value_as_number"))
    cuts = measurement_deciles(as_values).select("cuts")  # one row (all stays share cid 0)
    j = each.withColumn("_k", F.lit(0)).join(F.broadcast(cuts.withColumn("_k", F.lit(0))), "_k").drop("_k")
    return j.select("visit_id", F.round("los_days", 6).alias("los_days"),
                    F.concat(F.lit("LOS_Q"), decile_index("los_days", "cuts").cast("string")).alias("los_token"))
