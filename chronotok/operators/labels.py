"""Index times, histories and labels.

Sequences are processed in long form: running minutes are window sums over
``(person[, sim]) ORDER BY pos`` and horizon stops are filters on them, so no
sequence is ever materialised as a Python list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.tokens import concept_token, is_structural_leading, time_token_minutes
from .datasets import hash_key
from .ranking import Slices

# Token-name prefixes recorded as clinical events in a simulated future.
SIM_EVENT_PREFIXES = ["CONDITION_", "DRUG_", "PROCEDURE_", "MEASUREMENT_", "OBSERVATION_"]
# Event types a horizon label looks at.
LABEL_TYPES = ["condition", "medication", "procedure", "measurement"]


def days(n: int) -> Column:
    return F.expr(f"INTERVAL {int(n)} DAYS")


def event_span(events: DataFrame) -> DataFrame:
    """First and last event time and event count per person."""
    return events.groupBy("person_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_events"))


def _indexed(events: DataFrame | Slices) -> DataFrame:
    """Events with their 0-based position per person and the person's first/last time and count."""
    from .events import EVENT_ORDER, positions

    s = events if isinstance(events, Slices) else Slices(events.select("person_id", *EVENT_ORDER), ["person_id"], EVENT_ORDER)
    return positions(s).select("person_id", "ts", "_rn", "_n", "_first", "_last")


def index_time_end_minus_horizon(events: DataFrame | Slices, horizon_days: int) -> DataFrame:
    """``last - h``; when that is not after the first event, the event at ``n // 2``."""
    e = _indexed(events)
    mid = e.where(F.col("_rn") == F.floor(F.col("_n") / 2)).select(
        "person_id", F.col("ts").alias("_mid"), "_first", "_last")
    cand = F.col("_last") - days(horizon_days)
    return mid.select("person_id", F.when(cand <= F.col("_first"), F.col("_mid")).otherwise(cand).alias("index_time"))


def index_time_random(events: DataFrame | Slices, horizon_days: int, seed: int = K.SPLIT_SEED) -> DataFrame:
    """An md5-chosen event time with at least ``h`` after it before the last event;
    the first event time when there is none. The pick is a ``min`` over (hash, position),
    a plain aggregate, so no per-person window is needed."""
    e = _indexed(events)
    viable = e.where(F.col("ts") + days(horizon_days) <= F.col("_last"))
    picked = viable.groupBy("person_id").agg(
        F.min(F.struct(hash_key(seed, "person_id", "_rn").alias("h"), F.col("_rn").alias("rn"), F.col("ts").alias("ts")))
        .alias("_p")).select("person_id", F.col("_p.ts").alias("_pick"))
    firsts = e.where(F.col("_rn") == 0).select("person_id", "_first")
    return firsts.join(picked, "person_id", "left").select(
        "person_id", F.coalesce("_pick", "_first").alias("index_time"))


def index_time_first(events: DataFrame) -> DataFrame:
    """The first event time."""
    return events.groupBy("person_id").agg(F.min("ts").alias("index_time"))


def events_until(events: DataFrame, index: DataFrame) -> DataFrame:
    """P20: events with ``ts <= index_time`` (persons without an index time drop out)."""
    return events.join(index.select("person_id", "index_time"), "person_id").where(
        F.col("ts") <= F.col("index_time")).drop("index_time")


def _history(tokens: DataFrame, index: DataFrame) -> DataFrame:
    """Stored tokens of the static prefix and of events up to the index time, without EOS. Events are in time order,
    so these are a prefix of the sequence, with the positions and ids it already has."""
    j = tokens.join(index, "person_id")
    return j.where(((F.col("ev_seq") == 0) | (F.col("ts") <= F.col("index_time"))) & (F.col("token") != K.EOS))


def history_tokens(tokens: DataFrame, index: DataFrame, demo: DataFrame, vocab: DataFrame) -> DataFrame:
    """The sequence of each person of ``index`` up to its index time, from the stored token table.

    A history differs from the full sequence in the age at the index time (the first token) and in
    where it ends, so nothing is tokenized again. Equal to tokenizing the events up to the index time.
    """
    from ..functions.tokens import age_at_index, age_band
    from .vocab import encode, special_id

    age = F.concat(F.lit("AGE_"), age_band(age_at_index("index_time", "birth_year")))
    known = index.select("person_id", "index_time").join(demo.select("person_id", "birth_year"), "person_id").select(
        "person_id", "index_time", age.alias("_age"))
    body = _history(tokens, encode(known, vocab, token_col="_age", out="_age_id"))
    first = F.col("pos") == 0
    eos = body.groupBy("person_id").agg((F.max("pos") + 1).alias("pos")).select(
        "person_id", "pos", F.lit(K.EOS).alias("token"), F.lit(special_id(vocab, K.EOS)).alias("token_id"))
    return body.select("person_id", "pos", F.when(first, F.col("_age")).otherwise(F.col("token")).alias("token"),
                       F.when(first, F.col("_age_id")).otherwise(F.col("token_id")).alias("token_id")).unionByName(eos)


def history_lengths(tokens: DataFrame, index: DataFrame) -> DataFrame:
    """``(person_id, history_len)``: tokens of :func:`history_tokens`, counted without building them."""
    return _history(tokens.select("person_id", "token", "ev_seq", "ts"), index.select("person_id", "index_time")).groupBy(
        "person_id").agg((F.count(F.lit(1)) + 1).cast("int").alias("history_len"))


def history_tail(events: DataFrame, index: DataFrame, vocab: DataFrame, n_events: int = K.HISTORY_TAIL_EVENTS) -> DataFrame:
    """Last ``n_events`` clinical events up to the index time, concept tokens in the
    vocabulary only, then ``<EOS>`` -> ``(person_id, pos, token, token_id)``.
    The final numbering window holds at most ``n_events`` rows per person."""
    from .events import EVENT_ORDER
    from .vocab import special_id

    e = events_until(events, index)
    # the filter on a descending row number becomes a limit per person before the shuffle
    last = Window.partitionBy("person_id").orderBy(*[F.col(c).desc_nulls_last() for c in EVENT_ORDER])
    tail = e.withColumn("_from_end", F.row_number().over(last)).where(F.col("_from_end") <= n_events)
    v = vocab.select("token", "token_id")
    named = tail.withColumn("token", concept_token("et", "cid")).join(v, "token")  # inner: only known tokens
    w2 = Window.partitionBy("person_id").orderBy(F.col("_from_end").desc())
    body = named.select("person_id", (F.row_number().over(w2) - 1).alias("pos"), "token", "token_id")
    lens = body.groupBy("person_id").agg(F.count(F.lit(1)).alias("_n"))
    persons = index.select("person_id").join(lens, "person_id", "left")
    eos = persons.select("person_id", F.coalesce("_n", F.lit(0)).alias("pos"), F.lit(K.EOS).alias("token"),
                         F.lit(special_id(vocab, K.EOS)).alias("token_id"))
    return body.select("person_id", F.col("pos").cast("int"), "token", "token_id").unionByName(
        eos.select("person_id", F.col("pos").cast("int"), "token", F.col("token_id").cast("int")))


def label_in_window(events: DataFrame, index: DataFrame, horizon_days: int, target_tokens: list[str] | None = None,
                    regex: str | None = None, include_start: bool = True) -> DataFrame:
    """1 when a target clinical event lies in the horizon window.

    ``include_start=True``: ``index <= ts <= index + h`` (time-to-event rule);
    ``False``: ``index < ts <= index + h``. Only conditions, medications, procedures and
    measurements can be a target; observations and deaths never are.
    """
    events = events.where(F.col("et").isin(LABEL_TYPES))
    name = concept_token("et", "cid")
    j = events.join(index.select("person_id", "index_time"), "person_id")
    lo = (F.col("ts") >= F.col("index_time")) if include_start else (F.col("ts") > F.col("index_time"))
    inwin = lo & (F.col("ts") <= F.col("index_time") + days(horizon_days))
    hit = F.lit(False)
    if target_tokens:
        hit = hit | name.isin(target_tokens)
    if regex:
        hit = hit | (name.isNotNull() & name.rlike(regex))
    flags = j.where(inwin & hit).select("person_id").distinct().withColumn("label", F.lit(1))
    return index.select("person_id").join(flags, "person_id", "left").select(
        "person_id", F.coalesce("label", F.lit(0)).cast("int").alias("label"))


def truth_events(current: DataFrame, future: DataFrame, horizon_days: int) -> DataFrame:
    """Future clinical events after the last current event and within the horizon
    (exclusive start) -> ``(person_id, ts, token)``."""
    idx = current.groupBy("person_id").agg(F.max("ts").alias("index_time"))
    j = future.join(idx, "person_id")
    return j.where((F.col("ts") > F.col("index_time")) & (F.col("ts") <= F.col("index_time") + days(horizon_days))).select(
        "person_id", "ts", concept_token("et", "cid").alias("token")).where(F.col("token").isNotNull())


def sequence_minutes(seq: DataFrame, keys: list[str], num_partitions: int | None = None) -> DataFrame:
    """Running TIME_* minutes (inclusive) and EOS-before count per sequence."""
    from .ranking import running_sums

    s = seq.withColumn("_dm", time_token_minutes("token")).withColumn("_is_eos", (F.col("token") == K.EOS).cast("int"))
    s = running_sums(s, keys, ["pos"], ["_dm", "_is_eos"], ["cum_minutes", "_eos_before"], [True, False], num_partitions)
    return s.drop("_is_eos")


def sim_events(sims: DataFrame, horizon_days: int, seq: DataFrame | None = None) -> DataFrame:
    """Clinical tokens of each simulation with the minutes elapsed, up to the
    first EOS and while the running minutes stay below the horizon (``>=`` stops).
    ``seq`` may pass a precomputed :func:`sequence_minutes` of ``sims``."""
    h = horizon_days * 24 * 60
    s = seq if seq is not None else sequence_minutes(sims, ["person_id", "sim_id"])
    clinical = None
    for p in SIM_EVENT_PREFIXES:
        clinical = F.col("token").startswith(p) if clinical is None else clinical | F.col("token").startswith(p)
    return s.where((F.col("_eos_before") == 0) & (F.col("cum_minutes") < h) & clinical).select(
        "person_id", "sim_id", "pos", "token", F.col("cum_minutes").alias("minutes"))


def target_table(spark, targets: list[str]) -> DataFrame:
    """``(target, variant)`` for a user-given, bounded list of target tokens."""
    from ..functions.tokens import target_variants

    t = spark.createDataFrame([(x,) for x in targets], "target string")
    return t.select("target", F.explode(target_variants("target")).alias("variant"))


def label_from_sequence(seqs: DataFrame, targets: list[str], horizon_days: int = 365,
                        num_partitions: int | None = None) -> DataFrame:
    """Skip leading structural tokens, accumulate TIME_* minutes, and
    flag a target seen while the running minutes are at most the horizon (``>`` stops).

    ``seqs`` is ``(person_id, pos, token)``. Returns ``(person_id, target, label)``
    for every person and target.
    """
    from .ranking import running_sums

    h = horizon_days * 24 * 60
    named = F.when(F.col("token") != "", F.col("token"))
    # the walk starts at the first non-structural token: one row per person, no window
    start = seqs.where(~is_structural_leading(named)).groupBy("person_id").agg(F.min("pos").alias("_start"))
    s = seqs.join(start, "person_id").withColumn("_started", (F.col("pos") >= F.col("_start")).cast("int"))
    s = s.withColumn("_dm", F.when(F.col("_started") == 1, time_token_minutes("token")).otherwise(0))
    s = running_sums(s, ["person_id"], ["pos"], ["_dm"], ["_cum"], [True], num_partitions)
    kept = s.where((F.col("_started") == 1) & ~F.col("token").startswith("TIME_") & (F.col("_cum") <= h))
    tv = target_table(seqs.sparkSession, targets)
    hits = kept.join(F.broadcast(tv), kept["token"] == tv["variant"]).select("person_id", "target").distinct()
    grid = seqs.select("person_id").distinct().withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets])))
    return grid.join(hits.withColumn("label", F.lit(1)), ["person_id", "target"], "left").select(
        "person_id", "target", F.coalesce("label", F.lit(0)).cast("int").alias("label"))
