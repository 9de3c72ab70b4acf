"""Evaluation context over a bridge: current/future cut, future token sequences,
simulated futures, targets, the balanced cohort and the scored table.

Simulated futures follow FIXTURES.md: persons with a future timeline ranked by
id (0..N-1); simulation s of the person at rank r is the future sequence
(without its 4 static tokens) of the person at rank (r + s + 1) mod N. The
ranks come from the skew-proof two-phase rank, and the sequences are joined by
rank, so the fixture is a distributed Spark job like any other.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import evaluate as EV
from ..operators import labels as L
from ..operators.ranking import global_rank, slices_for
from ..operators.vocab import decode
from ..session import cut_lineage
from .timelines import TimelineBuild


class EvalContext:
    def __init__(self, build: TimelineBuild, cut: str, horizon_days: int, num_samples: int = 10,
                 n_targets: int = 3, patient_limit: int = 100, readmit_days: int = 30):
        self.b = build
        self.cut = cut
        self.h = horizon_days
        self.n = num_samples
        self.n_targets = n_targets
        self.limit = patient_limit
        self.readmit_days = readmit_days

    @cached_property
    def current(self) -> DataFrame:
        return self.b.known_events.where(F.col("ts") < F.to_timestamp_ntz(F.lit(self.cut)))

    @cached_property
    def future(self) -> DataFrame:
        return self.b.known_events.where(F.col("ts") >= F.to_timestamp_ntz(F.lit(self.cut)))

    @cached_property
    def overlap(self) -> DataFrame:
        """Persons with both current and future events."""
        return cut_lineage(self.current.select("person_id").intersect(self.future.select("person_id")))

    @cached_property
    def future_tokens(self) -> DataFrame:
        return cut_lineage(self.b.tokens_for(self.future, require_events=True))

    @cached_property
    def future_named(self) -> DataFrame:
        """Future sequences of the overlap persons with decoded names ('' when unknown)."""
        t = self.future_tokens.join(self.overlap, "person_id", "left_semi").select("person_id", "pos", "token_id")
        return decode(t, self.b.vocab, unknown_prefix="").withColumn(
            "token", F.when(F.col("token") == F.col("token_id").cast("string"), F.lit("")).otherwise(F.col("token")))

    @cached_property
    def sim_sources(self) -> DataFrame:
        """Which future sequence each simulation of a person copies."""
        persons = self.future_tokens.select("person_id").distinct()
        ranked = global_rank(persons, ["person_id"], out="r")
        n_persons = persons.count()
        grid = ranked.select("person_id", "r", F.explode(F.sequence(F.lit(0), F.lit(self.n - 1))).alias("sim_id"))
        grid = grid.withColumn("src_r", F.pmod(F.col("r") + F.col("sim_id") + 1, F.lit(n_persons)))
        src = ranked.select(F.col("r").alias("src_r"), F.col("person_id").alias("src_person"))
        return cut_lineage(grid.join(src, "src_r").select("person_id", "sim_id", "src_person"))

    @cached_property
    def sims(self) -> DataFrame:
        """The simulated futures themselves: ``(person_id, sim_id, pos, token)``."""
        body = self.future_tokens.where(F.col("pos") >= 4).select(
            F.col("person_id").alias("src_person"), (F.col("pos") - 4).alias("pos"), "token_id")
        s = self.sim_sources.join(body, "src_person").select("person_id", "sim_id", "pos", "token_id")
        return decode(s, self.b.vocab).select("person_id", "sim_id", "pos", "token")

    @cached_property
    def targets(self) -> list[str]:
        """The most frequent condition tokens of the future sequences (ties by text)."""
        rows = (self.future_tokens.where(F.col("token").startswith("CONDITION_OCCURRENCE_"))
                .groupBy("token").count().orderBy(F.col("count").desc(), F.col("token")).limit(self.n_targets).collect())
        return [r["token"] for r in rows]

    @cached_property
    def future_seq(self) -> DataFrame:
        """Future sequences without their static tokens up to the first EOS, with running minutes
        (W4/W8). Every simulation is a copy of one of them, so the walk runs once, before the copies."""
        body = self.future_tokens.where(F.col("pos") >= 4).select("person_id", (F.col("pos") - 4).alias("pos"), "token_id")
        s = L.sequence_minutes(decode(body, self.b.vocab), ["person_id"], slices_for(self.future_tokens)).where(F.col("_eos_before") == 0)
        return cut_lineage(s.select("person_id", "pos", "token", "cum_minutes", "_eos_before"))

    @cached_property
    def sim_seq(self) -> DataFrame:
        """Simulations up to the first EOS with running minutes. Not written: each score reads one join of the
        stored sources and sequences, with its filters and columns below the join."""
        src = self.future_seq.withColumnRenamed("person_id", "src_person")
        return self.sim_sources.join(src, "src_person").drop("src_person")

    @cached_property
    def sim_ev(self) -> DataFrame:
        return L.sim_events(self.sims, self.h, seq=self.sim_seq)

    @cached_property
    def seq_labels(self) -> DataFrame:
        return cut_lineage(L.label_from_sequence(
            self.future_named, self.targets, self.h, slices_for(self.future_tokens)))

    @cached_property
    def sim_tprob(self) -> DataFrame:
        persons = self.future_tokens.select("person_id")  # the persons that have simulations
        return cut_lineage(EV.sim_target_prob(self.sim_ev, persons, self.targets, self.n))

    @cached_property
    def truth(self) -> DataFrame:
        cur = self.current.join(self.overlap, "person_id", "left_semi")
        return L.truth_events(cur, self.future, self.h)

    @cached_property
    def cohort(self) -> DataFrame:
        return cut_lineage(EV.balanced_cohort(self.seq_labels, self.targets, self.limit))

    @cached_property
    def scored_all(self) -> DataFrame:
        """Labels and scores of every evaluated person."""
        return self.seq_labels.join(self.sim_tprob, ["person_id", "target"]).select(
            "target", "person_id", "label", F.col("prob").alias("score"))

    @cached_property
    def scored(self) -> DataFrame:
        """Labels and scores of the balanced cohort."""
        return self.scored_all.join(self.cohort, "person_id", "left_semi")

    @cached_property
    def tte_index(self) -> DataFrame:
        """Index time per person, the last event less the horizon (W13), for persons with simulations."""
        idx = L.index_time_end_minus_horizon(self.b.event_slices, self.h)
        return cut_lineage(idx.join(self.future_tokens.select("person_id").distinct(), "person_id", "left_semi"))

    @cached_property
    def tte_scored(self) -> DataFrame:
        """Label from the person's events after the index time, score from the simulations."""
        lab = L.label_in_window(self.b.known_events, self.tte_index, self.h, target_tokens=self.targets)
        k = self.sim_ev.where(F.col("token").isin(self.targets)).groupBy("person_id").agg(
            F.countDistinct("sim_id").alias("_k"))
        return cut_lineage(lab.join(k, "person_id", "left").select(
            F.lit("any").alias("target"), "person_id", "label",
            (F.coalesce("_k", F.lit(0)) / F.lit(float(self.n))).alias("score")))

    @cached_property
    def tte_history(self) -> DataFrame:
        """The full history up to the index time as tokens."""
        return L.history_tokens(self.b.tokens, self.tte_index, self.b.demo, self.b.vocab)

    @cached_property
    def tte_history_lengths(self) -> DataFrame:
        return L.history_lengths(self.b.tokens, self.tte_index)

    def write_results(self, out_dir: str) -> None:
        """K7: predictions and metrics of the time-to-event job as JSON lines."""
        from ..sources.sinks import write_json

        lens = self.tte_history_lengths
        scored = self.tte_scored.select("person_id", "label", F.col("score").alias("prob"))
        write_json(EV.predictions_table(self.tte_index, scored, lens), f"{out_dir}/tte_predictions")
        m = self.tte_scored
        n = m.agg(F.count(F.lit(1)).alias("n_patients"), F.lit("any").alias("target"))
        for f in (EV.auroc, EV.auprc, EV.brier, EV.ece):
            n = n.join(f(m, ["target"]), "target")
        write_json(n.withColumnRenamed("ece", "ece_10"), f"{out_dir}/tte_metrics")


# --------------------------------------------------------------------------- oracle SQL


def _time_case(t: str) -> str:
    return "CASE " + " ".join(f"WHEN {t} = 'TIME_{lab}' THEN {m}" for lab, m in K.TIME_INTERVALS) + " ELSE 0 END"


def _variants_sql(t: str) -> str:
    alts = [t]
    for short, long_ in K.TARGET_VARIANTS:
        alts.append(f"CASE WHEN starts_with({t}, '{long_}') THEN '{short}' || substr({t}, {len(long_) + 1}) END")
        alts.append(f"CASE WHEN starts_with({t}, '{short}') THEN '{long_}' || substr({t}, {len(short) + 1}) END")
    return "[" + ", ".join(alts) + "]"


def eval_sql(cut: str, horizon_days: int, num_samples: int, n_targets: int, limit: int, readmit_days: int) -> str:
    h = horizon_days * 24 * 60
    struct = " OR ".join(f"starts_with(token, '{p}')" for p in K.STRUCTURAL_LEADING_PREFIXES)
    clinical = " OR ".join(f"starts_with(token, '{p}')" for p in L.SIM_EVENT_PREFIXES)
    half = max(1, limit // max(1, n_targets) // 2)
    return f"""
ev_cur AS (SELECT * FROM ev_known WHERE ts < TIMESTAMP '{cut}'),
ev_future AS (SELECT * FROM ev_known WHERE ts >= TIMESTAMP '{cut}'),
demo_fut AS (SELECT * FROM demo WHERE person_id IN (SELECT person_id FROM ev_future)),
overlap AS (SELECT DISTINCT person_id FROM ev_cur INTERSECT SELECT DISTINCT person_id FROM ev_future),
fut_rank AS (SELECT person_id, row_number() OVER (ORDER BY person_id) - 1 AS r, count(*) OVER () AS n
             FROM (SELECT DISTINCT person_id FROM tokens)),
sims AS (
  SELECT f.person_id, CAST(s.sim_id AS INTEGER) AS sim_id, t.pos - 4 AS pos, coalesce(v.token, 'UNKNOWN_' || CAST(t.token_id AS VARCHAR)) AS token
  FROM fut_rank f CROSS JOIN range(0, {num_samples}) s(sim_id)
  JOIN fut_rank src ON src.r = (f.r + s.sim_id + 1) % f.n
  JOIN tokens t ON t.person_id = src.person_id AND t.pos >= 4
  LEFT JOIN vocab v ON v.token_id = t.token_id
),
targets AS (
  SELECT token AS target FROM (SELECT token, count(*) AS n FROM tokens WHERE starts_with(token, 'CONDITION_OCCURRENCE_')
                               GROUP BY token ORDER BY n DESC, token LIMIT {n_targets})
),
target_var AS (
  SELECT DISTINCT target, variant FROM (SELECT target, unnest({_variants_sql('target')}) AS variant FROM targets)
  WHERE variant IS NOT NULL
),
sim_seq AS (
  SELECT *, sum(dm) OVER (PARTITION BY person_id, sim_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_minutes,
         coalesce(sum(CASE WHEN token = '<EOS>' THEN 1 ELSE 0 END) OVER (PARTITION BY person_id, sim_id ORDER BY pos
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS eos_before
  FROM (SELECT *, {_time_case('token')} AS dm FROM sims)
),
sim_ev AS (
  SELECT person_id, sim_id, pos, token, cum_minutes AS minutes FROM sim_seq
  WHERE eos_before = 0 AND cum_minutes < {h} AND ({clinical})
),
sim_tprob AS (
  SELECT p.person_id, t.target, coalesce(k.k, 0) / {float(num_samples)} AS prob
  FROM (SELECT DISTINCT person_id FROM sims) p CROSS JOIN targets t
  LEFT JOIN (SELECT e.person_id, tv.target, count(DISTINCT e.sim_id) AS k FROM sim_ev e JOIN target_var tv ON e.token = tv.variant
             GROUP BY 1, 2) k ON k.person_id = p.person_id AND k.target = t.target
),
idx_cur AS (SELECT person_id, max(ts) AS index_time FROM ev_cur WHERE person_id IN (SELECT person_id FROM overlap) GROUP BY person_id),
truth AS (
  SELECT f.person_id, f.ts, {CLINICAL_PREFIX_CASE_F} || CAST(f.cid AS VARCHAR) AS token
  FROM ev_future f JOIN idx_cur i ON f.person_id = i.person_id
  WHERE f.ts > i.index_time AND f.ts <= i.index_time + INTERVAL {horizon_days} DAY AND f.et IN ({CLINICAL_LIST})
),
fut_named AS (
  SELECT t.person_id, t.pos, coalesce(v.token, '') AS token FROM tokens t LEFT JOIN vocab v ON t.token_id = v.token_id
  WHERE t.person_id IN (SELECT person_id FROM overlap)
),
seq_run AS (
  SELECT *, sum(CASE WHEN started = 1 THEN dm ELSE 0 END) OVER (PARTITION BY person_id ORDER BY pos
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM (SELECT *, max(CASE WHEN token = '' OR {struct} THEN 0 ELSE 1 END) OVER (PARTITION BY person_id ORDER BY pos
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS started, {_time_case('token')} AS dm
        FROM fut_named)
),
seq_labels AS (
  SELECT p.person_id, t.target, CAST(CASE WHEN hh.person_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS label
  FROM (SELECT DISTINCT person_id FROM fut_named) p CROSS JOIN targets t
  LEFT JOIN (SELECT DISTINCT s.person_id, tv.target FROM seq_run s JOIN target_var tv ON s.token = tv.variant
             WHERE s.started = 1 AND NOT starts_with(s.token, 'TIME_') AND s.cum <= {h}) hh
    ON hh.person_id = p.person_id AND hh.target = t.target
),
picked AS (
  SELECT DISTINCT person_id FROM (
    SELECT *, row_number() OVER (PARTITION BY target, label ORDER BY md5('42|' || target || '|' || CAST(person_id AS VARCHAR)), person_id) AS r
    FROM seq_labels) WHERE r <= {half}
),
cohort AS (
  SELECT person_id FROM picked
  UNION ALL
  SELECT person_id FROM (
    SELECT person_id, row_number() OVER (ORDER BY md5('42|topup|' || CAST(person_id AS VARCHAR)), person_id) AS r
    FROM (SELECT DISTINCT person_id FROM seq_labels) WHERE person_id NOT IN (SELECT person_id FROM picked))
  WHERE r <= {limit} - (SELECT count(*) FROM picked)
),
scored_all AS (
  SELECT l.target, l.person_id, l.label, p.prob AS score
  FROM seq_labels l JOIN sim_tprob p ON p.person_id = l.person_id AND p.target = l.target
),
scored AS (SELECT * FROM scored_all WHERE person_id IN (SELECT person_id FROM cohort)),
tte_rows AS (
  SELECT *, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY person_id) AS n,
         min(ts) OVER (PARTITION BY person_id) AS first_ts, max(ts) OVER (PARTITION BY person_id) AS last_ts
  FROM ev_known WINDOW w AS (PARTITION BY person_id ORDER BY ts NULLS FIRST, table_rank NULLS FIRST, ev_id NULLS FIRST,
                             cid NULLS FIRST, value_as_number NULLS FIRST, unit_concept_id NULLS FIRST)
),
tte_idx AS (
  SELECT person_id, CASE WHEN last_ts - INTERVAL {horizon_days} DAY <= first_ts THEN ts ELSE last_ts - INTERVAL {horizon_days} DAY END AS index_time
  FROM tte_rows WHERE rn = n // 2 AND person_id IN (SELECT person_id FROM sims)
),
tte_scored AS (
  SELECT i.person_id, 'any' AS target,
         CAST(CASE WHEN i.person_id IN (
           SELECT f.person_id FROM ev_known f JOIN tte_idx x ON f.person_id = x.person_id
           WHERE f.ts >= x.index_time AND f.ts <= x.index_time + INTERVAL {horizon_days} DAY
             AND f.et IN ('condition', 'medication', 'procedure', 'measurement')
             AND {CLINICAL_PREFIX_CASE_F} || CAST(f.cid AS VARCHAR) IN (SELECT target FROM targets)) THEN 1 ELSE 0 END AS INTEGER) AS label,
         coalesce(k.k, 0) / {float(num_samples)} AS score
  FROM tte_idx i LEFT JOIN (SELECT person_id, count(DISTINCT sim_id) AS k FROM sim_ev WHERE token IN (SELECT target FROM targets)
                            GROUP BY person_id) k ON k.person_id = i.person_id
),
first_hits AS (
  SELECT person_id, sim_id,
         arg_min(CASE WHEN token = 'EVENT_ADMISSION' AND NOT (cum_minutes > {readmit_days * 1440}) THEN 1 ELSE 0 END, pos) AS readmit
  FROM sim_seq WHERE eos_before = 0 AND (token IN ('EVENT_ADMISSION', 'EVENT_DEATH') OR cum_minutes > {readmit_days * 1440})
  GROUP BY 1, 2
),
mortality AS (
  SELECT p.person_id, coalesce(k.k, 0) / {float(num_samples)} AS prob
  FROM (SELECT DISTINCT person_id FROM sims) p
  LEFT JOIN (SELECT person_id, count(DISTINCT sim_id) AS k FROM sim_seq WHERE eos_before = 0 AND token = 'EVENT_DEATH' GROUP BY 1) k
    ON k.person_id = p.person_id
)"""


def _prefix_case_f() -> str:
    return "CASE f.et " + " ".join(f"WHEN '{et}' THEN '{p}'" for et, p in K.CONCEPT_PREFIX.items()) + " END"


CLINICAL_PREFIX_CASE_F = _prefix_case_f()
CLINICAL_LIST = ", ".join(f"'{et}'" for et in K.CLINICAL_TYPES)


def metric_sql(src: str, kind: str) -> str:
    """Rank/calibration metrics by target over a scored CTE ``src(target, person_id, label, score)``."""
    tab = f"""(SELECT *, coalesce(sum(neg) OVER (PARTITION BY target ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
       sum(pos) OVER (PARTITION BY target ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp_cum,
       sum(neg) OVER (PARTITION BY target ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp_cum,
       sum(pos) OVER (PARTITION BY target) AS np, sum(neg) OVER (PARTITION BY target) AS nn
  FROM (SELECT target, score, sum(label) AS pos, sum(1 - label) AS neg FROM {src} GROUP BY 1, 2))"""
    if kind == "auroc":
        return f"""SELECT target, round(CASE WHEN max(np) > 0 AND max(nn) > 0 THEN sum(pos * (neg_below + 0.5 * neg)) / (max(np) * max(nn)) END, 6) AS auroc
FROM {tab} GROUP BY target"""
    if kind == "auprc":
        return f"""SELECT target, round(CASE WHEN max(np) > 0 THEN sum(pos / np * tp_cum / (tp_cum + fp_cum)) END, 6) AS auprc
FROM {tab} GROUP BY target"""
    if kind == "brier":
        return f"SELECT target, round(avg(power(score - label, 2)), 6) AS brier FROM {src} GROUP BY target"
    if kind == "bins":
        return f"""SELECT g.target, CAST(g.bin AS INTEGER) AS bin, round(coalesce(b.acc, 0.0), 6) AS accuracy,
       round(coalesce(b.conf, 0.0), 6) AS confidence, round(coalesce(b.c, 0) / g.n, 6) AS weight
FROM (SELECT target, count(*) AS n, unnest(range(0, {K.ECE_BINS})) AS bin FROM {src} GROUP BY target) g
LEFT JOIN (SELECT target, bin, avg(label) AS acc, avg(score) AS conf, count(*) AS c FROM (
    SELECT *, len(list_filter(list_transform(range(0, {K.ECE_BINS + 1}), lambda i: i * {1.0 / K.ECE_BINS}::DOUBLE), lambda e: e <= score)) - 1 AS bin
    FROM {src}) WHERE bin >= 0 AND bin < {K.ECE_BINS} GROUP BY 1, 2) b ON g.target = b.target AND g.bin = b.bin"""
    if kind == "ece":
        return f"""SELECT g.target, round(sum(coalesce(b.c, 0) / g.n * abs(coalesce(b.acc, 0.0) - coalesce(b.conf, 0.0))), 6) AS ece
FROM (SELECT target, count(*) AS n, unnest(range(0, {K.ECE_BINS})) AS bin FROM {src} GROUP BY target) g
LEFT JOIN (SELECT target, bin, avg(label) AS acc, avg(score) AS conf, count(*) AS c FROM (
    SELECT *, len(list_filter(list_transform(range(0, {K.ECE_BINS + 1}), lambda i: i * {1.0 / K.ECE_BINS}::DOUBLE), lambda e: e <= score)) - 1 AS bin
    FROM {src}) WHERE bin >= 0 AND bin < {K.ECE_BINS} GROUP BY 1, 2) b ON g.target = b.target AND g.bin = b.bin
GROUP BY g.target"""
    if kind == "roc":
        return f"""SELECT target, threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr,
       round(sum(coalesce((fpr - pf) * (tpr + pt) / 2, 0)) OVER (PARTITION BY target), 6) AS auc
FROM (SELECT *, lag(fpr) OVER (PARTITION BY target ORDER BY fpr, tpr) AS pf, lag(tpr) OVER (PARTITION BY target ORDER BY fpr, tpr) AS pt
      FROM (SELECT target, score AS threshold, fp_cum / nn AS fpr, tp_cum / np AS tpr FROM {tab} WHERE np > 0 AND nn > 0
            UNION ALL
            SELECT DISTINCT target, CAST(NULL AS DOUBLE), 0.0, 0.0 FROM {tab} WHERE np > 0 AND nn > 0))"""
    raise ValueError(kind)
