"""Registered queries: name -> (DataFrame builder, DuckDB oracle SQL).

Every query reads the driver tables through a bridge (so its work grows with
the tables) and returns a DataFrame whose column names match its oracle SQL.
Floating results are rounded to 6 decimals in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import tokens as T
from ..operators import events as E
from ..operators import stats
from ..session import cut_lineage
from ..sources import bridge
from .oracle_sql import CLINICAL_PREFIX_CASE as CLINICAL_PREFIX_CASE_SQL
from .oracle_sql import assemble
from .timelines import build_for

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def r6(c) -> F.Column:
    return F.round(c, 6)


B1, B2 = "clickstream", "orders"
EV_COLS = ["person_id", "ts", "et", "cid", "value_as_number", "unit_concept_id", "visit_type", "table_rank", "ev_id"]
EV_SQL = ", ".join(EV_COLS)


# --------------------------------------------------------------------------- M1: events
@register("events_unified", assemble(B1, f"SELECT {EV_SQL} FROM ev_all"))
def q_events_unified(spark, sf_dir):
    return build_for(spark, sf_dir, B1).events.select(*EV_COLS)


@register("events_valid_person", assemble(B2, f"SELECT {EV_SQL} FROM ev_known"))
def q_events_valid_person(spark, sf_dir):
    return build_for(spark, sf_dir, B2).known_events.select(*EV_COLS)


FOLDER_TABLES = ["person", "condition_occurrence", "drug_exposure", "procedure_occurrence", "measurement", "observation"]


@register("folder_events", assemble(B1, """
SELECT person_id, CASE WHEN et = 'observation' THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) ELSE ts END AS ts, et, cid, value_as_number,
       unit_concept_id, visit_type, table_rank, ev_id
FROM ev_all WHERE et NOT IN ('admission', 'discharge', 'death')"""))
def q_folder_events(spark, sf_dir):
    """The bridge written as a folder of drifting parts and read back. One part of each table has
    text ids, one stores every integer as a double, and observations have a date column only."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources.omop import read_omop_dir

    root = f"{ensure_checkpoint_dir(spark)}/folder-{uuid.uuid4().hex}"
    for name in FOLDER_TABLES:
        df = bridge.load_bridge(spark, sf_dir, B1).get(name)
        if df is None:
            continue
        if name == "observation":
            df = df.withColumn("observation_date", F.col("observation_datetime").cast("date")).drop("observation_datetime")
        turn = F.coalesce(F.pmod(F.col("person_id"), F.lit(3)), F.lit(0))
        df.where(turn == 0).write.parquet(f"{root}/{name}/part=0")
        df.where(turn == 1).withColumn("person_id", F.col("person_id").cast("string")).write.parquet(f"{root}/{name}/part=1")
        df.where(turn == 2).select(*[F.col(c).cast("double") if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes]) \
            .write.parquet(f"{root}/{name}/part=2")
    return E.build_events(read_omop_dir(spark, root)).select(*EV_COLS)


@register("visit_events", assemble(B2, f"SELECT {EV_SQL} FROM ev_all WHERE et IN ('admission', 'discharge')"))
def q_visit_events(spark, sf_dir):
    return build_for(spark, sf_dir, B2).events.where(F.col("et").isin("admission", "discharge")).select(*EV_COLS)


@register("death_events", assemble(B2, f"SELECT {EV_SQL} FROM ev_all WHERE et = 'death'"))
def q_death_events(spark, sf_dir):
    return build_for(spark, sf_dir, B2).events.where(F.col("et") == "death").select(*EV_COLS)


@register("demographics", assemble(B2, """
SELECT person_id, gender_concept_id, race_concept_id, ethnicity_concept_id, birth_datetime, birth_year FROM demo"""))
def q_demographics(spark, sf_dir):
    d = build_for(spark, sf_dir, B2).demo
    return d.select("person_id", "gender_concept_id", "race_concept_id", "ethnicity_concept_id",
                    "birth_datetime", F.col("birth_year").cast("int").alias("birth_year"))


_ORDER_SQL = ("PARTITION BY person_id ORDER BY ts NULLS FIRST, table_rank NULLS FIRST, ev_id NULLS FIRST, "
              "cid NULLS FIRST, value_as_number NULLS FIRST, unit_concept_id NULLS FIRST")


@register("gap_minutes", assemble(B1, f"""
SELECT person_id, CAST(ev_seq AS INTEGER) AS ev_seq, ts,
       round((epoch_us(ts) - epoch_us(prev_ts)) / 60000000.0, 6) AS gap_minutes
FROM (SELECT *, row_number() OVER w AS ev_seq, lag(ts) OVER w AS prev_ts FROM ev_known WINDOW w AS ({_ORDER_SQL}))"""))
def q_gap_minutes(spark, sf_dir):
    o = E.ordered_events(build_for(spark, sf_dir, B1).event_slices)
    return o.select("person_id", F.col("ev_seq").cast("int"), "ts", r6("gap_minutes").alias("gap_minutes"))


def _gap_case_sql() -> str:
    from .oracle_sql import _gap_case

    return _gap_case("((epoch_us(ts) - epoch_us(prev_ts)) / 60000000.0)")


@register("gap_tokens", assemble(B2, f"""
SELECT token, count(*) AS n_tokens, count(DISTINCT person_id || ':' || CAST(ev_seq AS VARCHAR)) AS n_events FROM (
  SELECT person_id, ev_seq, unnest(g) AS token FROM (
    SELECT person_id, ev_seq, {_gap_case_sql()} AS g
    FROM (SELECT *, row_number() OVER w AS ev_seq, lag(ts) OVER w AS prev_ts FROM ev_known WINDOW w AS ({_ORDER_SQL}))))
GROUP BY token"""))
def q_gap_tokens(spark, sf_dir):
    o = E.ordered_events(build_for(spark, sf_dir, B2).event_slices)
    g = T.gap_tokens("gap_minutes")  # repeats of one token at most, so an event counts once for its first
    return o.select(F.try_element_at(g, F.lit(1)).alias("token"), F.size(g).alias("n")).where("n > 0").groupBy("token").agg(
        F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_events"))


@register("age_year_tokens", assemble(B2, """
SELECT person_id, CAST(age AS INTEGER) AS age, 'AGE_' || CASE WHEN age >= 0 AND age < 100 THEN
         CAST(CAST(floor(age / 5.0) * 5 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(floor(age / 5.0) * 5 + 5 AS BIGINT) AS VARCHAR)
       ELSE '100-120' END AS age_token,
       'YEAR_' || CASE WHEN birth_year IS NULL THEN 'None' ELSE
         CAST(CAST(1970 + floor((birth_year - 1970) / 5.0) * 5 AS BIGINT) AS VARCHAR) || '-' ||
         CAST(CAST(1970 + floor((birth_year - 1970) / 5.0) * 5 + 5 AS BIGINT) AS VARCHAR) END AS year_token
FROM (SELECT *, CASE WHEN birth_year IS NULL THEN 50 ELSE 2025 - birth_year END AS age FROM demo)"""))
def q_age_year_tokens(spark, sf_dir):
    d = build_for(spark, sf_dir, B2).demo
    age = T.age_at(F.lit(2025), F.col("birth_year"))
    return d.select(
        "person_id", age.cast("int").alias("age"),
        F.concat(F.lit("AGE_"), T.age_band(age)).alias("age_token"),
        F.concat(F.lit("YEAR_"), T.year_band("birth_year")).alias("year_token"),
    )


# --------------------------------------------------------------------------- M2: statistics, vocabulary
@register("concept_frequency", assemble(B1, "SELECT et, cid, token, n FROM concept_counts"))
def q_concept_frequency(spark, sf_dir):
    return build_for(spark, sf_dir, B1).concept_counts.select("et", "cid", "token", "n")


_Q_COLS_SQL = ", ".join(f"round(cuts[{i + 1}], 6) AS q{i}" for i in range(K.N_QUANTILES))


@register("measurement_deciles", assemble(B1, f"SELECT cid, n, {_Q_COLS_SQL} FROM cuts"))
def q_measurement_deciles(spark, sf_dir):
    c = build_for(spark, sf_dir, B1).cuts
    return c.select("cid", F.col("n").cast("bigint").alias("n"),
                    *[r6(F.col("cuts")[i]).alias(f"q{i}") for i in range(K.N_QUANTILES)])


@register("decile_assignment", assemble(B1, """
SELECT e.person_id, e.ev_id, e.cid, e.value_as_number,
       CAST(CASE WHEN len(list_filter(c.cuts, lambda x: x < e.value_as_number)) >= 10 THEN 0
            ELSE len(list_filter(c.cuts, lambda x: x < e.value_as_number)) END AS INTEGER) AS decile
FROM ev_known e JOIN cuts c ON e.cid = c.cid
WHERE e.et = 'measurement' AND e.value_as_number IS NOT NULL"""))
def q_decile_assignment(spark, sf_dir):
    b = build_for(spark, sf_dir, B1)
    c = b.cuts.select("cid", "cuts")
    e = b.known_events.where((F.col("et") == "measurement") & F.col("value_as_number").isNotNull())
    return e.join(c, "cid").select(
        "person_id", "ev_id", "cid", "value_as_number",
        T.decile_index("value_as_number", "cuts").cast("int").alias("decile"))


@register("distinct_categories", assemble(B2, "SELECT category, value FROM cat_values"))
def q_distinct_categories(spark, sf_dir):
    b = build_for(spark, sf_dir, B2)
    return b.categories.select("category", "value")


@register("vocabulary", assemble(B1, "SELECT token, token_id FROM vocab"))
def q_vocabulary(spark, sf_dir):
    return build_for(spark, sf_dir, B1).vocab.select("token", "token_id")


SMALL_VOCABULARY = 90


@register("vocabulary_capped", assemble(B1, "SELECT token, token_id FROM vocab").replace(
    f"SELECT {K.VOCAB_SIZE} - ", f"SELECT {SMALL_VOCABULARY} - "))
def q_vocabulary_capped(spark, sf_dir):
    """A capacity that binds, so only the most frequent concepts get an id."""
    b = build_for(spark, sf_dir, B1)
    return V.build_vocabulary(b.categories, b.concept_counts, SMALL_VOCABULARY).select("token", "token_id")


@register("vocabulary_orders", assemble(B2, "SELECT token, token_id FROM vocab"))
def q_vocabulary_orders(spark, sf_dir):
    return build_for(spark, sf_dir, B2).vocab.select("token", "token_id")


# --------------------------------------------------------------------------- M3: tokenizer
@register("timeline_tokens", assemble(B2, "SELECT person_id, pos, token, token_id FROM tokens"))
def q_timeline_tokens(spark, sf_dir):
    return build_for(spark, sf_dir, B2).tokens.select("person_id", "pos", "token", "token_id")


@register("timeline_tokens_skew_safe", assemble(B2, "SELECT person_id, pos, token, token_id FROM tokens"))
def q_timeline_tokens_skew_safe(spark, sf_dir):
    """Z1-Z4 with four times as many slices, so that many persons lie in several; same result as timeline_tokens."""
    b = build_for(spark, sf_dir, B2)
    from ..operators.ranking import slices_for
    from ..operators.tokenize import timeline_tokens

    n = 4 * slices_for(b.events)
    t = timeline_tokens(b.events, b.demo, b.vocab, b.cuts, as_of_year=b.as_of_year, num_partitions=n)
    return t.select("person_id", "pos", "token", "token_id")


@register("timeline_tokens_clickstream", assemble(B1, "SELECT person_id, pos, token, token_id FROM tokens"))
def q_timeline_tokens_clickstream(spark, sf_dir):
    return build_for(spark, sf_dir, B1).tokens.select("person_id", "pos", "token", "token_id")


@register("timeline_arrays", assemble(B2, """
SELECT person_id, CAST(count(*) AS INTEGER) AS n_tokens,
       string_agg(CAST(token_id AS VARCHAR), ',' ORDER BY pos) AS tokens
FROM tokens GROUP BY person_id"""))
def q_timeline_arrays(spark, sf_dir):
    a = build_for(spark, sf_dir, B2).arrays
    return a.select("person_id", "n_tokens", F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens"))


# --------------------------------------------------------------------------- M4: profiles and reports
from ..operators import profile as P  # noqa: E402
from ..operators import vocab as V  # noqa: E402
from ..sources.bridge import concept_tables  # noqa: E402
from .oracle_sql import label_case_sql  # noqa: E402

LENS_SQL = "(SELECT person_id, CAST(count(*) AS INTEGER) AS n_tokens FROM tokens GROUP BY person_id)"


@register("token_frequency", assemble(B2, "SELECT token_id, count(*) AS n FROM tokens GROUP BY token_id"))
def q_token_frequency(spark, sf_dir):
    return P.token_frequency(build_for(spark, sf_dir, B2).tokens)


@register("dataset_profile", assemble(B2, f"""
SELECT count(*) AS num_patients, CAST(sum(n_tokens) AS BIGINT) AS total_tokens,
       round(avg(n_tokens), 6) AS avg_sequence_length, round(quantile_cont(n_tokens, 0.5), 6) AS median_sequence_length,
       min(n_tokens) AS min_sequence_length, max(n_tokens) AS max_sequence_length,
       round(stddev_pop(n_tokens), 6) AS std_sequence_length,
       (SELECT count(DISTINCT token_id) FROM tokens) AS unique_tokens
FROM {LENS_SQL}"""))
def q_dataset_profile(spark, sf_dir):
    d = P.dataset_profile(build_for(spark, sf_dir, B2).tokens)
    return d.select(*[r6(c).alias(c) if c in ("avg_sequence_length", "median_sequence_length", "std_sequence_length")
                      else F.col(c) for c in d.columns])


@register("dataset_top_tokens", assemble(B2, """
SELECT CAST(rk AS INTEGER) AS rank, f.token_id, coalesce(v.token, 'UNKNOWN_' || CAST(f.token_id AS VARCHAR)) AS token, f.n
FROM (SELECT token_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, token_id) AS rk FROM tokens GROUP BY token_id) f
LEFT JOIN vocab v ON v.token_id = f.token_id WHERE rk <= 20"""))
def q_dataset_top_tokens(spark, sf_dir):
    """The 20 most frequent tokens of the dataset profile."""
    b = build_for(spark, sf_dir, B2)
    return P.top_tokens(b.tokens, b.vocab, 20)


@register("length_summary", assemble(B2, f"""
SELECT count(*) AS patients, min(n_tokens) AS min_length, max(n_tokens) AS max_length,
       round(avg(n_tokens), 6) AS mean_length, round(quantile_cont(n_tokens, 0.5), 6) AS median_length,
       round(quantile_cont(n_tokens, 0.1), 6) AS p10, round(quantile_cont(n_tokens, 0.25), 6) AS p25,
       round(quantile_cont(n_tokens, 0.75), 6) AS p75, round(quantile_cont(n_tokens, 0.9), 6) AS p90
FROM {LENS_SQL}"""))
def q_length_summary(spark, sf_dir):
    d = P.length_summary(build_for(spark, sf_dir, B2).tokens)
    return d.select(*[r6(c).alias(c) if c not in ("patients", "min_length", "max_length") else F.col(c)
                      for c in d.columns])


_BUCKET_CASE = ("CASE " + " ".join(f"WHEN n_tokens <= {ub} THEN '{lab}'" for lab, ub in K.LENGTH_BUCKETS)
                + f" ELSE '{K.LENGTH_BUCKET_REST}' END")
_BUCKET_VALUES = ", ".join(f"('{lab}', {i})" for i, lab in enumerate([b for b, _ in K.LENGTH_BUCKETS] + [K.LENGTH_BUCKET_REST]))


@register("length_buckets", assemble(B2, f"""
SELECT b.bucket, CAST(b.bucket_order AS INTEGER) AS bucket_order, CAST(coalesce(c.patients, 0) AS BIGINT) AS patients
FROM (VALUES {_BUCKET_VALUES}) b(bucket, bucket_order)
LEFT JOIN (SELECT {_BUCKET_CASE} AS bucket, count(*) AS patients FROM {LENS_SQL} GROUP BY 1) c ON b.bucket = c.bucket"""))
def q_length_buckets(spark, sf_dir):
    return P.length_buckets(build_for(spark, sf_dir, B2).tokens)


@register("length_histogram", assemble(B2, f"""
SELECT CAST(b.bin AS INTEGER) AS bin, round(m.lo + b.bin * (m.hi - m.lo) / 50.0, 6) AS bin_start,
       round(m.lo + (b.bin + 1) * (m.hi - m.lo) / 50.0, 6) AS bin_end, CAST(coalesce(c.patients, 0) AS BIGINT) AS patients
FROM (SELECT min(n_tokens) AS lo, max(n_tokens) AS hi FROM {LENS_SQL}) m
CROSS JOIN range(0, 50) b(bin)
LEFT JOIN (
  SELECT CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((n_tokens - lo) * 50 / CAST(hi - lo AS DOUBLE)) AS BIGINT), 49) END AS bin,
         count(*) AS patients
  FROM {LENS_SQL} l, (SELECT min(n_tokens) AS lo, max(n_tokens) AS hi FROM {LENS_SQL}) mm GROUP BY 1
) c ON b.bin = c.bin"""))
def q_length_histogram(spark, sf_dir):
    return P.length_histogram(build_for(spark, sf_dir, B2).tokens, bins=50)


_CAT_CASE = "CASE " + " ".join(f"WHEN starts_with(token, '{c}') THEN '{c}'" for c in K.CATEGORIES) + f" ELSE '{K.OTHER_CATEGORY}' END"


@register("vocab_by_category", assemble(B2, f"""
SELECT {_CAT_CASE} AS category, v.token_id, v.token, coalesce(c.n, 0) AS count
FROM vocab v LEFT JOIN (SELECT token_id, count(*) AS n FROM tokens GROUP BY token_id) c ON v.token_id = c.token_id"""))
def q_vocab_by_category(spark, sf_dir):
    b = build_for(spark, sf_dir, B2)
    return P.vocab_report(b.vocab, b.tokens)


@register("patient_top_tokens", assemble(B2, """
SELECT r.person_id, CAST(r.timeline_length AS INTEGER) AS timeline_length, CAST(r.unique_tokens AS INTEGER) AS unique_tokens,
       CAST(r.rnk AS INTEGER) AS rank, coalesce(v.token, 'UNKNOWN_' || CAST(r.token_id AS VARCHAR)) AS token, r.n
FROM (
  SELECT *, sum(n) OVER (PARTITION BY person_id) AS timeline_length, count(*) OVER (PARTITION BY person_id) AS unique_tokens,
         row_number() OVER (PARTITION BY person_id ORDER BY n DESC, first_pos) AS rnk
  FROM (SELECT person_id, token_id, count(*) AS n, min(pos) AS first_pos FROM tokens GROUP BY person_id, token_id)
) r LEFT JOIN vocab v ON r.token_id = v.token_id WHERE r.rnk <= 10"""))
def q_patient_top_tokens(spark, sf_dir):
    b = build_for(spark, sf_dir, B2)
    return P.patient_top_tokens(b.tokens, b.vocab, k=10).withColumn("rank", F.col("rank").cast("int"))


@register("example_timelines", assemble(B2, f"""
SELECT t.person_id, CAST(floor(t.pos / 8) AS INTEGER) AS line_no,
       string_agg(coalesce(v.token, 'UNKNOWN_' || CAST(t.token_id AS VARCHAR)), ', ' ORDER BY t.pos) AS line
FROM tokens t LEFT JOIN vocab v ON t.token_id = v.token_id
WHERE t.pos < 400 AND t.person_id IN (
  SELECT person_id FROM {LENS_SQL} l
  WHERE (EXISTS (SELECT 1 FROM {LENS_SQL} x WHERE x.n_tokens > 100) AND n_tokens > 100)
     OR NOT EXISTS (SELECT 1 FROM {LENS_SQL} x WHERE x.n_tokens > 100)
  ORDER BY CASE WHEN EXISTS (SELECT 1 FROM {LENS_SQL} x WHERE x.n_tokens > 100) THEN 0 ELSE -n_tokens END, person_id
  LIMIT 2)
GROUP BY 1, 2"""))
def q_example_timelines(spark, sf_dir):
    b = build_for(spark, sf_dir, B2)
    return P.example_timelines(b.tokens, b.vocab)


def _concept_ctes() -> str:
    return """
concept_t AS (
  SELECT CAST(p_partkey AS BIGINT) AS concept_id, p_name AS concept_name, p_type AS domain_id, p_brand AS vocabulary_id,
         CAST(p_partkey AS VARCHAR) AS concept_code, CAST(p_size AS VARCHAR) AS concept_class_id,
         CASE WHEN p_partkey % 10 = 0 THEN 'S' END AS standard_concept
  FROM part
),
concept_rel AS (
  SELECT CAST(p_partkey AS BIGINT) AS concept_id_1, CAST(p_partkey - p_partkey % 10 AS BIGINT) AS concept_id_2, 'Maps to' AS relationship_id
  FROM part WHERE p_partkey % 10 BETWEEN 1 AND 8
  UNION ALL
  SELECT CAST(p_partkey AS BIGINT), CAST(p_partkey - p_partkey % 10 + 10 AS BIGINT), 'Maps to' FROM part WHERE p_partkey % 10 = 5
  UNION ALL
  SELECT CAST(p_partkey AS BIGINT), CAST(p_partkey - p_partkey % 10 AS BIGINT), 'Is a' FROM part WHERE p_partkey % 10 = 9
)"""


_REPORT_CODE = "CASE " + " ".join(
    f"WHEN starts_with(token, '{p}') THEN TRY_CAST(CASE WHEN regexp_full_match(substr(split_part(token, '__TABLE_', 1), {len(p) + 1}), '-?[0-9]+') "
    f"THEN substr(split_part(token, '__TABLE_', 1), {len(p) + 1}) END AS BIGINT)"
    for p in K.REPORT_CONCEPT_PREFIXES) + " END"
_REPORT_FILTER = " OR ".join(f"starts_with(token, '{p}')" for p in K.REPORT_CONCEPT_PREFIXES)


def _top_report_sql(include_misc: bool) -> str:
    where = "" if include_misc else f"WHERE {_REPORT_FILTER}"
    return assemble(B2, f"""
SELECT r.token, r.token_id, r.raw_count, round(r.raw_count / greatest(r.total, 1) * 100.0, 6) AS frequency_percent,
       coalesce(c.concept_name, {label_case_sql('r.token')}) AS interpretation,
       r.concept_code, c.concept_name, c.domain_id, c.vocabulary_id, c.concept_class_id
FROM (
  SELECT *, sum(raw_count) OVER () AS total, {_REPORT_CODE} AS concept_code FROM (
    SELECT f.token_id, v.token, f.raw_count FROM (SELECT token_id, count(*) AS raw_count FROM tokens GROUP BY token_id) f
    JOIN vocab v ON f.token_id = v.token_id) {where}
) r LEFT JOIN concept_t c ON r.concept_code = c.concept_id
ORDER BY r.raw_count DESC, r.token_id LIMIT {K.REPORT_TOP_K}""", extra=_concept_ctes())


@register("top_token_report", _top_report_sql(False))
def q_top_token_report(spark, sf_dir):
    b = build_for(spark, sf_dir, B2)
    concept, _ = concept_tables(spark, sf_dir)
    return P.top_token_report(b.tokens, b.vocab, concept, include_misc=False)


@register("top_token_report_all", _top_report_sql(True))
def q_top_token_report_all(spark, sf_dir):
    b = build_for(spark, sf_dir, B2)
    concept, _ = concept_tables(spark, sf_dir)
    return P.top_token_report(b.tokens, b.vocab, concept, include_misc=True)


@register("standard_concepts", assemble(B2, """
SELECT i.concept_id, coalesce(m.concept_id_2, i.concept_id) AS standard_id,
       coalesce(s.concept_name, c.concept_name) AS concept_name, s.concept_name AS standard_concept_name,
       c.domain_id, c.vocabulary_id, c.standard_concept
FROM (SELECT DISTINCT cid AS concept_id FROM concept_counts WHERE et IN ('condition', 'medication', 'procedure')) i
LEFT JOIN (SELECT DISTINCT concept_id_1, concept_id_2 FROM concept_rel WHERE relationship_id = 'Maps to') m ON i.concept_id = m.concept_id_1
LEFT JOIN concept_t c ON i.concept_id = c.concept_id
LEFT JOIN concept_t s ON coalesce(m.concept_id_2, i.concept_id) = s.concept_id""", extra=_concept_ctes()))
def q_standard_concepts(spark, sf_dir):
    b = build_for(spark, sf_dir, B2)
    concept, rel = concept_tables(spark, sf_dir)
    ids = b.concept_counts.where(F.col("et").isin("condition", "medication", "procedure")).select(
        F.col("cid").alias("concept_id"))
    return P.standard_concepts(ids, concept, rel)


# Shrink/remap run on the clickstream bridge with a 150-token budget (FIXTURES).
SHRINK_SIZE = 150


def _shrunk(spark, sf_dir):
    b = build_for(spark, sf_dir, B1)
    counts = V.decode(P.token_frequency(b.tokens), b.vocab, unknown_prefix="UNKNOWN_").select("token", "n")
    return b, V.shrink_vocabulary(b.vocab, counts, SHRINK_SIZE)


_SHRINK_SQL = f"""
sh_counts AS (SELECT v.token, coalesce(c.n, 0) AS n FROM vocab v LEFT JOIN (SELECT token_id, count(*) AS n FROM tokens GROUP BY token_id) c ON v.token_id = c.token_id),
sh_class AS (
  SELECT token, n,
    CASE WHEN token IN ('<PAD>', '<UNK>', '<EOS>', '<SOS>') THEN 0
         WHEN {' OR '.join(f"starts_with(token, '{p}')" for p in K.PRUNABLE_PREFIXES)} THEN 99
         {' '.join(f"WHEN starts_with(token, '{p}') THEN {i + 1}" for i, p in enumerate(K.ALWAYS_KEEP_PREFIXES))}
         ELSE {len(K.ALWAYS_KEEP_PREFIXES) + 1} END AS grp,
    CASE token WHEN '<PAD>' THEN 1 WHEN '<UNK>' THEN 2 WHEN '<EOS>' THEN 3 WHEN '<SOS>' THEN 4 END AS sub
  FROM sh_counts
),
sh_kept AS (
  SELECT token, grp, sub, n FROM sh_class WHERE grp < 99
  UNION ALL
  SELECT token, grp, sub, n FROM (
    SELECT *, row_number() OVER (ORDER BY n DESC, token) AS rn FROM sh_class WHERE grp = 99)
  WHERE rn <= {SHRINK_SIZE} - (SELECT count(*) FROM sh_class WHERE grp < 99)
),
shrunk AS (
  SELECT token, CAST(row_number() OVER (ORDER BY grp, sub NULLS LAST, CASE WHEN grp = 99 THEN -n END NULLS FIRST, token) - 1 AS INTEGER) AS token_id
  FROM sh_kept
)"""


@register("vocab_shrunk", assemble(B1, "SELECT token, token_id FROM shrunk", extra=_SHRINK_SQL))
def q_vocab_shrunk(spark, sf_dir):
    _, s = _shrunk(spark, sf_dir)
    return s


@register("remapped_stats", assemble(B1, """
SELECT count(*) FILTER (WHERE new_id = 1 AND token_id <> 1) AS replaced, count(*) AS total,
       round(100.0 * count(*) FILTER (WHERE new_id = 1 AND token_id <> 1) / count(*), 6) AS pct_replaced
FROM (SELECT t.token_id, coalesce(s.token_id, 1) AS new_id
      FROM tokens t LEFT JOIN vocab v ON t.token_id = v.token_id LEFT JOIN shrunk s ON v.token = s.token)""",
                                       extra=_SHRINK_SQL))
def q_remapped_stats(spark, sf_dir):
    b, s = _shrunk(spark, sf_dir)
    from ..operators.datasets import remap_tokens

    _, stats_df = remap_tokens(b.tokens, b.vocab, s)
    return stats_df


# --------------------------------------------------------------------------- M5: datasets, transitions
from ..operators import datasets as D  # noqa: E402
from ..operators import transitions as R  # noqa: E402

MAX_SEQ_LEN = 32
BATCH_SIZE = 8


def _ids_str(c):
    return F.array_join(F.col(c).cast("array<string>"), ",")


def _md5_sql(*parts: str) -> str:
    return "md5(" + " || '|' || ".join(parts) + ")"


def _md5_int_sql(*parts: str) -> str:
    return f"CAST(('0x' || substr({_md5_sql(*parts)}, 1, 8)) AS BIGINT)"


_DATASET_SQL = f"""
arr AS (SELECT person_id, list(token_id ORDER BY pos) AS toks, CAST(count(*) AS INTEGER) AS n_tokens FROM tokens GROUP BY person_id),
split80 AS (
  SELECT person_id, CASE WHEN rn <= (SELECT round_even(0.8 * count(*), 0) FROM demo) THEN 'train' ELSE 'test' END AS split
  FROM (SELECT person_id, row_number() OVER (ORDER BY {_md5_sql("'42'", "CAST(person_id AS VARCHAR)")}, person_id) AS rn
        FROM (SELECT DISTINCT person_id FROM demo))
),
split90 AS (
  SELECT person_id, CASE WHEN rn <= (SELECT floor(0.9 * count(*)) FROM arr) THEN 'train' ELSE 'val' END AS split
  FROM (SELECT person_id, row_number() OVER (ORDER BY {_md5_sql("'42'", "'val'", "CAST(person_id AS VARCHAR)")}, person_id) AS rn
        FROM arr)
),
examples AS (
  SELECT person_id, n_tokens, CAST(start AS INTEGER) AS start,
         list_slice(toks, start + 1, start + len - 1) AS input_ids, list_slice(toks, start + 2, start + len) AS target_ids
  FROM (SELECT *, CASE WHEN n_tokens > {MAX_SEQ_LEN} THEN {_md5_int_sql("'42'", "CAST(person_id AS VARCHAR)", "'0'")} % (n_tokens - {MAX_SEQ_LEN}) ELSE 0 END AS start,
               least(n_tokens, {MAX_SEQ_LEN}) AS len
        FROM arr WHERE n_tokens > 10)
),
c_lens AS (SELECT person_id, count(*) AS n FROM tokens GROUP BY person_id),
c_offs AS (SELECT person_id, n, coalesce(sum(n + 2) OVER (ORDER BY person_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM c_lens),
corpus AS (
  SELECT o.off + 1 + t.pos AS global_pos, t.token_id FROM tokens t JOIN c_offs o ON t.person_id = o.person_id
  UNION ALL SELECT off, 3 FROM c_offs
  UNION ALL SELECT off + n + 1, 2 FROM c_offs
),
pairs AS (
  SELECT person_id, pos, token_id, lead(token_id) OVER (PARTITION BY person_id ORDER BY pos) AS target_id FROM tokens
),
bi AS (
  SELECT token_id AS prev_id, target_id AS next_id, count(*) AS n,
         count(*) / sum(count(*)) OVER (PARTITION BY token_id) AS prob
  FROM pairs WHERE target_id IS NOT NULL GROUP BY 1, 2
)"""


def _ds(final: str) -> str:
    return assemble(B1, final, extra=_DATASET_SQL)


@register("person_split", assemble(B2, "SELECT person_id, split FROM split80", extra=_DATASET_SQL))
def q_person_split(spark, sf_dir):
    return D.person_split(build_for(spark, sf_dir, B2).demo, 0.8, 42)


def _val_split(b):
    return D.person_split(P.lengths(b.tokens), K.VALIDATION_RATIO, "42|val", rounding="floor", names=("train", "val"))


@register("train_val_split", _ds("SELECT person_id, split FROM split90"))
def q_train_val_split(spark, sf_dir):
    return _val_split(build_for(spark, sf_dir, B1))


@register("next_token_pairs", _ds("SELECT person_id, pos, token_id, target_id FROM pairs WHERE target_id IS NOT NULL"))
def q_next_token_pairs(spark, sf_dir):
    return D.next_token_pairs(build_for(spark, sf_dir, B1).tokens)


@register("capped_slices", _ds("""
SELECT person_id, n_tokens, start, array_to_string(input_ids, ',') AS input_ids, array_to_string(target_ids, ',') AS target_ids
FROM examples"""))
def q_capped_slices(spark, sf_dir):
    b = build_for(spark, sf_dir, B1)
    ex = D.next_token_examples(b.tokens, D.filter_min_length(P.lengths(b.tokens)), MAX_SEQ_LEN, seed=42, epoch=0)
    return ex.select("person_id", "n_tokens", "start", _ids_str("input_ids").alias("input_ids"),
                     _ids_str("target_ids").alias("target_ids"))


@register("corpus_chunks", _ds(f"""
SELECT CAST(floor(global_pos / {MAX_SEQ_LEN}) AS BIGINT) AS chunk_id,
       string_agg(CAST(token_id AS VARCHAR), ',' ORDER BY global_pos) AS tokens
FROM corpus GROUP BY 1"""))
def q_corpus_chunks(spark, sf_dir):
    c = D.corpus_chunks(D.corpus_positions(build_for(spark, sf_dir, B1).tokens), MAX_SEQ_LEN)
    return c.select("chunk_id", _ids_str("tokens").alias("tokens"))


@register("sliding_windows", _ds(f"""
SELECT CAST(s AS BIGINT) AS start, array_to_string(list_slice(a, s + 1, s + {MAX_SEQ_LEN - 1}), ',') AS input_ids,
       array_to_string(list_slice(a, s + 2, s + {MAX_SEQ_LEN}), ',') AS target_ids
FROM (SELECT a, unnest(range(0, len(a) - {MAX_SEQ_LEN})) AS s FROM (SELECT list(token_id ORDER BY global_pos) AS a FROM corpus))"""))
def q_sliding_windows(spark, sf_dir):
    w = D.sliding_windows(D.corpus_positions(build_for(spark, sf_dir, B1).tokens), MAX_SEQ_LEN)
    return w.select("start", _ids_str("input_ids").alias("input_ids"), _ids_str("target_ids").alias("target_ids"))


@register("padded_batches", _ds(f"""
SELECT CAST(floor(rk / {BATCH_SIZE}) AS BIGINT) AS batch_id, CAST(rk % {BATCH_SIZE} AS INTEGER) AS slot, person_id,
       CAST(len(input_ids) AS INTEGER) AS n_real,
       array_to_string(list_concat(input_ids, list_transform(range(mx - len(input_ids)), lambda x: 0)), ',') AS input_ids,
       array_to_string(list_concat(target_ids, list_transform(range(mx - len(target_ids)), lambda x: 0)), ',') AS target_ids
FROM (
  SELECT *, max(len(input_ids)) OVER (PARTITION BY floor(rk / {BATCH_SIZE})) AS mx FROM (
    SELECT e.*, row_number() OVER (ORDER BY {_md5_sql("'42'", "CAST(e.person_id AS VARCHAR)", "CAST(e.start AS VARCHAR)")}, e.person_id) - 1 AS rk,
           count(*) OVER () AS n_ex
    FROM examples e JOIN split90 s ON e.person_id = s.person_id WHERE s.split = 'train')
  WHERE rk < floor(n_ex / {BATCH_SIZE}) * {BATCH_SIZE})"""))
def q_padded_batches(spark, sf_dir):
    b = build_for(spark, sf_dir, B1)
    train = _val_split(b).where(F.col("split") == "train").select("person_id")
    ex = D.next_token_examples(b.tokens, D.filter_min_length(P.lengths(b.tokens)).join(train, "person_id", "left_semi"),
                               MAX_SEQ_LEN, seed=42, epoch=0)
    out = D.batches(ex, BATCH_SIZE, seed=42, shuffle=True, drop_last=True)
    return out.select("batch_id", "slot", "person_id", "n_real", _ids_str("input_ids").alias("input_ids"),
                      _ids_str("target_ids").alias("target_ids"))


@register("bigrams", _ds("SELECT prev_id, next_id, n, round(prob, 6) AS prob FROM bi"))
def q_bigrams(spark, sf_dir):
    bi = R.bigrams(build_for(spark, sf_dir, B1).tokens)
    return bi.select("prev_id", "next_id", "n", r6("prob").alias("prob"))


@register("top_k_p", _ds("""
SELECT prev_id, next_id, CAST(rk AS INTEGER) AS rank, round(p_k / sum(p_k) OVER (PARTITION BY prev_id), 6) AS p_final FROM (
  SELECT *, coalesce(sum(p_k) OVER (PARTITION BY prev_id ORDER BY prob DESC, next_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT *, prob / sum(prob) OVER (PARTITION BY prev_id) AS p_k FROM (
          SELECT *, row_number() OVER (PARTITION BY prev_id ORDER BY prob DESC, next_id) AS rk FROM bi) WHERE rk <= 5))
WHERE rk = 1 OR before <= 0.9"""))
def q_top_k_p(spark, sf_dir):
    t = R.top_k_top_p(R.bigrams(build_for(spark, sf_dir, B1).tokens), k=5, p=0.9)
    return t.select("prev_id", "next_id", F.col("rank").cast("int"), r6("p_final").alias("p_final"))


@register("sequence_logprob", _ds("""
SELECT p.person_id, round(sum(ln(b.prob)), 6) AS logprob, count(*) AS n_pairs
FROM pairs p LEFT JOIN bi b ON p.token_id = b.prev_id AND p.target_id = b.next_id
WHERE p.target_id IS NOT NULL GROUP BY p.person_id"""))
def q_sequence_logprob(spark, sf_dir):
    b = build_for(spark, sf_dir, B1)
    s = R.sequence_logprob(b.tokens, R.bigrams(b.tokens))
    return s.select("person_id", r6("logprob").alias("logprob"), "n_pairs")


@register("greedy_next", _ds("""
SELECT prev_id, next_id, round(prob, 6) AS prob FROM (
  SELECT *, row_number() OVER (PARTITION BY prev_id ORDER BY prob DESC, next_id) AS rk FROM bi) WHERE rk = 1"""))
def q_greedy_next(spark, sf_dir):
    g = R.greedy_next(R.bigrams(build_for(spark, sf_dir, B1).tokens))
    return g.select("prev_id", "next_id", r6("prob").alias("prob"))


@register("val_cross_entropy", _ds("""
SELECT count(*) AS n_pairs, round(avg(-ln((coalesce(c.n, 0) + 1.0) / (coalesce(np.n_prev, 0) + (SELECT count(*) FROM vocab)))), 6) AS cross_entropy
FROM (SELECT p.token_id AS prev_id, p.target_id AS next_id FROM pairs p JOIN split90 s ON p.person_id = s.person_id
      WHERE s.split = 'val' AND p.target_id IS NOT NULL AND p.target_id <> 0) e
LEFT JOIN (SELECT p.token_id AS prev_id, p.target_id AS next_id, count(*) AS n FROM pairs p JOIN split90 s ON p.person_id = s.person_id
           WHERE s.split = 'train' AND p.target_id IS NOT NULL GROUP BY 1, 2) c ON e.prev_id = c.prev_id AND e.next_id = c.next_id
LEFT JOIN (SELECT p.token_id AS prev_id, count(*) AS n_prev FROM pairs p JOIN split90 s ON p.person_id = s.person_id
           WHERE s.split = 'train' AND p.target_id IS NOT NULL GROUP BY 1) np ON e.prev_id = np.prev_id"""))
def q_val_cross_entropy(spark, sf_dir):
    b = build_for(spark, sf_dir, B1)
    sp = _val_split(b)
    train = b.tokens.join(sp.where(F.col("split") == "train").select("person_id"), "person_id", "left_semi")
    val = b.tokens.join(sp.where(F.col("split") == "val").select("person_id"), "person_id", "left_semi")
    ce = R.cross_entropy(val, train, vocab_size=b.vocab.count(), alpha=1.0)
    return ce.select("n_pairs", r6("cross_entropy").alias("cross_entropy"))


# --------------------------------------------------------------------------- M6: labels and evaluation
from ..operators import evaluate as EV  # noqa: E402
from ..operators import labels as L  # noqa: E402
from .evaluation import EvalContext, eval_sql, metric_sql  # noqa: E402

EVAL_CUT, EVAL_H, N_SIMS, N_TARGETS, PATIENT_LIMIT, READMIT_DAYS = "2000-01-01 00:00:00", 365, 10, 3, 100, 30
_EVAL_CTX: dict = {}


def _ctx(spark, sf_dir) -> EvalContext:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _EVAL_CTX:
        _EVAL_CTX[key] = EvalContext(build_for(spark, sf_dir, B2), EVAL_CUT, EVAL_H, N_SIMS, N_TARGETS,
                                     PATIENT_LIMIT, READMIT_DAYS)
    return _EVAL_CTX[key]


_EVAL_EXTRA = eval_sql(EVAL_CUT, EVAL_H, N_SIMS, N_TARGETS, PATIENT_LIMIT, READMIT_DAYS)


def _ev(final: str, extra: str = "") -> str:
    return assemble(B2, final, extra=_EVAL_EXTRA + ("," + extra if extra else ""), tok_events="ev_future", tok_demo="demo_fut")


_IDX_SQL = f"""
idx_rows AS (SELECT *, row_number() OVER (w) - 1 AS rn, count(*) OVER (PARTITION BY person_id) AS n,
                    min(ts) OVER (PARTITION BY person_id) AS first_ts, max(ts) OVER (PARTITION BY person_id) AS last_ts
             FROM ev_known WINDOW w AS ({_ORDER_SQL})),
idx_end AS (
  SELECT person_id, CASE WHEN last_ts - INTERVAL {EVAL_H} DAY <= first_ts THEN ts ELSE last_ts - INTERVAL {EVAL_H} DAY END AS index_time
  FROM idx_rows WHERE rn = n // 2
),
idx_random AS (
  SELECT f.person_id, coalesce(p.ts, f.first_ts) AS index_time
  FROM (SELECT DISTINCT person_id, first_ts FROM idx_rows) f
  LEFT JOIN (SELECT person_id, ts FROM (
      SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY md5('42|' || CAST(person_id AS VARCHAR) || '|' || CAST(rn AS VARCHAR)), rn) AS pr
      FROM idx_rows WHERE ts + INTERVAL {EVAL_H} DAY <= last_ts) WHERE pr = 1) p ON f.person_id = p.person_id
),
ev_hist AS (SELECT e.* FROM ev_all e JOIN idx_end i ON e.person_id = i.person_id WHERE e.ts <= i.index_time),
demo_idx AS (SELECT d.*, i.index_time FROM demo d JOIN idx_end i ON d.person_id = i.person_id)"""


@register("index_time_end", assemble(B2, "SELECT person_id, index_time FROM idx_end", extra=_IDX_SQL))
def q_index_time_end(spark, sf_dir):
    return L.index_time_end_minus_horizon(build_for(spark, sf_dir, B2).event_slices, EVAL_H)


@register("index_time_random", assemble(B2, "SELECT person_id, index_time FROM idx_random", extra=_IDX_SQL))
def q_index_time_random(spark, sf_dir):
    return L.index_time_random(build_for(spark, sf_dir, B2).event_slices, EVAL_H, seed=42)


@register("index_time_first", assemble(B2, "SELECT person_id, min(ts) AS index_time FROM ev_known GROUP BY person_id"))
def q_index_time_first(spark, sf_dir):
    return L.index_time_first(build_for(spark, sf_dir, B2).known_events)


@register("history_tokens", assemble(
    B2, "SELECT person_id, pos, token, token_id FROM tokens", extra=_IDX_SQL, tok_events="ev_hist", tok_demo="demo_idx",
    age_expr="CASE WHEN birth_year IS NULL THEN 50 ELSE greatest(0, year(index_time) - birth_year) END"))
def q_history_tokens(spark, sf_dir):
    b = build_for(spark, sf_dir, B2)
    idx = L.index_time_end_minus_horizon(b.event_slices, EVAL_H)
    return L.history_tokens(b.tokens, cut_lineage(idx), b.demo, b.vocab)


@register("history_tail", _ev(f"""
SELECT person_id, CAST(row_number() OVER (PARTITION BY person_id ORDER BY from_end DESC) - 1 AS INTEGER) AS pos, token, token_id
FROM (
  SELECT h.person_id, h.from_end, v.token, v.token_id
  FROM (SELECT *, {CLINICAL_PREFIX_CASE_SQL} || CAST(cid AS VARCHAR) AS name,
               row_number() OVER (PARTITION BY person_id ORDER BY ts DESC NULLS LAST, table_rank DESC NULLS LAST, ev_id DESC NULLS LAST,
                                  cid DESC NULLS LAST, value_as_number DESC NULLS LAST, unit_concept_id DESC NULLS LAST) AS from_end
        FROM ev_cur WHERE person_id IN (SELECT person_id FROM overlap)) h
  JOIN vocab v ON v.token = h.name WHERE h.from_end <= {K.HISTORY_TAIL_EVENTS})
UNION ALL
SELECT o.person_id, CAST(coalesce(c.n, 0) AS INTEGER), '<EOS>', 2
FROM overlap o LEFT JOIN (
  SELECT h.person_id, count(*) AS n
  FROM (SELECT *, {CLINICAL_PREFIX_CASE_SQL} || CAST(cid AS VARCHAR) AS name,
               row_number() OVER (PARTITION BY person_id ORDER BY ts DESC NULLS LAST, table_rank DESC NULLS LAST, ev_id DESC NULLS LAST,
                                  cid DESC NULLS LAST, value_as_number DESC NULLS LAST, unit_concept_id DESC NULLS LAST) AS from_end
        FROM ev_cur WHERE person_id IN (SELECT person_id FROM overlap)) h
  JOIN vocab v ON v.token = h.name WHERE h.from_end <= {K.HISTORY_TAIL_EVENTS} GROUP BY 1) c ON o.person_id = c.person_id"""))
def q_history_tail(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    cur = c.current.join(c.overlap, "person_id", "left_semi")
    idx = cur.groupBy("person_id").agg(F.max("ts").alias("index_time"))
    return L.history_tail(cur, idx, c.b.vocab)


@register("overlap_patients", _ev("SELECT person_id FROM overlap"))
def q_overlap_patients(spark, sf_dir):
    return _ctx(spark, sf_dir).overlap


@register("target_ids", _ev("""
SELECT DISTINCT token, token_id FROM vocab
WHERE token IN (SELECT target FROM targets) OR regexp_matches(token, '^DRUG_EXPOSURE_1[0-9]$')"""))
def q_target_ids(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    return V.resolve_targets(c.b.vocab, c.targets, r"^DRUG_EXPOSURE_1[0-9]$")


@register("target_variants", assemble(B2, f"""
SELECT DISTINCT token, variant FROM (
  SELECT token, unnest({__import__('chronotok.plans.evaluation', fromlist=['x'])._variants_sql('token')}) AS variant FROM vocab)
WHERE variant IS NOT NULL"""))
def q_target_variants(spark, sf_dir):
    v = build_for(spark, sf_dir, B2).vocab
    return v.select("token", F.explode(T.target_variants("token")).alias("variant"))


@register("label_inclusive", _ev(f"""
SELECT i.person_id, CAST(max(CASE WHEN f.ts >= i.index_time AND f.ts <= i.index_time + INTERVAL {EVAL_H} DAY
                                 AND f.et IN ('condition', 'medication', 'procedure', 'measurement')
                                 AND {CLINICAL_PREFIX_CASE_SQL.replace('CASE et', 'CASE f.et')} || CAST(f.cid AS VARCHAR) IN (SELECT target FROM targets)
                            THEN 1 ELSE 0 END) AS INTEGER) AS label
FROM idx_cur i LEFT JOIN ev_future f ON f.person_id = i.person_id GROUP BY i.person_id"""))
def q_label_inclusive(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    cur = c.current.join(c.overlap, "person_id", "left_semi")
    idx = cur.groupBy("person_id").agg(F.max("ts").alias("index_time"))
    return L.label_in_window(c.future, idx, EVAL_H, target_tokens=c.targets, include_start=True)


@register("truth_events", _ev("SELECT person_id, ts, token FROM truth"))
def q_truth_events(spark, sf_dir):
    return _ctx(spark, sf_dir).truth


@register("label_by_target", _ev("""
SELECT o.person_id, t.target, CAST(CASE WHEN h.person_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS label
FROM overlap o CROSS JOIN targets t
LEFT JOIN (SELECT DISTINCT tr.person_id, tv.target FROM truth tr JOIN target_var tv ON tr.token = tv.variant) h
  ON h.person_id = o.person_id AND h.target = t.target"""))
def q_label_by_target(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    tv = L.target_table(spark, c.targets)
    hits = c.truth.join(F.broadcast(tv), c.truth["token"] == tv["variant"]).select("person_id", "target").distinct()
    grid = c.overlap.withColumn("target", F.explode(F.array(*[F.lit(t) for t in c.targets])))
    return grid.join(hits.withColumn("label", F.lit(1)), ["person_id", "target"], "left").select(
        "person_id", "target", F.coalesce("label", F.lit(0)).cast("int").alias("label"))


@register("label_from_sequence", _ev("SELECT person_id, target, label FROM seq_labels"))
def q_label_from_sequence(spark, sf_dir):
    return _ctx(spark, sf_dir).seq_labels


@register("sim_events", _ev("SELECT person_id, sim_id, CAST(pos AS INTEGER) AS pos, token, CAST(minutes AS BIGINT) AS minutes FROM sim_ev"))
def q_sim_events(spark, sf_dir):
    s = _ctx(spark, sf_dir).sim_ev
    return s.select("person_id", "sim_id", F.col("pos").cast("int"), "token", F.col("minutes").cast("bigint"))


@register("sim_token_prob", _ev(f"SELECT person_id, token, round(count(DISTINCT sim_id) / {float(N_SIMS)}, 6) AS prob FROM sim_ev GROUP BY 1, 2"))
def q_sim_token_prob(spark, sf_dir):
    p = EV.sim_token_prob(_ctx(spark, sf_dir).sim_ev, N_SIMS)
    return p.select("person_id", "token", r6("prob").alias("prob"))


@register("sim_target_prob", _ev("SELECT person_id, target, round(prob, 6) AS prob FROM sim_tprob"))
def q_sim_target_prob(spark, sf_dir):
    p = _ctx(spark, sf_dir).sim_tprob
    return p.select("person_id", "target", r6("prob").alias("prob"))


_SET_SQL = """
set_pp AS (
  SELECT o.person_id, coalesce(c.tp, 0) AS tp, coalesce(c.fp, 0) AS fp, coalesce(c.fn, 0) AS fn
  FROM overlap o LEFT JOIN (
    SELECT person_id, sum(p * t) AS tp, sum(p * (1 - t)) AS fp, sum((1 - p) * t) AS fn FROM (
      SELECT coalesce(a.person_id, b.person_id) AS person_id, CASE WHEN a.person_id IS NULL THEN 0 ELSE 1 END AS p,
             CASE WHEN b.person_id IS NULL THEN 0 ELSE 1 END AS t
      FROM (SELECT DISTINCT person_id, token FROM sim_ev WHERE person_id IN (SELECT person_id FROM overlap)) a
      FULL OUTER JOIN (SELECT DISTINCT person_id, token FROM truth) b ON a.person_id = b.person_id AND a.token = b.token)
    GROUP BY person_id) c ON o.person_id = c.person_id
),
set_m AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
         CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0.0 END AS jaccard
  FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
               CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM set_pp)
)"""


def _set_metrics_df(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    pred = c.sim_ev.join(c.overlap, "person_id", "left_semi")
    return EV.set_metrics(pred, c.truth, c.overlap)


@register("set_metrics", assemble(B2, """
SELECT person_id, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1, round(jaccard, 6) AS jaccard FROM set_m""",
                                  extra=_EVAL_EXTRA + "," + _SET_SQL, tok_events="ev_future", tok_demo="demo_fut"))
def q_set_metrics(spark, sf_dir):
    m = _set_metrics_df(spark, sf_dir)
    return m.select("person_id", "tp", "fp", "fn", *[r6(x).alias(x) for x in ("precision", "recall", "f1", "jaccard")])


@register("micro_metrics", assemble(B2, """
SELECT count(*) AS n_patients,
       round(CASE WHEN sum(tp) + sum(fp) > 0 THEN sum(tp) / (sum(tp) + sum(fp)) ELSE 0.0 END, 6) AS precision_micro,
       round(CASE WHEN sum(tp) + sum(fn) > 0 THEN sum(tp) / (sum(tp) + sum(fn)) ELSE 0.0 END, 6) AS recall_micro,
       round(CASE WHEN sum(tp) > 0 THEN 2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) ELSE 0.0 END, 6) AS f1_micro,
       round(coalesce(avg(jaccard), 0.0), 6) AS jaccard_mean FROM set_m""",
                                    extra=_EVAL_EXTRA + "," + _SET_SQL, tok_events="ev_future", tok_demo="demo_fut"))
def q_micro_metrics(spark, sf_dir):
    m = EV.micro_metrics(_set_metrics_df(spark, sf_dir))
    return m.select("n_patients", *[r6(x).alias(x) for x in ("precision_micro", "recall_micro", "f1_micro", "jaccard_mean")])


@register("balanced_cohort", _ev("SELECT person_id FROM cohort"))
def q_balanced_cohort(spark, sf_dir):
    return _ctx(spark, sf_dir).cohort


@register("prevalence", _ev("""
SELECT target, CAST(sum(label) AS BIGINT) AS positives, count(*) AS total FROM seq_labels
WHERE person_id IN (SELECT person_id FROM cohort) GROUP BY target"""))
def q_prevalence(spark, sf_dir):
    c = _ctx(spark, sf_dir)
    return EV.prevalence(c.seq_labels.join(c.cohort, "person_id", "left_semi"))


def _metric(name, fn, col, kind=None, src="scored"):
    @register(name, _ev(metric_sql(src, kind or name)))
    def q(spark, sf_dir):
        c = _ctx(spark, sf_dir)
        df = fn(c.scored if src == "scored" else c.scored_all, ["target"])
        return df.select("target", *[F.col(c).cast("int") if c == "bin" else F.col(c) if c == "threshold" else r6(c).alias(c)
                                     for c in col])

    return q


# rank metrics of the balanced cohort (E10); precision and calibration over every evaluated person
_metric("auroc", EV.auroc, ["auroc"])
_metric("roc_points", EV.roc_points, ["threshold", "fpr", "tpr", "auc"], "roc")
_metric("auprc", EV.auprc, ["auprc"], src="scored_all")
_metric("brier", EV.brier, ["brier"], src="scored_all")
_metric("ece", EV.ece, ["ece"], src="scored_all")
_metric("calibration_bins", EV.calibration_bins, ["bin", "accuracy", "confidence", "weight"], "bins", src="scored_all")


@register("tte_metrics", _ev("""
SELECT (SELECT count(*) FROM tte_scored) AS n_patients, a.auroc, p.auprc, b.brier, e.ece AS ece_10
FROM (""" + metric_sql("tte_scored", "auroc") + """) a
JOIN (""" + metric_sql("tte_scored", "auprc") + """) p ON a.target = p.target
JOIN (""" + metric_sql("tte_scored", "brier") + """) b ON a.target = b.target
JOIN (""" + metric_sql("tte_scored", "ece") + """) e ON a.target = e.target"""))
def q_tte_metrics(spark, sf_dir):
    scored = _ctx(spark, sf_dir).tte_scored
    n = scored.agg(F.count(F.lit(1)).alias("n_patients"), F.lit("any").alias("target"))
    out = n.join(EV.auroc(scored, ["target"]), "target").join(EV.auprc(scored, ["target"]), "target").join(
        EV.brier(scored, ["target"]), "target").join(EV.ece(scored, ["target"]), "target")
    return out.select("n_patients", r6("auroc").alias("auroc"), r6("auprc").alias("auprc"), r6("brier").alias("brier"),
                      r6("ece").alias("ece_10"))


@register("mortality_prob", _ev("SELECT person_id, round(prob, 6) AS prob FROM mortality"))
def q_mortality_prob(spark, sf_dir):
    p = EV.first_of(_ctx(spark, sf_dir).sims, ["EVENT_DEATH"], [], None, N_SIMS, seq=_ctx(spark, sf_dir).sim_seq)
    return p.select("person_id", r6("prob").alias("prob"))


@register("readmission_prob", _ev(f"""
SELECT p.person_id, round(coalesce(k.k, 0) / {float(N_SIMS)}, 6) AS prob
FROM (SELECT DISTINCT person_id FROM sims) p
LEFT JOIN (SELECT person_id, count(*) AS k FROM first_hits WHERE readmit = 1 GROUP BY 1) k ON p.person_id = k.person_id"""))
def q_readmission_prob(spark, sf_dir):
    p = EV.first_of(_ctx(spark, sf_dir).sims, ["EVENT_ADMISSION"], ["EVENT_DEATH"], READMIT_DAYS * 1440.0, N_SIMS,
                    seq=_ctx(spark, sf_dir).sim_seq)
    return p.select("person_id", r6("prob").alias("prob"))


@register("length_of_stay", _ev("""
SELECT person_id, round(avg(m / 1440.0), 6) AS los_days, count(*) AS n_sims FROM (
  SELECT person_id, sim_id, arg_min(token, pos) AS first_tok, arg_min(cum_minutes, pos) AS m
  FROM sim_seq WHERE eos_before = 0 AND token IN ('EVENT_DISCHARGE', 'EVENT_DEATH') GROUP BY 1, 2)
WHERE first_tok = 'EVENT_DISCHARGE' GROUP BY person_id"""))
def q_length_of_stay(spark, sf_dir):
    p = EV.length_of_stay(_ctx(spark, sf_dir).sims, seq=_ctx(spark, sf_dir).sim_seq)
    return p.select("person_id", r6("los_days").alias("los_days"), "n_sims")


@register("los_mae", _ev("""
SELECT count(*) AS n_patients, round(avg(abs(p.los - t.los)), 6) AS mae
FROM (SELECT person_id, avg(m / 1440.0) AS los FROM (
        SELECT person_id, sim_id, arg_min(token, pos) AS first_tok, arg_min(cum_minutes, pos) AS m
        FROM sim_seq WHERE eos_before = 0 AND token IN ('EVENT_DISCHARGE', 'EVENT_DEATH') GROUP BY 1, 2)
      WHERE first_tok = 'EVENT_DISCHARGE' GROUP BY person_id) p
JOIN (SELECT a.person_id, avg((epoch_us(d.ts) - epoch_us(a.ts)) / 86400000000.0) AS los
      FROM ev_future a JOIN ev_future d ON a.ev_id = d.ev_id AND d.et = 'discharge'
      WHERE a.et = 'admission' AND d.ts >= a.ts GROUP BY a.person_id) t ON t.person_id = p.person_id"""))
def q_los_mae(spark, sf_dir):
    """Mean absolute error of the simulated length of stay against the person's own later stays."""
    c = _ctx(spark, sf_dir)
    pred = EV.length_of_stay(c.sims, seq=c.sim_seq)
    truth = stats.stays(c.future).groupBy("person_id").agg(F.avg("los_days").alias("los_days"))
    m = EV.mean_absolute_error(pred, truth, "los_days")
    return m.select("n_patients", r6("mae").alias("mae"))


@register("cohort_summary", _ev("SELECT count(*) AS n_patients, round(avg(prob), 6) AS mean, round(stddev_pop(prob), 6) AS std FROM mortality"))
def q_cohort_summary(spark, sf_dir):
    p = EV.first_of(_ctx(spark, sf_dir).sims, ["EVENT_DEATH"], [], None, N_SIMS, seq=_ctx(spark, sf_dir).sim_seq)
    s = EV.cohort_summary(p)
    return s.select("n_patients", r6("mean").alias("mean"), r6("std").alias("std"))


# --------------------------------------------------------------------------- M7: source repair
from ..sources import repair as RP  # noqa: E402
from ..sources.bridge import read_table  # noqa: E402

_DIRTY_COLS = ["c_days", "c_secs", "c_millis", "c_iso", "c_mixed", "c_null"]


def _dirty_dates(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    d = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return o.select(
        "o_orderkey",
        d.cast("string").alias("c_days"),
        (d * 86400).cast("string").alias("c_secs"),
        (d * 86400000).cast("string").alias("c_millis"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("c_iso"),
        F.when(F.col("o_orderkey") % 3 == 0, d.cast("string")).otherwise(F.lit("n/a")).alias("c_mixed"),
        F.lit(None).cast("string").alias("c_null"),
    )


def _repair_sql() -> str:
    def readings(c):
        num = f"(CASE WHEN regexp_full_match({c}, '\\s*[-+]?[0-9]*\\.?[0-9]+([eE][-+]?[0-9]+)?\\s*') THEN TRY_CAST({c} AS DOUBLE) END)"
        out = {}
        for unit, ns, us in (("days", 86400e9, 86400e6), ("seconds", 1e9, 1e6), ("millis", 1e6, 1e3)):
            out[unit] = f"(CASE WHEN abs({num} * {ns}) < 9.223372036854775e18 THEN make_timestamp(CAST({num} * {us} AS BIGINT)) END)"
        out["string"] = f"(CASE WHEN {num} IS NULL THEN TRY_CAST({c} AS TIMESTAMP) END)"
        return out

    sel = []
    for c in _DIRTY_COLS:
        r = readings(c)
        whens = " ".join(f"WHEN (SELECT count({r[k]}) FROM dirty) > 0 THEN {r[k]}" for k in RP.STRATEGIES)
        sel.append(f"CASE {whens} ELSE NULL END AS {c}" if c != "c_null" else f"{c}")
    return f"""
WITH dirty AS (
  SELECT o_orderkey, CAST(d AS VARCHAR) AS c_days, CAST(d * 86400 AS VARCHAR) AS c_secs, CAST(d * 86400000 AS VARCHAR) AS c_millis,
         strftime(o_orderdate, '%Y-%m-%d') AS c_iso, CASE WHEN o_orderkey % 3 = 0 THEN CAST(d AS VARCHAR) ELSE 'n/a' END AS c_mixed,
         CAST(NULL AS VARCHAR) AS c_null
  FROM (SELECT *, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS d FROM orders)
)
SELECT o_orderkey, {', '.join(sel)} FROM dirty"""


@register("date_repair", _repair_sql())
def q_date_repair(spark, sf_dir):
    return RP.repair_dates(_dirty_dates(spark, sf_dir), _DIRTY_COLS)


@register("type_coercion", """
SELECT TRY_CAST(CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS BIGINT) AS measurement_id,
       TRY_CAST(CAST(l_orderkey AS VARCHAR) AS BIGINT) AS person_id,
       TRY_CAST(strftime(l_shipdate, '%Y-%m-%d') AS TIMESTAMP) AS measurement_date,
       TRY_CAST(CASE WHEN l_linenumber = 7 THEN 'x' ELSE CAST(l_extendedprice AS VARCHAR) END AS DOUBLE) AS value_as_number,
       'SRC-' || CAST(l_partkey AS VARCHAR) AS measurement_source_value,
       TRY_CAST(CAST(l_suppkey AS VARCHAR) AS BIGINT) AS unit_concept_id,
       l_returnflag AS range_flag
FROM lineitem""")
def q_type_coercion(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    raw = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("measurement_id"),
        F.col("l_orderkey").cast("string").alias("person_id"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("measurement_date"),
        F.when(F.col("l_linenumber") == 7, F.lit("x")).otherwise(F.col("l_extendedprice").cast("string")).alias("value_as_number"),
        F.concat(F.lit("SRC-"), F.col("l_partkey").cast("string")).alias("measurement_source_value"),
        F.col("l_suppkey").cast("string").alias("unit_concept_id"),
        F.col("l_returnflag").alias("range_flag"),
    )
    return RP.coerce_types(raw, "measurement")


# --------------------------------------------------------------------------- more inventory rows
@register("event_span", assemble(B2, "SELECT person_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events FROM ev_known GROUP BY person_id"))
def q_event_span(spark, sf_dir):
    """first/last event time and event count per person."""
    return L.event_span(build_for(spark, sf_dir, B2).known_events)


@register("first_patients", assemble(B2, "SELECT person_id, n_tokens FROM (SELECT person_id, CAST(count(*) AS INTEGER) AS n_tokens FROM tokens GROUP BY person_id) ORDER BY person_id LIMIT 100"))
def q_first_patients(spark, sf_dir):
    """The first N patients by id (a deterministic patient limit; the limit is the feature)."""
    return P.lengths(build_for(spark, sf_dir, B2).tokens).orderBy("person_id").limit(100)


@register("coverage_counts", assemble(B2, """
SELECT 'vocabulary' AS item, count(*) AS n FROM vocab
UNION ALL SELECT 'concept_tokens', count(*) FROM vocab WHERE token LIKE 'CONDITION_OCCURRENCE_%' OR token LIKE 'DRUG_EXPOSURE_%'
  OR token LIKE 'PROCEDURE_OCCURRENCE_%' OR token LIKE 'MEASUREMENT_%' OR token LIKE 'OBSERVATION_%'
UNION ALL SELECT 'concepts_with_name', count(*) FROM (SELECT DISTINCT cid FROM concept_counts WHERE et IN ('condition', 'medication', 'procedure')) c
  WHERE c.cid IN (SELECT concept_id FROM concept_t)
UNION ALL SELECT 'split_' || split, count(*) FROM split80 GROUP BY split
UNION ALL SELECT 'decile_concepts', count(*) FROM cuts""", extra=_concept_ctes() + "," + _DATASET_SQL))
def q_coverage_counts(spark, sf_dir):
    """Artifact sizes, mapped concepts and split sizes."""
    b = build_for(spark, sf_dir, B2)
    concept, _ = concept_tables(spark, sf_dir)
    concept_pref = None
    for p in K.CONCEPT_PREFIX.values():
        c = F.col("token").startswith(p)
        concept_pref = c if concept_pref is None else concept_pref | c
    ids = b.concept_counts.where(F.col("et").isin("condition", "medication", "procedure")).select(
        F.col("cid").alias("concept_id")).distinct()
    named = ids.join(concept.select("concept_id"), "concept_id", "left_semi")
    sp = D.person_split(b.demo, 0.8, 42).groupBy(F.concat(F.lit("split_"), F.col("split")).alias("item")).agg(
        F.count(F.lit(1)).alias("n"))
    parts = [
        b.vocab.agg(F.lit("vocabulary").alias("item"), F.count(F.lit(1)).alias("n")),
        b.vocab.where(concept_pref).agg(F.lit("concept_tokens").alias("item"), F.count(F.lit(1)).alias("n")),
        named.agg(F.lit("concepts_with_name").alias("item"), F.count(F.lit(1)).alias("n")),
        sp,
        b.cuts.agg(F.lit("decile_concepts").alias("item"), F.count(F.lit(1)).alias("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("inpatient_mortality_prob", _ev(f"""
SELECT p.person_id, round(coalesce(k.k, 0) / {float(N_SIMS)}, 6) AS prob
FROM (SELECT DISTINCT person_id FROM sims) p
LEFT JOIN (SELECT person_id, count(*) AS k FROM (
    SELECT person_id, sim_id, arg_min(token, pos) AS first_tok FROM sim_seq
    WHERE eos_before = 0 AND token IN ('EVENT_DEATH', 'EVENT_DISCHARGE') GROUP BY 1, 2) WHERE first_tok = 'EVENT_DEATH' GROUP BY 1) k
  ON p.person_id = k.person_id"""))
def q_inpatient_mortality_prob(spark, sf_dir):
    """Share of simulations where death comes before the first discharge."""
    c = _ctx(spark, sf_dir)
    p = EV.first_of(c.sims, ["EVENT_DEATH"], ["EVENT_DISCHARGE"], None, N_SIMS, seq=c.sim_seq)
    return p.select("person_id", r6("prob").alias("prob"))


_TTE_TOKENS = assemble(
    B2, "SELECT person_id, count(*) AS n FROM tokens GROUP BY person_id", extra=_IDX_SQL, tok_events="ev_hist",
    tok_demo="demo_idx", age_expr="CASE WHEN birth_year IS NULL THEN 50 ELSE greatest(0, year(index_time) - birth_year) END")


@register("tte_predictions", _ev("""
SELECT i.person_id, strftime(i.index_time, '%Y-%m-%dT%H:%M:%S') AS index_time, s.label, round(s.score, 6) AS prob,
       CAST(h.n AS INTEGER) AS history_len
FROM tte_idx i JOIN tte_scored s ON i.person_id = s.person_id JOIN (""" + _TTE_TOKENS + """) h ON h.person_id = i.person_id"""))
def q_tte_predictions(spark, sf_dir):
    """K7/F16: per-patient index time (ISO), label, probability and length of the full history."""
    c = _ctx(spark, sf_dir)
    probs = c.tte_scored.select("person_id", "label", r6("score").alias("prob"))
    return EV.predictions_table(c.tte_index, probs, c.tte_history_lengths)


# --------------------------------------------------------------------------- optional paper rows
N_BOOT = 20


def _boot_sql(src: str) -> str:
    cdf = "[" + ", ".join(f"{c!r}::DOUBLE" for c in EV.poisson_cdf()) + "]"
    u = f"(CAST(('0x' || substr(md5('42|' || CAST(b AS VARCHAR) || '|' || CAST(person_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0)"
    return f"""
SELECT a.target, a.auroc, round(c.ci_low, 6) AS ci_low, round(c.ci_high, 6) AS ci_high, c.n_boot
FROM ({metric_sql(src, 'auroc')}) a LEFT JOIN (
  SELECT target, quantile_cont(a, 0.025) AS ci_low, quantile_cont(a, 0.975) AS ci_high, count(a) AS n_boot FROM (
    SELECT target, b, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (neg_below + 0.5 * neg)) / (sum(pos) * sum(neg)) END AS a
    FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY target, b ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
          FROM (SELECT target, b, score, sum(w * label) AS pos, sum(w * (1 - label)) AS neg FROM (
                  SELECT s.*, b, len(list_filter({cdf}, lambda c: c < {u})) AS w
                  FROM {src} s CROSS JOIN range(0, {N_BOOT}) r(b))
                GROUP BY 1, 2, 3))
    GROUP BY target, b)
  GROUP BY target) c ON a.target = c.target"""


@register("auroc_bootstrap", _ev(_boot_sql("scored_all")))
def q_auroc_bootstrap(spark, sf_dir):
    """O3: AUROC with a 95 % Poisson-bootstrap interval per target, over every evaluated person."""
    df = EV.bootstrap_auroc(_ctx(spark, sf_dir).scored_all, ["target"], n_boot=N_BOOT, seed=42)
    return df.select("target", r6("auroc").alias("auroc"), r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"),
                     "n_boot")


@register("next_condition_topk", _ev("""
SELECT count(*) AS n_patients,
       round(avg(CASE WHEN p.rk <= 1 THEN 1 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN p.rk <= 2 THEN 1 ELSE 0 END), 6) AS top2,
       round(avg(CASE WHEN p.rk <= 3 THEN 1 ELSE 0 END), 6) AS top3, round(avg(CASE WHEN p.rk <= 5 THEN 1 ELSE 0 END), 6) AS top5
FROM (SELECT person_id, arg_min(token, ts) AS token FROM (
        SELECT person_id, token, ts, row_number() OVER (PARTITION BY person_id ORDER BY ts, token) AS r FROM truth
        WHERE starts_with(token, 'CONDITION_OCCURRENCE_')) WHERE r = 1 GROUP BY person_id) t
LEFT JOIN (SELECT person_id, token, row_number() OVER (PARTITION BY person_id ORDER BY prob DESC, token) AS rk FROM (
             SELECT person_id, token, count(DISTINCT sim_id) / 10.0 AS prob FROM sim_ev
             WHERE starts_with(token, 'CONDITION_OCCURRENCE_') GROUP BY 1, 2)) p
  ON p.person_id = t.person_id AND p.token = t.token"""))
def q_next_condition_topk(spark, sf_dir):
    """Top-1/2/3/5 accuracy of the first true future condition among the simulated
    condition tokens ranked by probability (ties by token)."""
    from pyspark.sql import Window as W

    c = _ctx(spark, sf_dir)
    tr = c.truth.where(F.col("token").startswith("CONDITION_OCCURRENCE_"))
    first = tr.groupBy("person_id").agg(F.min(F.struct("ts", "token")).alias("_f")).select("person_id", "_f.token")
    prob = EV.sim_token_prob(c.sim_ev.where(F.col("token").startswith("CONDITION_OCCURRENCE_")), N_SIMS)
    ranked = prob.withColumn("rank", F.row_number().over(W.partitionBy("person_id").orderBy(F.col("prob").desc(), "token")))
    acc = EV.top_k_accuracy(ranked.select("person_id", "token", "rank"), first.select("person_id", "token"))
    return acc.select("n_patients", *[r6(f"top{k}").alias(f"top{k}") for k in (1, 2, 3, 5)])


@register("top_lab_events", assemble(B1, """
SELECT cid, count(*) AS n FROM ev_known
WHERE et = 'measurement' AND cid IN (SELECT cid FROM (SELECT cid, count(*) AS n FROM ev_known WHERE et = 'measurement'
                                                     GROUP BY cid ORDER BY n DESC, cid LIMIT 100))
GROUP BY cid"""))
def q_top_lab_events(spark, sf_dir):
    """O2: measurement events restricted to the most frequent lab concepts (top 100 here),
    counted per kept concept."""
    kept = stats.keep_top_concepts(build_for(spark, sf_dir, B1).known_events, "measurement", 100)
    return kept.where(F.col("et") == "measurement").groupBy("cid").agg(F.count(F.lit(1)).alias("n"))


@register("stay_summary", assemble(B2, """
SELECT s.visit_id, m.cid, count(*) AS n, round(min(m.value_as_number), 6) AS min,
       round(quantile_cont(m.value_as_number, 0.25), 6) AS q1, round(quantile_cont(m.value_as_number, 0.5), 6) AS median,
       round(quantile_cont(m.value_as_number, 0.75), 6) AS q3, round(max(m.value_as_number), 6) AS max
FROM (SELECT a.person_id, a.ev_id AS visit_id, a.ts AS start_ts, d.ts AS end_ts
      FROM ev_known a JOIN ev_known d ON a.ev_id = d.ev_id AND d.et = 'discharge'
      WHERE a.et = 'admission' AND d.ts >= a.ts) s
JOIN ev_known m ON m.person_id = s.person_id AND m.et = 'measurement' AND m.value_as_number IS NOT NULL
 AND m.ts >= s.start_ts AND m.ts <= s.end_ts
GROUP BY s.visit_id, m.cid"""))
def q_stay_summary(spark, sf_dir):
    """Per-stay summary (min, quartiles, max) of measurement values."""
    return stats.stay_summary(build_for(spark, sf_dir, B2).known_events)


_LOS_SQL = """
los_stays AS (
  SELECT a.ev_id AS visit_id, (epoch_us(d.ts) - epoch_us(a.ts)) / 86400000000.0 AS los_days
  FROM ev_known a JOIN ev_known d ON a.ev_id = d.ev_id AND d.et = 'discharge'
  WHERE a.et = 'admission' AND d.ts >= a.ts
),
los_rank AS (SELECT los_days AS v, row_number() OVER (ORDER BY los_days) - 1 AS rk, count(*) OVER () AS n FROM los_stays),
los_cuts AS (
  SELECT list(a.v + (h.h - floor(h.h)) * (b.v - a.v) ORDER BY h.j) AS cuts
  FROM (SELECT j, n, (j::DOUBLE / 10.0::DOUBLE) * (n - 1)::DOUBLE AS h FROM (SELECT DISTINCT n FROM los_rank), range(0, 10) r(j)) h
  JOIN los_rank a ON a.rk = floor(h.h)::BIGINT JOIN los_rank b ON b.rk = least(floor(h.h)::BIGINT + 1, h.n - 1)
)"""


@register("los_decile_tokens", assemble(B2, """
SELECT s.visit_id, round(s.los_days, 6) AS los_days,
       'LOS_Q' || CAST(CASE WHEN len(list_filter(c.cuts, lambda x: x < s.los_days)) >= 10 THEN 0
                            ELSE len(list_filter(c.cuts, lambda x: x < s.los_days)) END AS VARCHAR) AS los_token
FROM los_stays s CROSS JOIN los_cuts c""", extra=_LOS_SQL))
def q_los_decile_tokens(spark, sf_dir):
    """Per-stay length of stay and its decile token."""
    return stats.los_decile_tokens(build_for(spark, sf_dir, B2).known_events)


from . import catalogue_more  # noqa: E402, F401 - registers further queries
