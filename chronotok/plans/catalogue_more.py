"""More registered queries: hierarchical codes, stored datasets, mergeable statistics, shuffles, intervals, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import codes as C
from ..operators import datasets as D
from ..operators import evaluate as EV
from ..operators import partial_stats as PS
from ..operators import permutation as PM
from ..operators import profile as P
from ..operators import stats, tokenize
from ..operators import vocab as V
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import bridge, repair, sinks
from .catalogue import (B1, B2, MAX_SEQ_LEN, N_BOOT, _ctx, _DATASET_SQL, _ev, _ids_str, r6, register)
from .oracle_sql import BRIDGE_CTES, CLINICAL_LIST, CLINICAL_PREFIX_CASE, N_FIXED, _split_ctes, assemble
from .timelines import build_for, write_outputs


def scratch(spark, name: str) -> str:
    """A new folder below the shared one."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --------------------------------------------------------------------------- O1: hierarchical codes
def _letter(letters: str, i: str) -> str:
    return f"substr('{letters}', CAST({i} % {len(letters)} + 1 AS BIGINT), 1)"


def _two(i: str) -> str:
    return f"lpad(CAST({i} % 100 AS VARCHAR), 2, '0')"


_ATC = " || ".join([_letter("ABCDGHJLMNPRSV", "k"), _two("(k // 14)"), _letter("ABCDEFGHIJ", "(k // 50)"), _letter("ABCDEFG", "k"), _two("k")])
_CM = " || ".join([_letter("ABCDEFGHJKLMNOPQRSTZ", "(k // 3)"), _two("(k // 7)"), "'.'", _two("k"), _two("(k // 100)")])
_PCS = " || ".join(_letter(bridge.CODE_LETTERS, f"(k // {j + 1} + {5 * j})") for j in range(7))
_CODE_SQL = f"""
code_raw AS (
  SELECT k AS cid, et, system, CASE WHEN n > 0 THEN substr(code, 1, n) ELSE code END AS code FROM (
    SELECT CAST(p_partkey AS BIGINT) AS k FROM part WHERE p_partkey % 11 <> 0) p, LATERAL (
    SELECT 'medication' AS et, 'ATC' AS system, {_ATC} AS code, [7, 7, 5, 4, 3][k % 5 + 1] AS n
    UNION ALL SELECT 'condition', 'ICD10CM', {_CM}, [3, 5, 6, 7, 8][k % 5 + 1]
    UNION ALL SELECT 'procedure', 'ICD10PCS', {_PCS}, 0) x
),
code_t AS (
  SELECT *, list_transform(range(1, len(pieces) + 1), lambda i: system || '_' || i || '_' || pieces[i]) AS toks FROM (
    SELECT *, list_filter(CASE system WHEN 'ATC' THEN [substr(bare, 1, 3), substr(bare, 4, 1), substr(bare, 5)]
        WHEN 'ICD10CM' THEN [substr(bare, 1, 3), substr(bare, 4, 2), substr(bare, 6)]
        ELSE [substr(bare, 1, 1), substr(bare, 2, 1), substr(bare, 3, 1), substr(bare, 4, 1), substr(bare, 5, 1), substr(bare, 6, 1), substr(bare, 7)]
        END, lambda x: x <> '') AS pieces
    FROM (SELECT *, replace(code, '.', '') AS bare FROM code_raw))
)"""


@register("code_tokens", assemble(B2, """
SELECT et, cid, system, code, array_to_string(toks, ' ') AS tokens, bare AS spelled FROM code_t""", extra=_CODE_SQL))
def q_code_tokens(spark, sf_dir):
    """O1: the level tokens of every code, and the code that they spell again."""
    t = bridge.code_table(spark, sf_dir).withColumn("t", C.code_tokens("system", "code"))
    return t.select("et", "cid", "system", "code", F.array_join("t", " ").alias("tokens"), C.code_of_tokens("t").alias("spelled"))


@register("code_roll_up", assemble(B2, """
SELECT system, CAST(i AS INTEGER) AS level, array_to_string(pieces[1:i], '') AS node,
       CASE WHEN i > 1 THEN array_to_string(pieces[1:i - 1], '') END AS parent, count(*) AS n_events, count(DISTINCT person_id) AS n_persons
FROM (SELECT c.system, c.pieces, e.person_id, unnest(range(1, len(c.pieces) + 1)) AS i
      FROM ev_known e JOIN code_t c ON c.et = e.et AND c.cid = e.cid)
GROUP BY ALL""", extra=_CODE_SQL))
def q_code_roll_up(spark, sf_dir):
    """O1: events and persons of every node of the code trees."""
    return C.roll_up(build_for(spark, sf_dir, B2).known_events, cut_lineage(bridge.code_table(spark, sf_dir)))


def _coded_ctes() -> str:
    """The vocabulary and tokenizer CTEs, with the tokens of a code in place of its concept token."""
    body = dict(_split_ctes(BRIDGE_CTES[B2]))
    swap = [
        ("vocab", "FROM concept_counts GROUP BY token",
         "FROM (SELECT unnest(coalesce(x.toks, [c.token])) AS token, c.n FROM concept_counts c "
         "LEFT JOIN code_t x ON x.et = c.et AND x.cid = c.cid) GROUP BY token"),
        ("tok_arr", "FROM tok_w)", "FROM (SELECT w.*, x.toks AS code_toks FROM tok_w w LEFT JOIN code_t x ON x.et = w.et AND x.cid = w.cid))"),
        ("tok_arr", f"THEN ['EVENT_' || upper(et), {CLINICAL_PREFIX_CASE} || CAST(cid AS VARCHAR)]",
         f"THEN list_concat(['EVENT_' || upper(et)], coalesce(code_toks, [{CLINICAL_PREFIX_CASE} || CAST(cid AS VARCHAR)]))"),
    ]
    for name, old, new in swap:
        assert old in body[name]
        body[name] = body[name].replace(old, new)
    return _CODE_SQL + ",\n" + body["vocab"] + ",\n" + body["tok_arr"]


@register("timeline_code_tokens", assemble(B2, "SELECT person_id, pos, token, token_id FROM tokens", extra=_coded_ctes()))
def q_timeline_code_tokens(spark, sf_dir):
    """O1 in the tokenizer: coded events carry a token per level, and the vocabulary counts these."""
    b = build_for(spark, sf_dir, B2)
    coded = cut_lineage(C.coded_concepts(bridge.code_table(spark, sf_dir)))
    vocab = V.build_vocabulary(b.categories, C.coded_counts(b.concept_counts, coded), b.vocab_size)
    return tokenize.timeline_tokens(b.events, b.demo, vocab, b.cuts, b.as_of_year, codes=coded).select(
        "person_id", "pos", "token", "token_id")


# --------------------------------------------------------------------------- A25, K1-K4, K9, S12: stored datasets
CHUNK = 64
TAIL = 100


@register("sequence_chunks", assemble(B2, f"""
SELECT t.person_id, s.split, CAST(pos // {CHUNK} AS BIGINT) AS chunk, CAST(min(pos) AS BIGINT) AS first_pos,
       CAST(count(*) AS INTEGER) AS n, string_agg(CAST(token_id AS VARCHAR), ',' ORDER BY pos) AS tokens
FROM tokens t JOIN split80 s ON s.person_id = t.person_id GROUP BY ALL""", extra=_DATASET_SQL))
def q_sequence_chunks(spark, sf_dir):
    """Sequences in chunks, written by split and read back."""
    b, path = build_for(spark, sf_dir, B2), scratch(spark, "sequences")
    sinks.write_sequences(tokenize.timeline_chunks(b.tokens, CHUNK), D.person_split(b.demo, 0.8, 42), path)
    return spark.read.parquet(path).select("person_id", "split", "chunk", "first_pos", "n", _ids_str("tokens").alias("tokens"))


@register("sequence_tails", assemble(B2, f"""
SELECT person_id, CAST(greatest(n - {TAIL}, 0) AS BIGINT) AS start, string_agg(CAST(token_id AS VARCHAR), ',' ORDER BY pos) AS tokens
FROM (SELECT *, count(*) OVER (PARTITION BY person_id) AS n FROM tokens) WHERE pos >= n - {TAIL} GROUP BY person_id, n"""))
def q_sequence_tails(spark, sf_dir):
    """W9 from chunks: the last tokens of every person, by the position index."""
    chunks = cut_lineage(tokenize.timeline_chunks(build_for(spark, sf_dir, B2).tokens, CHUNK))
    start = F.greatest(F.col("n_tokens") - TAIL, F.lit(0)).alias("start")
    wanted = tokenize.chunk_lengths(chunks).select("person_id", start, F.lit(TAIL).alias("length"))
    return tokenize.chunk_slices(chunks, wanted).select("person_id", "start", _ids_str("tokens").alias("tokens"))


@register("events_partitioned", assemble(B2, f"""
SELECT CAST(((person_id % 64) + 64) % 64 AS INTEGER) AS pid_bucket, count(*) AS n, count(DISTINCT person_id) AS persons,
       min(ts) AS first_ts, max(ts) AS last_ts FROM ev_known GROUP BY 1"""))
def q_events_partitioned(spark, sf_dir):
    """The event table by bucket, written and read back."""
    path = scratch(spark, "events")
    sinks.write_events_partitioned(build_for(spark, sf_dir, B2).known_events, path, n_buckets=64)
    return spark.read.parquet(path).groupBy("pid_bucket").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("person_id").alias("persons"), F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"))


@register("dataset_rows", assemble(B2, """
SELECT 'events_partitioned' AS artifact, count(*) AS n FROM ev_known
UNION ALL SELECT 'splits', count(*) FROM demo
UNION ALL SELECT 'sequences', CAST(sum(ceil(n / 4096.0)) AS BIGINT) FROM (SELECT count(*) AS n FROM tokens GROUP BY person_id)
UNION ALL SELECT 'vocabulary', count(*) FROM vocab
UNION ALL SELECT 'quantiles', count(*) FROM cuts"""))
def q_dataset_rows(spark, sf_dir):
    """A whole dataset with its manifest, reloaded part by part."""
    b = build_for(spark, sf_dir, B2)
    root = write_outputs(b, scratch(spark, "dataset"), tag="q")
    out = None
    for name in ("events_partitioned", "splits", "sequences", "vocabulary", "quantiles"):
        part = sinks.load_processed(spark, root, name).agg(F.lit(name).alias("artifact"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@register("tokenization_spec", assemble(B2, "SELECT token, token_id FROM vocab"))
def q_tokenization_spec(spark, sf_dir):
    """K4: the vocabulary as read back from the specification document."""
    path = scratch(spark, "spec")
    sinks.write_spec(build_for(spark, sf_dir, B2).vocab, path)
    doc = spark.read.text(path).select(F.from_json("value", "vocab map<string,int>").alias("d"))
    return doc.select(F.explode("d.vocab").alias("token", "token_id"))


@register("lengths_csv", assemble(B2, "SELECT person_id, CAST(count(*) AS INTEGER) AS n_tokens FROM tokens GROUP BY person_id"))
def q_lengths_csv(spark, sf_dir):
    """K5: sequence lengths as CSV, read back."""
    path = scratch(spark, "lengths")
    sinks.write_csv(P.lengths(build_for(spark, sf_dir, B2).tokens).select("person_id", "n_tokens"), path)
    return spark.read.schema("person_id long, n_tokens int").option("header", True).csv(path)


# --------------------------------------------------------------------------- S8-S11: converted folders
@register("converted_visits", """
SELECT CAST(o_orderkey AS BIGINT) AS visit_occurrence_id, CAST(o_custkey AS BIGINT) AS person_id,
       CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS visit_start_date,
       CASE WHEN o_custkey % 2 = 0 THEN CAST(o_orderkey % 97 AS BIGINT) END AS discharged_to_concept_id,
       o_orderpriority AS visit_source_value FROM orders""")
def q_converted_visits(spark, sf_dir):
    """A folder of text columns and epoch days, converted as a whole tree and read back."""
    src, out = scratch(spark, "raw"), scratch(spark, "converted")
    o = bridge.read_table(spark, sf_dir, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    home = F.when(F.col("o_custkey") % 2 == 0, (F.col("o_orderkey") % 97).cast("string")).otherwise("none")
    o.select(F.col("o_orderkey").cast("string").alias("visit_occurrence_id"), F.col("o_custkey").cast("string").alias("person_id"),
             day.cast("string").alias("visit_start_date"), home.alias("discharge_to_concept_id"),
             F.col("o_orderpriority").alias("visit_source_value")).write.parquet(f"{src}/deep/visit_occurrence")
    done = repair.convert_tables(spark, src, out)
    return spark.read.parquet(f"{out}/{done[0]}")


@register("concept_folder", """
SELECT CAST(p_partkey AS BIGINT) AS concept_id, p_name AS concept_name, r.targets FROM part LEFT JOIN (
  SELECT k, count(*) AS targets FROM (
    SELECT p_partkey AS k FROM part WHERE p_partkey % 10 >= 1 AND p_partkey % 10 <= 8
    UNION ALL SELECT p_partkey FROM part WHERE p_partkey % 10 = 5) GROUP BY k) r ON r.k = p_partkey""")
def q_concept_folder(spark, sf_dir):
    """Concepts and relationships from folders; concepts lie in two parts with ids of two types, some twice."""
    root = scratch(spark, "concepts")
    concept, relationship = bridge.concept_tables(spark, sf_dir)
    concept.where("concept_id % 2 = 0").write.parquet(f"{root}/concept/a")
    concept.where("concept_id % 2 = 1 or concept_id % 10 = 0").withColumn(
        "concept_id", F.col("concept_id").cast("double")).write.parquet(f"{root}/concept/b")
    relationship.write.parquet(f"{root}/concept_relationship")
    maps = repair.read_relationships(spark, root).where(F.col("relationship_id") == "Maps to").groupBy(
        F.col("concept_id_1").alias("concept_id")).agg(F.count(F.lit(1)).alias("targets"))
    return repair.read_concepts(spark, root).select("concept_id", "concept_name").join(maps, "concept_id", "left")


# --------------------------------------------------------------------------- A1, A2, Z5: mergeable statistics
PARTS = 3


def _store(spark, sf_dir) -> str:
    """Counts of the events in three parts (persons come with the first), one of them counted twice."""
    b, store = build_for(spark, sf_dir, B1), scratch(spark, "statistics")
    for i in [*range(PARTS), 0]:
        PS.add_part(store, str(i), b.known_events.where(F.pmod("ev_id", F.lit(PARTS)) == i), b.demo if i == 0 else b.demo.where("false"))
    return store


_Q_SQL = ", ".join(f"round(cuts[{i + 1}], 6) AS q{i}" for i in range(K.N_QUANTILES))


@register("merged_deciles", assemble(B1, f"SELECT cid, n, {_Q_SQL} FROM cuts"))
def q_merged_deciles(spark, sf_dir):
    """A2 from merged counts."""
    c = PS.measurement_deciles(spark, _store(spark, sf_dir))
    return c.select("cid", F.col("n").cast("bigint").alias("n"), *[r6(F.col("cuts")[i]).alias(f"q{i}") for i in range(K.N_QUANTILES)])


@register("merged_vocabulary", assemble(B1, "SELECT token, token_id FROM vocab"))
def q_merged_vocabulary(spark, sf_dir):
    """A1/A3/A4/Z5 from merged counts, after the parts were compacted into one."""
    store, base = _store(spark, sf_dir), scratch(spark, "compacted")
    PS.compact(spark, store, base)
    return V.build_vocabulary(PS.distinct_categories(spark, base), PS.concept_frequency(spark, base)).select("token", "token_id")


_GROUP = "CASE category WHEN 'GENDER' THEN 0 WHEN 'RACE' THEN 1 WHEN 'YEAR' THEN 2 WHEN 'VISIT_TYPE' THEN 3 ELSE 4 END"
_EXTENDED_SQL = f"""
part_ev AS (SELECT * FROM ev_known WHERE ev_id % {PARTS} = 0),
old_cat AS (
  SELECT category || '_' || value AS token, {_GROUP} AS grp FROM (
    SELECT category, value FROM cat_values WHERE category IN ('GENDER', 'RACE', 'YEAR')
    UNION SELECT 'UNIT', CAST(unit_concept_id AS VARCHAR) FROM part_ev WHERE et = 'measurement' AND unit_concept_id IS NOT NULL)
),
old_vocab AS (
  SELECT token, CAST(token_id AS BIGINT) AS token_id FROM fixed_tokens
  UNION ALL SELECT token, {N_FIXED} - 1 + row_number() OVER (ORDER BY grp, token) FROM old_cat
  UNION ALL SELECT token, {N_FIXED} - 1 + (SELECT count(*) FROM old_cat) + row_number() OVER (ORDER BY n DESC, token)
    FROM (SELECT {CLINICAL_PREFIX_CASE} || CAST(cid AS VARCHAR) AS token, count(*) AS n FROM part_ev WHERE et IN ({CLINICAL_LIST}) GROUP BY 1)
),
new_rows AS (
  SELECT token, grp, CAST(NULL AS BIGINT) AS n FROM cat_tokens
  UNION ALL SELECT token, 5, sum(n) FROM concept_counts GROUP BY token
)"""


@register("extended_vocabulary", assemble(B1, """
SELECT token, token_id FROM old_vocab
UNION ALL SELECT token, (SELECT max(token_id) FROM old_vocab) + row_number() OVER (ORDER BY grp, n DESC, token)
FROM new_rows WHERE token NOT IN (SELECT token FROM old_vocab)""", extra=_EXTENDED_SQL))
def q_extended_vocabulary(spark, sf_dir):
    """Z5 with stable ids: the vocabulary of the first part, extended by what the other parts bring."""
    store, b = _store(spark, sf_dir), build_for(spark, sf_dir, B1)
    first = b.known_events.where(F.pmod("ev_id", F.lit(PARTS)) == 0)
    old = V.build_vocabulary(stats.distinct_categories(first, b.demo), stats.concept_frequency(first))
    v = PS.extended_vocabulary(old, PS.distinct_categories(spark, store), PS.concept_frequency(spark, store))
    return v.select("token", F.col("token_id").cast("long").alias("token_id"))


# --------------------------------------------------------------------------- Z14: seeded shuffle
def _shuffle_sql(rows: str, batch: int, seed: int) -> str:
    """``rows`` selects dense numbers ``i``; the keys of every round are stated for a modulus of 2**64."""
    keys = ", ".join(f"({r}, {k}::HUGEINT, {a}, {b})" for r, (k, a, b) in enumerate(PM.round_keys(1 << 64, seed)))
    return f"""
SELECT i AS chunk_id, CAST(x // {batch} AS BIGINT) AS batch_id, CAST(x % {batch} AS INTEGER) AS slot FROM (
  WITH RECURSIVE base AS ({rows}),
  ks(r, k, a, b) AS (VALUES {keys}),
  perm AS (
    SELECT i, i AS x, 0 AS r FROM base
    UNION ALL
    SELECT i, CASE WHEN ((((y & {PM.LOW}) * a + (y >> 31) * b) >> 30) & 1) = 1 THEN o ELSE x END, r + 1
    FROM (SELECT *, greatest(x, o) AS y FROM (
      SELECT p.i, p.x, p.r, ks.a, ks.b, CAST((((ks.k % n.n) - p.x) % n.n + n.n) % n.n AS BIGINT) AS o
      FROM perm p JOIN ks ON ks.r = p.r, (SELECT count(*) AS n FROM base) n)))
  SELECT i, x FROM perm WHERE r = {PM.ROUNDS})"""


@register("shuffled_batches", assemble(B1, _shuffle_sql(
    f"SELECT DISTINCT CAST(floor(global_pos / {MAX_SEQ_LEN}) AS BIGINT) AS i FROM corpus", 8, 42), extra=_DATASET_SQL))
def q_shuffled_batches(spark, sf_dir):
    """Batches of corpus chunks in a seeded order that no sort makes."""
    chunks = cut_lineage(D.corpus_chunks(D.corpus_positions(build_for(spark, sf_dir, B1).tokens), MAX_SEQ_LEN))
    return PM.shuffled_batches(chunks, chunks.count(), 8, 42, "chunk_id").select("chunk_id", "batch_id", "slot")


# --------------------------------------------------------------------------- O3: interval of the mean absolute error
def _mae_boot_sql() -> str:
    cdf = "[" + ", ".join(f"{c!r}::DOUBLE" for c in EV.poisson_cdf()) + "]"
    u = "(CAST(('0x' || substr(md5('42|' || CAST(b AS VARCHAR) || '|' || CAST(person_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0)"
    return f"""
SELECT (SELECT count(*) FROM los_err) AS n_patients, (SELECT round(avg(e), 6) FROM los_err) AS mae,
       round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high, count(m) AS n_boot
FROM (SELECT b, sum(w * e) / nullif(sum(w), 0) AS m FROM (
        SELECT b, e, len(list_filter({cdf}, lambda c: c < {u})) AS w FROM los_err CROSS JOIN range(0, {N_BOOT}) r(b)) GROUP BY b)"""


_LOS_ERR = """
los_err AS (
  SELECT p.person_id, abs(p.los - t.los) AS e
  FROM (SELECT person_id, avg(m / 1440.0) AS los FROM (
          SELECT person_id, sim_id, arg_min(token, pos) AS first_tok, arg_min(cum_minutes, pos) AS m
          FROM sim_seq WHERE eos_before = 0 AND token IN ('EVENT_DISCHARGE', 'EVENT_DEATH') GROUP BY 1, 2)
        WHERE first_tok = 'EVENT_DISCHARGE' GROUP BY person_id) p
  JOIN (SELECT a.person_id, avg((epoch_us(d.ts) - epoch_us(a.ts)) / 86400000000.0) AS los
        FROM ev_future a JOIN ev_future d ON a.ev_id = d.ev_id AND d.et = 'discharge'
        WHERE a.et = 'admission' AND d.ts >= a.ts GROUP BY a.person_id) t ON t.person_id = p.person_id
)"""


@register("los_mae_bootstrap", _ev(_mae_boot_sql(), _LOS_ERR))
def q_los_mae_bootstrap(spark, sf_dir):
    """O3: the mean absolute error of the simulated length of stay with a 95 % interval."""
    c = _ctx(spark, sf_dir)
    truth = stats.stays(c.future).groupBy("person_id").agg(F.avg("los_days").alias("los_days"))
    m = EV.bootstrap_mae(EV.length_of_stay(c.sims, seq=c.sim_seq), truth, "los_days", n_boot=N_BOOT, seed=42)
    return m.select("n_patients", r6("mae").alias("mae"), r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"), "n_boot")


# --------------------------------------------------------------------------- Z4: incremental tokenization
@register("streamed_tokens", assemble(B1, "SELECT person_id, pos, token, token_id FROM tokens"))
def q_streamed_tokens(spark, sf_dir):
    """The tokens of a stream that gets the events in four micro-batches by hash, so that each brings events of all
    times, and then the close rows; events that come too late are taken over by the batch tokenizer."""
    from ..streaming import tokenize_stream as TS

    b, root = build_for(spark, sf_dir, B1), scratch(spark, "stream")
    schema = b.events.schema
    for i in range(4):
        b.events.where(F.pmod(F.xxhash64("ev_id", "et"), F.lit(4)) == i).coalesce(1).write.mode("append").parquet(f"{root}/in")
    closing = TS.close_rows(b.demo)
    closing = closing.select(*[F.col(f.name) if f.name in closing.columns else F.lit(None).cast(f.dataType).alias(f.name)
                               for f in schema.fields])
    for step in range(2):
        if step:
            closing.coalesce(1).write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        TS.stream_tokens(source, b.cuts, f"{root}/out", f"{root}/checkpoint", delay_minutes=2 * 1440).awaitTermination()
    t = TS.read_tokens(spark, f"{root}/out", b.events, b.demo, b.vocab, b.cuts, b.as_of_year)
    return t.select("person_id", "pos", "token", "token_id")
