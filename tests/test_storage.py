"""Chunked sequences, manifests, mergeable statistics, seeded permutations, bootstrap sums, incremental tokenization."""

import datetime as dt
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from chronotok.operators import evaluate as EV
from chronotok.operators import partial_stats as PS
from chronotok.operators import permutation as PM
from chronotok.operators import stats, tokenize
from chronotok.operators import vocab as V
from chronotok.plans.timelines import TimelineBuild, write_outputs
from chronotok.sources import sinks


def tables(spark, n=240, seed=1):
    rng = random.Random(seed)
    t = lambda: dt.datetime(2020, 1, 1) + dt.timedelta(minutes=rng.randrange(900_000))
    person = spark.createDataFrame([(p, 8507 + p % 2, 1, 1, dt.datetime(1960 + p, 5, 1)) for p in range(1, 7)],
                                   "person_id long, gender_concept_id long, race_concept_id long, ethnicity_concept_id long, birth_datetime timestamp_ntz")
    who = lambda: 1 if rng.random() < 0.6 else rng.randrange(2, 8)  # noqa: E731 - person 7 is unknown
    cond = spark.createDataFrame([(i, who(), t(), 5 + i % 9) for i in range(n)],
                                 "condition_occurrence_id long, person_id long, condition_start_datetime timestamp_ntz, condition_concept_id long")
    meas = spark.createDataFrame([(1000 + i, who(), t(), 3 + i % 2, rng.choice([None, 1.5, 2.5, float(i % 40)]), rng.choice([None, 8, 9])) for i in range(n)],
                                 "measurement_id long, person_id long, measurement_datetime timestamp_ntz, measurement_concept_id long, "
                                 "value_as_number double, unit_concept_id long")
    return {"person": person, "condition_occurrence": cond, "measurement": meas}


@pytest.fixture(scope="module")
def build(spark):
    return TimelineBuild(tables(spark))


def test_chunks_hold_the_sequences(spark, build):
    chunks = tokenize.timeline_chunks(build.tokens, 16)
    rows = chunks.collect()
    assert max(r.n for r in rows) == 16 and all(len(r.tokens) == r.n and r.first_pos == 16 * r.chunk for r in rows)
    key = ("person_id", "pos", "token_id")
    assert (sorted(map(tuple, tokenize.chunk_tokens(chunks).select(*key).collect()))
            == sorted(map(tuple, build.tokens.select(*key).collect())))
    full = {r.person_id: r.tokens for r in tokenize.timeline_arrays(build.tokens).collect()}
    assert {r.person_id: r.n_tokens for r in tokenize.chunk_lengths(chunks).collect()} == {p: len(t) for p, t in full.items()}
    wanted = [(p, s, n) for p in full for s, n in ((0, 1), (3, 40), (15, 2), (16, 16), (len(full[p]) - 1, 5))]
    got = tokenize.chunk_slices(chunks, spark.createDataFrame(wanted, "person_id long, start long, length long")).collect()
    assert {(r.person_id, r.start, tuple(r.tokens)) for r in got} == {
        (p, s, tuple(full[p][s:s + n])) for p, s, n in wanted if full[p][s:s + n]}


def test_a_person_of_millions_of_tokens_lies_in_bounded_rows(spark):
    tokens = spark.range(2_000_000).select(F.lit(1).cast("long").alias("person_id"), F.col("id").cast("int").alias("pos"),
                                           (F.col("id") % 50).cast("int").alias("token_id"))
    r = tokenize.timeline_chunks(tokens).agg(F.count("*").alias("n"), F.max("n").alias("most"), F.sum("n").alias("all")).first()
    assert tuple(r) == (489, 4096, 2_000_000)


def test_manifest_tells_a_finished_dataset(spark, build, tmp_path):
    root = write_outputs(build, str(tmp_path), tag="a", force=False)
    m = sinks.read_manifest(spark, root)
    assert m["finished"] and m["rows"]["splits"] == 6 and m["rows"]["events_partitioned"] == build.known_events.count()
    before = sorted(r.path for r in spark.read.format("binaryFile").load(f"{root}/sequences/*/*.parquet").select("path").collect())
    again = lambda b=build, **kw: write_outputs(b, str(tmp_path), tag="a", force=False, **kw)
    files = lambda: sorted(r.path for r in spark.read.format("binaryFile").load(f"{root}/sequences/*/*.parquet").select("path").collect())
    again()
    assert files() == before  # kept as it is
    # a job that died between two tables: the manifest says unfinished, reload refuses, the next run builds anew
    sinks.write_manifest(spark, root, False, build.parameters)
    with pytest.raises(ValueError, match="finished"):
        sinks.load_processed(spark, root, "sequences")
    again()
    assert files() != before and sinks.is_finished(spark, root)
    # a table that lost rows
    now = files()
    build.vocab.select("token", "token_id").limit(3).write.mode("overwrite").parquet(f"{root}/vocabulary")
    assert not sinks.is_finished(spark, root)
    with pytest.raises(ValueError, match="vocabulary"):
        sinks.load_processed(spark, root, "vocabulary")
    again()
    assert files() != now and sinks.load_processed(spark, root, "vocabulary").count() == build.vocab.count()
    # other parameters
    now = files()
    again(TimelineBuild(build.tables, as_of_year=2020))
    assert files() != now and json.loads(json.dumps(sinks.read_manifest(spark, root)))["parameters"]["as_of_year"] == 2020


def test_changed_inputs_are_seen(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(5).coalesce(1).write.parquet(folder)
    one = sinks.folder_state(spark, folder)
    assert one["files"] == 1 and sinks.folder_state(spark, folder) == one
    spark.range(5).coalesce(1).write.mode("append").parquet(folder)
    assert sinks.folder_state(spark, folder)["files"] == 2
    assert not sinks.is_finished(spark, str(tmp_path / "nothing"))


def test_merged_statistics_equal_those_of_all_events(spark, build, tmp_path):
    store, ev = str(tmp_path / "store"), build.known_events
    for i in (0, 1, 2, 1):  # one part comes twice
        PS.add_part(store, f"p{i}", ev.where(F.pmod(F.xxhash64("ev_id"), F.lit(3)) == i), build.demo if i == 0 else build.demo.where("false"))
    PS.compact(spark, store, f"{store}2")
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=str)
    for s in (store, f"{store}2"):
        assert rows(PS.measurement_deciles(spark, s), "cid", "n", "cuts") == rows(stats.measurement_deciles(ev), "cid", "n", "cuts")
        key = ("et", "cid", "n", "token")
        assert rows(PS.concept_frequency(spark, s), *key) == rows(stats.concept_frequency(ev), *key)
        assert rows(PS.distinct_categories(spark, s), "category", "value") == rows(stats.distinct_categories(ev, build.demo), "category", "value")


def test_an_extended_vocabulary_keeps_its_ids(spark, build):
    first = build.known_events.where("cid < 8 and (unit_concept_id is null or unit_concept_id = 8)")
    old = V.build_vocabulary(stats.distinct_categories(first, build.demo), stats.concept_frequency(first))
    new = PS.extended_vocabulary(old, build.categories, build.concept_counts)
    was, now = ({r.token: r.token_id for r in v.collect()} for v in (old, new))
    assert all(now[t] == i for t, i in was.items()) and sorted(now.values()) == list(range(len(now)))
    assert set(now) == {r.token for r in build.vocab.collect()} and len(now) > len(was)
    added = sorted(set(now) - set(was), key=now.get)
    assert added[0] == "UNIT_9" and all(t.startswith("CONDITION") for t in added[1:])
    capped = PS.extended_vocabulary(old, build.categories, build.concept_counts, vocab_size=len(was) + 2)
    assert capped.count() == len(was) + 2


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4096])
def test_permutation_is_a_bijection_for_every_size_and_key(spark, n):
    df = spark.range(n)
    orders = []
    for seed in (1, "1|epoch2"):
        got = [r[0] for r in df.select("id", PM.permuted("id", n, seed).alias("p")).orderBy("id").select("p").collect()]
        assert sorted(got) == list(range(n))
        orders.append(got)
    if n >= 97:
        assert orders[0] != orders[1] and orders[0] != list(range(n))
        near = sum(abs(a - b) <= n // 20 for a, b in zip(orders[0], orders[0][1:]))
        assert near < n / 4  # neighbours are sent far apart (a tenth by chance)


def test_permutation_against_a_loop_beyond_32_bits(spark):
    n, seed = 3_000_000_000_011, 5

    def place(x):
        for k, a, b in PM.round_keys(n, seed):
            other = (k - x) % n
            y = max(x, other)
            if ((y & PM.LOW) * a + (y >> 31) * b) >> 30 & 1:
                x = other
        return x

    ids = [0, 1, 17, n // 2, n - 2, n - 1, 2_147_483_647, 2_147_483_648]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    assert [r.p for r in df.select("id", PM.permuted("id", n, seed).alias("p")).collect()] == [place(i) for i in ids]


def test_batches_without_a_sort(spark):
    rows = PM.numbered(spark.range(0, 103, 1, 7).select(F.col("id").alias("payload")))
    assert sorted(r.number for r in rows.collect()) == list(range(103))
    b = PM.shuffled_batches(rows, 103, 10, "s", drop_last=True)
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange range" not in plan and "Window" not in plan
    sizes = {r.batch_id: (r.n, r.s) for r in b.groupBy("batch_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("slot")).alias("s")).collect()}
    assert sizes == {i: (10, list(range(10))) for i in range(10)}


def test_bootstrap_against_a_loop(spark):
    import hashlib

    rng = random.Random(2)
    rows = [(t, p, int(rng.random() < 0.4), rng.randrange(5) / 4) for t in "ab" for p in range(60)] + [("one", p, 1, 0.5) for p in range(5)]
    cdf = EV.poisson_cdf()

    def weight(b, p):
        u = int(hashlib.md5(f"42|{b}|{p}".encode()).hexdigest()[:8], 16) / 4294967296
        return sum(c < u for c in cdf)

    def auc(part):
        pos, neg = [(s, w) for _, l, s, w in part if l and w], [(s, w) for _, l, s, w in part if not l and w]
        if not pos or not neg:
            return None
        won = sum(w * v * ((s > t) + 0.5 * (s == t)) for s, w in pos for t, v in neg)
        return won / (sum(w for _, w in pos) * sum(v for _, v in neg))

    def quantile(values, q):
        values = sorted(values)
        at = q * (len(values) - 1)
        low = int(at)
        return values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low])

    scored = spark.createDataFrame(rows, "target string, person_id long, label int, score double")
    for n_boot in (7, EV.BOOT_BLOCK + 3):
        got = {r.target: r for r in EV.bootstrap_auroc(scored, ["target"], n_boot=n_boot).collect()}
        for t in "ab":
            part = [(p, l, s) for x, p, l, s in rows if x == t]
            own = [a for b in range(n_boot) if (a := auc([(p, l, s, weight(b, p)) for p, l, s in part])) is not None]
            r = got[t]
            assert abs(r.auroc - auc([(*x, 1) for x in part])) < 1e-12 and r.n_boot == len(own)
            assert abs(r.ci_low - quantile(own, 0.025)) < 1e-12 and abs(r.ci_high - quantile(own, 0.975)) < 1e-12
        assert got["one"].auroc is None and got["one"].n_boot == 0
    pred = spark.createDataFrame([(p, float(p)) for p in range(9)], "person_id long, v double")
    truth = spark.createDataFrame([(p, 2.0 * p + 1) for p in range(1, 12)], "person_id long, v double")
    r = EV.bootstrap_mae(pred, truth, "v", n_boot=6).first()
    own = [sum(weight(b, p) * (p + 1) for p in range(1, 9)) / n for b in range(6) if (n := sum(weight(b, p) for p in range(1, 9)))]
    assert (r.n_patients, r.mae, r.n_boot) == (8, 5.5, len(own))
    assert abs(r.ci_low - quantile(own, 0.025)) < 1e-12 and abs(r.ci_high - quantile(own, 0.975)) < 1e-12


@pytest.mark.parametrize("delay_days, late", [(1000, False), (3, True)])
def test_stream_gives_the_tokens_of_the_batch(spark, build, tmp_path, delay_days, late):
    """Events shuffled over micro-batches; with a short delay some come too late and go through the batch tokenizer."""
    from chronotok.streaming import tokenize_stream as TS

    root = str(tmp_path)
    events = build.events
    parts = [events.where(F.pmod(F.xxhash64("ev_id", F.lit(uuid.uuid5(uuid.NAMESPACE_OID, "x").hex)), F.lit(3)) == i) for i in range(3)]
    closing = TS.close_rows(build.demo)
    closing = closing.select(*[F.col(f.name) if f.name in closing.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields])
    for part in [*parts, closing]:  # one micro-batch after the other
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(events.schema).parquet(f"{root}/in")
        TS.stream_tokens(source, build.cuts, f"{root}/out", f"{root}/ckpt", delay_minutes=delay_days * 1440).awaitTermination(300)
    placed = spark.read.parquet(f"{root}/out").join(build.demo, "person_id", "left_semi")  # others are never closed
    kinds = {r.kind: r["count"] for r in placed.groupBy("kind").count().collect()}
    assert ("late" in kinds) == late and sum(kinds.values()) == build.known_events.count()
    got = TS.read_tokens(spark, f"{root}/out", events, build.demo, build.vocab, build.cuts)
    key = ("person_id", "pos", "token", "token_id", "ts", "ev_seq")
    assert sorted(map(tuple, got.select(*key).collect()), key=str) == sorted(map(tuple, build.tokens.select(*key).collect()), key=str)
