
import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def build(spark):
    from chronotok.plans.timelines import build_for

    return build_for(spark, SF, "orders")


def test_vocab_dense_and_sequences_well_formed(build):
    ids = [r[0] for r in build.vocab.select("token_id").orderBy("token_id").collect()]
    assert ids == list(range(len(ids)))
    per = build.tokens.groupBy("person_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("pos").alias("mx"), F.min("pos").alias("mn"),
        F.sum((F.col("token") == "<EOS>").cast("int")).alias("eos"),
        F.max(F.when(F.col("token") == "<EOS>", F.col("pos"))).alias("eos_pos")).collect()
    for r in per:
        assert r["mn"] == 0 and r["mx"] == r["n"] - 1 and r["eos"] == 1 and r["eos_pos"] == r["n"] - 1


def test_counts_equal_lengths(build):
    from chronotok.operators import profile as P

    total = build.tokens.count()
    assert P.token_frequency(build.tokens).agg(F.sum("n")).first()[0] == total
    assert P.lengths(build.tokens).agg(F.sum("n_tokens")).first()[0] == total


def test_split_partitions_persons(build):
    from chronotok.operators.datasets import person_split

    s = person_split(build.demo, 0.8, 42)
    n = build.demo.count()
    assert s.count() == n and s.select("person_id").distinct().count() == n
    train = s.where(F.col("split") == "train").count()
    assert train == round(0.8 * n)


def test_remap_preserves_length(build):
    from chronotok.operators import datasets as D
    from chronotok.operators import profile as P
    from chronotok.operators import vocab as V

    counts = V.decode(P.token_frequency(build.tokens), build.vocab).select("token", "n")
    small = V.shrink_vocabulary(build.vocab, counts, 200)
    out, stats = D.remap_tokens(build.tokens, build.vocab, small)
    assert out.count() == build.tokens.count()
    st = stats.first()
    assert st["total"] == build.tokens.count() and 0 <= st["replaced"] <= st["total"]


def test_write_outputs_read_back(spark, build):
    import tempfile

    from chronotok.plans.timelines import write_outputs
    from chronotok.sources.sinks import has_output, load_processed

    root = write_outputs(build, tempfile.mkdtemp(prefix="chronotok-out-", dir="/tmp"), tag="t")
    seqs = load_processed(spark, root, "sequences")
    assert seqs.count() == build.demo.count()
    assert set(r[0] for r in seqs.select("split").distinct().collect()) == {"train", "test"}
    back = {r["person_id"]: list(r["tokens"]) for r in seqs.collect()}
    mine = {r["person_id"]: list(r["tokens"]) for r in build.arrays.collect()}
    assert back == mine
    ev = load_processed(spark, root, "events_partitioned")
    assert ev.count() == build.known_events.count()
    assert ev.where("pid_bucket <> pmod(person_id, 1024)").count() == 0
    assert has_output(spark, f"{root}/vocabulary") and has_output(spark, f"{root}/quantiles")


def test_reuse_and_force(spark, build):
    import os as _os
    import tempfile

    from chronotok.plans.timelines import write_outputs

    out = tempfile.mkdtemp(prefix="chronotok-reuse-", dir="/tmp")
    root = write_outputs(build, out, tag="r")
    made = _os.path.getmtime(f"{root}/vocabulary/_SUCCESS")
    top = spark.read.option("header", True).csv(f"{root}/top_tokens_csv")
    assert top.count() > 0 and "token" in top.columns
    assert write_outputs(build, out, tag="r", force=False) == root
    assert _os.path.getmtime(f"{root}/vocabulary/_SUCCESS") == made
    spark.read.parquet(f"{root}/sequences").limit(0).write.mode("overwrite").parquet(f"{root}/sequences_empty")
    from chronotok.sources.sinks import has_output

    assert not has_output(spark, f"{root}/sequences_empty")  # no patients: built anew
    write_outputs(build, out, tag="r", force=True)
    assert _os.path.getmtime(f"{root}/vocabulary/_SUCCESS") > made


def test_single_patient_and_examples(build):
    from chronotok.operators import datasets as D
    from chronotok.operators import profile as P

    first = P.first_patient_ids(build.tokens, 3).collect()
    assert P.select_patient(build.tokens, first[0].person_id).count() > 4
    with pytest.raises(LookupError, match=str(first[0].person_id)):
        P.select_patient(build.tokens, -5)
    a, b = (sorted({r.person_id for r in P.example_timelines(build.tokens, build.vocab, random_seed=s).collect()}) for s in (1, 2))
    assert len(a) == len(b) == 2 and a != b
    longest = P.example_timelines(build.tokens, build.vocab, min_len=10 ** 9)
    want = {r.person_id for r in P.lengths(build.tokens).orderBy(F.col("n_tokens").desc(), "person_id").limit(2).collect()}
    assert {r.person_id for r in longest.collect()} == want
    tail = {r.person_id: list(r.tokens) for r in D.tail_tokens(build.arrays, 5).collect()}
    assert all(tail[r.person_id] == list(r.tokens)[-5:] for r in build.arrays.collect())


def test_results_as_json(spark, build):
    import tempfile

    from chronotok.plans.evaluation import EvalContext

    out = tempfile.mkdtemp(prefix="chronotok-results-", dir="/tmp")
    EvalContext(build, "2000-01-01 00:00:00", 365).write_results(out)
    m = spark.read.json(f"{out}/tte_metrics").first()
    p = spark.read.json(f"{out}/tte_predictions")
    assert m.n_patients == p.count() and {"index_time", "label", "prob", "history_len"} <= set(p.columns)


def test_artifacts_are_scanned_with_pruned_columns(build):
    plan = build.events.where(F.col("et") == "death").select("person_id")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "ReadSchema: struct<person_id:bigint,et:string>" in plan
    assert "PushedFilters: [IsNotNull(et), EqualTo(et,death)]" in plan


def test_simulations_are_joined_where_they_are_read(build):
    """The copies of the sequences are never written: a score's filter reaches the stored sequences below the join."""
    from chronotok.plans.evaluation import EvalContext

    c = EvalContext(build, "2000-01-01 00:00:00", 365)
    plan = c.sim_seq.where(F.col("token") == "EVENT_DEATH")._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "EqualTo(token,EVENT_DEATH)" in plan
