"""Tokenizer invariants on hand-made OMOP frames (FIXTURES part C)."""

import datetime as dt

from pyspark.sql import functions as F

from chronotok import constants as K
from chronotok.plans.timelines import TimelineBuild


def ts(d, h=0, m=0):
    return dt.datetime(2020, 1, d, h, m)


def tables(spark):
    person = spark.createDataFrame(
        [(1, 8507, 1, 1, dt.datetime(1968, 5, 1)), (2, 8532, 2, 1, None), (3, 8507, 1, 1, dt.datetime(1990, 1, 1))],
        "person_id long, gender_concept_id long, race_concept_id long, ethnicity_concept_id long, birth_datetime timestamp_ntz")
    cond = spark.createDataFrame(
        # cid 0 with a source concept -> fallback; cid NULL without source -> dropped by the filter
        [(10, 1, ts(1), 0, 7), (11, 1, ts(1), 5, None), (12, 1, ts(1, 0, 3), None, None), (13, 9, ts(2), 5, None)],
        "condition_occurrence_id long, person_id long, condition_start_datetime timestamp_ntz, "
        "condition_concept_id long, condition_source_concept_id long")
    meas = spark.createDataFrame(
        # only *_date present: the whole column falls back to the date column
        [(20 + i, 1, dt.date(2020, 1, 3), 3, float(i), None) for i in range(12)],
        "measurement_id long, person_id long, measurement_date date, measurement_concept_id long, "
        "value_as_number double, unit_concept_id long")
    visits = spark.createDataFrame(
        [(30, 1, ts(1), ts(5), 9201), (31, 2, ts(2), None, 9202)],
        "visit_occurrence_id long, person_id long, visit_start_datetime timestamp_ntz, "
        "visit_end_datetime timestamp_ntz, visit_type_concept_id long")
    death = spark.createDataFrame([(1, ts(9))], "person_id long, death_datetime timestamp_ntz")
    return {"person": person, "condition_occurrence": cond, "measurement": meas,
            "visit_occurrence": visits, "death": death}


def seqs(b):
    rows = b.tokens.orderBy("person_id", "pos").collect()
    out = {}
    for r in rows:
        out.setdefault(r["person_id"], []).append(r["token"])
    return out


def test_sequences(spark):
    b = TimelineBuild(tables(spark), as_of_year=2025)
    s = seqs(b)
    assert set(s) == {1, 2, 3}  # person 3 has no events and is kept; person 9 is unknown
    for pid, seq in s.items():
        assert seq[-1] == K.EOS and seq.count(K.EOS) == 1
        assert all(t.startswith(("AGE_", "GENDER_", "RACE_", "YEAR_")) for t in seq[:4])
    assert s[3] == ["AGE_35-40", "GENDER_8507", "RACE_1", "YEAR_1990-1995", K.EOS]
    assert s[2][:4] == ["AGE_50-55", "GENDER_8532", "RACE_2", "YEAR_None"]  # NULL birth: age 50
    p1 = s[1]
    assert p1[:4] == ["AGE_55-60", "GENDER_8507", "RACE_1", "YEAR_1965-1970"]
    # same-ts tie order: admission, then conditions (ev_id order); cid 0 -> source 7; NULL cid dropped
    assert p1[4:10] == ["EVENT_ADMISSION", "VISIT_TYPE_9201", "EVENT_CONDITION", "CONDITION_OCCURRENCE_7",
                        "EVENT_CONDITION", "CONDITION_OCCURRENCE_5"]
    assert "TIME_1d" in p1 and "EVENT_DEATH" in p1 and "EVENT_DISCHARGE" in p1
    meas = [t for t in p1 if t.startswith("Q")]
    assert len(meas) == 12  # 12 values >= 10 -> deciles exist
    # ids: dense vocabulary and <PAD> for tokens outside it
    v = b.vocab.orderBy("token_id").collect()
    assert [r["token_id"] for r in v] == list(range(len(v)))
    assert [r["token"] for r in v[:56]] == K.fixed_vocab_tokens()
    yr = b.tokens.where(F.col("token") == "YEAR_None").select("token_id").distinct().collect()
    assert [r[0] for r in yr] == [0]


def test_length_formula(spark):
    b = TimelineBuild(tables(spark), as_of_year=2025)
    n_tokens = b.tokens.groupBy("person_id").count().collect()
    lens = {r[0]: r[1] for r in n_tokens}
    ev = b.known_events.groupBy("person_id").count().collect()
    n_ev = {r[0]: r[1] for r in ev}
    gaps = b.tokens.where(F.col("token").startswith("TIME_")).groupBy("person_id").count().collect()
    n_gap = {r[0]: r[1] for r in gaps}
    slots = {"admission": 2, "discharge": 1, "death": 1, "condition": 2}
    per_event = b.known_events.groupBy("person_id", "et").count().collect()
    body = {}
    for r in per_event:
        k = slots.get(r["et"])
        if r["et"] == "measurement":
            k = 4  # event, concept, decile, unit
        body[r["person_id"]] = body.get(r["person_id"], 0) + k * r["count"]
    for pid in lens:
        assert lens[pid] == 4 + body.get(pid, 0) + n_gap.get(pid, 0) + 1
    assert set(n_ev) == {1, 2}


def test_hot_person_in_many_slices_equals_one_slice(spark):
    """A person with 90 % of the rows lies in most slices, and the tokens are those of one slice."""
    import random

    from chronotok.operators.tokenize import timeline_tokens

    rng = random.Random(0)
    n = 1500
    cond = spark.createDataFrame(
        [(i, 1 if i % 10 else 2 + i % 2, ts(1) + dt.timedelta(minutes=rng.randrange(2_000_000)), 5 + i % 9, None) for i in range(n)],
        "condition_occurrence_id long, person_id long, condition_start_datetime timestamp_ntz, "
        "condition_concept_id long, condition_source_concept_id long")
    b = TimelineBuild({**tables(spark), "condition_occurrence": cond}, as_of_year=2025)
    key = ("person_id", "pos", "token", "token_id", "ts", "ev_seq", "next_token_id")
    one, many = (sorted(map(tuple, timeline_tokens(b.events, b.demo, b.vocab, b.cuts, 2025, num_partitions=k).select(*key)
                            .collect()), key=str) for k in (1, 13))
    assert one == many
    for require in (False, True):
        got = timeline_tokens(b.events, b.demo, b.vocab, b.cuts, 2025, require_events=require, num_partitions=13)
        assert {r[0] for r in got.select("person_id").distinct().collect()} == ({1, 2} if require else {1, 2, 3})
    chain = {}
    for r in one:
        chain.setdefault(r[0], {})[r[1]] = (r[3], r[6])
    for toks in chain.values():
        assert all(toks[p][1] == (toks[p + 1][0] if p + 1 in toks else None) for p in toks)


def test_vocabulary_learned_from_training_persons(spark):
    t = tables(spark)
    b = TimelineBuild(t, fit_on="train", train_ratio=0.34)
    train = {r.person_id for r in b.splits.where("split = 'train'").collect()}
    assert len(train) == 1
    seen = {r.cid for r in b.known_events.where(F.col("person_id").isin(train) & F.col("cid").isNotNull()).collect()}
    assert {r.cid for r in b.concept_counts.collect()} <= seen
    assert {r.token for r in b.vocab.collect() if r.token.startswith("GENDER_")} == {
        f"GENDER_{r.gender_concept_id}" for r in b.demo.where(F.col("person_id").isin(train)).collect()}


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if " Exchange " in line]


def test_tokenizer_plan(spark):
    """Over the clustered slices the tokens take no exchange at all; ids are joined before the explode."""
    b = TimelineBuild(tables(spark), as_of_year=2025)
    from chronotok.operators.tokenize import timeline_tokens

    df = timeline_tokens(b.events, b.demo, b.vocab, b.cuts, 2025)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not exchanges(df) and "CartesianProduct" not in plan and "SortMergeJoin" not in plan
    assert all("_slice" in line for line in plan.split("\n") if " Window [" in line)
    above = plan.split("Generate posexplode")[0]
    assert "Join" not in above and "Generate posexplode" in plan


def test_clustered_events_plans(spark):
    """Orders, positions and cuts at an index time read the clustered events without moving them."""
    from chronotok.operators import events as E
    from chronotok.operators import labels as L

    b = TimelineBuild(tables(spark), as_of_year=2025)
    assert not exchanges(E.ordered_events(b.event_slices)) and not exchanges(E.positions(b.event_slices))
    index = b.spark.createDataFrame([(1, ts(3)), (2, ts(1))], "person_id long, index_time timestamp_ntz")
    cut = E.events_until(b.event_slices, index)
    assert all("person_id" not in line or "_slice" in line or "ts" not in line for line in exchanges(cut))
    key = ("person_id", "ts", "et", "cid", "ev_id", "value_as_number")
    rows = lambda df: sorted(map(tuple, df.select(*key).collect()), key=str)
    assert rows(cut) == rows(L.events_until(b.known_events, index)) and cut.count() == 15


def test_bucket_labels_have_a_bucket_each(spark):
    from chronotok.session import bucket_labels

    for n in (1, 2, 7, 64):
        labels = bucket_labels(spark, n)
        assert labels == sorted(set(labels)) and len(labels) == n
        b = spark.createDataFrame([(x,) for x in labels], "x int").select(F.pmod(F.hash("x"), F.lit(n)).alias("b"))
        assert b.distinct().count() == n


def test_history_equals_tokenizing_the_events_up_to_the_index_time(spark):
    from chronotok.functions.tokens import age_at_index
    from chronotok.operators import labels as L

    b = TimelineBuild(tables(spark), as_of_year=2025)
    index = spark.createDataFrame([(1, ts(3)), (2, ts(1)), (3, ts(2))], "person_id long, index_time timestamp_ntz")
    again = b.tokens_for(L.events_until(b.events, index), demo=b.demo.join(index, "person_id"),
                         age=age_at_index(F.col("index_time"), F.col("birth_year")))
    key = ("person_id", "pos", "token", "token_id")
    rows = lambda df: sorted(map(tuple, df.select(*key).collect()))
    got = L.history_tokens(b.tokens, index, b.demo, b.vocab)
    assert rows(got) == rows(again)
    lens = {r.person_id: r.history_len for r in L.history_lengths(b.tokens, index).collect()}
    assert lens == {r["person_id"]: r["count"] for r in got.groupBy("person_id").count().collect()}


def test_gap_minutes_are_read_once_a_row(spark):
    """The minutes before an event are one column: no threshold takes the timestamps apart again, and no token goes
    through a transform."""
    from chronotok.operators.tokenize import timeline_tokens

    b = TimelineBuild(tables(spark), as_of_year=2025)
    df = timeline_tokens(b.events, b.demo, b.vocab, b.cuts, 2025)
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("secondwithfraction") == 2 and "transform(" not in plan
