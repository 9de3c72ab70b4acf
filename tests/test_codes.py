"""Hierarchical codes (O1): levels, round trip, roll-up against a loop, tokens in the tokenizer."""

import datetime as dt
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chronotok.operators import codes as C

CASES = [("ATC", "A10BA02", ["ATC_1_A10", "ATC_2_B", "ATC_3_A02"], "A10BA02"), ("ATC", "a10b", ["ATC_1_A10", "ATC_2_B"], "A10B"),
         ("ATC", "A10", ["ATC_1_A10"], "A10"), ("ICD10CM", "E11.65", ["ICD10CM_1_E11", "ICD10CM_2_65"], "E1165"),
         ("ICD10CM", "S72.001A", ["ICD10CM_1_S72", "ICD10CM_2_00", "ICD10CM_3_1A"], "S72001A"), ("ICD10CM", " i10 ", ["ICD10CM_1_I10"], "I10"),
         ("ICD10PCS", "0DTJ4ZZ", [f"ICD10PCS_{i + 1}_{c}" for i, c in enumerate("0DTJ4ZZ")], "0DTJ4ZZ"),
         ("ICD10PCS", "0DTJ4ZZX", [*(f"ICD10PCS_{i + 1}_{c}" for i, c in enumerate("0DTJ4Z")), "ICD10PCS_7_ZX"], "0DTJ4ZZX"),
         ("ATC", "", None, None), ("ATC", None, None, None), ("LOINC", "1-2", None, None), (None, "A10", None, None), ("ATC", " . ", None, None)]


def test_levels_and_round_trip(spark):
    df = spark.createDataFrame([(i, s, c) for i, (s, c, _, _) in enumerate(CASES)], "i int, system string, code string")
    df = df.withColumn("t", C.code_tokens("system", "code")).withColumn("spelled", C.code_of_tokens("t"))
    got = {r.i: (r.t, r.spelled) for r in df.collect()}
    assert got == {i: (t, s) for i, (_, _, t, s) in enumerate(CASES)}


def test_tree_has_every_prefix_below_its_parent(spark):
    df = spark.createDataFrame([("ATC", "A10BA02"), ("ATC", "A10BB01"), ("ATC", "A10BA02"), ("ICD10CM", "A10.BA")], "system string, code string")
    got = sorted(map(tuple, C.code_tree(df).collect()))
    assert got == [("ATC", 1, "A10", None), ("ATC", 2, "A10B", "A10"), ("ATC", 3, "A10BA02", "A10B"), ("ATC", 3, "A10BB01", "A10B"),
                   ("ICD10CM", 1, "A10", None), ("ICD10CM", 2, "A10BA", "A10")]


def test_roll_up_against_a_loop(spark):
    import random

    rng = random.Random(3)
    codes = [("medication", i, "ATC", f"{rng.choice('AB')}{rng.choice(['01', '02'])}{rng.choice('XY')}{rng.choice(['', 'A01', 'B02'])}")
             for i in range(20)] + [("condition", 3, "ICD10CM", "E11.9")]
    # person 1 has most events, and one class holds most of them
    events = [(1 if rng.random() < 0.7 else rng.randrange(9), rng.choice(["medication", "condition"]), rng.randrange(25)) for _ in range(800)]
    ev = spark.createDataFrame(events, "person_id long, et string, cid long")
    ct = spark.createDataFrame(codes, "et string, cid long, system string, code string")
    n, persons = defaultdict(int), defaultdict(set)
    for p, et, cid in events:
        for e, c, system, code in codes:
            if (e, c) == (et, cid):
                bare, cuts = code.replace(".", ""), {"ATC": (3, 4, 9), "ICD10CM": (3, 5, 9)}[system]
                nodes = list(dict.fromkeys(bare[:k] for k in cuts))
                for level, node in enumerate(nodes, 1):
                    key = (system, level, node, nodes[level - 2] if level > 1 else None)
                    n[key] += 1
                    persons[key].add(p)
    got = {tuple(r)[:4]: tuple(r)[4:] for r in C.roll_up(ev, ct).collect()}
    assert got == {k: (n[k], len(persons[k])) for k in n}


@pytest.mark.parametrize("num_partitions", [1, 7])
def test_tokenizer_takes_the_levels_in_place_of_the_concept(spark, num_partitions):
    from chronotok.operators import vocab as V
    from chronotok.operators.tokenize import timeline_tokens
    from chronotok.plans.timelines import TimelineBuild

    ts = lambda d: dt.datetime(2020, 1, d)
    person = spark.createDataFrame([(1, 8507, 1, 1, dt.datetime(1968, 5, 1))],
                                   "person_id long, gender_concept_id long, race_concept_id long, ethnicity_concept_id long, birth_datetime timestamp_ntz")
    drug = spark.createDataFrame([(i, 1, ts(i), 40 + i % 3) for i in range(1, 10)],
                                 "drug_exposure_id long, person_id long, drug_exposure_start_datetime timestamp_ntz, drug_concept_id long")
    b = TimelineBuild({"person": person, "drug_exposure": drug})
    codes = spark.createDataFrame([("medication", 40, "ATC", "A10BA02"), ("medication", 41, "ATC", "A10"), ("condition", 42, "ICD10CM", "E11"),
                                   ("medication", 40, "ATC", "Z99ZZ99")], "et string, cid long, system string, code string")
    coded = C.coded_concepts(codes)
    counts = {r.token: r.n for r in C.coded_counts(b.concept_counts, coded).collect()}
    assert counts == {"ATC_1_A10": 6, "ATC_2_B": 3, "ATC_3_A02": 3, "DRUG_EXPOSURE_42": 3}
    vocab = V.build_vocabulary(b.categories, C.coded_counts(b.concept_counts, coded))
    t = timeline_tokens(b.events, b.demo, vocab, b.cuts, codes=coded, num_partitions=num_partitions)
    rows = t.orderBy("pos").collect()
    ids = {r.token: r.token_id for r in vocab.collect()}
    assert [r.pos for r in rows] == list(range(len(rows))) and all(r.token_id == ids.get(r.token, 0) for r in rows)
    body = [r.token for r in rows if not r.token.startswith(("TIME_", "EVENT_"))][4:-1]
    level = {40: ["ATC_1_A10", "ATC_2_B", "ATC_3_A02"], 41: ["ATC_1_A10"], 42: ["DRUG_EXPOSURE_42"]}
    assert body == [x for i in range(1, 10) for x in level[40 + i % 3]]
    spelled = t.where(F.col("token").startswith("ATC_")).groupBy("ev_seq").agg(
        C.code_of_tokens(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"])).alias("c"))
    assert {r.c for r in spelled.collect()} == {"A10BA02", "A10"}


def test_roll_up_moves_node_numbers(spark):
    ev = spark.createDataFrame([(1, "medication", 1)], "person_id long, et string, cid long")
    ct = spark.createDataFrame([("medication", 1, "ATC", "A10BA02")], "et string, cid long, system string, code string")
    plan = C.roll_up(ev, ct)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_node" in plan and "hashpartitioning(system" not in plan and "lambdafunction" not in plan
