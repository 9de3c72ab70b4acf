"""Rank metrics against brute force."""

import itertools
import math
import random

from chronotok.operators import evaluate as EV


def brute_auroc(y, p):
    pos = [s for s, l in zip(p, y) if l == 1]
    neg = [s for s, l in zip(p, y) if l == 0]
    if not pos or not neg:
        return None
    tot = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def brute_ap(y, p):
    order = sorted(set(p), reverse=True)
    P = sum(y)
    ap, prev_r = 0.0, 0.0
    for th in order:
        tp = sum(1 for s, l in zip(p, y) if s >= th and l == 1)
        fp = sum(1 for s, l in zip(p, y) if s >= th and l == 0)
        r = tp / P
        ap += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
    return ap


def frame(spark, y, p, key="t"):
    return spark.createDataFrame([(key, float(s), int(l)) for s, l in zip(p, y)], "target string, score double, label int")


def test_auroc_auprc_brier(spark):
    rnd = random.Random(7)
    y = [rnd.randint(0, 1) for _ in range(200)]
    p = [rnd.randint(0, 10) / 10 for _ in range(200)]  # many ties, like k / num_samples
    df = frame(spark, y, p)
    a = EV.auroc(df, ["target"]).first()["auroc"]
    assert math.isclose(a, brute_auroc(y, p), rel_tol=1e-9)
    ap = EV.auprc(df, ["target"]).first()["auprc"]
    assert math.isclose(ap, brute_ap(y, p), rel_tol=1e-9)
    b = EV.brier(df, ["target"]).first()["brier"]
    assert math.isclose(b, sum((s - l) ** 2 for s, l in zip(p, y)) / len(y), rel_tol=1e-9)
    # symmetry: AUROC(1 - p) = 1 - AUROC(p)
    a2 = EV.auroc(frame(spark, y, [1 - s for s in p]), ["target"]).first()["auroc"]
    assert math.isclose(a2, 1 - a, rel_tol=1e-9)


def test_single_class_is_null(spark):
    df = frame(spark, [1, 1, 1], [0.1, 0.5, 0.9])
    assert EV.auroc(df, ["target"]).first()["auroc"] is None


def test_set_metrics_empty_sets(spark):
    persons = spark.createDataFrame([(1,), (2,), (3,)], "person_id long")
    pred = spark.createDataFrame([(1, "A"), (1, "B"), (3, "A")], "person_id long, token string")
    truth = spark.createDataFrame([(1, "A"), (2, "C")], "person_id long, token string")
    m = {r["person_id"]: r for r in EV.set_metrics(pred, truth, persons).collect()}
    assert (m[1]["tp"], m[1]["fp"], m[1]["fn"]) == (1, 1, 0)
    assert math.isclose(m[1]["jaccard"], 0.5)
    assert m[2]["precision"] == 0.0 and m[2]["recall"] == 0.0 and m[2]["f1"] == 0.0
    assert m[3]["jaccard"] == 0.0


def test_first_of_and_length_of_stay_sort_nothing(spark):
    """Both take the first event of a simulation in hash aggregates, ties at one position as before: a stop wins."""
    rows = [(1, 0, 0, "EVENT_ADMISSION", 5), (1, 0, 1, "EVENT_DISCHARGE", 2880), (1, 1, 0, "EVENT_DEATH", 10), (1, 1, 2, "EVENT_DISCHARGE", 20),
            (2, 0, 0, "X", 0), (2, 1, 0, "EVENT_ADMISSION", 99_999), (3, 0, 4, "EVENT_DEATH", 1), (3, 0, 4, "EVENT_ADMISSION", 1),
            (3, 1, 0, "EVENT_DISCHARGE", 1440)]
    seq = spark.createDataFrame([(*r, 0) for r in rows], "person_id long, sim_id int, pos int, token string, cum_minutes long, _eos_before long")
    p = EV.first_of(seq, ["EVENT_ADMISSION"], ["EVENT_DEATH"], 43_200.0, 2, seq=seq)
    los = EV.length_of_stay(seq, seq=seq)
    assert {r.person_id: r.prob for r in p.collect()} == {1: 0.5, 2: 0.0, 3: 0.0}
    assert {tuple(r) for r in los.collect()} == {(1, 2.0, 1), (3, 1.0, 1)}
    for df in (p, los):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
