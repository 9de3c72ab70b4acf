"""Skew-proof running sums and exact deciles against brute force."""

import numpy as np
from pyspark.sql import functions as F

from chronotok.operators.ranking import exclusive_running_sum, global_rank
from chronotok.operators.stats import measurement_deciles


def test_exclusive_running_sum_hot_group(spark):
    # one group holds most rows, so it spans several range partitions
    rows = [(0, i, (i % 5) + 1) for i in range(3000)] + [(g, i, 1) for g in range(1, 20) for i in range(20)]
    df = spark.createDataFrame(rows, "g int, k int, w int")
    out = exclusive_running_sum(df, ["g"], ["k"], "w", out="off", total="tot", num_partitions=8).collect()
    by = {}
    for g, k, w in rows:
        by.setdefault(g, []).append((k, w))
    expect = {}
    for g, lst in by.items():
        run = 0
        for k, w in sorted(lst):
            expect[(g, k)] = (run, sum(x for _, x in lst))
            run += w
    assert len(out) == len(rows)
    for r in out:
        assert (r["off"], r["tot"]) == expect[(r["g"], r["k"])]


def test_global_rank(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "x int")
    got = sorted((r["x"], r["rank"]) for r in global_rank(df, ["x"], num_partitions=5).collect())
    assert got == [(x, x) for x in range(101)]


def test_deciles_match_numpy(spark):
    rng = np.random.default_rng(3)
    rows = []
    for cid, n in [(1, 9), (2, 10), (3, 11), (4, 500), (5, 40)]:
        vals = rng.integers(0, 30, n).astype(float) if cid != 5 else np.full(n, 7.0)
        rows += [(cid, "measurement", float(v)) for v in vals]
    rows += [(2, "measurement", None)]
    df = spark.createDataFrame(rows, "cid long, et string, value_as_number double")
    got = {r["cid"]: r["cuts"] for r in measurement_deciles(df, num_partitions=4).collect()}
    by = {}
    for r in df.where("value_as_number is not null").collect():
        by.setdefault(r["cid"], []).append(r["value_as_number"])
    for cid, values in by.items():
        if len(values) >= 10:
            assert np.allclose(got[cid], np.percentile(values, range(0, 100, 10)), rtol=1e-12, atol=0)
    assert set(got) == {c for c, v in by.items() if len(v) >= 10}


def test_small_values_keep_their_deciles(spark):
    df = spark.createDataFrame([("measurement", 1, i * 1e-8) for i in range(1, 21)], "et string, cid long, value_as_number double")
    cuts = measurement_deciles(df).first()["cuts"]
    assert len(set(cuts)) == 10 and np.allclose(cuts, np.percentile([i * 1e-8 for i in range(1, 21)], range(0, 100, 10)), atol=0)


def test_running_sums_in_many_slices(spark):
    from chronotok.operators.ranking import running_sums

    rows = [(g, i, (i * 7) % 5, (i * 3) % 4) for g, n in ((1, 900), (2, 3), (None, 50), (4, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, pos int, a int, b int")
    out = running_sums(df, ["g"], ["pos"], ["a", "b"], ["ca", "cb"], [True, False]).collect()
    want, run = {}, {}
    for g, i, x, y in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        ca, cb = run.get(g, (0, 0))
        want[g, i] = (ca + x, cb)
        run[g] = (ca + x, cb + y)
    assert len(out) == len(rows) and all((r["ca"], r["cb"]) == want[r["g"], r["pos"]] for r in out)


def test_hot_group_is_spread_over_slices(spark):
    from chronotok.operators.ranking import Slices

    df = spark.range(20000).selectExpr("if(id % 10 = 0, id, 7) as g", "id as k")
    s = Slices(df, ["g"], ["k"], 8)
    per = {r["_slice"]: r["count"] for r in s.rows.where("g = 7").groupBy("_slice").count().collect()}
    assert len(per) >= 6 and max(per.values()) < 6000
    assert s.spanning(F.count("k").alias("n")).count() <= 16


def test_ordered_events_of_a_hot_person(spark):
    import datetime as dt
    import random

    from chronotok.operators.events import EVENT_ORDER, ordered_events

    rng = random.Random(0)
    rows = []
    for i in range(1500):
        rows.append((1 if i % 10 else 2 + i % 7, dt.datetime(2020, 1, 1) + dt.timedelta(minutes=rng.randrange(500000)), i))
    df = spark.createDataFrame(rows, "person_id long, ts timestamp_ntz, ev_id long")
    for c in EVENT_ORDER:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0))
    got = {r["ev_id"]: (r["ev_seq"], r["gap_minutes"]) for r in ordered_events(df).collect()}
    last: dict = {}
    for p, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        n, before = last.get(p, (0, None))
        assert got[i] == (n + 1, None if before is None else (t - before).total_seconds() / 60)
        last[p] = (n + 1, t)


def test_slices_grow_with_the_rows(spark, monkeypatch):
    from chronotok.operators import ranking

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ranking.slices_for(spark.range(100)) == parts
    monkeypatch.setattr(ranking, "ROWS_A_SLICE", 10)
    assert ranking.slices_for(spark.range(101)) == 11
