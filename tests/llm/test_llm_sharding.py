import zlib

from llm_cases import documents, empty

from chronotok.llm import sharding as S
from chronotok.llm.text import crc32
from pyspark.sql import functions as F


def test_every_row_has_one_slot_and_sizes_are_near_equal(spark):
    docs, rows = documents(spark, n=300)
    got = S.shard_by_bytes(docs, 5).withColumn("crc", crc32(F.col("text"))).collect()
    assert len(got) == len(rows)
    sizes, slots = {}, {}
    for r in got:
        size = len((r.text or "").encode()) + 8
        assert r["size"] == size and r.crc == (None if r.text is None else zlib.crc32(r.text.encode()))
        sizes[r.shard] = sizes.get(r.shard, 0) + size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    largest = max(r["size"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest


def test_boundaries_equal_brute_force(spark):
    docs, _ = documents(spark, n=120)
    got = S.shard_by_bytes(docs, 7).collect()
    units = {}
    for r in got:
        units[r.k] = units.get(r.k, 0) + r["size"]
    total, at, want = sum(units.values()), 0, {}
    for k in sorted(units):
        want[k] = min(6, 7 * (2 * at + units[k]) // (2 * total))
        at += units[k]
    assert all(want[r.k] == r.shard for r in got)


def test_group_of_copies_is_split_and_contiguous(spark):
    docs = spark.range(900).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same text again', concat('own ', id)) as text")
    rows = S.shard_by_bytes(docs, 6).collect()
    sizes = [sum(r["size"] for r in rows if r.shard == s) for s in range(6)]
    assert max(sizes) - min(sizes) <= 60
    hot = sorted({r.shard for r in rows if r.text == "the same text again"})
    assert hot == list(range(hot[0], hot[-1] + 1)) and 2 <= len(hot) <= 4


def near_equal(rows, n, largest):
    sizes = [sum(r["size"] for r in rows if r.shard == s) for s in range(n)]
    slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(n)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(sizes) - min(sizes) <= 2 * largest, sizes


def test_a_repeated_row_is_cut_inside(spark):
    own = spark.range(600).selectExpr("id as doc_id", "concat('some text of its own ', id) as text")
    one = spark.range(300).selectExpr("cast(7000 as long) as doc_id", "'the very same row again' as text")
    rows = S.shard_by_bytes(own.unionByName(one), 24).collect()
    assert len(rows) == 900 and sum(r.doc_id == 7000 for r in rows) == 300
    near_equal(rows, 24, max(r["size"] for r in rows))


def test_a_third_of_the_rows_are_equal_and_others_repeat_too(spark):
    own = spark.range(2000).selectExpr("id as doc_id", "repeat(concat('own ', id, ' '), cast(1 + id % 5 as int)) as text")
    hot = spark.range(1200).selectExpr("cast(null as long) as doc_id", "'hot' as text")
    twice = spark.range(400).selectExpr("id % 200 as doc_id", "concat('twice ', id % 200) as text")
    rows = S.shard_by_bytes(own.unionByName(hot).unionByName(twice).repartition(5), 24).collect()
    assert len(rows) == 3600
    near_equal(rows, 24, max(r["size"] for r in rows))
    all_equal = S.shard_by_bytes(hot, 24).collect()
    near_equal(all_equal, 24, 11)


def test_tolerance_stops_early_but_stays_within_it(spark):
    docs = spark.range(20000).selectExpr("id as doc_id", "concat('text ', id) as text")
    got = S.shard_by_bytes(docs, 4, tolerance=0.01).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    total = sum(r.b for r in got)
    assert all(abs(r.b - total / 4) <= 0.02 * total / 4 + 64 for r in got)


def test_empty_and_null_tables(spark):
    assert S.shard_by_bytes(empty(spark)).count() == 0
    nulls = spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")
    rows = S.shard_by_bytes(nulls, 2).collect()
    assert len(rows) == 3 and all(r.doc_id is None and r.text is None for r in rows)
    near_equal(rows, 2, 8)  # equal rows are cut as well


def test_main_path_has_no_python(spark):
    plan = S.shard_by_bytes(documents(spark)[0])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
