import random
import re

import numpy as np
import pytest
from llm_cases import documents, empty, sentence

from chronotok.llm import substring_dedup as B


def brute(rows, k):
    words = [re.findall("[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - k + 1):
            if d is not None:
                g = tuple(w[i:i + k])
                first[g] = min(first.get(g, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - k + 1):
            if d is not None and first[tuple(w[i:i + k])] < d:
                gone.update(range(i, i + k))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, *r[1:])


def shared(seed=0, n=60):
    rng = random.Random(seed)
    pool = [sentence(rng, rng.randrange(5, 60)) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [rng.choice(pool) if rng.random() < 0.5 else sentence(rng, rng.randrange(1, 30)) for _ in range(5)]
        rows.append((rng.randrange(1000), "\n".join(parts)))
    rows += [rows[0], (rows[1][0], rows[2][1]), (None, rows[3][1]), (7, " ".join(["same"] * 60)), (8, " ".join(["same"] * 40))]
    return rows


@pytest.mark.parametrize("k, m, block", [(13, 5, 500_000), (13, 5, 50), (4, 2, 80), (5, 5, 60), (2, 1, 100)])
def test_equals_brute_force(spark, monkeypatch, k, m, block):
    monkeypatch.setattr(B, "BLOCK_WORDS", block)
    rows = shared(k)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in B.deduplicate(docs, k, m).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, k), key=key)


@pytest.mark.parametrize("seed", range(3))
def test_few_words_many_overlaps(spark, monkeypatch, seed):
    """Small alphabets give repeated rows, runs repeated within a row and every kind of partial overlap."""
    monkeypatch.setattr(B, "BLOCK_WORDS", 40)
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        base = [rng.choice("abcd") for _ in range(rng.randrange(3, 14))]
        rows.append((rng.randrange(60), " ".join(base * rng.choice((1, 1, 2)))))
    rows += rng.sample(rows, 30)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k, m in ((4, 2), (6, 3)):
        got = [tuple(r) for r in B.deduplicate(docs, k, m).collect()]
        assert sorted(got, key=key) == sorted(brute(rows, k), key=key)


def test_edge_rows(spark):
    docs, rows = documents(spark)
    got = [tuple(r) for r in B.deduplicate(docs).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, 13), key=key)
    assert B.deduplicate(empty(spark)).count() == 0


def test_paths_are_maximal_runs_of_source_coordinates(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, passage), (2, "x y " + passage + " z"), (3, " ".join(f"p{i}" for i in range(20)) + " branch " * 15)]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    base = {d: B.row_part(t) for d, t in rows}
    got = {(r.doc_id, r.start - base[r.doc_id], r.n, r.src_doc, r.src_start - base[r.src_doc])
           for r in B.repeated_paths(own.repartition("doc_id"), own).collect()}
    assert got == {(2, 2, 40, 1, 0), (3, 0, 20, 1, 0)}


def test_helpers():
    h = np.arange(50, dtype=np.uint64) * np.uint64(7919) % np.uint64(101)
    for width in (1, 2, 3, 9, 16):
        assert list(B.sliding_min(h, width)) == [min(h[i:i + width]) for i in range(len(h) - width + 1)]
    assert list(B.gram_hashes(h, 3)) == [int(B.gram_hashes(h[i:i + 3], 3)[0]) for i in range(48)]
    assert len(B.gram_hashes(h[:2], 3)) == 0


def test_collision_of_hashes_removes_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c x y z")], "doc_id long, text string")
    start = B.row_part("a b c x y z") + 3
    wrong = docs.filter("doc_id = 2").selectExpr(
        "doc_id", "text", f"array(named_struct('start', {start}L, 'n', 3, 'digest', cast('not it' as binary))) as spans")
    assert [r.n_removed for r in B._cut(wrong, 3).collect()] == [0]
