import math
import random

import pytest
import zstandard
from llm_cases import documents, empty, sentence

from chronotok.llm import quality_classifier as C


def labelled(spark, n=240):
    rng, docs, labels = random.Random(1), [], []
    for i in range(n):
        good = i % 3 > 0
        text = " ".join(sentence(rng, 12) for _ in range(4))
        docs.append((i, text if good else text.upper().replace(" ", "!! ")))
        labels.append((i, int(good), 0))
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_order(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r.score for r in C.score(docs, C.fit(docs, labels.filter("doc_id % 4 != 0"))).collect()}
    good = [s for i, s in got.items() if i % 4 == 0 and i % 3 > 0]
    bad = [s for i, s in got.items() if i % 4 == 0 and i % 3 == 0]
    assert min(good) > max(bad) and all(0 <= s <= 1 for s in got.values())


def plain_features(text, model):
    """Compressed sizes by a compressor made anew for every piece, as the docstring says."""
    raw = (text or "").encode("utf-8", "surrogatepass")

    def size(piece, dictionary):
        held = zstandard.ZstdCompressionDict(dictionary)
        made = zstandard.ZstdCompressor(level=C.LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)
        return len(made.compress(piece))

    part = lambda x: (size(x, model.bad) - size(x, model.good)) / len(x)
    pieces = [raw[i:i + C.CHUNK] for i in range(0, len(raw), C.CHUNK)]
    return (part(raw), min(part(x) for x in pieces)) if raw else (0.0, 0.0)


def test_scores_equal_brute_force(spark):
    docs, rows = documents(spark)
    model = C.fit(*labelled(spark))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in C.score(docs, model).collect())
    want = []
    for i, text in rows:
        z = model.weights[0] + sum(w * x for w, x in zip(model.weights[1:], plain_features(text, model)))
        want.append((-1 if i is None else i, 1 / (1 + math.exp(-z))))
    assert [i for i, _ in got] == [i for i, _ in sorted(want)]
    assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got, sorted(want)))


def test_fit_is_the_minimum_of_its_loss(spark):
    rng = random.Random(3)
    rows = [(" ".join(sentence(rng, 9) for _ in range(3)) + ("!!" * rng.randrange(9) if k else ""), k) for k in (0, 1) * 60]
    model = C._learn(rows)
    held = [(plain_features(t, model), y) for y in (0, 1) for t, _ in [r for r in rows if r[1] == y][30:]]

    def loss(w):
        fit = sum(math.log1p(math.exp(-(2 * y - 1) * (w[0] + w[1] * a + w[2] * b))) for (a, b), y in held)
        return fit + 0.5e-3 * sum(v * v for v in w)

    best = loss(model.weights)
    for at in range(3):
        for step in (-0.5, -0.05, 0.05, 0.5):
            moved = list(model.weights)
            moved[at] += step
            assert loss(moved) >= best - 1e-9


def test_edge_rows_and_few_labels(spark):
    docs, rows = documents(spark)
    base, labels = labelled(spark, 12)
    odd = labels.union(spark.createDataFrame([(None, 1, 0), (3, None, 0), (3, 0, 1), (10 ** 9, 1, 0)], labels.schema))
    model = C.fit(base, odd)
    got = C.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    empty_score = {r.score for r in got if r.doc_id in (43, 44)}
    assert len(empty_score) == 1
    assert C.score(empty(spark), model).count() == 0


@pytest.mark.parametrize("keep, want", [("quality = 1", 1.0), ("quality = 0", 0.0), ("false", 0.5)])
def test_one_kind_of_label(spark, keep, want):
    docs, labels = labelled(spark, 12)
    model = C.fit(docs, labels.filter(keep))
    assert {r.score for r in C.score(docs, model).collect()} == {want}


def test_held_out_accuracy_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = C.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    ranked = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert ranked > 0.9
