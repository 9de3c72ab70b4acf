import random

import numpy as np
from llm_cases import documents, empty, sentence, texts

from chronotok.llm import decontaminate as D


def bench(spark, n=30):
    rng = random.Random(9)
    items = [(i, sentence(rng, rng.randrange(8, 40)) + "\n" + sentence(rng, 6)) for i in range(n)]
    items += [(n, None), (n + 1, ""), (n + 2, "too few words"), (n + 3, items[0][1]), (n + 4, sentence(rng, 150))]
    return spark.createDataFrame(items, "item_id long, text string"), dict(items)


def test_wand_equals_exhaustive_scores(spark):
    frame, items = bench(spark)
    rng = random.Random(2)
    for index in [x for some in D.item_blocks(frame, 0.2) for x in some]:
        for _ in range(200):
            words = D.terms(items[rng.randrange(30)] + " " + sentence(rng, 30))
            words = rng.sample(words, min(len(words), rng.randrange(1, 40)))
            query = sorted({index.vocabulary[w] for w in words if w in index.vocabulary})
            score = np.zeros(len(index.ids))
            for t in query:
                score[index.items[t]] += index.impacts[t]
            for threshold in (0.05, 0.2, 0.5):
                index.threshold = threshold
                want = {i for i in range(len(score)) if score[i] >= threshold - 1e-9}
                assert {i for i, _ in index.search(query)} == want
            index.threshold = 0.2


def test_no_open_passage_is_missed(spark):
    frame, items = bench(spark)
    rng = random.Random(4)
    words = [D.terms(t) for t in texts(5) if t] + [D.terms(" ".join(rng.sample(items[i].split(), 8))) for i in range(20)]
    for index in [x for some in D.item_blocks(frame, 0.3) for x in some]:
        step, none = index.passage // 2, len(index.vocabulary)
        for own in words:
            numbers = np.array([index.vocabulary.get(w, none) for w in own], np.int64)
            opened = set(index.open_passages(numbers, np.arange(len(own)) // step).tolist())
            for block in range(-(-len(own) // step)):
                query = np.unique(numbers[block * step:block * step + index.passage])
                if index.search([int(t) for t in query if t != none]):
                    assert block in opened


def test_planted_items_are_found_and_clean_documents_left(spark):
    frame, items = bench(spark)
    docs, rows = documents(spark)
    rng = random.Random(6)
    planted = [(1000 + i, sentence(rng, 120) + " " + (items[i].upper() if i % 2 else items[i]) + " " + sentence(rng, 90))
               for i in range(30)] + [(1034, sentence(rng, 50) + items[34])]
    frame_docs = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in D.find_contaminated(frame_docs, frame).collect()}
    assert got == {(1000 + i, i) for i in range(30)} | {(1000, 33), (1034, 34)}
    left = D.drop_contaminated(docs.withColumnRenamed("kept", "item_id").unionByName(
        spark.createDataFrame(planted, "doc_id long, text string"), allowMissingColumns=True), frame)
    assert left.count() == len(rows) and "item_id" in left.columns


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    frame, items = bench(spark)
    docs = spark.createDataFrame([(i, t) for i, t in items.items()], "doc_id long, text string")
    found = lambda: sorted((r[0], r[1], *(round(x, 9) for x in r[2:])) for r in D.find_contaminated(docs, frame).collect())
    whole = found()
    monkeypatch.setattr(D, "BLOCK_ITEMS", 7)
    assert len(list(D.item_blocks(frame))) > 2
    assert found() == whole


def test_empty_tables(spark):
    frame, _ = bench(spark)
    none = empty(spark, "item_id long, text string")
    assert D.find_contaminated(empty(spark), frame).count() == 0
    assert D.find_contaminated(documents(spark)[0], none).count() == 0
    assert D.drop_contaminated(documents(spark)[0], none).count() == len(documents(spark)[1])


def test_a_better_but_false_passage_hides_no_copy(spark):
    frame, items = bench(spark)
    rng = random.Random(8)
    rows = []
    for i in range(20):
        words = items[i].split()
        shuffled = rng.sample(words, len(words))
        far = sentence(rng, 200)
        # The shuffled item fills one passage; the copy lies across a seam.
        rows.append((i, " ".join(shuffled) + " " + far + " " + sentence(rng, i) + " " + items[i]))
        rows.append((100 + i, " ".join(shuffled) + " " + far))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.find_contaminated(docs, frame).collect()}
    assert {(i, i) for i in range(20)} <= got
    assert all(doc < 100 for doc, _ in got)


def test_a_short_contaminated_first_text_touches_no_neighbour(spark):
    frame, items = bench(spark)
    for some in D.item_blocks(frame):
        for index in some:
            own = [D.terms(items[index.ids[0]])]
            for texts_ in (own, own + [D.terms("nothing of the kind")], own + own):
                found = list(index.matches(texts_))
                assert {(m[0], m[5] >= 0) for m in found} == {(t, True) for t in range(len(texts_)) if texts_[t] == own[0]}
                assert len({(m[0], m[1]) for m in found}) == len(found)


def test_the_score_does_not_depend_on_where_an_item_lies(spark):
    frame, items = bench(spark)
    for some in D.item_blocks(frame):
        for index in some:
            for item in (0, 5, 9):
                if item in index.ids:
                    own = D.terms(items[item])
                    texts_ = [["x"] * k + own + ["x"] * 100 for k in range(index.passage)]
                    scores = [m[2] for m in index.matches(texts_) if m[1] == item]
                    assert len(scores) == len(texts_) and min(scores) > 1 - 1e-9


def test_short_items_and_scripts_without_spaces_are_searched(spark):
    rng = random.Random(1)
    chinese = "世界上最高的山峰叫什么名字它位于哪个国家的边境。珠穆朗玛峰位于中国和尼泊尔边境"
    items = spark.createDataFrame([(0, chinese), (1, "Too few words"), (2, "..."), (3, "ยังไม่มีคำตอบสำหรับคำถามนี้เลย")],
                                  "item_id long, text string")
    docs = spark.createDataFrame(
        [(10, "前面的文字" + chinese + "后面的文字"), (11, sentence(rng, 60) + " too few WORDS, " + sentence(rng, 9)),
         (12, "few words too, words"), (13, "今天天气很好我们去公园散步然后回家吃饭看书睡觉"), (14, None),
         (15, "ก่อนยังไม่มีคำตอบสำหรับคำถามนี้เลยหลัง")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.find_contaminated(docs, items).collect()}
    assert got == {(10, 0), (11, 1), (15, 3)}
    assert {r.doc_id for r in D.drop_contaminated(docs, items).collect()} == {12, 13, 14}
