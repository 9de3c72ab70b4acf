import numpy as np
import pytest
from llm_cases import documents, empty
from pyspark.sql import functions as F

from chronotok.llm import language_id as L

SAMPLES = {
    "en": "the quick brown fox jumps over the lazy dog and this is what they were thinking about with that other one",
    "de": "der schnelle braune fuchs springt über den faulen hund und das ist was sie sich dabei gedacht haben werden",
    "ru": "быстрая коричневая лиса прыгает через ленивую собаку и это то что они думали о другом",
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, " ".join(np.random.default_rng(i).permutation(SAMPLES[x].split())), x)
            for i in range(60) for x in SAMPLES] + [(900, None, "en"), (901, "no language", None), (902, "", "de")]
    return L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_spans_of_mixed_text(model):
    mixed = SAMPLES["en"] + ". " + SAMPLES["de"] + ". " + SAMPLES["ru"]
    lang, score, spans = L.label_texts([mixed], model)[0]
    assert [s[2] for s in spans] == ["en", "de", "ru"] and 0 < score < 1
    assert mixed[spans[1][0]:spans[1][1]].startswith("der") and lang in SAMPLES
    assert L.label_texts([SAMPLES["ru"]], model)[0][0] == "ru"


def test_viterbi_equals_brute_force():
    from itertools import product

    rng = np.random.default_rng(0)
    sizes = np.array([4, 1, 6, 3])
    firsts = np.cumsum(sizes) - sizes
    scores = rng.normal(size=(14, 3)) * 3
    path = L.viterbi(scores, firsts, sizes, 2.0)
    value = lambda p, f: sum(scores[f + i, s] for i, s in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
    for f, n in zip(firsts, sizes):
        best = max(value(p, f) for p in product(range(3), repeat=int(n)))
        assert value(path[f:f + n], f) == pytest.approx(best)


def test_word_scores_do_not_depend_on_blocks(model, monkeypatch):
    text = (SAMPLES["en"] + "\n" + SAMPLES["ru"] + " ") * 20
    tables = model.arrays()
    whole = L.word_scores(text, *tables)
    monkeypatch.setattr(L, "BLOCK_CHARS", 200)
    parts = L.word_scores(text, *tables)
    assert all(np.allclose(a, b) for a, b in zip(whole, parts))


def test_scripts_narrow_candidates(model):
    _, allowed = model.arrays()
    at = {x: i for i, x in enumerate(model.languages)}
    assert not allowed[3, at["en"]] and allowed[3, at["ru"]] and allowed[1, at["en"]] and allowed[12].all()


def test_edge_rows(spark, model):
    docs, rows = documents(spark)
    got = L.identify(docs, model).collect()
    assert len(got) == len(rows)
    none = [r for r in got if r.doc_id in (43, 44, 45)]
    assert {(r.lang_pred, r.score, len(r.spans)) for r in none} == {("und", 0.0, 0)}
    odd = spark.createDataFrame([(1, "12345 !!! ???"), (2, "ẞİ ŉ ǰ text"), (3, "漢字")], "doc_id long, text string")
    found = {r.doc_id: r.lang_pred for r in L.identify(odd, model).collect()}
    assert found[1] == "und" and found[2] in SAMPLES and found[3] in SAMPLES
    assert L.identify(empty(spark), model).count() == 0
    nothing = L.fit(empty(spark))
    assert {r.lang_pred for r in L.identify(docs, nothing).collect()} == {"und"}


def test_held_out_accuracy_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = L.query(spark, sf).join(docs, "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


@pytest.mark.parametrize("text", ["བོད་སྐད", "မြန်မာဘာသာ", "አማርኛ ቋንቋ", "ᏣᎳᎩ", "ᐃᓄᒃᑎᑐᑦ", "ភាសាខ្មែរ", "ᠮᠣᠩᠭᠣᠯ", "ㄅㄆㄇ", "ꆈꌠ", "ꯃꯤꯇꯩ", "ⵜⴰⵎⴰⵣⵉⵖⵜ", "𐌲𐌿𐍄", "𞤀𞤁"])
def test_letters_of_any_script_get_a_language(model, text):
    lang, score, spans = L.label_texts([text], model)[0]
    assert lang in SAMPLES and score > 0 and spans[0][0] == 0 and spans[-1][1] == len(text)


@pytest.mark.parametrize("text", ["😀 👍🏽 🇩🇪", "༡༢ ༔", "123 ፠", "①② ㈱ ℃", "♪𝄞", "🀄"])
def test_signs_without_a_letter_are_unknown(model, text):
    assert L.label_texts([text], model)[0] == (L.UNKNOWN, 0.0, [])
