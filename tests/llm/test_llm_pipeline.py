import zlib

import corpus_pipeline as C
import numpy as np
from llm_cases import documents, empty

from chronotok.llm import packing, pii, quality_rules, simhash

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_predecessor(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in C.STAGES:
        stage(spark, seen[-1], SF).write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
    raw, cleaned, single, clean, masked, packed = seen
    assert all(x.columns == raw.columns for x in seen[:-1])

    judged = {r.doc_id: r for r in quality_rules.judge(raw).collect()}
    assert {r.doc_id: r.text for r in cleaned.collect()} == {i: r.clean_text for i, r in judged.items() if r.kept}

    near = simhash.near_duplicates(cleaned).collect()
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.component_id for r in near})

    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id: r.text for r in clean.collect()}
    for r in single.collect():
        if any(i in r.text for i in items):
            assert r.doc_id not in left
    assert len(left) > 0.9 * single.count() - 10

    for r in masked.collect():
        assert pii.base_spans(r.text) == [] and r.n_chars == len(r.text)
    assert masked.count() == len(left)

    tokens = packing.tokenizer(packing.public_paths()[0])
    full = {r.doc_id: np.array([*tokens.encode(r.text, add_special_tokens=False).ids, 2], "<u4") for r in masked.collect()}
    rows = packed.collect()
    assert sum(r.length for r in rows) == sum(map(len, full.values()))
    assert all(r.ids_crc32 == zlib.crc32(full[r.doc_id][r.start:r.start + r.length].tobytes()) for r in rows)
    assert C.run(spark, SF).count() == len(rows)


def test_edge_rows_pass_every_stage(spark):
    docs, _ = documents(spark)
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.count()
    assert C.STAGES[-1][1](spark, docs, SF).count() > 0
    for _, stage in C.STAGES:
        assert stage(spark, empty(spark, "doc_id long, text string, lang string, source string, n_chars long"), SF).count() == 0
