import zlib

import numpy as np
import pytest
from llm_cases import documents, empty

from chronotok.llm import packing as P

PATHS = P.public_paths()


def test_sum_of_squares_takes_the_least_change():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 33, 300)
    bins, offsets, used = P.sum_of_squares(lengths, 32)
    open_bins: dict[int, int] = {}  # bin -> fill, replayed by the plain rule

    def total(fills):
        gaps = [32 - f for f in fills.values() if f < 32]
        return sum(gaps.count(g) ** 2 for g in set(gaps))

    for at, s in enumerate(lengths):
        costs = []
        for b, f in list(open_bins.items()) + [(len(open_bins), 0)]:
            if f + s <= 32:
                costs.append(total({**open_bins, b: f + s}))
        placed = {**open_bins, int(bins[at]): open_bins.get(int(bins[at]), 0) + int(s)}
        assert total(placed) == min(costs)
        assert offsets[at] == open_bins.get(int(bins[at]), 0)
        open_bins = placed
    assert used.max() <= 32 and sum(used) == lengths.sum()


def test_encoder_equals_the_tokenizer():
    import random

    rng = random.Random(3)
    chars = list(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0   　​abAB12'.,!<|>é日д") + [
        "<|endoftext|>", "'s", "'ll"] + [chr(i) for i in range(0x250)]
    texts = ["".join(rng.choices(chars, k=rng.randrange(30))) for _ in range(3000)]
    plain = P.tokenizer(PATHS[0]).encode_batch_fast(texts, add_special_tokens=False)
    for paths in (PATHS, PATHS[:1]):
        assert all(list(a) == e.ids for a, e in zip(P.encoder(*paths)(texts), plain))


@pytest.mark.parametrize("capacity", [16, 1024])
def test_every_piece_has_one_gapless_place(spark, capacity):
    docs, rows = documents(spark)
    got = P.pack_documents(docs, PATHS, capacity).collect()
    full = [[*P.tokenizer(PATHS[0]).encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows]
    assert sum(r.length for r in got) == sum(map(len, full))
    spans: dict = {}
    for r in got:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.length == capacity or r.piece == 0
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    by_id = {d: np.array(f, "<u4") for (d, _), f in zip(rows, full) if d is not None and d != 5}
    for r in got:
        if r.doc_id in by_id:
            assert r.ids_crc32 == zlib.crc32(by_id[r.doc_id][r.start:r.start + r.length].tobytes())
    ids = P.packed_tokens(docs.filter("doc_id < 3"), P.pack_documents(docs.filter("doc_id < 3"), PATHS, capacity), PATHS,
                          capacity).collect()
    assert sum(len(p["ids"]) // 4 for r in ids for p in r.pieces) == sum(map(len, full[:3]))


def test_packing_is_close_to_the_bound(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('word ', cast(pmod(hash(id), 900) + 1 as int)) as text")
    got = P.pack_documents(docs, PATHS).selectExpr("count(distinct sequence_id) as n", "sum(length) as t").first()
    assert got.n <= 1.02 * got.t / 1024 + 1


def test_empty_table(spark):
    assert P.pack_documents(empty(spark), PATHS).count() == 0
