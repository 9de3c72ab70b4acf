import random
import re

import numpy as np
import pytest
import xxhash
from llm_cases import documents, empty

from chronotok.llm import simhash as H
from chronotok.llm.components import components


def plain(text):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, bits):
    root = list(range(len(values)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def clustered(seed, n=250):
    """Fingerprints in chains and clouds of few differing bits, some at the edge of three."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(20)}
    for base in list(out)[:8]:
        x = base
        for _ in range(n // 8):
            x ^= sum(1 << rng.randrange(64) for _ in range(rng.choice((1, 2, 3))))
            out.add(x & ((1 << 64) - 1))
            if rng.random() < 0.3:
                x = base
    return sorted(out)


@pytest.mark.parametrize("bits", [1, 2, 3])
@pytest.mark.parametrize("bucket", [0, 2, 64])
def test_links_connect_exactly_the_near_ones(spark, bits, bucket):
    values = clustered(bits)
    if bits == 3 and bucket == 0:
        values = values[::4]
    frame = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    label = {r.node & ((1 << 64) - 1): r.label for r in components(H.links(frame, bits, bucket)).collect()}
    want = groups(values, bits)
    got = [label.get(v, signed(v)) for v in values]
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(values)) for j in range(i))


def test_pigeonring_budgets_never_reject_a_near_pair(spark):
    rng = random.Random(1)
    diffs = [sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 3))) for _ in range(300)]
    frame = spark.createDataFrame([(signed(d),) for d in diffs], "d long")
    from pyspark.sql import functions as F

    ok = None
    for i in range(5):
        one = H._chain_ok(F.col("d"), F.lit(i), 2)
        ok = one if ok is None else ok | one
    assert frame.filter(~ok).count() == 0


def test_documents_equal_brute_force(spark):
    docs, rows = documents(spark)
    got = H.near_duplicates(docs).collect()
    prints = [plain(t) for _, t in rows]
    root = groups(prints, 2)
    least = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    want = sorted(((d is not None, d or 0), p, least.get(r, -1)) for (d, _), p, r in zip(rows, prints, root))
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.fp & ((1 << 64) - 1),
                   -1 if r.component_id is None else r.component_id) for r in got) == want
    one = H.drop_near_duplicates(docs)
    assert one.columns == docs.columns and one.count() == len(set(root))
    assert H.near_duplicates(empty(spark)).count() == 0 and H.drop_near_duplicates(empty(spark)).count() == 0


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 150)] + [(200, 201), (201, 202), (202, 200)]
    rng.shuffle(edges)
    frame = spark.createDataFrame([(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges] + [(300, 300)],
                                  "a long, b long")
    got = {r.node: r.label for r in components(frame).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 150)}, 200: 200, 201: 200, 202: 200}
    assert components(frame.limit(0)).count() == 0


def test_long_text_fingerprint():
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert H.fingerprint(text) == plain(text)
    assert np.uint64(H.fingerprint(None)) == 0
