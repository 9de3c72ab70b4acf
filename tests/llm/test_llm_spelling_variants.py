import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from llm_cases import CLASHING, documents, empty

from chronotok.llm import spelling_variants as sv


def one_edit(u, v):
    if abs(len(u) - len(v)) > 1 or u == v:
        return False
    if len(u) == len(v):
        return sum(x != y for x, y in zip(u, v)) == 1
    long, short = (u, v) if len(u) > len(v) else (v, u)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(words):
    out = []
    forms = {}
    for w, n in words.items():
        near = sorted((-m, v) for v, m in words.items() if one_edit(w, v))
        form = near[0][1] if near and -near[0][0] >= 10 * n else None
        forms[w] = form
        out.append([w, form, n, len(near), words[form] if form else None])
    for row in out:
        root = row[0]
        while forms[root]:
            root = forms[root]
        row.insert(2, root)
    return sorted(map(tuple, out))


def counted(rows, least=7, least_count=2):
    words = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                words[run] += 1
    return {w: n for w, n in words.items() if n >= least_count}


def made(seed, n=260):
    """Words of few letters, so that runs of one letter, shared prefixes and near words abound."""
    import random

    rng = random.Random(seed)
    out = Counter()
    for _ in range(n):
        w = "".join(rng.choice("abÿ") for _ in range(rng.randrange(7, 10)))
        out[w] += rng.choice([1, 1, 2, 30, 400])
        i = rng.randrange(len(w) + 1)
        for v in (w[:i] + rng.choice("abz") + w[i:], w[:i] + w[i + 1:], w[:i] + "c" + w[i + 1:]):
            if len(v) >= 7:
                out[v] += rng.choice([1, 3, 50])
    return dict(out)


def got(spark, words, **kw):
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    return sorted(map(tuple, sv.variants(table, **kw).select("word", "form", "root", "n", "n_near", "form_n").collect()))


@pytest.mark.parametrize("most", [sv.WORDS_A_STATE, 40, 3])
def test_variants_against_brute_force(spark, most):
    """Also with states that are entered deeper, down to single words."""
    words = made(most)
    assert got(spark, words, most=most) == brute(words)


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=6), max_size=40))
def test_accepted_pairs_are_the_near_pairs_each_once(words):
    found = [frozenset(p) for p in sv.accepted_pairs(sorted(words))]
    assert len(found) == len(set(found))
    assert set(found) == {frozenset((u, v)) for u in words for v in words if one_edit(u, v)}


@given(st.sets(st.text("ab", max_size=7), max_size=40))
def test_acceptor_is_minimal_and_accepts_the_words(words):
    arcs, final = sv.minimised(sorted(words))
    reached, stack, seen = set(), [(0, "")], set()
    while stack:
        p, w = stack.pop()
        reached.add(p)
        if final[p]:
            seen.add(w)
        stack.extend((q, w + c) for c, q in arcs[p].items())
    assert seen == words
    rights = {p: frozenset(w for w in language(arcs, final, p)) for p in reached}
    assert len(set(rights.values())) == len(rights)


def language(arcs, final, p):
    if final[p]:
        yield ""
    for c, q in arcs[p].items():
        yield from (c + w for w in language(arcs, final, q))


def test_texts_against_brute_force(spark):
    docs, rows = documents(spark, n=30)
    more = [(2000 + i, " ".join(w for w, n in made(i, 40).items() for _ in range(min(n, 25))) + " ÀÉtoile× NAÏVETÉ naïveté")
            for i in range(12)] + [(None, "Naiveté NAÏVETÉ " * 30)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    assert "kept" in docs.columns and "kept" in CLASHING
    found = sv.document_variants(docs, drop_every=sv.DROP_EVERY).select("word", "form", "root", "n", "n_near", "form_n")
    want = brute(counted(rows + more))
    assert len(want) > 200 and sorted(map(tuple, found.collect())) == want


def test_chains_of_forms_ties_and_long_words(spark):
    long = "ab" * 3000
    words = {"abcdefg": 1000, "abcdefgh": 100, "abcdefghi": 10, "abcdefghij": 1, "zzzzzzz": 5, "zzzzzzy": 50, "zzzzzzx": 50,
             long: 100, long + "c": 2, "x" + long: 3, "a" * 2000: 4, "a" * 2001: 40}
    assert got(spark, words) == brute(words)


def test_empty_table(spark):
    assert sv.document_variants(empty(spark)).count() == 0
    assert dict(sv.document_variants(empty(spark)).dtypes)["n_near"] == "bigint"
