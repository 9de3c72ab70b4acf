import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from llm_cases import documents, empty

from chronotok.llm import token_alignment as ta

PATHS = ta.public_paths()
HARD = ["Grüße aus Köln ﬁne", "naïve café — «déjà vu» 漢字かな交じり文 한국어", "<|endoftext|> <unk> <0x41> </s>", "a▁b", "tab\tand  spaces \n\n end",
        "🙂🙃 zero​width", "x" * 400, "Ａｆｕｌｌ", "\x00\x01 control", "0123456789 " * 30, "हिन्दी पाठ यहाँ है", "�"]


@lru_cache
def loaded():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATHS[0][0])
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def digest(text):
    """The contract read literally: byte sets of ends, all occurrence pairs."""
    none = (0, 0, 0, 0, "", Counter())
    if not text:
        return none
    t = loaded()[0]
    letters = ta.byte_letters()
    e = t.encode(" " + text, add_special_tokens=False)
    sp = loaded()[1]
    ids = [e.ids, sp.encode(text)]
    spelled = [[bytes(letters[c] for c in x) for x in e.tokens],
               [int(sp.id_to_piece(i)[3:5], 16).to_bytes() if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
                for i in ids[1]]]
    if any(b"".join(x) != b" " + text.encode() for x in spelled):
        return none
    ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelled]
    common = sorted(set(ends[0]) & set(ends[1]))
    groups = [([], []) for _ in common]
    for k in range(2):
        for i, x in zip(ids[k], ends[k]):
            groups[bisect_left(common, x)][k].append(i)  # the first common end that is not before the token's
    pairs = Counter((a, b) for ga, gb in groups for a in ga for b in gb)
    text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
    return len(ids[0]), len(ids[1]), len(groups), sum(pairs.values()), hashlib.sha256(text.encode()).hexdigest(), pairs


def brute(rows):
    found = [(i, digest(t)) for i, t in rows]
    count = Counter(p for _, d in found for p in d[5])
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return sorted(((i, *d[:4], sum(n for p, n in d[5].items() if count[p] == most[p[0]]),
                    sum(n * count[p] for p, n in d[5].items()), d[4]) for i, d in found), key=repr)


@pytest.mark.parametrize("lookup", [ta.LOOKUP_PAIRS, 0])
def test_against_brute_force(spark, lookup):
    docs, rows = documents(spark)
    more = [(1000 + i, t) for i, t in enumerate(HARD)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = ta.align_documents(docs, *PATHS, lookup_pairs=lookup).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows + more)


def test_empty_table_and_columns(spark):
    got = ta.align_documents(empty(spark), *PATHS)
    assert got.count() == 0
    assert dict(got.dtypes)["n_links"] == "bigint" and dict(got.dtypes)["groups_sha256"] == "string"


def test_alignments_spell_the_text(spark):
    docs, rows = documents(spark)
    spelled = [ta.byte_level(*PATHS[0])[1], ta.pieces(PATHS[1])[1]]
    got = ta.alignments(docs, *PATHS).filter("doc_id < 5").collect()
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    for r in got:
        parts = [[b"".join(s[x] for x in ids) for s, ids in zip(spelled, (g.a, g.b))] for g in r.groups]
        assert all(x == y for x, y in parts) and b"".join(x for x, _ in parts).decode()[1:] in texts[r.doc_id]


SOUP = ["a", "word", "Über", "漢字", "ﬁ", "é", "e\u0301", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u00a0", "\u2028", "\u3000", "'s", "1", "12.5",
        "!", "?!", "<|endoftext|>", "<0x41>", "\u200b", "🙂", "-", "\u0301", "the", "ing"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(SOUP), min_size=1, max_size=14).map("".join))
def test_units_give_the_tokens_of_the_whole_text(text):
    own = ta.aligner(*PATHS)
    found = own.digest(own.units([text])[0])
    got = (0, 0, 0, 0, "", Counter()) if found is None else (
        *found[:4], hashlib.sha256(found[4].encode()).hexdigest(), Counter(dict(zip(((int(k) >> 32, int(k) & (1 << 32) - 1) for k in found[5]), found[6].tolist()))))
    assert got == digest(text)


def test_units_are_forgotten_and_aligned_again(monkeypatch):
    monkeypatch.setattr(ta, "HELD_UNITS", 3)
    own = ta.Aligner(*PATHS)
    for text in ("one two three four five", "two six", "one\u2581bad two", "seven"):
        found = own.digest(own.units([text, None, "tail"])[0])
        assert (found is None) == ("\u2581" in text) and (found is None or found[:4] == digest(text)[:4])


@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)))
def test_galloping_finds_the_common_values(x, y):
    x, y = sorted(x), sorted(y)
    old, ta.ANCHOR = ta.ANCHOR, 3
    try:
        a, b = ta.galloped(np.array(x, np.int64), np.array(y, np.int64))
    finally:
        ta.ANCHOR = old
    assert [x[i] for i in a] == [y[i] for i in b] == sorted(set(x) & set(y))


@settings(max_examples=60)
@given(st.data())
def test_pairs_of_wide_groups(data):
    """Groups of every size, with repeated ids: distinct pairs with their multiplicities, none in two chunks."""
    shape = data.draw(st.lists(st.tuples(st.integers(1, 14), st.integers(1, 14)), min_size=1, max_size=6))
    to_a, to_b = np.cumsum([s[0] for s in shape]), np.cumsum([s[1] for s in shape])
    a, b = (np.array(data.draw(st.lists(st.integers(0, 6), min_size=int(n), max_size=int(n)))) for n in (to_a[-1], to_b[-1]))
    want, i, k = Counter(), 0, 0
    for j, m in zip(to_a, to_b):
        want.update((int(x) << 32 | int(y)) for x in a[i:j] for y in b[k:m])
        i, k = j, m
    old, ta.LINKS_AT_ONCE = ta.LINKS_AT_ONCE, data.draw(st.sampled_from([1, 10, 1 << 18]))
    try:
        chunks = list(ta.linked_pairs(a, b, to_a, to_b))
    finally:
        ta.LINKS_AT_ONCE = old
    keys = [int(x) for c, _ in chunks for x in c]
    assert len(keys) == len(set(keys))
    assert dict(zip(keys, (int(x) for _, t in chunks for x in t))) == dict(want)


def test_a_long_text_goes_on_in_further_rows(spark):
    text = " ".join(f"word{i}x{i * 7919 % 10007}" for i in range(6000))
    docs = spark.createDataFrame([(1, text), (2, "short one")], "doc_id long, text string")
    assert ta.aligned_rows(docs, *PATHS).count() > 2
    got = ta.align_documents(docs, *PATHS).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute([(1, text), (2, "short one")])
