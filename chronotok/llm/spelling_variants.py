"""Spelling variant grouping (operator 11): the vocabulary's acceptor composed with a one-edit transducer and itself.

The words of all texts are counted. Two words are near if one insertion, deletion or replacement of a code point
turns one into the other. The near pairs are the paths of the composition A o E o A, where A is the minimised acceptor
of the vocabulary and E the transducer of exactly one edit. Before the edit both sides read the same word, so they
stand in the same state of A; the edit takes one arc on one side or both; after it both sides must accept the same
rest. The edits of a state are enumerated once and used for every prefix that reaches it.

The composition is cut by initial state: the vocabulary is partitioned by the state that its first ``PREFIX`` code
points reach, and each partition builds its own acceptor and enumerates the pairs whose edit lies behind that prefix.
A pair whose edit lies within the prefix shares the last ``least - PREFIX`` code points (words have at least
``least``), so the acceptor of the reversed vocabulary, partitioned in the same way, gives the others. A state with
more than ``WORDS_A_STATE`` words is entered one code point deeper; the edits on the arcs that this skips leave the
state once, to equal rests, so the words meet on the key (prefix and rest), at most one for each letter.
Every pair is found in exactly one partition, which adds up per word the number of near words and the most frequent.

Defined results: a null or empty text has no words; a null id counts as empty text; repeated rows count each; an empty
table gives no rows; ties among near words go to the least in code-point order; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chronotok.llm.text import table
from chronotok.session import cut_lineage

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_POINTS = 7
LEAST_COUNT = 2
DROP_EVERY = 31
TIMES = 10  # a form is this many times as frequent as its variant
PREFIX = 3
WORDS_A_STATE = 32_768
HELD_WORDS = 200_000


def words_of(doc_id: int | None, text: str | None, least: int = LEAST_POINTS,
             drop_every: int | None = DROP_EVERY) -> Counter[str]:
    """Counts of one text's words of at least ``least`` code points; A-Z in lower case. With ``drop_every`` a run whose
    checksum with the id is divisible by it loses one code point."""
    runs = Counter(LETTERS.findall((text or "").encode("utf-8", "replace").lower().decode()))  # bytes: only A-Z change
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter[str] = Counter()
    for run, n in runs.items():
        if len(run) >= least:
            if drop_every:
                h = zlib.crc32(run.encode(), start)
                if h % drop_every == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1:]
            if len(run) >= least:
                out[run] += n
    return out


def counted_words(docs: DataFrame, least: int = LEAST_POINTS, drop_every: int | None = DROP_EVERY,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` and ``n`` (occurrences over all texts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                held.update(words_of(doc, text.as_py(), least, drop_every))
                if len(held) > HELD_WORDS:
                    yield _batch(held)
                    held.clear()
        if held:
            yield _batch(held)

    def _batch(held: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                          ["word", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def minimised(words: list[str]) -> tuple[list[dict[str, int]], list[bool]]:
    """Arcs and finality of the minimal acceptor of ascending distinct words; state 0 is the initial one."""
    arcs: list[dict[str, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path, last = [0], ""

    def close(depth: int) -> None:
        """Merge the states of the last word beyond ``depth`` with equal ones: same finality, same arcs."""
        while len(path) > depth + 1:
            state = path.pop()
            same = known.setdefault((final[state], tuple(arcs[state].items())), state)
            if same != state:
                arcs[path[-1]][last[len(path) - 1]] = same

    for word in words:
        shared = 0
        for x, y in zip(word, last):
            if x != y:
                break
            shared += 1
        close(shared)
        for c in word[shared:]:
            arcs[path[-1]][c] = len(arcs)
            path.append(len(arcs))
            arcs.append({})
            final.append(False)
        final[path[-1]] = True
        last = word
    close(0)
    return arcs, final


def _rests(arcs: list[dict[str, int]], final: list[bool], p: int, q: int, room: int | None, but: str = "") -> Iterator[str]:
    """Every word that both states accept, of at most ``room`` code points, not starting with ``but``."""
    stack: list[tuple] = [(p, q, 0, None)]
    while stack:
        p, q, n, read = stack.pop()
        if final[p] and final[q]:
            rest, link = [], read
            while link is not None:
                link, c = link
                rest.append(c)
            yield "".join(reversed(rest))
        if room is not None and n >= room:
            continue
        mine, other = arcs[p], arcs[q]
        for c in mine if len(mine) <= len(other) else other:
            if c in mine and c in other and (n or c != but):
                stack.append((mine[c], other[c], n + 1, (read, c)))


def _edits(arcs: list[dict[str, int]], final: list[bool], p: int, room: int | None) -> list[tuple[str, str]]:
    """Pairs of rests of state ``p`` that differ by an edit in their first place (the first place where they differ)."""
    out, leaving = [], list(arcs[p].items())
    less = None if room is None else room - 1
    for i, (a, to_a) in enumerate(leaving):
        out.extend((a + s, s) for s in _rests(arcs, final, p, to_a, less, a))  # inserted a
        for b, to_b in leaving[i + 1:]:
            out.extend((a + s, b + s) for s in _rests(arcs, final, to_a, to_b, less))
    return out


def accepted_pairs(words: list[str], behind: int = 0, room: int | None = None) -> Iterator[tuple[str, str]]:
    """Unordered pairs that A o E o A accepts, for ascending distinct words; the edit lies at ``behind`` or later,
    and with at most ``room`` code points from it to the end."""
    arcs, final = minimised(words)
    edits: dict[int, list[tuple[str, str]]] = {}
    stack: list[tuple[int, int, str]] = [(0, 0, "")]
    prefix: list[str] = []
    while stack:
        state, depth, c = stack.pop()
        del prefix[max(depth - 1, 0):]
        prefix.append(c) if c else None
        if depth >= behind:
            if state not in edits:
                edits[state] = _edits(arcs, final, state, room)
            if edits[state]:
                start = "".join(prefix)
                for x, y in edits[state]:
                    yield start + x, start + y
        stack.extend((to, depth + 1, c) for c, to in arcs[state].items())


def _pairs_of_state(depth: int, rows: list[tuple], room: int | None) -> Iterator[tuple[str, str]]:
    return accepted_pairs([r[0] for r in rows], depth, room)


def _pairs_of_key(depth: int, rows: list[tuple], room: int | None) -> Iterator[tuple[str, str]]:
    """Words that leave one state to equal rests: they differ at ``depth`` and nowhere else."""
    words = [r[0] for r in rows]
    for i, u in enumerate(words):
        for v in words[i + 1:]:
            if u[depth:depth + 1] != v[depth:depth + 1]:
                yield u, v


def _summed(parts: DataFrame, pairs_of: Callable, turned: bool, keep: int) -> DataFrame:
    """Per partition (``depth``, ``part``) and word: near words, and the most frequent one with its count. Of turned
    words only pairs count that differ in their first ``keep`` code points."""
    room = keep if turned else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (depth, _), rows in _streamed(batches):
            if len(rows) < 2:
                continue
            counts = dict(rows)
            near: dict[str, list] = {}
            for u, v in pairs_of(depth, rows, room):
                if turned:
                    if u[-keep:] == v[-keep:]:
                        continue
                for x, y in ((u, v), (v, u)):
                    z = y[::-1] if turned else y
                    seen = near.get(x)
                    if seen is None:
                        near[x] = [1, counts[y], z]
                        continue
                    seen[0] += 1
                    if (-counts[y], z) < (-seen[1], seen[2]):
                        seen[1:] = counts[y], z
            if near:
                found = [(x[::-1] if turned else x, *y) for x, y in near.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

    types, names = [pa.string(), pa.int64(), pa.int64(), pa.string()], ["word", "n_near", "near_n", "near"]
    dealt = parts.repartition("depth", "part").sortWithinPartitions("depth", "part", "s")
    return dealt.select("depth", "part", "s", "n").mapInArrow(run, "word string, n_near long, near_n long, near string")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(depth, part) and its (word, n) rows, one partition after the other, from sorted rows."""
    key, rows = None, []
    for b in batches:
        for depth, part, s, n in zip(*(c.to_pylist() for c in b.columns)):
            if (depth, part) != key:
                if rows:
                    yield key, rows
                key, rows = (depth, part), []
            rows.append((s, n))
    if rows:
        yield key, rows


def _near(words: DataFrame, depth: int, turned: bool, keep: int, most: int) -> DataFrame:
    """Near words of (``s``, ``n``) by acceptors of the states at ``depth``; of a larger state one code point deeper."""
    at, opened, found = depth, words, []
    while True:
        stated = opened.select(F.lit(at).alias("depth"), F.substring("s", 1, at).alias("part"), "s", "n")
        large = cut_lineage(stated.groupBy("part").count().filter(F.col("count") > most).select("part"))
        if large.isEmpty():
            return _union([*found, _summed(stated, _pairs_of_state, turned, keep)])
        found.append(_summed(stated.join(large, "part", "left_anti"), _pairs_of_state, turned, keep))
        opened = cut_lineage(stated.join(large, "part", "left_semi").select("s", "n"))
        rest = F.substring(F.col("s"), F.lit(at + 2), F.length("s"))
        left = opened if not turned else opened.filter(F.length("s") - at <= keep)
        both = F.array_distinct(F.array(F.concat(F.substring("s", 1, at), rest), "s"))
        keys = left.select(F.lit(at).alias("depth"), F.explode(both).alias("part"), "s", "n")
        found.append(_summed(keys, _pairs_of_key, turned, keep))
        opened = opened.filter(F.length("s") > at)
        at += 1


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def near_words(words: DataFrame, least: int = LEAST_POINTS, prefix: int = PREFIX, most: int = WORDS_A_STATE) -> DataFrame:
    """``word``, ``n_near``, ``near`` (the most frequent near word, ties to the least) and ``near_n`` of every word of
    a stored table (``word`` distinct and of at least ``least`` code points, ``n``) that has near words."""
    forward = _near(words.select(F.col("word").alias("s"), "n"), prefix, False, prefix, most)
    turned = _near(words.select(F.reverse("word").alias("s"), "n"), least - prefix, True, prefix, most)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    return forward.unionByName(turned).groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def followed(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the last word that ``form`` leads to. A form is ``TIMES`` as frequent as its word, so
    the links have no cycle and their length grows with the logarithm of the largest count; each round doubles the
    links that are followed."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = cut_lineage(now.join(step, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        if after.filter("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def variants(words: DataFrame, least: int = LEAST_POINTS, times: int = TIMES, prefix: int = PREFIX,
             most: int = WORDS_A_STATE) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every row of a stored table of words."""
    near = near_words(words, least, prefix, most)
    is_form: Column = F.col("near_n") >= times * F.col("n")
    formed = cut_lineage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"),
        F.when(is_form, F.col("near_n")).alias("form_n")))
    roots = followed(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def document_variants(docs: DataFrame, least: int = LEAST_POINTS, least_count: int = LEAST_COUNT, times: int = TIMES,
                      drop_every: int | None = None, id_col: str = "doc_id", text_col: str = "text",
                      most: int = WORDS_A_STATE) -> DataFrame:
    """The variants among all words of the texts that occur at least ``least_count`` times."""
    counted = counted_words(docs, least, drop_every, id_col, text_col)
    return variants(cut_lineage(counted.filter(F.col("n") >= least_count)), least, times, most=most)


def query(spark, sf_dir: str) -> DataFrame:
    return document_variants(table(spark, sf_dir, "documents"), drop_every=DROP_EVERY).select(
        "word", "form", "root", "n", "n_near", "form_n")
