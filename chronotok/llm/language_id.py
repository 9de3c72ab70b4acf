"""Language identification (operator 7): script ranges, per-word scores and Viterbi spans.

The script of a word (by code point ranges) narrows its candidate languages to those whose training text uses that
script. A word's score for a language is the sum of its character n-grams' log probabilities. Viterbi over a text's
words, with a fixed penalty for a change of language, labels spans of one language each; the document's language
is the one that covers the most letters.

The model is learned by Spark counts over a bounded sample: about ``per_language`` documents of each language, those
whose id hashes below a bound that comes from the language's row count. N-grams fall into ``BUCKETS`` hash buckets,
so the model has a fixed size for each language. Labelling reads every whole text in one pass without a shuffle.

Defined results: a null, empty or letterless text is ``und`` with score 0; without any language learned every text
is ``und``; ties go to the language that comes first by name; rows with a null language are not learned from;
repeated rows are labelled one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronotok.llm.text import id_crc_mod, table

PER_LANGUAGE = 3000
ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
SWITCH_PENALTY = 6.0
SMOOTHING = 0.5
BLOCK_CHARS = 1 << 20
HOLD_OUT = 3
UNKNOWN = "und"

# First code points of runs of one script (Unicode blocks); the script number of each run follows.
# 0 other, 1 Latin, 2 Greek, 3 Cyrillic, 4 Armenian, 5 Hebrew, 6 Arabic, 7 Indic, 8 Thai and Lao, 9 Georgian,
# 10 Hangul, 11 Kana, 12 Han; a letter in a run of 0 is of script 13, other letters
SCRIPT_STARTS = np.array([0x0, 0x41, 0x5B, 0x61, 0x7B, 0xAA, 0xAB, 0xB5, 0xB6, 0xBA, 0xBB, 0xC0, 0x2B0, 0x370, 0x400,
                          0x530, 0x590, 0x600, 0x900, 0xE00, 0xF00, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000,
                          0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0xFB1D, 0xFB50, 0xFE00,
                          0xFE70, 0xFF00, 0xFF21, 0xFF3B, 0xFF41, 0xFF5B, 0xFF66, 0xFFA0, 0xFFE0, 0x20000, 0x40000])
SCRIPT_OF_RUN = np.array([0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 2, 3,
                          4, 5, 6, 7, 8, 0, 9, 10, 0, 1, 2, 0,
                          11, 0, 12, 0, 10, 0, 12, 1, 5, 6, 0,
                          6, 0, 1, 0, 1, 0, 11, 10, 0, 12, 0], np.int8)
OTHER_LETTERS, N_SCRIPTS = 13, 14
# Blocks of whole scripts among the runs of number 0, whose marks belong to their words.
OTHER_BLOCKS = ((0xF00, 0x10A0), (0x1200, 0x1AB0), (0x1B00, 0x1DC0), (0x2C00, 0x2E00), (0xA000, 0xAC00), (0x10000, 0x1D000),
                (0x1E000, 0x1F000))
# Letters that no run has, by code point: all of them are script ``OTHER_LETTERS``.
IS_OTHER = np.array([(kind := unicodedata.category(chr(c))[0]) == "L" or kind == "M" and any(a <= c < b for a, b in OTHER_BLOCKS)
                     for c in range(0x20000)] + [False])


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: bytes  # float32 [BUCKETS, languages], log probabilities less their mean over the languages
    allowed: bytes  # bool [N_SCRIPTS, languages]

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.languages)
        return (np.frombuffer(self.table, np.float32).reshape(BUCKETS, n),
                np.frombuffer(self.allowed, bool).reshape(N_SCRIPTS, n))


def _words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points, first and one-past-last position and script of each run of letters, and scripts."""
    low = text.lower() if len(text.lower()) == len(text) else "".join(
        c.lower() if len(c.lower()) == 1 else c for c in text)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    script = SCRIPT_OF_RUN[np.searchsorted(SCRIPT_STARTS, codes, "right") - 1]
    script[(codes == 0xD7) | (codes == 0xF7)] = 0
    rest = np.flatnonzero((script == 0) & (codes >= 0x2B0))
    script[rest[IS_OTHER[np.minimum(codes[rest], len(IS_OTHER) - 1)]]] = OTHER_LETTERS
    edge = np.flatnonzero(np.diff(np.concatenate([[0], script != 0, [0]]).astype(np.int8)))
    starts, stops = edge[::2], edge[1::2]
    return codes, starts, stops, script[starts], script


def _grams(codes: np.ndarray, script: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position of the last letter's word, bucket) for each order; a run's two edges count as characters."""
    inside = script != 0
    c = np.where(inside, codes, 1).astype(np.uint64)  # 1: an edge
    padded, real = np.concatenate([[1, 1], c, [1, 1]]).astype(np.uint64), np.concatenate([[False] * 2, inside, [False] * 2])
    n = len(padded)
    for order in ORDERS:
        h = np.full(n - order + 1, order, np.uint64)
        any_letter = np.zeros(n - order + 1, bool)
        for j in range(order):
            h = (h ^ padded[j:n - order + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        middle = order // 2  # the gram belongs to the word of its middle character, which must be a letter
        any_letter = real[middle:n - order + 1 + middle]
        at = np.flatnonzero(any_letter)
        yield at + middle - 2, (h[at] >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1)


def _train(rows: DataFrame) -> Model:
    """``rows`` has lang and text; counts by language and bucket (below 0: letters of a script) are summed by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                if not text:
                    continue
                counts = found.setdefault(lang, np.zeros(BUCKETS + N_SCRIPTS, np.int64))
                for i in range(0, len(text), BLOCK_CHARS):
                    codes, _, _, _, script = _words(text[i:i + BLOCK_CHARS])
                    counts[BUCKETS:] += np.bincount(script, minlength=N_SCRIPTS)
                    for _, buckets in _grams(codes, script):
                        counts[:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
        for lang, counts in found.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(counts[at])],
                                             ["lang", "at", "n"])

    counted = rows.mapInArrow(run, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    found = counted.collect()  # at most BUCKETS + N_SCRIPTS rows a language
    languages = tuple(sorted({r.lang for r in found}))
    if not languages:
        return Model((), b"", b"")
    place = {x: i for i, x in enumerate(languages)}
    counts = np.zeros((BUCKETS + N_SCRIPTS, len(languages)))
    for r in found:
        counts[r["at"], place[r.lang]] = r.n
    grams, letters = counts[:BUCKETS] + SMOOTHING, counts[BUCKETS:]
    logs = np.log(grams / grams.sum(axis=0))
    logs -= logs.mean(axis=1, keepdims=True)
    letters[0] = 0
    allowed = letters > 0.01 * letters.sum(axis=0)
    allowed[~allowed.any(axis=1)] = True  # a script nobody uses rules nobody out
    return Model(languages, (logs / len(ORDERS)).astype(np.float32).tobytes(), allowed.tobytes())


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Model:
    """Model of the given rows' languages, from about ``per_language`` documents of each."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).alias("lang")).filter("lang is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    bound = F.lit(0)
    for lang, n in sizes.items():
        bound = F.when(F.col("lang") == lang, F.lit(min(1 << 30, (per_language << 30) // n))).otherwise(bound)
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < bound).select("lang", "text")
    return _train(sample.repartition(8))


def word_scores(text: str, log_table: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each word, and [words, languages] scores."""
    n = log_table.shape[1]
    starts_all, sizes_all, scores_all = [], [], []
    at = 0
    while at < len(text):  # blocks end at white space where there is any
        end = min(len(text), at + BLOCK_CHARS)
        if end < len(text):
            space = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
            end = space + 1 if space > at else end
        codes, starts, stops, first, script = _words(text[at:end])
        if len(starts):
            word = np.cumsum(np.bincount(starts, minlength=len(codes))) - 1
            scores = np.zeros((len(starts), n))
            for where, buckets in _grams(codes, script):
                owner, values = word[where], log_table[buckets]
                for k in range(n):
                    scores[:, k] += np.bincount(owner, values[:, k], len(starts))
            scores[~allowed[first]] -= 1e3
            starts_all.append(starts + at)
            sizes_all.append(stops - starts)
            scores_all.append(scores)
        at = end
    if not starts_all:
        return np.empty(0, int), np.empty(0, int), np.empty((0, n))
    return np.concatenate(starts_all), np.concatenate(sizes_all), np.concatenate(scores_all)


def viterbi(scores: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best language of each word of several texts at once; text d has rows firsts[d] to firsts[d] + sizes[d]."""
    total, n = scores.shape
    order = np.argsort(-sizes, kind="stable")
    firsts, sizes = firsts[order], sizes[order]
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left")  # texts longer than t
    came = np.zeros((total, n), np.int8 if n < 128 else np.int16)
    own = np.arange(n)
    v = scores[firsts[:active[0]]] if len(active) else None
    ended = np.zeros((len(sizes), n))
    for t in range(1, len(active)):
        a = active[t]
        ended[a:len(v)] = v[a:]
        v = v[:a]
        best = v.argmax(axis=1)
        jump = v[np.arange(a), best][:, None] - penalty
        stay = v >= jump
        rows = firsts[:a] + t
        came[rows] = np.where(stay, own, best[:, None])
        v = np.where(stay, v, jump) + scores[rows]
    path = np.zeros(total, np.int64)
    if v is None:
        return path
    ended[:len(v)] = v
    state = ended.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        rows = firsts[:active[t]] + t
        path[rows] = state[:active[t]]
        state[:active[t]] = came[rows, state[:active[t]]]
    return path


def label_texts(texts: list[str | None], model: Model) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, score, spans of (start, end, language) over the words) of each text."""
    log_table, allowed = model.arrays()
    parts = [word_scores(t or "", log_table, allowed) for t in texts]
    sizes = np.array([len(p[0]) for p in parts], np.int64)
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else sizes
    used = np.flatnonzero(sizes)
    scores = np.concatenate([p[2] for p in parts]) if parts else np.empty((0, len(model.languages)))
    path = viterbi(scores, firsts[used], sizes[used])
    out: list = [(UNKNOWN, 0.0, [])] * len(texts)
    for d in used:
        starts, lengths, s = parts[d]
        own = path[firsts[d]:firsts[d] + sizes[d]]
        letters = np.bincount(own, lengths, len(model.languages))
        k = int(letters.argmax())
        mean = s[own == k].mean(axis=0) * min(int((own == k).sum()), 20)
        sure = 1 / np.exp(np.clip(mean - mean[k], -50, 50)).sum()
        cut = np.flatnonzero(np.diff(own)) + 1
        runs = zip([0, *cut], [*cut, len(own)])
        spans = [(int(starts[i]), int(starts[j - 1] + lengths[j - 1]), model.languages[own[i]]) for i, j in runs]
        out[d] = (model.languages[k], float(min(1.0, letters[k] / letters.sum() * sure)), spans)
    return out


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``spans`` (start, end, lang by code points) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # as many texts as hold about a block of characters
                texts, chars, first = [], 0, at
                while at < batch.num_rows and chars < BLOCK_CHARS:
                    texts.append(batch.column(1)[at].as_py())
                    chars += len(texts[-1] or "")
                    at += 1
                found = (label_texts(texts, model) if model.languages else [(UNKNOWN, 0.0, [])] * len(texts))
                spans = [[{"start": a, "end": b, "lang": x} for a, b, x in f[2]] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array([f[0] for f in found], pa.string()),
                     pa.array([f[1] for f in found], pa.float64()), pa.array(spans, kind)],
                    ["doc_id", "lang_pred", "score", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, "
                                "spans array<struct<start: long, end: long, lang: string>>")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(id_crc_mod(F.col("doc_id"), HOLD_OUT) != 1))
    return identify(docs, model).select(
        "doc_id", (id_crc_mod(F.col("doc_id"), HOLD_OUT) == 1).alias("held_out"), "lang_pred", "score",
        F.size("spans").cast("long").alias("n_spans"))
