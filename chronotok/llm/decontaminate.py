"""Benchmark decontamination (operator 5): BM25 over an inverted index of test items, queried by block-max WAND.

The items are indexed (term -> items with impacts), documents are cut into passages of twice the items'
length that overlap by half, and every passage is a query. An item's score is its BM25 score for the passage's terms over its score for
its own terms, so one threshold fits items of every length. All items at or above the threshold are retrieved and
then verified, each passage on its own: enough word n-grams of the item's question and of its answer must occur
around the passage.

Most passages are settled before a search: the most frequent terms together can give an item at most some share of
its own score, so an item that a passage's other terms do not give the rest stays below the threshold. These sums
are upper bounds, taken for all passages of a batch at once, so nothing is lost. Passages with an item that may
reach the threshold go through block-max WAND.

Items are taken in blocks of one length class and of at most ``BLOCK_ITEMS`` items and ``BLOCK_CHARS`` characters
on average. Indexes of at most that size together are sent to the tasks at a time, so a larger test set means more
passes and not larger tasks. The items and their terms' frequencies are stored once; where there are several passes,
what a pass finds is stored before the next index is made, so the driver holds one index however many items there
are. Document frequencies are counted over all items. Documents are read in place; nothing of them is shuffled.

Defined results: null and empty texts have no passages; an item with fewer than ``MIN_ITEM_WORDS`` words is
found where exactly its words follow one another, and one without any word nowhere; items equal in text are reported each; a document is reported once for an item, with
its best verified passage, and repeated rows are reported each; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronotok.llm.text import table
from chronotok.session import cut_lineage

K1, B = 1.2, 0.75
THRESHOLD = 0.5
QUESTION_OVERLAP = ANSWER_OVERLAP = 0.5
NGRAM = 3
MIN_ITEM_WORDS = 5
MIN_PASSAGE = 32
POSTING_BLOCK = 32
PASSED_OVER = 0.7
BLOCK_ITEMS, BLOCK_CHARS = 5_000, 8_000_000
BATCH_WORDS = 500_000

_WORD = re.compile(r"\w+").findall
# Letters and marks of scripts written without spaces: Thai, Lao, Myanmar, Khmer, Kana, Han.
_UNSPACED = ("\u0E01-\u0E3A\u0E40-\u0E4E\u0E81-\u0EBD\u0EC0-\u0ECD\u1000-\u103F\u1050-\u108F\u1780-\u17D3\u3005-\u3007"
             "\u3041-\u3096\u309D-\u309F\u30A1-\u30FA\u30FC-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF"
             "\uFF66-\uFF9F\U00020000-\U0003FFFF")
_HAS_UNSPACED = re.compile(f"[{_UNSPACED}]").search
_RUN = re.compile(f"[{_UNSPACED}]+|[^\\W{_UNSPACED}]+").findall


def terms(text: str | None) -> list[str]:
    """Words, and pairs of neighbouring characters of scripts written without spaces."""
    if not text:
        return []
    if text.isascii() or not _HAS_UNSPACED(text):
        return _WORD(text.lower())
    return [w for run in _RUN(text.lower())
            for w in ([run[i:i + 2] for i in range(len(run) - 1)] if len(run) > 1 and _HAS_UNSPACED(run) else [run])]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence or line is the answer; where one of the two has fewer words than an n-gram, the last third
    is, and both take at least an n-gram."""
    parts = [terms(p) for p in re.split(r"(?<=[.!?])\s+|\n", text)]
    parts = [p for p in parts if p]
    question = [w for p in parts[:-1] for w in p]
    if parts and min(len(question), len(parts[-1])) >= NGRAM:
        return question, parts[-1]
    words = terms(text)
    last = max(NGRAM, len(words) // 3)
    return words[:max(NGRAM, len(words) - last)], words[-last:]


def ngrams(words: list[str]) -> set[tuple[str, ...]]:
    n = min(NGRAM, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def passage_class(n_words: int) -> int:
    """Stride of the passages that look for an item of so many words: a power of two that is no shorter."""
    size = MIN_PASSAGE
    while size < n_words:
        size *= 2
    return size


class Index:
    """Postings of one block of items; impacts are shares of the item's own score."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n_items: int, mean_words: float,
                 threshold: float = THRESHOLD) -> None:
        self.ids = [i for i, _ in items]
        self.threshold = threshold
        words = [terms(t) for _, t in items]
        self.passage = 2 * passage_class(max(map(len, words)))  # every item lies whole in some passage
        self.parts = [tuple(map(ngrams, question_and_answer(t))) for _, t in items]
        self.vocabulary: dict[str, int] = {}
        lists: list[list[tuple[int, float]]] = []
        for item, own in enumerate(words):
            counts: dict[str, int] = {}
            for w in own:
                counts[w] = counts.get(w, 0) + 1
            norm = K1 * (1 - B + B * len(own) / mean_words)
            impact = {w: np.log1p((n_items - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm)
                      for w, c in counts.items()}
            total = sum(impact.values())
            for w, x in impact.items():
                at = self.vocabulary.setdefault(w, len(self.vocabulary))
                if at == len(lists):
                    lists.append([])
                lists[at].append((item, float(x / total)))
        self.items = [[i for i, _ in p] for p in lists]
        self.impacts = [[x for _, x in p] for p in lists]
        self.top = np.array([max(x) for x in self.impacts])
        self.block_top = [[max(x[i:i + POSTING_BLOCK]) for i in range(0, len(x), POSTING_BLOCK)] for x in self.impacts]
        # Frequent terms that together give no item more than ``PASSED_OVER`` of the threshold are passed over at
        # first; the other terms' postings are kept as flat arrays.
        held, rare = np.zeros(len(items)), np.ones(len(lists) + 1, bool)
        for t in sorted(range(len(lists)), key=lambda t: -len(lists[t])):
            grown = held.copy()
            grown[self.items[t]] += self.impacts[t]
            if grown.max() > threshold * PASSED_OVER:
                break
            held, rare[t] = grown, False
        self.needed = threshold - held - 1e-9
        sizes = np.array([len(x) if r else 0 for x, r in zip([*self.items, []], rare)])
        self.size, self.offset = sizes, np.cumsum(sizes) - sizes
        self.flat_items = np.array([i for x, r in zip(self.items, rare) if r for i in x], np.int64)
        self.flat_impacts = np.array([i for x, r in zip(self.impacts, rare) if r for i in x])

    def open_passages(self, numbers: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Blocks at which a passage (a block and the next) may reach the threshold for some item.

        ``numbers`` are the terms of many texts, ``block`` the number of the half passage of each; texts are parted by
        a number left out. Sums over repeated terms only raise the bound.
        """
        reps = self.size[numbers]
        ends = np.cumsum(reps)
        total = int(ends[-1]) if len(ends) else 0
        if not total:
            return np.empty(0, np.int64)
        at = np.arange(total) + np.repeat(self.offset[numbers] - ends + reps, reps)
        n = len(self.ids)
        keys, where = np.unique(np.repeat(block, reps) * n + self.flat_items[at], return_inverse=True)
        got = np.bincount(where, self.flat_impacts[at])
        after = np.searchsorted(keys, keys + n)
        follows = (after < len(keys)) & (keys[np.minimum(after, len(keys) - 1)] == keys + n)
        pair = got + np.where(follows, got[np.minimum(after, len(keys) - 1)], 0.0)
        needed = self.needed[keys % n]
        first = keys // n
        # A half that reaches the bound alone opens the passage before it as well.
        return np.unique(np.concatenate([first[pair >= needed], first[got >= needed] - 1]))

    def search(self, query: list[int]) -> list[tuple[int, float]]:
        """All (item, score) at or above the threshold for distinct term numbers, by block-max WAND."""
        least = self.threshold - 1e-9
        cursors = [[0, t] for t in query]
        out = []
        while cursors:
            cursors.sort(key=lambda c: self.items[c[1]][c[0]])
            bound, pivot = 0.0, -1
            for n, (_, t) in enumerate(cursors):
                bound += self.top[t]
                if bound >= least:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = self.items[cursors[pivot][1]][cursors[pivot][0]]
            while pivot + 1 < len(cursors) and self.items[cursors[pivot + 1][1]][cursors[pivot + 1][0]] == item:
                pivot += 1
            closer, nearest = 0.0, None
            for c in cursors[:pivot + 1]:  # the blocks that would hold the pivot item
                at = bisect_left(self.items[c[1]], item, c[0])
                if at < len(self.items[c[1]]):
                    closer += self.block_top[c[1]][at // POSTING_BLOCK]
                    last = self.items[c[1]][min(len(self.items[c[1]]), (at // POSTING_BLOCK + 1) * POSTING_BLOCK) - 1]
                    nearest = last if nearest is None else min(nearest, last)
            if closer >= least:
                score = 0.0
                for c in cursors[:pivot + 1]:
                    c[0] = bisect_left(self.items[c[1]], item, c[0])
                    if c[0] < len(self.items[c[1]]) and self.items[c[1]][c[0]] == item:
                        score += self.impacts[c[1]][c[0]]
                        c[0] += 1
                if score >= least:
                    out.append((item, score))
                jump = item + 1
            else:  # no item of these blocks can reach the threshold before the next list comes in
                jump = nearest + 1
                if pivot + 1 < len(cursors):
                    jump = min(jump, self.items[cursors[pivot + 1][1]][cursors[pivot + 1][0]])
                jump = max(jump, item + 1)
            for c in cursors[:pivot + 1]:
                c[0] = bisect_left(self.items[c[1]], jump, c[0])
            cursors = [c for c in cursors if c[0] < len(self.items[c[1]])]
        return out

    def matches(self, words: list[list[str]]) -> Iterator[tuple[int, int, float, float, float, int]]:
        """(text, item, score, question overlap, answer overlap, first word of the passage): best verified passage."""
        size, step, none = self.passage, self.passage // 2, len(self.vocabulary)
        place = self.vocabulary.get
        lengths = np.array([len(w) for w in words], np.int64)
        numbers = np.fromiter((place(w, none) for own in words for w in own), np.int64, int(lengths.sum()))
        firsts = np.cumsum(lengths) - lengths
        halves = -(-lengths // step) + 1  # one number is left out between texts
        blocks = np.cumsum(halves) - halves
        inside = np.arange(len(numbers)) - np.repeat(firsts, lengths)
        best: dict[tuple[int, int], tuple[float, float, float, int]] = {}
        for block in self.open_passages(numbers, np.repeat(blocks, lengths) + inside // step):
            if block < 0:  # opened as the passage before the first text's first half
                continue
            text = int(np.searchsorted(blocks, block, "right")) - 1
            start = int(block - blocks[text]) * step
            if start >= lengths[text]:
                continue
            begin = int(firsts[text]) + start
            query = np.unique(numbers[begin:min(begin + size, int(firsts[text] + lengths[text]))])
            around = None
            for item, score in self.search([int(t) for t in query if t != none]):
                if score <= best.get((text, item), (0.0,))[0]:
                    continue
                if around is None:
                    around = ngrams(words[text][max(0, start - step):start + size + step])
                q, a = (len(part & around) / len(part) for part in self.parts[item])
                if q >= QUESTION_OVERLAP and a >= ANSWER_OVERLAP:
                    best[text, item] = (score, q, a, start)
        for (text, item), found in best.items():
            yield text, self.ids[item], *found


class ShortItems:
    """Items of too few words for a score; a text contains one where all its words follow one another."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids: dict[tuple[str, ...], list[int]] = {}
        for i, text in items:
            self.ids.setdefault(tuple(terms(text)), []).append(i)
        self.sizes = sorted({len(k) for k in self.ids})

    def matches(self, words: list[list[str]]) -> Iterator[tuple[int, int, float, float, float, int]]:
        """As of an index: (text, item, 1, 1, 1, first word)."""
        for text, own in enumerate(words):
            first: dict[tuple[str, ...], int] = {}
            for n in self.sizes:
                for at, key in enumerate(zip(*(own[k:] for k in range(n)))):
                    if key in self.ids:
                        first.setdefault(key, at)
            for key, at in first.items():
                for i in self.ids[key]:
                    yield text, i, 1.0, 1.0, 1.0, at


def short_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[ShortItems]]:
    """The items below ``MIN_ITEM_WORDS`` words, in blocks of bounded size."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([0 < len(terms(t)) < MIN_ITEM_WORDS for t in b.column(1).to_pylist()], pa.bool_()))

    items = cut_lineage(rows.mapInArrow(short, "id long, text string"))
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(-(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).orderBy("id", "text").collect()
        if own:  # bounded by the block's size
            yield [ShortItems([tuple(x) for x in own])]


def item_blocks(benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "item_id",
                text_col: str = "text") -> Iterator[list[Index]]:
    """Indexes of the items, one list of bounded size after another."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [terms(t) for t in b.column(1).to_pylist()]
            keep = [i for i, w in enumerate(own) if len(w) >= MIN_ITEM_WORDS]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64())),
                 pa.array([len(own[i]) for i in keep], pa.int64()),
                 pa.array([sorted(set(own[i])) for i in keep], pa.list_(pa.string()))], ["id", "text", "n", "terms"])

    items = cut_lineage(rows.mapInArrow(count, "id long, text string, n long, terms array<string>"))
    df = cut_lineage(items.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    classes = items.groupBy(F.expr(_CLASS).alias("size")).agg(
        F.count("*").alias("n"), F.sum("n").alias("words"), F.sum(F.length("text")).alias("chars")).collect()
    n_items, words = sum(r["n"] for r in classes), sum(r.words for r in classes)
    taken: list[Index] = []
    held = [0, 0]
    for r in sorted(classes, key=lambda r: r["size"]):
        blocks = max(-(-r["n"] // BLOCK_ITEMS), -(-r.chars // BLOCK_CHARS))
        for k in range(blocks):
            block = items.filter((F.expr(_CLASS) == r["size"])
                                 & (F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k))
            own = block.select("id", "text").orderBy("id", "text").collect()  # bounded by the block's size
            used = block.select(F.explode("terms").alias("term")).distinct().join(df, "term").collect()
            if not own:
                continue
            chars = sum(len(x.text) for x in own)
            if taken and (held[0] + len(own) > BLOCK_ITEMS or held[1] + chars > BLOCK_CHARS):
                yield taken
                taken, held = [], [0, 0]
            taken.append(Index([tuple(x) for x in own], {x.term: x.df for x in used}, n_items, words / n_items, threshold))
            held = [held[0] + len(own), held[1] + chars]
    if taken:
        yield taken


# passage_class() in SQL
_CLASS = f"cast(greatest({MIN_PASSAGE}, power(2, ceil(log2(n)))) as int)"


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[list[str]]]]:
    """(first row, terms of each text) for stretches of a batch with about ``BATCH_WORDS`` words."""
    at = 0
    while at < batch.num_rows:
        first, words, held = at, [], 0
        while at < batch.num_rows and held < BATCH_WORDS:
            words.append(terms(batch.column(column)[at].as_py()))
            held += len(words[-1])
            at += 1
        yield first, words


def find_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
                      text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and test item that it contains."""
    schema = ("doc_id long, item_id long, score double, question_overlap double, answer_overlap double, "
              "passage_word long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def searcher(indexes: list[Index] | list[ShortItems]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            names = [c.split()[0] for c in schema.split(", ")]
            for b in batches:
                for first, words in _blocks(b, 1):
                    found = [(b.column(0)[first + m[0]].as_py(), *m[1:]) for x in indexes for m in x.matches(words)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names)
        return run

    return _passes(lambda indexes: rows.mapInArrow(searcher(indexes), schema), benchmark, threshold, item_col,
                   item_text_col) or docs.sparkSession.createDataFrame([], schema)


def _passes(run, benchmark: DataFrame, threshold: float, item_col: str, text_col: str) -> DataFrame | None:
    """``run`` over every list of indexes, or None without any. Of several passes each is stored before the next, so
    that no plan holds more than one list."""
    out, waiting = None, None
    for indexes in chain(item_blocks(benchmark, threshold, item_col, text_col), short_blocks(benchmark, item_col, text_col)):
        if waiting is not None:
            part = cut_lineage(waiting)
            out = part if out is None else out.unionByName(part)
        waiting = run(indexes)
    return waiting if out is None else out.unionByName(cut_lineage(waiting))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that contain no test item."""
    at = docs.columns.index(text_col)

    def hit_rows(b: pa.RecordBatch, column: int, indexes: list) -> list[int]:
        return sorted({first + m[0] for first, words in _blocks(b, column) for x in indexes for m in x.matches(words)})

    def cleaner(indexes: list[Index] | list[ShortItems]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[hit_rows(b, at, indexes)] = False
                yield b.filter(pa.array(keep))
        return run

    def finder(indexes: list[Index] | list[ShortItems]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(hit_rows(b, 1, indexes), pa.int64()))], ["row"])
        return run

    lists = chain(item_blocks(benchmark, threshold, item_col, item_text_col),
                  short_blocks(benchmark, item_col, item_text_col))
    first, second = next(lists, None), next(lists, None)
    if first is None:
        return docs
    if second is None:
        return docs.mapInArrow(cleaner(first), docs.schema)
    # Several passes: the rows are stored with a number, each pass stores the numbers of its hits.
    rows = cut_lineage(docs.select(F.monotonically_increasing_id().alias("row"),
                                   F.struct(*(docs[c] for c in docs.columns)).alias("whole")))
    texts = rows.select("row", F.col("whole")[text_col].cast("string").alias("text"))
    for indexes in chain([first, second], lists):
        hits = cut_lineage(texts.mapInArrow(finder(indexes), "row long"))
        rows = rows.join(hits.distinct(), "row", "left_anti")
    return rows.select("whole.*")


def query(spark, sf_dir: str) -> DataFrame:
    return find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
