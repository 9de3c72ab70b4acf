"""Cross-tokenizer alignment (operator 13): galloping intersection of token ends.

A text is encoded by two tokenizers over the same bytes. The ascending byte ends of both encodings are intersected:
each end of the shorter list is sought in the longer one by an exponential search from the place reached so far,
then by a binary search. The common ends cut both encodings into groups, and the differences between the ranks of
successive common ends are the ranges of tokens that overlap each other. Every token of one side is linked with
every token of the other side in its group.

Both tokenizers encode a text unit by unit: neither has a token that goes on over a single space between two other
characters, so both end a token before it. A task keeps the units that it has aligned (up to ``HELD_UNITS``), and
aligns the new units of a batch of texts together, as one ascending list of ends.

An id pair's count is the number of documents that hold the pair linked. Documents are encoded once and written
with their distinct pairs (at most ``PAIRS_A_ROW`` a row, so no row grows with its text); pairs are counted by a
partial and a final aggregate. Up to ``LOOKUP_PAIRS`` distinct pairs, checked by counting them, the counts go to the
tasks as sorted arrays; beyond that the documents' pairs are joined with the table of counts. Both give the same.

Defined results: a null or empty text, or one whose tokens do not spell its bytes (the second tokenizer may normalise
a text), has no tokens: zeros and no groups. Rows are documents one by one, so repeated rows count each, and null ids
are kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronotok.llm.packing import BEYOND_LATIN, encoder, tokenizer
from chronotok.llm.text import table
from chronotok.session import cut_lineage

PAIRS_A_ROW = 2048
HELD_UNITS, HELD_CHARS = 400_000, 8_000_000
BATCH_TEXTS = 128
LOOKUP_PAIRS = 4_000_000  # 64 MB of sorted pairs and counts
ANCHOR = 8
WIDE_LINKS = 64  # groups of more links are taken by distinct ids with their multiplicities
LINKS_AT_ONCE = 1 << 18
SPACE_MARK = "▁"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def byte_level(path: str, ranks_path: str | None = None):
    """(texts -> ids of space and text, bytes of each id) of a byte-level vocabulary."""
    letters = byte_letters()
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    spelled = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        spelled[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    encode = encoder(path, ranks_path)
    return (lambda texts: encode([" " + t for t in texts])), spelled


@lru_cache(maxsize=2)
def pieces(path: str):
    """(texts -> ids, bytes of each id, whether texts can be taken by units) of a sentencepiece model that marks spaces
    and falls back to bytes."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        rules = sentencepiece_model_pb2.ModelProto.FromString(f.read()).normalizer_spec
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    spelled = [int(x[3:5], 16).to_bytes() if model.is_byte(i) else x.replace(SPACE_MARK, " ").encode()
               for i, x in enumerate(names)]
    by_unit = (rules.add_dummy_prefix and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
               and not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", x) for x in names))
    return (lambda texts: model.encode(texts, num_threads=1)), spelled, by_unit


def galloped(driver: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the common values in both ascending arrays; every value of ``driver`` is sought in ``longer``."""
    place, n = _places(driver, longer), len(longer)
    found = np.flatnonzero(longer[np.minimum(place, n - 1)] == driver) if n else np.empty(0, np.int64)
    return found, place[found]


def _places(x: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """First places of ``longer`` that are not below ``x``. Every ``ANCHOR``-th value is placed first, in the same way;
    the others gallop from the one before them, all of them side by side."""
    if len(x) <= ANCHOR:
        return _gallop(x, np.zeros(len(x), np.int64), longer)
    return _gallop(x, np.repeat(_places(x[::ANCHOR], longer), ANCHOR)[:len(x)], longer)


def _gallop(x: np.ndarray, low: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """First places of ``longer``, from ``low`` on, that are not below ``x``: steps of 1, 2, 4, ... then halves."""
    n = len(longer)
    low = low.copy()
    high = low.copy()  # below x at every place before ``low``, not below x from ``high`` on (or the end)
    going, step = np.arange(len(x)), 1
    while len(going):
        going = going[high[going] < n]
        going = going[longer[high[going]] < x[going]]
        low[going] = high[going] + 1
        high[going] += step
        step *= 2
    high = np.minimum(high, n)
    going = np.flatnonzero(low < high)
    while len(going):
        middle = (low[going] + high[going]) // 2
        below = longer[middle] < x[going]
        low[going[below]] = middle[below] + 1
        high[going[~below]] = middle[~below]
        going = going[low[going] < high[going]]
    return low


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exclusive last rank of every group in both arrays of byte ends."""
    if len(ends_a) <= len(ends_b):
        a, b = galloped(ends_a, ends_b)
    else:
        b, a = galloped(ends_b, ends_a)
    return a + 1, b + 1


def _distinct(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, times
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(times, first)


def narrow_links(a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray,
                 chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every link of the chosen groups as a pair (A id in the upper 32 bits), and its group."""
    n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
    group = np.repeat(np.arange(len(n_a)), n_a)
    at = np.flatnonzero(chosen[group])
    per = n_b[group[at]]  # links of each A token
    within = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    return (np.repeat(a[at] << 32, per) | b[np.repeat((to_b - n_b)[group[at]], per) + within],
            np.repeat(group[at], per))


def linked_pairs(a: np.ndarray, b: np.ndarray, to_a: np.ndarray,
                 to_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of distinct linked id pairs and how often each is linked; no pair is in two chunks. ``to_a`` and ``to_b``
    are the groups' exclusive last ranks."""
    n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
    wide = n_a * n_b > WIDE_LINKS
    keys = narrow_links(a, b, to_a, to_b, ~wide)[0]
    narrow = _distinct(keys, np.ones(len(keys), np.int64))
    if not wide.any():
        yield narrow
        return
    # Wide groups: each distinct A id of a group meets the group's distinct B ids. Chunks hold whole A ids.
    rows = []
    for g in np.flatnonzero(wide).tolist():
        ids_b = np.unique(b[to_b[g] - n_b[g]:to_b[g]], return_counts=True)
        for i, n in zip(*(x.tolist() for x in np.unique(a[to_a[g] - n_a[g]:to_a[g]], return_counts=True))):
            rows.append((i, n, ids_b))
    rows.sort(key=lambda r: r[0])
    start, low = 0, 0
    while start < len(rows):
        stop, size = start, 0
        while stop < len(rows) and (size < LINKS_AT_ONCE or rows[stop][0] == rows[stop - 1][0]):
            size += len(rows[stop][2][0])
            stop += 1
        high = (rows[stop][0] if stop < len(rows) else 1 << 31) << 32
        lo, hi = np.searchsorted(narrow[0], [low, high])
        yield _distinct(np.concatenate([narrow[0][lo:hi], *((i << 32) | ids for i, _, (ids, _) in rows[start:stop])]),
                        np.concatenate([narrow[1][lo:hi], *(n * c for _, n, (_, c) in rows[start:stop])]))
        start, low = stop, high


BREAK = re.compile(r"(?<=\S) (?=\S)")
BEYOND = re.compile(BEYOND_LATIN).search
JOINED_UNITS = 20_000
LOOSE_SPACE = re.compile(r"\A\s|\s\Z|\s | \s")


def units(text: str) -> list[str]:
    """The text cut at single spaces between other characters; a unit stands for itself and the space before it."""
    return BREAK.split(text) if LOOSE_SPACE.search(text) else text.split(" ")


class Aligner:
    """Aligned units: numbers of tokens, groups and links, the spelled groups, and the distinct linked pairs."""

    def __init__(self, byte_paths: tuple[str, ...], piece_path: str) -> None:
        self.encode_a, self.bytes_a = byte_level(*byte_paths)
        self.encode_b, self.bytes_b, self.by_unit = pieces(piece_path)
        self.lengths_a, self.lengths_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        ids = [*map(str, range(len(self.bytes_a))), *map(str, range(len(self.bytes_b)))]
        last = ["|"] * len(self.bytes_a) + [";"] * len(self.bytes_b)
        self.signed = np.array([*(i + "," for i in ids), *map("".join, zip(ids, last))], object)  # ids and what follows them
        self.sizes = np.array(list(map(len, self.signed)), np.int64)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.spelled: list[str] = []
        self.counts = np.empty((0, 5), np.int64)  # tokens of A, of B, groups, links, whether the bytes are the text's
        self.firsts = np.zeros(1, np.int64)  # of each unit's pairs; one more for the end
        self.keys = self.times = np.empty(0, np.int64)
        self.once = True  # no unit links a pair more than once

    def units(self, texts: list[str | None]) -> list[list[str]]:
        """The units of each text, all of them aligned."""
        if len(self.number) > HELD_UNITS or self.chars > HELD_CHARS:
            self.forget()
        cut = [[] if not t else units(t) if self.by_unit else [t] for t in texts]
        new = list({u for own in cut for u in own}.difference(self.number))
        if new:
            self._add(new)
        return cut

    def _add(self, new: list[str]) -> None:
        """Align units: regular ones joined to long texts, which encode as fast as any, the others one by one."""
        latin, other, single = [], [], []
        for u in new:
            if u[:1].isspace() or u[-1:].isspace():
                single.append(u)
            else:
                (latin if u.isascii() or not BEYOND(u) else other).append(u)
        for own in (latin, other):
            for at in range(0, len(own), JOINED_UNITS):
                part = own[at:at + JOINED_UNITS]
                if not self._add_joined(part):
                    single += part
        for u in single:
            if not self._add_joined([u]):
                self._keep([u], np.zeros((1, 5), np.int64), [""], np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, np.int64))

    def _add_joined(self, own: list[str]) -> bool:
        """Align units in one text; False, and nothing kept, where the tokens of one side do not spell it."""
        text = " ".join(own)
        a, b = (np.asarray(x, np.int64) for x in (self.encode_a([text])[0], self.encode_b([text])[0]))
        whole = b" " + text.encode("utf-8", "surrogatepass")
        if any(b"".join([spelled[i] for i in ids.tolist()]) != whole for spelled, ids in ((self.bytes_a, a), (self.bytes_b, b))):
            return False
        ends_a, ends_b = np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])
        last_a, last_b = groups(ends_a, ends_b)
        sizes = np.fromiter((len(u) if u.isascii() else len(u.encode("utf-8", "surrogatepass")) for u in own), np.int64, len(own))
        ends = np.searchsorted(ends_a[last_a - 1], np.cumsum(sizes + 1)) + 1  # groups up to each unit's end
        to_a, to_b = last_a[ends - 1], last_b[ends - 1]
        n_groups = np.diff(ends, prepend=0)
        links = np.concatenate(([0], np.cumsum(np.diff(last_a, prepend=0) * np.diff(last_b, prepend=0))))[ends]
        counts = np.stack([np.diff(to_a, prepend=0), np.diff(to_b, prepend=0), n_groups, np.diff(links, prepend=0),
                           np.ones(len(own), np.int64)], axis=1)
        self._keep(own, counts, self._spelled(a, b, last_a, last_b, ends), *self._pairs(a, b, last_a, last_b, ends, n_groups))
        return True

    def _keep(self, own: list[str], counts: np.ndarray, spelled: list[str], keys: np.ndarray, times: np.ndarray,
              sizes: np.ndarray) -> None:
        self.number.update(zip(own, range(len(self.spelled), len(self.spelled) + len(own))))
        self.chars += sum(map(len, own))
        self.spelled += spelled
        self.counts = np.concatenate([self.counts, counts])
        self.firsts = np.concatenate([self.firsts, self.firsts[-1] + np.cumsum(sizes)])
        self.keys, self.times = np.concatenate([self.keys, keys]), np.concatenate([self.times, times])
        self.once = self.once and not (times > 1).any()

    def _spelled(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, ends: np.ndarray) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each unit; ``ends`` are the groups up to each unit's end. Every id is written with
        the sign that follows it, all of them in one text, which is cut at the units."""
        group_a = np.repeat(np.arange(len(last_a)), np.diff(last_a, prepend=0))
        group_b = np.repeat(np.arange(len(last_b)), np.diff(last_b, prepend=0))
        closing_a, closing_b = (np.zeros(len(x), bool) for x in (a, b))
        closing_a[last_a - 1] = closing_b[last_b - 1] = True
        n = len(self.bytes_a) + len(self.bytes_b)
        signed = np.empty(len(a) + len(b), np.int64)
        signed[np.arange(len(a)) + np.concatenate(([0], last_b))[group_a]] = a + n * closing_a
        signed[np.arange(len(b)) + last_a[group_b]] = len(self.bytes_a) + b + n * closing_b
        whole = "".join(self.signed[signed].tolist())
        cuts = np.cumsum(self.sizes[signed])[(last_a + last_b - 1)[ends - 1]].tolist()
        return [whole[i:j - 1] for i, j in zip([0, *cuts], cuts)]

    @staticmethod
    def _pairs(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, ends: np.ndarray,
               n_groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linked pairs of the units one after another, how often each is linked, and how many a unit has."""
        in_a, in_b = np.diff(last_a, prepend=0), np.diff(last_b, prepend=0)
        wide = np.unique(np.searchsorted(ends, np.flatnonzero(in_a * in_b > WIDE_LINKS), "right"))
        unit = np.repeat(np.arange(len(ends)), n_groups)
        narrow = ~np.isin(unit, wide)
        keys, owners = narrow_links(a, b, last_a, last_b, narrow)
        found = [(keys, np.ones(len(keys), np.int64), unit[owners])]
        for u in wide.tolist():
            i, j = int(ends[u] - n_groups[u]), int(ends[u])
            x, y = (int(last_a[i - 1]), int(last_b[i - 1])) if i else (0, 0)
            chunks = list(linked_pairs(a[x:int(last_a[j - 1])], b[y:int(last_b[j - 1])], last_a[i:j] - x, last_b[i:j] - y))
            found += [(k, t, np.full(len(k), u)) for k, t in chunks]
        keys, times, owner = (np.concatenate(c) for c in zip(*found))
        if len(found) > 1:
            order = np.argsort(owner, kind="stable")
            keys, times, owner = keys[order], times[order], owner[order]
        return keys, times, np.bincount(owner, minlength=len(ends))

    def digest(self, own: list[str]) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray] | None:
        """Numbers of tokens, groups and links, the spelled groups, the distinct pairs and their times of a text's
        units; None where its tokens do not spell it."""
        numbers = list(map(self.number.__getitem__, own))
        at = np.array(numbers, np.int64)
        counts = self.counts[at]
        if not numbers or not counts[:, 4].all():
            return None
        first, sizes = self.firsts[at], self.firsts[at + 1] - self.firsts[at]
        place = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        if self.once:
            pairs = np.unique(self.keys[place], return_counts=True)
        else:
            pairs = _distinct(self.keys[place], self.times[place])
        return *counts[:, :4].sum(axis=0).tolist(), ";".join(map(self.spelled.__getitem__, numbers)), *pairs


@lru_cache(maxsize=2)
def aligner(byte_paths: tuple[str, ...], piece_path: str) -> Aligner:
    return Aligner(byte_paths, piece_path)


def alignments(docs: DataFrame, byte_paths: tuple[str, ...], piece_path: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``groups`` (array of the ids ``a`` and ``b`` of each group in order) of every row."""
    side = pa.list_(pa.int32())
    kind = pa.list_(pa.struct([("a", side), ("b", side)]))

    def read(text: str) -> list[dict]:
        return [{k: [int(i) for i in x.split(",")] for k, x in zip("ab", g.split("|"))} for g in text.split(";")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(byte_paths, piece_path)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.slice(at, BATCH_TEXTS)
                found = [own.digest(u) for u in own.units(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([read(f[4]) if f else [] for f in found], kind)], ["doc_id", "groups"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, groups array<struct<a:array<int>,b:array<int>>>")


DIGEST = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def aligned_rows(docs: DataFrame, byte_paths: tuple[str, ...], piece_path: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Digest of every row's alignment with its distinct ``pairs`` and the ``times`` each is linked. A row with more
    than ``PAIRS_A_ROW`` pairs goes on in further rows, whose digest columns are null."""
    def rows_of(found: tuple | None) -> Iterator[tuple]:
        if found is None:
            yield 0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)
            return
        *head, text, keys, times = found
        head.append(hashlib.sha256(text.encode()).hexdigest())
        for at in range(0, len(keys), PAIRS_A_ROW):
            yield *head, keys[at:at + PAIRS_A_ROW], times[at:at + PAIRS_A_ROW]
            head = (None,) * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(byte_paths, piece_path)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.slice(at, BATCH_TEXTS)
                cut = own.units(part.column(2).to_pylist())
                rows = [(doc, row, *x) for doc, row, u in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), cut)
                        for x in rows_of(own.digest(u))]
                for some in range(0, len(rows), 512):
                    columns = list(zip(*rows[some:some + 512]))
                    edges = pa.array(np.cumsum([0, *map(len, columns[7])]), pa.int32())
                    lists = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate(c))) for c in columns[7:]]
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(c, pa.string() if k == 6 else pa.int64()) for k, c in enumerate(columns[:7])),
                         *lists], names)

    names = [x.split()[0] for x in DIGEST.split(", ")] + ["pairs", "times"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                       F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, DIGEST + ", pairs array<long>, times array<long>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair``, ``count`` (documents that hold it linked) and ``best`` (whether no pair of its A id has more)."""
    counts = cut_lineage(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
                         .withColumn("a", F.shiftright("pair", 32)))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _looked_up(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Links to best pairs and sum of counts of every row, from sorted arrays that are sent to the tasks."""
    known = counts.toArrow()  # the caller has checked its size
    pair = known.column("pair").to_numpy()
    order = np.argsort(pair)
    sent = aligned.sparkSession.sparkContext.broadcast(
        (pair[order], known.column("count").to_numpy()[order], known.column("best").to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counted, best = sent.value
        for b in batches:
            lists = [b.column(b.schema.get_field_index(c)) for c in ("pairs", "times")]
            at, times = np.searchsorted(keys, lists[0].flatten().to_numpy()), lists[1].flatten().to_numpy()
            rows = np.repeat(np.arange(b.num_rows), np.diff(lists[0].offsets.to_numpy()))
            sums = [np.zeros(b.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], rows, times * best[at])
            np.add.at(sums[1], rows, times * counted[at])
            yield pa.RecordBatch.from_arrays([*b.columns[:7], *map(pa.array, sums)], [*b.schema.names[:7], "n_best", "count_sum"])

    return aligned.mapInArrow(run, DIGEST + ", n_best long, count_sum long")


def _joined(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a join of the rows' pairs with the table of counts."""
    pairs = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(
        "row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    sums = pairs.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    first = aligned.filter("n_a is not null").drop("pairs", "times")
    return first.join(sums, "row", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})


def align_documents(docs: DataFrame, byte_paths: tuple[str, ...], piece_path: str, id_col: str = "doc_id",
                    text_col: str = "text", lookup_pairs: int = LOOKUP_PAIRS) -> DataFrame:
    """Of every row ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256`` (empty without tokens),
    ``n_best`` (links whose pair's count is the highest of its A id) and ``count_sum`` (over links)."""
    aligned = cut_lineage(aligned_rows(docs, byte_paths, piece_path, id_col, text_col))
    counts = cut_lineage(pair_counts(aligned))
    few = counts.count() <= lookup_pairs
    scored = (_looked_up if few else _joined)(aligned, counts)
    digest = [x.split()[0] for x in DIGEST.split(", ") if not x.startswith("row ")]
    return scored.groupBy("row").agg(*(F.max(c).alias(c) for c in digest), F.sum("n_best").alias("n_best"),
                                     F.sum("count_sum").alias("count_sum")).drop("row")


def public_paths() -> tuple[tuple[str, str], str]:
    import public_tokenizers as p

    return (p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken")), p.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"), *public_paths()).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
