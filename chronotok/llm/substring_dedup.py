"""Substring dedup (operator 8): De Bruijn compaction of repeated token k-mers.

Words are tokens and a window of ``k`` words is an edge of the De Bruijn graph, from its first k - 1 words to its
last. An edge matters where it starts in a document with a smaller id too; its canonical occurrence, the first by
(id, position), is its source coordinate.

1. Candidates. Equal windows have equal minimizers (the least hash of their ``m``-word parts), so a window whose
   minimizer occurs in one document only cannot repeat. Each document sends its distinct minimizers, a sixth of its
   words; those found in two documents come back to it.
2. Runs. Consecutive candidate windows with one minimizer are compacted to one row each before anything is sent.
   Equal runs meet by hash: all but the first document's know their source at once.
3. Edges. Where different runs have one minimizer, the first occurrence of each is opened into its windows, which
   meet by hash in turn; so a window that different runs hold still learns the smallest document that has it. Row
   counts tell: a run that as many rows hold as hold its minimizer is the only one, or lies beside the others.
4. Compaction. Runs and edges that follow one another in a document and in its source form a path that does not
   branch; each such path becomes one row (document, start, length, source, source start). A path ends where the
   graph branches, because there the source coordinates jump.
5. Verification. Paths are joined to their source documents, which return a 128-bit digest of the words at the
   source coordinates; only a path whose own words have that digest is removed, so a collision of 64-bit hashes
   removes nothing.

Hot windows: a task first settles what it can see itself. Of the rows with one hash in a block of texts, only those
of the smallest document have to meet the other tasks; the rest already know a smaller document and travel under a
salt. So a hash gets at most one document's rows for each block, however many documents hold it. The texts cross
the cluster once, and the four joins with them reuse that exchange.

Defined results: words are runs between ASCII white space, unchanged; a null, empty or short text has no window and
keeps its words; rows with a null id take no part and keep their words; rows with one id count as one document, so
none of them removes words of another; repeated rows give repeated results; an empty table gives no rows; only the
id and the text column are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from chronotok.llm.text import table

WINDOW_WORDS = 13
MINIMIZER_WORDS = 4
BLOCK_WORDS = 500_000
SALTS = 1 << 12
UNCOUNTED = (1 << 31) - 1
ROW_SHIFT = 40  # a position is the word within its row, with 23 bits of the row's text hash above


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []  # bytes: ASCII white space only


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (of whatever follows in ``h``, texts or not)."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out ^= h[j:n + j]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def sliding_min(g: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        g = np.minimum(g[:-span], g[span:])
        span *= 2
    return np.minimum(g[:len(g) - (width - span)], g[width - span:]) if width > span else g


class _Block:
    """Some texts' words and hashes side by side, with what belongs to which text."""

    def __init__(self, raw: list[str | None], texts: list[list[bytes]], docs: np.ndarray, k: int) -> None:
        sizes = np.array([len(t) for t in texts], np.int64)
        self.k, self.docs = k, docs
        self.hashes = word_hashes([w for t in texts for w in t])
        n = np.maximum(sizes - k + 1, 0)
        self.first = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(texts)), n)  # of each window
        self.word = np.arange(len(self.owner)) - np.repeat(np.cumsum(n) - n, n)  # its word within the text
        self.at = self.first[self.owner] + self.word  # its word within the block
        self.pos = np.array([row_part(t) for t in raw], np.int64)[self.owner] + self.word

    def windows(self) -> np.ndarray:
        return gram_hashes(self.hashes, self.k)[self.at] if len(self.at) else np.empty(0, np.uint64)

    def minimizers(self, m: int) -> np.ndarray:
        if not len(self.at):
            return np.empty(0, np.uint64)
        return sliding_min(gram_hashes(self.hashes, m), self.k - m + 1)[self.at]


def row_part(text: str | None) -> int:
    """What a row adds to its positions, so that rows with one id and different texts keep apart."""
    return (xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass")) >> 41) << ROW_SHIFT


def _blocks(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, _Block]]:
    """(first row, number of rows, block) for stretches of a batch with about ``BLOCK_WORDS`` words."""
    ids, column = (batch.column(batch.schema.names.index(c)) for c in ("doc_id", "text"))
    at = 0
    while at < batch.num_rows:
        first, raw, texts, held = at, [], [], 0
        while at < batch.num_rows and held < BLOCK_WORDS:
            raw.append(column[at].as_py())
            texts.append(split_words(raw[-1]))
            held += len(texts[-1])
            at += 1
        docs = ids.slice(first, at - first).to_numpy(zero_copy_only=False)
        yield first, at - first, _Block(raw, texts, docs, k)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def _salts(n: int) -> np.ndarray:
    return (1 + np.arange(n) % SALTS).astype(np.int32)


def _repeated_minimizers(rows: DataFrame, k: int, m: int) -> DataFrame:
    """``doc_id``, ``ms`` and ``ns``: the minimizers of the document that a document with another id has too, and
    the number of rows that have each (``UNCOUNTED`` where the task knew at once that it is shared)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, block in _blocks(b, k):
                mins = block.minimizers(m).view(np.int64)
                new = _changes(mins, block.owner)
                mins, owner = mins[new], block.owner[new]
                order = np.lexsort((owner, mins))
                mins, owner = mins[order], owner[order]
                once = _changes(mins, owner)
                mins, docs = mins[once], block.docs[owner[once]]  # one for each row of the table
                order = np.lexsort((docs, mins))
                mins, docs = mins[order], docs[order]
                at = np.flatnonzero(_changes(mins, docs))
                count = np.diff(np.append(at, len(mins)))
                mins, docs = mins[at], docs[at]
                head = np.flatnonzero(_changes(mins))
                tail = np.append(head[1:], len(mins)) - 1 if len(head) else head
                total = np.add.reduceat(count, head) if len(head) else count
                shared = docs[head] != docs[tail]  # found in two documents of this block
                salt = np.where(np.repeat(shared, tail - head + 1), _salts(len(mins)), 0).astype(np.int32)
                # the block's first and last document stand for all of the block at other tasks
                probes = np.concatenate([head[shared], tail[shared]])
                count = np.concatenate([count, total[shared], np.zeros(int(shared.sum()), np.int64)]).astype(np.int32)
                mins, docs = np.concatenate([mins, mins[probes]]), np.concatenate([docs, docs[probes]])
                salt = np.concatenate([salt, np.zeros(len(probes), np.int32)])
                near = np.argsort(docs, kind="stable")  # rows of one document in a row compress best
                yield pa.RecordBatch.from_arrays([pa.array(x[near]) for x in (mins, salt, docs, count)],
                                                 ["m", "salt", "doc_id", "n"])

    found = rows.mapInArrow(run, "m long, salt int, doc_id long, n int")
    same = Window.partitionBy("m", "salt")
    shared = (found.withColumn("lo", F.min("doc_id").over(same)).withColumn("hi", F.max("doc_id").over(same))
              .withColumn("all", F.sum("n").over(same)).filter("salt > 0 or lo < hi"))
    n = F.when(F.col("salt") > 0, F.lit(UNCOUNTED)).otherwise(F.least("all", F.lit(UNCOUNTED - 1))).cast("int")
    return (shared.select("doc_id", "m", n.alias("n")).groupBy("doc_id")
            .agg(F.collect_list("m").alias("ms"), F.collect_list("n").alias("ns")))


_SEEN = "h long, salt int, doc_id long, pos long, n int, rows int, among int, src_doc long, src_pos long"


def _settle(h: np.ndarray, docs: np.ndarray, pos: np.ndarray, n: np.ndarray, among: np.ndarray) -> pa.RecordBatch:
    """Rows of ``_SEEN``: the first of each hash in a row of the table; those after the block's smallest document
    already have their source. ``rows``, on the first of a hash, is the block's number of rows with it."""
    order = np.lexsort((pos, docs, h))
    h, docs, pos, n, among = h[order], docs[order], pos[order], n[order], among[order]
    fresh = _changes(h, docs, pos >> ROW_SHIFT)
    # rows equal in id and text share their first position: each counts
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0)) if len(h) else np.empty(0, np.int64)
    h_every = h[pos == pos[start]]
    h, docs, pos, n, among = h[fresh], docs[fresh], pos[fresh], n[fresh], among[fresh]
    new = _changes(h)
    source = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0)) if len(h) else np.empty(0, np.int64)
    rows = np.zeros(len(h), np.int32)
    if len(h):
        first = np.flatnonzero(new)
        rows[first] = np.diff(np.append(np.flatnonzero(_changes(h_every)), len(h_every)))
    known = docs > docs[source]
    salt = np.where(known, _salts(len(h)), 0).astype(np.int32)
    near = np.lexsort((pos, docs))  # rows of one document in a row compress best
    mask = ~known[near]
    return pa.RecordBatch.from_arrays(
        [pa.array(x[near]) for x in (h, salt, docs, pos, n.astype(np.int32), rows, among.astype(np.int32))]
        + [pa.array(docs[source][near], mask=mask), pa.array(pos[source][near], mask=mask)],
        [c.split()[0] for c in _SEEN.split(", ")])


def _first_seen(rows: DataFrame) -> DataFrame:
    """Rows of ``_SEEN`` with the first occurrence of their hash as (src_doc, src_pos), and in ``rows`` the number of
    rows that hold it (of rows without a salt)."""
    same = Window.partitionBy("h", "salt").orderBy("doc_id", "pos")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for c in ("doc_id", "pos"):
        rows = rows.withColumn(f"first_{c}", F.first(c).over(same))
    return rows.withColumn("all", F.sum("rows").over(whole)).select(
        "doc_id", "pos", "n", F.coalesce("src_doc", "first_doc_id").alias("src_doc"),
        F.coalesce("src_pos", "first_pos").alias("src_pos"), F.col("all").alias("rows"), "among")


def _in_lists(values: np.ndarray, owner: np.ndarray, lists: pa.ListArray, numbers: pa.ListArray | None = None
              ) -> np.ndarray:
    """For each value the largest number beside it in its owner's list (1 without ``numbers``), 0 if it is not there."""
    with np.errstate(over="ignore"):
        mix = lambda x, o: x ^ (o.astype(np.int64) * np.int64(0x5851F42D4C957F2D))
        wanted = lists.flatten().to_numpy(zero_copy_only=False)
        lengths = np.diff(lists.offsets.to_numpy())
        wanted = mix(wanted, np.repeat(np.arange(len(lists)), lengths))
        beside = numbers.flatten().to_numpy(zero_copy_only=False) if numbers is not None else np.ones(len(wanted), int)
        values = mix(values, owner)
    out = np.zeros(len(values), np.int64)
    if len(wanted):
        order = np.lexsort((beside, wanted))  # the last of equal ones is the largest
        wanted, beside = wanted[order], beside[order]
        at = np.searchsorted(wanted, values, "right") - 1
        hit = (at >= 0) & (wanted[np.maximum(at, 0)] == values)
        out[hit] = beside[at[hit]]
    return out


def _runs(candidates: DataFrame, k: int, m: int) -> DataFrame:
    """Runs of consecutive candidate windows with one minimizer, with their sources; ``candidates`` has ``ms``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, size, block in _blocks(b, k):
                mins = block.minimizers(m).view(np.int64)
                lists = [b.column(b.schema.names.index(c)).slice(first, size) for c in ("ms", "ns")]
                among = _in_lists(mins, block.owner, *lists)
                keep = np.flatnonzero(among)
                h, pos, owner = block.windows()[keep], block.pos[keep], block.owner[keep]
                start = np.flatnonzero(_changes(mins[keep], owner, pos - np.arange(len(pos))))
                n = np.diff(np.append(start, len(pos)))
                inside = (np.arange(len(pos)) - np.repeat(start, n)).astype(np.uint64)
                with np.errstate(over="ignore"):  # order matters: each window is mixed with its place
                    mixed = (h ^ (inside * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
                    mixed ^= mixed >> np.uint64(32)
                    key = np.add.reduceat(mixed, start) if len(start) else mixed
                yield _settle(key.view(np.int64), block.docs[owner[start]], pos[start], n, among[keep][start])

    return _first_seen(candidates.mapInArrow(run, _SEEN))


def _edges(opened: DataFrame, k: int) -> DataFrame:
    """The windows of the runs in ``opened`` (structs of pos and n in the column ``runs``), with their sources."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, size, block in _blocks(b, k):
                lists = b.column(b.schema.names.index("runs")).slice(first, size)
                spans = lists.flatten()
                pos, n = (spans.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                wanted = np.repeat(pos, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                per_list = np.diff(lists.offsets.to_numpy())
                per_row = np.bincount(np.repeat(np.arange(size), per_list), n, size).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(per_row)])
                asked = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(wanted))
                keep = np.flatnonzero(_in_lists(block.pos, block.owner, asked))
                yield _settle(block.windows()[keep].view(np.int64), block.docs[block.owner[keep]], block.pos[keep],
                              np.ones(len(keep), np.int64), np.ones(len(keep), np.int64))

    return _first_seen(opened.mapInArrow(run, _SEEN))


def _paths(pieces: DataFrame, k: int) -> DataFrame:
    """Pieces (pos, n windows, source) compacted: (doc_id, start, n words, src_doc, src_start) of each path."""
    along = Window.partitionBy("doc_id").orderBy("pos")
    before = {c: F.lag(c).over(along) for c in ("pos", "n", "src_doc", "src_pos")}
    joins_on = ((before["pos"] + before["n"] == F.col("pos")) & (before["src_doc"] == F.col("src_doc"))
                & (before["src_pos"] + before["n"] == F.col("src_pos")))
    again = before["pos"] == F.col("pos")  # rows equal in id and text give every piece again
    numbered = (pieces.withColumn("fresh", F.when(joins_on | again, 0).otherwise(1))
                .withColumn("path", F.sum("fresh").over(along)))
    return numbered.groupBy("doc_id", "path").agg(
        F.min("pos").alias("start"), (F.max(F.col("pos") + F.col("n")) - F.min("pos") + (k - 1)).cast("int").alias("n"),
        F.min("src_doc").alias("src_doc"), F.min("src_pos").alias("src_start")).drop("path")


def span_digest(words: list[bytes], start: int, n: int) -> bytes:
    return xxhash.xxh128_digest(b" ".join(words[start:start + n]))


def _source_digests(texts: DataFrame, paths: DataFrame) -> DataFrame:
    """(src_doc, src_start, n, digest) of every span that some path names as its source."""
    asked = (paths.groupBy("src_doc").agg(F.collect_set(F.struct("src_start", "n")).alias("asked"))
             .withColumnRenamed("src_doc", "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {c: i for i, c in enumerate(b.schema.names)}
            rows: list[tuple[int, int, int, bytes]] = []
            for doc, text, spans in zip(*(b.column(at[c]) for c in ("doc_id", "text", "asked"))):
                words, own, doc = split_words(text.as_py()), row_part(text.as_py()), doc.as_py()
                for s in spans.as_py():
                    start, n = s["src_start"] - own, s["n"]
                    if 0 <= start < 1 << ROW_SHIFT:
                        rows.append((doc, s["src_start"], n, span_digest(words, start, n)))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
                                             ["src_doc", "src_start", "n", "digest"])

    found = texts.join(asked, "doc_id").mapInArrow(run, "src_doc long, src_start long, n int, digest binary")
    return found.distinct()


def _cut(rows: DataFrame, k: int) -> DataFrame:
    """Remove from each text the words of its verified spans, and of every window equal to one inside them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {c: i for i, c in enumerate(b.schema.names)}
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(b.column(at["text"]), b.column(at["spans"])):
                text, spans = text.as_py(), spans.as_py()
                words = split_words(text)
                gone = np.zeros(len(words), bool)
                if spans:
                    own = row_part(text)
                    h = gram_hashes(word_hashes(words), k)
                    hit = np.zeros(len(h), bool)
                    for s in spans:
                        start = s["start"] - own
                        if 0 <= start < 1 << ROW_SHIFT and span_digest(words, start, s["n"]) == s["digest"]:
                            hit[start:start + s["n"] - k + 1] = True
                    again = np.flatnonzero(np.isin(h, h[hit]) & ~hit)
                    if len(again):  # equal hashes, so far: the words decide
                        same = np.flatnonzero(hit & np.isin(h, h[again]))
                        known = {span_digest(words, i, k) for i in same.tolist()}
                        hit[[i for i in again.tolist() if span_digest(words, i, k) in known]] = True
                    edge = np.zeros(len(words) + 1, np.int64)
                    edge[:len(h)] += hit
                    edge[k:k + len(h)] -= hit
                    gone = np.cumsum(edge[:-1]) > 0
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                left = [w for w, x in zip(words, gone.tolist()) if not x] if n_removed[-1] else words
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [b.column(at["doc_id"]), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def repeated_paths(texts: DataFrame, rows: DataFrame, k: int = WINDOW_WORDS, m: int = MINIMIZER_WORDS) -> DataFrame:
    """Compacted paths of repeated windows; ``texts`` is ``rows`` (doc_id, text; no null ids) dealt by doc_id."""
    runs = _runs(texts.join(_repeated_minimizers(rows, k, m), "doc_id"), k, m)
    # A run that every row with its minimizer holds needs no opening: whatever row holds a part of it holds all of it.
    first = (runs.filter("src_doc >= doc_id and rows < among").groupBy("doc_id")
             .agg(F.collect_list(F.struct("pos", "n")).alias("runs")))
    edges = _edges(texts.join(first, "doc_id"), k)
    found = runs.unionByName(edges).filter("src_doc < doc_id").select("doc_id", "pos", "n", "src_doc", "src_pos")
    return _paths(found, k)


def deduplicate(docs: DataFrame, k: int = WINDOW_WORDS, m: int = MINIMIZER_WORDS, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = rows.filter("doc_id is not null")
    texts = own.repartition("doc_id")
    paths = repeated_paths(texts, own, k, m)
    digests = _source_digests(texts, paths)
    spans = (paths.join(digests, ["src_doc", "src_start", "n"])
             .groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "digest")).alias("spans")))
    none = F.lit(None).cast("array<struct<start:bigint,n:int,digest:binary>>")
    return (_cut(texts.join(spans, "doc_id", "left"), k)
            .unionByName(_cut(rows.filter("doc_id is null").withColumn("spans", none), k)))


def query(spark, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
