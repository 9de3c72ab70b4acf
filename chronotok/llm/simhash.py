"""SimHash near-dedup (operator 10): pigeonring filtering of fingerprints, then connected components.

Fingerprints are computed in one pass over the texts. Equal fingerprints are grouped first, so copies never meet.
For at most t differing bits the 64 bits are cut into m = 2 t + 1 segments on a ring. By the pigeonring principle
some segment starts a chain whose cumulative differences stay within l * t / m for every length l, and the first two
budgets round to no difference at all. So candidates share two consecutive segments; that pair is the join key.
A candidate must then pass the budgets of the longer chains, and last the full Hamming check.

A bucket of at most ``BUCKET`` fingerprints is paired up. For the fingerprints of larger buckets another exact way
is used: two fingerprints differ in at most t bits if and only if some 64-bit centre is within ceil(t / 2) bits of
one and floor(t / 2) bits of the other. Every such fingerprint is listed under its centres and linked to the least
inner member of each, which takes a fixed number of rows for each fingerprint instead of all pairs.

Defined results: a null, empty or blank text has fingerprint zero and links like any other; fewer than ``k`` words
give one shingle of the whole sequence; a null id is kept, and a component without any id has a null component_id;
repeated rows are kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from chronotok.llm.components import components
from chronotok.llm.text import table
from chronotok.session import cut_lineage

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
BUCKET = 64


def fingerprint(text: str | None, k: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the k-word shingles of a text, A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    joined, xx = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        hashes = np.array([xx(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-k].tolist()]
        hashes = np.array([xx(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1:] - 1).tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * ones > len(hashes))))


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``rid`` (128-bit digest of the row's id and text) and ``fp`` (the fingerprint as a signed long) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), k) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())],
                                             ["doc_id", "rid", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_id(id_col, text_col).alias("rid"),
                       F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, rid binary, fp long")


def row_id(id_col: str, text_col: str) -> Column:
    """128 bits, which differ between different rows (a 64-bit hash would not, over 10^10 rows)."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    return F.unhex(F.md5(F.encode(F.concat(part(id_col), F.lit(" "), part(text_col)), "UTF-8")))


def _segments(m: int) -> list[tuple[int, int]]:
    """(offset, width) of the m segments of 64 bits."""
    edges = [round(64 * i / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _bits(fp: Column, segment: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(fp, segment[0]).bitwiseAND(F.lit((1 << segment[1]) - 1))


def _chain_ok(diff: Column, start: Column, max_bits: int) -> Column:
    """The budgets of every chain length from segment ``start`` on, for ``diff`` (the xor of two fingerprints)."""
    m = 2 * max_bits + 1
    parts = [F.bit_count(_bits(diff, s)) for s in _segments(m)]
    ok = F.lit(False)
    for i in range(m):
        held, total = F.lit(True), F.lit(0)
        for n in range(1, m + 1):
            total = total + parts[(i + n - 1) % m]
            held = held & (total <= n * max_bits // m)
        ok = ok | ((start == i) & held)
    return ok


def _centres(max_bits: int) -> tuple[list[int], int]:
    """Masks of at most ceil(t / 2) bits as signed longs, those of at most floor(t / 2) bits first, and their number."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    outer, inner = -(-max_bits // 2), max_bits // 2
    masks = [signed(sum(1 << i for i in c)) for r in range(outer + 1) for c in combinations(range(64), r)]
    return masks, sum(1 for x in masks if (x & ((1 << 64) - 1)).bit_count() <= inner)


def links(fps: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) that connect exactly the distinct fingerprints (column ``fp``) within ``max_bits`` of another."""
    segments = _segments(2 * max_bits + 1)
    ring = [F.struct(F.lit(i).alias("i"), F.shiftleft(_bits(F.col("fp"), s), segments[(i + 1) % len(segments)][1])
                     .bitwiseOR(_bits(F.col("fp"), segments[(i + 1) % len(segments)])).alias("key"))
            for i, s in enumerate(segments)]
    keys = fps.select("fp", F.explode(F.array(*ring)).alias("c")).select("fp", "c.i", "c.key")
    sizes = keys.groupBy("i", "key").count().filter("count > 1")
    shared = cut_lineage(keys.join(sizes, ["i", "key"]))

    small = shared.filter(F.col("count") <= bucket).select("i", "key", "fp")
    pairs = small.join(small.withColumnRenamed("fp", "other"), ["i", "key"]).filter("fp < other")
    diff = F.col("fp").bitwiseXOR(F.col("other"))
    near = pairs.filter(_chain_ok(diff, F.col("i"), max_bits)).filter(F.bit_count(diff) <= max_bits)

    masks, n_inner = _centres(max_bits)
    crowded = shared.filter(F.col("count") > bucket).select("fp").distinct()
    listed = crowded.select("fp", F.posexplode(F.array(*map(F.lit, masks))).alias("at", "mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("centre"),
        F.when(F.col("at") < n_inner, F.col("fp")).alias("core"))
    hubs = listed.groupBy("centre").agg(F.count("*").alias("n"), F.min("core").alias("core")).filter("n > 1")
    stars = listed.select("centre", "fp").join(hubs.filter("core is not null"), "centre").filter("fp != core")
    return near.select(F.col("fp").alias("a"), F.col("other").alias("b")).unionByName(
        stars.select(F.col("fp").alias("a"), F.col("core").alias("b")))


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id``, ``rid``, ``fp``, ``component_id`` (least id reachable over links of at most ``max_bits``) and
    ``keeper`` (whether the row is the first of its component by id, then ``rid``) of every row."""
    rows = cut_lineage(fingerprints(docs, k, id_col, text_col))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")  # a row with an id comes first
    classes = cut_lineage(rows.groupBy("fp").agg(F.min(row).alias("first")))
    if max_bits:
        nodes = components(links(classes.select("fp"), max_bits)).withColumnRenamed("node", "fp")
        labelled = classes.join(nodes, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
        least = labelled.groupBy("label").agg(F.min("first").alias("least"))
        classes = labelled.join(least, "label").select("fp", "least")
    else:
        classes = classes.withColumnRenamed("first", "least")
    return rows.join(classes, "fp").select("doc_id", "rid", "fp", F.col("least.doc_id").alias("component_id"),
                                           row.eqNullSafe(F.col("least")).alias("keeper"))


def drop_near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """One row of each component, with all columns of ``docs``; of rows equal in id and text one stays."""
    kept = near_duplicates(docs, k, max_bits, id_col, text_col).filter("keeper").select(
        F.col("rid").alias("__rid")).distinct()
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), row_id(id_col, text_col).alias("__rid"))
    one = rows.join(kept, "__rid", "left_semi").dropDuplicates(["__rid"])
    return one.select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
