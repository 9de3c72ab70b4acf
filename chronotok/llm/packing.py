"""Best-fit packing (operator 1): sum-of-squares packing of token sequences.

A document's tokens are followed by the end id. Documents longer than a sequence are cut so that all pieces but
the first are full; full pieces fill a sequence of their own. The other pieces are dealt into groups of bounded
size, and each group is packed by the sum-of-squares rule: of all open sequences and a new one, the piece goes
where the sum over residual gaps of (open sequences with that gap) squared becomes smallest. A group takes its
pieces from the longest to the shortest. The sequences that a group leaves with more than ``LOOSE`` free tokens
are opened again, and their pieces are packed together in a second round.

Tokens never cross the cluster to be packed: only (row, piece, length) do. ``token_pieces`` returns the ids
themselves, ``packed_tokens`` joins them to their places.

Defined results: a null or empty text is the end id alone; rows are packed one by one, so repeated rows and null
ids are kept; an empty table gives no rows; other columns are not read. Groups hold whole rows dealt by a number
that each row gets in a checkpointed table, so one hot id or text cannot fill a group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronotok.llm.text import table
from chronotok.session import cut_lineage

CAPACITY = 1024
END_ID = 2
GROUP_PIECES = 16_384
LOOSE = 16

# Letters, digits and spaces of these characters are the same in every Unicode version a library may carry.
BEYOND_LATIN = "[^\\x00-\\u024f]"


def tokenizer(path: str):
    """The tokenizer of ``path`` (byte-level BPE JSON); strings of special tokens in a text are ordinary text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@lru_cache(maxsize=2)
def encoder(path: str, ranks_path: str | None = None):
    """texts -> one array of ids for each.

    ``ranks_path`` names the same vocabulary as ranks. Latin texts then go through the ranks, which takes a fifth
    of the time for the same ids (tested); others always go through the tokenizer.
    """
    import base64
    import os
    import re

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    exact, beyond, quick = tokenizer(path), re.compile(BEYOND_LATIN).search, None
    if ranks_path:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str | None]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        for i, t in enumerate(texts):
            if not t:
                out[i] = np.empty(0, np.uint32)
            elif quick is not None and not beyond(t):
                out[i] = quick.encode_to_numpy(t, disallowed_special=())
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, exact.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, np.uint32)
        return out

    return encode


def token_pieces(docs: DataFrame, tokenizer_paths: tuple[str, ...], capacity: int = CAPACITY, end_id: int = END_ID,
                 with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids`` (little-endian
    unsigned 32-bit) of every piece."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*tokenizer_paths)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                rows: list[tuple] = []
                for doc, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist())):
                    ids = np.append(ids, np.uint32(end_id))
                    first = len(ids) % capacity or capacity
                    edges = [0, *range(first, len(ids) + 1, capacity)]
                    for n, (i, j) in enumerate(zip(edges, edges[1:])):
                        raw = ids[i:j].astype("<u4").tobytes()
                        rows.append((doc, n, i, j - i, zlib.crc32(raw), raw)[:len(names)])
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return rows.mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and (by bin) used tokens, for lengths placed in the given order."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    never = np.iinfo(np.int64).max
    for at, s in enumerate(lengths.tolist()):
        # Change of the sum of squares: a gap g >= s turns into g - s; a gap of 0 is closed and counts none.
        change = np.where(count[s:] > 0, 2 * (count[:capacity + 1 - s] - count[s:]) + 2, never)
        if change[0] != never:
            change[0] = 1 - 2 * count[s]  # closes a sequence
        g = int(change.argmin()) + s
        fresh = 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        if change[g - s] <= fresh:
            b = stacks[g].pop()
            count[g] -= 1
        else:
            b, g = len(used), capacity
            used.append(0)
        bins[at], offsets[at] = b, used[b]
        used[b] += s
        if g > s:
            stacks[g - s].append(b)
            count[g - s] += 1
    return bins, offsets, np.array(used, np.int64)


def _pack_round(pieces: DataFrame, n_groups: int, capacity: int, first: int) -> DataFrame:
    """Pack pieces (row, length) in groups; sequence ids start at ``first`` and ``used`` is the sequence's fill."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        bins, offsets, used = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pd.DataFrame({"row": pdf["row"].to_numpy(), "length": pdf["length"].to_numpy(),
                             "sequence_id": first + (pdf["g"].to_numpy(np.int64) << 32) + bins,
                             "offset": offsets, "used": used[bins]})

    group = F.pmod(F.xxhash64("row"), F.lit(n_groups))
    return (pieces.select("row", "length", group.alias("g")).groupBy("g")
            .applyInPandas(run, "row long, length long, sequence_id long, offset long, used long"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``row``, ``sequence_id`` and ``offset`` of every row of a stored table with columns ``row`` and ``length``."""
    open_pieces = pieces.filter(F.col("length") < capacity)
    n = open_pieces.count()
    groups = max(1, -(-n // GROUP_PIECES))
    one = cut_lineage(_pack_round(open_pieces, groups, capacity, 0))
    tight = one.filter(F.col("used") >= capacity - LOOSE)
    loose = one.filter(F.col("used") < capacity - LOOSE)
    again = _pack_round(loose, max(1, -(-loose.count() // GROUP_PIECES)), capacity, 1 << 61)
    full = pieces.filter(F.col("length") >= capacity).select(
        "row", (F.lit(1 << 62) + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    cols = ["row", "sequence_id", "offset"]
    return tight.select(cols).unionByName(again.select(cols)).unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_paths: tuple[str, ...], capacity: int = CAPACITY, end_id: int = END_ID,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and its offset there."""
    pieces = token_pieces(docs, tokenizer_paths, capacity, end_id, False, id_col, text_col)
    stored = cut_lineage(pieces.withColumn("row", F.monotonically_increasing_id()))
    return stored.join(pack(stored, capacity), "row").drop("row")


def packed_tokens(docs: DataFrame, packed: DataFrame, tokenizer_paths: tuple[str, ...], capacity: int = CAPACITY,
                  end_id: int = END_ID) -> DataFrame:
    """One row per sequence: its pieces in order of offset, with the ids joined by (doc_id, piece)."""
    ids = token_pieces(docs, tokenizer_paths, capacity, end_id)
    rows = packed.join(ids.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))  # at most ``capacity`` of them
    return rows.groupBy("sequence_id").agg(parts.alias("pieces"))


def public_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_paths()).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
