"""Sharding (operator 2): histogram sort into shards of near equal bytes, native column functions only.

Rows are ordered by a 63-bit key, 32 bits of the text's md5 before 31 bits of the id's md5, so equal texts lie
side by side and a group of copies is cut only where the byte law needs it. The byte offset of every shard
boundary is found by counting: each round sums exact bytes (and rows) per bin of the key bits just below the
bins that hold a boundary, and narrows those bins, until every boundary is known to the row or is within the
tolerance. Only bins of boundaries (at most shards x 1024 counts) reach the driver, whatever the input's size.
Then the whole rows cross the cluster once, dealt by (shard, part of the shard); parts keep a task small however
large a shard is, and their row counts turn the place within a part into a gapless slot of the shard.

Rows equal in id and text share a key. Keys of several rows that a boundary falls into, or that would fill a part,
are looked up in the counted keys; their rows are stored with a number each, cut at the boundary by this number and
dealt to the parts by it, so a row that is repeated any number of times is spread like others.

Defined results: a null text has 0 bytes, so its size is 8, and its crc32 is null; a null id hashes as empty text;
repeated rows are kept and cut where the law needs it; an empty table gives no rows; only the id and the text column
are read, so other columns cannot clash.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronotok.llm.text import crc32, table
from chronotok.session import cut_lineage

SHARDS = 24
ROW_OVERHEAD = 8
KEY_BITS, FIRST_BITS, NEXT_BITS = 63, 13, 10  # the key is used up after the first and five more rounds
PART_ROWS, PART_BYTES, MIN_PARTS = 200_000, 64_000_000, 4


def _hash_bits(value: Column, bits: int) -> Column:
    whole = F.conv(F.substring(F.md5(F.encode(F.coalesce(value.cast("string"), F.lit("")), "UTF-8")), 1, 8), 16, 10)
    return F.shiftright(whole.cast("long"), 32 - bits)


def sort_key(id_col: Column, text_col: Column) -> Column:
    return F.shiftleft(_hash_bits(text_col, 32), 31).bitwiseOR(_hash_bits(id_col, 31))


def row_size(text_col: Column) -> Column:
    return (F.coalesce(F.octet_length(text_col), F.lit(0)) + ROW_OVERHEAD).cast("long")


def find_splitters(keys: DataFrame, n_shards: int, total: int,
                   tolerance: float = 0.0) -> tuple[list[int], dict[int, int]]:
    """First key of shards 1, 2, ... by repeated counting below probes; ``keys`` has columns ``k`` and ``size``. Also
    the keys that boundaries fall into, with the bytes before them.

    A boundary goes to the nearer edge of the key that straddles its target, or, once an edge of the narrowed bin
    is within ``tolerance`` (a share of a shard's mean bytes) of the target, to that edge.
    """
    slack = tolerance * total  # in n_shards-ths of a byte, as the targets below
    found: dict[int, int] = {}
    straddled: dict[int, int] = {}
    shift = KEY_BITS - FIRST_BITS
    parents: dict[int, int] | None = None  # bin -> bytes before it
    open_targets = list(range(1, n_shards))
    while open_targets:
        rows = keys
        if parents is not None:
            rows = rows.filter(F.shiftright("k", shift + NEXT_BITS).isin(list(parents)))
        counted = (rows.groupBy(F.shiftright("k", shift).alias("bin"))
                   .agg(F.sum("size").alias("bytes"), F.min("k").alias("lo"), F.max("k").alias("hi"))
                   .orderBy("bin").collect())  # at most n_shards * 2**NEXT_BITS bins, or 2**FIRST_BITS
        starts, running, parent = [], 0, None
        for r in counted:
            if parents is not None and r.bin >> NEXT_BITS != parent:
                parent = r.bin >> NEXT_BITS
                running = parents[parent]
            starts.append(running)
            running += r.bytes
        narrowed: dict[int, int] = {}
        still = []
        for i in open_targets:
            at = max(0, bisect_right([s * n_shards for s in starts], i * total) - 1)
            r, start = counted[at], starts[at]
            left, right = i * total - start * n_shards, (start + r.bytes) * n_shards - i * total
            if r.lo == r.hi or shift == 0 or min(left, right) <= slack:
                found[i] = r.lo if left <= right else r.hi + 1
                if r.lo == r.hi and left > 0 and right > 0:
                    straddled[r.lo] = start
            else:
                narrowed[r.bin] = start
                still.append(i)
        open_targets, parents = still, narrowed
        shift -= NEXT_BITS
    return [found[i] for i in range(1, n_shards)], straddled


def _repeated(keys: DataFrame, straddled: dict[int, int], least_bytes: float) -> DataFrame:
    """Keys of several rows that a boundary falls into, or of at least ``least_bytes``; with the bytes of a row."""
    several = keys.groupBy("k").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("each"))
    cut = F.col("k").isin(list(straddled)) if straddled else F.lit(False)
    return several.filter((F.col("n") > 1) & (cut | (F.col("bytes") >= F.lit(least_bytes)))).select("k", "each")


def _numbered(rows: DataFrame) -> DataFrame:
    """Stored rows with ``number``, dense from 0 within their key. Rows of a key lie together in each stored part, so
    only the first number and the count of (key, part) have to be known."""
    stored = cut_lineage(rows.sortWithinPartitions("k").withColumn("at", F.monotonically_increasing_id()))
    in_part = F.shiftright("at", 33).alias("in_part")
    firsts = stored.groupBy("k", in_part).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("k").orderBy("in_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select("k", "in_part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("less"))
    return stored.withColumn("in_part", F.shiftright("at", 33)).join(firsts, ["k", "in_part"]).withColumn(
        "number", F.col("less") + F.col("at")).drop("in_part", "less", "at")


def shard_by_bytes(docs: DataFrame, n_shards: int = SHARDS, tolerance: float = 0.0, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Id, text, size, shard, slot and sort key of every row; whole rows are exchanged once."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       row_size(F.col(text_col)).alias("size"), sort_key(F.col(id_col), F.col(text_col)).alias("k"))
    keys = cut_lineage(rows.select("k", "size"))
    n, total = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    splitters, straddled = find_splitters(keys, n_shards, total, tolerance) if n else ([], {})
    parts = max(MIN_PARTS, -(-n // (n_shards * PART_ROWS)), -(-total // (n_shards * PART_BYTES)))
    shard = sum((F.col("k") >= F.lit(s)).cast("int") for s in splitters) if splitters else F.lit(0)
    part = F.col("k").bitwiseAND(F.lit((1 << 31) - 1)) % F.lit(parts)

    hot = cut_lineage(_repeated(keys, straddled, total / (n_shards * parts)))  # at most shards x (parts + 1) keys
    rows = rows.withColumn("number", F.lit(0).cast("long"))
    if not hot.isEmpty():
        again = _numbered(rows.drop("number").join(F.broadcast(hot), "k"))
        cut_shard = shard
        for k, start in straddled.items():  # a row goes where its middle byte lies
            middle = (F.lit(start) + F.col("number") * F.col("each")) * 2 + F.col("each")
            own = F.least(F.floor(middle * n_shards / (2 * total)), F.lit(n_shards - 1)).cast("int")
            cut_shard = F.when(F.col("k") == k, own).otherwise(cut_shard)
        again = cut_lineage(again.withColumn("shard", cut_shard).withColumn("part", F.col("number") % parts).drop("each"))
        rows = rows.join(F.broadcast(hot), "k", "left_anti")
        keys = keys.join(F.broadcast(hot), "k", "left_anti")
    else:
        again = None
    counts = keys.select(shard.alias("shard"), part.alias("part"))
    if again is not None:
        counts = counts.unionByName(again.select("shard", "part"))
    counts = counts.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))

    place = Window.partitionBy("shard", "part").orderBy("k", "number", "doc_id", "size")
    dealt = rows.withColumn("shard", shard).withColumn("part", part)
    if again is not None:
        dealt = dealt.unionByName(again)
    placed = dealt.withColumn("at", F.row_number().over(place))
    return (placed.join(offsets, ["shard", "part"])
            .select("doc_id", "text", "size", "shard", (F.col("offset") + F.col("at") - 1).alias("slot"), "k"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder of Parquet files for each shard."""
    sharded.write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", crc32(F.col("text")).alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
