"""Seeded global shuffles without a sort.

A shuffled order of n rows is a permutation of their numbers 0 .. n - 1. Here it is a keyed
function of the number: the swap-or-not network, in whose every round a number x is paired
with key - x (mod n), and a bit of the pair's larger member says whether the two change places.
Each round is its own inverse, so the whole is a bijection of exactly 0 .. n - 1 for any n; a row
finds its place in the order by itself, and no row is compared with another one. Epochs
differ by the key.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

ROUNDS = 48
LOW = (1 << 31) - 1


def round_keys(n: int, seed, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Of each round the key in 0 .. n - 1 and two odd multipliers below 2**31, from sha256 of seed and round."""
    out = []
    for r in range(rounds):
        h = hashlib.sha256(f"{seed}|{r}".encode()).digest()
        a, b, c = (int.from_bytes(h[8 * i:8 * i + 8], "big") for i in range(3))
        out.append((a % max(n, 1), b & LOW | 1, c & LOW | 1))
    return out


def permuted(number, n: int, seed, rounds: int = ROUNDS) -> Column:
    """The place of row ``number`` (0 .. n - 1, n below 2**60) in the order that ``seed`` names."""
    keys = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"))
                     for k, a, b in round_keys(n, seed, rounds)])
    number = F.col(number) if isinstance(number, str) else number

    def step(x: Column, key: Column) -> Column:
        other = F.pmod(key["k"] - x, F.lit(n))
        larger = F.greatest(x, other)
        mixed = larger.bitwiseAND(F.lit(LOW)) * key["a"] + F.shiftright(larger, 31) * key["b"]
        return F.when(F.shiftright(mixed, 30).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(keys, number.cast("long"), step)


def numbered(rows: DataFrame, out: str = "number") -> DataFrame:
    """Rows with dense numbers from 0, in the order of the stored partitions: one pass that counts them and one broadcast
    row per partition, no sort."""
    stored = cut_lineage(rows.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).collect()  # one row per partition
    before, total = {}, 0
    for r in sorted(counts, key=lambda r: r["_part"]):
        before[r["_part"]] = total
        total += r["_n"]
    table = rows.sparkSession.createDataFrame(sorted(before.items()) or [(0, 0)], "_part long, _before long")
    return stored.withColumn("_part", part).join(F.broadcast(table), "_part").withColumn(
        out, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_at", "_before")


def shuffled_batches(rows: DataFrame, n: int, batch_size: int, seed, number: str = "number",
                     drop_last: bool = False) -> DataFrame:
    """``batch_id`` and ``slot`` of every row in the order of ``seed``; ``number`` holds dense numbers below ``n``."""
    place = permuted(number, n, seed)
    out = rows.withColumn("_place", place)
    if drop_last:
        out = out.where(F.col("_place") < n // batch_size * batch_size)
    return out.withColumn("batch_id", F.floor(F.col("_place") / batch_size).cast("long")).withColumn(
        "slot", F.pmod("_place", F.lit(batch_size)).cast("int")).drop("_place")
