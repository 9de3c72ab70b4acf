"""Skew-proof running sums, positions and neighbours.

A running sum over a group ordered by a key (``sum(w) over (partition by g
order by k)``) puts a whole group into one task. When one group may hold a
third of all rows -- one lab concept with most measurement values, one person
with most events, or the global order of all persons -- that task never
finishes. Everything here works in two phases, at every size:

1. rows are range-partitioned by ``(group, order)`` so a hot group spans many
   slices, and written with their slice number;
2. windows run inside each ``(slice, group)``, whose size is bounded, and the
   few groups that span slices get what they need from other slices out of a
   small table. That table has at most two rows per slice (a slice can share
   only its first and its last group with others), so it is broadcast.

Slices that are read more than once can be stored *clustered*: as a table bucketed by slice,
one bucket each, so that Spark reads a slice as one partition and every window or aggregate
by (slice, group) runs without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bucket_labels, clustered_table, cut_lineage


def _n_parts(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


ROWS_A_SLICE = 1_000_000


def slices_for(df: DataFrame) -> int:
    """How many slices the rows of ``df`` need: the session's shuffle partitions, and more where a slice would hold over
    ``ROWS_A_SLICE`` rows, so that what one task sorts does not grow with the input."""
    return max(_n_parts(df, None), -(-df.count() // ROWS_A_SLICE))


class Slices:
    """Rows of ``df`` cut into slices of the ``(group, order)`` range.

    ``order_cols`` must make rows unique within a group, or ties must be interchangeable.
    """

    def __init__(self, df: DataFrame, group_cols: list[str], order_cols: list[str | Column],
                 num_partitions: int | None = None, clustered: bool = False):
        order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
        keys = [F.col(g) for g in group_cols]
        self.groups = group_cols
        n = _n_parts(df, num_partitions)
        dealt = df.repartitionByRange(n, *keys, *order)
        if clustered:  # slices keep their order and have a bucket each
            labels = ", ".join(map(str, bucket_labels(df.sparkSession, n)))
            dealt = dealt.withColumn("_slice", F.expr(f"element_at(array({labels}), spark_partition_id() + 1)"))
            names = [c for c in order_cols if isinstance(c, str)]
            self.rows = clustered_table(dealt, "_slice", n, ["_slice", *group_cols, *names])
        else:
            self.rows = cut_lineage(dealt.withColumn("_slice", F.spark_partition_id()))
        self.window = Window.partitionBy("_slice", *group_cols).orderBy(*order)
        self.before = self.window.rowsBetween(Window.unboundedPreceding, -1)
        self.whole = self.window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        over = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy(F.lit(0))
        self.along = over.orderBy("_slice")  # over slices of one group, never over its rows
        self.earlier = self.along.rowsBetween(Window.unboundedPreceding, -1)
        self.all = self.along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def spanning(self, *aggregates: Column, rows: DataFrame | None = None) -> DataFrame:
        """One row of aggregates for each slice of the groups that lie in several slices."""
        per = (rows if rows is not None else self.rows).groupBy("_slice", *self.groups).agg(*aggregates)
        n = F.count(F.lit(1)).over(self.all)
        return per.withColumn("_n_slices", n).where(F.col("_n_slices") > 1).drop("_n_slices")

    def join(self, rows: DataFrame, table: DataFrame, how: str = "left") -> DataFrame:
        """Add a (materialised, small) table with one row per slice of a spanning group."""
        t = table.select(*[F.col(c).alias(f"_k_{c}") for c in ("_slice", *self.groups)],
                         *[c for c in table.columns if c not in ("_slice", *self.groups)])
        on = None
        for c in ("_slice", *self.groups):
            same = rows[c].eqNullSafe(t[f"_k_{c}"])
            on = same if on is None else on & same
        out = rows.join(F.broadcast(t), on, how)  # at most two rows per slice
        return out if how == "left_semi" else out.drop(*[f"_k_{c}" for c in ("_slice", *self.groups)])


def exclusive_running_sum(
    df: DataFrame,
    group_cols: list[str],
    order_cols: list[str | Column],
    weight: str | list[str],
    out: str | list[str] = "offset",
    total: str | list[str] | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``out`` = sum of ``weight`` over rows of the same group strictly before this row in
    ``order_cols`` order (0 for the first), and optionally ``total`` = the group's full sum.
    Several weights (with as many ``out`` and ``total`` names) are summed in the same pass."""
    weights = [weight] if isinstance(weight, str) else list(weight)
    outs = [out] if isinstance(out, str) else list(out)
    totals = [] if total is None else [total] if isinstance(total, str) else list(total)
    s = Slices(df, group_cols, order_cols, num_partitions)
    spans = s.spanning(*[F.sum(w).alias(f"_t_{i}") for i, w in enumerate(weights)])
    for i in range(len(weights)):
        spans = spans.withColumn(f"_p_{i}", F.coalesce(F.sum(f"_t_{i}").over(s.earlier), F.lit(0)))
        spans = spans.withColumn(f"_a_{i}", F.sum(f"_t_{i}").over(s.all))
    spans = cut_lineage(spans.drop(*[f"_t_{i}" for i in range(len(weights))]))
    rows = s.rows
    for i, w in enumerate(weights):
        rows = rows.withColumn(f"_in_{i}", F.coalesce(F.sum(w).over(s.before), F.lit(0)))
    for i, _ in enumerate(totals):
        rows = rows.withColumn(f"_own_{i}", F.sum(weights[i]).over(s.whole))
    rows = s.join(rows, spans)
    for i, o in enumerate(outs):
        rows = rows.withColumn(o, F.col(f"_in_{i}") + F.coalesce(f"_p_{i}", F.lit(0)))
    for i, t in enumerate(totals):
        rows = rows.withColumn(t, F.coalesce(f"_a_{i}", f"_own_{i}"))
    return rows.drop("_slice", *[f"_{k}_{i}" for i in range(len(weights)) for k in ("in", "own", "p", "a")])


def global_rank(df: DataFrame, order_cols: list[str | Column], out: str = "rank",
                num_partitions: int | None = None) -> DataFrame:
    """0-based dense position of each row in ``order_cols`` order (unique keys), without
    an unpartitioned window over the rows."""
    return exclusive_running_sum(
        df.withColumn("_one", F.lit(1)), [], order_cols, "_one", out=out, num_partitions=num_partitions
    ).drop("_one")


def running_sums(df: DataFrame, group_cols: list[str], order_cols: list[str], weights: list[str], outs: list[str],
                 inclusive: list[bool], num_partitions: int | None = None) -> DataFrame:
    """Running sums of several weights within groups; ``inclusive[i]`` adds the row's own weight."""
    r = exclusive_running_sum(df, group_cols, order_cols, list(weights), list(outs), num_partitions=num_partitions)
    for wt, o, inc in zip(weights, outs, inclusive):
        if inc:
            r = r.withColumn(o, F.col(o) + F.col(wt))
    return r


def row_index(df: DataFrame, group_cols: list[str], order_cols: list[str], out: str = "_rn") -> DataFrame:
    """0-based position of each row within its group."""
    return running_sums(df.withColumn("_one_", F.lit(1)), group_cols, order_cols, ["_one_"], [out], [False]).drop("_one_")
