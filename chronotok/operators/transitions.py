"""Table re-aims of the next-token model.

The neural model and its sampler are not table work; these operators answer
the same questions with a first-order transition table over the token table:
bigram counts and probabilities (R1), top-k + nucleus filtering (R2), sequence
log-probability (R3), greedy next token (R4), cross-entropy on held-out
persons (R5) and a ``mapInPandas`` hook that turns histories into simulated
continuations with a user-supplied scorer (R6).

Per-context windows run over the distinct successors of one token, so they
are bounded by the vocabulary size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .datasets import next_token_pairs


def bigrams(tokens: DataFrame, alpha: float = 0.0, vocab_size: int | None = None) -> DataFrame:
    """``(prev_id, next_id, n, prob)``; ``prob = (n + alpha) / (N_prev + alpha * V)``."""
    pairs = next_token_pairs(tokens)
    counts = pairs.groupBy(F.col("token_id").alias("prev_id"), F.col("target_id").alias("next_id")).agg(
        F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy("prev_id"))
    denom = tot + F.lit(alpha * (vocab_size or 0))
    return counts.withColumn("n_prev", tot).withColumn("prob", (F.col("n") + F.lit(alpha)) / denom)


def top_k_top_p(bi: DataFrame, k: int = 50, p: float = 1.0) -> DataFrame:
    """R2: keep the ``k`` most likely successors, renormalise, then keep a successor
    while the cumulative probability *before* it is at most ``p`` (the first is
    always kept) and renormalise again. Ties break on the smaller id."""
    w = Window.partitionBy("prev_id").orderBy(F.col("prob").desc(), F.col("next_id").asc())
    ranked = bi.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    by_ctx = Window.partitionBy("prev_id")
    ranked = ranked.withColumn("p_k", F.col("prob") / F.sum("prob").over(by_ctx))
    before = F.coalesce(F.sum("p_k").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    kept = ranked.withColumn("_before", before).where((F.col("rank") == 1) | (F.col("_before") <= F.lit(p)))
    return kept.withColumn("p_final", F.col("p_k") / F.sum("p_k").over(by_ctx)).select(
        "prev_id", "next_id", "rank", "p_final")


def sequence_logprob(tokens: DataFrame, bi: DataFrame) -> DataFrame:
    """Per person ``sum(log p(next | prev))`` (log, not product, to avoid underflow)."""
    counts = next_token_pairs(tokens).groupBy("person_id", "token_id", "target_id").agg(F.count(F.lit(1)).alias("_c"))
    j = counts.join(bi.select(F.col("prev_id").alias("token_id"), F.col("next_id").alias("target_id"), "prob"),
                    ["token_id", "target_id"], "left")
    return j.groupBy("person_id").agg(
        F.sum(F.col("_c") * F.log(F.col("prob"))).alias("logprob"), F.sum("_c").alias("n_pairs"))


def greedy_next(bi: DataFrame) -> DataFrame:
    """Most likely successor per token (smaller id on ties)."""
    best = F.max(F.struct(F.col("prob").alias("p"), (-F.col("next_id")).alias("neg_id")))
    return bi.groupBy("prev_id").agg(best.alias("_b")).select(
        "prev_id", (-F.col("_b.neg_id")).alias("next_id"), F.col("_b.p").alias("prob"))


def cross_entropy(eval_tokens: DataFrame, fit_tokens: DataFrame, vocab_size: int,
                  alpha: float = 1.0, pad_id: int = 0) -> DataFrame:
    """Mean ``-log p`` of the transitions of ``eval_tokens`` under an add-``alpha``
    bigram model fitted on ``fit_tokens``; targets equal to ``<PAD>`` are ignored."""
    fit = next_token_pairs(fit_tokens)
    n = fit.groupBy(F.col("token_id").alias("prev_id"), F.col("target_id").alias("next_id")).agg(
        F.count(F.lit(1)).alias("n"))
    n_prev = fit.groupBy(F.col("token_id").alias("prev_id")).agg(F.count(F.lit(1)).alias("n_prev"))
    ev = next_token_pairs(eval_tokens).where(F.col("target_id") != pad_id).select(
        F.col("token_id").alias("prev_id"), F.col("target_id").alias("next_id"))
    ev = ev.groupBy("prev_id", "next_id").agg(F.count(F.lit(1)).alias("_c"))  # vocabulary-sized from here on
    j = ev.join(n, ["prev_id", "next_id"], "left").join(n_prev, "prev_id", "left")
    prob = (F.coalesce("n", F.lit(0)) + F.lit(alpha)) / (F.coalesce("n_prev", F.lit(0)) + F.lit(alpha * vocab_size))
    return j.agg(F.coalesce(F.sum("_c"), F.lit(0)).cast("bigint").alias("n_pairs"),
                 (F.sum(-F.log(prob) * F.col("_c")) / F.sum("_c")).alias("cross_entropy"))


def simulate(histories: DataFrame, scorer: Callable, num_samples: int, max_new_tokens: int) -> DataFrame:
    """Batch generation hook. ``histories`` is ``(person_id, tokens array<int>)``;
    ``scorer(batch_of_histories_df, num_samples, max_new_tokens)`` returns a pandas
    frame ``(person_id, sim_id, pos, token_id)``. Spark partitions the persons and
    streams Arrow batches through the scorer; no model ships with this package."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            yield scorer(pdf, num_samples, max_new_tokens)

    return histories.mapInPandas(run, "person_id bigint, sim_id int, pos int, token_id int")
