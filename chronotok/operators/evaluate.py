"""Scoring simulated futures against what happened.

Simulated futures are an input table ``sims(person_id, sim_id, pos, token)``
(the generator itself is not table work). Rank metrics group by score first and take
cumulative counts from the two-phase running sum, so a target with a distinct score for
every person is spread over many tasks too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..session import cut_lineage
from .datasets import hash_int, hash_key
from .labels import sequence_minutes, target_table
from .ranking import exclusive_running_sum


def sim_token_prob(sim_ev: DataFrame, num_samples: int) -> DataFrame:
    """Per (person, token) share of simulations containing the token."""
    return sim_ev.groupBy("person_id", "token").agg(
        (F.countDistinct("sim_id") / F.lit(float(num_samples))).alias("prob"))


def sim_target_prob(sim_ev: DataFrame, persons: DataFrame, targets: list[str], num_samples: int) -> DataFrame:
    """Per (person, target) share of simulations with any variant of the target;
    every (person, target) pair appears (zeros included)."""
    tv = target_table(persons.sparkSession, targets)
    names = [r.variant for r in tv.select("variant").distinct().collect()]  # a few per target; filters before the join
    named = sim_ev.where(F.col("token").isin(names))
    hits = named.join(F.broadcast(tv), named["token"] == tv["variant"]).groupBy("person_id", "target").agg(
        F.countDistinct("sim_id").alias("_k"))
    grid = persons.select("person_id").distinct().withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets])))
    return grid.join(hits, ["person_id", "target"], "left").select(
        "person_id", "target", (F.coalesce("_k", F.lit(0)) / F.lit(float(num_samples))).alias("prob"))


def set_metrics(pred: DataFrame, truth: DataFrame, persons: DataFrame) -> DataFrame:
    """Per person TP/FP/FN, precision, recall, F1 and Jaccard of two token sets
    (``pred`` and ``truth`` are ``(person_id, token)``; empty sets give 0)."""
    p = pred.select("person_id", "token").distinct().withColumn("_p", F.lit(1))
    t = truth.select("person_id", "token").distinct().withColumn("_t", F.lit(1))
    both = p.join(t, ["person_id", "token"], "full_outer").select(
        "person_id", F.coalesce("_p", F.lit(0)).alias("_p"), F.coalesce("_t", F.lit(0)).alias("_t"))
    c = both.groupBy("person_id").agg(
        F.sum(F.col("_p") * F.col("_t")).alias("tp"),
        F.sum(F.col("_p") * (1 - F.col("_t"))).alias("fp"),
        F.sum((1 - F.col("_p")) * F.col("_t")).alias("fn"),
    )
    c = persons.select("person_id").distinct().join(c, "person_id", "left").select(
        "person_id", *[F.coalesce(x, F.lit(0)).cast("bigint").alias(x) for x in ("tp", "fp", "fn")])
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    c = c.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    union = F.col("tp") + F.col("fp") + F.col("fn")
    return c.withColumn("f1", f1).withColumn("jaccard", F.when(union > 0, F.col("tp") / union).otherwise(0.0))


def micro_metrics(per_person: DataFrame) -> DataFrame:
    """Micro precision/recall/F1 over summed counts and the mean Jaccard."""
    s = per_person.agg(
        F.count(F.lit(1)).alias("n_patients"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
        F.sum("fn").alias("fn"), F.avg("jaccard").alias("jaccard_mean"))
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    s = s.withColumn("precision_micro", prec).withColumn("recall_micro", rec)
    f1 = F.when(F.col("precision_micro") + F.col("recall_micro") > 0,
                2 * F.col("precision_micro") * F.col("recall_micro") / (F.col("precision_micro") + F.col("recall_micro"))
                ).otherwise(0.0)
    return s.withColumn("f1_micro", f1).select(
        "n_patients", "precision_micro", "recall_micro", "f1_micro", F.coalesce("jaccard_mean", F.lit(0.0)).alias("jaccard_mean"))


def _score_table(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Per (keys, score): positives and negatives, plus cumulative counts above/below."""
    g = scored.groupBy(*keys, "score").agg(
        F.sum(F.col("label")).alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    r = exclusive_running_sum(g, keys, ["score"], ["pos", "neg"], ["pos_below", "neg_below"], total=["P", "N"])
    return r.withColumn("tp_cum", F.col("P") - F.col("pos_below")).withColumn("fp_cum", F.col("N") - F.col("neg_below"))


def auroc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Rank AUROC with half credit for ties; NULL when only one class is present.
    ``scored`` has ``keys``, ``score`` (double) and ``label`` (0/1)."""
    t = _score_table(scored, keys)
    agg = t.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))).alias("_num"),
        F.max("P").alias("P"), F.max("N").alias("N"))
    return agg.select(*keys, F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("_num") / (F.col("P") * F.col("N"))).alias("auroc"))


def auprc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Average precision ``sum((R_n - R_{n-1}) * P_n)`` over distinct thresholds."""
    t = _score_table(scored, keys)
    prec = F.col("tp_cum") / (F.col("tp_cum") + F.col("fp_cum"))
    t = t.withColumn("_ap", F.when(F.col("P") > 0, F.col("pos") / F.col("P") * prec))
    return t.groupBy(*keys).agg(F.when(F.max("P") > 0, F.sum("_ap")).alias("auprc"))


def brier(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Mean squared difference of probability and label."""
    return scored.groupBy(*keys).agg(F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"))


def calibration_bins(scored: DataFrame, keys: list[str], n_bins: int = K.ECE_BINS) -> DataFrame:
    """Per bin accuracy, confidence and weight. Bin = number of edges ``i*(1/n)`` (as
    doubles) not above the score, minus one; a score of 1.0 falls outside every bin."""
    step = 1.0 / n_bins
    edges = F.transform(F.sequence(F.lit(0), F.lit(n_bins)), lambda i: i.cast("double") * F.lit(step))
    b = F.size(F.filter(edges, lambda e: e <= F.col("score"))) - 1
    total = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    per = scored.withColumn("bin", b).where((F.col("bin") >= 0) & (F.col("bin") < n_bins)).groupBy(*keys, "bin").agg(
        F.avg("label").alias("accuracy"), F.avg("score").alias("confidence"), F.count(F.lit(1)).alias("_c"))
    grid = total.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    out = grid.join(per, [*keys, "bin"], "left")
    return out.select(
        *keys, "bin",
        F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        (F.coalesce("_c", F.lit(0)) / F.col("_n")).alias("weight"))


def ece(scored: DataFrame, keys: list[str], n_bins: int = K.ECE_BINS) -> DataFrame:
    """Expected calibration error ``sum(weight * |accuracy - confidence|)``."""
    b = calibration_bins(scored, keys, n_bins)
    return b.groupBy(*keys).agg(F.sum(F.col("weight") * F.abs(F.col("accuracy") - F.col("confidence"))).alias("ece"))


def roc_points(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(fpr, tpr) at every distinct threshold (descending), plus the origin with a
    NULL threshold, and the trapezoid AUC per key (every point kept)."""
    t = _score_table(scored, keys).where((F.col("P") > 0) & (F.col("N") > 0))
    pts = t.select(*keys, F.col("score").alias("threshold"), (F.col("fp_cum") / F.col("N")).alias("fpr"),
                   (F.col("tp_cum") / F.col("P")).alias("tpr"))
    origin = t.select(*keys).distinct().select(*keys, F.lit(None).cast("double").alias("threshold"),
                                               F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    # a threshold's step is neg / N wide and lies between the true-positive rates before and after it
    area = F.col("neg") / F.col("N") * (2 * F.col("tp_cum") - F.col("pos")) / (2 * F.col("P"))
    auc = t.groupBy(*keys).agg(F.sum(area).alias("auc"))
    return pts.unionByName(origin).join(auc, keys)


def balanced_cohort(labels: DataFrame, targets: list[str], want: int, seed: int = K.SPLIT_SEED) -> DataFrame:
    """Per target up to ``max(1, want // targets // 2)`` positives and negatives
    (md5 order), their union, then a top-up in md5 order to ``want`` persons.
    ``labels`` is ``(person_id, target, label)`` over the candidate persons."""
    persons = labels.select("person_id").distinct()
    n_all = persons.count()
    if n_all <= want:
        return persons
    half = max(1, want // max(1, len(targets)) // 2)
    w = Window.partitionBy("target", "label").orderBy(hash_key(seed, "target", "person_id"), "person_id")
    picked = labels.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= half).select("person_id").distinct()
    n_picked = picked.count()
    if n_picked >= want:
        return picked
    rest = persons.join(picked, "person_id", "left_anti").orderBy(
        hash_key(seed, F.lit("topup"), "person_id"), "person_id").limit(want - n_picked)
    return picked.unionByName(rest)


def prevalence(labels: DataFrame) -> DataFrame:
    """Positives and cohort size per target."""
    return labels.groupBy("target").agg(F.sum("label").cast("bigint").alias("positives"),
                                        F.count(F.lit(1)).alias("total"))


def first_of(sims: DataFrame, hit_tokens: list[str], stop_tokens: list[str], max_minutes: float | None,
             num_samples: int, seq: DataFrame | None = None) -> DataFrame:
    """Per person, share of simulations whose first event among ``hit_tokens``,
    ``stop_tokens`` and the time limit (running minutes above ``max_minutes``) is a hit
    (up to the first EOS). ``seq`` may pass a precomputed :func:`sequence_minutes`.

    One pass: the first such position and whether it is a hit are one number, whose minimum is kept in a hash
    aggregate (a minimum of structs would sort all rows of a task)."""
    s = seq if seq is not None else sequence_minutes(sims, ["person_id", "sim_id"])
    is_hit = F.col("token").isin(hit_tokens)
    is_stop = F.col("token").isin(stop_tokens) if stop_tokens else F.lit(False)
    over = (F.col("cum_minutes") > max_minutes) if max_minutes is not None else F.lit(False)
    found = (F.col("_eos_before") == 0) & F.col("person_id").isNotNull() & (is_hit | is_stop | over)
    at = F.col("pos").cast("bigint") * 2 + F.coalesce(is_hit & ~over, F.lit(False)).cast("int")
    first = s.groupBy("person_id", "sim_id").agg(F.min(F.when(found, at)).alias("_f"))
    hits = F.count(F.when(F.pmod("_f", F.lit(2)) == 1, F.col("sim_id")))
    return first.groupBy("person_id").agg((hits / F.lit(float(num_samples))).alias("prob"))


def length_of_stay(sims: DataFrame, seq: DataFrame | None = None) -> DataFrame:
    """Per simulation, running minutes at the first discharge (days); simulations
    that die before discharging, or never discharge, are dropped; per person mean."""
    s = (seq if seq is not None else sequence_minutes(sims, ["person_id", "sim_id"])).where(F.col("_eos_before") == 0)
    at = F.col("pos").cast("bigint") * 2 + (F.col("token") == "EVENT_DISCHARGE").cast("int")  # numbers: no sort of all rows
    ev = s.where(F.col("token").isin("EVENT_DISCHARGE", "EVENT_DEATH")).groupBy("person_id", "sim_id").agg(
        F.min(at).alias("_at"), F.min_by("cum_minutes", at).alias("_minutes"))
    ok = ev.where(F.pmod("_at", F.lit(2)) == 1).select(
        "person_id", "sim_id", (F.col("_minutes") / 1440.0).alias("los_days"))
    return ok.groupBy("person_id").agg(F.avg("los_days").alias("los_days"), F.count(F.lit(1)).alias("n_sims"))


def cohort_summary(pred: DataFrame, value_col: str = "prob") -> DataFrame:
    """Mean and population standard deviation of per-person predictions."""
    return pred.agg(F.count(F.lit(1)).alias("n_patients"), F.avg(value_col).alias("mean"),
                    F.stddev_pop(value_col).alias("std"))


def predictions_table(index: DataFrame, scored: DataFrame, history: DataFrame) -> DataFrame:
    """K7/F16: per-patient predictions (label, prob) with the index time as an ISO string and the
    history's length."""
    return index.join(scored, "person_id").join(history, "person_id").select(
        "person_id", F.date_format("index_time", "yyyy-MM-dd'T'HH:mm:ss").alias("index_time"), "label", "prob",
        "history_len")


def poisson_cdf(n_terms: int = 13) -> list[float]:
    """CDF of Poisson(1) at 0..n_terms-1 (the bootstrap weight distribution). The rest has
    a probability below 2**-32, the step of the hash that draws a weight."""
    import math

    out, acc, term = [], 0.0, math.exp(-1.0)
    for k in range(n_terms):
        acc += term
        out.append(acc)
        term /= (k + 1)
    return out


BOOT_BLOCK = 50  # replicates whose sums are columns of one aggregate


def _weights(n: int, first: int, seed: int) -> Column:
    """Poisson(1) weights of the row's person in replicates ``first`` .. ``first + n - 1``, as an array: from
    md5(seed|b|person), so that replicates are reproducible without a driver RNG."""
    cdf = F.array(*[F.lit(c) for c in poisson_cdf()])
    return F.transform(F.sequence(F.lit(first), F.lit(first + n - 1)), lambda b: F.size(F.filter(
        cdf, lambda c: c < hash_int(seed, b, F.col("person_id")) / F.lit(4294967296.0))))


def _blocks(n_boot: int) -> list[tuple[int, int]]:
    return [(min(BOOT_BLOCK, n_boot - b), b) for b in range(0, n_boot, BOOT_BLOCK)]


def _interval(per: DataFrame, keys: list[str], level: float) -> DataFrame:
    """Percentile interval of the replicates' values, the array column ``a`` (NULLs are replicates without a value)."""
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    each = per.select(*keys, F.explode("a").alias("a"))
    aggs = [F.percentile("a", F.lit(lo)).alias("ci_low"), F.percentile("a", F.lit(hi)).alias("ci_high"), F.count("a").alias("n_boot")]
    return each.groupBy(*keys).agg(*aggs) if keys else each.agg(*aggs)


def bootstrap_auroc(scored: DataFrame, keys: list[str], n_boot: int = 20, seed: int = K.SPLIT_SEED,
                    level: float = 0.95) -> DataFrame:
    """O3: Poisson-bootstrap confidence interval of the AUROC per key.

    A row carries its weights in all replicates as one array, and rows of equal (key, score) are
    added up element by element before anything is ordered. One rank pass over these sums serves
    every replicate and the AUROC itself.
    """
    per = None
    for n, first in _blocks(n_boot):
        w = scored.withColumn("w", _weights(n, first, seed))
        label = F.col("label").cast("long")
        sums = [F.sum(F.col("w")[i] * x).alias(f"{c}{i}") for i in range(n) for c, x in (("p", label), ("n", 1 - label))]
        g = w.groupBy(*keys, "score").agg(F.sum(label).alias("p"), F.sum(1 - label).alias("n"), *sums)
        names = ["", *map(str, range(n))]
        g = exclusive_running_sum(g, keys, ["score"], [f"n{i}" for i in names], [f"below{i}" for i in names])
        area = [F.sum(F.col(f"p{i}") * (F.col(f"below{i}") + 0.5 * F.col(f"n{i}"))) for i in names]
        pos, neg = ([F.sum(f"{c}{i}") for i in names] for c in "pn")
        auc = [F.when((x > 0) & (y > 0), z / (x * y)) for x, y, z in zip(pos, neg, area)]
        block = g.groupBy(*keys).agg(auc[0].alias("auroc"), F.array(*auc[1:]).alias("a"))
        per = block if per is None else per.unionByName(block)
    per = cut_lineage(per)
    whole = per.groupBy(*keys).agg(F.max("auroc").alias("auroc"))
    return whole.join(_interval(per, keys, level), keys, "left")


def bootstrap_mae(pred: DataFrame, truth: DataFrame, value: str, n_boot: int = 20, seed: int = K.SPLIT_SEED,
                  level: float = 0.95) -> DataFrame:
    """Mean |prediction - truth| over persons in both tables, with its Poisson-bootstrap interval. Every
    replicate is a pair of weighted sums in one pass over the rows."""
    j = pred.select("person_id", F.col(value).alias("_p")).join(truth.select("person_id", F.col(value).alias("_t")), "person_id")
    j = j.select("person_id", F.abs(F.col("_p") - F.col("_t")).alias("e"))
    per = None
    for n, first in _blocks(n_boot):
        w = j.withColumn("w", _weights(n, first, seed))
        means = [F.sum(F.col("w")[i] * F.col("e")) / F.nullif(F.sum(F.col("w")[i]), F.lit(0)) for i in range(n)]
        block = w.agg(F.count(F.lit(1)).alias("n_patients"), F.avg("e").alias("mae"), F.array(*means).alias("a"))
        per = block if per is None else per.unionByName(block)
    per = cut_lineage(per)
    whole = per.agg(F.max("n_patients").alias("n_patients"), F.max("mae").alias("mae"))
    return whole.withColumn("_k", F.lit(0)).join(_interval(per, [], level).withColumn("_k", F.lit(0)), "_k").drop("_k")


def top_k_accuracy(ranked_pred: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 2, 3, 5)) -> DataFrame:
    """Share of persons whose true token is among their top-k predicted tokens.

    ``ranked_pred`` is ``(person_id, token, rank)`` (1 = best); ``truth`` is
    ``(person_id, token)`` with one true token per person."""
    j = truth.join(ranked_pred, ["person_id", "token"], "left")
    return j.agg(F.count(F.lit(1)).alias("n_patients"),
                 *[F.avg(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))).alias(f"top{k}") for k in ks])


def mean_absolute_error(pred: DataFrame, truth: DataFrame, value: str) -> DataFrame:
    """Mean |prediction - truth| over persons present in both tables."""
    j = pred.select("person_id", F.col(value).alias("_p")).join(truth.select("person_id", F.col(value).alias("_t")), "person_id")
    return j.agg(F.count(F.lit(1)).alias("n_patients"), F.avg(F.abs(F.col("_p") - F.col("_t"))).alias("mae"))
