"""Training datasets cut from the token table.

Randomness is replaced by md5 of ``seed|key`` so every run (and the SQL
oracle) picks the same rows. Global orders (splits, batches, corpus offsets)
use :mod:`.ranking`, never an unpartitioned window over persons or tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from .profile import lengths
from .ranking import exclusive_running_sum, global_rank
from ..session import cut_lineage
from .vocab import id_remap, special_id


def hash_key(seed, *parts) -> Column:
    """md5 hex of ``seed|part|...`` (lexical order of the hex = numeric order)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]))


def hash_int(seed, *parts) -> Column:
    """First 32 bits of :func:`hash_key` as a non-negative bigint."""
    return F.conv(F.substring(hash_key(seed, *parts), 1, 8), 16, 10).cast("bigint")


def remap_tokens(tokens: DataFrame, old_vocab: DataFrame, new_vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids re-mapped under a shrunk vocabulary (dropped -> ``<UNK>``), and the
    one-row statistics ``(replaced, total, pct_replaced)``."""
    m = id_remap(old_vocab, new_vocab)
    unk = special_id(new_vocab, K.UNK)
    mb = m
    out = tokens.join(mb, tokens["token_id"] == mb["old_id"], "left").withColumn(
        "new_id", F.coalesce(F.col("new_id"), F.lit(unk)).cast("int")).drop("old_id")
    replaced = F.sum(((F.col("new_id") == unk) & (F.col("token_id") != unk)).cast("long"))
    total = F.count(F.lit(1))
    stats = out.agg(replaced.alias("replaced"), total.alias("total")).withColumn(
        "pct_replaced", F.round(F.col("replaced") * 100.0 / F.col("total"), 6))
    return out, stats


def person_split(persons: DataFrame, ratio: float = K.TRAIN_RATIO, seed: int = K.SPLIT_SEED,
                 rounding: str = "half_even", names=("train", "test")) -> DataFrame:
    """Exact-count split of distinct persons in md5(seed|id) order.

    The first ``round(ratio*n)`` (``rounding='half_even'``) or ``floor(ratio*n)``
    (``'floor'``) persons of that order form the first split.
    """
    ids = persons.select("person_id").distinct().withColumn("_h", hash_key(seed, "person_id"))
    ranked = global_rank(ids, ["_h", "person_id"], out="_rank")
    n = ids.count()
    cut = round(ratio * n) if rounding == "half_even" else int(n * ratio)
    return ranked.select("person_id", F.when(F.col("_rank") < cut, F.lit(names[0])).otherwise(F.lit(names[1])).alias("split"))


def filter_min_length(lens: DataFrame, min_tokens: int = 10) -> DataFrame:
    """Keep sequences with more than ``min_tokens`` tokens (any table with ``n_tokens``)."""
    return lens.where(F.col("n_tokens") > min_tokens)


def next_token_examples(tokens: DataFrame, lens: DataFrame, max_seq_len: int, seed: int = K.SPLIT_SEED,
                        epoch: int = 0) -> DataFrame:
    """(input_ids, target_ids) per person of ``lens`` (:func:`profile.lengths`).

    Only the rows of the slice leave the long token table, so at most ``max_seq_len`` tokens
    of a person are ever collected.

    len <= L: input = t[:-1], target = t[1:]; len > L: a window of L tokens at a
    start drawn from md5(seed|person|epoch) in [0, len-L-1].
    """
    n = F.col("n_tokens")
    start = F.when(n > max_seq_len, F.pmod(hash_int(seed, "person_id", F.lit(epoch)), n - max_seq_len)).otherwise(F.lit(0))
    length = F.least(n, F.lit(max_seq_len))
    a = lens.select("person_id", "n_tokens", start.cast("int").alias("start"), length.alias("_len"))
    part = tokens.select("person_id", "pos", "token_id").join(a, "person_id").where(
        (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.col("_len")))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("pos", "token_id"))), lambda x: x["token_id"])
    return part.groupBy("person_id", "n_tokens", "start", "_len").agg(ids.alias("_t")).select(
        "person_id", "n_tokens", "start",
        F.slice("_t", F.lit(1), F.col("_len") - 1).alias("input_ids"),
        F.slice("_t", F.lit(2), F.col("_len") - 1).alias("target_ids"),
    )


def next_token_pairs(tokens: DataFrame) -> DataFrame:
    """W10 on the long form: (person, pos, input token, next token).

    The tokenizer already emits each token's successor (``next_token_id``), so this
    is a filter; other token tables fall back to ``lead`` over the person."""
    if "next_token_id" in tokens.columns:
        return tokens.where(F.col("next_token_id").isNotNull()).select(
            "person_id", "pos", "token_id", F.col("next_token_id").alias("target_id"))
    w = Window.partitionBy("person_id").orderBy("pos")
    return tokens.select("person_id", "pos", "token_id", F.lead("token_id").over(w).alias("target_id")).where(
        F.col("target_id").isNotNull())


def corpus_positions(tokens: DataFrame, sos_id: int = 3, eos_id: int = 2) -> DataFrame:
    """Continuous corpus ``<SOS> t... <EOS>`` per person (persons by id), as
    ``(global_pos, token_id)``. Offsets come from a two-phase running sum."""
    lens = lengths(tokens).withColumn("_w", F.col("n_tokens") + 2)
    offs = exclusive_running_sum(lens, [], ["person_id"], "_w", out="_off")
    # one offset row per person; persons are not a bounded set, so this joins by shuffle
    body = tokens.join(offs.select("person_id", "_off"), "person_id").select(
        (F.col("_off") + 1 + F.col("pos")).cast("bigint").alias("global_pos"), "token_id")
    marks = offs.select(
        F.explode(F.array(
            F.struct(F.col("_off").cast("bigint").alias("global_pos"), F.lit(sos_id).alias("token_id")),
            F.struct((F.col("_off") + F.col("n_tokens") + 1).cast("bigint").alias("global_pos"), F.lit(eos_id).alias("token_id")),
        )).alias("m")).select("m.global_pos", "m.token_id")
    return body.unionByName(marks)


def corpus_chunks(corpus: DataFrame, chunk_len: int) -> DataFrame:
    """Fixed-length chunks ``floor(global_pos / L)`` of the continuous corpus."""
    return corpus.groupBy((F.floor(F.col("global_pos") / chunk_len)).cast("bigint").alias("chunk_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("global_pos", "token_id"))), lambda s: s["token_id"]).alias("tokens"))


def sliding_windows(corpus: DataFrame, window: int, stride: int = 1) -> DataFrame:
    """Windows of ``window`` tokens at starts 0, stride, .. < N - window.

    Built from chunks of ``window`` tokens: the window starting in chunk k lies
    in chunks k and k+1, so each token is copied twice (not ``window`` times).
    """
    ch = cut_lineage(corpus_chunks(corpus, window).withColumn("_n", F.size("tokens")))
    n_windows = max(0, (ch.agg(F.sum("_n")).first()[0] or 0) - window)
    nxt = ch.select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("tokens").alias("_next"))
    both = ch.join(nxt, "chunk_id", "left").withColumn(
        "_buf", F.concat("tokens", F.coalesce("_next", F.array().cast("array<int>"))))
    base = F.col("chunk_id") * window
    offsets = F.filter(F.sequence(F.lit(0), F.lit(window - 1)),
                       lambda o: (base + o < n_windows) & (F.pmod(base + o, F.lit(stride)) == 0))
    cut = F.transform(offsets, lambda o: F.struct(  # cut before the explode: no exploded row carries the buffer
        (base + o).cast("bigint").alias("start"), F.slice("_buf", o + 1, window - 1).alias("input_ids"),
        F.slice("_buf", o + 2, window - 1).alias("target_ids")))
    return both.select(F.explode(cut).alias("_w")).select("_w.*")


def batches(examples: DataFrame, batch_size: int, seed: int = K.SPLIT_SEED, shuffle: bool = True,
            drop_last: bool = False, pad_id: int = 0) -> DataFrame:
    """Batch ids over an md5 order, padding to the longest input of each batch."""
    order = [hash_key(seed, "person_id", "start").alias("_h"), "person_id"] if shuffle else ["person_id", "start"]
    ex = examples.select("*", *([order[0]] if shuffle else []))
    ranked = global_rank(ex, ["_h", "person_id"] if shuffle else ["person_id", "start"], out="_rank")
    n = examples.count()
    full = (n // batch_size) * batch_size
    b = ranked.withColumn("batch_id", F.floor(F.col("_rank") / batch_size).cast("bigint")).withColumn(
        "slot", (F.col("_rank") % batch_size).cast("int"))
    if drop_last:
        b = b.where(F.col("_rank") < full)
    w = Window.partitionBy("batch_id")  # at most batch_size rows per batch
    b = b.withColumn("_max", F.max(F.size("input_ids")).over(w))

    def pad(c):
        return F.concat(F.col(c), F.array_repeat(F.lit(pad_id), F.col("_max") - F.size(c)))

    return b.select("batch_id", "slot", "person_id", F.size("input_ids").alias("n_real"),
                    pad("input_ids").alias("input_ids"), pad("target_ids").alias("target_ids"))


def tail_tokens(arrays: DataFrame, n: int) -> DataFrame:
    """The last ``n`` tokens of each sequence (the model's input window)."""
    return arrays.withColumn("tokens", F.when(F.size("tokens") > n, F.slice("tokens", -n, n)).otherwise(F.col("tokens")))
