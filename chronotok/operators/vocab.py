"""Vocabulary construction (Z5, T1, W17), shrink and remap (Z8, Z9, A23),
decoding (J4) and target resolution (E1).

The vocabulary is bounded by construction: 56 fixed tokens, the categorical
tokens (genders, races, birth-year bands, visit types, units) and at most
``vocab_size`` concepts, picked by a distributed top-k (TakeOrdered). Ranking
windows only ever run over this bounded table, never over event or token rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.tokens import token_category
from ..session import cut_lineage

CATEGORY_GROUP_ORDER = ["GENDER", "RACE", "YEAR", "VISIT_TYPE", "UNIT"]


def fixed_tokens(spark) -> DataFrame:
    rows = [(t, i) for i, t in enumerate(K.fixed_vocab_tokens())]
    return spark.createDataFrame(rows, "token string, token_id int")


def build_vocabulary(categories: DataFrame, concept_counts: DataFrame,
                     vocab_size: int = K.VOCAB_SIZE) -> DataFrame:
    """``(token, token_id, category, n)`` with dense ids from 0.

    ``categories`` is :func:`stats.distinct_categories`, ``concept_counts`` is
    :func:`stats.concept_frequency`. Ties among concepts break on token text.
    """
    spark = categories.sparkSession
    fixed = fixed_tokens(spark)
    n_fixed = len(K.fixed_vocab_tokens())
    grp = F.create_map(*[x for i, g in enumerate(CATEGORY_GROUP_ORDER) for x in (F.lit(g), F.lit(i))])
    cat_tokens = categories.select(
        F.concat(F.col("category"), F.lit("_"), F.col("value")).alias("token"),
        grp[F.col("category")].alias("grp"),
    ).distinct()
    cat_tokens = cut_lineage(cat_tokens)
    n_cat = cat_tokens.count()
    w_cat = Window.orderBy("grp", "token")  # bounded: categorical tokens only
    cat_ids = cat_tokens.select(
        "token", (F.row_number().over(w_cat) - 1 + n_fixed).cast("int").alias("token_id"))
    capacity = max(0, vocab_size - n_fixed - int(n_cat))
    top = (
        concept_counts.groupBy("token").agg(F.sum("n").alias("n"))
        .orderBy(F.col("n").desc(), F.col("token").asc())
        .limit(capacity)
    )
    w_c = Window.orderBy(F.col("n").desc(), F.col("token").asc())  # bounded by capacity
    concept_ids = top.select(
        "token", (F.row_number().over(w_c) - 1 + n_fixed + int(n_cat)).cast("int").alias("token_id"), "n")
    vocab = (
        fixed.withColumn("n", F.lit(None).cast("bigint"))
        .unionByName(cat_ids.withColumn("n", F.lit(None).cast("bigint")))
        .unionByName(concept_ids)
        .withColumn("category", token_category("token"))
    )
    return cut_lineage(vocab.repartition(1))


def encode(tokens: DataFrame, vocab: DataFrame, token_col: str = "token", out: str = "token_id") -> DataFrame:
    """Token string -> id, default 0 (``<PAD>``) when absent."""
    v = vocab.select(F.col("token").alias("_tok"), F.col("token_id").alias("_tid"))
    return (
        tokens.join(v, tokens[token_col] == v["_tok"], "left")
        .withColumn(out, F.coalesce(F.col("_tid"), F.lit(0)).cast("int"))
        .drop("_tok", "_tid")
    )


def decode(ids: DataFrame, vocab: DataFrame, id_col: str = "token_id", out: str = "token",
           unknown_prefix: str = "UNKNOWN_") -> DataFrame:
    """Id -> token string, default ``<unknown_prefix><id>``."""
    v = vocab.select(F.col("token_id").alias("_tid"), F.col("token").alias("_tok"))
    return (
        ids.join(v, ids[id_col] == v["_tid"], "left")
        .withColumn(out, F.coalesce(F.col("_tok"), F.concat(F.lit(unknown_prefix), F.col(id_col).cast("string"))))
        .drop("_tid", "_tok")
    )


def shrink_vocabulary(vocab: DataFrame, token_counts: DataFrame, max_vocab_size: int = K.SHRUNK_VOCAB_SIZE) -> DataFrame:
    """Keep specials and structural tokens, then the most frequent clinical tokens.

    ``token_counts`` is ``(token, n)`` over the tokenized sequences. New ids:
    specials in canonical order, then structural tokens by prefix group (token
    text order inside a group), then other kept tokens by text, then kept
    clinical tokens by (count desc, token). Raises when no capacity is left.
    """
    t = F.col("token")
    prunable = None
    for p in K.PRUNABLE_PREFIXES:
        prunable = t.startswith(p) if prunable is None else prunable | t.startswith(p)
    special = t.isin(K.SPECIAL_TOKENS)
    grp_expr = F.when(special, F.lit(0))
    sub = F.when(special, F.array_position(F.array(*[F.lit(s) for s in K.SPECIAL_TOKENS]), t))
    for i, p in enumerate(K.ALWAYS_KEEP_PREFIXES):
        grp_expr = grp_expr.when(~prunable & t.startswith(p), F.lit(1 + i))
    grp_expr = grp_expr.when(~prunable, F.lit(1 + len(K.ALWAYS_KEEP_PREFIXES))).otherwise(F.lit(99))
    v = vocab.select("token").withColumn("grp", grp_expr).withColumn("sub", sub.cast("bigint"))
    v = cut_lineage(v)
    n_keep = v.where("grp < 99").count()
    capacity = max_vocab_size - n_keep
    if capacity <= 0:
        raise ValueError(f"max_vocab_size={max_vocab_size} too small; needs > always_keep={n_keep}")
    counts = token_counts.groupBy("token").agg(F.sum("n").alias("n"))
    clinical = (
        v.where("grp = 99").join(counts, "token", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .orderBy(F.col("n").desc(), F.col("token").asc())
        .limit(capacity)
    )
    kept = v.where("grp < 99").withColumn("n", F.lit(0).cast("bigint")).unionByName(clinical)
    w = Window.orderBy("grp", F.col("sub").asc_nulls_last(), F.when(F.col("grp") == 99, -F.col("n")), "token")
    out = kept.select("token", (F.row_number().over(w) - 1).cast("int").alias("token_id"))
    return cut_lineage(out.repartition(1))


def id_remap(old_vocab: DataFrame, new_vocab: DataFrame) -> DataFrame:
    """Old id -> new id, tokens dropped by the shrink -> ``<UNK>``."""
    unk = special_id(new_vocab, K.UNK)
    m = old_vocab.select("token", F.col("token_id").alias("old_id")).join(
        new_vocab.select("token", F.col("token_id").alias("new_id")), "token", "left")
    return m.select("old_id", F.coalesce("new_id", F.lit(unk)).cast("int").alias("new_id"))


def special_id(vocab: DataFrame, token: str) -> int:
    """Id of a special token; a vocabulary without it is an error."""
    row = vocab.where(F.col("token") == token).select("token_id").first()
    if row is None:
        raise ValueError(f"the vocabulary has no {token}")
    return row[0]


def resolve_targets(vocab: DataFrame, concept_targets: list[str] | None = None, regex: str | None = None,
                    event_type: str | None = None, concept_ids: list[int] | None = None) -> DataFrame:
    """Distinct target ids from token names, an event type with concept ids, and/or a regex
    over the vocabulary. No target at all is an error."""
    cond = F.lit(False)
    names = list(concept_targets or [])
    if event_type and concept_ids:
        prefix = K.CONCEPT_PREFIX.get(event_type.lower())
        names += [f"{prefix}{c}" for c in concept_ids] if prefix else []
    if names:
        cond = cond | F.col("token").isin(names)
    if regex:
        cond = cond | F.col("token").rlike(regex)
    out = vocab.where(cond).select("token", "token_id").distinct()
    if out.isEmpty():
        raise ValueError("no target token resolved: give an event type with concept ids, names or a regex")
    return out
