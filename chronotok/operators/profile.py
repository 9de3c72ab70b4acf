"""Profiles and reports over the token table.

All aggregates run on the long token table, so a long patient never becomes
one huge array; percentiles of sequence lengths run on the small
``length -> frequency`` table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.tokens import token_category
from ..session import cut_lineage
from .vocab import decode


def lengths(tokens: DataFrame) -> DataFrame:
    """Per-person sequence length ``(person_id, n_tokens)``."""
    return tokens.groupBy("person_id").agg(F.count(F.lit(1)).cast("int").alias("n_tokens"))


def token_frequency(tokens: DataFrame) -> DataFrame:
    """A5: ``(token_id, n)`` over all sequences."""
    return tokens.groupBy("token_id").agg(F.count(F.lit(1)).alias("n"))


def top_tokens(tokens: DataFrame, vocab: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most frequent tokens (ties by id) with their rank."""
    top = token_frequency(tokens).orderBy(F.col("n").desc(), F.col("token_id")).limit(k)
    w = Window.orderBy(F.col("n").desc(), F.col("token_id"))  # over k rows
    return decode(top.withColumn("rank", F.row_number().over(w)), vocab).select("rank", "token_id", "token", "n")


def _length_freq(lens: DataFrame) -> DataFrame:
    return lens.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("freq"))


def _pct(p) -> Column:
    return F.percentile(F.col("n_tokens"), F.lit(p), F.col("freq"))


def dataset_profile(tokens: DataFrame) -> DataFrame:
    """Patients, total tokens, mean/median/min/max/population-std length, unique tokens."""
    lf = _length_freq(lengths(tokens))
    n = F.sum("freq")
    mean = F.sum(F.col("n_tokens") * F.col("freq")) / n
    var = F.sum(F.col("freq") * F.col("n_tokens") * F.col("n_tokens")) / n - mean * mean
    stats = lf.agg(
        n.alias("num_patients"),
        F.sum(F.col("n_tokens") * F.col("freq")).alias("total_tokens"),
        mean.alias("avg_sequence_length"),
        _pct(0.5).alias("median_sequence_length"),
        F.min("n_tokens").alias("min_sequence_length"),
        F.max("n_tokens").alias("max_sequence_length"),
        F.sqrt(F.greatest(var, F.lit(0.0))).alias("std_sequence_length"),
    )
    uniq = tokens.agg(F.countDistinct("token_id").alias("unique_tokens"))
    # both sides are single-row aggregates; join them on a constant key
    return stats.withColumn("_k", F.lit(1)).join(uniq.withColumn("_k", F.lit(1)), "_k").drop("_k")


def length_summary(tokens: DataFrame) -> DataFrame:
    """N, min, max, mean, median and p10/p25/p75/p90 of sequence lengths."""
    lf = _length_freq(lengths(tokens))
    n = F.sum("freq")
    return lf.agg(
        n.alias("patients"),
        F.min("n_tokens").alias("min_length"),
        F.max("n_tokens").alias("max_length"),
        (F.sum(F.col("n_tokens") * F.col("freq")) / n).alias("mean_length"),
        _pct(0.5).alias("median_length"),
        _pct(0.1).alias("p10"),
        _pct(0.25).alias("p25"),
        _pct(0.75).alias("p75"),
        _pct(0.9).alias("p90"),
    )


def length_buckets(tokens: DataFrame) -> DataFrame:
    """Patients per length bucket, all six buckets shown (zeros included)."""
    spark = tokens.sparkSession
    n = F.col("n_tokens")
    expr = None
    for label, ub in K.LENGTH_BUCKETS:
        expr = F.when(n <= ub, F.lit(label)) if expr is None else expr.when(n <= ub, F.lit(label))
    expr = expr.otherwise(F.lit(K.LENGTH_BUCKET_REST))
    counts = lengths(tokens).groupBy(expr.alias("bucket")).agg(F.count(F.lit(1)).alias("patients"))
    labels = [lab for lab, _ in K.LENGTH_BUCKETS] + [K.LENGTH_BUCKET_REST]
    all_b = spark.createDataFrame([(lab, i) for i, lab in enumerate(labels)], "bucket string, bucket_order int")
    return all_b.join(F.broadcast(counts), "bucket", "left").select(
        "bucket", "bucket_order", F.coalesce("patients", F.lit(0)).cast("bigint").alias("patients"))


def length_histogram(tokens: DataFrame, bins: int = 50) -> DataFrame:
    """Equal-width histogram over [min, max], last bin closed, empty bins included."""
    lf = _length_freq(lengths(tokens))
    mm = lf.agg(F.min("n_tokens").alias("lo"), F.max("n_tokens").alias("hi"))
    width = (F.col("hi") - F.col("lo")).cast("double")
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("n_tokens") - F.col("lo")) * bins / width), F.lit(bins - 1)))
    counts = lf.withColumn("_k", F.lit(1)).join(F.broadcast(mm.withColumn("_k", F.lit(1))), "_k").groupBy(b.cast("int").alias("bin")).agg(
        F.sum("freq").alias("patients"))
    all_bins = mm.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi")
    w = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return all_bins.join(counts, "bin", "left").select(
        "bin",
        F.round(F.col("lo") + F.col("bin") * w, 6).alias("bin_start"),
        F.round(F.col("lo") + (F.col("bin") + 1) * w, 6).alias("bin_end"),
        F.coalesce("patients", F.lit(0)).cast("bigint").alias("patients"),
    )


def vocab_report(vocab: DataFrame, tokens: DataFrame) -> DataFrame:
    """A10/K6: every vocabulary token with its category and count over the sequences."""
    counts = token_frequency(tokens)
    return vocab.select("token", "token_id").join(counts, "token_id", "left").select(
        token_category("token").alias("category"), "token_id", "token",
        F.coalesce("n", F.lit(0)).alias("count"))


def patient_top_tokens(tokens: DataFrame, vocab: DataFrame, k: int = 10) -> DataFrame:
    """Per person: length, distinct tokens and the ``k`` most frequent tokens.

    Ties keep the order of first occurrence in the sequence.
    """
    per = tokens.groupBy("person_id", "token_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    w_all = Window.partitionBy("person_id")
    w = w_all.orderBy(F.col("n").desc(), F.col("first_pos").asc())
    ranked = (
        per.withColumn("timeline_length", F.sum("n").over(w_all).cast("int"))
        .withColumn("unique_tokens", F.count(F.lit(1)).over(w_all).cast("int"))
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
    )
    return decode(ranked, vocab).select("person_id", "timeline_length", "unique_tokens", "rank", "token", "n")


def example_timelines(tokens: DataFrame, vocab: DataFrame, min_len: int = 100,
                      preview: int = 400, per_line: int = 8, n_examples: int = 2, random_seed: int | None = None) -> DataFrame:
    """Decoded preview of up to two patients longer than ``min_len`` (lowest ids),
    else the two longest; first ``preview`` tokens, ``per_line`` per line. With ``random_seed``
    (T5) the patients are the first of all in the order of md5(seed|id)."""
    lens = lengths(tokens)
    long_ones = lens.where(F.col("n_tokens") > min_len).orderBy("person_id").limit(n_examples)
    longest = lens.orderBy(F.col("n_tokens").desc(), F.col("person_id")).limit(n_examples)
    has_long = lens.where(F.col("n_tokens") > min_len).limit(1).count() > 0
    picked = (long_ones if has_long else longest).select("person_id")
    if random_seed is not None:
        from .datasets import hash_key

        picked = lens.orderBy(hash_key(random_seed, "person_id"), "person_id").limit(n_examples).select("person_id")
    sel = tokens.join(F.broadcast(picked), "person_id", "left_semi").where(F.col("pos") < preview)
    dec = decode(sel, vocab)
    return dec.groupBy("person_id", F.floor(F.col("pos") / per_line).cast("int").alias("line_no")).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]), ", "
        ).alias("line")
    )


def _map_lookup(mapping: dict, key: Column) -> Column:
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return m[key]


def token_label(token) -> Column:
    """readable fallback label of a token without a concept name."""
    t = F.col(token) if isinstance(token, str) else token

    def rest(prefix: str) -> Column:
        return F.substring(t, len(prefix) + 1, 1 << 20)

    ev = F.lower(rest("EVENT_"))
    titled = F.concat(F.upper(F.substring(ev, 1, 1)), F.substring(ev, 2, 1 << 20))
    qnum = F.substring(t, 2, 1 << 20)
    return (
        F.when(t.isin(K.SPECIAL_TOKENS), t)
        .when(t.startswith("EVENT_"), F.coalesce(_map_lookup(K.LABEL_EVENT, ev), F.concat(F.lit("Medical Event: "), titled)))
        .when(t.startswith("AGE_"), F.coalesce(_map_lookup(K.LABEL_AGE, rest("AGE_")),
                                               F.concat(F.lit("Age interval: "), rest("AGE_"), F.lit(" years"))))
        .when(t.startswith("TIME_"), F.coalesce(_map_lookup(K.LABEL_TIME, rest("TIME_")),
                                                F.concat(F.lit("Time gap: "), rest("TIME_"), F.lit(" intervals"))))
        .when(t.startswith("GENDER_"), F.concat(F.lit("Gender: "), F.coalesce(_map_lookup(K.LABEL_GENDER, rest("GENDER_")), rest("GENDER_"))))
        .when(t.startswith("RACE_"), F.concat(F.lit("Race: "), F.coalesce(_map_lookup(K.LABEL_RACE, rest("RACE_")), rest("RACE_"))))
        .when(t.startswith("YEAR_"), F.coalesce(_map_lookup(K.LABEL_YEAR, rest("YEAR_")),
                                                F.concat(F.lit("Birth year interval: "), rest("YEAR_"))))
        .when(t.startswith("VISIT_TYPE_"), F.concat(F.lit("Visit type: "),
                                                    F.coalesce(_map_lookup(K.LABEL_VISIT, rest("VISIT_TYPE_")), rest("VISIT_TYPE_"))))
        .when(t.startswith("UNIT_"), F.concat(F.lit("Unit: "), F.coalesce(
            _map_lookup(K.LABEL_UNIT, rest("UNIT_")), F.concat(F.lit("Unit ID "), rest("UNIT_")))))
        .when(t.startswith("Q") & qnum.rlike("^[0-9]+$"), F.coalesce(
            _map_lookup(K.LABEL_QUANTILE, qnum.cast("int")),
            F.concat(F.lit("Quantile: "), qnum.cast("int").cast("string"), F.lit("th percentile"))))
        .otherwise(F.concat(F.lit("Token: "), t))
    )


def concept_dictionary(concept: DataFrame) -> DataFrame:
    """One row per concept id (deterministic pick: smallest name)."""
    cols = [c for c in ["concept_id", "concept_name", "domain_id", "vocabulary_id", "concept_code",
                        "concept_class_id", "standard_concept"] if c in concept.columns]
    w = Window.partitionBy("concept_id").orderBy(F.col("concept_name").asc_nulls_last())
    return concept.select(*cols).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def lookup_concepts(ids: DataFrame, concept: DataFrame, id_col: str = "concept_id") -> DataFrame:
    """Concept rows for a bounded id list (semi join against the broadcast ids)."""
    wanted = ids.select(F.col(id_col).alias("concept_id")).distinct()
    return concept.join(wanted, "concept_id", "left_semi")


def top_token_report(tokens: DataFrame, vocab: DataFrame, concept: DataFrame,
                     top_k: int = K.REPORT_TOP_K, include_misc: bool = False) -> DataFrame:
    """Most frequent tokens with concept names and labels.

    Percentages are over the tokens that pass the concept filter, before top-k.
    """
    counts = cut_lineage(token_frequency(tokens).withColumnRenamed("n", "raw_count"))  # read twice below
    rows = counts.join(vocab.select("token_id", "token"), "token_id")
    is_concept = None
    for p in K.REPORT_CONCEPT_PREFIXES:
        is_concept = F.col("token").startswith(p) if is_concept is None else is_concept | F.col("token").startswith(p)
    if not include_misc:
        rows = rows.where(is_concept)
    # the filtered token table has at most one row per vocabulary entry, so the
    # grand total is a window over that bounded table
    total = F.sum("raw_count").over(Window.partitionBy(F.lit(1)))
    core = F.regexp_replace(F.col("token"), "__TABLE_.*$", "")
    code = None
    for p in K.REPORT_CONCEPT_PREFIXES:
        suffix = F.substring(core, len(p) + 1, 1 << 20)
        val = F.when(suffix.rlike("^-?[0-9]+$"), suffix.cast("bigint"))
        code = F.when(F.col("token").startswith(p), val) if code is None else code.when(F.col("token").startswith(p), val)
    rows = rows.withColumn("_total", total).withColumn("concept_code", code)
    meta = lookup_concepts(rows.where(F.col("concept_code").isNotNull()).select(F.col("concept_code").alias("concept_id")),
                           concept_dictionary(concept))
    meta = meta.select(F.col("concept_id").alias("concept_code"), "concept_name", "domain_id", "vocabulary_id",
                       "concept_class_id")
    out = rows.join(meta, "concept_code", "left").select(
        "token", "token_id", "raw_count",
        F.round(F.col("raw_count") / F.greatest(F.col("_total"), F.lit(1)) * 100.0, 6).alias("frequency_percent"),
        F.coalesce(F.col("concept_name"), token_label("token")).alias("interpretation"),
        "concept_code", "concept_name", "domain_id", "vocabulary_id", "concept_class_id",
    )
    return out.orderBy(F.col("raw_count").desc(), F.col("token_id").asc()).limit(top_k)


def standard_concepts(concept_ids: DataFrame, concept: DataFrame, relationship: DataFrame) -> DataFrame:
    """Map ids through ``'Maps to'`` (1->n multiplies rows), prefer the standard name."""
    ids = concept_ids.select("concept_id").distinct()
    maps = relationship.where(F.col("relationship_id") == "Maps to").select(
        F.col("concept_id_1").alias("concept_id"), F.col("concept_id_2")).distinct()
    c = concept_dictionary(concept)
    std = c.select(F.col("concept_id").alias("standard_id"), F.col("concept_name").alias("standard_concept_name"))
    m = ids.join(maps, "concept_id", "left").withColumn(
        "standard_id", F.coalesce("concept_id_2", "concept_id")).drop("concept_id_2")
    m = m.join(c.select("concept_id", "concept_name", "domain_id", "vocabulary_id", "standard_concept"), "concept_id", "left")
    m = m.join(std, "standard_id", "left")
    return m.select(
        "concept_id", "standard_id",
        F.coalesce("standard_concept_name", "concept_name").alias("concept_name"),
        "standard_concept_name", "domain_id", "vocabulary_id", "standard_concept",
    )


def concept_name(concept: DataFrame, concept_id: int) -> DataFrame:
    """Single id lookup (empty result = not found)."""
    return concept.where(F.col("concept_id") == F.lit(concept_id)).select("concept_id", "concept_name")


def select_patient(tokens: DataFrame, person_id: int, shown: int = 10) -> DataFrame:
    """One patient's tokens; for an unknown id an error that names the first known ids."""
    own = tokens.where(F.col("person_id") == F.lit(person_id))
    if own.isEmpty():
        first = [r.person_id for r in first_patient_ids(tokens, shown).collect()]
        raise LookupError(f"patient {person_id} not found; the first ids are {first}")
    return own


def first_patient_ids(tokens: DataFrame, n: int = 10) -> DataFrame:
    """P19 helper: the first ``n`` patient ids."""
    return tokens.select("person_id").distinct().orderBy("person_id").limit(n)
