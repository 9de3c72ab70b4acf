"""The tokenizer (Z1-Z4, Z6, Z7, J2, J3) as one DataFrame plan, the same at every size.

Person rows (4 static slots) and event rows are unioned and cut into slices of the
(person, event order) range (:class:`ranking.Slices`), so a person with most of all events
is spread over many tasks. Windows inside a slice give the J1 filter (a person without a
person row is dropped), the previous time (gap tokens), the last-row flag (EOS), the event
number, the token offset and the successor. Only persons that lie in several slices need
anything from another slice; they get it from two broadcast tables of at most two rows per
slice. Each row builds its array of (token, id) pairs with built-in array expressions, and a
single ``posexplode`` produces the canonical long form
``timeline_tokens(person_id, pos, token, token_id, ts, ev_seq)``.

Ids are looked up on the rows, before the explode (J3): an event has at most one concept token
and one qualifier (unit or visit type), a person one gender, race and birth-year token. The
fixed tokens (events, ages, gaps, deciles) come from a map of their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.tokens import (
    age_at,
    age_band,
    concept_token,
    decile_index,
    event_token,
    gap_minutes,
    gap_tokens,
    year_band,
)
from ..session import cut_lineage
from .events import EVENT_ORDER
from .ranking import Slices, slices_for
from .vocab import encode

ROW_ORDER = ["_kind", *EVENT_ORDER]


def _named(prefix: str, value: str) -> Column:
    return F.concat(F.lit(prefix), F.coalesce(F.col(value).cast("string"), F.lit("None")))


def _person_tokens() -> dict[str, Column]:
    return {"_gender": _named("GENDER_", "gender_concept_id"), "_race": _named("RACE_", "race_concept_id"),
            "_year": F.concat(F.lit("YEAR_"), year_band("birth_year"))}


def _row_tokens() -> dict[str, Column]:
    et = F.col("et")
    unit, visit = _named("UNIT_", "unit_concept_id"), _named("VISIT_TYPE_", "visit_type")
    return {"_concept": F.when(et.isin(K.CLINICAL_TYPES), concept_token(et, "cid")),
            "_qualifier": F.when(et == "measurement", unit).when(et == "admission", visit)}


def fixed_ids(vocab: DataFrame) -> dict[str, int]:
    """Ids of the fixed tokens (at most as many as the scheme has)."""
    names = ", ".join(f"'{t}'" for t in K.fixed_vocab_tokens())
    return {r.token: r.token_id for r in vocab.where(f"token IN ({names})").select("token", "token_id").collect()}


def known(fixed: dict[str, int], token: str) -> Column:
    """The (token, id) pair of a fixed token as a constant."""
    return _pair(F.lit(token), F.lit(fixed.get(token, 0)))


def with_gaps(rows: DataFrame, prev_ts: Column, fixed: dict[str, int]) -> DataFrame:
    """``_gaps``: (token, id) pairs of the gap before each row. The minutes are a column of their own, since every
    threshold reads them."""
    return rows.withColumn("_gap", gap_minutes(prev_ts, "ts")).withColumn("_gaps", gap_tokens("_gap", lambda t: known(fixed, t)))


def static_tokens(fixed: dict[str, int]) -> Column:
    age = F.concat(F.lit("AGE_"), age_band("age"))
    return F.array(_pair(age, _fixed(fixed, age)), *[_pair(t, F.col(f"{c}_id")) for c, t in _person_tokens().items()])


def event_tokens(fixed: dict[str, int]) -> Column:
    et = F.col("et")
    head = _pair(event_token(et), _fixed(fixed, event_token(et)))
    for t in K.fixed_vocab_tokens():  # constants for the event types of the scheme
        if t.startswith("EVENT_"):
            head = F.when(et == t[len("EVENT_"):].lower(), known(fixed, t)).otherwise(head)
    q = F.try_element_at(F.array(*[known(fixed, f"Q{i}") for i in range(K.N_QUANTILES)]), F.col("_decile") + 1)  # NULL without a decile
    token = _row_tokens()
    concept = F.coalesce("_code", F.array(_pair(token["_concept"], F.col("_concept_id"))))
    qualifier = _pair(token["_qualifier"], F.col("_qualifier_id"))
    return (
        F.when(et == "admission", F.array(head, qualifier))
        .when(et == "measurement", F.concat(F.array(head), concept, F.array_compact(F.array(q, qualifier))))
        .when(et.isin(K.CLINICAL_TYPES), F.concat(F.array(head), concept))
        .otherwise(F.array(head))
    )


def _pair(token: Column, token_id: Column) -> Column:
    return F.struct(token.alias("token"), token_id.cast("int").alias("id"))


def _fixed(fixed: dict[str, int], token: Column) -> Column:
    ids = F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv]) if fixed else F.lit(None).cast("map<string,int>")
    return F.coalesce(F.try_element_at(ids, token), F.lit(0))


def _with_ids(rows: DataFrame, vocab: DataFrame, tokens: dict[str, Column]) -> DataFrame:
    """J3 on rows: for each named token expression a column ``<name>_id`` (0 when absent, NULL without a token)."""
    for name, token in tokens.items():
        rows = encode(rows.withColumn(name, token), vocab, token_col=name, out=f"{name}_id")
        rows = rows.withColumn(f"{name}_id", F.when(F.col(name).isNotNull(), F.col(f"{name}_id"))).drop(name)
    return rows


def with_decile(events: DataFrame, cuts: DataFrame) -> DataFrame:
    """The columns an event's tokens follow from, with ``_decile`` (NULL without a value or cuts)."""
    c = cuts.select(F.col("cid").alias("_cut_cid"), "cuts")
    ev = events.join(c, (F.col("cid") == F.col("_cut_cid")) & (F.col("et") == F.lit("measurement")), "left")
    decile = F.when(F.col("value_as_number").isNotNull() & F.col("cuts").isNotNull(),
                    decile_index("value_as_number", "cuts"))
    return ev.select("person_id", F.lit(1).alias("_kind"), *EVENT_ORDER, "et", "visit_type", decile.alias("_decile"))


def event_rows(events: DataFrame, vocab: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Rows of :func:`with_decile` with the ids that :func:`event_tokens` puts together."""
    return _with_codes(_with_ids(events, vocab, _row_tokens()), vocab, codes)


def static_rows(demo: DataFrame, vocab: DataFrame, as_of_year: int, age: Column | None = None) -> DataFrame:
    """One row per person with the age and the ids that :func:`static_tokens` puts together."""
    age_expr = age if age is not None else age_at(F.lit(as_of_year), F.col("birth_year"))
    static = demo.select(
        "person_id", F.lit(0).alias("_kind"), age_expr.alias("age"),
        "gender_concept_id", "race_concept_id", "birth_year",
    )
    return _with_ids(static, vocab, _person_tokens())


def timeline_tokens(
    events: DataFrame,
    demo: DataFrame,
    vocab: DataFrame,
    cuts: DataFrame,
    as_of_year: int = 2025,
    age: Column | None = None,
    require_events: bool = False,
    num_partitions: int | None = None,
    codes: DataFrame | None = None,
) -> DataFrame:
    """Long-form token table for every person of ``demo``.

    ``events`` are unified events (persons not in ``demo`` are dropped here);
    ``cuts`` is ``(cid, cuts)`` from :func:`stats.measurement_deciles`;
    ``age`` overrides the static age expression (default F4 with ``as_of_year``;
    it may refer to columns of ``demo``). ``require_events=True`` drops persons
    without events. ``codes`` is ``(et, cid, tokens)`` from :func:`codes.coded_concepts`: events
    of these concepts carry the tokens of their code in place of the concept token (O1). Rows tied on every order key produce identical tokens, so any order
    among them is fine.
    """
    static = static_rows(demo, vocab, as_of_year, age)
    ev = event_rows(with_decile(events, cuts), vocab, codes)
    fixed = fixed_ids(vocab)
    s = Slices(static.unionByName(ev, allowMissingColumns=True), ["person_id"], ROW_ORDER,
               num_partitions or slices_for(events), clustered=True)

    is_person = (F.col("_kind") == 0).cast("int")
    spans = s.spanning(F.count(F.lit(1)).alias("_rows"), F.max("ts").alias("_ts"), F.max(is_person).alias("_p"),
                       F.sum("_kind").alias("_e"))
    spans = cut_lineage(spans.select(
        "_slice", "person_id", F.coalesce(F.sum("_rows").over(s.earlier), F.lit(0)).alias("_rows_before"),
        F.lag("_ts").over(s.along).alias("_ts_before"), F.max("_p").over(s.all).alias("_any_person"),
        F.sum("_e").over(s.all).alias("_all_events"), F.lead("_slice").over(s.along).isNull().alias("_last_slice")))
    has_event = (lambda n: n > 0) if require_events else (lambda n: F.lit(True))

    def with_tokens(rows: DataFrame) -> DataFrame:
        rows = (rows.withColumn("_rn", F.row_number().over(s.window)).withColumn("_lag_ts", F.lag("ts").over(s.window))
                .withColumn("_end", F.lead("_kind").over(s.window).isNull())
                .withColumn("_has", F.max(is_person).over(s.whole)).withColumn("_n", F.sum("_kind").over(s.whole)))
        rows = s.join(rows, spans)
        rows = rows.where((F.coalesce("_any_person", "_has") == 1) & has_event(F.coalesce("_all_events", "_n")))
        prev = F.when(F.col("_rn") == 1, F.col("_ts_before")).otherwise(F.col("_lag_ts"))
        rows = with_gaps(rows, prev, fixed)
        rows = rows.withColumn("_own", F.when(F.col("_kind") == 0, static_tokens(fixed)).otherwise(event_tokens(fixed)))
        body = F.when(F.col("_kind") == 0, F.col("_own")).otherwise(F.concat("_gaps", "_own"))
        last, none = F.col("_end") & F.coalesce("_last_slice", F.lit(True)), F.array().cast("array<struct<token:string,id:int>>")
        return rows.select(
            "_slice", "person_id", *ROW_ORDER, "_rn", "_end",
            (F.col("_rn") - 1 + F.coalesce("_rows_before", F.lit(0))).cast("int").alias("ev_seq"),
            F.concat(body, F.when(last, F.array(known(fixed, K.EOS))).otherwise(none)).alias("_toks"))

    first = F.try_element_at("_toks", F.lit(1))["id"]
    hot = with_tokens(s.join(s.rows, spans.select("_slice", "person_id"), "left_semi"))
    ends = s.spanning(F.sum(F.size("_toks")).alias("_len"), F.max(F.when(F.col("_rn") == 1, first)).alias("_first"),
                      rows=hot)
    ends = cut_lineage(ends.select("_slice", "person_id",
                                   F.coalesce(F.sum("_len").over(s.earlier), F.lit(0)).alias("_off_before"),
                                   F.lead("_first").over(s.along).alias("_first_after")))

    rows = with_tokens(s.rows)
    rows = (rows.withColumn("_off_in", F.coalesce(F.sum(F.size("_toks")).over(s.before), F.lit(0)))
            .withColumn("_first_next", F.lead(first).over(s.window)))
    rows = (s.join(rows, ends).withColumn("_off", F.col("_off_in") + F.coalesce("_off_before", F.lit(0)))
            .withColumn("_next_first", F.when(F.col("_end"), F.col("_first_after")).otherwise(F.col("_first_next"))))
    long = rows.select("person_id", "ev_seq", "ts", "_off", F.posexplode(_with_next()).alias("_slot", "_p")).select(
        "person_id",
        (F.col("_off") + F.col("_slot")).cast("int").alias("pos"),
        F.col("_p._t.token").alias("token"),
        F.when(F.col("ev_seq") > 0, F.col("ts")).alias("ts"),
        "ev_seq",
        F.col("_p._t.id").alias("token_id"),
        F.col("_p.next_id").alias("next_token_id"),
    )
    return long


def _with_codes(events: DataFrame, vocab: DataFrame, codes: DataFrame | None) -> DataFrame:
    """``_code``: (token, id) pairs of the event's code, NULL without one. The ids are looked up once per concept."""
    if codes is None:
        return events.withColumn("_code", F.lit(None).cast("array<struct<token:string,id:int>>"))
    each = codes.select("et", "cid", F.posexplode("tokens").alias("_at", "token"))
    coded = encode(each, vocab).groupBy(F.col("et").alias("_et"), F.col("cid").alias("_cid")).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("_at", "token", "token_id"))), lambda x: _pair(x["token"], x["token_id"])).alias("_code"))
    return events.join(coded, (F.col("et") == F.col("_et")) & (F.col("cid") == F.col("_cid")), "left").drop("_et", "_cid")


def _with_next() -> Column:
    """W10 without a second pass: pair each slot with its successor -- the following
    slot of the same row, else the first token of the next row (``_next_first``);
    NULL after EOS. Built before the explode so no exploded row carries the array."""
    after = F.concat(F.slice(F.col("_toks.id"), F.lit(2), F.size("_toks")), F.array("_next_first"))
    return F.arrays_zip(F.col("_toks").alias("_t"), after.alias("next_id"))


def timeline_arrays(tokens: DataFrame) -> DataFrame:
    """A25 view: ``(person_id, tokens array<int>, n_tokens)`` ordered by position."""
    return tokens.groupBy("person_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "token_id"))), lambda s: s["token_id"]).alias("tokens"),
        F.count(F.lit(1)).cast("int").alias("n_tokens"),
    )


CHUNK_TOKENS = 4096


def timeline_chunks(tokens: DataFrame, chunk: int = CHUNK_TOKENS) -> DataFrame:
    """``(person_id, chunk, first_pos, n, tokens array<int>)``, at most ``chunk`` tokens a row.

    The group key holds the chunk, so a person of any length is many groups of bounded size. ``first_pos`` and ``n``
    are the position index: what lies where can be told without reading the arrays.
    """
    at = F.floor(F.col("pos") / chunk).cast("bigint")
    return tokens.groupBy("person_id", at.alias("chunk")).agg(
        F.min("pos").cast("bigint").alias("first_pos"), F.count(F.lit(1)).cast("int").alias("n"),
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "token_id"))), lambda s: s["token_id"]).alias("tokens"))


def chunk_tokens(chunks: DataFrame) -> DataFrame:
    """The long form ``(person_id, pos, token_id)`` of chunks."""
    return chunks.select("person_id", "first_pos", F.posexplode("tokens").alias("_at", "token_id")).select(
        "person_id", (F.col("first_pos") + F.col("_at")).cast("bigint").alias("pos"), "token_id")


def chunk_lengths(chunks: DataFrame) -> DataFrame:
    """``(person_id, n_tokens, n_chunks)`` from the position index alone."""
    return chunks.groupBy("person_id").agg(F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_chunks"))


def chunk_slices(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(person_id, start, tokens)`` for each row ``(person_id, start, length)`` of ``wanted``: only chunks that meet
    the slice send tokens, and only those of the slice, so the length wanted bounds what a group collects."""
    j = chunks.join(wanted, "person_id").where(
        (F.col("first_pos") < F.col("start") + F.col("length")) & (F.col("first_pos") + F.col("n") > F.col("start")))
    low = F.greatest(F.col("start") - F.col("first_pos"), F.lit(0)).cast("int")
    high = F.least(F.col("start") + F.col("length") - F.col("first_pos"), F.col("n").cast("bigint")).cast("int")
    part = j.select("person_id", "start", "length", "first_pos", F.slice("tokens", low + 1, high - low).alias("t"))
    parts = F.sort_array(F.collect_list(F.struct("first_pos", "t")))
    return part.groupBy("person_id", "start", "length").agg(
        F.flatten(F.transform(parts, lambda x: x["t"])).alias("tokens")).drop("length")
