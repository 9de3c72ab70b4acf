"""DuckDB oracle SQL for the registered queries.

Each query's SQL is a ``WITH`` block of the common table expressions it uses
(collected by name from the library below) followed by its final SELECT. The
CTEs restate the bridges and the tokenizer rules directly in SQL, written
independently of the DataFrame code, so the driver can compare both engines.

DuckDB notes: lambdas use ``lambda x: ...``; ascending ORDER BY puts NULLs
last, so window orders that meet NULLs say ``NULLS FIRST`` to match Spark.
"""

from __future__ import annotations

import re

from .. import constants as K

CLINICAL_PREFIX_CASE = (
    "CASE et "
    + " ".join(f"WHEN '{et}' THEN '{p}'" for et, p in K.CONCEPT_PREFIX.items())
    + " END"
)
CLINICAL_LIST = ", ".join(f"'{et}'" for et in K.CLINICAL_TYPES)
FIXED_VALUES = ", ".join(f"('{t}', {i})" for i, t in enumerate(K.fixed_vocab_tokens()))
N_FIXED = len(K.fixed_vocab_tokens())


def _gap_case(m: str) -> str:
    singles = " ".join(
        f"WHEN {m} >= {th} THEN ['TIME_{lab}']" for lab, th in reversed(K.TIME_INTERVALS)
    )
    return (
        f"CASE WHEN {m} IS NULL OR {m} < {K.MIN_GAP_MINUTES} THEN []::VARCHAR[] "
        f"WHEN {m} > {K.ONE_YEAR_MINUTES} THEN list_transform(range(greatest(2, CAST(round_even({m} / {K.SIX_MONTHS_MINUTES}.0, 0) AS BIGINT))), lambda x: 'TIME_6m') "
        f"{singles} ELSE []::VARCHAR[] END"
    )


def _age_band(a: str) -> str:
    return (
        f"CASE WHEN {a} >= 0 AND {a} < 100 THEN "
        f"CAST(CAST(floor({a} / 5.0) * 5 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(floor({a} / 5.0) * 5 + 5 AS BIGINT) AS VARCHAR) "
        f"ELSE '100-120' END"
    )


def _year_band(y: str) -> str:
    return (
        f"CASE WHEN {y} IS NULL THEN 'None' ELSE "
        f"CAST(CAST(1970 + floor(({y} - 1970) / 5.0) * 5 AS BIGINT) AS VARCHAR) || '-' || "
        f"CAST(CAST(1970 + floor(({y} - 1970) / 5.0) * 5 + 5 AS BIGINT) AS VARCHAR) END"
    )


def _decile(v: str, cuts: str) -> str:
    n = f"len(list_filter({cuts}, lambda c: c < {v}))"
    return f"CASE WHEN {n} >= 10 THEN 0 ELSE {n} END"


PERSON = """
person_t AS (
  SELECT CAST(c_custkey AS BIGINT) AS person_id,
         CAST(CASE WHEN c_custkey % 2 = 0 THEN 8507 ELSE 8532 END AS BIGINT) AS gender_concept_id,
         CAST(8000 + c_nationkey AS BIGINT) AS race_concept_id,
         CAST(38003563 AS BIGINT) AS ethnicity_concept_id,
         CASE WHEN c_custkey % 50 = 48 THEN NULL
              ELSE CAST(make_date(CAST(1930 + (c_custkey * 7) % 90 AS INTEGER), CAST(1 + c_custkey % 12 AS INTEGER), 1) AS TIMESTAMP) END AS birth_datetime
  FROM customer WHERE c_custkey % 10 <> 9
)"""

DEMO = """
demo AS (
  SELECT person_id, gender_concept_id, race_concept_id, ethnicity_concept_id, birth_datetime,
         CAST(year(birth_datetime) AS INTEGER) AS birth_year
  FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY birth_datetime DESC NULLS LAST,
          gender_concept_id DESC NULLS LAST, race_concept_id DESC NULLS LAST, ethnicity_concept_id DESC NULLS LAST) AS rn
        FROM person_t) WHERE rn = 1
)"""

_EV_COLS = "person_id, ts, et, cid, value_as_number, unit_concept_id, visit_type, table_rank, ev_id"

B1_EVENTS = f"""
b1_src AS (
  SELECT event_id, ts, CAST(user_id AS BIGINT) AS person_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events
),
ev_raw AS (
  SELECT person_id, CAST(ts AS TIMESTAMP) AS ts, 'condition' AS et,
         CASE WHEN k IS NULL OR k = 0 THEN CAST(1000 + event_id % 7 AS BIGINT) ELSE k END AS cid,
         CAST(NULL AS DOUBLE) AS value_as_number, CAST(NULL AS BIGINT) AS unit_concept_id,
         CAST(NULL AS BIGINT) AS visit_type, 2 AS table_rank, CAST(event_id AS BIGINT) AS ev_id
  FROM b1_src WHERE event_type = 'error'
  UNION ALL
  SELECT person_id, ts, 'medication', k, NULL, NULL, NULL, 3, event_id FROM b1_src WHERE event_type = 'purchase'
  UNION ALL
  SELECT person_id, ts, 'procedure', k, NULL, NULL, NULL, 4, event_id FROM b1_src WHERE event_type = 'view'
  UNION ALL
  SELECT person_id, ts, 'measurement', CASE WHEN m IS NULL OR m = 0 THEN 900 ELSE m END, CAST(value AS DOUBLE),
         CASE WHEN k % 5 = 0 THEN NULL ELSE k % 5 END, NULL, 5, event_id
  FROM (SELECT *, CASE WHEN k < 50 THEN k ELSE 2 * k + event_id % 2 END AS m FROM b1_src WHERE event_type = 'click')
  UNION ALL
  SELECT person_id, ts, 'observation', CASE WHEN k IS NULL OR k = 0 THEN NULL ELSE k END, NULL, NULL, NULL, 6, event_id
  FROM b1_src WHERE event_type = 'signup'
),
ev_all AS (SELECT {_EV_COLS} FROM ev_raw WHERE ts IS NOT NULL AND cid IS NOT NULL AND cid > 0)"""

B2_EVENTS = f"""
li_o AS (SELECT l.*, o.o_custkey FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
ev_clin AS (
  SELECT CAST(o_custkey AS BIGINT) AS person_id, CAST(l_shipdate AS TIMESTAMP) AS ts,
         CASE WHEN l_returnflag = 'R' THEN 'condition' WHEN l_returnflag = 'A' THEN 'medication'
              WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'procedure' ELSE 'measurement' END AS et,
         CAST(CASE WHEN l_returnflag = 'N' AND l_linestatus <> 'O' THEN 1 + l_suppkey % 50 ELSE l_partkey END AS BIGINT) AS cid,
         CASE WHEN l_returnflag = 'N' AND l_linestatus <> 'O' THEN CAST(l_extendedprice AS DOUBLE) END AS value_as_number,
         CASE WHEN l_returnflag = 'N' AND l_linestatus <> 'O' THEN CAST(l_linenumber AS BIGINT) END AS unit_concept_id,
         CAST(NULL AS BIGINT) AS visit_type,
         CASE WHEN l_returnflag = 'R' THEN 2 WHEN l_returnflag = 'A' THEN 3
              WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 4 ELSE 5 END AS table_rank,
         CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS ev_id
  FROM li_o WHERE l_returnflag IN ('R', 'A') OR (l_returnflag = 'N' AND l_linestatus IS NOT NULL)
),
ev_all AS (
  SELECT CAST(o_custkey AS BIGINT) AS person_id, CAST(o_orderdate AS TIMESTAMP) AS ts, 'admission' AS et,
         CAST(NULL AS BIGINT) AS cid, CAST(NULL AS DOUBLE) AS value_as_number, CAST(NULL AS BIGINT) AS unit_concept_id,
         CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS visit_type, 0 AS table_rank, CAST(o_orderkey AS BIGINT) AS ev_id
  FROM orders WHERE o_orderdate IS NOT NULL
  UNION ALL
  SELECT CAST(o.o_custkey AS BIGINT), CAST(e.end_ts AS TIMESTAMP), 'discharge', NULL, NULL, NULL, NULL, 1, CAST(o.o_orderkey AS BIGINT)
  FROM orders o JOIN (SELECT l_orderkey, max(l_shipdate) AS end_ts FROM lineitem GROUP BY l_orderkey) e
    ON o.o_orderkey = e.l_orderkey WHERE e.end_ts IS NOT NULL
  UNION ALL
  SELECT {_EV_COLS} FROM ev_clin WHERE ts IS NOT NULL AND cid IS NOT NULL AND cid > 0
  UNION ALL
  SELECT * FROM (
    SELECT CAST(o_custkey AS BIGINT) AS person_id, CAST(o_orderdate AS TIMESTAMP) AS ts, 'observation' AS et,
           CAST(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 WHEN 'P' THEN 3 END AS BIGINT) AS cid,
           CAST(NULL AS DOUBLE) AS value_as_number, CAST(NULL AS BIGINT) AS unit_concept_id,
           CAST(NULL AS BIGINT) AS visit_type, 6 AS table_rank, CAST(o_orderkey AS BIGINT) AS ev_id
    FROM orders) WHERE ts IS NOT NULL AND cid IS NOT NULL AND cid > 0
  UNION ALL
  SELECT CAST(c_custkey AS BIGINT), TIMESTAMP '2001-12-31 00:00:00', 'death', NULL, NULL, NULL, NULL, 7, CAST(NULL AS BIGINT)
  FROM customer WHERE c_acctbal < 0
)"""

COMMON = f"""
ev_known AS (SELECT * FROM ev_all WHERE person_id IN (SELECT person_id FROM demo)),
concept_counts AS (
  SELECT et, cid, count(*) AS n, {CLINICAL_PREFIX_CASE} || CAST(cid AS VARCHAR) AS token
  FROM ev_known WHERE et IN ({CLINICAL_LIST}) GROUP BY et, cid
),
cut_vals AS (
  SELECT cid, value_as_number AS v, row_number() OVER (PARTITION BY cid ORDER BY value_as_number) - 1 AS rk,
         count(*) OVER (PARTITION BY cid) AS n
  FROM ev_known WHERE et = 'measurement' AND value_as_number IS NOT NULL
),
cuts AS (
  SELECT cid, n, list(q ORDER BY j) AS cuts FROM (
    SELECT h.cid, h.n, h.j, a.v + (h.h - floor(h.h)) * (b.v - a.v) AS q
    FROM (SELECT cid, n, j, (j::DOUBLE / 10.0::DOUBLE) * (n - 1)::DOUBLE AS h
          FROM (SELECT DISTINCT cid, n FROM cut_vals WHERE n >= {K.MIN_VALUES_FOR_QUANTILES}), range(0, {K.N_QUANTILES}) r(j)) h
    JOIN cut_vals a ON a.cid = h.cid AND a.rk = floor(h.h)::BIGINT
    JOIN cut_vals b ON b.cid = h.cid AND b.rk = least(floor(h.h)::BIGINT + 1, h.n - 1))
  GROUP BY cid, n
),
cat_values AS (
  SELECT DISTINCT category, value FROM (
    SELECT 'GENDER' AS category, CAST(gender_concept_id AS VARCHAR) AS value FROM demo WHERE gender_concept_id IS NOT NULL
    UNION ALL SELECT 'RACE', CAST(race_concept_id AS VARCHAR) FROM demo WHERE race_concept_id IS NOT NULL
    UNION ALL SELECT 'YEAR', {_year_band('birth_year')} FROM demo WHERE birth_year IS NOT NULL
    UNION ALL SELECT 'UNIT', CAST(unit_concept_id AS VARCHAR) FROM ev_known WHERE et = 'measurement' AND unit_concept_id IS NOT NULL
    UNION ALL SELECT 'VISIT_TYPE', coalesce(CAST(visit_type AS VARCHAR), 'None') FROM ev_known WHERE et = 'admission'
  )
),
cat_tokens AS (
  SELECT DISTINCT category || '_' || value AS token,
         CASE category WHEN 'GENDER' THEN 0 WHEN 'RACE' THEN 1 WHEN 'YEAR' THEN 2 WHEN 'VISIT_TYPE' THEN 3 ELSE 4 END AS grp
  FROM cat_values
),
fixed_tokens AS (SELECT * FROM (VALUES {FIXED_VALUES}) t(token, token_id)),
vocab_cap AS (SELECT {K.VOCAB_SIZE} - {N_FIXED} - (SELECT count(*) FROM cat_tokens) AS cap),
vocab AS (
  SELECT token, CAST(token_id AS INTEGER) AS token_id, CAST(NULL AS BIGINT) AS n FROM fixed_tokens
  UNION ALL
  SELECT token, CAST({N_FIXED} - 1 + row_number() OVER (ORDER BY grp, token) AS INTEGER), CAST(NULL AS BIGINT) FROM cat_tokens
  UNION ALL
  SELECT token, CAST({N_FIXED} - 1 + (SELECT count(*) FROM cat_tokens) + rn AS INTEGER), n FROM (
    SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS rn
    FROM (SELECT token, sum(n) AS n FROM concept_counts GROUP BY token)
  ) WHERE rn <= (SELECT cap FROM vocab_cap)
),
tok_rows AS (
  SELECT person_id, 0 AS kind, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS INTEGER) AS table_rank,
         CAST(NULL AS BIGINT) AS ev_id, CAST(NULL AS BIGINT) AS cid, CAST(NULL AS DOUBLE) AS value_as_number,
         CAST(NULL AS BIGINT) AS unit_concept_id, CAST(NULL AS VARCHAR) AS et, CAST(NULL AS BIGINT) AS visit_type,
         CAST(NULL AS DOUBLE[]) AS cuts,
         ['AGE_' || {_age_band("({age_expr})")},
          'GENDER_' || coalesce(CAST(gender_concept_id AS VARCHAR), 'None'),
          'RACE_' || coalesce(CAST(race_concept_id AS VARCHAR), 'None'),
          'YEAR_' || {_year_band('birth_year')}] AS static_toks
  FROM {{tok_demo}}
  UNION ALL
  SELECT e.person_id, 1, e.ts, e.table_rank, e.ev_id, e.cid, e.value_as_number, e.unit_concept_id, e.et, e.visit_type,
         c.cuts, CAST(NULL AS VARCHAR[])
  FROM {{tok_events}} e LEFT JOIN cuts c ON e.cid = c.cid AND e.et = 'measurement'
  WHERE e.person_id IN (SELECT person_id FROM {{tok_demo}})
),
tok_w AS (
  SELECT *, lag(ts) OVER w AS prev_ts, (lead(kind) OVER w) IS NULL AS is_last,
         CAST(row_number() OVER w - 1 AS INTEGER) AS ev_seq
  FROM tok_rows
  WINDOW w AS (PARTITION BY person_id ORDER BY kind, ts NULLS FIRST, table_rank NULLS FIRST, ev_id NULLS FIRST,
               cid NULLS FIRST, value_as_number NULLS FIRST, unit_concept_id NULLS FIRST)
),
tok_arr AS (
  SELECT *, CASE WHEN is_last THEN list_append(body, '<EOS>') ELSE body END AS toks FROM (
    SELECT *, CASE WHEN kind = 0 THEN static_toks ELSE list_concat(
      {_gap_case("((epoch_us(ts) - epoch_us(prev_ts)) / 60000000.0)")},
      CASE WHEN et = 'admission' THEN ['EVENT_ADMISSION', 'VISIT_TYPE_' || coalesce(CAST(visit_type AS VARCHAR), 'None')]
           WHEN et = 'measurement' THEN list_filter(['EVENT_MEASUREMENT', 'MEASUREMENT_' || CAST(cid AS VARCHAR),
                CASE WHEN value_as_number IS NOT NULL AND cuts IS NOT NULL THEN 'Q' || CAST({_decile('value_as_number', 'cuts')} AS VARCHAR) END,
                'UNIT_' || coalesce(CAST(unit_concept_id AS VARCHAR), 'None')], lambda x: x IS NOT NULL)
           WHEN et IN ({CLINICAL_LIST}) THEN ['EVENT_' || upper(et), {CLINICAL_PREFIX_CASE} || CAST(cid AS VARCHAR)]
           ELSE ['EVENT_' || upper(et)] END) END AS body
    FROM tok_w)
),
tok_off AS (
  SELECT *, coalesce(sum(len(toks)) OVER (PARTITION BY person_id ORDER BY kind, ts NULLS FIRST, table_rank NULLS FIRST,
           ev_id NULLS FIRST, cid NULLS FIRST, value_as_number NULLS FIRST, unit_concept_id NULLS FIRST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM tok_arr
),
tok_long AS (
  SELECT person_id, ev_seq, CASE WHEN ev_seq > 0 THEN ts END AS ts, CAST(off + i - 1 AS INTEGER) AS pos, toks[i] AS token
  FROM (SELECT *, unnest(range(1, len(toks) + 1)) AS i FROM tok_off)
),
tokens AS (
  SELECT t.person_id, t.pos, t.token, CAST(coalesce(v.token_id, 0) AS INTEGER) AS token_id, t.ts, t.ev_seq
  FROM tok_long t LEFT JOIN vocab v ON t.token = v.token
)"""

BRIDGE_CTES = {
    "clickstream": PERSON + "," + DEMO + "," + B1_EVENTS + "," + COMMON,
    "orders": PERSON + "," + DEMO + "," + B2_EVENTS + "," + COMMON,
}

_CTE_HEAD = re.compile(r"^([a-z_][a-z0-9_]*) AS \(", re.M)


def _split_ctes(text: str) -> list[tuple[str, str]]:
    """Split a CTE list into (name, body) pairs by the ``name AS (`` heads."""
    heads = list(_CTE_HEAD.finditer(text))
    out = []
    for i, m in enumerate(heads):
        end = heads[i + 1].start() if i + 1 < len(heads) else len(text)
        body = text[m.start():end].strip().rstrip(",").strip()
        out.append((m.group(1), body))
    return out


DEFAULT_AGE_SQL = "CASE WHEN birth_year IS NULL THEN 50 ELSE {as_of_year} - birth_year END"


def assemble(bridge: str, final: str, extra: str = "", as_of_year: int = 2025,
             tok_events: str = "ev_all", tok_demo: str = "demo", age_expr: str = DEFAULT_AGE_SQL) -> str:
    """``WITH`` the CTEs ``final`` needs (transitively), in definition order.

    ``tok_events`` / ``tok_demo`` / ``age_expr`` choose the events, persons and
    static age of the ``tokens`` CTE (the vocabulary always uses every event).
    """
    text = BRIDGE_CTES[bridge] + ("," + extra if extra else "")
    text = (text.replace("{age_expr}", age_expr).replace("{as_of_year}", str(as_of_year))
            .replace("{tok_events}", tok_events).replace("{tok_demo}", tok_demo))
    ctes = _split_ctes(text)
    names = [n for n, _ in ctes]
    bodies = dict(ctes)
    deps = {n: [m for m in names if m != n and re.search(rf"\b{m}\b", bodies[n].split(" AS (", 1)[1])]
            for n in names}
    order: list[str] = []
    seen: set[str] = set()

    def visit(n: str) -> None:
        if n in seen:
            return
        seen.add(n)
        for m in deps[n]:
            visit(m)
        order.append(n)

    for n in names:
        if re.search(rf"\b{n}\b", final):
            visit(n)
    if not order:
        return final.strip()
    return "WITH " + ",\n".join(bodies[n] for n in order) + "\n" + final.strip()


def _lookup_case(mapping: dict, key: str, quote: bool = True) -> str:
    q = (lambda k: f"'{k}'") if quote else str
    return "CASE " + " ".join(f"WHEN {key} = {q(k)} THEN '{v}'" for k, v in mapping.items()) + " END"


def label_case_sql(t: str) -> str:
    """F11 fallback label of token column ``t``."""
    def rest(p: str) -> str:
        return f"substr({t}, {len(p) + 1})"

    ev = f"lower({rest('EVENT_')})"
    qn = f"substr({t}, 2)"
    specials = ", ".join(f"'{s}'" for s in K.SPECIAL_TOKENS)
    return (
        f"CASE WHEN {t} IN ({specials}) THEN {t} "
        f"WHEN starts_with({t}, 'EVENT_') THEN coalesce({_lookup_case(K.LABEL_EVENT, ev)}, "
        f"'Medical Event: ' || upper(substr({ev}, 1, 1)) || substr({ev}, 2)) "
        f"WHEN starts_with({t}, 'AGE_') THEN coalesce({_lookup_case(K.LABEL_AGE, rest('AGE_'))}, 'Age interval: ' || {rest('AGE_')} || ' years') "
        f"WHEN starts_with({t}, 'TIME_') THEN coalesce({_lookup_case(K.LABEL_TIME, rest('TIME_'))}, 'Time gap: ' || {rest('TIME_')} || ' intervals') "
        f"WHEN starts_with({t}, 'GENDER_') THEN 'Gender: ' || coalesce({_lookup_case(K.LABEL_GENDER, rest('GENDER_'))}, {rest('GENDER_')}) "
        f"WHEN starts_with({t}, 'RACE_') THEN 'Race: ' || coalesce({_lookup_case(K.LABEL_RACE, rest('RACE_'))}, {rest('RACE_')}) "
        f"WHEN starts_with({t}, 'YEAR_') THEN coalesce({_lookup_case(K.LABEL_YEAR, rest('YEAR_'))}, 'Birth year interval: ' || {rest('YEAR_')}) "
        f"WHEN starts_with({t}, 'VISIT_TYPE_') THEN 'Visit type: ' || coalesce({_lookup_case(K.LABEL_VISIT, rest('VISIT_TYPE_'))}, {rest('VISIT_TYPE_')}) "
        f"WHEN starts_with({t}, 'UNIT_') THEN 'Unit: ' || coalesce({_lookup_case(K.LABEL_UNIT, rest('UNIT_'))}, 'Unit ID ' || {rest('UNIT_')}) "
        f"WHEN starts_with({t}, 'Q') AND regexp_full_match({qn}, '[0-9]+') THEN coalesce("
        f"{_lookup_case(K.LABEL_QUANTILE, f'CAST({qn} AS INTEGER)', quote=False)}, "
        f"'Quantile: ' || CAST(CAST({qn} AS INTEGER) AS VARCHAR) || 'th percentile') "
        f"ELSE 'Token: ' || {t} END"
    )
