"""Bridges from the driver's test tables to OMOP-shaped tables.

The reference ships no data; these two bridges stand in for an OMOP
directory (see FIXTURES.md part B). Each returns a dict ``table name ->
DataFrame`` with real OMOP column names so the schema-adaptive scan in
:mod:`chronotok.sources.omop` runs on them unchanged.

* ``clickstream`` (B1) maps the ``events`` table onto the five clinical tables.
* ``orders`` (B2) maps ``orders``/``lineitem``/``customer`` onto visits, the
  five clinical tables and deaths.

``concept`` / ``concept_relationship`` come from ``part``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed bridge parameters (FIXTURES.md part B).
GENDER_EVEN, GENDER_ODD = 8507, 8532
RACE_BASE = 8000
ETHNICITY = 38003563
DEATH_DATE = "2001-12-31 00:00:00"
ORDER_STATUS_CONCEPT = {"O": 1, "F": 2, "P": 3}
CLICK_SOURCE_CONCEPT = 900
CONDITION_SOURCE_BASE = 1000

# Current/future cut and horizon per bridge.
CUTS = {
    "clickstream": ("2024-01-16 00:00:00", 7),
    "orders": ("2000-01-01 00:00:00", 365),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ntz(s: str):
    return F.to_timestamp_ntz(F.lit(s))


def bridge_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    birth = F.make_date(
        (F.lit(1930) + (key * 7) % 90).cast("int"),
        (F.lit(1) + key % 12).cast("int"),
        F.lit(1),
    ).cast("timestamp_ntz")
    return c.where(key % 10 != 9).select(
        key.cast("bigint").alias("person_id"),
        F.when(key % 2 == 0, F.lit(GENDER_EVEN)).otherwise(F.lit(GENDER_ODD)).cast("bigint").alias("gender_concept_id"),
        (F.lit(RACE_BASE) + F.col("c_nationkey")).cast("bigint").alias("race_concept_id"),
        F.lit(ETHNICITY).cast("bigint").alias("ethnicity_concept_id"),
        F.when(key % 50 == 48, F.lit(None).cast("timestamp_ntz")).otherwise(birth).alias("birth_datetime"),
    )


def clickstream(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """B1: the ``events`` table as five clinical OMOP tables."""
    ev = read_table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    k = F.col("k")
    pid = F.col("user_id").cast("bigint").alias("person_id")
    eid = F.col("event_id")

    def part(event_type: str) -> DataFrame:
        return ev.where(F.col("event_type") == event_type)

    tables = {
        "person": bridge_person(spark, sf_dir),
        "condition_occurrence": part("error").select(
            eid.alias("condition_occurrence_id"), pid,
            F.col("ts").alias("condition_start_datetime"),
            k.alias("condition_concept_id"),
            (F.lit(CONDITION_SOURCE_BASE) + eid % 7).cast("bigint").alias("condition_source_concept_id"),
        ),
        "drug_exposure": part("purchase").select(
            eid.alias("drug_exposure_id"), pid,
            F.col("ts").alias("drug_exposure_start_datetime"),
            k.alias("drug_concept_id"),
        ),
        "procedure_occurrence": part("view").select(
            eid.alias("procedure_occurrence_id"), pid,
            F.col("ts").alias("procedure_datetime"),
            k.alias("procedure_concept_id"),
        ),
        "measurement": part("click").select(
            eid.alias("measurement_id"), pid,
            F.col("ts").alias("measurement_datetime"),
            F.when(k < 50, k).otherwise(k * 2 + eid % 2).cast("bigint").alias("measurement_concept_id"),
            F.lit(CLICK_SOURCE_CONCEPT).cast("bigint").alias("measurement_source_concept_id"),
            F.col("value").cast("double").alias("value_as_number"),
            F.when(k % 5 == 0, F.lit(None)).otherwise(k % 5).cast("bigint").alias("unit_concept_id"),
        ),
        "observation": part("signup").select(
            eid.alias("observation_id"), pid,
            F.col("ts").alias("observation_datetime"),
            k.alias("observation_concept_id"),
            F.lit(None).cast("bigint").alias("observation_source_concept_id"),
        ),
    }
    return tables


def orders(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """B2: orders as visits, lineitems as clinical events, negative balances as deaths."""
    o = read_table(spark, sf_dir, "orders")
    li = read_table(spark, sf_dir, "lineitem")
    cust = read_table(spark, sf_dir, "customer")

    # Every lineitem-derived table is a filter over this join; each reads lineitem once.
    li_o = li.join(
        o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey")), "l_orderkey"
    )
    line_id = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint")
    pid = F.col("o_custkey").cast("bigint").alias("person_id")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")

    visit_end = li.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("visit_end_datetime"))
    visits = o.join(visit_end, o.o_orderkey == visit_end.l_orderkey, "left").select(
        F.col("o_orderkey").cast("bigint").alias("visit_occurrence_id"),
        F.col("o_custkey").cast("bigint").alias("person_id"),
        F.col("o_orderdate").alias("visit_start_datetime"),
        F.col("visit_end_datetime"),
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("visit_type_concept_id"),
    )

    def lines(cond, prefix: str, ts_name: str, id_name: str) -> DataFrame:
        return li_o.where(cond).select(
            line_id.alias(id_name), pid,
            F.col("l_shipdate").alias(ts_name),
            F.col("l_partkey").cast("bigint").alias(f"{prefix}_concept_id"),
        )

    status_cid = F.col("o_orderstatus")
    obs_cid = F.when(status_cid == "O", 1).when(status_cid == "F", 2).when(status_cid == "P", 3)

    return {
        "person": bridge_person(spark, sf_dir),
        "visit_occurrence": visits,
        "condition_occurrence": lines(flag == "R", "condition", "condition_start_datetime", "condition_occurrence_id"),
        "drug_exposure": lines(flag == "A", "drug", "drug_exposure_start_datetime", "drug_exposure_id"),
        "procedure_occurrence": lines((flag == "N") & (status == "O"), "procedure", "procedure_datetime", "procedure_occurrence_id"),
        "measurement": li_o.where((flag == "N") & (status != "O")).select(
            line_id.alias("measurement_id"), pid,
            F.col("l_shipdate").alias("measurement_datetime"),
            (F.lit(1) + F.col("l_suppkey") % 50).cast("bigint").alias("measurement_concept_id"),
            F.col("l_extendedprice").cast("double").alias("value_as_number"),
            F.col("l_linenumber").cast("bigint").alias("unit_concept_id"),
        ),
        "observation": o.select(
            F.col("o_orderkey").cast("bigint").alias("observation_id"),
            F.col("o_custkey").cast("bigint").alias("person_id"),
            F.col("o_orderdate").alias("observation_datetime"),
            obs_cid.cast("bigint").alias("observation_concept_id"),
        ),
        "death": cust.where(F.col("c_acctbal") < 0).select(
            F.col("c_custkey").cast("bigint").alias("person_id"),
            _ntz(DEATH_DATE).alias("death_datetime"),
        ),
    }


def concept_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``concept`` and ``concept_relationship`` from ``part``."""
    p = read_table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("bigint")
    concept = p.select(
        key.alias("concept_id"),
        F.col("p_name").alias("concept_name"),
        F.col("p_type").alias("domain_id"),
        F.col("p_brand").alias("vocabulary_id"),
        key.cast("string").alias("concept_code"),
        F.col("p_size").cast("string").alias("concept_class_id"),
        F.when(key % 10 == 0, F.lit("S")).alias("standard_concept"),
    )
    base = key - key % 10
    maps_to = p.where((key % 10 >= 1) & (key % 10 <= 8)).select(
        key.alias("concept_id_1"), base.alias("concept_id_2"), F.lit("Maps to").alias("relationship_id")
    )
    second = p.where(key % 10 == 5).select(
        key.alias("concept_id_1"), (base + 10).alias("concept_id_2"), F.lit("Maps to").alias("relationship_id")
    )
    is_a = p.where(key % 10 == 9).select(
        key.alias("concept_id_1"), base.alias("concept_id_2"), F.lit("Is a").alias("relationship_id")
    )
    return concept, maps_to.unionByName(second).unionByName(is_a)


CODE_LETTERS = "ABCDEFGHJKLMNPQRSTUVWXYZ0123456789"  # procedure codes have no I and O


def code_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the ``orders`` bridge's concepts, ``(et, cid, system, code)``, from ``part``: drugs have ATC codes of
    3, 4, 5 or 7 characters, conditions ICD-10-CM codes of 3 to 7 with a dot, procedures ICD-10-PCS codes. Every
    eleventh part has none."""
    k = F.col("p_partkey").cast("bigint")
    at = lambda letters, i: F.substring(F.lit(letters), (F.pmod(i, F.lit(len(letters))) + 1).cast("int"), F.lit(1))
    two = lambda i: F.lpad(F.pmod(i, F.lit(100)).cast("string"), 2, "0")
    atc = F.concat(at("ABCDGHJLMNPRSV", k), two(F.floor(k / 14)), at("ABCDEFGHIJ", F.floor(k / 50)), at("ABCDEFG", k), two(k))
    cm = F.concat(at("ABCDEFGHJKLMNOPQRSTZ", F.floor(k / 3)), two(F.floor(k / 7)), F.lit("."), two(k), two(F.floor(k / 100)))
    pcs = F.concat(*[at(CODE_LETTERS, F.floor(k / (j + 1)) + 5 * j) for j in range(7)])
    cut = lambda c, lengths: F.substring(c, F.lit(1), F.element_at(
        F.array(*[F.lit(n) for n in lengths]), (F.pmod(k, F.lit(len(lengths))) + 1).cast("int")))
    each = [("medication", "ATC", cut(atc, (7, 7, 5, 4, 3))), ("condition", "ICD10CM", cut(cm, (3, 5, 6, 7, 8))),
            ("procedure", "ICD10PCS", pcs)]
    rows = F.array(*[F.struct(F.lit(et).alias("et"), k.alias("cid"), F.lit(s).alias("system"), c.alias("code"))
                     for et, s, c in each])
    return read_table(spark, sf_dir, "part").where(k % 11 != 0).select(F.explode(rows).alias("r")).select("r.*")


BRIDGES = {"clickstream": clickstream, "orders": orders}


def load_bridge(spark: SparkSession, sf_dir: str, name: str) -> dict[str, DataFrame]:
    return BRIDGES[name](spark, sf_dir)
