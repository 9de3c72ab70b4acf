"""Schema-adaptive scans of OMOP tables into the unified event schema.

Column availability is decided at plan time from ``df.columns``: a column is
used only if it exists, the ``*_datetime`` column falls back to the table's
``*_date`` column (whole column, not per row), and missing columns become
typed NULLs. All projections and filters are plain Catalyst expressions, so
column pruning and the ``ts IS NOT NULL`` filter reach the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import TABLE_RANK
from .parts import PartReport, part_files, read_parts, widened  # noqa: F401 - part of this module's interface

# Unified event schema: name -> Spark type.
EVENT_SCHEMA = [
    ("person_id", "bigint"),
    ("ts", "timestamp_ntz"),
    ("et", "string"),
    ("cid", "bigint"),
    ("value_as_number", "double"),
    ("unit_concept_id", "bigint"),
    ("visit_type", "bigint"),
    ("cond_status", "bigint"),
    ("drug_route", "bigint"),
    ("value_as_concept_id", "bigint"),
    ("obs_type", "bigint"),
    ("proc_type", "bigint"),
    ("table_rank", "int"),
    ("ev_id", "bigint"),
]
EVENT_COLUMNS = [n for n, _ in EVENT_SCHEMA]
EXTRA_COLUMNS = ["cond_status", "drug_route", "value_as_concept_id", "obs_type", "proc_type"]

PERSON_COLUMNS = [
    ("person_id", "bigint"),
    ("gender_concept_id", "bigint"),
    ("race_concept_id", "bigint"),
    ("ethnicity_concept_id", "bigint"),
    ("birth_datetime", "timestamp_ntz"),
    ("death_datetime", "timestamp_ntz"),
]


@dataclass(frozen=True)
class ClinicalTable:
    table: str
    et: str
    ts: str
    date: str
    cid: str
    source: str
    id_col: str
    value: str | None = None
    unit: str | None = None
    extras: dict = field(default_factory=dict)


CLINICAL_TABLES = [
    ClinicalTable("condition_occurrence", "condition", "condition_start_datetime", "condition_start_date",
                  "condition_concept_id", "condition_source_concept_id", "condition_occurrence_id",
                  extras={"condition_status_concept_id": "cond_status"}),
    ClinicalTable("drug_exposure", "medication", "drug_exposure_start_datetime", "drug_exposure_start_date",
                  "drug_concept_id", "drug_source_concept_id", "drug_exposure_id",
                  extras={"route_concept_id": "drug_route"}),
    ClinicalTable("procedure_occurrence", "procedure", "procedure_datetime", "procedure_date",
                  "procedure_concept_id", "procedure_source_concept_id", "procedure_occurrence_id",
                  extras={"procedure_type_concept_id": "proc_type"}),
    ClinicalTable("measurement", "measurement", "measurement_datetime", "measurement_date",
                  "measurement_concept_id", "measurement_source_concept_id", "measurement_id",
                  value="value_as_number", unit="unit_concept_id",
                  extras={"value_as_concept_id": "value_as_concept_id"}),
    ClinicalTable("observation", "observation", "observation_datetime", "observation_date",
                  "observation_concept_id", "observation_source_concept_id", "observation_id",
                  extras={"observation_type_concept_id": "obs_type", "value_as_concept_id": "value_as_concept_id"}),
]
CLINICAL_BY_NAME = {t.table: t for t in CLINICAL_TABLES}

OMOP_TABLES = ["person", "visit_occurrence", *[t.table for t in CLINICAL_TABLES], "death"]


def _opt(df: DataFrame, name: str | None, typ: str) -> Column:
    """The column if present, else a typed NULL; text that is no such value is NULL."""
    if name and name in df.columns:
        return _as(df, name, typ)
    return F.lit(None).cast(typ)


def _as(df: DataFrame, name: str, typ: str) -> Column:
    return F.col(name).try_cast(typ) if dict(df.dtypes)[name] == "string" else F.col(name).cast(typ)


def _ts_source(df: DataFrame, ts: str, date: str | None) -> Column:
    """Column-level choice: the datetime column if it exists, else the date column."""
    if ts in df.columns:
        return _as(df, ts, "timestamp_ntz")
    if date and date in df.columns:
        return _as(df, date, "timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


def _unified(cols: dict[str, Column]) -> list[Column]:
    out = []
    for name, typ in EVENT_SCHEMA:
        c = cols.get(name)
        out.append((c if c is not None else F.lit(None)).cast(typ).alias(name))
    return out


def scan_clinical(df: DataFrame, spec: ClinicalTable) -> DataFrame:
    """S2/S3/P1-P6 for one clinical table: rename, fallback, pad, cast, filter."""
    cid = _opt(df, spec.cid, "bigint")
    if spec.source in df.columns:
        src = _opt(df, spec.source, "bigint")
        cid = F.when(cid.isNull() | (cid == 0), src).otherwise(cid)
    cols = {
        "person_id": _opt(df, "person_id", "bigint"),
        "ts": _ts_source(df, spec.ts, spec.date),
        "et": F.lit(spec.et),
        "cid": cid,
        "value_as_number": _opt(df, spec.value, "double") if spec.value else None,
        "unit_concept_id": _opt(df, spec.unit, "bigint") if spec.unit else None,
        "table_rank": F.lit(TABLE_RANK[spec.et]),
        "ev_id": _opt(df, spec.id_col, "bigint"),
    }
    for src_col, alias in spec.extras.items():
        if src_col in df.columns:
            cols[alias] = _opt(df, src_col, "bigint")
    out = df.select(*_unified(cols))
    return out.where(F.col("ts").isNotNull() & F.col("cid").isNotNull() & (F.col("cid") > 0))


def scan_visits(df: DataFrame) -> DataFrame:
    """One admission at the visit start and one discharge at its end, each only when set."""
    start = _ts_source(df, "visit_start_datetime", "visit_start_date")
    end = _ts_source(df, "visit_end_datetime", "visit_end_date")
    common = {"person_id": _opt(df, "person_id", "bigint"), "ev_id": _opt(df, "visit_occurrence_id", "bigint")}
    adm = df.select(*_unified({
        **common, "ts": start, "et": F.lit("admission"),
        "visit_type": _opt(df, "visit_type_concept_id", "bigint"),
        "table_rank": F.lit(TABLE_RANK["admission"]),
    }))
    dis = df.select(*_unified({
        **common, "ts": end, "et": F.lit("discharge"),
        "table_rank": F.lit(TABLE_RANK["discharge"]),
    }))
    return adm.unionByName(dis).where(F.col("ts").isNotNull())


def scan_death(df: DataFrame) -> DataFrame:
    """One death event per row with a death time."""
    return df.select(*_unified({
        "person_id": _opt(df, "person_id", "bigint"),
        "ts": _ts_source(df, "death_datetime", "death_date"),
        "et": F.lit("death"),
        "table_rank": F.lit(TABLE_RANK["death"]),
    })).where(F.col("ts").isNotNull())


def scan_person(df: DataFrame) -> DataFrame:
    """Person columns present in the table, missing ones as typed NULLs."""
    return df.select(*[_opt(df, n, t).alias(n) for n, t in PERSON_COLUMNS])


def read_omop_dir(spark: SparkSession, root: str, tables: list[str] | None = None, skip_unreadable: bool = False,
                  salvage: bool = False, reports: list[PartReport] | None = None) -> dict[str, DataFrame]:
    """Each OMOP table is a folder of Parquet parts; an absent folder is an absent table.

    Drifting parts are widened (:func:`read_parts`). Anything unreadable is an error unless
    ``skip_unreadable`` is set; with ``salvage`` the damaged parts of a table give the columns
    that decode and its sound parts stay whole. ``reports`` receives one report per table.
    """
    out: dict[str, DataFrame] = {}
    for name in tables or OMOP_TABLES + ["concept", "concept_relationship"]:
        report = PartReport(name)
        df = read_parts(spark, f"{root.rstrip('/')}/{name}", skip_unreadable, report, salvage)
        if df is not None:
            out[name] = df
        if reports is not None and (df is not None or report.skipped):
            reports.append(report)
    return out


SAFE_NAME_PARTS = ["id", "concept", "value", "count", "type"]


def salvage_columns(df: DataFrame) -> DataFrame:
    """Only the "safe" columns of a table (name contains id, concept, value, count or type), for callers that
    trust nothing else of a damaged one."""
    keep = [c for c in df.columns if any(p in c.lower() for p in SAFE_NAME_PARTS)]
    return df.select(*keep)
