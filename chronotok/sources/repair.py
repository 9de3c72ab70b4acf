"""Source repair: the date cascade (S5, F13), name-keyword type coercion
and whole-directory conversion (S8, S9).

The date cascade decides *per column* which reading of the raw values wins
(epoch days, then seconds, then milliseconds, then string parsing): the first
reading with at least one non-NULL value. The decision is one aggregate pass
(``count`` of each reading) followed by a single projection, so the column is
never collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .parts import PartReport, part_paths, read_parts

# Source-value columns kept as strings by the coercion rule (fixed list).
PRESERVE_AS_STRINGS = [
    "person_source_value",
    "gender_source_value",
    "race_source_value",
    "ethnicity_source_value",
    "state_of_residence_source_value",
    "sex_at_birth_source_value",
    "self_reported_category_source_value",
    "visit_source_value",
    "condition_source_value",
    "drug_source_value",
    "procedure_source_value",
    "measurement_source_value",
    "observation_source_value",
    "death_source_value",
    "note_source_value",
    "specimen_source_value",
]
DATE_KEYWORDS = ["date", "time", "start", "end"]
NUMERIC_KEYWORDS = ["id", "concept", "value", "count"]
EVENT_TABLES = ["visit_occurrence", "condition_occurrence", "drug_exposure", "procedure_occurrence",
                "measurement", "observation"]
RENAMES = {"discharge_to_concept_id": "discharged_to_concept_id"}

# Limits of a nanosecond timestamp (what the original readings could hold).
_NS_LIMIT = 9.223372036854775e18
_UNIT_NS = {"days": 86400e9, "seconds": 1e9, "millis": 1e6}
_UNIT_MICROS = {"days": 86400e6, "seconds": 1e6, "millis": 1e3}
STRATEGIES = ["days", "seconds", "millis", "string"]


def _epoch(num: Column, unit: str) -> Column:
    ok = num.isNotNull() & (F.abs(num * _UNIT_NS[unit]) < _NS_LIMIT)
    micros = (num * _UNIT_MICROS[unit]).cast("bigint")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.when(ok, F.timestamp_add("MICROSECOND", micros, epoch))  # wall clock, no session time zone


def readings(c: Column) -> dict[str, Column]:
    """the four readings of a raw value (numeric via ``try_cast``)."""
    s = c.cast("string")
    num = F.when(s.rlike(r"^\s*[-+]?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?\s*$"), s.cast("double"))
    return {
        "days": _epoch(num, "days"),
        "seconds": _epoch(num, "seconds"),
        "millis": _epoch(num, "millis"),
        "string": F.when(num.isNull(), _try_ts(s)),
    }


def _try_ts(s: Column) -> Column:
    return s.cast("string").try_cast("timestamp_ntz")


def repair_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column, the first reading (days, seconds, millis, string) that yields
    any non-NULL value replaces the column; otherwise the column is left as is."""
    cols = [c for c in columns if c in df.columns]
    if not cols:
        return df
    aggs = []
    for c in cols:
        r = readings(F.col(c))
        for k in STRATEGIES:
            aggs.append(F.count(r[k]).alias(f"{c}__{k}"))
    counts = df.agg(*aggs).first().asDict()  # one row of counts: bounded, fine on the driver
    out = df
    for c in cols:
        r = readings(F.col(c))
        chosen = next((k for k in STRATEGIES if counts[f"{c}__{k}"] > 0), None)
        if chosen is not None:
            out = out.withColumn(c, r[chosen])
    return out


def _is_integer(c: Column) -> Column:
    """True for the text of an integer that a bigint holds, False for another number, NULL for no number."""
    whole = c.rlike(r"^\s*[-+]?[0-9]+\s*$") & F.trim(c).try_cast("bigint").isNotNull()
    return F.when(F.trim(c).try_cast("double").isNotNull(), whole)


def coerce_types(df: DataFrame, table: str | None = None) -> DataFrame:
    """String columns re-typed by name keyword.

    * names in :data:`PRESERVE_AS_STRINGS` stay strings;
    * a name containing date/time/start/end -> timestamp (bad values NULL);
    * else a name containing id/concept/value/count and not ``source`` -> a number (bad NULL):
      bigint where every value that is a number is an integer in range, else double. One
      aggregate pass over the columns concerned decides, so ids above 2^53 stay exact;
    * ``person.birth_datetime`` and the date/time columns of event tables are always timestamps.
    """
    numeric = [f.name for f in df.schema.fields
               if isinstance(f.dataType, T.StringType) and f.name not in PRESERVE_AS_STRINGS
               and not any(k in f.name.lower() for k in DATE_KEYWORDS)
               and any(k in f.name.lower() for k in NUMERIC_KEYWORDS) and "source" not in f.name.lower()]
    integral: dict[str, bool] = {}
    if numeric:  # one row of flags
        flags = df.agg(*[F.coalesce(F.bool_and(_is_integer(F.col(c))), F.lit(False)).alias(c) for c in numeric]).first()
        integral = flags.asDict()
    out = []
    for f in df.schema.fields:
        name, low = f.name, f.name.lower()
        c = F.col(name)
        is_str = isinstance(f.dataType, T.StringType)
        datey = any(k in low for k in DATE_KEYWORDS)
        forced = (table == "person" and name == "birth_datetime") or (table in EVENT_TABLES and datey)
        if is_str and name not in PRESERVE_AS_STRINGS:
            if datey:
                c = _try_ts(c)
            elif name in integral:
                c = F.trim(c).try_cast("bigint" if integral[name] else "double")
        elif forced and not isinstance(f.dataType, T.TimestampNTZType):
            c = _try_ts(c.cast("string")) if not isinstance(f.dataType, (T.DateType, T.TimestampType)) else c.cast("timestamp_ntz")
        out.append(c.alias(name))
    return df.select(*out)


def table_folders(spark: SparkSession, root: str) -> list[str]:
    """The folders below ``root`` that hold Parquet parts, relative to it."""
    base = root.rstrip("/")
    found = part_paths(spark, base)
    if found is None:
        return []
    folders = found.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("f")).distinct().collect()  # one per folder
    inside = {r.f.split(base.split("://")[-1], 1)[-1].strip("/") for r in folders}
    return sorted(n for n in inside if n)


def convert_tables(spark: SparkSession, input_root: str, output_root: str, tables: list[str] | None = None,
                   date_columns: dict[str, list[str]] | None = None, mode: str = "overwrite",
                   skip_unreadable: bool = False, reports: list[PartReport] | None = None) -> list[str]:
    """Read each table folder (all that ``input_root`` holds unless ``tables`` names some),
    repair dates, coerce types, apply the column renames and write it under the same layout.
    A part that cannot be read is an error unless ``skip_unreadable`` is set."""
    done = []
    for t in tables if tables is not None else table_folders(spark, input_root):
        report = PartReport(t)
        df = read_parts(spark, f"{input_root.rstrip('/')}/{t}", skip_unreadable, report)
        if reports is not None:
            reports.append(report)
        if df is None:
            if tables is not None and not report.skipped:
                raise ValueError(f"no Parquet parts in {input_root}/{t}")
            continue
        for old, new in RENAMES.items():
            if old in df.columns:
                df = df.withColumnRenamed(old, new)
        cols = (date_columns or {}).get(t) or [c for c in df.columns
                                               if any(k in c.lower() for k in ("date", "time"))
                                               and isinstance(df.schema[c].dataType, (T.StringType, T.LongType, T.IntegerType, T.DoubleType))]
        df = coerce_types(repair_dates(df, cols), t.rpartition("/")[2])
        df.write.mode(mode).parquet(f"{output_root.rstrip('/')}/{t}")
        done.append(t)
    return done


def read_concepts(spark: SparkSession, omop_dir: str) -> DataFrame:
    """Every concept part; six columns if present; one row per concept id."""
    from ..operators.profile import concept_dictionary

    df = read_parts(spark, f"{omop_dir.rstrip('/')}/concept")
    if df is None:
        raise ValueError(f"no concept table in {omop_dir}")
    return concept_dictionary(df)


def read_relationships(spark: SparkSession, omop_dir: str) -> DataFrame:
    """Concept relationships; the three columns are required."""
    df = read_parts(spark, f"{omop_dir.rstrip('/')}/concept_relationship")
    if df is None:
        raise ValueError(f"no concept_relationship table in {omop_dir}")
    missing = {"concept_id_1", "concept_id_2", "relationship_id"} - set(df.columns)
    if missing:
        raise ValueError(f"concept_relationship lacks {sorted(missing)}")
    return df.select("concept_id_1", "concept_id_2", "relationship_id")
