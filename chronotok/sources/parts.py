"""Part files of a table folder: footers read by tasks, drifting schemas merged, damaged parts salvaged.

The footers of all parts are read by tasks and grouped by schema there, so the driver gets one row for each
*distinct schema* with its row count and paths, and the number of jobs does not depend on the number of parts. Each
schema is read by one scan; the scans are united over a lattice of types:

* wider integers, then double; date, then timestamp; anything else becomes text;
* doubles that meet whole numbers or text: writers that know no missing integers store ids as doubles, and a missing
  one as NaN. Where every double of the column is a whole number within 2**53 it is read as an integer, and NaN as
  NULL. A fraction in a column of ids is an error; other columns (values) are doubles, or text among text.

A part whose footer cannot be read is an error unless the caller skips it. With ``salvage`` every column chunk of
every part is decoded once by the tasks: sound parts are read as they are, and of damaged parts each row group gives
the columns that decode, the others being NULL there. Nothing is dropped without a count in the report.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ID_SUFFIX = "_id"
EXACT_DOUBLE = 2 ** 53


@dataclass
class PartReport:
    """What a folder read saw: part files, rows by their footers, distinct schemas, files left out on request, and of
    damaged parts the (path, row group, column) chunks that were lost."""

    table: str
    files: int = 0
    rows: int = 0
    schemas: int = 1
    skipped: list[str] = field(default_factory=list)
    damaged: list[str] = field(default_factory=list)
    lost_chunks: int = 0
    lost_rows: int = 0


_INTEGRAL = {"tinyint": 0, "smallint": 1, "int": 2, "bigint": 3}
_FRACTIONAL = {"float": 0, "double": 1}


def widened(types: set[str]) -> str:
    """The type that holds every value of the given ones: wider integer, double, timestamp, else string."""
    types = types - {"void"}
    if len(types) <= 1:
        return next(iter(types), "string")
    if types <= set(_INTEGRAL):
        return max(types, key=_INTEGRAL.get)
    if types <= {*_INTEGRAL, *_FRACTIONAL} and "bigint" not in types:  # a double loses ids above 2^53
        return "double"
    if types <= {"date", "timestamp_ntz", "timestamp"}:
        return "timestamp_ntz"
    return "string"


def part_paths(spark: SparkSession, path: str) -> DataFrame | None:
    """``path`` and ``length`` of the Parquet parts below ``path``, or None where there is none. Spark lists them; no
    file is opened."""
    from pyspark.errors import AnalysisException

    try:
        found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                 .option("pathGlobFilter", "*.parquet").load(path).select("path", "length"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e.getCondition()) or "UNABLE_TO_INFER_SCHEMA" in str(e.getCondition()):
            return None
        raise
    return None if found.isEmpty() else found


def part_files(spark: SparkSession, path: str) -> list[str]:
    """Sorted paths of the Parquet parts below ``path``; an absent folder has none."""
    found = part_paths(spark, path)
    return [] if found is None else sorted(r.path for r in found.select("path").collect())  # one row per part file


def _open(path: str, content: bytes | None):
    """A Parquet file in a task: its bytes if they came along, else by the path's file system."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    if content is not None:
        return pq.ParquetFile(pa.BufferReader(content))
    if path.startswith("file:/"):
        path = "file:///" + path[len("file:"):].lstrip("/")
    system, name = fs.FileSystem.from_uri(path)
    return pq.ParquetFile(system.open_input_file(name))


def _tasks_open(spark: SparkSession, path: str) -> bool:
    """Whether tasks can open files of this store themselves (else Spark hands them the bytes)."""
    scheme = path.split(":", 1)[0] if ":" in path.split("/", 1)[0] else ""
    if not scheme:
        scheme = spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").split(":", 1)[0]
    return scheme in ("file", "s3", "s3a", "gs", "gcs", "abfs", "abfss")


def _sources(spark: SparkSession, path: str, paths: list[str] | None = None) -> DataFrame:
    """(path, content) of the parts; ``content`` is NULL where tasks open the files themselves."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    rows = reader.load(paths if paths is not None else path)
    content = F.lit(None).cast("binary") if _tasks_open(spark, path) else F.col("content")
    return rows.select("path", content.alias("content"))


FOOTER = "path string, signature string, rows long, damaged array<string>, error string"


def part_footers(spark: SparkSession, path: str, probe: bool = False) -> DataFrame | None:
    """One row per part: ``path``, ``signature`` (its columns with their stored types), ``rows``, ``error`` if its
    footer cannot be read and, with ``probe``, the column chunks that do not decode as ``<row group>:<column>``.
    Tasks read the footers, and with ``probe`` the data."""
    listed = part_paths(spark, path)
    if listed is None:
        return None
    n = min(listed.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    f = _open(name, content.as_py())
                    stored = [f.schema.column(i) for i in range(len(f.schema))]
                    signature = ";".join(f"{c.path}:{c.physical_type}:{c.logical_type}:{c.max_repetition_level}" for c in stored)
                    bad = [f"{g}:{c}" for g, c in _damage(f)] if probe else []
                    out.append((name, signature, f.metadata.num_rows, bad, None))
                except Exception as e:  # noqa: BLE001 - reported row by row, and raised by the reader unless asked not to
                    out.append((name, None, None, [], str(e).splitlines()[0] if str(e) else type(e).__name__))
            types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                             ["path", "signature", "rows", "damaged", "error"])

    return _sources(spark, path).repartition(n).mapInArrow(run, FOOTER)


def _damage(f) -> Iterator[tuple[int, str]]:
    """Row groups and top-level columns of a Parquet file that do not decode."""
    for g in range(f.metadata.num_row_groups):
        for c in f.schema_arrow.names:
            if not _decodes(f, g, c):
                yield g, c


def _decodes(f, group: int, column: str):
    """The decoded column chunk, or None."""
    try:
        got = f.read_row_group(group, columns=[column])
        got.validate(full=True)  # text that is no UTF-8 counts as damage
    except Exception:  # noqa: BLE001 - any failure to decode is the finding
        return None
    return got if got.num_rows == f.metadata.row_group(group).num_rows else None


def salvaged(spark: SparkSession, path: str, paths: list[str], schema: str) -> DataFrame:
    """The rows of damaged parts of one schema: each row group with the columns that decode, NULL elsewhere. Row
    groups of which nothing decodes give no rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                f = _open(name, content.as_py())
                for g in range(f.metadata.num_row_groups):
                    n, columns = f.metadata.row_group(g).num_rows, []
                    for wanted in target:
                        got = _decodes(f, g, wanted.name)
                        columns.append(None if got is None else got.column(0).combine_chunks().cast(wanted.type, safe=False))
                    if any(c is not None for c in columns):
                        whole = pa.RecordBatch.from_arrays([pa.nulls(n, t.type) if c is None else c
                                                            for c, t in zip(columns, target)], target.names)
                        for at in range(0, n, 10_000):
                            yield whole.slice(at, 10_000)

    n = min(len(paths), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _sources(spark, path, paths).repartition(n, "path").mapInArrow(run, schema)


def _whole(scans: list[DataFrame], columns: list[str]) -> dict[str, bool]:
    """Of each column whether all its double values are whole numbers that a double holds exactly; one job for all."""
    parts = []
    for scan in scans:
        kinds = dict(scan.dtypes)
        mine = [c for c in columns if kinds.get(c) in _FRACTIONAL]
        if mine:
            parts.append(scan.agg(*[F.max(_fraction(F.col(c))).alias(c) for c in mine]).select(
                *[(F.col(c) if c in mine else F.lit(False)).alias(c) for c in columns]))
    if not parts:
        return {c: True for c in columns}
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    found = out.agg(*[F.coalesce(F.max(c), F.lit(False)).alias(c) for c in columns]).first()
    return {c: not found[c] for c in columns}


def _fraction(c: Column) -> Column:
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & ((c != F.floor(c)) | (F.abs(c) > EXACT_DOUBLE))


def merged_types(scans: list[DataFrame]) -> tuple[dict[str, str], set[str]]:
    """The type of every column over all scans, and the columns whose doubles are whole numbers."""
    kinds: dict[str, set[str]] = {}
    for scan in scans:
        for name, kind in scan.dtypes:
            kinds.setdefault(name, set()).add(kind)
    numbers = {*_INTEGRAL, *_FRACTIONAL}
    mixed = [c for c, t in kinds.items() if t & set(_FRACTIONAL) and t & {*_INTEGRAL, "string"} and t - {"void"} <= {*numbers, "string"}]
    whole = {c for c, yes in (_whole(scans, mixed) if mixed else {}).items() if yes}
    out = {c: widened(t) for c, t in kinds.items()}
    for c in mixed:
        if c not in whole and c.lower().endswith(ID_SUFFIX):
            raise ValueError(f"column {c}: ids stored as doubles hold a fraction or a value beyond 2**53")
        if "string" not in kinds[c]:
            out[c] = "bigint" if c in whole else "double"
    return out, whole


def _cast(scan: DataFrame, column: str, kind: str, whole: set[str]) -> Column:
    c = F.col(column) if column in scan.columns else F.lit(None)
    if column in whole and column in scan.columns and dict(scan.dtypes)[column] in _FRACTIONAL:
        c = F.when(~F.isnan(c), c).cast("bigint")
    return c.cast(kind).alias(column)


def read_parts(spark: SparkSession, path: str, skip_unreadable: bool = False, report: PartReport | None = None,
               salvage: bool = False) -> DataFrame | None:
    """Every Parquet part below ``path`` as one table, or None where there is none.

    A column has the type of :func:`merged_types`, and columns that a part lacks are NULL. A part
    that cannot be opened raises an error; with ``skip_unreadable`` it is left out and named in
    ``report``. With ``salvage`` (which reads all data once more) damaged parts give what decodes.
    """
    report = report if report is not None else PartReport(path)
    footers = part_footers(spark, path, probe=salvage)
    if footers is None:
        return None
    hurt = F.size("damaged") > 0
    groups = footers.groupBy("signature", hurt.alias("hurt")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.sum(F.size("damaged")).alias("lost"),
        F.sort_array(F.collect_list("path")).alias("paths"), F.min(F.struct("path", "error")).alias("first")).collect()
    report.files = sum(g.files for g in groups)
    report.rows = sum(g.rows or 0 for g in groups)
    for g in groups:
        if g.signature is None:
            if not (skip_unreadable or salvage):
                raise ValueError(f"cannot read {g.first.path}: {g.first.error}")
            report.skipped += g.paths
    readable = sorted((g for g in groups if g.signature is not None), key=lambda g: (g.hurt, g.paths))
    report.schemas = len({g.signature for g in readable})
    if not readable:
        return None
    scans = []
    for g in readable:
        if len(groups) == 1 and not g.hurt:  # no path list: the folder itself
            scans.append(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path))
            continue
        scan = spark.read.parquet(*g.paths)  # one footer gives the schema of the group
        if g.hurt:
            report.damaged += g.paths
            report.lost_chunks += g.lost
            scan = salvaged(spark, path, g.paths, ", ".join(f"`{n}` {t}" for n, t in scan.dtypes))
        scans.append(scan)
    types, whole = merged_types(scans)
    out = None
    for scan in scans:
        part = scan.select(*[_cast(scan, c, t, whole) for c, t in types.items()])
        out = part if out is None else out.unionByName(part)
    if report.damaged:
        report.lost_rows = sum(g.rows for g in readable if g.hurt) - sum(
            s.count() for s, g in zip(scans, readable) if g.hurt)
    return out
