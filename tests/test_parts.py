"""Part files: footers by tasks, drifting types, float ids, salvage of damaged column chunks."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from chronotok.operators.events import build_events
from chronotok.sources import omop, parts

ID, TS = "condition_occurrence_id", "condition_start_datetime"


def part(path, ids, persons, concepts, id_type=pa.int64(), **kw):
    path.parent.mkdir(parents=True, exist_ok=True)
    n = len(ids)
    table = pa.table({ID: pa.array(ids, id_type), "person_id": pa.array(persons, id_type), "condition_concept_id": pa.array(concepts, id_type),
                      TS: pa.array([dt.datetime(2020, 1, 1 + i % 28) for i in range(n)], pa.timestamp("us"))})
    pq.write_table(table, path, **kw)


def ordered(rows):
    return sorted(rows, key=str)


def events(spark, root):
    t = omop.read_omop_dir(spark, str(root))
    return ordered((r.person_id, r.cid, r.ev_id) for r in build_events(t).collect())


def test_ids_stored_as_doubles_keep_their_rows(spark, tmp_path):
    """What pandas writes for a nullable integer column; missing ids are NaN or NULL."""
    part(tmp_path / "condition_occurrence/a.parquet", [10, 11], [1, 2], [41, 9007199254740993])
    part(tmp_path / "condition_occurrence/b.parquet", [12.0, 13.0, float("nan")], [103.0, 104.0, 105.0], [43.0, 44.0, 45.0], pa.float64())
    part(tmp_path / "condition_occurrence/c.parquet", ["14", "15"], ["6", "x"], ["46", "47"], pa.string())
    assert events(spark, tmp_path) == ordered([
        (None, 47, 15), (1, 41, 10), (2, 9007199254740993, 11), (6, 46, 14), (103, 43, 12), (104, 44, 13), (105, 45, None)])


def test_a_fraction_among_ids_is_an_error(spark, tmp_path):
    part(tmp_path / "condition_occurrence/a.parquet", [10], [1], [41])
    part(tmp_path / "condition_occurrence/b.parquet", [12.0], [103.5], [43.0], pa.float64())
    with pytest.raises(ValueError, match="person_id"):
        omop.read_omop_dir(spark, str(tmp_path))
    part(tmp_path / "condition_occurrence/b.parquet", [12.0], [2.0 ** 60], [43.0], pa.float64())
    with pytest.raises(ValueError, match="person_id"):
        omop.read_omop_dir(spark, str(tmp_path))


def test_values_of_two_number_types_are_doubles(spark, tmp_path):
    for name, kind, values in (("a", pa.int64(), [1, 2]), ("b", pa.float64(), [2.5, None])):
        path = tmp_path / f"measurement/{name}.parquet"
        path.parent.mkdir(exist_ok=True)
        pq.write_table(pa.table({"measurement_id": [1, 2], "value_as_number": pa.array(values, kind)}), path)
    t = omop.read_omop_dir(spark, str(tmp_path))["measurement"]
    assert dict(t.dtypes)["value_as_number"] == "double" and sorted(r.value_as_number for r in t.collect() if r.value_as_number) == [1, 2, 2.5]


def test_footers_take_a_bounded_number_of_jobs(spark, tmp_path):
    """300 parts of two schemas: the number of Spark jobs does not depend on the number of parts."""
    sc = spark.sparkContext

    def jobs(n, root):
        for i in range(n):
            part(root / f"condition_occurrence/{i:04d}.parquet", [i], [i], [5], pa.int64() if i % 2 else pa.int32())
        group = f"footers-{n}"
        sc.setJobGroup(group, group)
        report = parts.PartReport("t")
        df = parts.read_parts(spark, str(root / "condition_occurrence"), report=report)
        ran = len(sc.statusTracker().getJobIdsForGroup(group))
        sc.setLocalProperty("spark.jobGroup.id", None)
        assert (report.files, report.rows, report.schemas) == (n, n, 2) and df.count() == n
        return ran

    assert jobs(300, tmp_path / "many") <= jobs(4, tmp_path / "few") + 2


def damage(path, column, group):
    """Overwrite the data of one column chunk."""
    chunk = pq.ParquetFile(path).metadata.row_group(group).column(pq.ParquetFile(path).schema_arrow.names.index(column))
    raw = bytearray(path.read_bytes())
    at = chunk.dictionary_page_offset or chunk.data_page_offset
    raw[at:at + chunk.total_compressed_size] = b"\xff" * chunk.total_compressed_size
    path.write_bytes(bytes(raw))


def test_salvage_reads_what_decodes(spark, tmp_path):
    folder = tmp_path / "condition_occurrence"
    part(folder / "sound.parquet", [1, 2, 3], [1, 2, 3], [41, 42, 43])
    part(folder / "hurt.parquet", list(range(10, 20)), list(range(10, 20)), list(range(50, 60)), row_group_size=5)
    (folder / "lost.parquet").write_bytes(b"PAR1 this is no parquet file")
    damage(folder / "hurt.parquet", ID, 0)
    with pytest.raises(ValueError, match="lost.parquet"):
        omop.read_omop_dir(spark, str(tmp_path))
    reports = []
    t = omop.read_omop_dir(spark, str(tmp_path), salvage=True, reports=reports)
    rows = ordered((r.person_id, r.condition_concept_id, r[ID], r[TS].day) for r in t["condition_occurrence"].collect())
    assert rows == ordered([(1, 41, 1, 1), (2, 42, 2, 2), (3, 43, 3, 3)] + [(10 + i, 50 + i, None if i < 5 else 10 + i, 1 + i) for i in range(10)])
    r = reports[0]
    assert [p.rsplit("/", 1)[1] for p in r.skipped] == ["lost.parquet"] and [p.rsplit("/", 1)[1] for p in r.damaged] == ["hurt.parquet"]
    assert (r.files, r.rows, r.lost_chunks, r.lost_rows) == (3, 13, 1, 0)
    assert len(build_events(t).collect()) == 13  # the sound part kept its times


def test_a_row_group_of_which_nothing_decodes_is_counted(spark, tmp_path):
    path = tmp_path / "t/hurt.parquet"
    part(path, list(range(6)), list(range(6)), list(range(6)), row_group_size=3)
    for c in (ID, "person_id", "condition_concept_id", TS):
        damage(path, c, 1)
    report = parts.PartReport("t")
    got = parts.read_parts(spark, str(tmp_path / "t"), report=report, salvage=True)
    assert sorted(r.person_id for r in got.collect()) == [0, 1, 2]
    assert (report.lost_chunks, report.lost_rows, report.rows) == (4, 3, 6)
