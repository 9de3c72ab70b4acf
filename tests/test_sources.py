"""Folder reader, salvage, conversion and coercion on small folders; expected values are written by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronotok.sources import omop, repair


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))


def folder(spark, root):
    write(spark, [(1, 8507), (2, 8532)], "person_id long, gender_concept_id long", root / "person")
    write(spark, [(10, 1, 41, dt.date(2020, 1, 2))],
          "drug_exposure_id long, person_id long, drug_concept_id long, drug_exposure_start_date date", root / "drug_exposure/a")
    write(spark, [(11, 2, "42", dt.date(2020, 1, 3), 7), (12, 2, "no number", dt.date(2020, 1, 4), 7)],
          "drug_exposure_id int, person_id long, drug_concept_id string, drug_exposure_start_date date, route_concept_id int",
          root / "drug_exposure/b")
    return str(root)


def test_type_drift_keeps_every_row(spark, tmp_path):
    root, reports = folder(spark, tmp_path), []
    t = omop.read_omop_dir(spark, root, reports=reports)
    assert set(t) == {"person", "drug_exposure"}
    assert dict(t["drug_exposure"].dtypes)["drug_concept_id"] == "string" and t["drug_exposure"].count() == 3
    ev = omop.scan_clinical(t["drug_exposure"], omop.CLINICAL_BY_NAME["drug_exposure"])
    assert sorted((r.person_id, r.cid, r.ev_id, r.drug_route) for r in ev.collect()) == [(1, 41, 10, None), (2, 42, 11, 7)]
    assert [(r.table, r.files, r.schemas, r.skipped) for r in reports] == [("person", 1, 1, []), ("drug_exposure", 2, 2, [])]


def test_corrupt_part_is_loud(spark, tmp_path):
    root = folder(spark, tmp_path)
    bad = tmp_path / "drug_exposure/bad.parquet"
    bad.write_bytes(b"PAR1 this is no parquet file")
    with pytest.raises(ValueError, match="bad.parquet"):
        omop.read_omop_dir(spark, root)
    reports = []
    t = omop.read_omop_dir(spark, root, skip_unreadable=True, salvage=True, reports=reports)
    drug = next(r for r in reports if r.table == "drug_exposure")
    assert [p.rsplit("/", 1)[1] for p in drug.skipped] == ["bad.parquet"] and drug.files == 3
    assert "drug_exposure_start_date" in t["drug_exposure"].columns and t["drug_exposure"].count() == 3  # sound parts stay whole


@pytest.mark.parametrize("types, want", [
    ({"int", "bigint"}, "bigint"), ({"int", "double"}, "double"), ({"bigint", "double"}, "string"),
    ({"date", "timestamp_ntz"}, "timestamp_ntz"), ({"bigint", "string"}, "string"), ({"void", "int"}, "int")])
def test_widening(types, want):
    assert omop.widened(types) == want


def test_absent_tables_and_folders(spark, tmp_path):
    assert omop.read_omop_dir(spark, str(tmp_path / "nothing")) == {}
    with pytest.raises(ValueError):
        repair.read_concepts(spark, str(tmp_path))
    write(spark, [(1, 2)], "concept_id_1 long, concept_id_2 long", tmp_path / "concept_relationship")
    with pytest.raises(ValueError, match="relationship_id"):
        repair.read_relationships(spark, str(tmp_path))
    write(spark, [(1, "b"), (1, "a"), (2, "c")], "concept_id long, concept_name string", tmp_path / "concept")
    assert {(r.concept_id, r.concept_name) for r in repair.read_concepts(spark, str(tmp_path)).collect()} == {(1, "a"), (2, "c")}


def test_tree_conversion_finds_the_tables(spark, tmp_path):
    write(spark, [("1", "18262", "9007199254740993", "5")],
          "person_id string, visit_start_date string, discharge_to_concept_id string, visit_source_value string",
          tmp_path / "in/visit_occurrence")
    write(spark, [("7", "1.5"), ("8", "x")], "measurement_id string, value_as_number string", tmp_path / "in/deep/measurement")
    done = repair.convert_tables(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert done == ["deep/measurement", "visit_occurrence"]
    v = spark.read.parquet(str(tmp_path / "out/visit_occurrence")).first()
    assert (v.person_id, v.discharged_to_concept_id, v.visit_source_value) == (1, 9007199254740993, "5")
    assert v.visit_start_date == dt.datetime(2020, 1, 1)
    m = spark.read.parquet(str(tmp_path / "out/deep/measurement")).orderBy("measurement_id").collect()
    assert [(r.measurement_id, r.value_as_number) for r in m] == [(7, 1.5), (8, None)]
    with pytest.raises(ValueError):
        repair.convert_tables(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["absent"])


def test_ids_beyond_double_precision(spark):
    rows = [("9007199254740993", "1", "2.5", None), ("9007199254740992", "x", "3", None), (" 5 ", None, "4", None)]
    got = repair.coerce_types(spark.createDataFrame(rows, "person_id string, unit_concept_id string, value string, count string"))
    assert dict(got.dtypes) == {"person_id": "bigint", "unit_concept_id": "bigint", "value": "double", "count": "double"}
    assert [tuple(r) for r in got.collect()] == [(9007199254740993, 1, 2.5, None), (9007199254740992, None, 3.0, None),
                                                (5, None, 4.0, None)]


def test_gaps_across_a_missing_hour(spark):
    from chronotok.functions.tokens import gap_minutes

    assert spark.conf.get("spark.sql.session.timeZone") == "America/New_York"
    rows = [(dt.datetime(2021, 3, 14, 1, 0), dt.datetime(2021, 3, 14, 2, 30), 90.0),
            (dt.datetime(2021, 3, 14, 2, 30), dt.datetime(2021, 3, 14, 3, 30), 60.0),
            (dt.datetime(2021, 11, 7, 0, 30), dt.datetime(2021, 11, 7, 3, 30), 180.0),
            (dt.datetime(1969, 12, 31, 23, 59, 59, 500000), dt.datetime(1970, 1, 1), 0.5 / 60), (None, dt.datetime(2020, 1, 1), None)]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz, want double")
    assert all(r.got == r.want for r in df.withColumn("got", gap_minutes("a", "b")).collect())


def test_labels_look_at_four_event_types(spark):
    from chronotok.operators.labels import label_in_window

    rows = [(1, "observation", 5), (2, "condition", 5), (3, "death", None), (4, "measurement", 5)]
    ev = spark.createDataFrame([(p, dt.datetime(2020, 1, 2), e, c) for p, e, c in rows],
                               "person_id long, ts timestamp_ntz, et string, cid long")
    idx = spark.createDataFrame([(p, dt.datetime(2020, 1, 1)) for p in range(1, 6)], "person_id long, index_time timestamp_ntz")
    got = {r.person_id: r.label for r in label_in_window(ev, idx, 30, regex="_5$").collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0}


def test_targets(spark):
    from chronotok.operators.vocab import resolve_targets, special_id

    v = spark.createDataFrame([("<UNK>", 0), ("CONDITION_OCCURRENCE_5", 1), ("DRUG_EXPOSURE_5", 2), ("MEASUREMENT_7", 3)],
                              "token string, token_id int")
    ids = lambda **k: {r.token_id for r in resolve_targets(v, **k).collect()}
    assert ids(event_type="Condition", concept_ids=[5, 6]) == {1} and ids(regex="_5$") == {1, 2}
    assert ids(event_type="medication", concept_ids=[5], regex="^MEAS") == {2, 3}
    for none in ({"event_type": "condition", "concept_ids": [99]}, {"event_type": "death", "concept_ids": [1]}, {}):
        with pytest.raises(ValueError):
            resolve_targets(v, **none)
    with pytest.raises(ValueError):
        special_id(v, "<EOS>")


def test_rank_metrics_with_a_million_scores(spark):
    from chronotok.operators import evaluate as EV

    df = spark.range(1_000_000).select(F.lit("t").alias("target"), F.col("id").alias("person_id"),
                                       (F.col("id") / 1_000_000).alias("score"),
                                       (F.col("id") % 4 == 3).cast("int").alias("label"))
    n, pos = 1_000_000, 250_000
    # label 1 at ids 3, 7, ...: the j-th positive (from 0) has 3 (j + 1) negatives below it
    want = sum(3 * (j + 1) for j in range(pos)) / (pos * (n - pos))
    assert abs(EV.auroc(df, ["target"]).first()["auroc"] - want) < 1e-12
    pts = EV.roc_points(df, ["target"])
    assert abs(pts.first()["auc"] - want) < 1e-9 and pts.count() == n + 1
    plan = EV.auroc(df, ["target"])._jdf.queryExecution().executedPlan().toString()
    assert all("_slice" in line for line in plan.split("\n") if " Window [" in line)
