"""Streaming ingestion into the partitioned event table, and sink read-back."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F


def test_stream_into_events(spark):
    from chronotok.streaming.ingest import stream_table_into_events

    root = tempfile.mkdtemp(prefix="chronotok-stream-", dir="/tmp")
    rows = [(i, i % 3, dt.datetime(2020, 1, 1 + i % 20), 100 + i % 4, None) for i in range(30)]
    df = spark.createDataFrame(rows, "condition_occurrence_id long, person_id long, condition_start_datetime timestamp_ntz, "
                                     "condition_concept_id long, condition_source_concept_id long")
    df.write.parquet(f"{root}/in/condition_occurrence")
    q = stream_table_into_events(spark, f"{root}/in/condition_occurrence", "condition_occurrence", df.schema,
                                 f"{root}/events", f"{root}/ckpt", n_buckets=4)
    q.awaitTermination(120)
    back = spark.read.parquet(f"{root}/events")
    assert back.count() == 30
    assert sorted(r[0] for r in back.select("pid_bucket").distinct().collect()) == [0, 1, 2]
    assert back.where(F.col("et") != "condition").count() == 0
    # the same batch again (a replay after a failure) replaces its rows
    q = stream_table_into_events(spark, f"{root}/in/condition_occurrence", "condition_occurrence", df.schema,
                                 f"{root}/events", f"{root}/ckpt2", n_buckets=4)
    q.awaitTermination(120)
    assert spark.read.parquet(f"{root}/events").count() == 30


def test_sinks_roundtrip(spark):
    from chronotok.sources import sinks

    root = tempfile.mkdtemp(prefix="chronotok-sinks-", dir="/tmp")
    vocab = spark.createDataFrame([("<PAD>", 0), ("<UNK>", 1)], "token string, token_id int")
    sinks.write_spec(vocab, f"{root}/spec")
    txt = spark.read.text(f"{root}/spec").first()[0]
    assert '"vocab":{"<PAD>":0,"<UNK>":1}' in txt and '"max_quantile_tokens":10' in txt
    assert not sinks.has_output(spark, f"{root}/missing")
    sinks.write_table(vocab, f"{root}/vocab")
    assert sinks.has_output(spark, f"{root}/vocab")


def test_reports(spark):
    from chronotok.sources import sinks

    root = tempfile.mkdtemp(prefix="chronotok-reports-", dir="/tmp")
    report = spark.createDataFrame([("UNIT", 9, "UNIT_1", 4), ("AGE", 3, "AGE_0-5", 1), ("UNIT", 7, "UNIT_2", 0)],
                                   "category string, token_id int, token string, count long")
    sinks.write_vocab_text(report, f"{root}/txt")
    assert [r.value for r in spark.read.text(f"{root}/txt").collect()] == [
        "[AGE]", "3\tAGE_0-5\t1", "[UNIT]", "7\tUNIT_2\t0", "9\tUNIT_1\t4"]
    sinks.write_vocab_report(report, f"{root}/tsv")
    rows = spark.read.option("header", True).option("sep", "\t").csv(f"{root}/tsv").collect()
    assert [(r.category, r.token_id, r["count"]) for r in rows] == [("AGE", "3", "1"), ("UNIT", "7", "0"), ("UNIT", "9", "4")]
    sinks.write_json(report, f"{root}/json")
    assert spark.read.json(f"{root}/json").count() == 3
    assert sinks.dataset_path("/x", "t") == "/x/processed_data_t" and sinks.dataset_path("/x", None) == "/x/processed_data"
