"""Native column expressions shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WHITE = " \t\n\x0b\f\r"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
GAP_PATTERN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words between ASCII white space; an empty array for null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP_PATTERN))


def crc32(text: Column) -> Column:
    return F.crc32(F.encode(text, "UTF-8"))


def id_crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id written as text, modulo m; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % m
