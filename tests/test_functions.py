"""Edge frames for the scalar rules (FIXTURES part C)."""

import math

import numpy as np

from chronotok import constants as K
from chronotok.functions import tokens as T


def gap_rule(m):
    """The time-gap rule written out in plain Python (test oracle)."""
    if m is None or m < 5:
        return []
    if m > 525600:
        n = max(2, int(round(m / 259200)))
        return ["TIME_6m"] * n
    for label, th in reversed(K.TIME_INTERVALS):
        if m >= th:
            return [f"TIME_{label}"]
    return []


GAPS = [4.99, 5, 14.99, 15, 59, 60, 179, 180, 359, 360, 719, 720, 1439, 1440, 4319, 4320, 10079, 10080,
        43199, 43200, 129599, 129600, 259199, 259200, 525599, 525600, 525601, 2.5 * 259200, 3.5 * 259200,
        10 * 525600]


def test_gap_tokens(spark):
    df = spark.createDataFrame([(float(g),) for g in GAPS] + [(None,)], "m double")
    got = {r["m"]: r["t"] for r in df.select("m", T.gap_tokens("m").alias("t")).collect()}
    for g in GAPS:
        assert got[float(g)] == gap_rule(g), g
    assert got[None] == []
    # half-even: 2.5 x 6 months -> 2 tokens, 3.5 x -> 4 tokens
    assert len(got[2.5 * 259200]) == 2 and len(got[3.5 * 259200]) == 4
    assert got[525600.0] == ["TIME_1y"] and got[525601.0] == ["TIME_6m", "TIME_6m"]


def test_age_and_year_bands(spark):
    ages = [-1, 0, 4, 5, 99, 100, 119, 120]
    df = spark.createDataFrame([(a,) for a in ages], "a int")
    got = {r["a"]: r["b"] for r in df.select("a", T.age_band("a").alias("b")).collect()}
    assert got[-1] == "100-120" and got[0] == "0-5" and got[4] == "0-5" and got[5] == "5-10"
    assert got[99] == "95-100" and got[100] == "100-120" and got[120] == "100-120"
    years = [1900, 1965, 1968, 1969, 1970, 1974, 1975, None]
    df = spark.createDataFrame([(y,) for y in years], "y int")
    got = {r["y"]: r["b"] for r in df.select("y", T.year_band("y").alias("b")).collect()}
    assert got[1968] == "1965-1970" and got[1970] == "1970-1975" and got[1975] == "1975-1980"
    assert got[1900] == "1900-1905" and got[None] == "None"


def test_decile_index(spark):
    cuts = [float(x) for x in range(10, 101, 10)]  # 10..100
    vals = [5.0, 10.0, 10.5, 100.0, 100.5]
    df = spark.createDataFrame([(v, cuts) for v in vals], "v double, cuts array<double>")
    got = {r["v"]: r["q"] for r in df.select("v", T.decile_index("v", "cuts").alias("q")).collect()}
    assert got[5.0] == 0 and got[10.0] == 0 and got[10.5] == 1 and got[100.0] == 9
    assert got[100.5] == 0  # above the last cut falls back to Q0


def test_target_variants(spark):
    df = spark.createDataFrame([("CONDITION_OCCURRENCE_5",), ("DRUG_7",), ("MEASUREMENT_3",)], "t string")
    got = {r["t"]: set(r["v"]) for r in df.select("t", T.target_variants("t").alias("v")).collect()}
    assert got["CONDITION_OCCURRENCE_5"] == {"CONDITION_OCCURRENCE_5", "CONDITION_5", "CONDITION_OCCURRENCE_OCCURRENCE_5"}
    assert got["DRUG_7"] == {"DRUG_7", "DRUG_EXPOSURE_7"}
    assert got["MEASUREMENT_3"] == {"MEASUREMENT_3"}


def test_token_labels(spark):
    from chronotok.operators.profile import token_label

    toks = ["<PAD>", "EVENT_MEDICATION", "EVENT_DEATH", "AGE_0-5", "GENDER_1", "VISIT_TYPE_3", "UNIT_99", "Q0", "Q7", "XYZ"]
    df = spark.createDataFrame([(t,) for t in toks], "t string")
    got = {r["t"]: r["l"] for r in df.select("t", token_label("t").alias("l")).collect()}
    assert got["<PAD>"] == "<PAD>"
    assert got["EVENT_MEDICATION"] == "Medical Event: Medication"
    assert got["EVENT_DEATH"] == "Death Event"
    assert got["AGE_0-5"] == "Age interval: 0-5 years"
    assert got["GENDER_1"] == "Gender: Male"
    assert got["VISIT_TYPE_3"] == "Visit type: Emergency"
    assert got["UNIT_99"] == "Unit: Unit ID 99"
    assert got["Q0"] == "Quantile: Minimum (0th percentile)"
    assert got["Q7"] == "Quantile: 7th percentile"
    assert got["XYZ"] == "Token: XYZ"


def test_ece_bin_edges(spark):
    from chronotok.operators.evaluate import calibration_bins

    ps = [0.3, 0.6, 0.7, 0.5, 1.0, 0.0]
    df = spark.createDataFrame([("t", p, 1) for p in ps], "target string, score double, label int")
    bins = calibration_bins(df, ["target"]).where("weight > 0").collect()
    got = {r["bin"]: r["weight"] for r in bins}
    edges = np.linspace(0.0, 1.0, 11)
    expect = {}
    for p in ps:
        b = int(np.digitize(p, edges) - 1)
        if 0 <= b < 10:
            expect[b] = expect.get(b, 0) + 1 / len(ps)
    assert set(got) == set(expect)
    for b in expect:
        assert math.isclose(got[b], expect[b])
    assert 2 in got and 5 in got  # 0.3 -> bin 2, 0.6 and 0.5 -> bin 5, 0.7 -> bin 6
