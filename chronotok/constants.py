"""Fixed values of the tokenization scheme.

Everything in this module is a *fixed value* that must equal the original
scheme for results to match: special tokens, event types, token prefixes,
age bands, time-gap thresholds, category order and target-name variants.
They are stated once, plainly, in their natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the original tokenization scheme)
# ---------------------------------------------------------------------------

# Special tokens, ids 0..3 in this order.
SPECIAL_TOKENS = ["<PAD>", "<UNK>", "<EOS>", "<SOS>"]
PAD, UNK, EOS, SOS = SPECIAL_TOKENS

# Event types, in vocabulary order (ids 4..11 as EVENT_<TYPE>).
EVENT_TYPES = [
    "admission",
    "discharge",
    "condition",
    "medication",
    "procedure",
    "measurement",
    "observation",
    "death",
]

# Concept token prefix per clinical event type.
CONCEPT_PREFIX = {
    "condition": "CONDITION_OCCURRENCE_",
    "medication": "DRUG_EXPOSURE_",
    "procedure": "PROCEDURE_OCCURRENCE_",
    "measurement": "MEASUREMENT_",
    "observation": "OBSERVATION_",
}
CLINICAL_TYPES = list(CONCEPT_PREFIX)

# Tie-break rank of event types on equal timestamps (visit, condition, drug,
# procedure, measurement, observation, death; admission before discharge).
TABLE_RANK = {et: i for i, et in enumerate(EVENT_TYPES)}

# Age bands: 0-5, 5-10, ..., 95-100, then 100-120 (also the default band).
AGE_BAND_WIDTH = 5
AGE_BAND_LIMIT = 100
AGE_DEFAULT_BAND = "100-120"
AGE_BANDS = [f"{a}-{a + AGE_BAND_WIDTH}" for a in range(0, AGE_BAND_LIMIT, AGE_BAND_WIDTH)] + [
    AGE_DEFAULT_BAND
]
DEFAULT_AGE = 50  # used when the birth year is unknown

# Birth-year bands: 5-year bands anchored at 1970.
YEAR_BASE = 1970
YEAR_BAND_WIDTH = 5

# Time-gap labels and their lower thresholds in minutes, ascending.
TIME_INTERVALS = [
    ("5m", 5),
    ("15m", 15),
    ("1h", 60),
    ("3h", 180),
    ("6h", 360),
    ("12h", 720),
    ("1d", 1440),
    ("3d", 4320),
    ("1w", 10080),
    ("1m", 43200),
    ("3m", 129600),
    ("6m", 259200),
    ("1y", 525600),
]
MIN_GAP_MINUTES = 5
SIX_MONTHS_MINUTES = 259200
ONE_YEAR_MINUTES = 525600

# Decile tokens Q0..Q9 and the minimum number of values for a concept's cuts.
N_QUANTILES = 10
MIN_VALUES_FOR_QUANTILES = 10

# Vocabulary capacity (concepts fill what is left after the fixed groups).
VOCAB_SIZE = 50000
SHRUNK_VOCAB_SIZE = 30000

# Vocabulary report categories, first matching prefix wins, else OTHER.
CATEGORIES = [
    "EVENT_",
    "AGE_",
    "TIME_",
    "Q",
    "GENDER_",
    "RACE_",
    "YEAR_",
    "VISIT_TYPE_",
    "UNIT_",
    "CONDITION_",
    "DRUG_",
    "PROCEDURE_",
    "MEASUREMENT_",
    "OBSERVATION_",
]
OTHER_CATEGORY = "OTHER"

# Shrink: structural prefixes always kept (in this group order) and
# clinical prefixes that may be pruned.
ALWAYS_KEEP_PREFIXES = ["EVENT_", "AGE_", "TIME_", "Q", "GENDER_", "RACE_", "YEAR_", "VISIT_TYPE_", "UNIT_"]
PRUNABLE_PREFIXES = ["CONDITION_", "DRUG_", "PROCEDURE_", "MEASUREMENT_", "OBSERVATION_"]

# Target-name variants: short and long concept prefixes name the same target.
TARGET_VARIANTS = [
    ("CONDITION_", "CONDITION_OCCURRENCE_"),
    ("DRUG_", "DRUG_EXPOSURE_"),
    ("PROCEDURE_", "PROCEDURE_OCCURRENCE_"),
]

# Leading structural tokens skipped when labelling a generated sequence.
STRUCTURAL_LEADING_PREFIXES = ["AGE_", "GENDER_", "RACE_", "YEAR_"]

# Default split parameters.
SPLIT_SEED = 42
TRAIN_RATIO = 0.8
VALIDATION_RATIO = 0.9

# Number of events kept in a minimal history.
HISTORY_TAIL_EVENTS = 256

# Length buckets of the sequence-length report: (label, inclusive upper bound), then the rest.
LENGTH_BUCKETS = [("0-10", 10), ("10-20", 20), ("20-100", 100), ("100-200", 200), ("200-800", 800)]
LENGTH_BUCKET_REST = ">800"

# Number of calibration bins.
ECE_BINS = 10

# Top-token report: prefixes parsed as concept tokens (note UNIT_ is included).
REPORT_CONCEPT_PREFIXES = [
    "CONDITION_OCCURRENCE_",
    "DRUG_EXPOSURE_",
    "PROCEDURE_OCCURRENCE_",
    "MEASUREMENT_",
    "OBSERVATION_",
    "UNIT_",
]
REPORT_TOP_K = 1000

# Top-token report: readable labels for tokens without a concept name.
LABEL_EVENT = {
    "condition": "Medical Condition",
    "drug": "Medication",
    "procedure": "Medical Procedure",
    "measurement": "Lab Test/Measurement",
    "observation": "Clinical Observation",
    "visit": "Healthcare Visit",
    "death": "Death Event",
}
LABEL_AGE = {
    "0": "Age: 0-1 years",
    "1": "Age: 1-5 years",
    "5": "Age: 5-10 years",
    "10": "Age: 10-15 years",
    "15": "Age: 15-20 years",
    "20": "Age: 20-30 years",
    "30": "Age: 30-40 years",
    "40": "Age: 40-50 years",
    "50": "Age: 50-60 years",
    "60": "Age: 60-70 years",
    "70": "Age: 70-80 years",
    "80": "Age: 80+ years",
}
LABEL_TIME = {
    "0": "Time: Same day",
    "1": "Time: 1-6 months gap",
    "2": "Time: 6-12 months gap",
    "3": "Time: 1-2 years gap",
    "4": "Time: 2-5 years gap",
    "5": "Time: 5+ years gap",
}
LABEL_GENDER = {"0": "Unknown", "1": "Male", "2": "Female"}
LABEL_RACE = {
    "0": "Unknown",
    "1": "White",
    "2": "Black/African American",
    "3": "Asian",
    "4": "Hispanic/Latino",
    "5": "Other",
}
LABEL_YEAR = {
    "0": "Birth year: 2000+",
    "1": "Birth year: 1990-1999",
    "2": "Birth year: 1980-1989",
    "3": "Birth year: 1970-1979",
    "4": "Birth year: 1960-1969",
    "5": "Birth year: 1950-1959",
    "6": "Birth year: 1940-1949",
    "7": "Birth year: 1930-1939",
    "8": "Birth year: 1920-1929",
    "9": "Birth year: 1910-1919",
    "10": "Birth year: 1900-1909",
}
LABEL_VISIT = {
    "0": "Unknown",
    "1": "Inpatient",
    "2": "Outpatient",
    "3": "Emergency",
    "4": "Urgent Care",
    "5": "Primary Care",
}
LABEL_UNIT = {
    "0": "Unknown unit",
    "1": "mg/dL",
    "2": "mmol/L",
    "3": "mg/L",
    "4": "ng/mL",
    "5": "pg/mL",
    "6": "U/L",
    "7": "mEq/L",
    "8": "mmHg",
    "9": "bpm",
    "10": "kg",
    "11": "cm",
    "12": "Fahrenheit",
    "13": "Celsius",
    "14": "inches",
    "15": "pounds",
    "16": "percent",
    "17": "ratio",
}
LABEL_QUANTILE = {
    0: "Quantile: Minimum (0th percentile)",
    25: "Quantile: 25th percentile",
    50: "Quantile: Median (50th percentile)",
    75: "Quantile: 75th percentile",
    100: "Quantile: Maximum (100th percentile)",
}


def time_label_minutes() -> dict[str, int]:
    """TIME_<label> -> minutes."""
    return {f"TIME_{label}": m for label, m in TIME_INTERVALS}


def fixed_vocab_tokens() -> list[str]:
    """Tokens with fixed ids 0..55: specials, events, ages, times, deciles."""
    return (
        SPECIAL_TOKENS
        + [f"EVENT_{et.upper()}" for et in EVENT_TYPES]
        + [f"AGE_{b}" for b in AGE_BANDS]
        + [f"TIME_{label}" for label, _ in TIME_INTERVALS]
        + [f"Q{i}" for i in range(N_QUANTILES)]
    )


# Hierarchical code systems: characters of each level of a code, 0 for all that is left.
CODE_LEVELS = {
    "ATC": [3, 1, 0],
    "ICD10CM": [3, 2, 0],
    "ICD10PCS": [1, 1, 1, 1, 1, 1, 0],
}
