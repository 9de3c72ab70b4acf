"""Column expressions of the tokenization scheme.

All are built-in Catalyst expressions, so they stay inside whole-stage
codegen; none needs a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def concept_token(et, cid) -> Column:
    """``<PREFIX><cid>`` for the five clinical event types, else NULL."""
    et, cid = _c(et), _c(cid)
    expr = None
    for name, prefix in K.CONCEPT_PREFIX.items():
        branch = F.concat(F.lit(prefix), cid.cast("string"))
        expr = F.when(et == name, branch) if expr is None else expr.when(et == name, branch)
    return expr


def event_token(et) -> Column:
    """``EVENT_<ET>``."""
    return F.concat(F.lit("EVENT_"), F.upper(_c(et)))


def age_band(age) -> Column:
    """five-year band for 0 <= age < 100, else the default band (also negatives)."""
    age = _c(age)
    lo = (F.floor(age / K.AGE_BAND_WIDTH) * K.AGE_BAND_WIDTH).cast("bigint")
    return F.when(
        (age >= 0) & (age < K.AGE_BAND_LIMIT),
        F.concat(lo.cast("string"), F.lit("-"), (lo + K.AGE_BAND_WIDTH).cast("string")),
    ).otherwise(F.lit(K.AGE_DEFAULT_BAND))


def age_at(as_of_year, birth_year) -> Column:
    """``as_of_year - birth_year``; the default age when the birth year is unknown."""
    by = _c(birth_year)
    return F.when(by.isNull(), F.lit(K.DEFAULT_AGE)).otherwise(_c(as_of_year) - by)


def age_at_index(index_ts, birth_year) -> Column:
    """F4 at an index time: ``max(0, year(index) - birth_year)``, default when unknown."""
    by = _c(birth_year)
    return F.when(by.isNull(), F.lit(K.DEFAULT_AGE)).otherwise(F.greatest(F.lit(0), F.year(_c(index_ts)) - by))


def year_band(birth_year) -> Column:
    """``1970 + floor((y - 1970) / 5) * 5`` .. ``+5``; ``None`` label when unknown."""
    y = _c(birth_year)
    start = (F.lit(K.YEAR_BASE) + F.floor((y - K.YEAR_BASE) / K.YEAR_BAND_WIDTH) * K.YEAR_BAND_WIDTH).cast("bigint")
    return F.when(y.isNull(), F.lit("None")).otherwise(
        F.concat(start.cast("string"), F.lit("-"), (start + K.YEAR_BAND_WIDTH).cast("string"))
    )


def decile_index(value, cuts) -> Column:
    """first i with ``value <= cuts[i]``; above the last cut falls back to 0."""
    n_below = F.size(F.filter(_c(cuts), lambda c: c < _c(value)))
    return F.when(n_below >= K.N_QUANTILES, F.lit(0)).otherwise(n_below)


def wall_micros(ts) -> Column:
    """Microseconds of a wall-clock timestamp since 1970-01-01 00:00, from its own fields.

    ``timestampdiff`` reads both sides in the session time zone, where an hour may be missing
    or come twice; the fields of a TIMESTAMP_NTZ do not depend on it."""
    t = _c(ts).cast("timestamp_ntz")
    seconds = F.unix_date(t.cast("date")).cast("bigint") * 86_400 + F.hour(t) * 3_600 + F.minute(t) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("bigint")


def gap_minutes(prev_ts, ts) -> Column:
    """Minutes between two wall-clock timestamps (NULL when either is NULL)."""
    return (wall_micros(ts) - wall_micros(prev_ts)) / 60_000_000.0


def gap_tokens(minutes, entry=F.lit) -> Column:
    """time-gap tokens before an event, each as the column ``entry(token)`` (the token itself by default).

    none below 5 minutes (or NULL); above one year ``max(2, round_half_even(m / 6 months))``
    times ``TIME_6m``; otherwise the largest threshold not above the gap.
    """
    m = _c(minutes)
    single = None
    for label, threshold in reversed(K.TIME_INTERVALS):
        tok = F.array(entry(f"TIME_{label}"))
        single = F.when(m >= threshold, tok) if single is None else single.when(m >= threshold, tok)
    n6 = F.greatest(F.lit(2), F.bround(m / K.SIX_MONTHS_MINUTES, 0).cast("int"))
    empty = F.slice(F.array(entry("TIME_6m")), 1, 0)
    return (
        F.when(m.isNull() | (m < K.MIN_GAP_MINUTES), empty)
        .when(m > K.ONE_YEAR_MINUTES, F.array_repeat(entry("TIME_6m"), n6))
        .otherwise(single.otherwise(empty))
    )


def time_token_minutes(token) -> Column:
    """F8: minutes of a ``TIME_*`` token, 0 for any other token."""
    t = _c(token)
    expr = None
    for label, minutes in K.TIME_INTERVALS:
        expr = F.when(t == f"TIME_{label}", F.lit(minutes)) if expr is None else expr.when(t == f"TIME_{label}", F.lit(minutes))
    return expr.otherwise(F.lit(0))


def token_category(token) -> Column:
    """first matching category prefix, else OTHER."""
    t = _c(token)
    expr = None
    for cat in K.CATEGORIES:
        expr = F.when(t.startswith(cat), F.lit(cat)) if expr is None else expr.when(t.startswith(cat), F.lit(cat))
    return expr.otherwise(F.lit(K.OTHER_CATEGORY))


def target_variants(token) -> Column:
    """distinct names of one target: a long prefix also gives the short name and
    a short prefix also gives the long name (both rules apply independently)."""
    t = _c(token)
    names = [t]
    for short, long_ in K.TARGET_VARIANTS:
        names.append(F.when(t.startswith(long_), F.regexp_replace(t, "^" + long_, short)))
        names.append(F.when(t.startswith(short), F.regexp_replace(t, "^" + short, long_)))
    return F.array_distinct(F.array_compact(F.array(*names)))


def is_structural_leading(token) -> Column:
    """P25: AGE_/GENDER_/RACE_/YEAR_ tokens (or unknown) that may lead a generated sequence."""
    t = _c(token)
    cond = t.isNull()
    for p in K.STRUCTURAL_LEADING_PREFIXES:
        cond = cond | t.startswith(p)
    return cond
