"""Numbers in prose and in JSON, and the buckets that pair them up."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_LIST_MARKER = "(?m)^\\s*\\d+\\.\\s+"
_PROSE_NUMBER = "(?<![A-Za-z0-9_-])(\\d[\\d,]*\\.?\\d*)(?![A-Za-z0-9_-])"
_JSON_STRING = "\"(?:[^\"\\\\]|\\\\.)*\""
_JSON_NUMBER = "(-?\\d+(?:\\.\\d+)?(?:[eE][+-]?\\d+)?)"

ABSOLUTE_TOLERANCE = 0.05
RELATIVE_TOLERANCE = 0.01
# Buckets are narrower than any tolerance interval, so no interval lies inside one.
_LINEAR_STEP, _LINEAR_END, _LOG_STEP = 0.04, 4.0, math.log(1.005)


def prose_numbers(text: Column) -> Column:
    """Every number stated in the text, list positions and digits inside ids left out."""
    found = F.regexp_extract_all(F.regexp_replace(text, _LIST_MARKER, ""), F.lit(_PROSE_NUMBER), F.lit(1))
    return F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit("")).cast("double"))


def json_numbers(payload: Column) -> Column:
    """Every numeric leaf of a JSON document, at any depth."""
    found = F.regexp_extract_all(F.regexp_replace(payload, _JSON_STRING, "\"\""), F.lit(_JSON_NUMBER), F.lit(1))
    return F.transform(found, lambda n: n.cast("double"))


def restatements(number: Column) -> Column:
    """The number itself, as a percentage, and as a fraction of a hundred."""
    return F.array(number, F.round(number * 100, 6), F.round(number / 100, 6))


def tolerance_interval(number: Column) -> tuple[Column, Column]:
    """Open interval of the known values that ground a non-negative number."""
    low = F.least(number - ABSOLUTE_TOLERANCE, number / (1 + RELATIVE_TOLERANCE))
    high = F.greatest(number + ABSOLUTE_TOLERANCE, number / (1 - RELATIVE_TOLERANCE))
    return low, high


def value_bucket(value: Column) -> Column:
    """A bucket number that never falls as the value grows."""
    linear = F.floor(value / _LINEAR_STEP)
    logarithmic = F.floor(F.ln(F.greatest(value, F.lit(_LINEAR_END)) / _LINEAR_END) / _LOG_STEP)
    return F.when(value < _LINEAR_END, linear).otherwise(F.lit(round(_LINEAR_END / _LINEAR_STEP)) + logarithmic).cast("long")
