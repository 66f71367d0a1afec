"""Payer-name similarity and bounded subset sums."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieout.vocab import SUBSET_CANDIDATES


@F.pandas_udf(T.DoubleType())
def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else SequenceMatcher(None, a, b).ratio()
                      for a, b in zip(left, right)])


def payer_similarity(left: Column, right: Column) -> Column:
    """Gestalt ratio of two names in [0, 1], case and outer spaces ignored.

    Spark has no such measure (edit distance is another one), hence a vectorised
    helper. Apply it to pairs that a join on other keys has already brought together.
    """
    return _ratio(F.trim(F.lower(left)), F.trim(F.lower(right)))


def subset_sum(targets: DataFrame, limit: int = SUBSET_CANDIDATES) -> DataFrame:
    """For (target, candidates array<struct<id, gross>>): the one subset that sums to the target.

    The first `limit` candidates are tried in all combinations; no subset or more than one gives
    null. The sums of all combinations come from doubling: every candidate appends the sums so far
    plus itself, so that a sum's place is the bit mask of its candidates. Amounts are positive.
    """
    sums = F.aggregate("tried", F.array(F.lit(0).cast("long")), lambda sums, c: F.concat(
        sums, F.transform(sums, lambda value: value + c["gross"])))
    hits = F.array_compact(F.transform("sums", lambda value, mask: F.when((mask > 0) & (value == F.col("target")), mask)))
    rows = targets.withColumn("tried", F.coalesce(F.slice("candidates", 1, limit), F.array().cast(
        targets.schema["candidates"].dataType)))
    rows = rows.withColumn("sums", sums).withColumn("found", hits)
    mask = F.try_element_at("found", F.lit(1))
    chosen = F.filter("tried", lambda c, i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1)
    ids = F.transform(chosen, lambda c: c["id"])
    return rows.withColumn("subset", F.when(F.size("found") == 1, ids)).withColumn(
        "solutions", F.size("found").cast("long")).drop("tried", "sums", "found")
