"""Join keys that spread."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spread_nulls(key: Column, *row: str) -> Column:
    """The key, or where it is null one of the row's own that no other table holds.

    In a left join all rows with a null key would meet in one task, though none of them can match.
    `row` names the columns that tell rows apart.
    """
    return F.coalesce(key, F.concat(F.lit("\0"), F.xxhash64(*row).cast("string")))
