"""Row numbers and running sums over one global order, without one task holding it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tieout.session import materialize

_PART = "__part"


def _ranged(rows: DataFrame, order: list[str], parts: int | None) -> DataFrame:
    """Rows cut into ranges of the order, written once so the cuts stay as they are."""
    cut = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    return materialize(cut.withColumn(_PART, F.spark_partition_id()), "ranged")


def running_sum(rows: DataFrame, order: list[str], value: Column, name: str, parts: int | None = None) -> DataFrame:
    """Adds the sum of `value` up to and including each row.

    A sum inside each range plus the totals of the ranges before it. `order` should
    end in a unique column, so that ties cannot pile up in one range.
    """
    ranged = _ranged(rows.withColumn("__value", value), order, parts)
    totals = ranged.groupBy(_PART).agg(F.sum("__value").alias("total"))
    # One row per range: this window sees a few hundred rows at most.
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(_PART, F.coalesce(F.sum("total").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(_PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (ranged.withColumn("__run", F.sum("__value").over(inside)).join(F.broadcast(offsets), _PART)
            .withColumn(name, (F.col("__run") + F.col("__before")).cast("long"))
            .drop(_PART, "__value", "__run", "__before"))


def with_ordinals(rows: DataFrame, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """Adds 1, 2, 3, ... in the given order."""
    return running_sum(rows, order, F.lit(1).cast("long"), name, parts)


def running_balance(bank_lines: DataFrame, opening: int = 0) -> DataFrame:
    """Statement balance after each line, by value date and then input order."""
    moved = running_sum(bank_lines, ["value_date", "id"], F.col("credit") - F.col("debit"), "balance_after")
    return moved.withColumn("balance", F.col("balance_after") + opening).drop("balance_after")
