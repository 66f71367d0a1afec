"""Rules over several tables, checked in one pass.

Every row of a table gives one tagged key for each rule that concerns it; keys of all tables and rules meet in one
aggregate, which adds them up in each task before the shuffle, so a key that very many rows hold arrives as one row from each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Unique:
    """No two rows of the table have the same values; rows with a null among them do not count."""
    name: str
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Disjoint:
    """No value is in both columns, each given as (table, column); nulls are in neither."""
    name: str
    left: tuple[str, str]
    right: tuple[str, str]


@dataclass(frozen=True)
class Listed:
    """The column holds only the allowed values; a null is not one of them."""
    name: str
    table: str
    column: str
    allowed: tuple[str, ...]


Rule = Unique | Disjoint | Listed
_UNIQUE, _LEFT, _RIGHT, _UNLISTED = 1, 2, 4, 8


def _tags(rule: Rule, table: str) -> list[Column]:
    """(rule, key, side) columns, null where the row says nothing."""
    def tag(columns: Sequence[str], side: int, counts: Column) -> Column:
        key = F.to_json(F.array(*[F.col(c).cast("string") for c in columns]))
        return F.when(counts, F.struct(F.lit(rule.name).alias("rule"), key.alias("key"), F.lit(side).alias("side")))

    if isinstance(rule, Unique):
        held = reduce(Column.__and__, [F.col(c).isNotNull() for c in rule.columns])
        return [tag(rule.columns, _UNIQUE, held)] if rule.table == table else []
    if isinstance(rule, Listed):
        wrong = ~F.coalesce(F.col(rule.column).isin(*rule.allowed), F.lit(False))
        return [tag([rule.column], _UNLISTED, wrong)] if rule.table == table else []
    return [tag([column], side, F.col(column).isNotNull())
            for (where, column), side in ((rule.left, _LEFT), (rule.right, _RIGHT)) if where == table]


def breaches(tables: dict[str, DataFrame], rules: Sequence[Rule]) -> DataFrame:
    """(rule, key, rows): every key that breaks a rule, as a JSON list of its values, and how many rows hold it."""
    parts = []
    for name, rows in tables.items():
        tags = [t for rule in rules for t in _tags(rule, name)]
        if tags:
            parts.append(rows.select(F.inline(F.array_compact(F.array(*tags)))))
    if not parts:
        raise ValueError("no rule concerns any of the tables")
    keys = reduce(DataFrame.union, parts).groupBy("rule", "key").agg(
        F.count("*").alias("rows"), F.bit_or("side").alias("sides"))
    broken = ((F.col("sides") == _UNIQUE) & (F.col("rows") > 1)) | (F.col("sides") == _LEFT | _RIGHT) | (F.col("sides") == _UNLISTED)
    return keys.where(broken).select("rule", "key", "rows")
