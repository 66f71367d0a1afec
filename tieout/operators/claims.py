"""Give each record to at most one proposal, in proposal order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.operators.components import components
from tieout.session import materialize


def contested_records(claims: DataFrame) -> DataFrame:
    """Records that more than one proposal asks for; `claims` is (prop, kind, id)."""
    return (claims.groupBy("kind", "id").agg(F.min("prop").alias("first"), F.max("prop").alias("last"))
            .filter("first < last"))


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Proposals in order, one component after the other; only the component's taken records are held."""
    component, prop = None, None
    taken: set[tuple[str, str]] = set()
    asked: set[tuple[str, str]] = set()
    for rows in batches:
        lost = []
        for row in rows.itertuples(index=False):
            if row.prop != prop:
                if prop is not None and asked & taken:
                    lost.append(prop)
                else:
                    taken |= asked
                prop, asked = row.prop, set()
            if row.component != component:
                component, taken = row.component, set()
            asked.add((row.kind, row.id))
        yield pd.DataFrame({"prop": pd.Series(lost, dtype="int64")})
    if prop is not None and asked & taken:
        yield pd.DataFrame({"prop": pd.Series([prop], dtype="int64")})


def rejected_proposals(claims: DataFrame, valid: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(prop) of the `valid` proposals that lose a record to an earlier accepted one.

    Equals walking the proposals in order: a proposal is accepted when no accepted one before it
    holds any of its records. `held` are records (kind, id) with an owner from before; whoever asks
    for one loses at once. Of the rest only contested records can decide, and they tie proposals into
    components that don't touch each other. Components are found by stars, in a number of rounds that
    grows with the logarithm of the longest chain, and walked side by side, sorted, in a stream: a task
    holds the records taken in the component it is in, never the component's rows.
    """
    lost = claims.limit(0).select("prop")
    if held is not None:
        lost = materialize(claims.join(held, ["kind", "id"], "left_semi").select("prop").distinct()
                           .join(valid.select("prop"), "prop", "left_semi"), "lost")
        valid = valid.join(lost, "prop", "left_anti")
    # Written, so that their number is known: few are broadcast and the claims stay where they lie.
    contested = materialize(contested_records(claims).select("kind", "id"), "contested_records")
    # Validity is applied to the few contested rows, not to all claims.
    asked = claims.join(contested, ["kind", "id"]).join(valid.select("prop"), "prop", "left_semi")
    asked = materialize(asked.select("prop", "kind", "id").distinct(), "contested")
    first = asked.groupBy("kind", "id").agg(F.min("prop").alias("first"))
    ties = components(asked.join(first, ["kind", "id"]).select(F.col("prop").alias("a"), F.col("first").alias("b")))
    tied = asked.join(ties, F.col("prop") == F.col("node")).select("component", "prop", "kind", "id")
    walked = tied.repartition("component").sortWithinPartitions("component", "prop").mapInPandas(_walk, "prop bigint")
    return lost.unionByName(walked)
