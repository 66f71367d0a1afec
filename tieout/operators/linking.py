"""Tie settlements to bank lines by reference and exact amount."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.functions.narration import canonical_utr, utrs
from tieout.model import Books
from tieout.operators.joins import spread_nulls
from tieout.vocab import BANK_CREDIT_WINDOW_DAYS

LINKED, LATE, AMBIGUOUS, UNMATCHED = "linked", "late", "ambiguous", "unmatched"


def line_references(lines: DataFrame) -> DataFrame:
    """(bank_utr, ...): a line's columns once for each reference in its narration."""
    return lines.select(F.explode(F.transform(utrs(F.col("narration")), canonical_utr)).alias("bank_utr"), "*")


def bank_references(books: Books) -> DataFrame:
    """(utr, credit) with how many index entries carry it, and the line if there is one.

    Entries are counted before the join, so a reference repeated on very many
    lines reaches the join as one row and never fans out.
    """
    tokens = books.bank_lines.select("id", F.explode(utrs(F.col("narration"))).alias("token"), "credit", "value_date")
    if not books.unique_ids:
        tokens = tokens.select("id", "token").join(books.indexed("bank_line").select("id", "credit", "value_date"), "id")
    return (tokens.groupBy(canonical_utr(F.col("token")).alias("bank_utr"), "credit")
            .agg(F.count("*").alias("entries"), F.min("id").alias("bank_line_id"),
                 F.min("value_date").alias("value_date")))


def link_settlements(books: Books, window_days: int = BANK_CREDIT_WINDOW_DAYS) -> DataFrame:
    """Every settlement with its link status, and the line where exactly one qualifies."""
    settlements = books.indexed("settlement")
    cited = settlements.withColumn("own_utr", spread_nulls(
        F.when(F.coalesce(F.col("utr"), F.lit("")) != "", canonical_utr(F.col("utr"))), "id"))
    references = bank_references(books)
    joined = cited.join(
        references, (cited.own_utr == references.bank_utr) & (cited.payout == references.credit), "left")
    single = F.col("entries") == 1
    late = F.abs(F.datediff("value_date", "settled_at")) > window_days
    status = (F.when(F.col("entries").isNull(), UNMATCHED).when(~single, AMBIGUOUS)
              .when(late, LATE).otherwise(LINKED))
    return joined.select(
        F.col("id").alias("settlement_id"), "ord", "utr", "payout", "fees", "tax", "adjustments", "settled_at",
        status.alias("link_status"),
        F.when(single, F.col("bank_line_id")).alias("bank_line_id"),
        F.coalesce("entries", F.lit(0)).cast("long").alias("candidates"))
