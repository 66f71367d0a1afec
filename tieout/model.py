"""The four record sets and the answer key, as DataFrames.

Settlement membership is a bridge table, one row per (settlement, payment), so a
settlement with a very large share of the payments is many rows and not one
huge array. Every record carries `ord`, its position in the input.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INVOICE = "id string, number string, customer string, amount bigint, issued_at date, ref string, ord bigint"
PAYMENT = ("id string, order_id string, invoice_ref string, gross bigint, fee bigint, tax bigint, net bigint, "
           "status string, captured_at timestamp_ntz, method string, settlement_id string, ord bigint")
SETTLEMENT = ("id string, utr string, payout bigint, fees bigint, tax bigint, adjustments bigint, settled_at date, "
              "ord bigint")
MEMBERSHIP = "settlement_id string, payment_id string, pos bigint"
BANK_LINE = ("id string, value_date date, narration string, credit bigint, debit bigint, balance bigint, "
             "ord bigint")
PROPOSAL = ("settlement_id string, proposal_ord int, bank_line_id string, confidence double, "
            "evidence_spans array<string>")


def latest_by_id(records: DataFrame) -> DataFrame:
    """One row per id: the last record's values at the first record's position.

    An aggregate, not a window: copies of one id combine before the shuffle.
    """
    values = [c for c in records.columns if c not in ("id", "ord")]
    return (records.groupBy("id")
            .agg(F.max_by(F.struct(*values), "ord").alias("last"), F.min("ord").alias("ord"))
            .select("id", *[F.col(f"last.{c}").alias(c) for c in values], "ord"))


@dataclass(frozen=True)
class Books:
    invoices: DataFrame
    payments: DataFrame
    settlements: DataFrame
    membership: DataFrame
    bank_lines: DataFrame
    # Set when ids are known to be unique, e.g. after `duplicate_ids` came back empty.
    unique_ids: bool = False

    @classmethod
    def from_records(cls, invoices: DataFrame, payments: DataFrame, settlements: DataFrame,
                     bank_lines: DataFrame, unique_ids: bool = False) -> "Books":
        """From canonical records, where a settlement lists its payments in an array."""
        records = settlements if unique_ids else latest_by_id(settlements)
        bridge = records.select(
            F.col("id").alias("settlement_id"), F.posexplode("payment_ids").alias("pos", "payment_id"))
        return cls(invoices, payments, settlements.drop("payment_ids"),
                   bridge.select("settlement_id", "payment_id", F.col("pos").cast("long")), bank_lines, unique_ids)

    def records(self, kind: str) -> DataFrame:
        return {"invoice": self.invoices, "payment": self.payments,
                "settlement": self.settlements, "bank_line": self.bank_lines}[kind]

    def indexed(self, kind: str) -> DataFrame:
        """One row per id."""
        return self.records(kind) if self.unique_ids else latest_by_id(self.records(kind))

    def replaced(self, **changes: DataFrame) -> "Books":
        return replace(self, **changes)


AMOUNT_OF = {"invoice": "amount", "payment": "gross", "settlement": "payout", "bank_line": "credit"}


def duplicate_ids(books: Books) -> DataFrame:
    """Ids that occur more than once, per kind."""
    parts = [books.records(kind).groupBy("id").agg(F.count("*").alias("copies")).filter("copies > 1")
             .select(F.lit(kind).alias("kind"), "id", "copies") for kind in AMOUNT_OF]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@dataclass(frozen=True)
class AnswerKey:
    """`groups`: settlement_id, bank_line_id; `members`: group_id, kind, id for invoices
    and payments; `records`: kind, id, group_id (or `unmatchable`), difficulty."""
    groups: DataFrame
    members: DataFrame
    records: DataFrame
