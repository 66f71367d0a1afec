"""Which source column holds which canonical field."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieout.functions.text import header_signature
from tieout.session import materialize

# Accepted header names per field, best first (fixed values).
FIELD_HEADERS: dict[str, dict[str, tuple[str, ...]]] = {
    "ledger": {
        "id": ("invoice id", "invoice no", "invoice number", "inv id", "inv no", "bill no", "bill number",
               "document no", "document number"),
        "ref": ("invoice ref", "reference", "reference no", "ref", "ref no"),
        "customer": ("customer name", "customer", "party name", "party", "client", "client name", "buyer",
                     "billed to", "vendor"),
        "amount": ("amount due", "invoice amount", "invoice value", "amount", "total amount", "total", "value",
                   "gross amount"),
        "issued_at": ("invoice date", "issue date", "issued at", "issued on", "bill date", "date"),
        "number": ("invoice number", "number"),
    },
    "gateway": {
        "id": ("payment id", "razorpay payment id", "gateway payment id", "transaction id", "txn id"),
        "order_id": ("order id", "receipt", "receipt no"),
        "invoice_ref": ("invoice ref", "invoice id", "invoice no", "invoice number", "invoice"),
        "gross": ("amount captured", "captured amount", "gross amount", "gross", "payment amount", "amount"),
        "fee": ("gateway fee", "fee", "fees", "mdr", "commission"),
        "tax": ("gst on fee", "tax on fee", "gst", "tax", "service tax"),
        "net": ("net amount", "amount settled", "net"),
        "status": ("payment status", "status", "state"),
        "captured_at": ("payment date", "captured at", "capture date", "created at", "transaction date", "date"),
        "method": ("payment method", "payment mode", "method", "mode", "instrument"),
        "settlement_id": ("settlement id", "payout id", "batch id"),
    },
    "settlement": {
        "id": ("settlement id", "payout id", "batch id"),
        "utr": ("utr number", "utr no", "utr", "bank reference", "bank ref", "rrn"),
        "payout": ("net payout", "net amount", "amount credited", "settlement amount", "payout amount", "payout"),
        "fees": ("gateway fee", "settlement fee", "fees", "fee", "commission", "mdr"),
        "tax": ("gst on fee", "tax on fee", "gst", "tax"),
        "adjustments": ("adjustments", "adjustment", "adjustment amount"),
        "settled_at": ("settlement date", "settled at", "payout date", "credit date", "value date", "date"),
        "payment_ids": ("payment ids", "payment refs", "payment ref", "payment id", "payments",
                        "payment references"),
    },
    "bank": {
        "id": ("txn id", "transaction id", "reference id", "sl no", "serial no", "s no"),
        "value_date": ("value date", "transaction date", "txn date", "posting date", "book date", "date"),
        "narration": ("narration", "description", "particulars", "remarks", "details", "transaction remarks",
                      "reference no", "ref no"),
        "credit": ("credit amount", "credit", "deposit", "deposits", "amount credited", "cr", "amount"),
        "debit": ("debit amount", "debit", "withdrawal", "withdrawals", "amount debited", "dr"),
        "balance": ("closing balance", "running balance", "balance", "available balance"),
    },
}
# Headers with nothing to reconcile (fixed values).
IGNORED_HEADERS: dict[str, tuple[str, ...]] = {
    "ledger": ("currency", "status", "due date", "notes", "gst", "tax", "sr no", "s no", "serial no"),
    "gateway": ("currency", "customer name", "customer", "email", "contact", "phone", "notes", "description",
                "card network", "bank"),
    "settlement": ("currency", "status", "notes", "type"),
    "bank": ("type", "cr dr", "dr cr", "transaction type", "cheque no", "branch", "currency"),
}


def plain_header(header: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in header.lower()).split())


def map_headers(role: str, headers: list[str]) -> dict[str, str | None]:
    """What the lexicon is sure of; a header missing from the result is unresolved.

    A field takes its best-placed free header, a header serves one field.
    """
    plain = {header: plain_header(header) for header in headers}
    resolved: dict[str, str | None] = {}
    for field, names in FIELD_HEADERS[role].items():
        free = [h for name in names for h in headers if plain[h] == name and h not in resolved]
        if free:
            resolved[free[0]] = field
    for header in headers:
        if plain[header] in IGNORED_HEADERS[role]:
            resolved.setdefault(header, None)
    return resolved


_MAPPED = T.ArrayType(T.StructType([T.StructField("field", T.StringType()),
                                    T.StructField("resolved", T.BooleanType())]))


@F.pandas_udf(_MAPPED)
def _mapped(roles: pd.Series, headers: pd.Series) -> pd.Series:
    out = []
    for role, names in zip(roles, headers):
        known = map_headers(role, list(names))
        out.append([{"field": known.get(name), "resolved": name in known} for name in names])
    return pd.Series(out)


def map_shapes(files: DataFrame, proposals: DataFrame | None = None) -> DataFrame:
    """(role, signature, fields): a canonical field or null for each header of each distinct shape.

    `files` is (path, role, headers). `proposals` (role, signature, header, field, ord) may
    fill what the lexicon leaves open, each free field once and in order.
    """
    shapes = files.select("role", header_signature(F.col("headers")).alias("signature"), "headers").groupBy(
        "role", "signature").agg(F.min("headers").alias("headers"))
    mapped = shapes.withColumn("mapped", _mapped("role", "headers"))
    lone = mapped.select("role", "signature", F.posexplode("mapped").alias("at", "m"), "headers").select(
        "role", "signature", "at", F.get("headers", F.col("at")).alias("header"), "m.field", "m.resolved")
    if proposals is not None:
        lone = materialize(lone, "shapes")  # read three times
        taken = lone.filter("field is not null").select("role", "signature", "field")
        wanted = proposals.join(lone.filter("not resolved").select("role", "signature", "header", "at"),
                                ["role", "signature", "header"]).filter("field is not null")
        free = wanted.join(taken, ["role", "signature", "field"], "left_anti")
        won = free.groupBy("role", "signature", "field").agg(F.min_by("at", "ord").alias("at"))
        won = won.select("role", "signature", "at", F.col("field").alias("proposed"))
        lone = lone.join(won, ["role", "signature", "at"], "left").withColumn(
            "field", F.coalesce("field", "proposed"))
    # As many rows per shape as the shape has columns.
    ordered = F.array_sort(F.collect_list(F.struct("at", "field")))
    return lone.groupBy("role", "signature").agg(F.transform(ordered, lambda s: s["field"]).alias("fields"))


def mapped_rows(rows: DataFrame, files: DataFrame, shapes: DataFrame) -> DataFrame:
    """Adds to each row (path, row_number, values) its role and a map of canonical fields."""
    keyed = files.select("path", "role", header_signature(F.col("headers")).alias("signature")).join(
        shapes, ["role", "signature"]).select("path", "role", "fields")
    pairs = F.filter(F.arrays_zip(F.col("fields"), F.col("values")), lambda p: p["fields"].isNotNull())
    return rows.join(keyed, "path").select(
        "path", "role", "row_number", F.map_from_entries(pairs).alias("fields"))


def field(name: str) -> Column:
    return F.try_element_at(F.col("fields"), F.lit(name))
