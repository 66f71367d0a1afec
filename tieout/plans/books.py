"""Reconciliation books derived from an orders table.

Every order is an invoice; payments, settlement batches of twelve orders and bank
lines follow from it by fixed rules, with refunds, duplicates, missing references,
late credits and broken batches at known places. No randomness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.functions.money import payment_economics
from tieout.model import AnswerKey, Books
from tieout.session import materialize, spread
from tieout.vocab import UNMATCHABLE

BATCH = 12


def _id(prefix: str, number: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def orders(spark: SparkSession, sf_dir: str, even: bool = True) -> DataFrame:
    """One row per order: `k`, its batch `b`, the amount in paise and the issue date.

    `even` spreads a table that is too small to be cut; a run shuffles by its own keys
    at once and does without.
    """
    k = F.col("o_orderkey")
    source = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    return (spread(source, "o_orderkey") if even else source).select(
        k.alias("k"), F.floor(k / BATCH).cast("long").alias("b"), "o_custkey",
        F.round(F.col("o_totalprice") * 100).cast("long").alias("amount"),
        F.date_add(F.lit("2024-01-08").cast("date"), (k % 500).cast("int")).alias("issued_at"))


def invoices(spark: SparkSession, sf_dir: str, named: bool = False, even: bool = True) -> DataFrame:
    k = F.col("k")
    base = orders(spark, sf_dir, even)
    if named:
        customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
        base = base.join(customers, base.o_custkey == customers.c_custkey, "left")
    else:
        base = base.withColumn("c_name", F.lit(None).cast("string"))
    ref = F.when(k % 40 == 7, F.lit(None)).when(k % 97 == 3, _id("INV", k - 1, 9)).otherwise(_id("INV", k, 9))
    return base.select(
        _id("INV", k, 9).alias("id"), _id("INV/2024-25/", k, 9).alias("number"), F.col("c_name").alias("customer"),
        "amount", "issued_at", ref.alias("ref"), k.alias("ord"))


def payments(spark: SparkSession, sf_dir: str, even: bool = True) -> DataFrame:
    k = F.col("k")
    method = F.element_at(F.array(*[F.lit(m) for m in ("upi", "card", "netbanking", "wallet")]),
                          (k % 4 + 1).cast("int"))
    base = orders(spark, sf_dir, even).filter(k % 50 != 11).withColumn("method", method)
    fee, tax, _ = payment_economics(F.col("amount"), F.col("method"))
    base = base.withColumn("fee", fee)
    base = base.withColumn("tax", payment_economics(F.col("amount"), F.col("method"))[1])
    ref = (F.when((k % 40).isin(7, 13), F.lit(None)).when((k % 241 == 9) & (k >= 12), _id("INV", k - 12, 9))
           .otherwise(_id("INV", k, 9)))
    status = (F.when(k % 37 == 5, "refunded").when(k % 41 == 6, "disputed").when(k % 53 == 8, "failed")
              .otherwise("captured"))
    copies = F.when(k % 31 == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = base.select("*", F.explode(copies).alias("copy"))
    first = F.col("copy") == 0
    return rows.select(
        F.when(first, _id("pay_", k, 9)).otherwise(_id("payd_", k, 9)).alias("id"),
        F.lit(None).cast("string").alias("order_id"), ref.alias("invoice_ref"), F.col("amount").alias("gross"),
        "fee", "tax", (F.col("amount") - F.col("fee") - F.col("tax")).alias("net"), status.alias("status"),
        F.date_add("issued_at", (k % 3).cast("int")).cast("timestamp_ntz").alias("captured_at"), "method",
        F.when(first & (k % 29 != 4), _id("STL", F.col("b"), 6)).alias("settlement_id"),
        (k * 2 + F.col("copy")).alias("ord"))


def membership(payment_rows: DataFrame) -> DataFrame:
    return (payment_rows.filter("settlement_id is not null")
            .select("settlement_id", F.col("id").alias("payment_id"), F.col("ord").alias("pos")))


def settlements(payment_rows: DataFrame) -> DataFrame:
    gross, fee, tax = F.sum("gross"), F.sum("fee"), F.sum("tax")
    reversed_gross = F.sum(F.when(F.col("status").isin("refunded", "disputed"), F.col("gross")).otherwise(0))
    totals = payment_rows.filter("settlement_id is not null").groupBy("settlement_id").agg(
        gross.alias("gross"), fee.alias("fees"), tax.alias("tax"), reversed_gross.alias("reversed"),
        F.date_add(F.max(F.to_date("captured_at")), 2).alias("settled_at"))
    b = F.col("b")
    totals = totals.withColumn("b", F.substring("settlement_id", 4, 20).cast("long"))
    totals = totals.withColumn("adjustments", F.when(b % 5 == 0, F.lit(-250)).otherwise(0).cast("long"))
    payout = (F.col("gross") - F.col("fees") - F.col("tax") - F.col("reversed") + F.col("adjustments")
              + F.when(b % 23 == 9, 100).otherwise(0))
    utr = F.when(b % 47 != 0, _id("UTR", F.lit(100000000000) + b * 7919, 12))
    return totals.select(F.col("settlement_id").alias("id"), utr.alias("utr"), payout.alias("payout"), "fees", "tax",
                         "adjustments", "settled_at", b.alias("ord"))


def bank_lines(settlement_rows: DataFrame) -> DataFrame:
    b = F.col("ord")
    digits, batch = F.expr("substring(utr, 4)"), b.cast("string")
    narration = (
        F.when((b % 17 == 5) | F.col("utr").isNull(),
               F.concat(F.lit("BY TRANSFER FROM RAZORPAY SOFTWARE PVT LTD BATCH "), batch))
        .when(b % 4 == 0, F.concat(F.lit("NEFT CR-HDFC00012-RAZORPAY SOFTWARE PVT LTD-UTR "), digits,
                                   F.lit("-RAZORPAY SETTLEMENT")))
        .when(b % 4 == 1, F.concat(F.lit("BY TRANSFER-IMPS*ICIC*UTR"), digits, F.lit("*RAZORPAY SOFTWARE PVT LTD")))
        .when(b % 4 == 2, F.concat(F.lit("RTGS/SBIN00450/UTR NO "), digits, F.lit("/RAZORPAY PAYOUT "), batch))
        .otherwise(F.concat(F.lit("  neft  CR   utr:  "), F.lower(digits), F.lit("   RAZORPAY  "))))
    rows = settlement_rows.filter(b % 19 != 3).select(
        b.alias("b"), narration.alias("text"),
        F.date_add("settled_at", F.when(b % 13 == 4, F.lit(45)).otherwise(b % 3).cast("int")).alias("value_date"),
        (F.col("payout") - F.when(b % 59 == 20, 150000).otherwise(0)).alias("amount"))
    b = F.col("b")
    kinds = F.array_compact(F.array(F.lit("BNK"), F.when(b % 43 == 10, "BNKD"), F.when(b % 25 == 6, "BNKX")))
    rows = rows.select("*", F.explode(kinds).alias("prefix"))
    stray = F.col("prefix") == "BNKX"
    rank = F.when(F.col("prefix") == "BNK", 0).when(F.col("prefix") == "BNKD", 1).otherwise(2)
    return rows.select(
        F.concat("prefix", F.lpad(b.cast("string"), 6, "0")).alias("id"), "value_date",
        F.when(stray, F.concat(F.lit("MISC CREDIT NOT IDENTIFIED REF "), b.cast("string")))
        .otherwise(F.col("text")).alias("narration"),
        F.when(stray, 250000 + b).otherwise(F.col("amount")).alias("credit"),
        F.lit(0).cast("long").alias("debit"), F.lit(0).cast("long").alias("balance"), (b * 3 + rank).alias("ord"))


def books(spark: SparkSession, sf_dir: str, named: bool = False) -> Books:
    paid = payments(spark, sf_dir, even=False)
    batches = settlements(paid)
    return Books(invoices(spark, sf_dir, named, even=False), paid, batches, membership(paid), bank_lines(batches),
                 unique_ids=True)


def stored_books(spark: SparkSession, sf_dir: str) -> Books:
    """The same books as tables; settlements and bank lines are made from the stored payments, not from the orders again."""
    billed = materialize(invoices(spark, sf_dir, even=False), "invoices")
    paid = materialize(payments(spark, sf_dir, even=False), "payments")
    batches = materialize(settlements(paid), "settlements")
    return Books(billed, paid, batches, materialize(membership(paid), "membership"),
                 materialize(bank_lines(batches), "bank_lines"), unique_ids=True)


def answer_key(source: Books) -> AnswerKey:
    """Which records belong together, and how hard each was made on purpose."""
    lines = source.bank_lines.filter(F.col("id").rlike("^BNK[0-9]")).select(
        F.concat(F.lit("STL"), F.substring("id", 4, 20)).alias("line_of"), F.col("id").alias("bank_line_id"))
    groups = (source.settlements.join(lines, F.col("id") == F.col("line_of"), "left")
              .select(F.col("id").alias("settlement_id"), "bank_line_id"))
    paid = source.payments.filter("settlement_id is not null")
    own_invoice = F.concat(F.lit("INV"), F.substring("id", 5, 20))
    members = paid.select(F.col("settlement_id").alias("group_id"), F.lit("payment").alias("kind"), "id").unionByName(
        paid.select(F.col("settlement_id").alias("group_id"), F.lit("invoice").alias("kind"), own_invoice.alias("id")))

    k, b = F.col("k"), F.floor(F.col("k") / BATCH)
    invoice_key = source.invoices.select("id", F.col("ord").alias("k")).select(
        F.lit("invoice").alias("kind"), "id",
        F.when((k % 50 == 11) | (k % 29 == 4), UNMATCHABLE).otherwise(_id("STL", b, 6)).alias("group_id"),
        F.when((k % 50 == 11) | (k % 29 == 4), UNMATCHABLE).when(k % 37 == 5, "refund_in_batch")
        .when(k % 41 == 6, "chargeback").when(b % 13 == 4, "date_outside_window")
        .when(b % 17 == 5, "narration_missing_utr").otherwise("clean").alias("difficulty"))
    copied = F.col("id").startswith("payd_")
    payment_key = source.payments.select(
        F.lit("payment").alias("kind"), "id",
        F.when(copied | F.col("settlement_id").isNull(), UNMATCHABLE).otherwise(F.col("settlement_id"))
        .alias("group_id"),
        F.when(copied, "duplicate_payment").when(F.col("settlement_id").isNull(), UNMATCHABLE).otherwise("clean")
        .alias("difficulty"))
    stray = F.col("id").startswith("BNKX")
    line_key = source.bank_lines.select(
        F.lit("bank_line").alias("kind"), "id",
        F.when(stray, UNMATCHABLE).otherwise(
            F.concat(F.lit("STL"), F.regexp_extract("id", "([0-9]+)$", 1))).alias("group_id"),
        F.when(stray, "unrelated_credit").otherwise("clean").alias("difficulty"))
    return AnswerKey(groups, members, invoice_key.unionByName(payment_key).unionByName(line_key))
