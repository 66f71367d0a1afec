"""One reconciliation run: link, check in exact integers, claim, and file the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.model import AMOUNT_OF, Books
from tieout.operators.claims import rejected_proposals
from tieout.operators.invoices import resolve_invoices
from tieout.operators.linking import AMBIGUOUS, LATE, LINKED, link_settlements
from tieout.session import materialize
from tieout.vocab import CONFIDENCE, REVERSED_STATUSES, action_of, severity_of

EXCEPTION_COLUMNS = ("id", "code", "severity", "amount_at_risk", "kind", "record_id", "attempted", "explanation",
                     "suggested_action", "failed_check", "stage", "ord")


@dataclass(frozen=True)
class Run:
    """`outcomes`: every settlement with its link and whether it was accepted.
    `chain`: one row per payment of a linked settlement, with its invoice.
    `groups`, `members`: accepted chains, and their records in long form.
    `exceptions`: everything else."""
    books: Books
    outcomes: DataFrame
    chain: DataFrame
    groups: DataFrame
    members: DataFrame
    exceptions: DataFrame


def settled_payments(books: Books, links: DataFrame) -> DataFrame:
    """Payments of the given settlements, with the invoice each one resolves to."""
    payments = books.indexed("payment").select(
        F.col("id").alias("known_id"), "gross", "status", "invoice_ref", "captured_at")
    rows = books.membership.join(links.select("settlement_id", F.col("ord").alias("prop")), "settlement_id")
    rows = rows.join(payments, rows.payment_id == payments.known_id, "left")
    return resolve_invoices(books, rows).drop("captured_at")


def batch_totals(chain: DataFrame) -> DataFrame:
    """Per settlement: gross, reversed gross and unknown payments of its members."""
    gross = F.col("gross").cast("decimal(38,0)")
    return chain.groupBy("prop").agg(
        F.coalesce(F.sum(gross), F.lit(0)).alias("gross_total"),
        F.coalesce(F.sum(F.when(F.col("status").isin(*REVERSED_STATUSES), gross)), F.lit(0)).alias("reversed_total"),
        F.count_if(F.col("known_id").isNull()).alias("unknown_payments"),
        F.count("invoice_id").alias("resolved_payments"))


def batch_residual() -> Column:
    """Payout less what the members add up to; zero when the batch ties out."""
    def amount(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("decimal(38,0)")
    expected = (amount("gross_total") - amount("fees") - amount("tax") - amount("reversed_total")
                + amount("adjustments"))
    return (amount("payout") - expected).cast("decimal(38,0)")


def claimed_records(chain: DataFrame, proposals: DataFrame) -> DataFrame:
    """(prop, kind, id) for everything a proposal would take."""
    payments = chain.select("prop", F.lit("payment").alias("kind"), F.col("payment_id").alias("id"))
    invoices = chain.filter("invoice_id is not null").select(
        "prop", F.lit("invoice").alias("kind"), F.col("invoice_id").alias("id"))
    lines = proposals.select("prop", F.lit("bank_line").alias("kind"), F.col("bank_line_id").alias("id"))
    return payments.unionByName(invoices).unionByName(lines)


def member_rows(chain: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, kind, id, pos) of the settlements in `chain`, each record once."""
    payments = chain.groupBy(F.col("settlement_id").alias("group_id"), F.col("payment_id").alias("id")).agg(
        F.min("pos").alias("pos")).select("group_id", F.lit("payment").alias("kind"), "id", "pos")
    invoices = chain.filter("invoice_id is not null").groupBy(
        F.col("settlement_id").alias("group_id"), F.col("invoice_id").alias("id")).agg(
        F.min("pos").alias("pos")).select("group_id", F.lit("invoice").alias("kind"), "id", "pos")
    heads = groups.select("id", F.explode(F.array(
        F.struct(F.lit("settlement").alias("kind"), F.col("settlement_id").alias("id")),
        F.struct(F.lit("bank_line").alias("kind"), F.col("bank_line_id").alias("id")))).alias("r")).select(
        F.col("id").alias("group_id"), "r.kind", "r.id", F.lit(0).cast("long").alias("pos"))
    return payments.unionByName(invoices).unionByName(heads)


def exception_rows(records: DataFrame, kind: str, code: Column, attempted: Column, stage: Column,
                   failed_check: Column | None = None) -> DataFrame:
    """File each record of one kind under a code; `records` has the kind's id, amount and ord."""
    return records.select(
        F.concat(F.lit(f"EXC-{kind}-"), F.col("id")).alias("id"), code.alias("code"),
        severity_of(code).alias("severity"), F.col(AMOUNT_OF[kind]).alias("amount_at_risk"),
        F.lit(kind).alias("kind"), F.col("id").alias("record_id"), attempted.alias("attempted"),
        F.lit(None).cast("string").alias("explanation"), action_of(code).alias("suggested_action"),
        (F.lit(None).cast("string") if failed_check is None else failed_check).alias("failed_check"), stage.alias("stage"), "ord")


def settlement_exceptions(outcomes: DataFrame) -> DataFrame:
    status = F.col("link_status")
    code = (F.when(status == AMBIGUOUS, "AMBIGUOUS_MULTI_CANDIDATE").when(status == LATE, "DATE_OUTSIDE_WINDOW")
            .when(status == LINKED, "AMT_MISMATCH_UNEXPLAINED").otherwise("MISSING_IN_BANK"))
    stage = F.when(status == AMBIGUOUS, 1).when(status == LATE, 2).when(status == LINKED, 4).otherwise(3)
    tried = F.when(status == LINKED, F.array(F.lit("P1"), F.lit("P2"), F.lit("P3"))).otherwise(F.array(F.lit("P1")))
    open_rows = outcomes.filter(~F.col("accepted")).withColumnRenamed("settlement_id", "id")
    return exception_rows(open_rows, "settlement", code, tried, stage)


def residue(books: Books, accepted_chain: DataFrame, outcomes: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Exceptions for every invoice, payment and bank line that no accepted chain holds.

    `held` are records (kind, id) that groups of earlier batches hold.
    """
    used_payments = accepted_chain.select(F.col("payment_id").alias("id"))
    used_invoices = accepted_chain.filter("invoice_id is not null").select(F.col("invoice_id").alias("id"))
    used_lines = outcomes.filter("accepted").select(F.col("bank_line_id").alias("id"))
    paid = accepted_chain.select("gross", "invoice_ref")
    if held is not None:
        before = {kind: held.filter(F.col("kind") == kind).select("id") for kind in ("payment", "invoice", "bank_line")}
        used_payments, used_invoices = used_payments.union(before["payment"]), used_invoices.union(before["invoice"])
        used_lines = used_lines.union(before["bank_line"])
        paid = paid.union(books.indexed("payment").join(before["payment"], "id", "left_semi").select("gross", "invoice_ref"))

    invoices = books.indexed("invoice").join(used_invoices, "id", "left_anti")
    lines = books.indexed("bank_line").join(used_lines, "id", "left_anti")
    signatures = (paid.filter("invoice_ref is not null and invoice_ref <> ''")
                  .select(F.col("gross").alias("seen_gross"), F.col("invoice_ref").alias("seen_ref")).distinct())
    orphans = books.indexed("payment").join(used_payments, "id", "left_anti")
    orphans = orphans.join(signatures, (F.col("gross") == F.col("seen_gross"))
                           & (F.col("invoice_ref") == F.col("seen_ref")), "left")
    code = (F.when(F.col("seen_ref").isNotNull(), "DUPLICATE_CANDIDATE")
            .when(F.col("status") == "refunded", "REFUND_UNLINKED")
            .when(F.col("status") == "disputed", "CHARGEBACK_UNLINKED").otherwise("MISSING_IN_LEDGER"))
    return (exception_rows(invoices, "invoice", F.lit("MISSING_IN_BANK"), F.array(F.lit("P3")), F.lit(5))
            .unionByName(exception_rows(orphans, "payment", code, F.array(F.lit("P2")), F.lit(6)))
            .unionByName(exception_rows(lines, "bank_line", F.lit("UNIDENTIFIED_CREDIT"), F.array(F.lit("P1")),
                                        F.lit(7))))


def reconcile(books: Books, held: DataFrame | None = None) -> Run:
    """One run over the books.

    `held` are records (kind, id) that groups of earlier batches own. They stay in the books, so that
    lookups find them, but no proposal may take one, and their settlements are not looked at again.
    """
    links = link_settlements(books)
    if held is not None:
        closed = held.filter("kind = 'settlement'").select(F.col("id").alias("settlement_id"))
        links = links.join(closed, "settlement_id", "left_anti")
    links = materialize(links, "links")
    linked = links.filter(F.col("link_status") == LINKED)
    chain = settled_payments(books, linked)

    proposals = linked.withColumnRenamed("ord", "prop").join(batch_totals(chain), "prop", "left")
    proposals = proposals.select("prop", "settlement_id", "bank_line_id", batch_residual().alias("residual"),
                                 F.coalesce("unknown_payments", F.lit(0)).alias("unknown_payments"),
                                 F.coalesce("resolved_payments", F.lit(0)).alias("resolved_payments"))
    proposals = materialize(proposals, "proposals")
    valid = proposals.filter("residual = 0 and unknown_payments = 0")
    rejected = rejected_proposals(claimed_records(chain, proposals), valid, held)
    accepted = valid.join(rejected, "prop", "left_anti")

    outcomes = materialize(
        links.join(accepted.select("settlement_id", "resolved_payments", F.lit(True).alias("ok")),
                   "settlement_id", "left")
        .withColumn("accepted", F.coalesce("ok", F.lit(False))).drop("ok"), "outcomes")
    pass_id = F.when(F.col("resolved_payments") > 0, "P3").otherwise("P2")
    confidence = F.when(F.col("resolved_payments") > 0, CONFIDENCE["P3"]).otherwise(CONFIDENCE["P2"])
    groups = outcomes.filter("accepted").select(
        F.col("settlement_id").alias("id"), "settlement_id", "bank_line_id", F.lit("auto").alias("status"),
        pass_id.alias("pass_id"), confidence.alias("confidence"), F.lit(0).cast("long").alias("residual"),
        "payout", "settled_at", "ord",
        F.array(F.struct(F.lit("utr").alias("field"), F.col("utr").alias("value"),
                         F.col("settlement_id").alias("source_id")),
                F.struct(F.lit("credit").alias("field"), F.col("payout").cast("string").alias("value"),
                         F.col("bank_line_id").alias("source_id"))).alias("evidence"))
    # Linked settlements that failed are few: drop them from the chain, keep the rest in place.
    failed = outcomes.filter((F.col("link_status") == LINKED) & ~F.col("accepted")).select(F.col("ord").alias("prop"))
    kept = chain.join(failed, "prop", "left_anti")
    exceptions = settlement_exceptions(outcomes).unionByName(residue(books, kept, outcomes, held))
    return Run(books, outcomes, kept, groups, member_rows(kept, groups), exceptions)


def batch_algebra(books: Books) -> DataFrame:
    """Every settlement re-added from its payments: gross, reversals and what does not tie out."""
    payments = books.indexed("payment").select(
        F.col("id").alias("known_id"), "gross", "status", F.lit(None).cast("string").alias("invoice_id"))
    settlements = books.indexed("settlement").withColumnRenamed("ord", "prop")
    rows = books.membership.join(settlements.select(F.col("id").alias("settlement_id"), "prop"), "settlement_id")
    totals = batch_totals(rows.join(payments, F.col("payment_id") == F.col("known_id"), "left"))
    return settlements.join(totals, "prop", "left").select(
        F.col("id").alias("settlement_id"), F.coalesce("gross_total", F.lit(0)).cast("long").alias("gross"),
        F.coalesce("reversed_total", F.lit(0)).cast("long").alias("reversed"), "payout",
        batch_residual().cast("long").alias("residual"))


def unbalanced_batches(books: Books) -> DataFrame:
    """How many settlements break the accounting identity, and by how much in all."""
    return batch_algebra(books).agg(
        F.count("*").alias("settlements"), F.count_if(F.col("residual") != 0).alias("unbalanced"),
        F.coalesce(F.sum(F.abs("residual")), F.lit(0)).alias("residual_total"))
