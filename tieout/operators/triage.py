"""Verify matches proposed from outside the run, and explain what stays open."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.functions.text import cap_text, quoted
from tieout.model import Books
from tieout.operators.claims import rejected_proposals
from tieout.operators.ordering import with_ordinals
from tieout.plans.reconcile import (
    Run, batch_residual, batch_totals, claimed_records, exception_rows, member_rows, settled_payments)
from tieout.session import materialize


@dataclass(frozen=True)
class Triage:
    """`verdicts`: every proposal that was answered to, with its failed check (null if
    accepted). `groups`, `members`, `exceptions`: the run with accepted proposals in."""
    verdicts: DataFrame
    groups: DataFrame
    members: DataFrame
    exceptions: DataFrame


def open_settlements(run: Run) -> DataFrame:
    return run.outcomes.filter(~F.col("accepted"))


def open_bank_lines(run: Run) -> DataFrame:
    used = run.outcomes.filter("accepted").select(F.col("bank_line_id").alias("id"))
    return run.books.indexed("bank_line").join(used, "id", "left_anti")


def candidate_groups(run: Run) -> DataFrame:
    """Offers in factored form: (amount, side, id, lines), one row per open record.

    A settlement's candidates are the bank lines listed under its amount, and every
    settlement of an amount shares the list, so it is kept once and pairs are never
    written out. Amounts that lack either side are left out.
    """
    settlements = open_settlements(run).select(F.col("payout").alias("amount"), F.lit("settlement").alias("side"),
                                               F.col("settlement_id").alias("id"))
    lines = open_bank_lines(run).select(F.col("credit").alias("amount"), F.lit("bank_line").alias("side"), "id")
    both = settlements.unionByName(lines)
    offered = both.groupBy("amount").agg(
        F.count_if(F.col("side") == "settlement").alias("settlements"),
        F.count_if(F.col("side") == "bank_line").alias("lines")).filter("settlements > 0 and lines > 0")
    return both.join(offered.select("amount", "lines"), "amount")


def _spans_elsewhere(probes: DataFrame, lines: DataFrame) -> DataFrame:
    """(amount, span) of the probes that some line of the amount contains.

    Containment as an equality join: each distinct narration lists its substrings of
    the lengths asked for, so the work grows with the text and not with probes
    times lines.
    """
    lengths = probes.select("amount", F.length("span").alias("span_length")).distinct()
    texts = lines.select(F.col("credit").alias("amount"), "narration").distinct().join(lengths, "amount")
    starts = F.sequence(F.lit(1), F.length("narration") - F.col("span_length") + 1)
    pieces = (texts.filter(F.length("narration") >= F.col("span_length"))
              .select("amount", "narration", "span_length", F.explode(starts).alias("at"))
              .select("amount", F.col("narration").substr(F.col("at"), F.col("span_length")).alias("span")))
    return probes.join(pieces.distinct(), ["amount", "span"], "left_semi")


def _ungrounded(offered: DataFrame, lines: DataFrame) -> DataFrame:
    """(settlement_id, proposal_ord, span) of each proposal's first span that no offered line holds."""
    spans = offered.select("settlement_id", "proposal_ord", F.col("payout").alias("amount"), "narration",
                           F.posexplode("evidence_spans").alias("at", "span"))
    # The proposed line itself is an offered one: only spans missing from it look further.
    doubtful = spans.filter(~F.col("narration").contains(F.col("span")) & (F.col("span") != ""))
    probes = doubtful.select("amount", "span").distinct()
    missing = doubtful.join(_spans_elsewhere(probes, lines), ["amount", "span"], "left_anti")
    return missing.groupBy("settlement_id", "proposal_ord").agg(F.min_by("span", "at").alias("span"))


def _claim_failure(chain: DataFrame, judged: DataFrame, owners: DataFrame) -> DataFrame:
    """(prop, reason): the first record of a proposal that someone before it holds."""
    def asked(kind: str, rank: int, rows: DataFrame, record: str, pos: Column) -> DataFrame:
        return rows.select("prop", F.lit(kind).alias("kind"), F.col(record).alias("id"),
                           F.lit(rank).alias("rank"), pos.cast("long").alias("pos"))
    keys = (asked("invoice", 1, chain.filter("invoice_id is not null"), "invoice_id", F.col("pos"))
            .unionByName(asked("payment", 2, chain, "payment_id", F.col("pos")))
            .unionByName(asked("settlement", 3, judged, "settlement_id", F.lit(0)))
            .unionByName(asked("bank_line", 4, judged, "bank_line_id", F.lit(0))))
    held = keys.join(owners, ["kind", "id"]).filter("owner < prop")
    first = held.groupBy("prop").agg(F.min(F.struct("rank", "pos", "kind", "id")).alias("first"))
    return first.select("prop", F.concat("first.kind", F.lit(" "), "first.id",
                                         F.lit(" already claimed by another group")).alias("held_reason"))


def resolve_proposals(run: Run, proposals: DataFrame) -> Triage:
    """Grounding first, then the same integer checks and claims as the run itself.

    Proposals are applied by settlement id and then in their own order. A proposal
    for a settlement with no offered line was never asked for and is ignored. A
    span has to lie within one narration.
    """
    books: Books = run.books
    lines = open_bank_lines(run)
    amounts = lines.select(F.col("credit").alias("payout")).distinct()
    settlements = open_settlements(run).join(amounts, "payout", "left_semi").select(
        "settlement_id", F.col("ord").alias("settlement_ord"), "payout", "fees", "tax", "adjustments", "settled_at")
    asked = proposals.join(settlements, "settlement_id")
    asked = asked.join(lines.select(F.col("id").alias("bank_line_id"), F.col("credit"), "narration"),
                       "bank_line_id", "left")
    offered = F.coalesce(F.col("credit") == F.col("payout"), F.lit(False))
    ungrounded = _ungrounded(asked.filter(offered), lines)
    asked = asked.join(ungrounded, ["settlement_id", "proposal_ord"], "left")
    check = (F.when(~offered, F.lit("proposed bank_line_id was not an offered candidate"))
             .when(F.col("span").isNotNull(), F.concat(F.lit("ungrounded evidence span: "), quoted(F.col("span")))))
    asked = materialize(_numbered(asked.withColumn("failed_check", check).drop("span", "narration", "credit")),
                        "asked")

    grounded = asked.filter("failed_check is null")
    targets = grounded.select("settlement_id", F.col("settlement_ord").alias("ord")).distinct()
    payments = settled_payments(books, targets).drop("prop")
    chain = materialize(payments.join(grounded.select("settlement_id", "prop"), "settlement_id"), "triage_chain")
    judged = grounded.join(batch_totals(chain), "prop", "left").withColumn("residual", batch_residual())

    taken = claimed_records(run.chain.withColumn("prop", F.lit(-1).cast("long")),
                            run.outcomes.filter("accepted").select(F.lit(-1).cast("long").alias("prop"),
                                                                   "bank_line_id")).select("kind", "id")
    claims = claimed_records(chain, judged).unionByName(
        judged.select("prop", F.lit("settlement").alias("kind"), F.col("settlement_id").alias("id")))
    # The run's own records are many and the proposals' few: look the many up in the few.
    taken = materialize(taken.join(claims.select("kind", "id").distinct(), ["kind", "id"], "left_semi").distinct(),
                        "taken")
    blocked = claims.join(taken, ["kind", "id"], "left_semi").select("prop").distinct()
    valid = judged.filter("residual = 0 and coalesce(unknown_payments, 0) = 0").join(blocked, "prop", "left_anti")
    accepted = materialize(valid.join(rejected_proposals(claims, valid), "prop", "left_anti").select("prop"),
                           "assisted")

    owners = (claims.join(accepted, "prop", "left_semi").select("kind", "id", F.col("prop").alias("owner"))
              .unionByName(taken.withColumn("owner", F.lit(-1).cast("long"))))
    reasons = _claim_failure(chain, judged, owners)
    algebra = F.when(F.coalesce("unknown_payments", F.lit(0)) > 0, F.lit("unknown payment id")).otherwise(
        F.concat(F.lit("batch algebra does not tie out: residual "), F.col("residual").cast("string"),
                 F.lit(" paise")))
    judged = judged.join(accepted.withColumn("ok", F.lit(True)), "prop", "left").join(reasons, "prop", "left")
    final = judged.select("prop", F.when(F.col("ok"), F.lit(None).cast("string")).otherwise(
        F.coalesce("held_reason", algebra)).alias("later_check"), F.coalesce("ok", F.lit(False)).alias("accepted"))
    verdicts = asked.join(final, "prop", "left").select(
        "prop", "settlement_id", "settlement_ord", "proposal_ord", "bank_line_id", "payout", "settled_at",
        "confidence", "evidence_spans", F.coalesce("failed_check", "later_check").alias("failed_check"),
        F.coalesce("accepted", F.lit(False)).alias("accepted"))
    verdicts = materialize(verdicts, "verdicts")
    return _merged(run, verdicts, chain)


def _numbered(asked: DataFrame) -> DataFrame:
    """Adds `prop`, counting up in (settlement_id, proposal_ord) order."""
    return with_ordinals(asked, ["settlement_id", "proposal_ord"], "prop")


def _merged(run: Run, verdicts: DataFrame, chain: DataFrame) -> Triage:
    won = verdicts.filter("accepted")
    assisted = won.select(
        F.col("settlement_id").alias("id"), "settlement_id", "bank_line_id", F.lit("assisted").alias("status"),
        F.lit("LLM").alias("pass_id"), "confidence", F.lit(0).cast("long").alias("residual"), "payout", "settled_at",
        F.col("settlement_ord").alias("ord"),
        F.transform("evidence_spans", lambda s: F.struct(
            F.lit("narration").alias("field"), s.alias("value"), F.col("bank_line_id").alias("source_id"))
        ).alias("evidence"))
    closed = member_rows(chain.join(won.select("prop"), "prop", "left_semi"), assisted)
    members = run.members.unionByName(closed)
    remaining = run.exceptions.join(
        closed.select("kind", F.col("id").alias("record_id")).distinct(), ["kind", "record_id"], "left_anti")
    failed = verdicts.filter("not accepted").withColumnRenamed("settlement_id", "id").withColumnRenamed("prop", "ord")
    failures = exception_rows(failed, "settlement", F.lit("LLM_PROPOSAL_FAILED_VERIFY"),
                              F.array(F.lit("P1"), F.lit("LLM")), F.lit(8), F.col("failed_check"))
    return Triage(verdicts, run.groups.unionByName(assisted), members, remaining.unionByName(failures))


def explain(exceptions: DataFrame, explanations: DataFrame) -> DataFrame:
    """One text per code fanned out to its exceptions; uncovered codes keep their template action.

    `explanations` is (code, explanation, suggested_action, given): of several for a code the last given holds.
    """
    texts = explanations.groupBy(F.upper(F.trim("code")).alias("code")).agg(
        F.max_by(F.struct("explanation", "suggested_action"), "given").alias("last")).select(
        "code", F.col("last.explanation").alias("text"), F.col("last.suggested_action").alias("action"))
    joined = exceptions.join(texts, "code", "left")
    action = F.nullif(cap_text(F.col("action")), F.lit(""))
    return joined.withColumn("explanation", F.coalesce(cap_text(F.col("text")), F.col("explanation"))).withColumn(
        "suggested_action", F.coalesce(action, F.col("suggested_action"))).drop("text", "action")


def distinct_codes(exceptions: DataFrame) -> DataFrame:
    return exceptions.select("code").distinct()
