"""Fixed vocabularies of the reconciliation domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("invoice", "payment", "settlement", "bank_line")
ROLES = {"ledger": "invoice", "gateway": "payment", "settlement": "settlement", "bank": "bank_line"}
# Statuses and states (fixed values).
PAYMENT_STATUSES = ("captured", "refunded", "failed", "disputed")
REVERSED_STATUSES = ("refunded", "disputed")
RUN_STATES = ("queued", "normalising", "matching", "triaging", "explaining", "scoring", "complete", "failed")
TERMINAL_STATES = ("complete", "failed")
UNMATCHABLE = "unmatchable"

# Matching parameters (fixed values).
FEE_BAND_BPS = 300
INVOICE_WINDOW_BUSINESS_DAYS = 5
BANK_CREDIT_WINDOW_DAYS = 5
SUBSET_CANDIDATES = 8
CONFIDENCE = {"P1": 1.00, "P2": 0.99, "P3": 0.95, "P4": 0.90}
FORECAST_DAYS = 14
SECONDS_PER_MANUAL_MATCH = 90
MAX_REPORTED_ERRORS = 200
MAX_LISTED_ROWS = 20
GST_BPS = 1800
FEE_BPS = {"upi": 0, "card": 200, "netbanking": 150, "wallet": 190}

# Exception codes: code, label, severity, suggested action (fixed values).
EXCEPTION_CODES = (
    ("AMT_MISMATCH_UNEXPLAINED", "Amount mismatch, unexplained", 1,
     "Compare the ledger and gateway amounts line by line and confirm the delta with finance."),
    ("FEE_GST_DELTA_UNCONFIRMED", "Fee/GST delta unconfirmed", 2,
     "Recompute fee and GST at the current rate card and confirm against the gateway invoice."),
    ("DATE_OUTSIDE_WINDOW", "Date outside expected window", 2,
     "Check for a settlement delay or holiday shift and extend the matching window if legitimate."),
    ("MISSING_IN_BANK", "Missing in bank statement", 1,
     "Confirm the payout was initiated and check for a delayed or failed bank credit."),
    ("MISSING_IN_LEDGER", "Missing in ledger", 1,
     "Search the ledger for an unlinked invoice or raise one if the sale was never recorded."),
    ("DUPLICATE_CANDIDATE", "Duplicate candidate", 2,
     "Confirm which record is the duplicate and void or merge it."),
    ("PARTIAL_SETTLEMENT_OPEN", "Partial settlement still open", 2,
     "Wait for the remaining settlement batch or confirm a short payout with the gateway."),
    ("REFUND_UNLINKED", "Refund unlinked to original payment", 2,
     "Locate the original captured payment for this refund and link the two records."),
    ("CHARGEBACK_UNLINKED", "Chargeback unlinked to original payment", 1,
     "Locate the original captured payment for this chargeback and escalate to disputes."),
    ("UNIDENTIFIED_CREDIT", "Unidentified bank credit", 2,
     "Trace the narration and UTR against all open sources before treating it as unrelated income."),
    ("AMBIGUOUS_MULTI_CANDIDATE", "Ambiguous, multiple tied candidates", 2,
     "Review the tied candidates manually and pick the correct match by evidence."),
    ("LLM_PROPOSAL_FAILED_VERIFY", "Proposed match failed verification", 2,
     "Review the rejected proposal and the failed check, then resolve manually."),
    ("SOURCE_PARSE_INCOMPLETE", "Source file parsed incompletely", 3,
     "Review the skipped rows and re-upload a corrected file if needed."),
)


def exception_dimension(spark: SparkSession) -> DataFrame:
    """The thirteen codes as a table, for joins and coverage reports."""
    return spark.createDataFrame(
        list(EXCEPTION_CODES), "code string, label string, severity int, suggested_action string")


def _lookup(code: Column, index: int) -> Column:
    pairs = [F.lit(part) for row in EXCEPTION_CODES for part in (row[0], row[index])]
    return F.element_at(F.create_map(*pairs), code)


def label_of(code: Column) -> Column:
    return _lookup(code, 1)


def severity_of(code: Column) -> Column:
    return _lookup(code, 2)


def action_of(code: Column) -> Column:
    return _lookup(code, 3)
