"""Tokens in free-text bank narrations, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tieout.functions.text import collapse

# Token patterns (fixed values).
UTR = "(?i)\\bUTR\\s*(?:NO\\.?|NUMBER|#)?\\s*[:\\-]?\\s*([A-Z0-9]{9,23})\\b"
RRN = "(?i)\\bRRN\\s*(?:NO\\.?|#)?\\s*[:\\-]?\\s*([A-Z0-9]{9,23})\\b"
PAY_ID = "\\b(pay_[A-Za-z0-9]{6,})\\b"
ORDER_ID = "\\b(order_[A-Za-z0-9]{6,})\\b"
INVOICE = "(?i)\\b(INV[-_ ]?[0-9]{2,}[A-Za-z0-9_\\-]*)\\b"
RAIL = "(?i)\\b(NEFT|IMPS|UPI|RTGS)\\b"
WORD = "(?<!\\d)([A-Za-z][A-Za-z.&]*)(?!\\d)"
UTR_LABEL = "(?i)^(?:UTR|RRN)\\s*(?:NO\\.?|NUMBER|#)?\\s*[:\\-]?\\s*"

# Words that are never part of a payer's name (fixed values).
NOISE_WORDS = (
    "UTR", "RRN", "TO", "FROM", "BY", "VIA", "REF", "NO", "NUMBER", "PAYMENT", "TRANSFER", "CREDIT", "DEBIT",
    "SETTLEMENT", "RAZORPAY", "NEFT", "IMPS", "UPI", "RTGS", "TXN", "ID", "FOR", "AND", "THE", "INV", "PAY", "ORDER",
)


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(collapse(text), F.lit(pattern), F.lit(1))


def _upper(tokens: Column) -> Column:
    return F.array_distinct(F.transform(tokens, F.upper))


def utrs(narration: Column) -> Column:
    return _upper(_found(narration, UTR))


def rrns(narration: Column) -> Column:
    return _upper(_found(narration, RRN))


def pay_ids(narration: Column) -> Column:
    return F.array_distinct(_found(narration, PAY_ID))


def order_ids(narration: Column) -> Column:
    return F.array_distinct(_found(narration, ORDER_ID))


def invoice_tokens(narration: Column) -> Column:
    return _upper(_found(narration, INVOICE))


def rail(narration: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(collapse(narration), RAIL, 1)), F.lit(""))


def payer(narration: Column) -> Column:
    """The first three words that are not banking noise."""
    words = F.filter(_found(narration, WORD), lambda w: ~F.upper(w).isin(*NOISE_WORDS))
    return F.nullif(F.array_join(F.slice(words, 1, 3), " "), F.lit(""))


def canonical_utr(value: Column) -> Column:
    """A reference without label and spaces, upper case; both sides of a comparison go through it."""
    return F.upper(F.replace(F.regexp_replace(collapse(value), UTR_LABEL, ""), F.lit(" "), F.lit("")))
