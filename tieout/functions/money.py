"""Amounts in integer paise: parsing, rendering, fee arithmetic and display figures."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tieout.functions.text import let, quoted
from tieout.vocab import FEE_BAND_BPS, FEE_BPS, GST_BPS

# Spaces an export may put inside an amount, zero-width space included.
_AMOUNT_SPACE = "[\\s\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000]+"
_CURRENCY_PREFIX = "^(?i)(?:₹|rs\\.?|inr|usd|\\$)\\s*"  # fixed value
_TRAILING_SIGN = "(?i)\\s*(cr|dr)\\.?$"  # fixed value
_AMOUNT_SHAPE = "^-?\\d+(?:,\\d+)*(?:\\.\\d+)?$"  # fixed value


def _compatibility_pairs() -> tuple[str, str]:
    """Characters an amount can be written in, paired with their plain form.

    Built by rule from the Unicode tables: every decimal digit, and every
    compatibility character whose NFKC form is one plain ASCII character or the
    rupee sign.
    """
    source, target = [], []
    for point in range(0x80, sys.maxunicode + 1):
        char = chr(point)
        digit = unicodedata.decimal(char, None)
        plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", char)
        if plain != char and len(plain) == 1 and (plain.isascii() and plain.isprintable() or plain == "₹"):
            source.append(char)
            target.append(plain)
    return "".join(source), "".join(target)


_SOURCE, _TARGET = _compatibility_pairs()


def plain_text(text: Column) -> Column:
    """Full-width and other compatibility characters to their plain form.

    Only text that holds a non-ASCII character pays for the long translation.
    """
    return F.when(text.rlike("[^\\x00-\\x7f]"), F.translate(text, _SOURCE, _TARGET)).otherwise(text)


def parse_amount(text: Column) -> Column:
    """`struct(paise, error)`: exactly one side is set. Extra decimals are cut, never rounded."""
    return let(F.regexp_replace(plain_text(text), _AMOUNT_SPACE, ""), lambda bare: let(
        _unwrapped(bare), lambda part: _result(text, bare, _signed(part["inner"], part["negative"]))))


def _unwrapped(bare: Column) -> Column:
    """Without brackets, trailing sign and currency; negative if either of the first two says so."""
    bracketed = bare.startswith("(") & bare.endswith(")")
    inner = F.when(bracketed, F.regexp_replace(bare, "^\\(|\\)$", "")).otherwise(bare)
    debit = F.lower(F.regexp_extract(inner, _TRAILING_SIGN, 1)) == "dr"
    return F.struct(F.regexp_replace(F.regexp_replace(inner, _TRAILING_SIGN, ""), _CURRENCY_PREFIX, "").alias("inner"),
                    (bracketed | debit).alias("negative"))


def _signed(inner: Column, negative: Column) -> Column:
    """Paise, or null where the text has not the shape of an amount or is too large."""
    def paise(body: Column) -> Column:
        digits = F.replace(body, F.lit(","), F.lit(""))
        whole = F.regexp_extract(digits, "^(-?\\d+)", 1).try_cast("decimal(30,0)")
        part = F.rpad(F.regexp_extract(digits, "\\.(\\d{1,2})", 1), 2, "0").try_cast("decimal(2,0)")
        sign = F.when(negative | inner.startswith("-"), -1).otherwise(1)
        return F.when(body.rlike(_AMOUNT_SHAPE), ((whole * 100 + part) * sign).try_cast("long"))
    return let(F.regexp_replace(inner, "^[+-]", ""), paise)


def _result(text: Column, bare: Column, paise: Column) -> Column:
    def checked(value: Column) -> Column:
        error = F.when(F.coalesce(bare, F.lit("")) == "", F.lit("empty amount")).when(
            value.isNull(), F.concat(F.lit("unrecognised amount shape: "), quoted(text)))
        return F.struct(value.alias("paise"), error.alias("error"))
    return let(paise, checked)


def format_paise(paise: Column) -> Column:
    """Indian grouping, two decimals: 12,34,567.89."""
    magnitude = F.abs(paise.cast("decimal(20,0)"))
    digits = F.lpad(magnitude.cast("string"), F.greatest(F.length(magnitude.cast("string")), F.lit(3)), F.lit("0"))
    whole = digits.substr(F.lit(1), F.length(digits) - 2)
    grouped = F.regexp_replace(whole, "(\\d)(?=(\\d\\d)+\\d$)", "$1,")
    sign = F.when(paise < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, grouped, F.lit("."), F.right(digits, F.lit(2)))


def rupees(paise: Column) -> Column:
    """Report form: the sign before the currency code."""
    sign = F.when(paise < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.lit("INR "), format_paise(F.abs(paise)))


def round_bps(amount: Column, bps: Column) -> Column:
    """Share of a non-negative amount in basis points, half up, in integers."""
    # Whole ten-thousands apart from the rest, so the product stays far from overflow.
    whole, rest = F.call_function("div", amount, F.lit(10000)), amount % 10000
    return whole * bps + F.call_function("div", rest * bps + 5000, F.lit(10000))


def within_fee_band(invoice: Column, gross: Column, bps: int = FEE_BAND_BPS) -> Column:
    """Is the gross within `bps` of the invoice amount, floor division as in the books?"""
    i, g = invoice.cast("decimal(38,0)"), gross.cast("decimal(38,0)")
    return (F.when(invoice == 0, gross == 0).when(invoice < 0, F.lit(True))
            .otherwise(F.abs(i - g) * 10000 < i * (bps + 1)))


def band_limits(gross: Column, bps: int = FEE_BAND_BPS) -> tuple[Column, Column]:
    """Smallest and largest positive invoice amount whose band holds `gross` (> 0).

    Solves |i - g| * 10000 < (bps + 1) * i for integers i.
    """
    scaled = gross.cast("decimal(30,0)") * 10000
    low = F.floor(scaled / (10000 + bps + 1)) + 1
    high = F.floor((scaled - 1) / (10000 - bps - 1))
    return low.cast("long"), high.cast("long")


def fee_bps(method: Column) -> Column:
    pairs = [F.lit(x) for pair in FEE_BPS.items() for x in pair]
    return F.element_at(F.create_map(*pairs), method)


def payment_economics(gross: Column, method: Column) -> tuple[Column, Column, Column]:
    """Fee, tax on the fee and net of one payment."""
    fee = round_bps(gross, fee_bps(method))
    tax = round_bps(fee, F.lit(GST_BPS))
    return fee, tax, gross - fee - tax


def duration_text(seconds: Column) -> Column:
    """`45s`, `12 min`, `2h 05m`."""
    minutes = F.floor(seconds / 60)
    hours, rest = F.floor(minutes / 60), minutes % 60
    return (F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
            .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min")))
            .when(rest == 0, F.concat(hours.cast("string"), F.lit("h")))
            .otherwise(F.concat(hours.cast("string"), F.lit("h "), F.lpad(rest.cast("string"), 2, "0"), F.lit("m"))))


def elapsed_text(millis: Column) -> Column:
    """`0:07.4`: minutes always, tenths always."""
    total = F.greatest(F.lit(0), millis)
    seconds = F.lpad(F.floor((total % 60000) / 1000).cast("string"), 2, "0")
    return F.concat(F.floor(total / 60000).cast("string"), F.lit(":"), seconds, F.lit("."),
                    F.floor((total % 1000) / 100).cast("string"))


def stage_text(millis: Column) -> Column:
    """`740ms` below a second, else `1.4s`."""
    return F.when(millis < 1000, F.concat(F.greatest(F.lit(0), F.round(millis).cast("long")).cast("string"),
                                          F.lit("ms"))).otherwise(
        F.concat(F.format_string("%.1f", millis / 1000), F.lit("s")))


def percent_text(rate: Column) -> Column:
    return F.concat(F.format_string("%.1f", rate * 100), F.lit("%"))


def optional_text(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("-")).otherwise(F.format_string("%.3f", value))
