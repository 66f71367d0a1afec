"""Whitespace, header and cell predicates as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's notion of whitespace, which is wider than Java's \s.
_SPACE = "[\\s\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"

_NUMBER = ("^(?i)[+-]?(?:(?:\\d+(?:_\\d+)*)?\\.?(?:\\d+(?:_\\d+)*)(?:e[+-]?\\d+)?"
           "|\\d+(?:_\\d+)*\\.(?:e[+-]?\\d+)?|inf|infinity|nan)$")

SUMMARY_MARKERS = (  # fixed values
    "total", "closing balance", "opening balance", "brought forward", "carried forward", "grand tot")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Work `value` out once and use it many times in `body`.

    Plain column references would copy the whole expression into every use.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(text: Column) -> Column:
    """Runs of any whitespace become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"{_SPACE}+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{_SPACE[1:]}")


def header_signature(headers: Column) -> Column:
    """sha256 over the trimmed, lower-cased, collapsed headers in file order."""
    shaped = F.transform(headers, lambda h: collapse(F.lower(h)))
    return F.sha2(F.array_join(shaped, "\x1f"), 256)


def filled_cells(cells: Column) -> Column:
    return F.filter(cells, lambda c: ~is_blank(c))


def is_numberish(cell: Column) -> Column:
    """What a data row holds and a header does not: amount, date or bare reference."""
    bare = F.regexp_replace(strip(cell), "^[()]+|[()]+$", "")
    bare = F.regexp_replace(bare, "[,₹%]", "")
    bare = F.regexp_replace(bare, "Cr$", "")
    bare = strip(F.regexp_replace(bare, "Dr$", ""))
    digits = F.length(F.regexp_replace(cell, "[^\\p{Nd}]", ""))
    dated = (digits >= 4) & cell.rlike("[/-]")
    return let(bare, lambda text: (text != "") & (text.rlike(_NUMBER) | dated))


def is_blank_row(cells: Column) -> Column:
    return F.size(filled_cells(cells)) == 0


def looks_like_header(cells: Column) -> Column:
    return let(filled_cells(cells), lambda filled: (F.size(filled) >= 2) & (
        F.size(F.filter(filled, is_numberish)) * 3 <= F.size(filled)))


def is_summary_row(cells: Column) -> Column:
    """A sparse totals or balance line; a full row that mentions a total is data."""
    marker = "|".join(SUMMARY_MARKERS)
    return let(filled_cells(cells), lambda filled: F.size(filled).between(1, 3) & F.exists(
        filled, lambda c: F.lower(c).rlike(marker)))


def header_names(cells: Column) -> Column:
    """Collapsed names, `column_N` for a blank one, `name_K` for the K-th repeat."""
    named = F.transform(
        cells,
        lambda c, i: F.when(is_blank(c), F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(collapse(c)))

    def numbered(names: Column) -> Column:
        def suffixed(name: Column, i: Column) -> Column:
            seen = F.size(F.filter(F.slice(names, F.lit(1), i + 1), lambda other: F.lower(other) == F.lower(name)))
            return F.when(seen > 1, F.concat(name, F.lit("_"), seen.cast("string"))).otherwise(name)
        return F.transform(names, suffixed)

    return let(named, numbered)


def quoted(text: Column) -> Column:
    """Text as an error message quotes it."""
    body = F.regexp_replace(text, "\\\\", "\\\\\\\\")
    body = F.replace(F.replace(F.replace(body, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")),
                     F.lit("\t"), F.lit("\\t"))
    double = text.contains("'") & ~text.contains('"')
    escaped = F.replace(body, F.lit("'"), F.lit("\\'"))
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), escaped, F.lit("'")))


def cap_text(text: Column, limit: int = 240) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit - 1), F.lit("…")))


def class_label(name: Column) -> Column:
    """Display form of a difficulty class: spaces, bank and tax acronyms upper, first letter upper."""
    words = F.transform(F.split(name, "_"), lambda w: F.when(w.isin("gst", "utr"), F.upper(w)).otherwise(w))
    joined = F.array_join(words, " ")
    return F.concat(F.upper(F.substring(joined, 1, 1)), joined.substr(F.lit(2), F.length(joined)))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def request_key(model: Column, schema: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws(":", model, schema, prompt), 256)
