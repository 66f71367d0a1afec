"""Text rows to canonical records: typed, defaulted, and split into good and bad."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tieout.functions.dates import parse_date
from tieout.functions.money import format_paise, parse_amount
from tieout.functions.text import is_blank, strip
from tieout.sources.mapping import field
from tieout.vocab import MAX_REPORTED_ERRORS, PAYMENT_STATUSES

# Fields of each role (fixed values).
REQUIRED = {"ledger": ("amount", "issued_at"), "gateway": ("gross", "captured_at"),
            "settlement": ("payout", "settled_at"), "bank": ("value_date",)}
ID_PREFIX = {"ledger": "INV", "gateway": "pay_row", "settlement": "STL", "bank": "BNK"}
# Amount and date fields in the order a row is checked.
CHECKED = {"ledger": ("amount", "issued_at"), "gateway": ("gross", "fee", "tax", "net", "captured_at"),
           "settlement": ("payout", "fees", "tax", "adjustments", "settled_at"),
           "bank": ("credit", "debit", "value_date", "balance")}
DATES = {"issued_at", "captured_at", "settled_at", "value_date"}


@dataclass(frozen=True)
class Records:
    """`good`: canonical records with path and row_number. `errors`: path, row_number, reason.
    `health`: one row of counts per file."""
    good: DataFrame
    errors: DataFrame
    health: DataFrame


def _given(name: str) -> Column:
    return F.coalesce(field(name), F.lit("")) != ""


def _parsed(name: str) -> Column:
    return F.col(f"p_{name}")


def _paise(name: str, default: Column | int) -> Column:
    default = F.lit(default).cast("long") if isinstance(default, int) else default
    return F.when(_given(name), _parsed(name)["paise"]).otherwise(default)


def _unmapped(name: str) -> Column:
    return ~F.map_contains_key("fields", F.lit(name))


def _canonical(role: str) -> list[Column]:
    record_id = F.col("id")
    if role == "ledger":
        return [record_id, F.when(_unmapped("number"), record_id).otherwise(field("number")).alias("number"),
                F.coalesce(field("customer"), F.lit("")).alias("customer"), _parsed("amount")["paise"].alias("amount"),
                _parsed("issued_at")["day"].alias("issued_at"),
                F.when(_given("ref"), field("ref")).otherwise(record_id).alias("ref")]
    if role == "gateway":
        gross, fee, tax = _parsed("gross")["paise"], _paise("fee", 0), _paise("tax", 0)
        optional = [F.when(_given(n), field(n)).alias(n) for n in ("order_id", "invoice_ref", "settlement_id")]
        return [record_id, *optional[:2], gross.alias("gross"), fee.alias("fee"), tax.alias("tax"),
                _paise("net", gross - fee - tax).alias("net"), F.coalesce(field("status"), F.lit("captured")).alias(
                    "status"), _parsed("captured_at")["day"].cast("timestamp_ntz").alias("captured_at"),
                F.coalesce(field("method"), F.lit("unknown")).alias("method"), optional[2]]
    if role == "settlement":
        ids = F.filter(F.transform(F.split(field("payment_ids"), ";"), strip), lambda p: p != "")
        return [record_id, F.when(_given("utr"), field("utr")).alias("utr"), _parsed("payout")["paise"].alias("payout"),
                *[_paise(n, 0).alias(n) for n in ("fees", "tax", "adjustments")],
                _parsed("settled_at")["day"].alias("settled_at"),
                F.coalesce(ids, F.array().cast("array<string>")).alias("payment_ids")]
    credit, debit = _paise("credit", 0), _paise("debit", 0)
    outgoing = credit < 0
    return [record_id, _parsed("value_date")["day"].alias("value_date"),
            F.coalesce(field("narration"), F.lit("")).alias("narration"),
            F.when(outgoing, F.lit(0).cast("long")).otherwise(credit).alias("credit"),
            F.when(outgoing, debit - credit).otherwise(debit).alias("debit"), _paise("balance", 0).alias("balance")]


def build_records(mapped: DataFrame, role: str) -> Records:
    """Validate the rows of one role, (path, role, row_number, fields), from any number of files.

    A row with nothing in it is not a record; a row without an id gets one from its
    position; a bad row is reported with its first reason and the rest go on.
    """
    rows = mapped.filter(F.col("role") == role).filter(
        F.exists(F.map_values("fields"), lambda v: ~is_blank(F.coalesce(v, F.lit("")))))
    numbered = F.concat(F.lit(ID_PREFIX[role]), F.format_string("%06d", F.col("row_number")))
    rows = rows.withColumn("id", F.when(_given("id"), field("id")).otherwise(numbered))
    parsed = [(parse_date if name in DATES else parse_amount)(F.coalesce(field(name), F.lit(""))).alias(f"p_{name}")
              for name in CHECKED[role]]
    # Made as rows of a one-row list: the planner would copy plain columns into every filter and use, and parse each cell many times.
    rows = rows.select("*", F.inline(F.array(F.struct(*parsed))))

    absent = F.array_compact(F.array(*[F.when(~_given(n), F.lit(n)) for n in REQUIRED[role]]))
    reason = F.when(F.size(absent) > 0, F.concat(F.lit("missing required field(s): "), F.array_join(absent, ", ")))
    for name in CHECKED[role]:
        wrong = _parsed(name)["error"].isNotNull() & (_given(name) if name not in REQUIRED[role] else F.lit(True))
        reason = reason.when(wrong, F.concat(F.lit(f"{name}: "), _parsed(name)["error"]))
    if role == "gateway":
        status = F.coalesce(field("status"), F.lit("captured"))
        reason = reason.when(~status.isin(*PAYMENT_STATUSES), F.concat(
            F.lit("validation failed: status "), status, F.lit(" is not one of "),
            F.lit(", ".join(PAYMENT_STATUSES))))
    checked = rows.withColumn("reason", reason)
    good = checked.filter("reason is null").select("path", "row_number", *_canonical(role))
    errors = checked.filter("reason is not null").select("path", "row_number", "reason")
    health = checked.groupBy("path").agg(
        F.count("*").alias("total_rows"), F.count_if(F.col("reason").isNull()).alias("valid_rows"),
        F.count_if(F.col("reason").isNotNull()).alias("error_count"),
        F.count_if(~_given("id")).alias("synthesised_ids"))
    return Records(good, errors, health)


def reported_errors(errors: DataFrame, limit: int = MAX_REPORTED_ERRORS) -> DataFrame:
    """The first errors of each file; `health` keeps the true count."""
    order = Window.partitionBy("path").orderBy("row_number")
    return errors.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= limit).drop("rn")


def error_reasons(errors: DataFrame, limit: int = 3) -> DataFrame:
    """The most frequent reasons, with the first row each was seen on."""
    return errors.groupBy("reason").agg(F.count("*").alias("rows"), F.min("row_number").alias("first_row")).orderBy(
        F.desc("rows"), F.asc("first_row"), F.asc("reason")).limit(limit)


def canonical_text(records: DataFrame, role: str) -> DataFrame:
    """The export form of a role: rupees in Indian grouping, dates only, empty for null, `;` lists.

    What `build_records` reads back to the same records.
    """
    money = set(CHECKED[role]) - DATES
    columns = []
    for name, kind in records.dtypes:
        value = F.col(name)
        if name in money:
            value = format_paise(value)
        elif name == "captured_at":
            value = F.date_format(value, "yyyy-MM-dd")
        elif kind.startswith("array"):
            value = F.array_join(value, ";")
        columns.append(F.coalesce(value.cast("string"), F.lit("")).alias(name))
    return records.select(*columns)


def write_canonical(records: DataFrame, role: str, path: str) -> None:
    canonical_text(records, role).write.option("header", True).option("emptyValue", "").csv(path)
