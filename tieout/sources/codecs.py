"""JSON and CSV forms of records, results and the answer key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout import model
from tieout.model import AnswerKey, Books

RECORD_SCHEMAS = {
    "ledger": model.INVOICE, "gateway": model.PAYMENT, "bank": model.BANK_LINE,
    "settlement": model.SETTLEMENT.replace("ord bigint", "payment_ids array<string>, ord bigint"),
}
GROUP_SCHEMA = ("id string, settlement_id string, bank_line_id string, status string, pass_id string, "
                "confidence double, residual bigint, payout bigint, settled_at date, ord bigint, "
                "evidence array<struct<field: string, value: string, source_id: string>>")
EXCEPTION_SCHEMA = ("id string, code string, severity int, amount_at_risk bigint, kind string, record_id string, "
                    "attempted array<string>, explanation string, suggested_action string, failed_check string, "
                    "stage int, ord bigint")


def to_json_lines(rows: DataFrame) -> DataFrame:
    """One JSON document per row, nulls written out."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def from_json_lines(lines: DataFrame, schema: str) -> DataFrame:
    return lines.select(F.from_json("json", schema).alias("row")).select("row.*")


def records_to_json(records: DataFrame) -> DataFrame:
    return to_json_lines(records)


def records_from_json(lines: DataFrame, role: str) -> DataFrame:
    return from_json_lines(lines, RECORD_SCHEMAS[role])


def books_from_json(ledger: DataFrame, gateway: DataFrame, settlement: DataFrame, bank: DataFrame) -> Books:
    """Books from the JSON lines of the four roles."""
    read = {role: records_from_json(lines, role) for role, lines in
            (("ledger", ledger), ("gateway", gateway), ("settlement", settlement), ("bank", bank))}
    return Books.from_records(read["ledger"], read["gateway"], read["settlement"], read["bank"])


def write_result(groups: DataFrame, members: DataFrame, exceptions: DataFrame, path: str) -> None:
    """A finished run as three folders of JSON lines."""
    for name, rows in (("groups", groups), ("members", members), ("exceptions", exceptions)):
        rows.write.option("ignoreNullFields", "false").option("compression", "gzip").json(f"{path}/{name}")


def read_result(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (spark.read.schema(GROUP_SCHEMA).json(f"{path}/groups"),
            spark.read.schema("group_id string, kind string, id string, pos bigint").json(f"{path}/members"),
            spark.read.schema(EXCEPTION_SCHEMA).json(f"{path}/exceptions"))


def answer_key_from_json(lines: DataFrame) -> AnswerKey:
    """From documents with `groups`, `record_group` and `record_difficulty` keyed `kind:id`."""
    group = ("struct<id: string, invoice_ids: array<string>, payment_ids: array<string>, settlement_id: string, "
             "bank_line_id: string>")
    schema = f"groups map<string, {group}>, record_group map<string, string>, record_difficulty map<string, string>"
    parsed = lines.select(F.from_json("json", schema).alias("t")).select("t.*")
    rows = parsed.select(F.explode("groups").alias("group_id", "g"))
    members = rows.select("group_id", F.explode(F.concat(
        F.transform("g.invoice_ids", lambda i: F.struct(F.lit("invoice").alias("kind"), i.alias("id"))),
        F.transform("g.payment_ids", lambda i: F.struct(F.lit("payment").alias("kind"), i.alias("id"))))).alias("m"))
    groups = rows.select(F.coalesce("g.settlement_id", "group_id").alias("settlement_id"), "g.bank_line_id")
    placed = parsed.select(F.explode("record_group").alias("key", "group_id"))
    rated = parsed.select(F.explode("record_difficulty").alias("key", "difficulty"))
    records = placed.join(rated, "key", "full").select(
        F.substring_index("key", ":", 1).alias("kind"), F.regexp_replace("key", "^[^:]*:", "").alias("id"),
        "group_id", F.coalesce("difficulty", F.lit("clean")).alias("difficulty"))
    return AnswerKey(groups, members.select("group_id", "m.kind", "m.id"), records)


def exceptions_export(exceptions: DataFrame) -> DataFrame:
    """The spreadsheet form of the open items."""
    return exceptions.select(
        F.col("id").alias("exception_id"), "code", "severity", F.col("amount_at_risk").alias("amount_at_risk_paise"),
        F.concat_ws(":", "kind", "record_id").alias("records"),
        F.coalesce("suggested_action", F.lit("")).alias("suggested_action"))


def write_exceptions(exceptions: DataFrame, path: str) -> None:
    exceptions_export(exceptions).write.option("header", True).csv(path)
