"""Tables the queries need besides the books, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.functions.money import format_paise
from tieout.operators.triage import open_bank_lines, open_settlements
from tieout.plans import books as fixture
from tieout.plans.reconcile import Run
from tieout.session import new_folder

FILE_ROWS = 120


def proposals(run: Run) -> DataFrame:
    """Outside suggestions: the lowest open line of the right amount, with a quoted span.

    Even settlements quote a second span that no line holds; every seventh also gets a
    second suggestion that names its own line without a quote.
    """
    lines = open_bank_lines(run).groupBy(F.col("credit").alias("payout")).agg(
        F.min("id").alias("bank_line_id"), F.min_by("narration", "id").alias("narration"))
    opened = open_settlements(run).select("settlement_id", "payout", F.col("ord").alias("b"))
    first = F.substring("narration", 1, 12)
    spans = F.when(F.col("b") % 2 == 0, F.array(first, F.concat(F.lit("NOT IN TEXT "), F.col("b").cast("string")))
                   ).otherwise(F.array(first))
    main = opened.join(lines, "payout").select(
        "settlement_id", F.lit(1).alias("proposal_ord"), "bank_line_id", F.lit(0.9).alias("confidence"),
        spans.alias("evidence_spans"))
    second = opened.filter("b % 7 = 0").select(
        "settlement_id", F.lit(2).alias("proposal_ord"),
        F.concat(F.lit("BNK"), F.lpad(F.col("b").cast("string"), 6, "0")).alias("bank_line_id"),
        F.lit(0.5).alias("confidence"), F.array().cast("array<string>").alias("evidence_spans"))
    return main.unionByName(second)


def decisions(run: Run, run_id: str) -> DataFrame:
    """Approvals by the numeric tail of the exception id, every other one overruled later."""
    tail = F.regexp_extract("id", "([0-9]+)$", 1).cast("long")
    rows = run.exceptions.select("id", tail.alias("tail")).filter("tail % 3 = 0")
    steps = F.array_compact(F.array(
        F.struct(F.lit("approved").alias("decision"), F.lit("2024-02-01 00:00:00").alias("at")),
        F.when(F.col("tail") % 6 == 0, F.struct(F.lit("rejected").alias("decision"),
                                                F.lit("2024-02-02 00:00:00").alias("at")))))
    return rows.select("id", F.explode(steps).alias("s")).select(
        F.lit(run_id).alias("run_id"), F.col("id").alias("exception_id"), "s.decision",
        F.concat(F.lit("note "), F.col("s.decision")).alias("note"), F.col("s.at").cast("timestamp").alias("created_at"))


# ---------------------------------------------------------------- catalog


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per order: its user, dataset, state and idempotency key."""
    k = F.col("k")
    states = F.array(*[F.lit(s) for s in ("queued", "matching", "complete", "failed", "complete")])
    return fixture.orders(spark, sf_dir).select(
        F.concat(F.lit("RUN"), F.lpad(k.cast("string"), 9, "0")).alias("id"), F.col("o_custkey").alias("user_id"),
        F.when(k % 5 != 0, F.concat(F.lit("DS"), F.lpad(F.floor(k / 8).cast("string"), 8, "0"))).alias("dataset_id"),
        F.get(states, (k % 5).cast("int")).alias("state"), F.lit("upload").alias("source"),
        F.when(k % 3 != 0, F.concat(F.lit("key-"), F.floor(k / 2).cast("string"))).alias("idempotency_key"),
        F.timestamp_add("MINUTE", (k * 7919 % 100003).cast("int"), F.lit("2024-01-01").cast("timestamp"))
        .alias("created_at"))


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.orders(spark, sf_dir).filter("k % 8 = 0").select(
        F.concat(F.lit("DS"), F.lpad(F.floor(F.col("k") / 8).cast("string"), 8, "0")).alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("books "), F.floor(F.col("k") / 16).cast("string")).alias("name"),
        F.lit("draft").alias("status"), (F.floor(F.col("k") / 8) % 3 == 0).alias("has_truth"))


def dataset_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four files per dataset; some have no valid row, some are missing."""
    roles = F.array(*[F.lit(r) for r in ("ledger", "gateway", "settlement", "bank")])
    k = F.col("k")
    return fixture.orders(spark, sf_dir).filter("k % 8 < 4 and k % 11 <> 5").select(
        F.concat(F.lit("DS"), F.lpad(F.floor(k / 8).cast("string"), 8, "0")).alias("dataset_id"),
        F.get(roles, (k % 8).cast("int")).alias("role"), (k % 97 + 1).alias("row_count"),
        F.when(k % 13 == 3, 0).otherwise(k % 97).cast("long").alias("valid_count"), k.alias("uploaded_at"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later uploads for some files, a few of them twice."""
    base = dataset_files(spark, sf_dir).filter("uploaded_at % 6 = 0 or uploaded_at % 9 = 1")
    return base.select("dataset_id", "role", "row_count", F.explode(F.sequence(
        F.lit(1), F.when(F.col("uploaded_at") % 4 == 0, 2).otherwise(1))).alias("n"), "uploaded_at").select(
        "dataset_id", "role", (F.col("row_count") + F.col("n") * 1000).alias("row_count"),
        (F.col("row_count") + F.col("n")).cast("long").alias("valid_count"),
        (F.col("uploaded_at") + F.col("n")).alias("uploaded_at"))


TRACE_STATES = {"signup": "normalising", "view": "matching", "click": "triaging", "purchase": "scoring",
                "error": "failed"}


def trace_of(events: DataFrame) -> DataFrame:
    """Run progress from the events: a user is a run, an event type a state.

    An error ends a run only when its value is high, so runs live for a while.
    """
    states = F.create_map(*[F.lit(x) for kv in TRACE_STATES.items() for x in kv])
    state = F.when((F.col("event_type") == "error") & (F.col("value") < 90), "explaining").otherwise(
        F.element_at(states, F.col("event_type")))
    return events.select(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
                         state.alias("state"), F.col("ts").cast("timestamp").alias("at"), "event_id")


def calls_of(events: DataFrame) -> DataFrame:
    """Model calls from the events: the type is the model, the value sets the tokens."""
    return events.select(F.col("user_id"), F.col("event_type").alias("model"),
                         F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
                         F.floor("value").alias("tokens"), (F.col("value") > 150).alias("degraded"),
                         F.col("ts").cast("timestamp").alias("at"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (spark.readStream.schema(events(spark, sf_dir).schema).option("pathGlobFilter", "events.parquet")
            .parquet(sf_dir))


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of several files; each spans all times, so that later files bring late rows."""
    folder = new_folder(spark, "event-files")
    events(spark, sf_dir).repartition(4, F.xxhash64("event_id")).write.parquet(folder)
    return spark.readStream.schema(events(spark, sf_dir).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def keyed_calls(event_rows: DataFrame) -> DataFrame:
    """Calls with the key of the pool that each one used."""
    rows = calls_of(event_rows)
    return rows.withColumn("key", F.concat(F.lit("key-"), (F.col("user_id") % 3).cast("string")))


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, rpm, rpd, tpm, valid_from): two versions for every model but `signup`, which gets its first on the 12th."""
    model, at = F.col("event_type"), F.array(F.lit("2024-01-01"), F.lit("2024-01-12"))
    rows = events(spark, sf_dir).select("event_type").distinct().select(model.alias("model"), F.posexplode(at).alias("n", "day"))
    return rows.filter("model <> 'signup' OR n = 1").select(
        "model", F.lit(1).alias("rpm"), (20 + F.length("model") - 4 * F.col("n")).alias("rpd"), (100 + 200 * F.col("n")).alias("tpm"),
        F.to_timestamp("day").alias("valid_from"))


def key_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, active_from): a key is in the pool from the day of its first call, one of them from the 20th."""
    calls = keyed_calls(events(spark, sf_dir))
    first = F.date_trunc("day", F.min("at"))
    return calls.groupBy("key").agg(first.alias("first")).select(
        "key", F.when(F.col("key") == "key-2", F.to_timestamp(F.lit("2024-01-20"))).otherwise(F.col("first")).alias("active_from"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written answer per order with the JSON it was given; some state numbers of their own."""
    k = F.col("k")
    total = F.format_string("%.2f", F.col("amount") / 100.0)
    text = F.concat(
        F.lit("1. Order INV"), F.lpad(k.cast("string"), 9, "0"), F.lit(" comes to "),
        F.when(k % 7 == 3, F.format_string("%.2f", F.col("amount") / 80.0)).otherwise(total),
        F.lit(" rupees, share "), F.format_string("%.1f", (k % 1000) / 10.0), F.lit("%\n2. Batch "),
        F.when(k % 5 == 2, F.col("b") + 77777).otherwise(F.col("b")).cast("string"), F.lit(" is open."))
    payload = F.concat(F.lit("{\"total\": "), total, F.lit(", \"share\": "),
                       F.format_string("%.3f", (k % 1000) / 1000.0), F.lit(", \"batch\": {\"id\": \"STL12\", \"n\": ["),
                       F.col("b").cast("string"), F.lit("]}, \"open\": true}"))
    return fixture.orders(spark, sf_dir).select(k.alias("answer_id"), text.alias("text"), payload.alias("payload"))


# ------------------------------------------------------------- raw files

HEADERS = {
    "ledger": "Invoice No{d}Customer Name{d}Amount Due{d}Invoice Date{d}Reference{d}Notes",
    "gateway": "Payment ID{d}Invoice Ref{d}Gross Amount{d}Gateway Fee{d}GST on Fee{d}Status{d}Created At{d}"
               "Method{d}Settlement ID",
    "settlement": "Settlement ID{d}UTR Number{d}Gross Amount{d}Net Payout{d}Fees{d}GST{d}Adjustment{d}"
                  "Settlement Date{d}Payment IDs",
    "bank": "Txn ID{d}Value Date{d}Narration{d}Deposit{d}Withdrawal{d}Balance",
}


def _cell(value: Column, delimiter: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    needs = F.contains(text, delimiter) | text.contains('"')
    return F.when(needs, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def _dated(day: Column, n: Column) -> Column:
    """One of the shapes exports write dates in."""
    return (F.when(n % 4 == 0, F.date_format(day, "d/M/yyyy")).when(n % 4 == 1, F.date_format(day, "d-MMM-yy"))
            .when(n % 4 == 2, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 10:23:45")))
            .otherwise(F.date_format(day, "yyyy-MM-dd")))


def _line_cells(role: str, rows: DataFrame) -> tuple[DataFrame, list[Column]]:
    n = F.col("ord")
    money = format_paise
    if role == "ledger":
        amount = F.concat(F.when((n % 3 == 0) & (F.floor(n / FILE_ROWS) % 2 == 1), F.lit("₹")).when(n % 3 == 1, F.lit("Rs. ")).otherwise(F.lit("")),
                          money(F.col("amount")))
        cells = [F.col("id"), F.col("customer"), amount, _dated(F.col("issued_at"), n), F.col("ref"), F.lit("")]
    elif role == "gateway":
        cells = [F.col("id"), F.col("invoice_ref"), money(F.col("gross")), money(F.col("fee")), money(F.col("tax")),
                 F.col("status"), _dated(F.to_date("captured_at"), n), F.col("method"), F.col("settlement_id")]
    elif role == "settlement":
        cells = [F.col("id"), F.col("utr"), money(F.col("payout") + 100000), money(F.col("payout")),
                 money(F.col("fees")), money(F.col("tax")), money(F.col("adjustments")),
                 _dated(F.col("settled_at"), n), F.concat(F.lit("p"), n.cast("string"), F.lit("; q"), n.cast("string"))]
    else:
        cells = [F.when(n % 10 == 0, F.lit("")).otherwise(F.col("id")), _dated(F.col("value_date"), n),
                 F.col("narration"), money(F.col("credit")), F.lit(""), F.lit("")]
    return rows, cells


def raw_files(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    """(path, role, content): messy exports of one role, a bounded number of rows per file.

    Files differ by number: separator, letterhead, totals line, blank line, a broken
    row, quoting and encoding.
    """
    source = {"ledger": lambda: fixture.invoices(spark, sf_dir).withColumn(
                  "customer", F.concat(F.lit("Naïve & Co, "), F.col("ord").cast("string"))),
              "gateway": lambda: fixture.payments(spark, sf_dir),
              "settlement": lambda: fixture.settlements(fixture.payments(spark, sf_dir)),
              "bank": lambda: fixture.bank_lines(fixture.settlements(fixture.payments(spark, sf_dir)))}[role]()
    rows, cells = _line_cells(role, source)
    file_no = F.floor(F.col("ord") / FILE_ROWS)
    delimiter = F.when(file_no % 4 == 0, ",").when(file_no % 4 == 1, ";").when(file_no % 4 == 2, "\t").otherwise("|")
    lines = rows.select(file_no.alias("file_no"), "ord", delimiter.alias("d"),
                        F.concat_ws("\u0001", *[_cell(c, delimiter) for c in cells]).alias("line"))
    lines = lines.withColumn("line", F.replace("line", F.lit("\u0001"), F.col("d")))
    # Never more than FILE_ROWS lines (bank lines and payments: three and two per number) in a file.
    files = lines.groupBy("file_no", "d").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("body"))
    f, d = F.col("file_no"), F.col("d")
    header = F.lit(HEADERS[role].replace("{d}", "\u0001"))
    header = F.replace(header, F.lit("\u0001"), d)
    above = F.when(f % 3 == 1, F.lit("ACME TRADERS PVT LTD\n\n")).otherwise(F.lit(""))
    at = {"ledger": 2, "gateway": 2, "settlement": 3, "bank": 1}[role]
    rest = HEADERS[role].count("{d}") - at
    broken = F.when(f % 5 == 2, F.concat(F.lit("BAD"), F.repeat(d, at), F.lit("oops"), F.repeat(d, rest), F.lit("\n"))
                    ).otherwise(F.lit(""))
    total = F.when(f % 2 == 0, F.concat(F.lit("\nGrand Total"), F.repeat(d, 3), F.lit("99,999.00\n"))).otherwise(
        F.lit(""))
    body = F.array_join(F.transform("body", lambda r: r["line"]), "\n")
    text = F.concat(above, header, F.lit("\n"), broken, body, total)
    # Even files are Latin-1 bytes, the rest UTF-8 with a byte-order mark on some.
    content = F.when((f % 2 == 0) & (~text.contains("₹")), F.encode(text, "ISO-8859-1")).otherwise(
        F.encode(F.concat(F.when(f % 6 == 1, F.lit("﻿")).otherwise(F.lit("")), text), "UTF-8"))
    return files.select(F.concat(F.lit(f"{role}/"), F.lpad(f.cast("string"), 9, "0"), F.lit(".csv")).alias("path"),
                        F.lit(role).alias("role"), content.alias("content"))
