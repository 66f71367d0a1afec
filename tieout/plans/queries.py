"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tieout.functions import dates, money, narration, text
from tieout.functions.calendar import add_business_days, is_business_day
from tieout.model import duplicate_ids
from tieout.operators import audit, catalog, constraints, faults, linking, ordering, reporting, scoring, similarity, triage
from tieout.operators.invoices import band_candidates
from tieout.plans import books as fixture
from tieout.plans import derived
from tieout.plans.reconcile import Run, batch_algebra, reconcile, settled_payments, unbalanced_batches
from tieout.session import materialize, new_folder
from tieout.sources import codecs, mapping, records, tables
from tieout.streaming import stages, trace, usage
from tieout.streaming.incremental import OpenBooks
from tieout.vocab import SUBSET_CANDIDATES, exception_dimension, label_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


_STORE: dict[tuple[str, str, str], object] = {}


def _stored(spark: SparkSession, sf: str, name: str, build: Callable[[], object]):
    """Reports read the stored result of a run over the same files and do not run it again.

    Kept per session; `_STORE.clear()` makes the next query start from the tables.
    """
    key = (spark.sparkContext.applicationId, f"{sf} {_snapshot(spark, sf)}", name)
    if key not in _STORE:
        _STORE[key] = build()
    return _STORE[key]


def _snapshot(spark: SparkSession, sf: str) -> int | None:
    """Names the files that the books come from, with their sizes and times; no row is read."""
    parts = [spark.read.parquet(f"{sf}/{name}.parquet").select(F.xxhash64(
        "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("file")).distinct()
        for name in ("orders", "customer")]
    return parts[0].union(parts[1]).agg(F.bit_xor("file")).first()[0]


def _run(spark: SparkSession, sf: str) -> Run:
    def build() -> Run:
        # Written once: every step of a run reads the books again.
        run = reconcile(fixture.stored_books(spark, sf))
        return replace(run, groups=materialize(run.groups, "groups"), members=materialize(run.members, "members"),
                       exceptions=materialize(run.exceptions, "exceptions"))
    return _stored(spark, sf, "run", build)


def _triaged(spark: SparkSession, sf: str) -> tuple[Run, triage.Triage]:
    run = _run(spark, sf)
    return run, _stored(spark, sf, "triage", lambda: triage.resolve_proposals(run, derived.proposals(run)))


def _joined(array: str | Column) -> Column:
    return F.array_join(array, ",")


# ------------------------------------------------------- links and matches


@query
def settlement_links(spark, sf):
    links = linking.link_settlements(fixture.books(spark, sf))
    return links.select("settlement_id", "link_status", "bank_line_id", "candidates")


@query
def batch_totals(spark, sf):
    return batch_algebra(fixture.books(spark, sf))


@query
def accounting_identity(spark, sf):
    return unbalanced_batches(fixture.books(spark, sf))


@query
def payment_invoice_links(spark, sf):
    books = fixture.books(spark, sf)
    links = linking.link_settlements(books).filter(F.col("link_status") == linking.LINKED)
    return settled_payments(books, links).select("settlement_id", "payment_id", "invoice_id", "resolved_by")


@query
def fee_band_candidates(spark, sf):
    books = fixture.books(spark, sf)
    probes = books.payments.filter("invoice_ref is null").select(F.to_date("captured_at").alias("captured_on"), "gross")
    hits = band_candidates(probes, books.invoices.select("issued_at", "amount", "ord"))
    return hits.select("captured_on", "gross", "band_hits",
                       F.when(F.col("band_hits") == 1, F.col("band_ord")).alias("invoice_ord"))


@query
def fee_band_flags(spark, sf):
    books = fixture.books(spark, sf)
    own = books.payments.select(F.col("id").alias("payment_id"), "invoice_ref",
                                (F.col("gross") + F.col("ord") % 700 * F.col("gross").cast("long") % 100000)
                                .alias("gross"))
    pairs = own.join(books.invoices.select(F.col("id").alias("invoice_ref"), "amount"), "invoice_ref")
    return pairs.select("payment_id", "amount", "gross", money.within_fee_band(F.col("amount"), F.col("gross")).alias("fits"))


@query
def matched_groups(spark, sf):
    run = _run(spark, sf)
    sizes = run.members.groupBy("group_id").agg(
        F.count_if(F.col("kind") == "invoice").alias("invoices"),
        F.count_if(F.col("kind") == "payment").alias("payments"))
    return run.groups.join(sizes, F.col("id") == F.col("group_id")).select(
        "id", "bank_line_id", "status", "pass_id", "confidence", "residual", "invoices", "payments",
        _joined(F.transform("evidence", lambda e: F.concat_ws("=", e["field"], e["value"], e["source_id"])))
        .alias("evidence"))


@query
def group_members(spark, sf):
    return _run(spark, sf).members.select("group_id", "kind", "id")


@query
def open_exceptions(spark, sf):
    return _run(spark, sf).exceptions.select(
        "id", "code", "severity", "amount_at_risk", "kind", "record_id", _joined("attempted").alias("attempted"),
        "suggested_action")


@query
def exception_summary(spark, sf):
    return reporting.exception_summary(_run(spark, sf).exceptions)


@query
def largest_exceptions(spark, sf):
    return reporting.list_exceptions(_run(spark, sf).exceptions).select("id", "code", "amount_at_risk", "total", "truncated")


@query
def exceptions_of_code(spark, sf):
    return reporting.list_exceptions(_run(spark, sf).exceptions, "DUPLICATE_CANDIDATE").select(
        "id", "amount_at_risk", "total", "truncated")


@query
def report_positions(spark, sf):
    return reporting.report_positions(_run(spark, sf).exceptions).select("position", "id", "severity", "amount_at_risk")


@query
def matched_by_status(spark, sf):
    return reporting.list_groups(_run(spark, sf).groups, "auto", "P3").select("id", "bank_line_id", "total", "truncated")


@query
def record_lookup(spark, sf):
    run = _run(spark, sf)
    wanted = run.books.payments.select(F.lit("payment").alias("kind"), F.explode(F.array(
        F.col("id"), F.concat(F.lit("ghost_"), "id"))).alias("id")).unionByName(
        run.books.invoices.select(F.lit("invoice").alias("kind"), "id"))
    return reporting.locate_records(wanted, run.groups, run.members, run.exceptions)


@query
def record_search(spark, sf):
    run = _run(spark, sf)
    return reporting.search_records(run.groups, run.members, run.exceptions, " 0012 ")


@query
def exception_codes(spark, sf):
    counts = _run(spark, sf).exceptions.groupBy("code").agg(F.count("*").alias("n"))
    return exception_dimension(spark).join(counts, "code", "left").select(
        "code", "label", "severity", F.coalesce("n", F.lit(0)).alias("n"))


# ----------------------------------------------------------------- scoring


def _scored(spark, sf):
    run = _run(spark, sf)
    return run, fixture.answer_key(run.books)


def _rounded(rows: DataFrame, *names: str) -> DataFrame:
    for name in names:
        rows = rows.withColumn(name, F.round(name, 6))
    return rows


@query
def run_metrics(spark, sf):
    run, key = _scored(spark, sf)
    return _rounded(scoring.run_metrics(run.books, run.groups, run.members, run.exceptions, key),
                    "auto_rate", "assist_rate", "open_rate", "precision", "recall")


@query
def class_recall(spark, sf):
    run, key = _scored(spark, sf)
    return _rounded(scoring.class_recall(run.groups, run.members, key), "recall").withColumn(
        "label", text.class_label(F.col("class")))


@query
def class_counts(spark, sf):
    return scoring.class_counts(fixture.answer_key(fixture.books(spark, sf)))


@query
def chain_counts(spark, sf):
    run = _run(spark, sf)
    return scoring.chain_counts(run.groups, run.members)


@query
def accounting_check(spark, sf):
    run = _run(spark, sf)
    return scoring.accounting(run.books, run.members, run.exceptions)


@query
def run_impact(spark, sf):
    run = _run(spark, sf)
    return scoring.run_impact(scoring.run_metrics(run.books, run.groups, run.members, run.exceptions))


@query
def output_hash(spark, sf):
    run = _run(spark, sf)
    return scoring.output_hash(run.groups, run.members)


def _history(spark, sf):
    k = F.col("k")
    return fixture.orders(spark, sf).select(
        F.concat(F.lit("label "), (k % 10).cast("string")).alias("label"), (k % 977).alias("records"),
        F.when(k % 4 != 1, (k % 100) / 100.0).alias("precision"), F.when(k % 4 != 1, (k % 64) / 64.0).alias("recall"),
        F.when(k % 4 != 1, k % 3).alias("false_matches"), ((k % 256) / 256.0).alias("auto_rate"),
        (k % 83).alias("open_exceptions"), (F.col("amount") / 100.0).alias("throughput_rps"))


@query
def sweep_summary(spark, sf):
    return scoring.sweep_summary(_history(spark, sf))


# --------------------------------------------------------------- reporting


@query
def cash_forecast(spark, sf):
    run = _run(spark, sf)
    return reporting.cash_forecast(run.books.settlements, run.groups, run.exceptions)


@query
def forecast_report(spark, sf):
    run = _run(spark, sf)
    return reporting.nonzero_days(reporting.cash_forecast(run.books.settlements, run.groups, run.exceptions))


@query
def unrecognised_cash(spark, sf):
    run = _run(spark, sf)
    return reporting.unrecognised_cash(run.books.bank_lines, run.exceptions)


@query
def decision_overlay(spark, sf):
    run = _run(spark, sf)
    decided = reporting.decision_overlay(run.exceptions, derived.decisions(run, "r1"), "r1")
    return decided.select("id", "decision", "note")


@query
def run_comparison(spark, sf):
    run, triaged = _triaged(spark, sf)
    key = fixture.answer_key(run.books)
    first = scoring.run_metrics(run.books, run.groups, run.members, run.exceptions, key)
    second = scoring.run_metrics(run.books, triaged.groups, triaged.members, triaged.exceptions, key)
    both = first.withColumn("run_id", F.lit("run-1")).unionByName(second.withColumn("run_id", F.lit("run-2")))
    events = derived.events(spark, sf)
    spent = catalog.usage_totals(derived.calls_of(events)).join(
        catalog.total_duration(catalog.latest_state(derived.trace_of(events))), "run_id")
    spent = spent.select("run_id", F.col("requests").alias("llm_requests"), F.col("tokens").alias("llm_tokens"), "millis")
    figures = both.join(spent, "run_id", "left").withColumn("throughput_rps", F.col("records") * 1000 / F.col("millis"))
    return _rounded(reporting.compare_runs(figures, "run-1", "run-2"), "a", "b", "delta_b_minus_a")


# ------------------------------------------------------------------ triage


@query
def triage_offers(spark, sf):
    return triage.candidate_groups(_run(spark, sf))


@query
def triage_verdicts(spark, sf):
    _, triaged = _triaged(spark, sf)
    return triaged.verdicts.select("settlement_id", "proposal_ord", "bank_line_id", "accepted", "failed_check")


@query
def triaged_groups(spark, sf):
    _, triaged = _triaged(spark, sf)
    return triaged.groups.select("id", "bank_line_id", "status", "pass_id", "confidence")


@query
def triaged_exceptions(spark, sf):
    _, triaged = _triaged(spark, sf)
    return triaged.exceptions.select("id", "code", "amount_at_risk", "failed_check")


@query
def explained_exceptions(spark, sf):
    exceptions = _run(spark, sf).exceptions
    texts = triage.distinct_codes(exceptions).filter("code <> 'REFUND_UNLINKED'").select(
        F.concat(F.lit("  "), F.lower("code")).alias("code"),
        F.repeat(F.concat(label_of(F.col("code")), F.lit(". ")), 9).alias("explanation"),
        F.when(F.col("code").startswith("M"), F.lit("")).otherwise(F.concat(F.lit("Check "), "code"))
        .alias("suggested_action"), F.lit(2).alias("given"))
    dropped = texts.withColumns({"explanation": F.lit("withdrawn"), "given": F.lit(1)})
    return triage.explain(exceptions, texts.unionByName(dropped)).select("id", "code", "explanation", "suggested_action")


# ------------------------------------------------------------------ scalars


@query
def parsed_amounts(spark, sf):
    k, plain = F.col("k"), money.format_paise(F.col("amount"))
    wide = F.translate(plain, "0123456789", "０１２３４５６７８９")
    shapes = [plain, F.concat(F.lit("₹ "), plain), F.concat(F.lit("("), plain, F.lit(")")),
              F.concat(plain, F.lit(" Dr.")), F.concat(F.lit("Rs. "), plain, F.lit(" Cr")), F.concat(F.lit("-"), plain),
              wide, F.concat(plain, F.lit("9")), F.concat(F.lit("INR "), F.replace(plain, F.lit(","), F.lit(""))),
              F.concat(plain, F.lit("x")), F.lit("  ")]
    shape = F.get(F.array(*shapes), (k % len(shapes)).cast("int"))
    parsed = fixture.orders(spark, sf).select(k, shape.alias("written")).select("k", money.parse_amount(F.col("written")).alias("p"))
    return parsed.select("k", "p.paise", "p.error")


@query
def rendered_amounts(spark, sf):
    signed = F.when(F.col("k") % 3 == 0, -F.col("amount")).when(F.col("k") % 3 == 1, F.col("amount") % 1000).otherwise(
        F.col("amount") * 1000 + F.col("k"))
    rows = fixture.orders(spark, sf).select("k", signed.alias("paise"))
    return rows.select("k", money.format_paise(F.col("paise")).alias("plain"), money.rupees(F.col("paise")).alias("report"))


@query
def parsed_dates(spark, sf):
    k, day = F.col("k"), F.col("issued_at")
    iso = F.date_format(day, "yyyy-MM-dd")
    shapes = [iso, F.date_format(day, "yyyyMMdd"), F.date_format(day, "d/M/yyyy"), F.date_format(day, "d-MMM-yy"),
              F.upper(F.date_format(day, "dd-MMM-yy")), F.date_format(day, "yyyy-M-d"), F.concat(iso, F.lit(" 10:23:45")),
              F.concat(iso, F.lit("T21:00:00Z")), F.concat(iso, F.lit("T21:00:00+05:30")),
              F.concat(F.date_format(day, "d/M/yyyy"), F.lit(" 9:05 pm")), F.lit("31/02/2024"), F.lit("12-Foo-24"),
              F.concat(iso, F.lit("?")), F.lit(" ")]
    written = F.get(F.array(*shapes), (k % len(shapes)).cast("int"))
    rows = fixture.orders(spark, sf).select("k", written.alias("written"))
    return rows.select("k", dates.parse_date(F.col("written")).alias("p")).select("k", "p.day", "p.error")


@query
def serial_dates(spark, sf):
    return fixture.orders(spark, sf).select("k", dates.excel_date(F.lit(45299.75) + F.col("k") % 500).alias("day"),
                                            dates.ist_text(F.col("issued_at").cast("timestamp")).alias("shown"))


@query
def business_days(spark, sf):
    days = fixture.orders(spark, sf).select("issued_at").distinct()
    return days.select("issued_at", is_business_day("issued_at").alias("open"),
                       *[add_business_days("issued_at", n).alias(f"d_{'m' if n < 0 else 'p'}{abs(n)}")
                         for n in (-5, -1, 0, 1, 5, 8)])


@query
def narration_references(spark, sf):
    line = F.col("narration")
    lines = fixture.books(spark, sf).bank_lines
    return lines.select("id", _joined(narration.utrs(line)).alias("utrs"), _joined(narration.rrns(line)).alias("rrns"),
                        narration.rail(line).alias("rail"))


def _gateway_narrations(spark, sf):
    rows = fixture.payments(spark, sf)
    line = F.concat(
        F.upper(F.col("method")), F.lit("/RRN "), F.lpad((F.col("ord") + 400000000000).cast("string"), 12, "0"),
        F.lit("/"), F.col("id"), F.lit("/order_"), F.lpad(F.col("ord").cast("string"), 8, "0"), F.lit(" for "),
        F.coalesce(F.lower("invoice_ref"), F.lit("misc")), F.lit(" from ACME TRADERS VIA "),
        F.when(F.col("ord") % 3 == 0, "imps").when(F.col("ord") % 3 == 1, "UPI").otherwise("cash"))
    return rows.select("id", line.alias("narration"))


@query
def gateway_references(spark, sf):
    line = F.col("narration")
    return _gateway_narrations(spark, sf).select(
        "id", _joined(narration.rrns(line)).alias("rrns"), _joined(narration.pay_ids(line)).alias("pay_ids"),
        _joined(narration.order_ids(line)).alias("order_ids"),
        _joined(narration.invoice_tokens(line)).alias("invoice_tokens"), narration.rail(line).alias("rail"))


@query
def narration_payers(spark, sf):
    lines = fixture.books(spark, sf).bank_lines
    return lines.select("id", narration.payer(F.col("narration")).alias("payer"))


@query
def canonical_references(spark, sf):
    b = F.col("ord")
    written = F.when(b % 3 == 0, F.col("utr")).when(b % 3 == 1, F.concat(
        F.lit("  utr no. : "), F.expr("substring(utr, 4, 6)"), F.lit(" "), F.expr("substring(utr, 10)"))).otherwise(
        F.concat(F.lit("RRN#"), F.expr("substring(utr, 4)"), F.lit("x")))
    batches = fixture.settlements(fixture.payments(spark, sf))
    return batches.select("id", narration.canonical_utr(written).alias("reference"))


@query
def payment_economics(spark, sf):
    return fixture.payments(spark, sf).groupBy("method").agg(
        F.count("*").alias("payments"), F.sum("gross").alias("gross"), F.sum("fee").alias("fee"),
        F.sum("tax").alias("tax"), F.sum("net").alias("net"))


@query
def display_figures(spark, sf):
    k = F.col("k")
    return fixture.orders(spark, sf).select(
        "k", money.duration_text(k * 7).alias("duration"), money.elapsed_text(k * 137).alias("elapsed"),
        money.stage_text(k % 3000).alias("stage"),
        money.percent_text((k % 1000) / 1000.0).alias("percent"),
        money.optional_text(F.when(k % 4 != 0, (k % 1000) / 1000.0)).alias("optional"))


@query
def request_digests(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    prompts = turns.select(F.col("role").alias("model"), F.lit("triage-v1").alias("schema"), F.col("text").alias("prompt"))
    return catalog.distinct_requests(prompts).select("request_key", "askers", text.token_estimate(F.col("prompt")).alias("tokens"))


@query
def subset_sums(spark, sf):
    books = fixture.books(spark, sf)
    paid = books.payments.filter("settlement_id is not null")
    rank = F.row_number().over(Window.partitionBy("settlement_id").orderBy("ord"))
    tried = SUBSET_CANDIDATES
    few = paid.select("settlement_id", "id", "gross", "ord").withColumn("rn", rank).filter(F.col("rn") <= tried)
    # At most eight rows per settlement from here on; how many more there are is counted.
    offered = few.groupBy("settlement_id").agg(
        F.array_sort(F.collect_list(F.struct("rn", "id", "gross"))).alias("c"),
        F.sum(F.when(F.col("rn").isin(2, 3, 5), F.col("gross"))).alias("target"))
    offered = offered.join(paid.groupBy("settlement_id").agg(F.count("*").alias("payments")), "settlement_id")
    offered = offered.select("settlement_id", "target", F.greatest(F.col("payments") - tried, F.lit(0)).alias("left_out"), F.transform(
        "c", lambda c: F.struct(c["id"].alias("id"), c["gross"].alias("gross"))).alias("candidates"))
    found = similarity.subset_sum(offered)
    return found.select("settlement_id", "target", _joined("subset").alias("subset"), "solutions", "left_out")


@query
def running_balance(spark, sf):
    lines = fixture.books(spark, sf).bank_lines
    return ordering.running_balance(lines).select("id", "value_date", "credit", "balance")


@query
def repeated_ids(spark, sf):
    books = fixture.books(spark, sf)
    doubled = books.bank_lines.unionByName(books.bank_lines.filter("id like 'BNKD%'"))
    return duplicate_ids(books.replaced(bank_lines=doubled))


# ------------------------------------------------------------------- files


def _ingested(spark, sf, role):
    def build():
        files = materialize(derived.raw_files(spark, sf, role), "raw")
        parsed = tables.parse_files(files.select("path", "content"))
        parsed = replace(parsed, files=materialize(parsed.files, "files"), rows=materialize(parsed.rows, "rows"))
        described = parsed.files.withColumn("role", F.lit(role))
        rows = mapping.mapped_rows(parsed.rows, described, mapping.map_shapes(described))
        return parsed, records.build_records(rows, role)
    return _stored(spark, sf, f"files-{role}", build)


@query
def ledger_files(spark, sf):
    return _ingested(spark, sf, "ledger")[1].good.select("id", "number", "customer", "amount", "issued_at", "ref")


@query
def large_files(spark, sf):
    """Invoices in a few files that grow with the table, with line ends inside quotes, read in byte ranges."""
    folder = new_folder(spark, "large-files")
    source = fixture.invoices(spark, sf).select(
        F.col("id").alias("Invoice No"), F.format_string('Naïve & Co, "%d"\nsecond line', "ord").alias("Customer"),
        F.col("amount").cast("string").alias("Amount"), F.date_format("issued_at", "yyyy-MM-dd").alias("Invoice Date"),
        F.col("ref").alias("Reference"))
    source.repartition(2, F.xxhash64("Invoice No")).write.option("header", True).option("escape", '"').csv(folder)
    parsed = tables.parse_paths(spark, folder)
    return parsed.rows.select(*[F.get("values", F.lit(i)).alias(name) for i, name in enumerate(
        ("id", "customer", "amount", "issued_at", "ref"))])


@query
def gateway_files(spark, sf):
    return _ingested(spark, sf, "gateway")[1].good.select(
        "id", "invoice_ref", "gross", "fee", "tax", "net", "status", F.to_date("captured_at").alias("captured_on"),
        "method", "settlement_id")


@query
def settlement_files(spark, sf):
    return _ingested(spark, sf, "settlement")[1].good.select(
        "id", "utr", "payout", "fees", "tax", "adjustments", "settled_at", _joined("payment_ids").alias("payment_ids"))


@query
def bank_files(spark, sf):
    return _ingested(spark, sf, "bank")[1].good.select("id", "value_date", "narration", "credit", "debit", "balance")


@query
def file_repairs(spark, sf):
    parsed = _ingested(spark, sf, "ledger")[0]
    return parsed.files.select("path", "encoding", F.when(F.col("delimiter") == "\t", "tab").otherwise(
        F.col("delimiter")).alias("delimiter"), "header_row", "preamble_rows", "blank_rows", "summary_rows",
        "truncated_rows", "data_rows", _joined("headers").alias("headers"))


@query
def file_health(spark, sf):
    return _ingested(spark, sf, "bank")[1].health


@query
def row_errors(spark, sf):
    return records.reported_errors(_ingested(spark, sf, "gateway")[1].errors)


@query
def error_reasons(spark, sf):
    return records.error_reasons(_ingested(spark, sf, "ledger")[1].errors)


@query
def header_mapping(spark, sf):
    parts = []
    for role in ("ledger", "gateway", "settlement", "bank"):
        names = F.split(F.lit(derived.HEADERS[role].replace("{d}", ";")), ";")
        parts.append(fixture.orders(spark, sf).select(
            F.concat(F.lit(f"{role}-"), F.col("k").cast("string")).alias("path"), F.lit(role).alias("role"),
            F.concat(names, F.array(F.concat(F.lit("Extra "), F.col("o_custkey").cast("string")))).alias("headers")))
    files = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    signed = files.select("role", text.header_signature(F.col("headers")).alias("signature"), "headers").distinct()
    wanted = signed.select("role", "signature", F.get("headers", F.size("headers") - 1).alias("header"),
                           F.when(F.col("role") == "ledger", "number").otherwise("id").alias("field"),
                           F.lit(1).alias("ord"))
    return mapping.map_shapes(files, wanted).select(
        "role", "signature", _joined(F.transform("fields", lambda f: F.coalesce(f, F.lit("-")))).alias("fields"))


@query
def file_kinds(spark, sf):
    magic = F.array(*[F.lit(m) for m in ("504B0304", "89504E470D0A1A0A", "FFD8FF00", "474946383961", "255044462D", "")])
    k = F.col("k")
    files = fixture.orders(spark, sf).select(
        F.concat(F.lit("f"), k.cast("string")).alias("path"),
        F.unhex(F.concat(F.get(magic, (k % 6).cast("int")), F.when(k % 12 == 5, "").otherwise("610A"))).alias("content"))
    return files.select("path", tables.content_kind(F.col("content")).alias("kind"))


@query
def file_previews(spark, sf):
    parsed = _ingested(spark, sf, "settlement")[0]
    return tables.preview(parsed).select("path", "row_number", _joined("headers").alias("headers"),
                                         F.get("values", F.lit(0)).alias("first_value"))


@query
def statement_lines(spark, sf):
    lines = fixture.books(spark, sf).bank_lines
    written = F.concat(F.date_format("value_date", "dd/MM/yyyy"), F.lit("  "), text.collapse(F.col("narration")),
                       F.lit("  "), money.format_paise(F.col("credit")), F.lit(" CR"))
    noise = lines.select("id", F.explode(F.array(written, F.concat(F.lit("Page "), "id"))).alias("value"))
    return tables.statement_lines(noise)


@query
def text_round_trip(spark, sf):
    """Invoices to their export text and back through mapping and validation."""
    source = fixture.invoices(spark, sf, named=True)
    names = ["id", "number", "customer", "amount", "issued_at", "ref"]
    exported = records.canonical_text(source.select(*names), "ledger")
    rows = exported.select(F.lit("all").alias("path"), F.lit("ledger").alias("role"), F.substring("id", 4, 9).try_cast(
        "long").alias("row_number"), F.map_from_arrays(
            F.array(*[F.lit(n) for n in names]), F.array(*names)).alias("fields"))
    return records.build_records(rows, "ledger").good.select(*names)


@query
def json_round_trip(spark, sf):
    run = _run(spark, sf)
    paid = codecs.records_from_json(codecs.records_to_json(run.books.payments), "gateway")
    filed = codecs.from_json_lines(codecs.to_json_lines(run.exceptions), codecs.EXCEPTION_SCHEMA)
    return paid.agg(F.lit("payments").alias("part"), F.count("*").alias("n"), F.sum("gross").alias("amount")).unionByName(
        filed.agg(F.lit("exceptions").alias("part"), F.count("*").alias("n"), F.sum("amount_at_risk").alias("amount")))


@query
def books_round_trip(spark, sf):
    """Books to the JSON lines of the four roles and back, run again, and the result through its own JSON: the hash stays."""
    run = _run(spark, sf)
    books, folder = run.books, new_folder(spark, "books-json")
    listed = books.membership.groupBy("settlement_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "payment_id"))),
                                                                       lambda p: p["payment_id"]).alias("payment_ids"))
    settled = books.settlements.join(listed, F.col("id") == F.col("settlement_id"), "left").drop("settlement_id")
    parts = {"ledger": books.invoices, "gateway": books.payments, "bank": books.bank_lines,
             "settlement": settled.withColumn("payment_ids", F.coalesce("payment_ids", F.array().cast("array<string>")))}
    for role, rows in parts.items():
        codecs.records_to_json(rows).write.option("compression", "gzip").text(f"{folder}/{role}")
    read = {role: spark.read.text(f"{folder}/{role}").withColumnRenamed("value", "json") for role in parts}
    again = reconcile(codecs.books_from_json(**read).replaced(unique_ids=True))
    codecs.write_result(again.groups, again.members, again.exceptions, f"{folder}/result")
    groups, members, _ = codecs.read_result(spark, f"{folder}/result")
    first, second = scoring.output_hash(run.groups, run.members), scoring.output_hash(groups, members)
    return first.withColumn("part", F.lit("books")).unionByName(second.withColumn("part", F.lit("json")))


@query
def exceptions_export(spark, sf):
    return codecs.exceptions_export(_run(spark, sf).exceptions)


# ----------------------------------------------------------------- catalog


@query
def dataset_readiness(spark, sf):
    sets = catalog.file_readiness(derived.datasets(spark, sf), derived.dataset_files(spark, sf))
    return sets.select("id", "roles_ready", "status")


@query
def ready_datasets(spark, sf):
    sets = catalog.file_readiness(derived.datasets(spark, sf), derived.dataset_files(spark, sf))
    return catalog.ready_datasets(sets).select("id", "name")


@query
def runs_per_dataset(spark, sf):
    return catalog.runs_per_dataset(derived.datasets(spark, sf), derived.runs(spark, sf))


@query
def repeated_request_keys(spark, sf):
    return catalog.repeated_keys(derived.runs(spark, sf), "user_id", "idempotency_key").unionByName(
        catalog.repeated_keys(derived.datasets(spark, sf), "user_id", "name").withColumnRenamed("name", "idempotency_key"))


@query
def constraint_breaches(spark, sf):
    """All rules of the catalog in one pass, over tables with planted breaches of each."""
    files = derived.dataset_files(spark, sf).select("dataset_id", F.when(
        F.col("uploaded_at") % 101 == 3, F.lit("invoice")).otherwise(F.col("role")).alias("role"))
    filed = fixture.settlements(fixture.payments(spark, sf)).select(
        F.concat(F.lit("r"), (F.col("ord") % 3).cast("string")).alias("run_id"), F.concat(F.lit("EXC-settlement-"), "id").alias("exception_id"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("ord") % 31 == 4, 2).otherwise(1))).alias("copy"))
    batches = fixture.orders(spark, sf).select(F.col("b").alias("seed")).distinct()
    tables_ = {
        "datasets": derived.datasets(spark, sf).withColumn("user_id", F.col("user_id") % 7), "files": files, "exceptions": filed,
        "runs": derived.runs(spark, sf).withColumn("user_id", F.col("user_id") % 7),
        "golden": batches.filter("seed % 50 = 1"), "held_out": batches.filter("seed % 70 = 1")}
    return constraints.breaches(tables_, catalog.RULES)


@query
def idempotent_runs(spark, sf):
    keyed = derived.runs(spark, sf).withColumn("user_id", F.col("user_id") % 7)
    return catalog.idempotent_rows(keyed).select("id", "user_id", "idempotency_key")


@query
def replaced_files(spark, sf):
    return catalog.upsert_files(derived.dataset_files(spark, sf), derived.uploads(spark, sf)).select(
        "dataset_id", "role", "row_count", "valid_count")


@query
def deleted_datasets(spark, sf):
    sets = derived.datasets(spark, sf)
    doomed = sets.filter(F.substring("id", 3, 8).cast("long") % 4 == 1)
    return catalog.delete_datasets(doomed, sets, derived.dataset_files(spark, sf), derived.runs(spark, sf))[3]


@query
def surviving_runs(spark, sf):
    sets = derived.datasets(spark, sf)
    doomed = sets.filter(F.substring("id", 3, 8).cast("long") % 4 == 1)
    kept = catalog.delete_datasets(doomed, sets, derived.dataset_files(spark, sf), derived.runs(spark, sf))[2]
    return kept.select("id", "dataset_id")


@query
def removed_files(spark, sf):
    files = derived.dataset_files(spark, sf)
    gone = files.filter("role = 'bank' and row_count % 2 = 0")
    return catalog.remove_file(derived.datasets(spark, sf), files, gone)[0].select("id", "roles_ready", "status")


@query
def newest_runs(spark, sf):
    return catalog.newest_per_user(derived.runs(spark, sf), 3).select("user_id", "position", "id", "state")


@query
def user_runs(spark, sf):
    return catalog.newest(derived.runs(spark, sf), 5, 50).select("id", "state", "dataset_id")


@query
def run_datasets(spark, sf):
    return catalog.dataset_of_run(derived.runs(spark, sf), derived.datasets(spark, sf), derived.dataset_files(spark, sf)
                                  ).select("run_id", "dataset_id", "name", "has_truth_file", "role", "row_count", "valid_count")


@query
def record_page(spark, sf):
    return catalog.page(fixture.invoices(spark, sf), 400, 500).select("id", "amount", "total")


@query
def run_states(spark, sf):
    return catalog.latest_state(derived.trace_of(derived.events(spark, sf))).select("run_id", "state")


@query
def orphan_sweep(spark, sf):
    return catalog.sweep_orphans(catalog.latest_state(derived.trace_of(derived.events(spark, sf)))).select(
        "run_id", "state", "swept")


@query
def stage_durations(spark, sf):
    return catalog.stage_durations(derived.trace_of(derived.events(spark, sf)))


@query
def run_durations(spark, sf):
    return catalog.total_duration(catalog.latest_state(derived.trace_of(derived.events(spark, sf))))


@query
def usage_totals(spark, sf):
    return catalog.usage_totals(derived.calls_of(derived.events(spark, sf)))


@query
def latest_decisions(spark, sf):
    latest = reporting.latest_decisions(derived.decisions(_run(spark, sf), "r1"))
    return reporting.capped(latest, F.asc("exception_id")).select("exception_id", "decision", "total", "truncated")


# --------------------------------------------------------------- streaming


@query
def streamed_states(spark, sf):
    stream = trace.distinct_states(derived.trace_of(derived.event_stream(spark, sf)))
    return trace.drain(stream.select("run_id", "state"), "states")


@query
def streamed_run_states(spark, sf):
    moves = trace.drain(trace.transitions(derived.trace_of(derived.event_stream(spark, sf))), "moves")
    return trace.last_states(moves)


@query
def streamed_usage(spark, sf):
    calls = derived.calls_of(derived.event_stream(spark, sf))
    counts = trace.drain_counts(usage.calls_per_window(calls, ["model"], "1 day", "30 days"), "usage", ["model", "window_start"])
    return usage.over_limit(counts, 50).select("model", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "calls", "over")


@query
def usage_by_minute(spark, sf):
    counts = usage.calls_per_window(derived.calls_of(derived.events(spark, sf)), ["model"], "1 minute")
    return usage.over_limit(counts, 1).select(
        "model", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("minute"), "calls", "over")


@query
def usage_by_user_day(spark, sf):
    counts = usage.calls_per_window(derived.calls_of(derived.events(spark, sf)), ["user_id"], "1 day")
    return usage.over_limit(counts, 3).select(
        "user_id", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "calls", "over")


@query
def streamed_stage_durations(spark, sf):
    """Stage times kept up live over files that bring late rows, as they stand at the end."""
    live = stages.live_stage_durations(derived.trace_of(derived.event_files(spark, sf)), 60 * 86_400_000, "40 days")
    return trace.drain_counts(live, "stages", ["run_id", "state"])


def _limit_report(minutes: DataFrame, spark, sf) -> DataFrame:
    found = usage.against_limits(minutes, derived.limits(spark, sf), derived.key_pool(spark, sf), None)
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query
def usage_against_limits(spark, sf):
    return _limit_report(usage.usage_by_minute(derived.keyed_calls(derived.events(spark, sf))), spark, sf)


@query
def streamed_usage_against_limits(spark, sf):
    """The minutes are counted on a stream of several files, the limits are looked up in what it leaves."""
    stream = usage.usage_by_minute(derived.keyed_calls(derived.event_files(spark, sf)), "40 days")
    return _limit_report(trace.drain_counts(stream, "minutes", usage.MINUTE_KEYS), spark, sf)


def _in_two_batches(spark, sf) -> OpenBooks:
    """All books first, but the lines of odd batches only in a second batch."""
    def build():
        books = fixture.books(spark, sf)
        late = F.floor(F.col("ord") / 3) % 2 == 1
        held = OpenBooks(spark)
        held.apply(books.replaced(bank_lines=books.bank_lines.filter(~late)), 0)
        nothing = {k: getattr(books, k).limit(0) for k in ("invoices", "payments", "settlements", "membership")}
        held.apply(books.replaced(bank_lines=books.bank_lines.filter(late), **nothing), 1)
        return held
    return _stored(spark, sf, "two-batches", build)


@query
def incremental_groups(spark, sf):
    return _in_two_batches(spark, sf).groups().select("id", "bank_line_id", F.col("batch").cast("long").alias("batch"))


@query
def incremental_exceptions(spark, sf):
    """What is open after both batches, kept up record by record."""
    return _in_two_batches(spark, sf).exceptions().select(
        "id", "code", "severity", "amount_at_risk", "kind", "record_id", _joined("attempted").alias("attempted"), "suggested_action")


# ------------------------------------------------------------------ faults


def _corrupted(spark, sf, *specs: faults.Fault):
    def build():
        books = fixture.stored_books(spark, sf)
        key = fixture.answer_key(books)
        return books, replace(key, groups=materialize(key.groups, "key_groups"),
                              members=materialize(key.members, "key_members"),
                              records=materialize(key.records, "key_records"))
    books, key = _stored(spark, sf, "sound", build)
    return faults.apply_faults(books, key, list(specs), seed=7)


@query
def fault_duplicate_payment(spark, sf):
    books, _ = _corrupted(spark, sf, faults.Fault("duplicate_payment", fraction=0.05))
    return books.payments.select("id", "invoice_ref", "gross", "settlement_id")


@query
def fault_shift_date(spark, sf):
    books, _ = _corrupted(spark, sf, faults.Fault("shift_date", days=45, fraction=0.05))
    return books.bank_lines.select("id", "value_date")


@query
def fault_alter_amount(spark, sf):
    books, _ = _corrupted(spark, sf, faults.Fault("alter_amount", fraction=0.05))
    return books.payments.select("id", "gross", "fee")


@query
def fault_delete_bank_line(spark, sf):
    _, key = _corrupted(spark, sf, faults.Fault("delete_bank_line", fraction=0.05))
    return key.groups


@query
def fault_inject_credit(spark, sf):
    books, key = _corrupted(spark, sf, faults.Fault("inject_unrelated_credit", fraction=0.05))
    hard = key.records.filter("kind = 'bank_line'").select("id", "difficulty")
    return books.bank_lines.join(hard, "id").select("id", "value_date", "narration", "credit", "difficulty")


@query
def fault_scramble_narration(spark, sf):
    books, _ = _corrupted(spark, sf, faults.Fault("scramble_narration", fraction=0.05))
    return books.bank_lines.select("id", "narration")


@query
def fault_split_payment(spark, sf):
    books, key = _corrupted(spark, sf, faults.Fault("split_payment", fraction=0.05))
    rated = key.records.filter("kind = 'payment'").select("id", "group_id", "difficulty")
    return books.payments.join(rated, "id").select("id", "gross", "fee", "tax", "net", "settlement_id", "group_id", "difficulty")


@query
def faulted_run(spark, sf):
    """A run over chained corruptions, one victim each, with its figures against the answer key."""
    books, key = _corrupted(spark, sf, *faults.planned(spark, [
        "duplicate_payment", "shift_date:45", "alter_amount:-150000", "delete_bank_line", "scramble_narration",
        "split_payment", "inject_unrelated_credit"]))
    run = reconcile(books)
    return _rounded(scoring.run_metrics(books, run.groups, run.members, run.exceptions, key).select(
        "records", "payments_total", "payments_auto", "open_exceptions", "amount_at_risk", "amount_cleared",
        "false_matches", "precision", "recall"), "precision", "recall")


# ------------------------------------------------------------------- audits


@query
def answer_grounding(spark, sf):
    written = derived.answers(spark, sf)
    return audit.answer_grounding(written, written)


@query
def answer_citations(spark, sf):
    written = derived.answers(spark, sf)
    known = written.select("answer_id", F.posexplode(F.array(
        F.struct(F.lit("invoice").alias("kind"), F.concat(F.lit("INV"), F.lpad(F.col("answer_id").cast("string"), 9, "0")).alias("id")),
        F.struct(F.lit("settlement").alias("kind"), F.lit("STL12").alias("id")),
        F.struct(F.lit("settlement").alias("kind"), F.lit("open").alias("id")),
        F.struct(F.lit("run").alias("kind"), F.lit("open").alias("id")))).alias("seen", "r")).select("answer_id", "seen", "r.*")
    return audit.citations(written, known)
