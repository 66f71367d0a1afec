"""Tie payments to invoices: by reference, else by a unique amount and date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tieout.functions.calendar import add_business_days
from tieout.functions.money import band_limits
from tieout.model import Books
from tieout.operators.joins import spread_nulls
from tieout.session import materialize
from tieout.vocab import INVOICE_WINDOW_BUSINESS_DAYS

_CHUNK_BITS = 12


def invoice_references(books: Books) -> DataFrame:
    """(ref) with the number of invoices that carry it, and the invoice if there is one."""
    return (books.invoices.filter("ref is not null and ref <> ''").groupBy("ref")
            .agg(F.count("*").alias("ref_hits"), F.min("id").alias("ref_invoice_id")))


def capture_windows(invoices: DataFrame, days: int = INVOICE_WINDOW_BUSINESS_DAYS) -> DataFrame:
    """(captured_on, issued_at): issue dates in use, by the capture dates their window covers."""
    return (invoices.select("issued_at").distinct()
            .select("issued_at", F.explode(F.sequence(
                add_business_days("issued_at", -days), add_business_days("issued_at", days)))
                .alias("captured_on")))


def _amount_chunk(amount: Column) -> list[Column]:
    """An order-preserving coarse amount: its magnitude and its leading bits.

    Each chunk spans a bounded run of amounts, so a running sum inside one chunk
    stays small even when all records share a date.
    """
    shift = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(amount, F.lit(1)))) - _CHUNK_BITS).cast("int")
    return [shift.alias("shift"), F.call_function("shiftright", amount, shift).alias("lead")]


def band_candidates(probes: DataFrame, invoices: DataFrame,
                    days: int = INVOICE_WINDOW_BUSINESS_DAYS) -> DataFrame:
    """For each distinct (captured_on, gross): how many invoices fit, and a fingerprint of them.

    Counting a rectangle without listing it: per issue date the invoices are
    summed up by amount, and a probe is the running count at the top of its fee
    band less the one below it. Next to the count runs the XOR of the invoices'
    `ord`, which is the invoice itself where the count is one. The work is a sort
    of invoices plus probes; no pair of the two is ever built.
    """
    windows = capture_windows(invoices, days)
    points = invoices.groupBy("issued_at", "amount").agg(
        F.count("*").alias("n"), F.expr("bit_xor(ord)").alias("x"))
    probes = probes.select("captured_on", "gross").distinct()
    dated = probes.join(windows, "captured_on")

    low, high = band_limits(F.col("gross"))
    edges = (dated.filter("gross > 0")
             .select("issued_at", "captured_on", "gross",
                     F.explode(F.array(F.struct(low.alias("at"), F.lit(-1).alias("side")),
                                       F.struct(high.alias("at"), F.lit(1).alias("side")))).alias("edge"))
             .select("issued_at", F.col("edge.at").alias("at"), F.col("edge.side").alias("side"),
                     F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("x"), "captured_on", "gross"))
    line = edges.unionByName(points.filter("amount > 0").select(
        "issued_at", F.col("amount").alias("at"), F.lit(0).alias("side"), "n", "x",
        F.lit(None).cast("date").alias("captured_on"), F.lit(None).cast("long").alias("gross")))
    line = line.select("*", *_amount_chunk(F.col("at")))

    # A lower edge sorts before the invoices at its amount, an upper edge after them.
    running = Window.partitionBy("issued_at", "shift", "lead").orderBy("at", "side").rowsBetween(
        Window.unboundedPreceding, 0)
    inside = (line.withColumn("n_run", F.sum("n").over(running))
              .withColumn("x_run", F.expr("bit_xor(x)").over(running)).filter("side <> 0"))
    before = Window.partitionBy("issued_at").orderBy("shift", "lead").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (line.groupBy("issued_at", "shift", "lead").agg(F.sum("n").alias("n"), F.expr("bit_xor(x)").alias("x"))
              .select("issued_at", "shift", "lead", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
                      F.coalesce(F.expr("bit_xor(x)").over(before), F.lit(0)).alias("x_before")))
    positive = (inside.join(chunks, ["issued_at", "shift", "lead"])
                .select("captured_on", "gross",
                        (F.col("side") * (F.col("n_run") + F.col("n_before"))).alias("n"),
                        F.col("x_run").bitwiseXOR(F.col("x_before")).alias("x")))
    # Invoices at zero fit a gross of zero; those below zero fit any gross.
    odd = (points.filter("amount <= 0")
           .groupBy("issued_at", (F.col("amount") == 0).alias("zero"))
           .agg(F.sum("n").alias("n"), F.expr("bit_xor(x)").alias("x")))
    odd = (dated.join(odd, "issued_at").filter(~F.col("zero") | (F.col("gross") == 0))
           .select("captured_on", "gross", "n", "x"))
    return (positive.unionByName(odd).groupBy("captured_on", "gross")
            .agg(F.sum("n").cast("long").alias("band_hits"), F.expr("bit_xor(x)").alias("band_ord")))


def resolve_invoices(books: Books, payments: DataFrame) -> DataFrame:
    """Adds `invoice_id` and `resolved_by` to payments (id, invoice_ref, gross, captured_at, ...).

    One invoice with the reference: linked. Several: no link and no second try.
    None: the invoice that alone fits the fee band and the date window. The first
    step is written out, so the second touches only the payments it left open.
    """
    references = invoice_references(books)
    asked = payments.withColumn("cited_ref", spread_nulls(
        F.when(F.col("invoice_ref") != "", F.col("invoice_ref")), *payments.columns))
    cited = asked.join(references, F.col("cited_ref") == references.ref, "left")
    cited = materialize(cited.select(*payments.columns, "ref_hits", "ref_invoice_id"), "cited")
    how = F.when(F.col("ref_hits") == 1, "ref").otherwise("ref_ambiguous")
    by_reference = cited.filter("ref_hits is not null").select(
        *payments.columns, F.when(F.col("ref_hits") == 1, F.col("ref_invoice_id")).alias("invoice_id"),
        how.alias("resolved_by"))

    invoices = books.indexed("invoice")
    unresolved = cited.filter("ref_hits is null").withColumn("captured_on", F.to_date("captured_at"))
    hits = band_candidates(unresolved, invoices.select("issued_at", "amount", "ord"))
    # Only probes with a single fit look up the invoice behind the fingerprint.
    named = invoices.select(F.col("id").alias("invoice_id"), F.col("ord").alias("invoice_ord"))
    fits = hits.join(named, (F.col("band_hits") == 1) & (F.col("band_ord") == F.col("invoice_ord")), "left")
    fits = fits.select("captured_on", "gross", "band_hits", "invoice_id")
    how = F.when(F.col("band_hits") == 1, "band_unique").when(F.col("band_hits") > 1, "band_several").otherwise("none")
    by_band = unresolved.join(fits, ["captured_on", "gross"], "left").select(
        *payments.columns, "invoice_id", how.alias("resolved_by"))
    return by_reference.unionByName(materialize(by_band, "by_band"))
