"""Reconcile feeds that arrive in pieces, looking again only at what a piece touches.

Everything that has arrived lies in lookups that are partitioned by a hash of the key they are asked by. A
batch asks them for the keys of its own records and reads the buckets of those keys only; what it finds is
joined to counted keys, which are broadcast as long as they are few, so that the lookups are not shuffled.

A batch touches an open settlement if the settlement, one of its payments or a line with its reference and payout
arrived, or if it once lost its records to others and an invoice arrived that one of its payments may mean. No
other settlement can change: its lookups give what they gave before, and records stay with their owners. The
touched settlements are reconciled over books that hold every record under their keys, and so get the links,
candidates and counts that all books would give them. The first batch touches every settlement it brings and only
its own records can be under their keys, so it is reconciled as it came and asks no lookup.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tieout.functions.money import band_limits
from tieout.functions.narration import canonical_utr
from tieout.model import BANK_LINE, INVOICE, MEMBERSHIP, PAYMENT, SETTLEMENT, Books
from tieout.operators.invoices import capture_windows
from tieout.operators.linking import LINKED, line_references
from tieout.plans.reconcile import Run, reconcile, residue, settlement_exceptions
from tieout.session import materialize, new_folder

KINDS = {"invoices": "invoice", "payments": "payment", "settlements": "settlement", "membership": None, "bank_lines": "bank_line"}
BUCKETS = 16
# Up to so many keys travel to the lookups; beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000
# Tables of one batch written at a time.
WRITERS = 4

# Name: columns, and the one that is asked by.
LOOKUPS = {
    "settlements": (SETTLEMENT, "id"), "settlement_utrs": ("utr string, payout bigint, id string", "utr"),
    "membership": (MEMBERSHIP, "settlement_id"), "payment_settlements": ("payment_id string, settlement_id string", "payment_id"),
    "payments": (PAYMENT, "id"), "payments_by_ref": (PAYMENT, "invoice_ref"),
    "invoices_by_ref": (INVOICE, "ref"), "invoices_by_day": (INVOICE, "issued_at"), "issue_days": ("issued_at date", "issued_at"),
    "lines_by_utr": (f"bank_utr string, {BANK_LINE}", "bank_utr"),
    # what batches decided
    "groups": ("id string, settlement_id string, bank_line_id string, status string, pass_id string, confidence double, "
               "residual bigint, payout bigint, settled_at date, ord bigint, evidence array<struct<field: string, value: string, "
               "source_id: string>>", "id"),
    "members": ("group_id string, kind string, id string, pos bigint", "id"),
    "paid": ("invoice_ref string, gross bigint", "invoice_ref"),
    "lost_refs": ("ref string, settlement_id string", "ref"), "lost_days": ("captured_on date, settlement_id string", "captured_on"),
    "filed": ("id string, code string, severity int, amount_at_risk bigint, kind string, record_id string, attempted array<string>, "
              "explanation string, suggested_action string, failed_check string, stage int, ord bigint", "id"),
}


def _names(schema: str) -> list[str]:
    return StructType.fromDDL(schema).names


@dataclass(frozen=True)
class Delta:
    """What one batch changed: the run over the touched settlements, and the exceptions that were filed or filed anew."""
    run: Run
    filed: DataFrame


class OpenBooks:
    """Groups accepted batch by batch; what they own is kept as claims, never taken out of the books.

    All lookups answer for everything that has arrived, so a payment that cites an owned invoice still finds it; a
    proposal that touches a claim of an earlier batch is rejected, which makes the order of batches the order of
    proposals. A late bank line closes an open settlement but cannot undo a group. Of an id that a batch repeats the last
    record counts; different batches bring different ids.

    The last table of a batch is its row in `commits`. A new object on the same root goes on after
    the committed batches; a batch that failed before its commit, or is replayed, is written over.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.root = root or new_folder(spark, "open-books")

    def committed(self, before: int | None = None) -> list[int]:
        """Numbers of the finished batches, those below `before` if it is given."""
        try:
            rows = self.spark.read.parquet(f"{self.root}/commits").select(F.col("batch").cast("int")).distinct().collect()
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return []
        return sorted(r.batch for r in rows if before is None or r.batch < before)

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int")

    def _put_all(self, tables: dict[str, DataFrame], batch: int) -> None:
        """Write what doesn't depend on each other side by side."""
        with ThreadPoolExecutor(WRITERS) as pool:
            list(pool.map(lambda name: self._put(name, tables[name], batch), tables))

    def _put(self, name: str, rows: DataFrame, batch: int) -> None:
        schema, key = LOOKUPS[name]
        columns = _names(schema)
        (rows.select(*columns).withColumn("bucket", self._bucket(key)).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{name}/batch={batch}"))

    def _all(self, name: str, batches: list[int]) -> DataFrame:
        """All rows of a lookup that the given batches wrote."""
        schema, _ = LOOKUPS[name]
        if not batches:
            return self.spark.createDataFrame([], schema).withColumns({"batch": F.lit(0), "bucket": F.lit(0)})
        stored = self.spark.read.schema(f"{schema}, batch int, bucket int").parquet(f"{self.root}/{name}")
        return stored.where(F.col("batch").isin(batches))

    def _touching(self, name: str, batches: list[int], keys: DataFrame) -> DataFrame:
        """The rows of a lookup under the given keys: a table whose columns are named as the lookup's.

        The lookup's key is among them. Only the keys' buckets are read.
        """
        key = LOOKUPS[name][1]
        if not batches:
            return self._all(name, batches).drop("batch", "bucket")
        keys = keys.where(F.col(key).isNotNull()).distinct()
        found = keys.agg(F.collect_set(self._bucket(key)).alias("buckets"), F.count("*").alias("n")).first()
        rows = self._all(name, batches).where(F.col("bucket").isin(found.buckets or [-1])).drop("batch", "bucket")
        how = "broadcast" if found.n <= BROADCAST_ROWS else "merge"
        return rows.join(keys.hint(how), keys.columns, "left_semi")

    def _touched(self, fresh: Books, lines: DataFrame, known: list[int], before: list[int]) -> DataFrame:
        """The open settlements that a batch can change."""
        paid = self._touching("payment_settlements", known, fresh.payments.select(F.col("id").alias("payment_id")))
        cited = self._touching("settlement_utrs", known, lines.select(F.col("bank_utr").alias("utr"), F.col("credit").alias("payout")))
        meant = self._touching("lost_refs", before, fresh.invoices.select("ref"))
        near = self._touching("lost_days", before, capture_windows(fresh.invoices).select("captured_on"))
        ids = (fresh.settlements.select("id").union(fresh.membership.select("settlement_id")).union(paid.select("settlement_id"))
               .union(cited.select("id")).union(meant.select("settlement_id")).union(near.select("settlement_id")))
        ids = materialize(ids.distinct(), "touched")  # asked twice
        closed = self._touching("members", before, ids).where("kind = 'settlement'")
        return materialize(self._touching("settlements", known, ids).join(closed, "id", "left_anti"), "settlements")

    def _books(self, settlements: DataFrame, known: list[int]) -> Books:
        """Every record under the keys of the given settlements."""
        own = settlements.select("id", F.when(F.col("utr") != "", canonical_utr(F.col("utr"))).alias("bank_utr"), F.col("payout").alias("credit"))
        lines = self._touching("lines_by_utr", known, own.select("bank_utr", "credit")).drop("bank_utr").dropDuplicates(["id"])
        membership = materialize(self._touching("membership", known, own.select(F.col("id").alias("settlement_id"))), "membership")
        payments = materialize(self._touching("payments", known, membership.select(F.col("payment_id").alias("id"))), "payments")
        cited = materialize(self._touching("invoices_by_ref", known, payments.where("invoice_ref <> ''").select(
            F.col("invoice_ref").alias("ref"))), "cited")
        # payments without such an invoice may mean one by amount and date
        open_ = payments.join(cited.select(F.col("ref").alias("invoice_ref")).distinct(), "invoice_ref", "left_anti")
        low, high = band_limits(F.col("gross"))
        probes = open_.groupBy(F.to_date("captured_at").alias("captured_on")).agg(F.min(low).alias("low"), F.max(high).alias("high"))
        days = self._all("issue_days", known).select("issued_at").distinct()
        reach = (capture_windows(days).join(probes, "captured_on").groupBy("issued_at")
                 .agg(F.min("low").alias("low"), F.max("high").alias("high")))
        reach = materialize(reach, "reach")  # at most a row for each calendar day
        near = self._touching("invoices_by_day", known, reach.select("issued_at")).join(F.broadcast(reach), "issued_at")
        near = near.where("amount <= 0 OR amount BETWEEN low AND high").select(*cited.columns)
        invoices = cited.unionByName(near).dropDuplicates(["id"])
        return Books(materialize(invoices, "invoices"), payments, settlements, membership, materialize(lines, "lines"), unique_ids=True)

    def _first_books(self, fresh: Books) -> Books:
        """What `_books` would find for the first batch: all that has arrived is its own, and nothing is held yet."""
        settlements = fresh.settlements.where(F.col("id").isNotNull())
        invoices, lines = fresh.invoices.dropDuplicates(["id"]), fresh.bank_lines.dropDuplicates(["id"])
        return fresh.replaced(invoices=materialize(invoices, "invoices"), settlements=settlements, bank_lines=materialize(lines, "lines"))

    def _refiled(self, fresh: Books, run: Run, known: list[int], before: list[int]) -> DataFrame:
        """Exceptions of the batch's open records, of touched settlements, and of older payments that copy one just paid."""
        if not before:  # no older payment that could be a copy, and none that has an owner
            payments = fresh.payments.dropDuplicates(["id"])
            taken = run.chain.select("payment_id", "invoice_id", "gross", "invoice_ref")
            rest = residue(fresh.replaced(payments=payments, unique_ids=True), taken, run.outcomes)
            return settlement_exceptions(run.outcomes).unionByName(rest)
        paid = run.chain.where("invoice_ref <> ''").select("invoice_ref", "gross").distinct()
        copies = self._touching("payments_by_ref", known, paid)
        payments = materialize(fresh.payments.select(*copies.columns).union(copies).dropDuplicates(["id"]), "payments")
        owned = self._touching("members", before, payments.select("id")).where("kind = 'payment'")
        seen = self._touching("paid", before, payments.where("invoice_ref <> ''").select("invoice_ref", "gross"))
        taken = run.chain.select("payment_id", "invoice_id", "gross", "invoice_ref").union(seen.select(
            F.lit(None).cast("string"), F.lit(None).cast("string"), "gross", "invoice_ref"))
        rest = residue(fresh.replaced(payments=payments.join(owned, "id", "left_anti"), unique_ids=True), taken, run.outcomes)
        return settlement_exceptions(run.outcomes).unionByName(rest)

    def apply(self, fresh: Books, batch_id: int) -> Delta:
        before = self.committed(batch_id)
        known = [*before, batch_id]
        fresh = fresh.replaced(**{kind: materialize(fresh.indexed(one) if one else fresh.membership, kind)
                                  for kind, one in KINDS.items()}, unique_ids=True)
        lines = materialize(line_references(fresh.bank_lines), "lines")
        self._put_all({
                "settlements": fresh.settlements, "membership": fresh.membership, "payment_settlements": fresh.membership,
                "settlement_utrs": fresh.settlements.withColumn("utr", canonical_utr(F.col("utr"))),
                "payments": fresh.payments, "payments_by_ref": fresh.payments, "invoices_by_ref": fresh.invoices,
                "invoices_by_day": fresh.invoices, "issue_days": fresh.invoices.select("issued_at").distinct(),
                "lines_by_utr": lines}, batch_id)
        if before:
            books = self._books(self._touched(fresh, lines, known, before), known)
            ids = books.payments.select("id").union(books.invoices.select("id")).union(books.bank_lines.select("id"))
            held = self._touching("members", before, ids).select("kind", "id")
        else:
            books, held = self._first_books(fresh), None
        run = reconcile(books, held)
        run = replace(run, chain=materialize(run.chain, "chain"), members=materialize(run.members, "members"))
        lost = run.outcomes.where((F.col("link_status") == LINKED) & ~F.col("accepted")).select("settlement_id")
        asked = books.membership.join(lost, "settlement_id").join(books.payments.withColumnRenamed("id", "payment_id").select(
            "payment_id", F.col("invoice_ref").alias("ref"), F.to_date("captured_at").alias("captured_on")), "payment_id")
        self._put_all({
            "groups": run.groups, "members": run.members,
            "paid": run.chain.where("invoice_ref <> ''").select("invoice_ref", "gross").distinct(),
            "lost_refs": asked.select("ref", "settlement_id").distinct(),
            "lost_days": asked.select("captured_on", "settlement_id").distinct(),
            "filed": self._refiled(fresh, run, known, before)}, batch_id)
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.root}/commits/batch={batch_id}")
        return Delta(run, self._all("filed", [batch_id]).drop("batch", "bucket"))

    def groups(self) -> DataFrame:
        """The groups of all finished batches."""
        return self._all("groups", self.committed()).drop("bucket")

    def members(self) -> DataFrame:
        return self._all("members", self.committed()).drop("bucket")

    def exceptions(self) -> DataFrame:
        """What is open after all finished batches: the last word on each record that no group holds."""
        filed, names = self._all("filed", self.committed()), _names(LOOKUPS["filed"][0])
        last = filed.groupBy("id").agg(F.max_by(F.struct(*[c for c in names if c != "id"]), "batch").alias("last"))
        held = self.members().select("kind", F.col("id").alias("record_id"))
        return last.select("id", "last.*").join(held, ["kind", "record_id"], "left_anti").select(*names)

    def follow(self, arrivals: DataFrame, books_of: Callable[[DataFrame], Books], checkpoint: str):
        """Drive `apply` from a stream: each micro-batch is turned into books and reconciled."""
        return (arrivals.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
                .foreachBatch(lambda rows, batch_id: self.apply(books_of(rows), batch_id)).start())
