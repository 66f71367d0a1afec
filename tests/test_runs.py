"""Triage, faults, streams, audits and SQL twins."""

import datetime as dt
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.test_matching import DAY, make
from tieout import model
from tieout.operators import audit, faults, ordering, triage
from tieout.plans import books as fixture
from tieout.plans.reconcile import reconcile
from tieout.streaming import incremental, stages, trace, usage

SF = "/root/testdata/sf0.001"


def small(spark):
    at = dt.datetime.combine(DAY, dt.time(9))
    inv = [(f"I{i}", "", "c", 1000 * (i + 1), DAY, f"I{i}", i) for i in range(4)]
    pay = [(f"P{i}", None, f"I{i}", 1000 * (i + 1), 0, 0, 0, "captured", at, "upi", None, i) for i in range(4)]
    stl = [(f"S{i}", None, 1000 * (i + 1) + (5 if i == 3 else 0), 0, 0, 0, DAY, [f"P{i}"], i) for i in range(4)]
    bank = [(f"B{i}", DAY, f"PAYOUT {i} ACME", 1000 * (i + 1) + (5 if i == 3 else 0), 0, 0, i) for i in range(4)]
    bank.append(("B9", DAY, "OTHER LINE", 1000, 0, 0, 9))
    return reconcile(make(spark, inv, pay, stl, bank))


def test_proposals_are_grounded_then_verified(spark):
    run = small(spark)
    rows = [("S0", 1, "B1", .9, []), ("S0", 2, "B0", .9, ["not there"]), ("S0", 3, "B0", .9, ["OTHER"]),
            ("S0", 4, "B9", .9, ["OTHER"]), ("S1", 1, "B1", .8, ["PAYOUT 1"]), ("S3", 1, "B3", .8, ["ACME"])]
    result = triage.resolve_proposals(run, spark.createDataFrame(rows, model.PROPOSAL))
    checks = {(v.settlement_id, v.proposal_ord): v.failed_check for v in result.verdicts.collect()}
    assert checks == {
        ("S0", 1): "proposed bank_line_id was not an offered candidate",
        ("S0", 2): "ungrounded evidence span: 'not there'",
        ("S0", 3): None,
        ("S0", 4): "invoice I0 already claimed by another group",
        ("S1", 1): None,
        ("S3", 1): "batch algebra does not tie out: residual 5 paise"}
    assert {g.id for g in result.groups.filter("status = 'assisted'").collect()} == {"S0", "S1"}
    left = {(e.kind, e.record_id) for e in result.exceptions.filter("stage < 8").collect()}
    assert ("invoice", "I0") not in left and ("bank_line", "B9") in left and ("settlement", "S3") in left


def test_fault_specs_are_read_as_a_table(spark):
    texts = ["", "  ", "nope", ":5", "shift_date:x", "shift_date:1.5", "alter_amount:0", "split_payment:3", None]
    for text in texts:
        with pytest.raises(ValueError):
            faults.planned(spark, ["shift_date", text])
    good = ["shift_date:60", "shift_date:0", "alter_amount:-250000", "split_payment", " Delete_Bank_Line ", "shift_date:"]
    assert faults.planned(spark, good) == [
        faults.Fault("shift_date", days=60), faults.Fault("shift_date", days=0), faults.Fault("alter_amount", amount=-250000),
        faults.Fault("split_payment"), faults.Fault("delete_bank_line"), faults.Fault("shift_date")]
    for fault in faults.planned(spark, good):
        assert faults.planned(spark, [faults.written(fault)]) == [fault]


def test_running_sum_over_hot_keys(spark):
    rows = [(1 if i % 3 else 2, i, i * 7 % 11) for i in range(500)]
    frame = spark.createDataFrame(rows, "d int, id int, v long").repartition(7)
    got = {r.id: r.total for r in ordering.running_sum(frame, ["d", "id"], F.col("v"), "total", 5).collect()}
    total, expected = 0, {}
    for d, i, v in sorted(rows):
        total += v
        expected[i] = total
    assert got == expected


def test_silent_runs_fail(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 9)
    rows = [("a", "matching", at, 1), ("a", "matching", at + dt.timedelta(minutes=1), 2),
            ("b", "complete", at + dt.timedelta(days=2), 3), ("b", "matching", at + dt.timedelta(days=2, minutes=1), 4)]
    schema = "run_id string, state string, at timestamp, event_id long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    moves = trace.drain(trace.transitions(stream, silence_ms=1_800_000), "moves").collect()
    assert {(m.run_id, m.state, m.timed_out) for m in moves} == {
        ("a", "matching", False), ("a", "failed", True), ("b", "complete", False)}


def test_grounding_tolerances(spark):
    cases = [(1, "rate 73.3% of 12,345", '{"r": 0.733, "n": 12345}', True), (2, "about 100", '{"n": 98.9}', False),
             (3, "about 100", '{"n": 99.5}', True), (4, "0.03", '{"n": -0.01}', True), (5, "none here", "{}", True),
             (6, "50", '{"n": 5000}', True), (7, "7", "{}", False)]
    frame = spark.createDataFrame(cases, "answer_id int, text string, payload string, ok boolean")
    found = {r.answer_id: r.grounded for r in audit.answer_grounding(frame, frame).collect()}
    assert found == {c[0]: c[3] for c in cases}


def test_long_answers_are_compared_by_buckets_and_short_ones_in_rows(spark, monkeypatch):
    """Both ways give the same; only answers with much text go by buckets, and rows that share an id meet."""
    rows = [(k % 40 or None, f"{k * 37 % 101}.{k % 7} of {k * 11 % 1000} and {k % 40}", f'{{"a": [{k * 41 % 97}, {k % 13}.5], "b": {k}}}')
            for k in range(200)] + [(99, None, '{"n": 1}'), (98, "5 and 5 and 5.0", None)]
    rows += [(77, " ".join(str(n) for n in range(3000)), "[%s]" % ", ".join(str(n * 1.5) for n in range(0, 3000, 3)))]
    frame = spark.createDataFrame(rows, "answer_id int, text string, payload string")
    sent, by_buckets = [], audit._compared_by_buckets
    monkeypatch.setattr(audit, "_compared_by_buckets", lambda part: sent.append(part) or by_buckets(part))

    def found():
        return sorted(audit.answer_grounding(frame, frame).collect(), key=str)
    mixed = found()
    assert {r.answer_id for r in sent[0].select("answer_id").distinct().collect()} == {77}
    monkeypatch.setattr(audit, "PAIRS_IN_ROW", 0)
    assert found() == mixed and len(mixed) == len(rows)
    monkeypatch.setattr(audit, "PAIRS_IN_ROW", 10 ** 12)
    assert found() == mixed
    assert {(r.numbers, r.unexplained) for r in mixed if r.answer_id == 98} == {(1, 1)}
    assert {(r.numbers, r.grounded) for r in mixed if r.answer_id in (None, 99)} == {(0, True)}


def plain(value):
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


TWINS = ["settlement_links", "batch_totals", "fee_band_candidates", "matched_groups", "open_exceptions", "exception_summary",
         "class_recall", "accounting_check", "output_hash", "cash_forecast", "triage_verdicts", "triaged_exceptions",
         "parsed_amounts", "parsed_dates", "gateway_references", "ledger_files", "header_mapping", "run_datasets",
         "streamed_run_states", "streamed_usage", "fault_split_payment", "answer_grounding"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", TWINS)
def test_query_equals_its_sql(spark, name):
    base = duckdb.connect()
    for file in os.listdir(SF):
        base.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    result = base.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    rows = entry.queries()[name](spark, SF).select(*columns).collect()
    from decimal import Decimal

    def norm(row):
        return tuple(plain(float(v) if isinstance(v, Decimal) else v) for v in row)
    assert sorted(map(norm, rows), key=repr) == sorted(map(norm, result.fetchall()), key=repr)


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streamed_counts_reach_every_window(spark, tmp_path):
    """Several input files, out of order: the counts equal those over the table."""
    at = dt.datetime(2024, 1, 1)
    rows = [("m", at + dt.timedelta(hours=h * 7 % 240)) for h in range(300)]
    frame = spark.createDataFrame(rows, "model string, at timestamp")
    for k in range(4):
        frame.filter((F.hour("at") + F.dayofmonth("at")) % 4 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = trace.drain_counts(usage.calls_per_window(stream, ["model"], "1 day", "30 days"), "counts", ["model", "window_start"])
    want = usage.calls_per_window(frame, ["model"], "1 day")
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want.collect()))


def test_citations_carry_the_last_kind_and_the_total(spark):
    answers = spark.createDataFrame([(1, "see " + " ".join(f"ID{i:03d}" for i in range(20)))], "answer_id int, text string")
    known = spark.createDataFrame([(1, "payment", f"ID{i:03d}", 0) for i in range(20)] + [(1, "invoice", "ID003", 1)],
                                  "answer_id int, kind string, id string, seen int")
    found = audit.citations(answers, known).orderBy("position").collect()
    assert [r.id for r in found] == [f"ID{i:03d}" for i in range(12)] and {r.total for r in found} == {20}
    assert found[3].kind == "invoice"


def test_a_new_object_goes_on_where_the_last_one_stopped(spark, tmp_path):
    """Batch 0 owns I0; a later settlement whose payment cites it is rejected, an open one closes with its late line."""
    at = dt.datetime.combine(DAY, dt.time(9))
    inv = [(f"I{i}", "", "c", 1000 * (i + 1), DAY, f"I{i}", i) for i in range(3)]
    pay = [(f"P{i}", None, f"I{i}", 1000 * (i + 1), 0, 0, 0, "captured", at, "upi", None, i) for i in range(3)]
    stl = [(f"S{i}", f"UTR{i}00000000{i}", 1000 * (i + 1), 0, 0, 0, DAY, [f"P{i}"], i) for i in range(3)]
    bank = [(f"B{i}", DAY, f"UTR {i}00000000{i} X", 1000 * (i + 1), 0, 0, i) for i in range(4)]
    first = make(spark, inv, pay, stl, bank[:2])
    incremental.OpenBooks(spark, str(tmp_path)).apply(first, 0)
    late_pay = [("P8", None, "I0", 1000, 0, 0, 0, "captured", at, "upi", None, 8)]
    late_stl = [("S8", "UTR800000008", 1000, 0, 0, 0, DAY, ["P8"], 8)]
    late_bank = [bank[2], ("B8", DAY, "UTR 800000008 X", 1000, 0, 0, 8)]
    second = make(spark, inv[:0], late_pay, late_stl, late_bank)
    again = incremental.OpenBooks(spark, str(tmp_path))
    assert again.committed() == [0]
    for _ in range(2):  # a replayed batch changes nothing
        again.apply(second, 1)
        assert {(g.id, g.batch) for g in again.groups().collect()} == {("S0", 0), ("S1", 0), ("S2", 1)}
    filed = {(e.kind, e.record_id): e.code for e in again.exceptions().collect()}
    assert filed["settlement", "S8"] == "AMT_MISMATCH_UNEXPLAINED" and filed["payment", "P8"] == "DUPLICATE_CANDIDATE"
    assert ("invoice", "I0") not in filed and ("bank_line", "B0") not in filed


def test_the_first_batch_asks_no_lookup(spark, tmp_path, monkeypatch):
    """Nothing has arrived before it, so it is reconciled as it came."""
    at = dt.datetime.combine(DAY, dt.time(9))
    inv = [(f"I{i}", "", "c", 1000 * (i + 1), DAY, f"I{i}", i) for i in range(2)]
    pay = [(f"P{i}", None, f"I{i}", 1000 * (i + 1), 0, 0, 0, "captured", at, "upi", None, i) for i in range(2)]
    pay.append(("P9", None, "I0", 1000, 0, 0, 0, "captured", at, "upi", None, 9))
    stl = [(f"S{i}", f"UTR{i}00000000{i}", 1000 * (i + 1), 0, 0, 0, DAY, [f"P{i}"], i) for i in range(2)]
    bank = [(f"B{i}", DAY, f"UTR {i}00000000{i} X", 1000 * (i + 1), 0, 0, i) for i in (0, 3)]
    asked = []
    touching = incremental.OpenBooks._touching
    monkeypatch.setattr(incremental.OpenBooks, "_touching", lambda self, name, *rest: asked.append(name) or touching(self, name, *rest))
    books, held = make(spark, inv, pay, stl, bank), incremental.OpenBooks(spark, str(tmp_path))
    held.apply(books, 0)
    assert not asked
    whole = reconcile(books)
    assert [g.id for g in held.groups().collect()] == [g.id for g in whole.groups.collect()] == ["S0"]
    assert {(e.id, e.code) for e in held.exceptions().collect()} == {(e.id, e.code) for e in whole.exceptions.collect()}


def _naive(books_of, batches):
    """Every batch reconciles all that has arrived; (groups with their batch, exceptions)."""
    arrived, held, groups, run = None, None, {}, None
    for number, batch in enumerate(batches):
        arrived = batch if arrived is None else arrived.replaced(**{
            kind: getattr(arrived, kind).union(getattr(batch, kind)) for kind in incremental.KINDS})
        run = reconcile(arrived, held)
        groups |= {r.id: number for r in run.groups.collect()}
        members = [(r.kind, r.id) for r in run.members.collect()]
        fresh = books_of.createDataFrame(members, "kind string, id string")
        held = fresh if held is None else held.union(fresh)
    return groups, {(r.id, r.code) for r in run.exceptions.collect()}


def test_batches_equal_looking_at_everything_again(spark, tmp_path):
    """Records arrive in any order: lines, payments, invoices before or after their settlement; a small batch reads little."""
    source = fixture.books(spark, "/root/testdata/sf0.001")
    kinds = {"invoices": "id", "payments": "id", "settlements": "id", "membership": "settlement_id", "bank_lines": "id"}

    def part(low, high):
        spots = {kind: F.pmod(F.hash(F.lit(kind), F.col(key)), F.lit(100)) for kind, key in kinds.items()}
        return source.replaced(**{kind: spark.createDataFrame(
            getattr(source, kind).filter((spot >= low) & (spot < high)).collect(), getattr(source, kind).schema)
            for kind, spot in spots.items()})

    batches = [part(0, 60), part(60, 97), part(97, 100)]
    want_groups, want_exceptions = _naive(spark, batches)
    held = incremental.OpenBooks(spark, str(tmp_path), buckets=7)
    deltas = [held.apply(batch, number) for number, batch in enumerate(batches)]
    assert {r.id: r.batch for r in held.groups().collect()} == want_groups and {1, 2} <= set(want_groups.values())
    assert {(r.id, r.code) for r in held.exceptions().collect()} == want_exceptions
    looked_at = [d.run.books.payments.count() for d in deltas]
    assert looked_at[2] < 0.6 * source.payments.count()  # 3 % of the payments reach a third of the settlements of twelve


def test_windows_are_held_against_the_limits_of_their_time(spark):
    at = dt.datetime(2024, 5, 1, 10, 0)
    rows = [(7, "m", "k1", 60, at + dt.timedelta(seconds=s)) for s in (0, 10, 50)]
    rows += [(7, "m", "k2", 10, at + dt.timedelta(days=1, seconds=s)) for s in (0, 61)] + [(8, "other", "k1", 5, at)]
    calls = spark.createDataFrame(rows, "user_id bigint, model string, key string, tokens bigint, at timestamp")
    limits = spark.createDataFrame([("m", 2, 10, 100, dt.datetime(2024, 1, 1)), ("m", 1, 1, 5, dt.datetime(2024, 5, 2))],
                                   "model string, rpm int, rpd int, tpm int, valid_from timestamp")
    keys = spark.createDataFrame([("k1", dt.datetime(2024, 1, 1)), ("k2", dt.datetime(2024, 5, 2))], "key string, active_from timestamp")
    got = {(r.scope, r.model, r.key, r.user_id, r.window_start.day, r.window_start.minute): (r.used, r.ceiling, r.over)
           for r in usage.against_limits(usage.usage_by_minute(calls), limits, keys).collect()}
    assert got == {
        ("rpm", "m", "k1", None, 1, 0): (3, 2, 1), ("tpm", "m", "k1", None, 1, 0): (180, 100, 80), ("rpd", "m", "k1", None, 1, 0): (3, 10, 0),
        ("rpm", "m", "k2", None, 2, 0): (1, 1, 0), ("rpm", "m", "k2", None, 2, 1): (1, 1, 0), ("tpm", "m", "k2", None, 2, 0): (10, 5, 5),
        ("tpm", "m", "k2", None, 2, 1): (10, 5, 5), ("rpd", "m", "k2", None, 2, 0): (2, 1, 1),
        ("rpm", "other", "k1", None, 1, 0): (1, None, None), ("tpm", "other", "k1", None, 1, 0): (5, None, None),
        ("rpd", "other", "k1", None, 1, 0): (1, None, None),
        ("user_day", None, None, 7, 1, 0): (3, 25, 0), ("user_day", None, None, 8, 1, 0): (1, 25, 0), ("user_day", None, None, 7, 2, 0): (2, 50, 0)}
    fixed = usage.against_limits(usage.usage_by_minute(calls), limits, keys, user_quota=2)
    assert {(r.user_id, r.used, r.over) for r in fixed.where("scope = 'user_day'").collect()} == {(7, 3, 1), (8, 1, 0), (7, 2, 0)}
    empty = usage.against_limits(usage.usage_by_minute(calls.limit(0)), limits, keys)
    assert empty.count() == 0


def test_live_stage_times_follow_late_rows_and_forget(spark, tmp_path):
    """Each file is a micro-batch: a late row moves a beginning back, a silent run is forgotten and starts anew."""
    at = dt.datetime(2024, 1, 1)
    files = [[("a", "matching", 10), ("a", "scoring", 40), ("b", "normalising", 5)], [("a", "normalising", 4), ("a", "matching", 7)],
             [("c", "matching", 5_000)], [("c", "scoring", 5_010)], [("b", "matching", 5_020), ("c", "failed", 5_030)]]
    for k, rows in enumerate(files):
        frame = spark.createDataFrame([(r, s, at + dt.timedelta(seconds=x), k) for r, s, x in rows], "run_id string, state string, at timestamp, event_id bigint")
        frame.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    live = stages.live_stage_durations(stream, 60_000, "100 seconds")
    got = {(r.run_id, r.state): r.millis for r in trace.drain_counts(live, "live", ["run_id", "state"]).collect()}
    assert got["a", "queued"] == 0 and got["a", "normalising"] == 3000 and got["a", "matching"] == 33_000 and got["a", "scoring"] is None
    assert got["c", "matching"] == 10_000 and got["c", "scoring"] == 20_000 and ("c", "failed") not in got
    assert got["b", "normalising"] is None and got["b", "matching"] is None  # forgotten in between: its later row has no earlier one


class _Store:
    """A state store in memory that counts the calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_a_run_asks_the_state_store_at_most_four_times_a_micro_batch():
    store, clock = _Store(), stages.StageClock(60_000)
    clock.init(store)

    class Times:
        def getCurrentWatermarkInMs(self):
            return 0

    def arrive(*rows):
        store.calls = 0
        batch = pd.DataFrame(rows, columns=["state", "micros"])
        out = list(clock.handleInputRows(("r",), iter([batch]), Times()))
        assert store.calls <= 4
        return [row for frame in out for row in frame.itertuples(index=False, name=None)]

    assert dict((s, m) for _, s, m in arrive(("normalising", 5_000_000), ("matching", 9_000_000), (None, 1)))["normalising"] == 4000
    assert store.timers == {69_000}
    assert arrive(("matching", 9_500_000)) == []
    assert dict((s, m) for _, s, m in arrive(("matching", 7_000_000)))["normalising"] == 2000
    assert store.timers == {69_500}


def test_stored_books_are_the_books_and_read_the_orders_twice(spark, monkeypatch):
    read, orders = [], fixture.orders
    monkeypatch.setattr(fixture, "orders", lambda *given: read.append(1) or orders(*given))
    stored = fixture.stored_books(spark, SF)
    assert len(read) == 2
    plain = fixture.books(spark, SF)
    for name in ("invoices", "payments", "settlements", "membership", "bank_lines"):
        ours, theirs = getattr(stored, name), getattr(plain, name)
        assert ours.schema.simpleString() == theirs.schema.simpleString()
        assert ours.exceptAll(theirs).isEmpty() and theirs.exceptAll(ours).isEmpty()
        assert "orders.parquet" not in "".join(ours.inputFiles())
