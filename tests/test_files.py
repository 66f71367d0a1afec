"""Messy files written here, read back through the whole path."""

import csv
import datetime as dt
import io
import random

import pytest
from pyspark.sql import functions as F

from tieout import session
from tieout.functions.text import header_signature
from tieout.sources import mapping, records, splits, tables

BANK = "Date,Narration,Withdrawal,Deposit,Balance\n"
ROWS = "".join(f"0{i}/08/2026,NEFT row {i},,\"1,00{i}.50\",5000\n" for i in range(1, 9))
FILES = {
    "clean.csv": (BANK + ROWS).encode(),
    "letterhead.csv": ("ACME BANK\nAccount Name,ACME TRADERS PVT LTD\n,,\n" + BANK + ROWS).encode(),
    "semicolon.csv": (BANK + ROWS).replace('"1,00', "100").replace('.50"', ".50").replace(",", ";").encode(),
    "legacy.csv": (BANK + ROWS).replace("NEFT", "Café").encode("cp1252"),
    "repairs.csv": (BANK + ROWS + ",,,,\nClosing Balance,,,,9000\n09/08/2026,total refund of fees,,5,6,extra\n").encode(),
    "unnamed.csv": (",Date,Narration,Narration,Deposit\n" + "".join(f",0{i}/08/2026,a,b,{i}\n" for i in range(1, 6))).encode(),
    "multiline.csv": (BANK + ROWS + '09/08/2026,"two\nlines",,7,8\n').encode(),
    "photo.csv": b"\x89PNG\r\n\x1a\nxxxx", "paper.csv": b"%PDF-1.7 x",
}


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    for name, content in FILES.items():
        (folder / name).write_bytes(content)
    files = tables.read_files(spark, str(folder)).withColumn("path", F.substring_index("path", "/", -1))
    # Spark's file listing leaves out files without a byte; feeds that pass rows do not.
    files = files.unionByName(spark.createDataFrame([("empty.csv", bytearray())], "path string, content binary"))
    return tables.parse_files(files)


def by_path(frame):
    return {r.path: r for r in frame.collect()}


def test_shapes(parsed):
    files = by_path(parsed.files)
    assert files["clean.csv"].headers == ["Date", "Narration", "Withdrawal", "Deposit", "Balance"]
    assert files["letterhead.csv"].header_row == 3 and files["letterhead.csv"].preamble_rows == 2
    assert files["semicolon.csv"].delimiter == ";" and files["legacy.csv"].encoding == "cp1252"
    repairs = files["repairs.csv"]
    assert (repairs.blank_rows, repairs.summary_rows, repairs.truncated_rows, repairs.data_rows) == (1, 1, 1, 9)
    assert files["unnamed.csv"].headers == ["Date", "Narration", "Narration_2", "Deposit"]
    assert files["unnamed.csv"].dropped_columns == 1


def test_rejects(parsed):
    rejected = by_path(parsed.rejected)
    assert set(rejected) == {"photo.csv", "paper.csv", "empty.csv"}
    assert "image" in rejected["photo.csv"].reason


def test_values(parsed):
    rows = {(r.path, r.row_number): r["values"] for r in parsed.rows.collect()}
    assert rows[("legacy.csv", 1)][1] == "Café row 1"
    assert rows[("multiline.csv", 9)][1] == "two lines"
    assert rows[("repairs.csv", 9)] == ["09/08/2026", "total refund of fees", "", "5", "6"]


def test_records(parsed):
    described = parsed.files.withColumn("role", F.lit("bank"))
    mapped = mapping.mapped_rows(parsed.rows, described, mapping.map_shapes(described))
    built = records.build_records(mapped, "bank")
    good = {(r.path, r.row_number): r for r in built.good.collect()}
    first = good[("clean.csv", 1)]
    assert (first.id, first.value_date, first.credit, first.balance) == ("BNK000001", dt.date(2026, 8, 1), 100150, 500000)
    assert by_path(built.health)["clean.csv"].synthesised_ids == 8


def fields(spark, role, rows):
    return spark.createDataFrame([("f", role, i + 1, r) for i, r in enumerate(rows)],
                                 "path string, role string, row_number long, fields map<string,string>")


def test_bad_rows_are_reported_with_their_first_reason(spark):
    rows = [{"gross": "100", "captured_at": "2026-08-04"}, {"gross": "x", "captured_at": "y"}, {"gross": "5"},
            {"gross": "5", "captured_at": "1/1/2026", "status": "odd"}, {"gross": " ", "captured_at": ""},
            {"gross": "5", "captured_at": "1/1/2026", "status": ""}]
    built = records.build_records(fields(spark, "gateway", rows), "gateway")
    good = built.good.collect()
    assert [(g.id, g.net, g.status, g.method) for g in good] == [("pay_row000001", 10000, "captured", "unknown")]
    errors = {e.row_number: e.reason for e in built.errors.collect()}
    assert errors[2] == "gross: unrecognised amount shape: 'x'"
    assert errors[3] == "missing required field(s): captured_at"
    assert set(errors) == {2, 3, 4, 6}


def test_signed_amount_column(spark):
    rows = [{"value_date": "1/1/2026", "credit": "-250.75"}]
    row = records.build_records(fields(spark, "bank", rows), "bank").good.first()
    assert (row.credit, row.debit) == (0, 25075)


def test_header_rules():
    found = mapping.map_headers("settlement", ["settlement_id", "payment_ref", "gross_amount", "gateway_fee", "gst_on_fee",
                                               "net_payout", "settlement_date", "utr_number"])
    assert found["net_payout"] == "payout" and "gross_amount" not in found
    twice = mapping.map_headers("ledger", ["Amount", "Invoice Amount", "Status"])
    assert twice == {"Invoice Amount": "amount", "Status": None}


def test_error_cap(spark):
    rows = [{"value_date": "never"}] * 250
    built = records.build_records(fields(spark, "bank", rows), "bank")
    assert records.reported_errors(built.errors).count() == 200
    assert built.health.first().error_count == 250


def _messy(seed, rows):
    """Cells with quoted line ends, doubled quotes, stray quotes, lone carriage returns and ragged rows."""
    rng = random.Random(seed)
    cells = ["1,200.50", "plain", "two\nlines", 'say ""hi""', 'x"y', "", " ", "a\r\nb", "é₹", '"', "12/08/2026", 'q""', "\n\n"]

    def cell():
        one = rng.choice(cells)
        quoted = "\n" in one or "," in one or "\r" in one or rng.random() < 0.3
        return f'"{one.replace(chr(34) * 2, chr(34)).replace(chr(34), chr(34) * 2)}"' + rng.choice(["", "", "tail"]) if quoted else one

    lines = [",".join(cell() for _ in range(rng.choice([5, 5, 5, 3, 7]))) for _ in range(rows)]
    end = rng.choice(["\n", "\r\n"])
    return BANK + "".join(line + (end if rng.random() < 0.97 else "\r" if rng.random() < 0.5 else end * 2) for line in lines)


@pytest.mark.parametrize("size", [350])
def test_files_in_byte_ranges_equal_whole_files(spark, tmp_path, size):
    for name, content in FILES.items():
        (tmp_path / name).write_bytes(content)
    for seed in range(4):
        (tmp_path / f"messy{seed}.csv").write_bytes(_messy(seed, 40).encode("utf-8-sig" if seed % 2 else "utf-8"))
    (tmp_path / "open.csv").write_text(BANK + ROWS + '1,"never closed\nx,y\n')
    whole = tables.parse_files(tables.read_files(spark, str(tmp_path)).withColumn("path", F.substring_index("path", "/", -1)))
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        lines = splits.read_lines(spark, str(tmp_path))
        if size < 1000:
            assert lines.filter("path like '%messy0%'").select("block").distinct().count() > 5
        parsed = tables.parse_paths(spark, str(tmp_path))
        last = F.substring_index("path", "/", -1)
        for name in ("rows", "files", "rejected"):
            got, want = (sorted(map(repr, f.collect())) for f in (getattr(parsed, name).withColumn("path", last), getattr(whole, name)))
            assert got == want, name
    finally:
        for key, value in held.items():
            spark.conf.set(key, value)


def test_ends_inside_quotes_as_the_csv_module_sees_it():
    rng, opener = random.Random(3), splits._openers((",",))[0]
    for _ in range(20_000):
        line = "".join(rng.choices('",a\r', k=rng.randint(0, 9)))
        mark = "\x00"
        for inside in (False, True):
            text = ('"' if inside else "") + line + "\n" + mark
            rows = list(csv.reader(io.StringIO(text, newline="")))
            assert splits.ends_inside(line.encode(), opener, inside) == (rows[-1] != [mark])


def _planned(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_a_cell_is_parsed_in_one_place_of_the_plan(spark):
    rows = spark.createDataFrame([("a", "ledger", 1, {"amount": "1.00", "issued_at": "2024-01-02"})],
                                 "path string, role string, row_number long, fields map<string, string>")
    assert _planned(records.build_records(rows, "ledger").good).count("empty date") == 1


def test_rows_of_files_are_judged_once(spark):
    content = b"Invoice No,Amount\nA1,10.00\n,\nTotal,10.00\n"
    parsed = tables.parse_files(spark.createDataFrame([("a", bytearray(content))], "path string, content binary"))
    assert "RLIKE" not in _planned(parsed.rows).upper()
    assert [(r.row_number, r["values"]) for r in parsed.rows.collect()] == [(1, ["A1", "10.00"])]
    assert [(r.blank_rows, r.summary_rows, r.data_rows) for r in parsed.files.collect()] == [(1, 1, 1)]


def test_larger_tables_are_spread_to_more_tasks(spark, monkeypatch, tmp_path):
    spark.range(1000).write.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(session, "SPREAD_BYTES", 40)
    rows = session.spread(spark.read.parquet(f"{tmp_path}/t"), "id")
    assert rows.rdd.getNumPartitions() > 4 * spark.sparkContext.defaultParallelism and rows.count() == 1000


def test_shapes_are_mapped_once_when_there_are_proposals(spark):
    files = spark.createDataFrame([("a", "ledger", ["Invoice No", "Extra"])], "path string, role string, headers array<string>")
    wanted = files.select("role", header_signature(F.col("headers")).alias("signature"), F.lit("Extra").alias("header"),
                          F.lit("number").alias("field"), F.lit(1).alias("ord"))
    mapped = mapping.map_shapes(files, wanted)
    assert "_mapped" not in _planned(mapped)
    assert [r.fields for r in mapped.collect()] == [["id", "number"]]


def test_rows_of_ranges_stay_where_they_lie_and_keep_their_numbers(spark, tmp_path, monkeypatch):
    body = ["Invoice No,Amount Due,Invoice Date"] + [f"INV{i},{i}.00,2024-01-02" for i in range(60)]
    (tmp_path / "a.csv").write_text("\n".join(body) + "\n")
    monkeypatch.setattr(tables, "STRETCH_ROWS", 4)
    monkeypatch.setattr(tables.splits, "grid", kept := Kept(tables.splits.grid))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parsed = tables.parse_paths(spark, str(tmp_path / "a.csv"))
        plan = kept.result._jdf.queryExecution().executedPlan().toString()
        rows = sorted((r["row_number"], r["values"][0]) for r in parsed.rows.collect())
        parts = parsed.rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert "REPARTITION_BY_NUM" in parts
    assert rows == [(i + 1, f"INV{i}") for i in range(60)]


class Kept:
    def __init__(self, call):
        self.call = call

    def __call__(self, *given):
        self.result = self.call(*given)
        return self.result
