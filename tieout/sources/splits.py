"""Large delimited files cut into byte ranges, each read by a task of its own.

Spark cuts a text file at line ends, but a line end inside quotes is not a row end, and whether a range begins
inside quotes depends on all ranges before it. So the first pass works out for every range what it does to
that state: where it leaves off if it begins outside quotes, and where if it begins inside. These are functions of
one bit; running them one after the other over a file's ranges (a row each) tells every range how it begins. The second
pass cuts rows inside ranges. A row that ends in a later range is left in pieces, which are put together by
a running count of the rows that were left open. Row numbers are those inside the range plus the sums of the ranges before.

The rows equal those of `tables.tokenize`, which reads a file in one piece: quotes only count where a cell begins,
doubled quotes stand for one, and a lone carriage return ends a line too.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.window import Window

from tieout.session import materialize

# Rows cut at once, and lines at the head of a file that are kept to choose its separator.
ROWS_AT_ONCE, HEAD_LINES = 10_000, 100
# Ranges whose state may be broadcast to the second pass; more are joined and sorted.
BROADCAST_RANGES = 1_000_000
# A row left open for longer is not a row: quotes are out of balance.
OPEN_BYTES = 16 << 20
_CLOSE = re.compile(rb'[^"]*(?:""[^"]*)*"(?!")')
_UNDEFINED = re.compile(rb"[\x81\x8d\x8f\x90\x9d]")  # bytes without a character in Windows-1252

RANGES = pa.schema([
    ("path", pa.string()), ("block", pa.int64()), ("ends_outside", pa.list_(pa.bool_())), ("ends_inside", pa.list_(pa.bool_())),
    ("utf8", pa.bool_()), ("undefined", pa.bool_()), ("head", pa.list_(pa.binary()))])
ROWS = pa.schema([
    ("path", pa.string()), ("block", pa.int64()), ("part", pa.string()), ("local_no", pa.int64()), ("filled", pa.int64()),
    ("cells", pa.list_(pa.string())), ("problem", pa.string()), ("open", pa.binary())])


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, block, at, line): a block is a byte range of a file, and its lines come in order of `at`."""
    return spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").cast("long").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("line"))


def _openers(delimiters: tuple[str, ...]) -> list[re.Pattern]:
    return [re.compile(b"[" + re.escape(d.encode()) + b"\r]\"") for d in delimiters]


def ends_inside(line: bytes, opener: re.Pattern, inside: bool) -> bool:
    """Whether the end of the line lies inside quotes, given whether its start does."""
    at = 0
    if not inside:
        if line[:1] == b'"':
            at = 1
        elif found := opener.search(line):
            at = found.end()
        else:
            return False
    while closed := _CLOSE.match(line, at):
        found = opener.search(line, closed.end())
        if not found:
            return False
        at = found.end()
    return True


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
    for batch in batches:
        rest = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        names = batch.schema.names
        line = names.index("line")
        others = [i for i in range(len(names)) if names[i] not in ("line", "at")]
        for row in zip(*rest, strict=True):
            yield tuple(row[i] for i in others), row[line] or b""


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def describe_ranges(lines: DataFrame, delimiters: tuple[str, ...]) -> DataFrame:
    """One row per byte range: its effect on the quote state under each separator, encoding marks, and the file's first lines."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        openers, now = _openers(delimiters), None
        for (path, block), line in _runs(batches):
            if now is None or now[:2] != [path, block]:
                if now:
                    yield _table(RANGES, [tuple(now)])
                now = [path, block, [False] * len(openers), [True] * len(openers), True, False, []]
            if b'"' in line:
                for state in (now[2], now[3]):
                    state[:] = [ends_inside(line, opener, inside) for opener, inside in zip(openers, state, strict=True)]
            if not line.isascii():
                try:
                    line.decode()
                except UnicodeDecodeError:
                    now[4] = False
                now[5] = now[5] or bool(_UNDEFINED.search(line))
            if block == 0 and len(now[6]) < HEAD_LINES:
                now[6].append(line)
        if now:
            yield _table(RANGES, [tuple(now)])

    return lines.select("path", "block", "line").mapInArrow(scan, from_arrow_schema(RANGES))


def begin_states(ranges: DataFrame) -> DataFrame:
    """Adds `inside`: whether a range begins inside quotes; columns path, block, f0, f1 (its ends if it begins outside, inside)."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # A range that ends alike in both cases fixes the state; from there on only the ranges that turn it over count.
    fixed, turns = F.col("f0") == F.col("f1"), (F.col("f0") & ~F.col("f1")).cast("int")
    marked = ranges.withColumn("turned", F.coalesce(F.sum(turns).over(before), F.lit(0)))
    last = F.last(F.when(fixed, F.struct(F.col("f0").cast("int").alias("state"), F.col("turned"))), ignorenulls=True).over(before)
    return (marked.withColumn("fixed", last)
            .withColumn("inside", (F.coalesce("fixed.state", F.lit(0)) + F.col("turned") - F.coalesce("fixed.turned", F.lit(0))) % 2 == 1)
            .drop("turned", "fixed"))


def _text(data: bytes, encoding: str, first: bool) -> str:
    if encoding == "cp1252":
        return data.decode("cp1252")
    text = data.decode("utf-8" if encoding == "utf-8" else "latin-1")
    return text.removeprefix("﻿") if first and encoding == "utf-8" else text


def _cut(text: str, delimiter: str) -> tuple[list[list[str]], str | None]:
    rows: list[list[str]] = []
    try:
        rows.extend(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter))
    except csv.Error as problem:
        return rows, str(problem)
    return rows, None


def _cut_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their range's (inside, delimiter, encoding) to numbered rows, and the pieces of rows that cross ranges."""
    now, state, head, open_, ready, size, numbers = None, False, None, [], [], 0, [0, 0]

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal ready, size
        path, block, _, delimiter, encoding = now
        rows, problem = _cut(_text(b"".join(ready), encoding, block == 0 and numbers[0] == 0), delimiter)
        out = []
        for cells in rows:
            numbers[1] += any(c.strip() for c in cells)
            out.append((path, block, "row", numbers[0], numbers[1], cells, None, None))
            numbers[0] += 1
        if problem:
            out.append((path, block, "row", numbers[0], numbers[1], [], problem, None))
        ready, size = [], 0
        yield _table(ROWS, out)

    def close() -> Iterator[pa.RecordBatch]:
        yield from flush()
        for part, piece in (("head", head), ("tail", b"".join(open_) if open_ else None)):
            if piece is not None:
                long = len(piece) > OPEN_BYTES
                yield _table(ROWS, [(now[0], now[1], part, None, None, None, "a quoted cell does not end" if long else None,
                                     piece[:OPEN_BYTES])])

    for key, line in _runs(batches):
        if key != now:
            if now:
                yield from close()
            now, state, open_, ready, size, numbers = key, key[2], [], [], 0, [0, 0]
            head = b"" if state else None
            opener, heading = _openers((key[3],))[0], state
        was, whole = state, line + b"\n"
        if b'"' in line:
            state = ends_inside(line, opener, was)
        if heading:  # still the row that began in an earlier range
            if len(head) <= OPEN_BYTES:
                head += whole
            heading = state
        elif state:
            open_.append(whole)
        else:
            ready += [*open_, whole]
            open_ = []
            size += 1
            if size >= ROWS_AT_ONCE:
                yield from flush()
    if now:
        yield from close()


def _joined_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, block, delimiter, encoding, problem, text) of the rows that cross ranges to rows after those of the range they began in."""
    for batch in batches:
        out = []
        for path, block, delimiter, encoding, problem, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            rows, broken = _cut(_text(data, encoding, False), delimiter)
            filled = 0
            for k, cells in enumerate(rows):
                filled += any(c.strip() for c in cells)
                out.append((path, block, "joined", k, filled, cells, None, None))
            if problem or broken:
                out.append((path, block, "joined", len(rows), filled, [], problem or broken, None))
        yield _table(ROWS, out)


def grid(lines: DataFrame, files: DataFrame, ranges: DataFrame) -> DataFrame:
    """(path, row_no, filled_no, cells, problem) of whole files, as `tables.tokenize` gives them.

    `files` are (path, delimiter, rank, encoding) with the separator's place in the list the ranges were described for.
    """
    known = ranges.join(files, "path").select("path", "block", "delimiter", "encoding", F.get("ends_outside", "rank").alias("f0"),
                                              F.get("ends_inside", "rank").alias("f1"))
    states = materialize(begin_states(known).select("path", "block", "inside", "delimiter", "encoding"), "ranges")
    few = states.count() <= BROADCAST_RANGES
    told = lines.join(states.hint("broadcast" if few else "merge"), ["path", "block"])
    if not few:
        told = told.sortWithinPartitions("path", "block", "at")
    cut = materialize(told.select("path", "block", "inside", "delimiter", "encoding", "line").mapInArrow(_cut_ranges, from_arrow_schema(ROWS)), "cut")

    # a tail begins a row, and the heads after it belong to it
    order = Window.partitionBy("path").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, 0)
    pieces = cut.where("part <> 'row'").withColumn("number", F.sum((F.col("part") == "tail").cast("int")).over(order))
    parts = pieces.groupBy("path", "number").agg(
        F.min("block").alias("block"), F.max("problem").alias("problem"),
        F.array_sort(F.collect_list(F.struct("block", "open"))).alias("parts"))
    text = F.aggregate("parts", F.lit(b"").cast("binary"), lambda all_, p: F.concat(all_, p["open"]))
    joined = (parts.join(files.select("path", "delimiter", "encoding"), "path")
              .select("path", "block", "delimiter", "encoding", "problem", text.alias("text")).mapInArrow(_joined_pieces, from_arrow_schema(ROWS)))
    rows = cut.where("part = 'row'").unionByName(joined)
    rows = rows.select("path", "block", (F.col("part") == "joined").alias("crosses"), "local_no", "filled", "cells", "problem")
    rows = materialize(rows, "rows")
    counts = rows.groupBy("path", "block", "crosses").agg(F.count_if(F.col("problem").isNull()).alias("n"), F.max("filled").alias("full"))
    before = Window.partitionBy("path").orderBy("block", "crosses").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("path", "block", "crosses", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
                         F.coalesce(F.sum("full").over(before), F.lit(0)).alias("full_before"))
    # A row or two per range: sent to the rows, which would else be shuffled with a whole range to a task.
    base = materialize(base, "base").hint("broadcast" if few else "merge")
    return rows.join(base, ["path", "block", "crosses"]).select(
        "path", (F.col("local_no") + F.col("n_before")).alias("row_no"), (F.col("filled") + F.col("full_before")).alias("filled_no"),
        "cells", "problem")
