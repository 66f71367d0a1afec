"""Messy delimited files to clean text tables, many files at a time.

Each step is a DataFrame job over all files: sniffing, decoding and choosing the
separator work on the file column, shaping works on one row per line. Python only
splits text into cells. `parse_files` takes whole files as rows, one task each; `parse_paths`
reads files of any size from their paths in byte ranges (`splits`), many tasks to a file.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tieout.functions.text import (
    collapse, filled_cells, header_names, is_blank, is_blank_row, is_summary_row, let, looks_like_header)
from tieout.session import materialize
from tieout.sources import splits

# Thresholds of reading a table (fixed values).
HEADER_SCAN_LIMIT = 40
BODY_SAMPLE = 12
MIN_BODY_AGREEMENT = 0.6
MIN_DELIMITER_AGREEMENT = 0.9
DELIMITERS = (",", ";", "\t", "|")
# Rows of a file that are numbered together.
STRETCH_ROWS = 100_000

# Windows-1252 where it differs from Latin-1; five bytes have no character in it.
_HIGH = "".join(chr(b) for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore"))
_HIGH_1252 = "".join(bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0))
_UNDEFINED = "[\\x81\\x8d\\x8f\\x90\\x9d]"


@dataclass(frozen=True)
class Parsed:
    """`rows`: path, row_number, values. `files`: path, headers, and one count per repair.
    `rejected`: path, reason."""
    rows: DataFrame
    files: DataFrame
    rejected: DataFrame


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths)).select("path", "content")


def content_kind(content: Column) -> Column:
    """What the first bytes say the file is, whatever its name."""
    head = F.hex(F.substring(content, 1, 8))
    return (F.when(F.length(content) == 0, "empty").when(head.startswith("504B0304"), "xlsx")
            .when(head.startswith("89504E470D0A1A0A") | head.startswith("FFD8FF")
                  | head.startswith("474946383761") | head.startswith("474946383961"), "image")
            .when(head.startswith("255044462D"), "pdf").otherwise("csv"))


def decode(files: DataFrame) -> DataFrame:
    """Adds `text` and `encoding`: UTF-8 if it is that, else Windows-1252, else Latin-1."""
    raw = F.col("content").cast("string")
    latin = F.decode(F.col("content"), "ISO-8859-1")
    encoding = (F.when(F.is_valid_utf8(raw), "utf-8").when(latin.rlike(_UNDEFINED), "latin-1")
                .otherwise("cp1252"))
    return files.withColumn("encoding", encoding).withColumn("text", _decoded(F.col("content")))


def _decoded(content: Column) -> Column:
    """The text of bytes whose `encoding` is known."""
    raw, latin = content.cast("string"), F.decode(content, "ISO-8859-1")
    return (F.when(F.col("encoding") == "utf-8", F.regexp_replace(raw, "^﻿", ""))
            .when(F.col("encoding") == "cp1252", F.translate(latin, _HIGH, _HIGH_1252)).otherwise(latin))


def _mode(values: Column) -> Column:
    """`struct(count, -position, value)` of the most common value, first seen wins ties."""
    return let(values, lambda vs: F.array_max(F.transform(F.array_distinct(vs), lambda v, i: F.struct(
        F.size(F.filter(vs, lambda w: w == v)).alias("count"), (-i).alias("rank"), v.alias("value")))))


def choose_delimiter(text: Column) -> Column:
    """The separator that splits the sampled lines most alike; width only breaks ties."""
    def chosen(sample: Column) -> Column:
        def score(rank: int, delimiter: str) -> Column:
            mark = "\\" + delimiter if delimiter == "|" else delimiter
            quoted = f"(^|{mark})\"(?:[^\"]|\"\")*(?:\"|$)"
            widths = F.transform(sample, lambda line: F.size(F.split(F.regexp_replace(line, quoted, "$1"), mark)))
            return let(_mode(widths), lambda best: F.when(
                (best["value"] >= 2) & (best["count"] / F.size(sample) >= MIN_DELIMITER_AGREEMENT),
                F.struct((best["count"] / F.size(sample)).alias("agreement"), best["value"].alias("width"),
                         F.lit(-rank).alias("rank"), F.lit(delimiter).alias("delimiter"))))

        best = F.array_max(F.array_compact(F.array(*[score(i, d) for i, d in enumerate(DELIMITERS)])))
        return F.coalesce(best["delimiter"], F.lit(","))

    head = F.substring_index(text, "\n", HEADER_SCAN_LIMIT)  # holds at least as many lines; the rest is not split
    lines = F.slice(F.split(head, "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"), 1, HEADER_SCAN_LIMIT)
    return let(F.slice(F.filter(lines, lambda line: ~is_blank(line)), 1, BODY_SAMPLE), chosen)


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cut each file's text into numbered rows of cells, a block of rows at a time."""
    for batch in batches:
        for path, text, delimiter in zip(batch["path"], batch["text"], batch["delimiter"]):
            block: list[tuple] = []
            filled = 0
            reader = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)
            number = -1
            try:
                for number, cells in enumerate(reader):
                    filled += any(c.strip() for c in cells)
                    block.append((path, number, filled, cells, None))
                    if len(block) == 10_000:
                        yield pd.DataFrame(block, columns=["path", "row_no", "filled_no", "cells", "problem"])
                        block = []
            except csv.Error as problem:
                block.append((path, number + 1, filled, [], str(problem)))
            yield pd.DataFrame(block, columns=["path", "row_no", "filled_no", "cells", "problem"])


def tokenize(decoded: DataFrame) -> DataFrame:
    """(path, row_no, filled_no, cells); `filled_no` counts the rows that are not blank."""
    chosen = decoded.select("path", "text", choose_delimiter(F.col("text")).alias("delimiter"))
    return chosen.mapInPandas(
        _cells, "path string, row_no long, filled_no long, cells array<string>, problem string")


def locate_headers(grid: DataFrame) -> DataFrame:
    """(path, header_row, obvious): the first word-shaped row whose followers agree with it."""
    head = grid.filter((F.col("filled_no") <= HEADER_SCAN_LIMIT + BODY_SAMPLE) & ~is_blank_row(F.col("cells")))
    # Some fifty rows per file at most, whatever the size of the file.
    after = Window.partitionBy("path").orderBy("row_no").rowsBetween(1, BODY_SAMPLE)
    shaped = head.select("path", "row_no", F.size(filled_cells(F.col("cells"))).alias("width"),
                         looks_like_header(F.col("cells")).alias("wordy"))
    shaped = shaped.withColumn("below", F.collect_list("width").over(after))
    agrees = (F.size("below") > 0) & let(_mode(F.col("below")), lambda best: (
        best["count"] / F.size("below") >= MIN_BODY_AGREEMENT) & (F.col("width") >= best["value"] - 1))
    wordy = F.col("wordy") & (F.col("row_no") < HEADER_SCAN_LIMIT)
    found = shaped.groupBy("path").agg(
        F.min(F.when(wordy & agrees, F.col("row_no"))).alias("sure"),
        F.min(F.when(wordy, F.col("row_no"))).alias("maybe"))
    files = grid.groupBy("path").agg(F.count("*").alias("grid_rows"), F.max("problem").alias("problem"))
    return files.join(found, "path", "left").select(
        "path", "grid_rows", "problem", F.coalesce("sure", "maybe", F.lit(0)).alias("header_row"),
        F.coalesce("sure", "maybe").isNotNull().alias("obvious"))


def _reason(kind: Column) -> Column:
    """Why a file of this kind is not read."""
    reasons = {"empty": "file is empty", "image": "file content is an image, not a table",
               "pdf": "this is a PDF; use the statement line extraction on its text",
               "xlsx": "this is a workbook; convert it to delimited text first"}
    return F.element_at(F.create_map(*[F.lit(x) for kv in reasons.items() for x in kv]), kind)


def parse_files(files: DataFrame, max_rows: int | None = None) -> Parsed:
    """All files (path, content) to shaped rows, with every repair counted.

    `max_rows` rejects longer files, for uploads that promise to be short; feeds have no limit.
    """
    kinds = files.withColumn("kind", content_kind(F.col("content")))
    wrong = kinds.filter("kind <> 'csv'").select("path", _reason(F.col("kind")).alias("reason"))

    decoded = decode(kinds.filter("kind = 'csv'"))
    # Cut once: locating headers, shaping and counting all read the same cells.
    grid = materialize(tokenize(decoded), "grid")
    head = F.substring_index(F.col("content").cast("string"), "\n", HEADER_SCAN_LIMIT).cast("binary")
    described = decoded.select("path", "encoding", choose_delimiter(_decoded(head)).alias("delimiter"))
    return _shaped(grid, described, wrong, max_rows)


def parse_paths(spark: SparkSession, *paths: str, max_rows: int | None = None) -> Parsed:
    """As `parse_files`, of files of any size: each is read in byte ranges by many tasks."""
    lines = splits.read_lines(spark, *paths)
    ranges = materialize(splits.describe_ranges(lines, DELIMITERS), "ranges")
    marks = ranges.groupBy("path").agg(F.bool_and("utf8").alias("utf8"), F.bool_or("undefined").alias("undefined"))
    head = ranges.filter("block = 0").select("path", F.aggregate(
        "head", F.lit(b"").cast("binary"), lambda all_, line: F.concat(all_, line, F.lit(b"\n"))).alias("content"))
    kinds = head.join(marks, "path").withColumn("kind", content_kind(F.col("content")))
    wrong = kinds.filter("kind <> 'csv'").select("path", _reason(F.col("kind")).alias("reason"))
    encoding = F.when(F.col("utf8"), "utf-8").when(F.col("undefined"), "latin-1").otherwise("cp1252")
    known = kinds.filter("kind = 'csv'").withColumn("encoding", encoding)
    known = known.select("path", "encoding", choose_delimiter(_decoded(F.col("content"))).alias("delimiter"))
    known = materialize(known.withColumn("rank", F.array_position(F.lit(list(DELIMITERS)), F.col("delimiter")).cast("int") - 1), "described")
    return _shaped(splits.grid(lines, known, ranges), known.select("path", "encoding", "delimiter"), wrong, max_rows)


def _shaped(grid: DataFrame, described: DataFrame, wrong: DataFrame, max_rows: int | None) -> Parsed:
    located = locate_headers(grid)
    header = grid.join(located.select("path", F.col("header_row").alias("row_no")), ["path", "row_no"], "left_semi")
    # One row per file, written so that few files are broadcast: their rows then stay where they lie.
    located = materialize(located.join(header.select("path", header_names(F.col("cells")).alias("headers")), "path"), "located")
    over = F.lit(False) if max_rows is None else F.col("grid_rows") > max_rows + HEADER_SCAN_LIMIT
    too_long = located.filter(over).select(
        "path", F.concat(F.col("grid_rows").cast("string"), F.lit(f" rows, more than the {max_rows} allowed here"))
        .alias("reason"))
    broken = located.filter("problem is not null").select(
        "path", F.concat(F.lit("could not parse as csv: "), F.col("problem")).alias("reason"))
    usable = located.filter(~over & F.col("problem").isNull())

    lines = grid.select("path", "row_no", "cells").join(
        usable.select("path", "header_row", "headers"), "path")
    blank, summary = is_blank_row(F.col("cells")), is_summary_row(F.col("cells"))
    above = F.col("row_no") < F.col("header_row")
    kind = (F.when(above & blank, "spacer").when(above, "preamble")
            .when(F.col("row_no") == F.col("header_row"), "header")
            .when(blank, "blank").when(summary, "summary").otherwise("data"))
    width = F.size("headers")
    values = F.transform(F.slice("cells", F.lit(1), width), collapse)
    padded = F.concat(values, F.array_repeat(F.lit(""), width - F.size(values)))
    # Judged once: numbering, counting and the columns in use all read the same rows.
    lines = materialize(lines.select("path", "row_no", kind.alias("kind"), (F.size("cells") > width).alias("cut"),
                                     F.when(kind == "data", padded).alias("values")), "lines")
    # Numbered inside stretches of a file, after the data rows of the stretches before.
    stretch = F.floor(F.col("row_no") / STRETCH_ROWS).alias("stretch")
    data = lines.filter("kind = 'data'").select(
        "path", stretch, "row_no", "values")
    earlier = Window.partitionBy("path").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    begins = lines.filter("kind = 'data'").groupBy("path", stretch).agg(F.count("*").alias("n")).select(
        "path", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    begins = materialize(begins, "begins")
    parts = -(-lines.filter("kind = 'data'").count() // STRETCH_ROWS)
    if parts > data.sparkSession.sparkContext.defaultParallelism:  # a stretch to a task, however many there are
        data = data.repartition(parts, "path", "stretch")
    within = F.row_number().over(Window.partitionBy("path", "stretch").orderBy("row_no"))
    data = data.withColumn("within", within).join(begins, ["path", "stretch"]).select(
        "path", (F.col("within") + F.col("begin")).alias("row_number"), "values")

    filled = lines.filter("kind = 'data'").select("path", F.posexplode("values").alias("at", "value")).filter("value <> ''")
    in_use = filled.groupBy("path", "at").agg(F.lit(1).alias("one")).groupBy("path").agg(
        F.collect_list("at").alias("in_use"))
    repairs = lines.groupBy("path").agg(
        F.count_if(F.col("kind") == "preamble").alias("preamble_rows"),
        F.count_if(F.col("kind") == "blank").alias("blank_rows"),
        F.count_if(F.col("kind") == "summary").alias("summary_rows"),
        F.count_if(F.col("kind") == "data").alias("data_rows"),
        F.count_if((F.col("kind") == "data") & F.col("cut")).alias("truncated_rows"))
    keep = F.filter(F.sequence(F.lit(0), F.size("headers") - 1), lambda i: F.array_contains("in_use", i)
                    | ~F.get("headers", i).startswith("column_"))
    info = (usable.select("path", "header_row", "obvious", "headers").join(repairs, "path")
            .join(in_use, "path", "left").withColumn("in_use", F.coalesce("in_use", F.array().cast("array<int>")))
            .withColumn("keep", keep)
            .join(described, "path"))
    info = materialize(info, "info")
    unnamed = F.size(F.filter("headers", lambda h: h.rlike("^column_\\d+$")))
    shaped_files = info.select(
        "path", F.transform("keep", lambda i: F.get("headers", i)).alias("headers"), "encoding", "delimiter",
        "header_row", "obvious", "preamble_rows", "blank_rows", "summary_rows", "truncated_rows", "data_rows",
        unnamed.cast("long").alias("unnamed_columns"),
        (F.size("headers") - F.size("keep")).cast("long").alias("dropped_columns"))
    rows = data.join(info.select("path", "keep"), "path").select(
        "path", "row_number", F.transform("keep", lambda i: F.get("values", i)).alias("values"))
    return Parsed(rows, shaped_files, wrong.unionByName(too_long).unionByName(broken))


def preview(parsed: Parsed, rows: int = 5) -> DataFrame:
    """The first rows of each file under its headers."""
    return parsed.rows.filter(F.col("row_number") <= rows).join(parsed.files.select("path", "headers"), "path")


STATEMENT_LINE = ("^(\\d{1,2}[/-][A-Za-z0-9]{2,4}[/-]\\d{2,4})\\s+(.+?)\\s+([\\d,]+\\.\\d{2})\\s*(CR|DR)?\\s*$")


def statement_lines(lines: DataFrame) -> DataFrame:
    """Date, narration, amount and sign from statement text lines; other lines are left out.

    `lines` has a `value` column, as `spark.read.text` returns it.
    """
    line = F.trim("value")
    kept = lines.filter(line.rlike(STATEMENT_LINE))
    part = [F.regexp_extract(line, STATEMENT_LINE, i) for i in range(1, 5)]
    others = [c for c in lines.columns if c != "value"]
    return kept.select(*others, part[0].alias("date"), F.trim(part[1]).alias("narration"), part[2].alias("amount"),
                       part[3].alias("sign"))
