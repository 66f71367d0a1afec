"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Vectors are scaled to length one and projected on random normal directions. Two vectors at the
threshold differ in each projection by a normal amount of known spread, so the chance to fall into
a window around each other is known, and with it the count of collisions that a linked pair
reaches with the wanted probability (`calibrated`). Only pairs that reach it are verified, in
double precision.

Windows of one projection hold a fixed share of all vectors, so they can't be paired as they are.
A table deals the vectors by the cells of several further projections at once; there are as many
tables as it takes for a linked pair to share a cell in one of them with the wanted probability,
and as many projections to a table as keep a cell at about CELL unrelated vectors. Within a cell
vectors are sorted along one projection, each looks at its window, and collisions are counted over
all the others. A pair that shares several cells counts in the first.

Equal vectors are one entry with a weight. A cell of more than BLOCK entries is worked in pairs of
blocks. Cells hand out, for each vector, how many it is linked with there and one link that keeps
it connected, never the pairs; so a dense group costs comparisons but no rows.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows
without an id, link with nothing; vectors of different length never link; a repeated id is one
vector for each of its rows; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .chunks import flat, mixed
from .common import read, store
from .simhash import forest

COSINE, RECALL = 0.95, 0.999
CELL, BLOCK, WIDTH = 128, 1024, 2.0
PROJECTIONS, WINDOW = 24, 2.5  # counted projections; half a window in spreads of a pair at the threshold
PAIRS, HELD = 200_000, 20_000  # pairs compared and vectors held at once


def calibrated(cosine: float, recall: float = RECALL) -> tuple[float, int]:
    """(half window, least count): a pair at the threshold reaches the count with probability `recall`."""
    inside = math.erf(WINDOW / math.sqrt(2))
    tail = 0.0
    for count in range(PROJECTIONS + 1):
        tail += math.comb(PROJECTIONS, count) * inside ** count * (1 - inside) ** (PROJECTIONS - count)
        if tail > 1 - recall:
            return WINDOW * math.sqrt(2 - 2 * cosine), count
    return WINDOW * math.sqrt(2 - 2 * cosine), PROJECTIONS


def tables_for(entries: int, cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """(projections of a table, tables)."""
    spread = math.sqrt(2 - 2 * cosine)
    z = np.linspace(-8, 8, 20001)
    weight = np.exp(-z * z / 2) / np.exp(-z * z / 2).sum()
    together = float((weight * np.maximum(0, 1 - abs(z) * spread / WIDTH)).sum())
    stranger = float((weight * np.maximum(0, 1 - abs(z) * math.sqrt(2) / WIDTH)).sum())
    size = max(1, math.ceil(math.log(max(entries, 1) / CELL) / math.log(1 / stranger))) if entries > CELL else 1
    return size, math.ceil(math.log(1 - recall) / math.log(1 - together ** size))


def projected(unit: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """unit @ directions, added up in one order, so that a vector always gets the same bits."""
    total = np.zeros((len(unit), directions.shape[1]))
    for k in range(unit.shape[1]):
        total += unit[:, k, None] * directions[k]
    return total


class Grid:
    """Directions for one vector length: cells of all tables, and the counted projections."""

    def __init__(self, length: int, size: int, tables: int):
        rng = np.random.default_rng(length)
        self.size, self.tables = size, tables
        self.directions, self.shift = rng.normal(size=(length, size * tables)), rng.uniform(0, WIDTH, size * tables)
        self.counted = rng.normal(size=(length, PROJECTIONS + 1))
        self.salts = mixed(rng.integers(1, 1 << 62, size * tables).astype("u8"))

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """One number for each vector and table."""
        steps = np.floor((projected(unit, self.directions) + self.shift) / WIDTH).astype("i8").view("u8")
        hashed = mixed(steps + self.salts).reshape(len(unit), self.tables, self.size)
        return mixed(np.bitwise_xor.reduce(hashed, axis=2)).view("i8")


def units(column: pa.Array | pa.ChunkedArray, length: int) -> np.ndarray:
    values = flat(column if isinstance(column, pa.ChunkedArray) else pa.chunked_array([column]))[0]
    vectors = values.reshape(-1, length).astype("f8")
    vectors /= np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def usable(vector: str | Column) -> Column:
    vector = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _dealt(batches: Iterator[pa.RecordBatch], size: int, tables: int) -> Iterator[pa.RecordBatch]:
    """Each vector once for each table, with its cell there."""
    grids: dict[int, Grid] = {}
    for batch in batches:
        lengths = batch.column(3).to_numpy()
        for length in np.unique(lengths).tolist():
            grid = grids.setdefault(length, Grid(length, size, tables))
            part = batch.filter(pa.array(lengths == length))
            for at in range(0, part.num_rows, 2000):
                some = part.slice(at, 2000)
                cells = grid.cells(units(some.column(2), length))
                take = pa.array(np.repeat(np.arange(some.num_rows), tables))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(tables, dtype="i4"), some.num_rows)), pa.array(cells.ravel()),
                     *[some.column(i).take(take) for i in range(4)]],
                    names=["table", "cell", "rep", "n", "vector", "dim"])


def _compare(group, table, own, mixed_blocks, rep, n, unit, grid: Grid, cosine: float) -> Iterator[pa.RecordBatch]:
    """Whole groups (a cell, or a pair of its blocks) of one vector length."""
    half, least = calibrated(cosine)
    values = projected(unit, grid.counted)
    order = np.lexsort((values[:, 0], group))
    group, table, own, mixed_blocks, rep, n, unit, values = (
        x[order] for x in (group, table, own, mixed_blocks, rep, n, unit, values))
    # the windows along the sorting projection are wide enough to miss nothing
    lead = group * 1e4 + values[:, 0]
    last = np.searchsorted(lead, lead + 2 * half, "right")
    partners = last - np.arange(len(lead)) - 1
    ends = np.cumsum(partners)
    links, a, b = np.zeros(len(rep), "i8"), [], []
    values = values[:, 1:].astype("f4")
    at = 0
    while at < len(rep):
        stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")), at + 1)
        many = partners[at:stop]
        x = np.repeat(np.arange(at, stop), many)
        y = np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many) + x + 1
        keep = ~mixed_blocks[x] | (own[x] != own[y])
        x, y = x[keep], y[keep]
        hits = (np.abs(values[x] - values[y]) <= half).sum(1)
        x, y = x[hits >= least], y[hits >= least]
        close = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
        x, y = x[close], y[close]
        if len(x):
            which, place = np.unique(np.concatenate([x, y]), return_inverse=True)
            cells = grid.cells(unit[which])
            first = (cells[place[:len(x)]] == cells[place[len(x):]]).argmax(1) == table[x]
            x, y = x[first], y[first]
            np.add.at(links, x, n[y])
            np.add.at(links, y, n[x])
            a.append(rep[x])
            b.append(rep[y])
            if sum(map(len, a)) > 500_000:
                a, b = ([part] for part in forest(np.concatenate(a), np.concatenate(b)))
        at = stop
    if not a:
        return
    node, root = forest(np.concatenate(a), np.concatenate(b))
    held = np.flatnonzero(links)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([rep[held], node])), pa.array(np.concatenate([rep[held], root])),
                                      pa.array(np.concatenate([links[held], np.zeros(len(node), "i8")]))],
                                     names=["a", "b", "links"])


def _compared(batches: Iterator[pa.RecordBatch], size: int, tables: int, cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by group; the buffer is worked off at the end of a group."""
    grids: dict[int, Grid] = {}
    kept: list[pa.RecordBatch] = []

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        lengths = rows.column("dim").to_numpy()
        for length in np.unique(lengths).tolist():
            part = rows.filter(pa.array(lengths == length)) if len(np.unique(lengths)) > 1 else rows
            names = ("table", "cell", "i", "j")
            key = np.stack([part.column(c).to_numpy().astype("i8") for c in names])
            group = np.cumsum(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])) - 1
            yield from _compare(group, key[0], part.column("own").to_numpy(), key[2] != key[3], part.column("rep").to_numpy(),
                                part.column("n").to_numpy(), units(part.column("vector"), length),
                                grids.setdefault(length, Grid(length, size, tables)), cosine)

    def last_group(rows: pa.Table) -> int:
        same = np.ones(rows.num_rows, bool)
        for name in ("table", "cell", "i", "j"):
            values = rows.column(name).to_numpy()
            same &= values == values[-1]
        return int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0

    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
        if sum(x.num_rows for x in kept) >= HELD:
            rows = pa.Table.from_batches(kept)
            cut = last_group(rows)
            if cut:
                yield from work(rows.slice(0, cut))
            kept = rows.slice(cut).to_batches()
    if kept:
        yield from work(pa.Table.from_batches(kept))


def near_duplicates(rows: DataFrame, key: str, vector: str, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(key, n_links, component_id) of every row."""
    own = rows.select(F.col(key).cast("bigint").alias("id"), F.when(usable(vector), F.col(vector)).alias("vector"))
    able = own.where(F.col("vector").isNotNull() & F.col("id").isNotNull())
    classes = store(able.groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
                    .select("rep", "n", "vector", F.size("vector").alias("dim")), "vectors")
    size, tables = tables_for(classes.count(), cosine, recall)
    vector_type = classes.schema["vector"].dataType.simpleString()
    dealt = classes.mapInArrow(lambda it: _dealt(it, size, tables),
                               f"table int, cell bigint, rep bigint, n bigint, vector {vector_type}, dim int")
    counts = classes.select("rep", "n", "vector", "dim").mapInArrow(
        lambda it: (b.select(["table", "cell", "dim"]) for b in _dealt(it, size, tables)), "table int, cell bigint, dim int")
    full = counts.groupBy("table", "cell", "dim").agg(F.count("*").alias("entries")).where("entries > 1").select(
        "table", "cell", "dim", F.ceil(F.col("entries") / BLOCK).cast("int").alias("blocks"))
    met = dealt.join(full, ["table", "cell", "dim"]).select(
        "table", "cell", "dim", "rep", "n", "vector", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("own"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("table", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep",
                     "n", "vector", "dim")
    groups = ["table", "cell", "dim", "i", "j"]
    found = store(met.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(
        lambda it: _compared(it, size, tables, cosine), "a bigint, b bigint, links bigint"), "links")
    joined = components(found.where("a <> b"))
    links = found.where("a = b").groupBy("a").agg(F.sum("links").alias("links"))
    named = classes.select("rep", "n", "vector").join(links, F.col("rep") == F.col("a"), "left").join(
        joined, F.col("rep") == F.col("node"), "left").select(
        F.col("vector").alias("of"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"))
    linked = able.join(named, F.col("vector") == F.col("of")).select("id", "n_links", "component_id")
    alone = own.where(F.col("vector").isNull() | F.col("id").isNull()).select(
        "id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).withColumnRenamed("id", key)


def op5_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return found.select("vec_id", "n_links", "component_id",
                        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
