"""Near copies of whole texts: SimHash groups and MinHash bands for the candidates, exact Jaccard similarity to link them.

Words are those of `simhash` (ASCII letters folded, cut at ASCII white space). Texts are compared
by their sets of five-word shingles; a text of fewer words is one shingle. Texts that share a band
meet under its key and are linked only where the exact similarity of their sets reaches the
threshold; bands are as many as `paragraphs.bands_for` says for the wanted recall there.

The groups of `simhash` (fingerprints at 4 or fewer differing bits) are such keys as well. They alone
don't find all candidates: at similarity 0.8 about 10 of 64 bits differ, and a radius of 13 takes blocks
of so few bits that a fixed share of all pairs would meet.

Equal texts are one entry from the start. A key's texts are dealt to blocks of HELD shingles that
meet in pairs, each a task of its own; a text linked there is not compared again except to find
further members, so a dense group costs a few passes and not all its pairs.

Defined results: texts without words, null ones too, have one and the same empty set and are copies
of one another; rows without a key are kept only where their group has no other; equal rows are one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from . import simhash
from .chunks import flat, mixed
from .common import map_texts, store
from .paragraphs import RECALL, SHINGLE, SIMILARITY, bands_for, shingles

# Sharper than op7's three: texts that share only a common passage seldom meet.
ROWS_PER_BAND = 5
# Shingles of one block.
HELD = 500_000
EMPTY = 0


def text_shingles(text: str, known: dict) -> np.ndarray:
    """The distinct five-word shingles of a text as sorted hashes; none for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, "u8")
    if len(words) < SHINGLE:
        words = [b" ".join(words)] + [b""] * (SHINGLE - 1)
    return np.unique(shingles(words, known))


def _bands(found: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One key for each band of a text's least hashes."""
    least = np.concatenate([(found[None, :] * part[:, None]).min(axis=1)
                            for part in np.array_split(seeds, max(1, len(found) * len(seeds) // 1_000_000))])
    keys = np.zeros(len(seeds) // ROWS_PER_BAND, "u8")
    for k in range(ROWS_PER_BAND):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + least[k::ROWS_PER_BAND]
    return mixed(keys + np.arange(1, len(keys) + 1, dtype="u8")).view("i8")


def signatures(docs: DataFrame, keys: list[str], text: str, bands: int) -> DataFrame:
    """(keys, size, bands): the number of shingles and the band keys of every text."""
    def start() -> Callable:
        known: dict = {}
        seeds = np.random.default_rng(7).integers(1, 1 << 62, bands * ROWS_PER_BAND).astype("u8") * np.uint64(2) + np.uint64(1)

        def work(texts: list[str]) -> list:
            sets = [text_shingles(t, known) for t in texts]
            made = [_bands(s, seeds) if len(s) else np.zeros(0, "i8") for s in sets]
            return [np.fromiter(map(len, sets), "i8", len(sets)), pa.array(made, pa.list_(pa.int64()))]
        return work
    return map_texts(docs, keys, text, "size bigint, bands array<bigint>", start)


def _linked(table: pa.Table, similarity: float) -> pa.Table:
    """Links (a, b) that join the texts of one pair of blocks as all their similar pairs would."""
    units = table.column("unit").to_numpy()
    values, sizes = flat(table.column("shingles"))
    distinct, ids = np.unique(values, return_inverse=True)
    owner = np.repeat(np.arange(len(units)), sizes)
    ends, fresh = np.cumsum(sizes), np.ones(len(units), bool)
    a, b = [], []

    def index() -> tuple[np.ndarray, np.ndarray]:
        some = fresh[owner]
        order = np.argsort(ids[some], kind="stable")
        return owner[some][order], np.searchsorted(ids[some][order], np.arange(len(distinct) + 1))

    holders, edges = index()
    indexed = len(units)
    waiting: list[int] = []
    for first in range(len(units)):
        if not fresh[first]:
            continue
        fresh[first] = False
        waiting.append(first)
        while waiting:
            x = waiting.pop()
            if 2 * (left := int(fresh.sum())) < indexed:  # drop the linked from the index
                holders, edges = index()
                indexed = left
            if not left:
                break
            mine = ids[ends[x] - sizes[x]:ends[x]]
            common = np.bincount(np.concatenate([holders[edges[i]:edges[i + 1]] for i in mine]), minlength=len(units))
            close = np.flatnonzero(fresh & (common >= similarity * (sizes[x] + sizes - common) - 1e-9))
            fresh[close] = False
            waiting.extend(close.tolist())
            a.append(units[close])
            b.append(np.full(len(close), units[x]))
        waiting.clear()
    return pa.table({"a": np.concatenate(a) if a else np.zeros(0, "i8"),
                     "b": np.concatenate(b) if b else np.zeros(0, "i8")})


def simhash_keys(rows: DataFrame) -> DataFrame:
    """(unit, key): the units of (unit, row, text) under a key for each group of linked SimHash fingerprints."""
    marked = store(simhash.fingerprints(rows, ["unit", "row"], "text").dropDuplicates(["unit"]), "prints")
    rooted = simhash.groups(marked, "unit")
    return marked.join(rooted, "fp").select("unit", F.xxhash64(F.lit("simhash"), "root").alias("key"))


def links(rows: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Links (a, b) between the units of (unit, row, text) that join all pairs of at least `similarity`.

    Rows of one unit have one text; rows of one `row` are equal.
    """
    bands = bands_for(similarity, recall, ROWS_PER_BAND)
    signed = store(signatures(rows, ["unit", "row"], "text", bands).dropDuplicates(["unit"]), "signatures")
    asked = signed.select("unit", "row", "size", F.explode("bands").alias("key")).unionByName(
        signed.join(simhash_keys(rows), "unit").select("unit", "row", "size", "key"))
    # near copies share most bands: keep one key for each set of texts
    sets = asked.groupBy("key").agg(F.bit_xor(F.xxhash64("unit")).alias("mark"), F.count("*").alias("n"),
                                    F.sum("size").alias("size")).where("n > 1")
    sets = sets.groupBy("mark", "n").agg(F.min(F.struct("key", "size")).alias("s")).select(
        "s.key", F.ceil(F.col("s.size") / HELD).cast("int").alias("blocks"))
    members = store(asked.join(sets, "key").select("key", "unit", "row", "blocks"), "members")
    own = F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int")
    met = members.select("key", "unit", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "key", "unit", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            sets = [text_shingles(t or "", known).view("i8") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["unit", "shingles"])

    held = rows.select("unit", "row", "text").join(members.select("unit", "row").distinct(), ["unit", "row"]).select(
        "unit", "text").mapInArrow(cut, "unit bigint, shingles array<bigint>").dropDuplicates(["unit"])
    found = met.join(held, "unit").groupBy("key", "i", "j").applyInArrow(
        lambda t: _linked(t, similarity), "a bigint, b bigint")
    return found.distinct()


def one_of_each(docs: DataFrame, key: str, text: str, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """All columns of one row of each group: the smallest key's, of equal keys the one with the smaller hash of all its columns."""
    bare = F.translate(F.coalesce(F.col(text), F.lit("")), " \t\n\x0b\x0c\r", "")
    rows = docs.select(F.struct("*").alias("doc"), F.xxhash64(*docs.columns).alias("row"), F.col(key).alias("key"),
                       F.when(bare == "", F.lit(EMPTY)).otherwise(F.xxhash64(text)).alias("unit"), F.col(text).alias("text"))
    linked = components(links(rows.select("unit", "row", "text"), similarity, recall))
    once = rows.groupBy("unit").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("first"))
    kept = (once.join(linked, once["unit"] == linked["node"], "left")
            .groupBy(F.coalesce("component", "unit").alias("root")).agg(F.min("first").alias("first")).select("first.row"))
    return rows.select("doc", "row").join(kept, "row").dropDuplicates(["row"]).select("doc.*")
