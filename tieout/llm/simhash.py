"""SimHash near duplicates by meeting in the middle.

Two fingerprints that differ in at most 2r bits have a common variant within r bits of each. Every
distinct fingerprint therefore emits its ball of radius r; whoever shares a variant is linked. All
holders of a variant are within 2r bits of each other, so they are joined to one of them instead
of being paired, and no link between components is lost.

The ball of 2,081 variants (radius 2) isn't shuffled one by one. A variant's address is its bits
folded to 16 by parity; the ball of a fingerprint touches 1 + 16 + 120 addresses, each with at most
97 of its variants. The fingerprint goes once to each address and its variants there are made on
the spot. Parity folding deals even a dense group of near copies over thousands of addresses.

Defined results: a null or empty text, or one without words, has fingerprint zero, which links like
any other; equal texts share a fingerprint; repeated rows give repeated rows; rows without an id
take part and do not name a component (one made only of them is null); further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .common import map_texts, read, store

SHINGLE_WORDS = 4
SEED = 42
FOLD = 16
# Variants held at once by a task.
VARIANTS = 2_000_000


def fingerprint(text: str, size: int = SHINGLE_WORDS) -> int:
    """Majority bits of the XXH64 of all shingles, as a signed number."""
    import xxhash

    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space cuts
    if not words:
        return 0
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(len(words) - size + 1, 1)
    starts, ends = starts[:last], ends[min(size, len(words)) - 1:]
    ones = np.zeros(64, "i8")
    for at in range(0, last, 65536):
        cut = zip(starts[at:at + 65536].tolist(), ends[at:at + 65536].tolist(), strict=True)
        hashes = np.array([hashed(joined[i:j], SEED) for i, j in cut], "<u8")
        ones += np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(ones * 2 > last, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keys: list[str], text: str, size: int = SHINGLE_WORDS) -> DataFrame:
    def start() -> Callable:
        return lambda texts: [np.array([fingerprint(t, size) for t in texts], "i8")]
    return map_texts(docs, keys, text, "fp bigint", start)


def _ball() -> tuple[list[int], dict[int, np.ndarray]]:
    """All flips of at most two bits, by the address they move a fingerprint to."""
    flips: dict[int, list[int]] = {0: [0]}
    for bits in [*combinations(range(64), 1), *combinations(range(64), 2)]:
        step = 0
        for bit in bits:
            step ^= 1 << (bit % FOLD)
        flips.setdefault(step, []).append(sum(1 << b for b in bits))
    return sorted(flips), {k: np.array(v, "u8") for k, v in flips.items()}


def _folded(values: np.ndarray) -> np.ndarray:
    return (values ^ values >> np.uint64(16) ^ values >> np.uint64(32) ^ values >> np.uint64(48)) & np.uint64(0xFFFF)


def _met(address: np.ndarray, prints: np.ndarray, flips: dict[int, np.ndarray], held: int) -> tuple:
    """Edges (fingerprint, the smallest with a common variant), for whole addresses at a time.

    Where the variants outgrow the buffer they are made in slices of the variant space.
    """
    step = (_folded(prints) ^ address.astype("u8")).astype("i8")
    order = np.argsort(step, kind="stable")
    at = np.flatnonzero(np.diff(step[order], prepend=-1))
    parts = [(order[i:j], flips[int(step[order[i]])]) for i, j in zip(at, [*at[1:], len(order)], strict=True)]
    slices = -(-sum(len(rows) * len(ball) for rows, ball in parts) // held)
    found_a, found_b = [], []
    for which in range(slices):
        made, owners = [], []
        for rows, ball in parts:
            for cut in range(0, len(rows), max(held // len(ball), 1)):
                some = rows[cut:cut + max(held // len(ball), 1)]
                values, owner = (prints[some][:, None] ^ ball).ravel(), np.repeat(some, len(ball))
                if slices > 1:
                    mixed = (values * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(slices)
                    values, owner = values[mixed == which], owner[mixed == which]
                made.append(values)
                owners.append(owner)
        variants, owner = np.concatenate(made), np.concatenate(owners)
        ordered = np.sort(variants)
        shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(shared):
            continue
        place = np.minimum(np.searchsorted(shared, variants), len(shared) - 1)
        hit = np.flatnonzero(shared[place] == variants)
        place, signed = place[hit], prints[owner[hit]].view("i8")
        least = np.full(len(shared), np.iinfo("i8").max)
        np.minimum.at(least, place, signed)
        found_a.append(signed)
        found_b.append(least[place])
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.zeros(0, "i8"),) * 2


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest node of its component among these edges."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = flat[:len(a)], flat[len(a):], np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        if (label[x] == least).all() and (label[y] == least).all():
            break
        np.minimum.at(label, label[x], least)
        np.minimum.at(label, label[y], least)
        while (label[label] != label).any():
            label = label[label]
    inner = label != np.arange(len(nodes))
    return nodes[inner], nodes[label[inner]]


def _meet(batches: Iterator[pa.RecordBatch], flips: dict[int, np.ndarray], held: int) -> Iterator[pa.RecordBatch]:
    """Addresses arrive in order; the buffer is worked off at the end of an address."""
    kept_a, kept_p, size = [], [], 0

    def work(address: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = forest(*_met(address, prints, flips, held))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        kept_a.append(batch.column(0).to_numpy())
        kept_p.append(batch.column(1).to_numpy().view("u8"))
        size += batch.num_rows
        if size * 16 > held:
            address, prints = np.concatenate(kept_a), np.concatenate(kept_p)
            cut = int(np.searchsorted(address, address[-1]))  # the last address may go on
            if cut:
                yield from work(address[:cut], prints[:cut])
            kept_a, kept_p, size = [address[cut:]], [prints[cut:]], len(address) - cut
    if size:
        yield from work(np.concatenate(kept_a), np.concatenate(kept_p))


def links(prints: DataFrame, held: int = VARIANTS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that keep all components of the 4-bit graph."""
    steps, flips = _ball()
    folded = F.col("fp").bitwiseXOR(F.shiftrightunsigned("fp", 16)).bitwiseXOR(
        F.shiftrightunsigned("fp", 32)).bitwiseXOR(F.shiftrightunsigned("fp", 48)).bitwiseAND(F.lit(0xFFFF)).cast("int")
    sent = (prints.select("fp").distinct()
            .select(folded.alias("at"), "fp", F.explode(F.array(*[F.lit(s) for s in steps])).alias("step"))
            .select(F.col("at").bitwiseXOR(F.col("step")).alias("address"), "fp"))
    dealt = sent.repartition("address").sortWithinPartitions("address")
    return dealt.mapInArrow(lambda it: _meet(it, flips, held), "a bigint, b bigint").distinct()


def groups(marked: DataFrame, key: str) -> DataFrame:
    """(fp, root, component_id) of every fingerprint: `root` is a fingerprint that names its group."""
    linked = components(links(marked))
    first = marked.groupBy("fp").agg(F.min(key).alias("first"))
    rooted = store(first.join(linked, first.fp == linked.node, "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root")), "roots")
    return rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select(
        "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fp, component_id): the smallest key reachable over links of at most 4 bits."""
    marked = store(fingerprints(docs, [key], text), "prints")
    return marked.join(groups(marked, key), "fp").select(key, "fp", "component_id")


def one_of_each(docs: DataFrame, key: str, text: str) -> DataFrame:
    """All columns of one row of each group: the smallest key's, of equal keys the one with the smaller hash.

    Rows without a key are kept only where their group has no other; equal rows are one.
    """
    rows = docs.select(F.struct("*").alias("doc"), F.xxhash64(key, text).alias("row"), F.col(key).alias("key"),
                       F.col(text).alias("text"))
    marked = store(fingerprints(rows, ["key", "row"], "text"), "prints")
    kept = (marked.join(groups(marked, "key"), "fp").groupBy("root")
            .agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("first")).select("first.row"))
    return rows.join(kept, "row").dropDuplicates(["row"]).select("doc.*")


def op10_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
