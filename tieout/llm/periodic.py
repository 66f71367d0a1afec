"""Stretches of words that repeat themselves: all runs of every text, and the texts without the repeats.

A run is a stretch with smallest period q (words q apart are equal) and length of at least
max(MIN_LENGTH, TIMES * q) that no neighbouring word extends. Its start s and s + q share a longest common prefix (LCP) of
length - q words, and no position between them shares as much, else the period would be smaller.

So the suffixes of a text are united as Kruskal's method unites nodes: neighbours of the suffix array
are edges, taken by descending LCP, and union-find keeps for each class its positions in order. When two classes
meet at LCP l, positions i < j that become neighbours in the joined order have exactly the
common prefix l. If j - i is small against l they seed a run of period j - i, which ends with the
common prefix; it starts at i if the words before i and j differ, and otherwise further left, where it has
a seed of its own. Nothing is compared twice, and no run is found twice.

An edge below the least LCP of a run (five words for the given limits) seeds nothing. Texts without
a repeated window of so many words are left out before sorting; suffix arrays are built for the
others by doubling, a whole Arrow batch at a time on flat arrays. A text is one row and its work stays in one task:
no shuffle, and nothing is kept between batches.

Words are runs of characters other than space and \\x09 to \\x0D. Defined results: null, empty and blank texts have no words,
no runs and an empty collapsed text; repeated rows give repeated rows; a null id counts as the empty text where the
query plants repeats; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import chain, count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .chunks import mixed, packed
from .common import read

MIN_LENGTH, TIMES = 6, 4
# Up to so many positions are inserted one by one into a class, more are merged with it.
FEW = 24
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def least_lcp(min_length: int, times: int) -> int:
    """The smallest common prefix of any run's seed."""
    return min(max((times - 1) * q, min_length - q) for q in range(1, min_length + 1))


def _repeated(words: np.ndarray, block: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Whether the `width` words from each place on also start elsewhere in its text (by hash: maybe more)."""
    key = mixed(block.astype("u8"))
    for at in range(width):
        key[:len(words) - at] = mixed(key[:len(words) - at] + words[at:].astype("u8"))
    places = np.flatnonzero(np.arange(len(words)) + width <= ends[block])
    order = places[np.argsort(key[places])]
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(words), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def suffix_order(words: np.ndarray, block: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places by text and by the words from there on, by doubling; only ties are sorted again."""
    total = len(words)
    key = block.astype("i8") * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    stop = ends[block]

    def heads(fresh: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))

    head = heads(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    rank = np.empty(total, "i8")
    rank[order] = head
    tied = np.bincount(head, minlength=total)[head] > 1
    left, step = order[tied], 1
    while len(left):
        ahead = left + step
        inside = ahead < stop[left]
        second = np.where(inside, rank[np.minimum(ahead, total - 1)] + 1, 0)
        sort = np.lexsort((second, rank[left]))
        left, second = left[sort], second[sort]
        old = rank[left]
        lead = np.concatenate([[True], old[1:] != old[:-1]])
        offset = np.arange(len(left)) - heads(lead)
        order[old + offset] = left
        fresh = lead | np.concatenate([[True], second[1:] != second[:-1]])
        new = (old + offset)[heads(fresh)]
        rank[left] = new
        group = heads(fresh)
        left = left[np.bincount(group, minlength=len(left))[group] > 1]
        step *= 2
    return order


def _edges(words: np.ndarray, block: np.ndarray, ends: np.ndarray, repeated: np.ndarray, least: int) -> list[tuple]:
    """(LCP, place, place before it in suffix order) of at least `least`, longest first."""
    order = suffix_order(words, block, ends)
    before = np.full(len(words), -1)
    before[order[1:]] = order[:-1]
    places = np.flatnonzero(repeated & (before >= 0) & (block == block[before]))
    symbols, found, shared, last = words.tolist(), [], 0, -2
    for i, j, end in zip(places.tolist(), before[places].tolist(), ends[block[places]].tolist(), strict=True):
        shared = max(shared - 1, 0) if i == last + 1 else 0  # one word less than from the place before
        most = end - max(i, j)
        while shared < most and symbols[i + shared] == symbols[j + shared]:
            shared += 1
        last = i
        if shared >= least:
            found.append((shared, i, j))
    found.sort(reverse=True)
    return found


def _runs(edges: list[tuple], symbols: list[int], first: np.ndarray, min_length: int, times: int) -> Iterator[tuple]:
    """(start place, length, period): unite the edges' classes and seed runs where places become neighbours."""
    parent: dict[int, int] = {}
    classes: dict[int, list[int]] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for shared, i, j in edges:
        for x in (i, j):
            if x not in parent:
                parent[x], classes[x] = x, [x]
        a, b = root(i), root(j)
        if len(classes[a]) < len(classes[b]):
            a, b = b, a
        large, small = classes[a], classes.pop(b)
        parent[b] = a
        near = []
        for k, x in enumerate(small):
            at = bisect_left(large, x)
            if at and (not k or small[k - 1] < large[at - 1]):
                near.append((large[at - 1], x))
            if at < len(large) and (k + 1 == len(small) or small[k + 1] > large[at]):
                near.append((x, large[at]))
        if len(small) <= FEW:
            for x in small:
                insort(large, x)
        else:
            large.extend(small)
            large.sort()
        for x, y in near:
            period = y - x
            if (shared >= (times - 1) * period and shared + period >= min_length
                    and (first[x] or symbols[x - 1] != symbols[y - 1])):
                yield x, shared + period, period


def runs_of(texts: list[list], min_length: int = MIN_LENGTH, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """All runs (start, length, period) of each list of words, by start, then period."""
    out: list[list] = [[] for _ in texts]
    sizes = np.fromiter(map(len, texts), "i8", len(texts))
    known = dict(zip(dict.fromkeys(chain.from_iterable(texts)), count()))  # noqa: B905
    words = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), "i8", sizes.sum())
    least = least_lcp(min_length, times)
    if len(words) <= least:
        return out
    block, ends = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes)
    repeated = _repeated(words, block, ends, least)
    live = np.unique(block[repeated])
    if not len(live):
        return out
    chosen = np.isin(block, live)
    words, repeated = words[chosen], repeated[chosen]
    block, ends = np.repeat(np.arange(len(live)), sizes[live]), np.cumsum(sizes[live])
    starts = ends - sizes[live]
    first = np.zeros(len(words), bool)
    first[starts] = True
    edges = _edges(words, block, ends, repeated, least)
    for place, length, period in _runs(edges, words.tolist(), first, min_length, times):
        own = block[place]
        out[live[own]].append((int(place - starts[own]), length, period))
    for one in out:
        one.sort()
    return out


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [words[k] for k in np.flatnonzero(keep)]


def find_runs(docs: DataFrame, key: str, text: str, prepare: Callable[[object, list], list] | None = None,
              min_length: int = MIN_LENGTH, times: int = TIMES) -> DataFrame:
    """(key, runs, collapsed) of every whole text: all runs by start, and the kept words joined by a space.

    `prepare(key, words)` may change a text's words before.
    """
    source = docs.select(key, text)
    made = StructType.fromDDL(f"runs array<{RUN}>, collapsed string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [(t or b"").split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            if prepare:
                texts = [prepare(k, words) for k, words in zip(batch.column(0).to_pylist(), texts, strict=True)]
            found = runs_of(texts, min_length, times)
            flat = np.array([r for one in found for r in one], "i8").reshape(-1, 3)
            rows = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
            left = pa.array([b" ".join(kept_words(w, r)) for w, r in zip(texts, found, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), packed(rows, np.cumsum([len(r) for r in found])), left.cast(pa.string())],
                names=[key, "runs", "collapsed"])

    return source.mapInArrow(run, StructType(source.schema.fields[:1] + made.fields))


def planted(key: object, words: list) -> list:
    """One text in ten, by the crc32 of its id, repeats a stretch of its own words to its end."""
    h = crc32(b"" if key is None else str(key).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(read(spark, sf_dir, "documents"), "doc_id", "text", planted)
    # the longest run; of equal ones the first, then the shortest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
