"""Documents packed into sequences of a fixed length by shortest-pack-first over the length histogram.

Every document is tokenized and closed by an end id. Whole multiples of the capacity are sequences of
their own; what is left, shorter than the capacity, is packed. Packing sees only how many remainders there are
of each length, at most capacity - 1 numbers however many documents. It opens as many packs as the remainders
fill, and takes lengths longest first, each into the shortest pack. Packs that look alike are one
pattern with a count, so a step places many remainders at once. A remainder longer than the space of the shortest pack is cut:
its head fills the pack, and its tail goes back into the histogram. The total is not a multiple of
the capacity, so the last packs are powers of two, which need no padding: no sequence has any.

Patterns come back to documents by rank. The remainders of one length are numbered 0, 1, 2, ...: a task numbers
its own while it tokenizes, and running sums over tasks, one window for each length, tell where a
task's numbers begin. A placement holds for a range of ranks, and the sequence is its first
sequence plus the rank's place in the range. The list of placements is sent along with the last pass. It follows the
histogram's shape and not the number of documents: about 7,000 rows for all 2,047 lengths with up to 10^9 documents each,
and 300,000 in the worst shape tried (nearly all documents under fifty ids).

Token ids are stored between the passes, so a text is tokenized once, by the tiktoken library with the ranks of the
vocabulary file (`bpe.Codec`): the ids are those of the tokenizers library, at a quarter of its time.

Defined results: a null or empty text has only the end id; repeated rows and rows without an id are packed each for
itself; equal lengths are ranked in no promised order, but once for all as ranks are stored; an empty table gives
an empty table; further columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bpe import Codec
from .common import read, store

VOCABULARY, END, CAPACITY = "byte_bpe_50k.json", 1, 2048
# Ids of a vocabulary of up to 65,536 are stored in two bytes, others in four.
NARROW = 1 << 16
# Rows by task and length that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def byte_ranks(vocabulary_file: str) -> dict[bytes, int]:
    """The tokens of a byte-level BPE vocabulary in the tokenizers library's format, as bytes with their ids.

    Ids must rise with the merges, so that an id is the rank of its merge.
    """
    with open(vocabulary_file, encoding="utf-8") as file:
        content = json.load(file)
    model, special = content["model"], {t["content"] for t in content["added_tokens"]}
    # the format writes visible Latin-1 characters as themselves, and other bytes as the characters from 256 on
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(visible))
    code = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ids = {token: i for token, i in model["vocab"].items() if token not in special}
    merged = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged) or content["pre_tokenizer"]["type"] != "ByteLevel" or content["normalizer"]:
        raise ValueError(f"{vocabulary_file} is not a byte-level BPE vocabulary in the order of its merges")
    return {bytes(code[c] for c in token): i for token, i in ids.items()}


def id_type(kinds: int) -> str:
    return "<u2" if kinds <= NARROW else "<u4"


def placements(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Where the remainders of each length go: rows (length, first rank, number of ranks, start in the remainder,
    size, first sequence, offset in the sequence). Sequences are numbered from 0.
    """
    whole, rest = divmod(sum(length * n for length, n in counts.items()), capacity)
    # (-space, first sequence, number of sequences, filled)
    packs = [(-capacity, 0, whole, 0)] if whole else []
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            packs.append((-(1 << bit), whole, 1, 0))
            whole += 1
    # (-size, length, first rank, number of ranks, start)
    lots = [(-length, length, 0, n, 0) for length, n in counts.items() if n]
    heapq.heapify(packs)
    heapq.heapify(lots)
    out = []
    while lots:
        size, length, rank, ranks, start = heapq.heappop(lots)
        space, first, sequences, filled = heapq.heappop(packs)
        n, put = min(ranks, sequences), min(-size, -space)
        out.append((length, rank, n, start, put, first, filled))
        if -size > put:
            heapq.heappush(lots, (size + put, length, rank, n, start + put))
        if -space > put:
            heapq.heappush(packs, (space + put, first, n, filled + put))
        if ranks > n:
            heapq.heappush(lots, (size, length, rank + n, ranks - n, start))
        if sequences > n:
            heapq.heappush(packs, (space, first + n, sequences - n, filled))
    return out


def tokenized(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int], pattern: str, end: int,
              capacity: int) -> DataFrame:
    """(key, part, rest, rank, fulls, ids): a task is a `part`, and numbers its remainders of each length.

    Whole sequences are numbered along; `rank` and `fulls` count the task's earlier ones.
    """
    source = docs.select(key, text)
    schema = StructType(source.schema.fields[:1] + StructType.fromDDL(
        "part int, rest int, rank bigint, fulls bigint, ids binary").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part, type_ = Codec(vocabulary, pattern), TaskContext.get().partitionId(), id_type(len(vocabulary))
        width, close = int(type_[-1]), np.array([end], type_).tobytes()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            ids = [codec.encode(t or "").astype(type_).tobytes() + close for t in batch.column(1).to_pylist()]
            rests, ranks, fulls = [], [], []
            for one in ids:
                full, rest = divmod(len(one) // width, capacity)
                rests.append(rest)
                ranks.append(seen[rest])
                fulls.append(seen[0])
                if rest:
                    seen[rest] += 1
                seen[0] += full
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(rests, pa.int32()),
                 pa.array(ranks, pa.int64()), pa.array(fulls, pa.int64()), pa.array(ids, pa.binary())],
                names=schema.names)

    return source.mapInArrow(run, schema)


def pack(docs: DataFrame, key: str, text: str, vocabulary_file: str, pattern: str = public_tokenizers.PATTERN,
         end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: (key, start, length, ids, doc_tokens, sequence_id, offset).

    `start` and `length` are in ids of the document; `ids` are the piece's own, little-endian in four bytes each.
    Sequences are numbered from 0.
    """
    vocabulary = byte_ranks(vocabulary_file)  # travels with the tasks; vocabularies are of fixed size
    rows = store(tokenized(docs, key, text, vocabulary, pattern, end, capacity), "tokens")
    type_ = id_type(len(vocabulary))
    width = int(type_[-1])
    # One row for each task and length, and for length 0 the task's whole sequences.
    full = F.floor(F.octet_length("ids") / (width * capacity)).cast("bigint")
    own = (rows.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(full).alias("full")))
    counted = (own.where("rest > 0").select("part", "rest", "n")
               .union(own.groupBy("part").agg(F.sum("full").alias("n")).select("part", F.lit(0).alias("rest"), "n")))
    earlier = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = store(counted.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "ranks")
    # at most `capacity` rows
    totals = dict(begins.groupBy("rest").agg(F.sum("n")).collect())
    packed_first = totals.pop(0, 0)
    by_length: dict[int, list] = defaultdict(list)
    for length, *row in placements(totals, capacity):
        by_length[length].append(row)
    plan = {length: np.array(sorted(found), "i8") for length, found in by_length.items()}

    how = "broadcast" if begins.count() <= BROADCAST_ROWS else "merge"
    first_full = begins.where("rest = 0").select("part", F.col("before").alias("part_fulls"))
    first_rank = begins.select("part", "rest", F.col("before").alias("part_rank"))
    ranked = (rows.join(first_full.hint(how), "part").join(first_rank.hint(how), ["part", "rest"])
              .select(key, "rest", (F.col("rank") + F.col("part_rank")).alias("rank"),
                      (F.col("fulls") + F.col("part_fulls")).alias("fulls"), "ids"))
    schema = StructType(ranked.schema.fields[:1] + StructType.fromDDL(
        "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint").fields)

    def pieces(rest: int, rank: int, fulls: int, size: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset)."""
        for k in range(size // capacity):
            yield k * capacity, capacity, fulls + k, 0
        if rest:
            found = plan[rest]
            for first, _, start, put, sequence, offset in found[(found[:, 0] <= rank) & (rank < found[:, 0] + found[:, 1])].tolist():
                yield size - rest + start, put, packed_first + sequence + rank - first, offset

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out, parts = [], [], []
            numbers = zip(*(batch.column(c).to_pylist() for c in (1, 2, 3, 4)), strict=True)
            for row, (rest, rank, fulls, ids) in enumerate(numbers):
                size, wide = len(ids) // width, np.frombuffer(ids, type_).astype("<u4").tobytes()
                for start, length, sequence, offset in pieces(rest, rank, fulls, size):
                    at.append(row)
                    out.append((start, length, size, sequence, offset))
                    parts.append(wide[4 * start:4 * (start + length)])
            made = np.array(out, "i8").reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), pa.array(made[:, 0]), pa.array(made[:, 1]), pa.array(parts, pa.binary()),
                 pa.array(made[:, 2]), pa.array(made[:, 3]), pa.array(made[:, 4])], names=schema.names)

    return ranked.mapInArrow(run, schema)


def op11_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pack(read(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path(VOCABULARY))
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
