"""Ask every document's keys of the whole corpus, and bring the answers back.

Documents are dealt by a hash of the row into chunks of a few megabytes. A chunk works out its
distinct keys and sends them, packed into arrays, to the bucket that owns each key; a bucket sees
every chunk's mention of its keys, and sends each chunk an array of answers in the order asked.
Both moves are Spark shuffles. A key that a third of all documents share arrives once from each
chunk, so no bucket grows with its number of holders, and packing never makes more rows than keys.

The numbers of chunks and buckets follow the size of the input, so that a group stays at a few
megabytes whatever the size; they don't change any result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
BUCKET_KEYS = 1 << 20


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def deal(docs: DataFrame, columns: list[str], total: int, size: int = CHUNK_BYTES) -> DataFrame:
    """Each row's chunk, by a hash of the named columns, and all columns."""
    chunks = max(1, math.ceil(total / size))
    return docs.select(F.pmod(F.xxhash64(*columns), F.lit(chunks)).cast("int").alias("chunk"), "*")


def buckets_for(keys: float) -> int:
    return max(8, math.ceil(keys / BUCKET_KEYS))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    values = values.astype("u8", copy=True)
    values ^= values >> np.uint64(30)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype("i8")


def packed(flat: np.ndarray | pa.Array, ends: np.ndarray) -> pa.Array:
    """A list column from flat values and the ends of the lists."""
    values = flat if isinstance(flat, pa.Array) else pa.array(flat)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)


def squeezed(values: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers of 64 bits by byte planes, without empty upper planes; `rising` ones as steps.

    Shuffle compression finds runs of equal bytes this way, which it can't in whole numbers.
    """
    values = values.view("u8") if values.dtype.itemsize == 8 else values.astype("u8")
    if rising and len(values):
        values = np.concatenate([values[:1], values[1:] - values[:-1]])
    planes = values.astype("<u8").view("u1").reshape(-1, 8).T
    while len(planes) > 1 and not planes[-1].any():
        planes = planes[:-1]
    return bytes([len(planes)]) + planes.tobytes()


def unsqueezed(blob: bytes, rising: bool = False) -> np.ndarray:
    count = blob[0]
    planes = np.frombuffer(blob, "u1", offset=1).reshape(count, -1)
    values = np.zeros((planes.shape[1], 8), "u1")
    values[:, :count] = planes.T
    out = values.view("<u8").ravel()
    return np.cumsum(out, dtype="u8") if rising else out


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and how many each list has."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], column.type)
    sizes = np.diff(lists.offsets.to_numpy(zero_copy_only=False)).astype("i8")
    return lists.flatten().to_numpy(zero_copy_only=False), sizes
