"""Byte-level BPE with the tiktoken library and a local rank file.

Every match of the pre-splitting pattern is encoded separately, without special tokens. A long
text is cut only where a non-space is followed by white space: no match of the pattern crosses
such a place and none looks back, so the ids are those of the uncut text. A stretch without such
a place that is still too long is cut into the pattern's matches and each is encoded alone.

Defined results: a null or empty text has no ids and the digests of no bytes; repeated rows give
repeated rows; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from .common import map_texts, read

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
# Characters handed to the library at once.
PIECE_CHARS = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """Cut at safe places: a piece starts with white space that follows a non-space."""
    start, safe = 0, re.compile(r"(?<=\S)(?=\s)")
    while len(text) - start > limit:
        cut = safe.search(text, start + limit)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


class Codec:
    """Encoder and decoder of one task, made from the bytes of a rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = PIECE_CHARS):
        import regex
        import tiktoken

        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.matches, self.limit = regex.compile(pattern), limit

    def encode(self, text: str) -> np.ndarray:
        parts = []
        for piece in pieces(text, self.limit):
            if len(piece) <= 2 * self.limit:
                parts.append(np.asarray(self.library.encode_ordinary(piece), "<u4"))
            else:  # no white space for a long way: match by match
                for match in self.matches.finditer(piece):
                    parts.append(np.asarray(self.library._encode_single_piece(match[0].encode()), "<u4"))
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return self.library.decode_bytes(ids.tolist())


def rank_bytes(path: str) -> bytes:
    """The file travels with the task; rank files are of fixed size, about a megabyte."""
    with open(path, "rb") as file:
        return file.read()


def codec_from(data: bytes, pattern: str) -> Codec:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
    return Codec(ranks, pattern)


def encode(text: Column, rank_file: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Token ids of each text as an array column; null for null."""
    data = rank_bytes(rank_file)
    held: dict[str, Codec] = {}

    @F.pandas_udf(ArrayType(IntegerType()))
    def ids(texts):
        codec = held.setdefault("codec", held.get("codec") or codec_from(data, pattern))
        return texts.map(lambda t: None if t is None else codec.encode(t).astype("i4"))

    return ids(text)


def decode(ids: Column, rank_file: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The raw bytes of token ids; they need not be valid UTF-8. Null for null."""
    data = rank_bytes(rank_file)
    held: dict[str, Codec] = {}

    @F.pandas_udf(BinaryType())
    def raw(rows):
        codec = held.setdefault("codec", held.get("codec") or codec_from(data, pattern))
        return rows.map(lambda r: None if r is None else codec.decode(np.asarray(r)))

    return raw(ids)


def round_trip(docs: DataFrame, keys: list[str], text: str, rank_file: str,
               pattern: str = public_tokenizers.PATTERN, ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids, and digest both; with `ids`, return the ids too."""
    data = rank_bytes(rank_file)

    def start() -> Callable:
        codec = codec_from(data, pattern)

        def work(texts: list[str]) -> list:
            counts, sums, backs, kept = [], [], [], []
            for one in texts:
                tokens = codec.encode(one)
                counts.append(len(tokens))
                sums.append(hashlib.sha256(tokens.tobytes()).hexdigest())
                backs.append(hashlib.sha256(codec.decode(tokens)).hexdigest())
                if ids:
                    kept.append(tokens.astype("i4"))
            return [np.array(counts, "i8"), sums, backs, *([kept] if ids else [])]
        return work

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    return map_texts(docs, keys, text, schema, start)


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"), ["doc_id"], "text", public_tokenizers.path(RANK_FILE))
