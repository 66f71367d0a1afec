"""Log-probabilities of texts under a weighted backoff automaton over n-grams.

The model learns the counts of all n-grams of the training texts. A context seen in training is a
state; from state h an arc for word w exists if hw was seen and weighs
    log10((c(hw) + K * p(w | shorter)) / (c(h) + K)),
the failure arc weighs log10(K / (c(h) + K)) and leads to the state of the shorter context; the
empty context gives every word its smoothed share. These weights sum to one in every state. A text
is read once from left to right, starting in the state of the text's beginning. The state after a
word is the longest seen run of last words, so all of a chunk's steps are taken at once on arrays.

Counts cover all training texts, and none is dropped. They are never gathered in one place: chunks
of documents ask the buckets that own the n-grams (see `chunks`), and score with the answers.

Words are compared by 64-bit hashes. Defined results: a null or empty text has one token, the end;
without training texts N and V are 0 and every token has the base probability 1; rows without an id
count as the empty id; repeated rows train and score as often as they occur; an empty table gives an
empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import bucket_of, buckets_for, deal, mixed, squeezed, text_bytes, unsqueezed
from .common import fold, read

ORDER, PRIOR, SMOOTH = 2, 4.0, 0.1
# Reserved hashes of the marks before and after a text.
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
# A bound on bytes per token, only to choose the number of buckets.
TOKEN_BYTES = 6


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, each text closed by the end mark; and the ends of the texts."""
    import xxhash

    known: dict[bytes, int] = {}
    digest, parts, ends = xxhash.xxh64_intdigest, [], []
    size = 0
    for text in texts:
        words = (text or "").encode().lower().split()
        try:
            found = [known[w] for w in words]
        except KeyError:
            for word in words:
                if word not in known:
                    known[word] = digest(word)
            found = [known[w] for w in words]
        found.append(int(END))
        parts.append(np.array(found, "u8"))
        size += len(found)
        ends.append(size)
    return (np.concatenate(parts) if parts else np.zeros(0, "u8")), np.array(ends, "i8")


def grams(tokens: np.ndarray, ends: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the n-grams that end at each token, for n = 1 to order; beginnings are padded."""
    starts = np.concatenate([[0], ends[:-1]]).astype("i8")
    place = np.arange(len(tokens)) - np.repeat(starts, ends - starts)
    out, previous = [mixed(tokens)], tokens
    for n in range(2, order + 1):
        earlier = np.full(len(tokens), BEGIN)
        earlier[n - 1:] = tokens[:len(tokens) - n + 1]
        earlier[place < n - 1] = BEGIN
        previous = mixed(previous + mixed(earlier + np.uint64(n)))
        out.append(previous)
    return out


def contexts(tokens: np.ndarray, ends: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the contexts of each token, for n = 2 to order: the (n-1)-gram that ends before it.

    A context that reaches before the text counts the beginnings, under a key of its own.
    """
    starts = np.concatenate([[0], ends[:-1]]).astype("i8")
    place = np.arange(len(tokens)) - np.repeat(starts, ends - starts)
    before, out = grams(tokens, ends, order - 1) if order > 1 else [], []
    for n in range(2, order + 1):
        key = np.roll(before[n - 2], 1)
        key[place == 0] = mixed(np.array([BEGIN + np.uint64(n)]))[0]
        out.append(key)
    return out


def _ask(table: pa.Table, order: int, buckets: int) -> pa.Table:
    """A chunk's distinct keys and their counts in its training texts, by bucket."""
    tokens, ends = token_hashes(table.column("text").to_pylist())
    sizes = np.diff(np.concatenate([[0], ends]))
    trains = np.repeat(table.column("train").to_numpy(zero_copy_only=False).astype(bool), sizes)
    keys = np.concatenate([*grams(tokens, ends, order), *_beginnings(ends, order)])
    weights = np.concatenate([*[trains] * order, *[trains[ends - 1]] * (order - 1)])
    distinct, count = _totals(keys, weights)
    return _rows(table.column("chunk")[0].as_py(), distinct, count, buckets)


def _beginnings(ends: np.ndarray, order: int) -> list[np.ndarray]:
    return [np.full(len(ends), mixed(np.array([BEGIN + np.uint64(n)]))[0]) for n in range(2, order + 1)]


def _totals(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in rising order and the sums of their weights."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, "i8")
    return keys[first], np.add.reduceat(weights[order].astype("i8"), first) if len(keys) else np.zeros(0, "i8")


def _rows(chunk: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    """Keys rise, and so do their buckets: one row for each bucket that is asked."""
    which, first = np.unique(bucket_of(keys, buckets), return_index=True)
    ends = np.concatenate([first[1:], [len(keys)]])
    return pa.table({
        "chunk": pa.array(np.full(len(which), chunk, "i4")), "bucket": pa.array(which.astype("i4")),
        "keys": pa.array([squeezed(keys[a:b], rising=True) for a, b in zip(first, ends, strict=False)], pa.binary()),
        "counts": pa.array([squeezed(counts[a:b]) for a, b in zip(first, ends, strict=False)], pa.binary())})


def _answer(table: pa.Table) -> pa.Table:
    """A bucket's totals, sent back in the order in which each chunk asked."""
    keys = [unsqueezed(k, rising=True) for k in table.column("keys").to_pylist()]
    counts = np.concatenate([unsqueezed(c) for c in table.column("counts").to_pylist()])
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), "u8")
    np.add.at(total, place, counts)
    answers = np.split(total[place], np.cumsum([len(k) for k in keys])[:-1])
    return pa.table({"chunk": table.column("chunk").combine_chunks(), "bucket": table.column("bucket").combine_chunks(),
                     "totals": pa.array([squeezed(a) for a in answers], pa.binary())})


def _score(docs: pa.Table, answers: pa.Table, order: int, prior: float, train_tokens: int, kinds: int) -> pa.Table:
    if not docs.num_rows:
        return pa.table({"doc_id": docs.column("doc_id"), "train": docs.column("train"), "n_tokens": pa.array([], pa.int64()),
                         "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()),
                         "score": pa.array([], pa.float64())})
    tokens, ends = token_hashes(docs.column("text").to_pylist())
    runs, before = grams(tokens, ends, order), contexts(tokens, ends, order)
    distinct = np.unique(np.concatenate([*runs, *_beginnings(ends, order)]))
    # keys rise with their buckets
    totals = np.concatenate([unsqueezed(t) for t in answers.sort_by("bucket").column("totals").to_pylist()]).view("i8")
    counts = [totals[np.searchsorted(distinct, keys)] for keys in runs]
    one = counts[0].astype("f8")
    share = (one + SMOOTH) / (train_tokens + SMOOTH * (kinds + 1))
    p = share
    for n in range(2, order + 1):
        # where neither the n-gram nor the context was seen, the failure arc leaves p as it is
        held = totals[np.searchsorted(distinct, before[n - 2])].astype("f8")
        p = (counts[n - 1] + prior * p) / (held + prior)
    starts = np.concatenate([[0], ends[:-1]])
    return pa.table({
        "doc_id": docs.column("doc_id").combine_chunks(), "train": docs.column("train").combine_chunks(),
        "n_tokens": pa.array(ends - starts), "n_known": pa.array(np.add.reduceat((one > 0).astype("i8"), starts)),
        "base_score": pa.array(np.add.reduceat(np.log10(share), starts)),
        "score": pa.array(np.add.reduceat(np.log10(p), starts))})


def vocabulary(docs: DataFrame, total: int) -> tuple[int, int]:
    """(tokens, distinct tokens) of the training texts: columns text and train."""
    buckets = buckets_for(total / TOKEN_BYTES / 4)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = [t for t, train in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if train]
            tokens, _ = token_hashes(chosen)
            if len(tokens):
                distinct = np.unique(mixed(tokens))
                asked = _rows(0, distinct, np.zeros(len(distinct)), buckets)
                said = pa.array([len(tokens)] + [0] * (asked.num_rows - 1), pa.int64())
                yield from asked.append_column("tokens", said).select(["bucket", "keys", "tokens"]).to_batches()

    def count(table: pa.Table) -> pa.Table:
        return pa.table({"kinds": [len(np.unique(np.concatenate([unsqueezed(k, rising=True) for k in table.column("keys").to_pylist()])))],
                         "tokens": [sum(table.column("tokens").to_pylist())]})

    asked = docs.select("text", "train").mapInArrow(words, "bucket int, keys binary, tokens bigint")
    found = asked.groupBy("bucket").applyInArrow(count, "kinds bigint, tokens bigint").agg(
        F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    return found[0], found[1]


def score(docs: DataFrame, key: str, text: str, train: F.Column, order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """(key, train, n_tokens, n_known, train_tokens, base_score, score) of every whole text."""
    marked = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), train.alias("train"))
    total = text_bytes(marked, "text")
    train_tokens, kinds = vocabulary(marked, total)
    dealt = deal(marked, ["doc_id", "text", "train"], total)
    buckets = buckets_for(order * total / TOKEN_BYTES)
    id_type = marked.schema["doc_id"].dataType.simpleString()
    asked = dealt.groupBy("chunk").applyInArrow(
        lambda t: _ask(t, order, buckets), "chunk int, bucket int, keys binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(_answer, "chunk int, bucket int, totals binary")
    scored = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        lambda d, a: _score(d, a, order, prior, train_tokens, kinds),
        f"doc_id {id_type}, train boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select(F.col("doc_id").alias(key), "train", "n_tokens", "n_known",
                         F.lit(train_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, "doc_id", "text", fold("doc_id", 10) != 0)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")
