"""Document filtering as a chain of stages; each reads what the one before has written.

Documents that the toxicity classifier rejects go; one document of each group of near copies
(linked by SimHash fingerprints or MinHash bands, Jaccard similarity of five-word shingles at least 0.8) stays; bytes of repeated 50-byte strings
go; documents that hold a benchmark item go; the rest is encoded. All columns of the documents pass
through, and `text` and `n_chars` follow the removals.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.llm import bpe, decontaminate, exactdup, nearcopies, toxicity
from tieout.llm.common import read, store

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    rows = docs.select(F.struct("*").alias("doc"), "text")
    return toxicity.score(rows, ["doc"], "text", model).where("predicted = 0").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.one_of_each(docs, "doc_id", "text")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = exactdup.remove_repeats(docs, "doc_id", "text")
    made = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    return done.select(*[(made[c] if c in made else F.col("row")[c]).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(docs, "doc_id", "text", read(spark, sf_dir, "benchmark"), "item_id", "text")
    found = found.select(F.col("doc_id").alias("id"), "version").distinct()
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("own"), F.xxhash64("text").alias("hash"))
    same = rows["own"].eqNullSafe(found["id"]) & (rows["hash"] == found["version"])
    return rows.join(found, same, "left_anti").select("doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(F.struct("*").alias("doc"), "text")
    done = bpe.round_trip(rows, ["doc"], "text", public_tokenizers.path(bpe.RANK_FILE), ids=True)
    return done.select("doc.*", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("simhash", drop_near_copies), ("suffix_array", cut_repeats),
    ("decontamination", drop_contaminated), ("bpe", encode),
]
# Learned weights and connected components have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
