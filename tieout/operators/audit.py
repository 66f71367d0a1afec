"""Audits of written answers against the data they were given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tieout.functions.grounding import (
    json_numbers, prose_numbers, restatements, tolerance_interval, value_bucket)
from tieout.session import materialize

MAX_CITATIONS = 12
# Large answers whose ids may be broadcast; more are joined by shuffles.
BROADCAST_ANSWERS = 100_000


# Letters of an answer times those of its payloads whose numbers are compared in one row; answers with more go by buckets.
LETTERS_IN_ROW, PAIRS_IN_ROW = 1_000, 10_000_000


def answer_grounding(answers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Per answer: numbers stated, numbers no payload explains, grounded or not.

    `answers` is (answer_id, text), `payloads` is (answer_id, payload) with one or
    more JSON documents each. A stated number is explained by a payload number, that
    number times or over 100, within a small absolute or relative tolerance. An answer's
    numbers meet in one row and are compared there. Answers with too much text for that
    are found first and compared by buckets, spread over many tasks; both ways are exact.
    """
    kept = F.col("answer_id").isNotNull()
    lengths = answers.select("answer_id", F.length("text").alias("s"), F.lit(0).alias("k")).unionByName(
        payloads.select("answer_id", F.lit(0).alias("s"), F.length("payload").alias("k")))
    lengths = lengths.filter(kept).groupBy("answer_id").agg(
        *[F.greatest(F.sum(c), F.lit(LETTERS_IN_ROW)).cast("double").alias(c) for c in ("s", "k")])
    large = materialize(lengths.filter(F.col("s") * F.col("k") > PAIRS_IN_ROW).select("answer_id"), "large_answers")
    none = F.array().cast("array<double>")
    rows = answers.select("answer_id", F.array_distinct(prose_numbers(F.col("text"))).alias("stated"), none.alias("known"))
    rows = rows.unionByName(payloads.select(
        "answer_id", none.alias("stated"), F.array_distinct(json_numbers(F.col("payload"))).alias("known"))).filter(kept)
    few = large.hint("broadcast") if large.count() <= BROADCAST_ANSWERS else large
    per_answer = _compared_in_rows(rows.join(few, "answer_id", "left_anti")).unionByName(
        _compared_by_buckets(rows.join(few, "answer_id", "left_semi")))
    return answers.select("answer_id").join(per_answer, "answer_id", "left").select(
        "answer_id", F.coalesce("numbers", F.lit(0)).alias("numbers"),
        F.coalesce("unexplained", F.lit(0)).alias("unexplained"),
        (F.coalesce("unexplained", F.lit(0)) == 0).alias("grounded"))


def _compared_in_rows(rows: DataFrame) -> DataFrame:
    """(answer_id, numbers, unexplained) of answers whose numbers fit into a row."""
    def explained(number: Column) -> Column:
        low, high = tolerance_interval(number)
        return F.exists("values", lambda v: (v > low) & (v < high))

    met = rows.groupBy("answer_id").agg(
        F.array_distinct(F.flatten(F.collect_list("stated"))).alias("stated"),
        F.array_distinct(F.flatten(F.collect_list("known"))).alias("known"))
    met = met.filter(F.size("stated") > 0).select("answer_id", "stated", F.flatten(F.transform("known", restatements)).alias("values"))
    return met.select("answer_id", F.size("stated").cast("long").alias("numbers"),
                      F.size(F.filter("stated", lambda n: ~explained(n))).cast("long").alias("unexplained"))


def _compared_by_buckets(rows: DataFrame) -> DataFrame:
    """The same of answers with any number of numbers.

    Known numbers are reduced to the least and greatest per bucket; buckets are narrower
    than any tolerance interval, so looking into the few buckets an interval touches
    decides the question without pairing every number with every other.
    """
    stated = rows.select("answer_id", F.explode("stated").alias("number")).distinct()
    known = rows.select("answer_id", F.explode("known").alias("number")).distinct()
    known = known.select("answer_id", F.explode(restatements(F.col("number"))).alias("value"))
    buckets = known.groupBy("answer_id", value_bucket(F.col("value")).alias("bucket")).agg(
        F.min("value").alias("least"), F.max("value").alias("greatest"))
    low, high = tolerance_interval(F.col("number"))
    probes = stated.select("answer_id", "number", low.alias("low"), high.alias("high"))
    probes = probes.select("*", F.explode(F.sequence(value_bucket(F.col("low")), value_bucket(F.col("high"))))
                           .alias("bucket"))
    hits = probes.join(buckets, ["answer_id", "bucket"], "left")
    explained = F.coalesce((F.col("greatest") > F.col("low")) & (F.col("least") < F.col("high")), F.lit(False))
    per_number = hits.groupBy("answer_id", "number").agg(F.bool_or(explained).alias("explained"))
    return per_number.groupBy("answer_id").agg(
        F.count("*").alias("numbers"), F.count_if(~F.col("explained")).alias("unexplained"))


def citations(answers: DataFrame, known_ids: DataFrame) -> DataFrame:
    """Ids from the payloads that an answer mentions, by position, the first twelve, and how many in all.

    `known_ids` is (answer_id, kind, id, seen): the ids returned to that answer in the order `seen`; an
    id has the record kind with which it was seen last.
    """
    known = known_ids.filter(F.length("id") > 3).groupBy("answer_id", "id").agg(F.max_by("kind", "seen").alias("kind"))
    at = F.instr(F.col("text"), F.col("id"))
    cited = known.join(answers.select("answer_id", "text"), "answer_id").withColumn("at", at).filter("at > 0")
    order = Window.partitionBy("answer_id").orderBy("at", "id")
    every = Window.partitionBy("answer_id")
    return (cited.select("answer_id", "kind", "id", "at").withColumn("position", F.row_number().over(order))
            .withColumn("total", F.count("*").over(every)).filter(F.col("position") <= MAX_CITATIONS).drop("at"))
