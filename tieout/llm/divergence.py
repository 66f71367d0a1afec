"""Which sources of a language speak apart from each other, and by which terms.

A translate table lowers A-Z and blanks every other ASCII character in one pass; splitting gives the
terms (ASCII letters and everything beyond ASCII), and one Counter per document gives the term's
frequencies and marks the document once for each of its terms. A task adds its documents' Counters
up by (lang, source) and emits rows, so a source that holds a third of all documents arrives as
one row per term from each task.

A language keeps the terms of at least `min_docs` documents. With V kept terms and N occurrences of
them in a group (a source of the language, or the whole language), a term's share is
    p = 1 + floor(SCALE * (count + 1) / (N + V)),
and two groups differ in it by floor((p - q)^2 / q). All of it is whole numbers. Most counts are zero, and a zero has
the same share p0 for all terms of a group, so a sum over all V terms is worked out from the rows that
exist: terms of neither group count V - |a| - |b| times, terms of one group by a histogram of their counts, and
terms of both correct what the histograms counted for them. Buckets of terms add the corrections up for
every two sources before anything is shuffled.

Defined results: null text, language and source are empty strings, which are a language and a source like any
other; documents without terms still make their group; a group without kept terms has value 0 in all
pairs if its language keeps none; repeated rows count as often as they occur; ties of value are ranked
by the item's UTF-8 bytes; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, store

MIN_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
# Terms that a task adds up before it emits them, bytes split at once, rows of a bucket of terms.
HELD, BLOCK, BUCKET_ROWS = 200_000, 1 << 20, 20_000

LETTERS = bytes(range(ord("a"), ord("z") + 1))
TABLE = bytes(
    code if code >= 0x80 or code in LETTERS else code + 32 if code + 32 in LETTERS and code < 0x5B else 0x20
    for code in range(256))


def counted(text: bytes) -> Counter:
    """The terms of a text and how often each occurs."""
    plain = text.translate(TABLE)
    found, start = Counter(), 0
    while start < len(plain):
        end = plain.find(b" ", start + BLOCK)
        end = len(plain) if end < 0 else end
        found.update(plain[start:end].split())
        start = end
    return found


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, docs), added up over many documents."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def emitted() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in held.items():
            if times:
                terms = pa.array(list(times), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(times), pa.string()), pa.array([source] * len(times), pa.string()), terms,
                     pa.array(list(times.values()), pa.int64()), pa.array([docs[t] for t in times], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        langs, sources = (batch.column(i).to_pylist() for i in (0, 1))
        for lang, source, text in zip(langs, sources, batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            found = counted(text)
            times, docs = held.setdefault((lang, source), (Counter(), Counter()))
            times.update(found)
            docs.update(found.keys())
        if sum(len(times) for times, _ in held.values()) > HELD:
            yield from emitted()
    yield from emitted()


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of the terms that a language keeps; columns lang, source, text.

    `lang_n` is the term's count in the language, and one row of each of its terms is `first`.
    """
    rows = docs.select("lang", "source", "text").mapInArrow(
        _tally, "lang string, source string, term string, n bigint, docs bigint")
    # one exchange serves both sums, as rows of a term lie together
    sums = (rows.repartition("lang", "term").groupBy("lang", "term", "source")
            .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    term = Window.partitionBy("lang", "term")
    return (sums.withColumn("lang_docs", F.sum("docs").over(term)).withColumn("lang_n", F.sum("n").over(term))
            .withColumn("first", F.row_number().over(term.orderBy("source")) == 1)
            .where(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", "first"))


def share(count: str, total: str) -> Column:
    """1 + floor(SCALE * (count + 1) / total); null if the total is 0."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + 1 AS DECIMAL(20,0))) "
                  f"div CAST(nullif({total}, 0) AS DECIMAL(20,0))")


def apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _both(table: pa.Table) -> pa.Table:
    """For every two sources, what terms that both have add to the sum beyond the histograms.

    A bucket's rows (source, term, p, p0) are taken source by source: its terms' rows of all sources.
    """
    table = table.combine_chunks()
    lang = table.column("lang")[0]
    coded = table.column("source").combine_chunks().dictionary_encode()
    source, names = coded.indices.to_numpy(zero_copy_only=False).astype("i8"), coded.dictionary
    term = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    order = np.argsort(term, kind="stable")
    term, source = term[order], source[order]
    p, zero = (table.column(c).to_numpy()[order] for c in ("p", "p0"))
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    size = np.diff(np.concatenate([first, [len(term)]]))
    by_source = np.argsort(source, kind="stable")
    ends = np.cumsum(np.bincount(source, minlength=len(names)))
    out: list[tuple[np.ndarray, ...]] = []
    for a, end in enumerate(ends):
        mine = by_source[ends[a - 1] if a else 0:end]
        many = size[term[mine]]
        own = np.repeat(mine, many)
        other = np.repeat(first[term[mine]] - np.cumsum(many) + many, many) + np.arange(many.sum())
        value = sum(sign * ((x - y) * (x - y) // y) for sign, x, y in (
            (1, p[own], p[other]), (-1, p[own], zero[other]), (-1, zero[own], p[other]), (1, zero[own], zero[other])))
        sums, met = np.zeros(len(names), "i8"), np.zeros(len(names), bool)
        np.add.at(sums, source[other], value)
        met[source[other]] = True
        met[a] = False
        item = np.flatnonzero(met)
        out.append((np.full(len(item), a), item, sums[item]))
    a, b, value = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table({"lang": pa.array([lang.as_py()] * len(a), pa.string()), "source": names.take(pa.array(a)),
                     "item": names.take(pa.array(b)), "value": pa.array(value, pa.int64())})


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
               min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): see the module's text.

    Part `pair` compares a source with every other one of its language, part `term` names the `top` terms that it has
    more of than its language.
    """
    def named(c: str, name: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)

    docs = docs.select(named(lang, "lang"), named(source, "source"), named(text, "text"))
    kept = store(kept_terms(docs, min_docs), "terms")
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("kinds"), F.sum("n").alias("lang_total"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_total"), F.count("*").alias("own_kinds"))
    groups = (docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
              .na.fill(0).withColumn("p0", F.coalesce(share("0L", "own_total + kinds"), F.lit(1).cast("bigint"))))
    groups = store(groups, "sources")

    shares = kept.join(groups, ["lang", "source"]).withColumn("p", share("n", "own_total + kinds"))
    terms = (shares.withColumn("q", share("lang_n", "lang_total + kinds")).where("p > q")
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart("p", "q").alias("value")))

    buckets = max(1, math.ceil(kept.count() / BUCKET_ROWS))
    both = (shares.select("lang", "source", "term", "p", "p0",
                          F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket"))
            .groupBy("lang", "bucket").applyInArrow(_both, "lang string, source string, item string, value bigint"))
    # how many terms of a source have each share
    levels = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("times"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("own_kinds").alias("item_kinds"))
    met = levels.join(others, "lang").where("source <> item")
    ahead = met.select("lang", "source", "item", (F.col("times") * apart("p", "q0")).alias("value"))
    behind = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"),
                        (F.col("times") * apart("q0", "p")).alias("value"))
    neither = (groups.join(others, "lang").where("source <> item")
               .select("lang", "source", "item", ((F.col("kinds") - F.col("own_kinds") - F.col("item_kinds")) * apart("p0", "q0")).alias("value")))
    pairs = (neither.union(ahead).union(behind).union(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    return pairs.select("*", rank).union(terms.select("*", rank).where(F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))
