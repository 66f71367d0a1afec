"""Shares of terms by source and language."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tests.llm.cases import odd_rows, prose, table
from tieout.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _brute(rows, min_docs, top):
    """(lang, source, part, item, value, rank) by dense loops."""
    docs = [(lang or "", source or "", Counter(TERM.findall((text or "").translate(LOWER)))) for text, lang, source in rows]
    seen, counts, every = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, found in docs:
        every[lang].add(source)
        seen[lang].update(found.keys())
        counts[lang, source].update(found)
        counts[lang, None].update(found)
    out = []
    for lang, sources in every.items():
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        p = {}
        for source in [*sources, None]:
            total = sum(counts[lang, source][t] for t in kept) + len(kept)
            p[source] = {t: 1 + 10**9 * (counts[lang, source][t] + 1) // total for t in kept}
        for source in sources:
            def gap(t, other, own=p[source]):
                return (own[t] - p[other][t]) ** 2 // p[other][t]
            pairs = [(o, sum(gap(t, o) for t in kept)) for o in sources if o != source]
            terms = [(t, gap(t, None)) for t in kept if counts[lang, source][t] and p[source][t] > p[None][t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def _got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_sources_and_terms_equal_dense_loops(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BUCKET_ROWS", 40)
    monkeypatch.setattr(divergence, "BLOCK", 100)
    rows = []
    for k in range(120):
        lang, source = ("en", "de", None)[k % 3], ("big", "big", "a", "B", None, "é")[k * 7 % 6]
        rows.append((prose(k % 40, 30 + k, kinds=60 + 10 * (k % 3)), lang, source))
    rows += [(None, "en", "silent"), ("", "xx", "only"), ("!!", "xx", "other"), ("İstanbul ﬀ x_y Z9z naïve\u0000q", "en", "a")] * 2
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert _got(divergence.divergence(docs, min_docs=3, top=7)) == _brute(rows, 3, 7)
    # no term is kept: pairs remain and are 0
    few = _got(divergence.divergence(docs, min_docs=10_000))
    assert few == _brute(rows, 10_000, 200) and {(r[2], r[4]) for r in few} == {("pair", 0)}


def test_odd_rows_and_empty_tables(spark):
    docs = table(spark, odd_rows()).withColumn("term", F.lit(1)).withColumn("rank", F.lit("x")).withColumn(
        "source", F.when(F.col("doc_id") % 2 == 0, "even"))
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert _got(divergence.divergence(docs, min_docs=2)) == _brute(rows, 2, 200)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_terms_are_cut_anywhere_alike(monkeypatch):
    text = ("Straße, don't STOP—x1y " * 50).encode()
    whole = divergence.counted(text)
    monkeypatch.setattr(divergence, "BLOCK", 3)
    assert divergence.counted(text) == whole == Counter(t.encode() for t in TERM.findall(text.decode().translate(LOWER)))
