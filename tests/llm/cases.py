"""Small document tables that every operator must take."""

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, size int, a string, start int"


def table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Documents from (doc_id, text) with null labels and columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, None, None, None, 0.5, 7, "x", 3) for i, t in rows], SCHEMA)


def prose(seed: int, words: int, kinds: int = 300) -> str:
    rng = random.Random(seed)
    syllables = ["ba", "ko", "ri", "tu", "len", "sa", "mor", "vi", "den", "ta"]
    lexicon = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(kinds)]
    out = []
    while len(out) < words:
        sentence = rng.choices(lexicon, k=rng.randint(5, 14))
        out += [sentence[0].capitalize(), *sentence[1:-1], sentence[-1] + "."]
    return " ".join(out[:words])


def odd_rows() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows and no id."""
    long = prose(1, 30_000)
    return [(1, None), (2, ""), (3, "   \n\t "), (4, "!!! 123 ???"), (5, long), (6, long[:-20] + " end"), (7, prose(2, 80)),
            (8, prose(2, 80)), (8, prose(2, 80)), (None, prose(2, 80)), (None, None), (9, "x" * 50_000),
            (10, "ÄÖ ß   naïve 漢字 🙂 " * 20), (-3, prose(3, 60)), (11, "one"), (12, "one")]
