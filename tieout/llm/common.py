"""What several operators share: reading tables, folds, scratch tables and Arrow loops."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import materialize, tune


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str | Column, folds: int) -> Column:
    """crc32 of the key's text, modulo `folds`; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string") if isinstance(key, str) else key, F.lit("")).cast("binary")) % folds


def store(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Cut the lineage with a table in the shared folder."""
    return materialize(df, f"llm-{label}", codec)


def sampled(rows: DataFrame, group: str, key: str, size: int) -> DataFrame:
    """Up to `size` rows (group, key) of each group: those with the lowest hashes of the key.

    Rows far above a group's share are left out before they are ranked, so ranking a group reads
    about three times `size` rows however large the group is.
    """
    counts = rows.groupBy(group).agg(F.count("*").alias("_n"))
    place = F.shiftrightunsigned(F.xxhash64(key), 1) / F.lit(float(1 << 63))
    likely = rows.join(counts, group).where(place * F.col("_n") < 3 * size)
    order = Window.partitionBy(group).orderBy(F.xxhash64(key), key)
    return (likely.select(group, key, F.row_number().over(order).alias("_rank"))
            .where(F.col("_rank") <= size).select(group, key))


def map_texts(docs: DataFrame, keys: list[str], text: str, schema: str, start: Callable[[], Callable]) -> DataFrame:
    """Run a function over every text, Arrow batch by Arrow batch.

    `start()` is called once per task and returns a function from a list of texts (nulls
    are empty texts) to one list or array per column of `schema`; the key columns pass through.
    """
    source = docs.select(*keys, text)
    made = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            if batch.num_rows:
                texts = [t or "" for t in batch.column(len(keys)).to_pylist()]
                out = work(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i) for i in range(len(keys))]
                    + [x if isinstance(x, pa.Array) else pa.array(x) for x in out], names=[*keys, *made.names])

    return source.mapInArrow(run, StructType(source.schema.fields[:len(keys)] + made.fields))
