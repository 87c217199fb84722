"""What the operators share: reading tables, the shared scratch folder, and runs of texts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import clear_scratch, discard, scratch_path, settle

__all__ = ["apart", "by_text_size", "clear_scratch", "discard", "read_table", "scratch_path", "settle"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_text_size(texts: list[str], limit: int) -> Iterator[range]:
    """Runs of neighbouring texts of about `limit` characters together; a longer text is a run of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield range(start, i)
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield range(start, len(texts))


def apart(sums: DataFrame, key: str) -> DataFrame:
    """sums, one row for each value of a long key, under keys that the planner can't take for those it was summed
    by: a join then shuffles both of its sides itself, and only such a join has its hot keys split."""
    return sums.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long")))
