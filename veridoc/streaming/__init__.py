"""Documents as they arrive: tokens and authorship need no state, so a stream is scored batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import authorship, terms


def watch_parquet(spark: SparkSession, folder: str, schema: str = "doc_id long, text string", files_per_batch: int = 100) -> DataFrame:
    """New files of a folder of (doc_id, text)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def score_stream(arriving: DataFrame, path: str, checkpoint: str, model: authorship.Model, threshold: float = 50.0):
    """Writes the authorship scores of each batch in a folder of its own, so a batch that is run again after a
    failure replaces what it wrote."""

    def each(batch: DataFrame, number: int) -> None:
        scored = authorship.authorship_scores(batch, terms.tokenized(batch), model, threshold)
        scored.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arriving.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
