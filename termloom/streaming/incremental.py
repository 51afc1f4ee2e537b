"""An index kept up to date from a stream of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from termloom.operators import index


def document_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of (doc_id, text) as they arrive."""
    return spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run(docs: DataFrame, folder: str, shards: int, flush_tail: bool = False, on_map_finished: Callable[[int], None] | None = None) -> None:
    """Every micro-batch's partial index goes to its own folder; ends when the input is used up.

    A batch that is run again after a failure overwrites its own folder, so nothing counts twice.
    ``on_map_finished`` is called on the driver with the number of each batch that is written.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        part = index.of_documents(batch, shards, flush_tail)
        part.write.mode("overwrite").parquet(f"{folder}/partial/batch={batch_id}")
        if on_map_finished:
            on_map_finished(batch_id)

    query = docs.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def merged(spark: SparkSession, folder: str) -> DataFrame:
    """The index of all batches so far."""
    return index.merge(spark.read.parquet(f"{folder}/partial").select("shard", "term", "df", "postings"))


def compact(spark: SparkSession, folder: str, into: str, on_reduce_finished: Callable[[str], None] | None = None) -> DataFrame:
    """The merged index written as one; it may itself be merged again later."""
    index.write(merged(spark, folder), into)
    if on_reduce_finished:
        on_reduce_finished(into)
    return spark.read.parquet(into)
