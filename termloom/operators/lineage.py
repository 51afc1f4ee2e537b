"""Which files a job made, which it consumed, and who does what next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active_files(made: DataFrame, consumed: DataFrame) -> DataFrame:
    """Files of ``made`` that no row of ``consumed`` (file_id) names."""
    return made.join(consumed.select("file_id").distinct(), "file_id", "left_anti")


def orphan_acks(made: DataFrame, consumed: DataFrame) -> DataFrame:
    """Rows of ``consumed`` whose file was never made."""
    return consumed.join(made.select("file_id").distinct(), "file_id", "left_anti")


def pending(works: DataFrame, tags: DataFrame) -> DataFrame:
    """The works whose tag is asked for."""
    return works.join(tags.select("tag").distinct(), "tag", "left_semi")


def files_by_shard(*lists: DataFrame) -> DataFrame:
    """(shard, n_files, bytes, file_ids ascending) over all lists of (shard, file_id, bytes)."""
    rows = lists[0]
    for x in lists[1:]:
        rows = rows.unionByName(x)
    return rows.groupBy("shard").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"), F.array_sort(F.collect_list("file_id")).alias("file_ids"))


def numbered(df: DataFrame, order: list[Column | str], name: str = "n", start: int = 0) -> DataFrame:
    """Consecutive numbers in the given order, without bringing all rows into one task.

    Rows are range-sorted; the size of each partition goes through the driver and shifts its numbers.
    """
    spark = df.sparkSession
    cols = df.columns
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i"))
    ordered = ordered.withColumn("_k", F.col("_i") - F.shiftleft(F.col("_p").cast("long"), 33)).persist()
    sizes = {r["_p"]: r["n"] for r in ordered.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    shift, rows = start, []
    for p in sorted(sizes):
        rows.append((p, shift))
        shift += sizes[p]
    before = spark.createDataFrame(rows, "_p int, _s long")
    return ordered.join(F.broadcast(before), "_p").select(*cols, (F.col("_k") + F.col("_s")).alias(name))


def round_robin(df: DataFrame, order: list[str], n: int, name: str = "owner") -> DataFrame:
    """Row i in the order goes to owner i mod n."""
    return numbered(df, order, "_n").withColumn(name, F.pmod("_n", F.lit(n)).cast("int")).drop("_n")


def reassigned(files: DataFrame, dead: DataFrame, heir: str) -> DataFrame:
    """The files of dead owners (nick) go to ``heir``; others keep theirs."""
    gone = dead.select("nick").distinct().withColumn("_gone", F.lit(True))
    return files.join(gone, "nick", "left").withColumn("nick", F.when(F.col("_gone"), F.lit(heir)).otherwise(F.col("nick"))).drop("_gone")


def first_files(files: DataFrame, most: int) -> DataFrame:
    """Of each shard the ``most`` files of least id: a reduce step's fan-in."""
    w = Window.partitionBy("shard").orderBy("file_id")
    return files.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def result_files(index_path: str, spark) -> DataFrame:
    """(shard, file, bytes) of the files of an index that is written by shard. Only footers are read."""
    rows = spark.read.parquet(index_path).select("shard", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return rows.groupBy("shard", "file").agg(F.max("bytes").alias("bytes"))
