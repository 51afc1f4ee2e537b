"""Counters and throughput of a job from its acknowledgements (nick, ts, files, bytes, seconds)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import values as V


def totals(acks: DataFrame, *by: str) -> DataFrame:
    return acks.groupBy(*by).agg(F.count("*").alias("n_acks"), F.sum("bytes").alias("bytes"), F.sum("seconds").alias("seconds"))


def throughput(acks: DataFrame, *by: str) -> DataFrame:
    """Mean MiB/s; null without time."""
    return totals(acks, *by).withColumn("mib_s", V.mib_per_second(F.col("bytes"), F.col("seconds")))


def running_total(acks: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The running sum of bytes of each ``by``, only where it changes."""
    w = Window.partitionBy(by).orderBy(*order)
    run = acks.withColumn("total", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where("total <> coalesce(total - bytes, 0) or total is null").where("bytes <> 0")


def job_status(tracker) -> dict:
    """Active stages and tasks of the session's StatusTracker."""
    stages = [tracker.getStageInfo(i) for i in tracker.getActiveStageIds()]
    return {"jobs": list(tracker.getActiveJobsIds()), "stages": [{"id": s.stageId, "name": s.name, "tasks": s.numTasks, "done": s.numCompletedTasks, "failed": s.numFailedTasks} for s in stages if s]}
