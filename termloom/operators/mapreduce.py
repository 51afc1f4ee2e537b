"""User extension points: a source, a map function and a re-reducible reduce function."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


class Input(Protocol):
    def input(self) -> Iterator[tuple]: ...


class Mapper(Protocol):
    #: schema of the rows that ``execute`` yields
    schema: str

    def execute(self, batch: pd.DataFrame) -> Iterator[pd.DataFrame]: ...


class Reducer(Protocol):
    schema: str

    def execute(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame: ...


def load(name: str) -> Any:
    """The object that a dotted name, ``package.module.Name``, stands for."""
    module, _, attribute = name.rpartition(".")
    return getattr(importlib.import_module(module), attribute)


def run_map(df: DataFrame, mapper: Mapper) -> DataFrame:
    def run(batches):
        if hasattr(mapper, "setup"):
            mapper.setup()
        for b in batches:
            yield from mapper.execute(b)

    return df.mapInPandas(run, mapper.schema)


def run_reduce(df: DataFrame, key: list[str], reducer: Reducer) -> DataFrame:
    return df.groupBy(*key).applyInPandas(lambda k, rows: reducer.execute(k, rows), reducer.schema)


def run_reduce_twice(df: DataFrame, key: list[str], reducer: Reducer, salt: int = 8) -> DataFrame:
    """Reduce in two levels: a re-reducible function may be applied to parts and to its own results.

    A hot key's rows are dealt over ``salt`` tasks first.
    """
    from pyspark.sql import functions as F

    part = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salt)))
    first = part.groupBy(*key, "_salt").applyInPandas(lambda k, rows: reducer.execute(k[:-1], rows.drop(columns="_salt")), reducer.schema)
    return run_reduce(first, key, reducer)


class Callback(Protocol):
    """Sees the postings of a partition in the order (shard, term, doc_id), then ``finish``."""

    schema: str

    def posting(self, shard: int, term: str, doc_id: int, tf: int) -> Iterator[tuple]: ...

    def finish(self) -> Iterator[tuple]: ...


def run_callback(postings: DataFrame, make: Callable[[], Callback]) -> DataFrame:
    """What callbacks yield for the postings (shard, term, doc_id, tf), one callback for each partition.

    All postings of a (shard, term) are in one partition.
    """
    schema = make().schema

    def run(batches):
        call = make()
        for b in batches:
            rows = [r for x in zip(b["shard"], b["term"], b["doc_id"], b["tf"], strict=True) for r in call.posting(*x)]
            yield pd.DataFrame(rows, columns=names)
        yield pd.DataFrame(list(call.finish()), columns=names)

    names = [x.split()[0] for x in schema.split(",")]
    dealt = postings.select("shard", "term", "doc_id", "tf").repartition("shard", "term").sortWithinPartitions("shard", "term", "doc_id")
    return dealt.mapInPandas(run, schema)


def pipe(df: DataFrame, command: list[str]) -> DataFrame:
    """(line): what an executable prints that gets the first column's values as lines, once a partition.

    A command that ends with an error fails the task.
    """

    def run(batches):
        import subprocess
        import threading

        p = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True)

        def feed():
            with p.stdin:
                for b in batches:
                    p.stdin.writelines(f"{x}\n" for x in b.iloc[:, 0])

        t = threading.Thread(target=feed)
        t.start()
        lines = []
        for line in p.stdout:
            lines.append(line.rstrip("\n"))
            if len(lines) == 10_000:
                yield pd.DataFrame({"line": lines})
                lines = []
        t.join()
        if p.wait():
            raise RuntimeError(f"{command[0]} ended with {p.returncode}")
        yield pd.DataFrame({"line": lines}, dtype="object")

    return df.mapInPandas(run, "line string")


def reported_files(lines: DataFrame) -> DataFrame:
    """(name, shard, bytes) of the lines "=> name shard size"; other lines are left out."""
    from pyspark.sql import functions as F

    part = lambda k: F.regexp_extract("line", "^=> (\\S+) (\\d+) (\\d+)$", k)
    return lines.where(F.col("line").rlike("^=> \\S+ \\d+ \\d+$")).select(part(1).alias("name"), part(2).cast("int").alias("shard"), part(3).cast("long").alias("bytes"))


def source(spark: SparkSession, maker: Input, schema: str) -> DataFrame:
    """The rows of a user's generator, through a Python data source read on an executor."""
    from pyspark.sql.datasource import DataSource, DataSourceReader

    class Reader(DataSourceReader):
        def read(self, partition):
            yield from maker.input()

    class Source(DataSource):
        @classmethod
        def name(cls):
            return "termloom_input"

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Source)
    return spark.read.format("termloom_input").load()
