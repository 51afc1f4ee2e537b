"""One validated job configuration."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class JobConfig:
    num_mapper: int = 1
    num_reducer: int = 1
    threshold_nfile: int = 10
    limit_size: int = 128_000
    datadir: str = "."
    input_prefix: str = ""
    output_prefix: str = ""
    input_module: str = ""
    map_module: str = ""
    reduce_module: str = ""

    def __post_init__(self):
        for name in ("num_mapper", "num_reducer", "threshold_nfile", "limit_size"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")

    @classmethod
    def parse(cls, raw: str) -> "JobConfig":
        """From flat JSON with hyphens or underscores; unknown keys are an error."""
        given = {k.replace("-", "_"): v for k, v in json.loads(raw).items()}
        known = {f.name: f.type for f in fields(cls)}
        odd = sorted(set(given) - set(known))
        if odd:
            raise ValueError(f"unknown keys: {', '.join(odd)}")
        return cls(**given)

    def apply(self, spark) -> None:
        spark.conf.set("spark.sql.shuffle.partitions", str(self.num_reducer))

    def run(self, spark):
        """The rows of the job whose input, map and reduce classes the modules name.

        The input has a ``schema``; a reducer has its ``key`` columns and reduces in two levels.
        Without a reduce module the mapped rows are the result, without a map module the input's.
        """
        from termloom.operators import mapreduce

        source = mapreduce.load(self.input_module)()
        rows = mapreduce.source(spark, source, source.schema)
        if self.map_module:
            rows = mapreduce.run_map(rows, mapreduce.load(self.map_module)())
        if self.reduce_module:
            reducer = mapreduce.load(self.reduce_module)()
            rows = mapreduce.run_reduce_twice(rows, list(reducer.key), reducer, self.num_reducer)
        return rows
