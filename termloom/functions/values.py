"""Formats and small expressions of the job-status and naming layer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1048576
PHASES = {0: "MAP", 1: "REDUCE", 2: "MERGE"}


def elapsed(seconds: Column) -> Column:
    """HH:MM:SS; hours go on past 24."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def files_and_size(files: Column, size: Column) -> Column:
    """"n files, m.00 MBs" of whole mebibytes."""
    return F.format_string("%d files, %.2f MBs", files.cast("long"), F.floor(size / MIB).cast("double"))


def size_triple(a: Column, b: Column) -> Column:
    x, y = a / MIB, b / MIB
    # ties go to the even digit, as in C
    return F.format_string("%.2f/%.2f/%.2f", *(F.bround(v, 2) for v in (x, y, x + y)))


def mib_per_second(size: Column, seconds: Column) -> Column:
    """Null for zero seconds."""
    return F.try_divide(size, seconds * MIB)


def phase_name(code: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in PHASES.items() for x in kv)), code)


def index_file_name(shard: Column, file_id: Column) -> Column:
    return F.format_string("output-r%06d-p%018d", shard, file_id)


def parsed_file_name(name: Column) -> Column:
    """struct(shard, file_id); nulls if the name is another's."""
    part = lambda k: F.nullif(F.regexp_extract(name, "output-r(\\d{6})-p(\\d{18})", k), F.lit("")).cast("long")
    return F.struct(part(1).alias("shard"), part(2).alias("file_id"))


def member_doc_id(member: Column) -> Column:
    """The integer from the fifth character on, 0 if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(member, "^.{4}\\s*([+-]?\\d+)", 1), F.lit("")).cast("long"), F.lit(0))


def machine_line(line: Column) -> Column:
    """struct(host, slots) of "host:slots"; slots 1 if missing; null for blanks and comments."""
    parts = F.split(F.trim(line), ":")
    slots = F.coalesce(F.get(parts, 1).try_cast("int"), F.lit(1))
    return F.when(~F.trim(line).rlike("^(#|$)"), F.struct(F.get(parts, 0).alias("host"), slots.alias("slots")))


def url_parts(url: Column) -> Column:
    part = lambda x: F.parse_url(url, F.lit(x))
    return F.struct(part("PROTOCOL").alias("scheme"), F.regexp_extract(F.coalesce(part("AUTHORITY"), F.lit("")), "^([^:]*)", 1).alias("host"), F.regexp_extract(F.coalesce(part("AUTHORITY"), F.lit("")), ":(\\d+)$", 1).alias("port"), part("PATH").alias("path"))


def shard_of(doc_id: Column, shards: int) -> Column:
    return F.pmod(doc_id, F.lit(shards)).cast("int")


def known_keys_merged(defaults: Column, update: Column) -> Column:
    """Map of defaults with the update's values for keys that the defaults have."""
    return F.transform_values(defaults, lambda k, v: F.coalesce(F.element_at(update, k), v))
