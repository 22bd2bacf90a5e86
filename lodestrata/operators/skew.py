"""Aggregation by key where a few keys hold most rows (two-stage, salted)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.session import cut

#: A key counts as heavy above this fraction of all rows; so there are at most HEAVY_PARTS heavy keys whatever the data, which bounds their broadcast.
HEAVY_PARTS = 256
SALTS = 64


def heavy_keys(df: DataFrame, keys: list[str], parts: int = HEAVY_PARTS) -> DataFrame:
    """Keys on more than 1/parts of the rows (null-safe; at most ``parts`` rows), with their row count ``_n``.

    One pass with map-side partial counts; no rows are moved but one count per key and map task.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return counts.join(F.broadcast(total), F.col("_n") * parts > F.col("_total")).drop("_total")


def with_salt(df: DataFrame, keys: list[str], spread: Column, parts: int = HEAVY_PARTS, salts: int = SALTS, heavy: DataFrame | None = None) -> DataFrame:
    """Add ``_salt``: 0 for light keys, ``hash(spread) mod salts`` for heavy ones.

    The salt is a hash and not a random number: a task that is run again after a lost executor gives the same salt, and equal values of
    ``spread`` meet in one salt, which makes partial distinct counts additive.
    """
    heavy = (heavy if heavy is not None else heavy_keys(df, keys, parts)).select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.lit(True).alias("_heavy"))
    on = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys]
    return df.join(F.broadcast(heavy), on, "left").withColumn("_salt", F.when(F.col("_heavy"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("_heavy", *[f"_h_{k}" for k in keys])


def lookup(df: DataFrame, table: DataFrame, keys: list[str], parts: int = HEAVY_PARTS) -> DataFrame:
    """Inner join of ``df`` with ``table``, which has one row per key: heavy keys of ``df`` meet a broadcast of their rows of ``table`` (at most
    ``parts``), all others are shuffled. Null keys match nothing; columns beyond the keys must differ."""
    heavy = heavy_keys(df, keys, parts).drop("_n")
    hot = F.broadcast(cut(table.join(F.broadcast(heavy), keys, "left_semi")))
    light = df.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table, keys)
    return light.unionByName(df.join(hot, keys).select(*light.columns))


def salted_count_distinct(df: DataFrame, keys: list[str], value: str, out: str, parts: int = HEAVY_PARTS, salts: int = SALTS) -> DataFrame:
    """Number of distinct non-null ``value`` per key.

    Stage 1 counts per (key, salt), stage 2 adds the partial counts per key. Nulls in a key form a group of their own; a key with null values only
    gets 0; an empty table gives an empty result; other columns are ignored.
    """
    narrow = df.select(*keys, value).distinct()  # repeated rows collapse map-side before any key is weighed
    partial = with_salt(narrow, keys, F.col(value), parts, salts).groupBy(*keys, "_salt").agg(F.count(value).alias("_partial"))
    return partial.groupBy(*keys).agg(F.sum("_partial").alias(out))


def salted_aggregate(df: DataFrame, keys: list[str], aggs: dict[str, tuple[str, str]], parts: int = HEAVY_PARTS, salts: int = SALTS) -> DataFrame:
    """count/sum/min/max per key, partial per salt and then merged.

    ``aggs`` maps the output name to (function, column); ``("count", "*")`` counts rows. Rows of a heavy key are spread by the hash of all their columns.
    """
    merge = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    make = {"count": lambda c: F.count(F.lit(1) if c == "*" else F.col(c)), "sum": F.sum, "min": F.min, "max": F.max}
    salted = with_salt(df, keys, F.struct(*[F.col(c) for c in df.columns]), parts, salts)
    part = salted.groupBy(*keys, "_salt").agg(*[make[f](c).alias(o) for o, (f, c) in aggs.items()])
    return part.groupBy(*keys).agg(*[merge[f](o).alias(o) for o, (f, _) in aggs.items()])
