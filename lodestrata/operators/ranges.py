"""As-of and interval joins without a cross product.

A key is cut into buckets of equal width. Only rows of one bucket meet, so a key that holds a third of the rows is spread over its buckets.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIDTH = 1 << 16


def _bucket(c: Column, width: int) -> Column:
    return F.floor(c / F.lit(width)).cast("decimal(20,0)")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, start: str, payload: list[str], width: int = WIDTH) -> DataFrame:
    """Each left row with the ``payload`` of the right row of the same ``by`` whose ``start`` is the greatest <= ``at`` (null if none).

    Rows of ``right`` with a null key or start are no candidates; of several with one start the one with the smallest payload counts; left rows
    with nulls come out with nulls; columns of ``right`` beyond the payload are ignored, those of ``left`` kept. A bucket without a start of its
    own gets the last one of the buckets before it, found on one row per bucket.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    right = right.where(F.col(start).isNotNull()).groupBy(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(start).alias("_at")).agg(F.min(F.struct(*payload)).alias("_p"))
    right = right.withColumns({"_b": _bucket(F.col("_at"), width), "_v": F.struct(F.col("_at").alias("s"), F.col("_p").alias("p"))})
    told = F.col(at).isNotNull()
    for b in by:
        told = told & F.col(b).isNotNull()
    none_of = left.where(~told)
    left = left.where(told)
    probe = left.withColumns({**{k: F.col(b) for b, k in zip(by, keys, strict=True)}, "_at": F.col(at)}).withColumn("_b", _bucket(F.col("_at"), width))
    ends = right.groupBy(*keys, "_b").agg(F.max("_v").alias("_last"))
    wanted = probe.select(*keys, "_b").distinct().join(ends.select(*keys, "_b").withColumn("_has", F.lit(True)), [*keys, "_b"], "left").select(*keys, "_b")
    none = F.lit(None).cast(ends.schema["_last"].dataType)
    steps = ends.select(*keys, "_b", "_last", F.lit(1).alias("_t")).unionByName(wanted.select(*keys, "_b", none.alias("_last"), F.lit(0).alias("_t")))
    before = Window.partitionBy(*keys).orderBy("_b", "_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = steps.withColumn("_c", F.last("_last", ignorenulls=True).over(before)).where("_t = 0 and _c is not null").select(*keys, "_b", F.col("_c").alias("_v"))
    marks = right.select(*keys, "_b", F.col("_at"), "_v").unionByName(carry.select(*keys, "_b", F.col("_v.s").alias("_at"), "_v"))
    row = F.struct(*[F.col(c) for c in left.columns])
    both = marks.select(*keys, "_b", "_at", F.lit(0).alias("_t"), "_v", F.lit(None).cast(probe.select(row.alias("r")).schema["r"].dataType).alias("_row")).unionByName(
        probe.select(*keys, "_b", "_at", F.lit(1).alias("_t"), F.lit(None).cast(marks.schema["_v"].dataType).alias("_v"), row.alias("_row"))
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("_at", "_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_f", F.last("_v", ignorenulls=True).over(inside)).where("_t = 1")
    name = lambda p: f"{p}_asof" if p in left.columns else p
    out = found.select(*[F.col("_row")[c].alias(c) for c in left.columns], *[F.col(f"_f.p.{p}").alias(name(p)) for p in payload])
    kinds = {f.name: f.dataType for f in out.schema}
    return out.unionByName(none_of.select(*left.columns, *[F.lit(None).cast(kinds[name(p)]).alias(name(p)) for p in payload]))


#: Widths of the interval buckets grow by this factor, so 64-bit addresses need at most twelve of them.
STEP, LEVELS = 16, 12


def interval_join(left: DataFrame, right: DataFrame, by: list[str], at: str, lo: str, hi: str, order: str, payload: list[str], width: int = WIDTH) -> DataFrame:
    """Each left row with the payload of the first (smallest ``order``) right row of the same ``by`` with lo <= at < hi; null if none.

    Empty and null intervals match nothing; left rows with nulls come out with nulls; repeated left rows stay. An interval goes into the buckets of
    the narrowest width that is at least its own length, so into two of them at most, however long it is; a probe looks into one bucket of each width.
    Distinct (key, place) pairs are probed and joined back, so nothing depends on row numbers.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    widths = [min(width * STEP**k, 10**20 - 1) for k in range(LEVELS)]
    length = F.col(hi) - F.col(lo)
    level = F.coalesce(*[F.when(length <= F.lit(Decimal(w)), F.lit(k)) for k, w in enumerate(widths)], F.lit(LEVELS - 1))
    w = F.element_at(F.array(*[F.lit(Decimal(x)).cast("decimal(20,0)") for x in widths]), F.col("_l") + 1)
    at_bucket = lambda c: F.floor(c / w).cast("decimal(20,0)")
    marks = right.where(F.col(lo) < F.col(hi)).select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), level.alias("_l"), F.struct(F.col(order).alias("o"), *[F.col(p).alias(f"p{i}") for i, p in enumerate(payload)]).alias("_v"))
    marks = marks.withColumn("_b", F.explode(F.array_distinct(F.array(at_bucket(F.col("_lo")), at_bucket(F.col("_hi") - 1)))))
    asked = left.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(at).alias("_at")).dropna().distinct()
    probe = asked.withColumn("_l", F.explode(F.array(*[F.lit(k) for k in range(LEVELS)]))).withColumn("_b", at_bucket(F.col("_at")))
    used = F.broadcast(marks.select("_l").distinct())  # at most LEVELS rows
    hits = probe.join(used, "_l", "left_semi").join(marks, [*keys, "_l", "_b"]).where((F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi")))
    best = hits.groupBy(*keys, "_at").agg(F.min("_v").alias("_v"))
    on = [F.col(b) == F.col(k) for b, k in zip(by, keys, strict=True)] + [F.col(at) == F.col("_at")]
    return left.join(best, on, "left").select(*[left[c] for c in left.columns], *[F.col(f"_v.p{i}").alias(p) for i, p in enumerate(payload)])


def ranked(df: DataFrame, keys: list[str], order: str, rank: str, width: int = WIDTH, most: str | None = None) -> DataFrame:
    """``df`` with its 1-based ``rank`` by ``order`` (a non-negative number) within ``keys``, and the number of rows per key as ``most``.

    Ranks are made inside blocks of ``order`` and shifted by the rows in the blocks before, so a key with most rows isn't one task's window. Null keys
    are a group of their own; ties get ranks in no fixed order.
    """
    cols = [c for c in df.columns]
    x = df.withColumn("_blk", F.floor(F.col(order) / width))
    w = Window.partitionBy(*keys)
    sizes = x.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_m")).select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col("_blk").alias("_sb"), (F.sum("_m").over(w.orderBy("_blk")) - F.col("_m")).alias("_before"), F.sum("_m").over(w).alias("_all"))
    inside = x.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_blk").orderBy(order)))
    on = [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys] + [F.col("_blk").eqNullSafe(F.col("_sb"))]
    return inside.join(sizes, on).select(*cols, (F.col("_r") + F.col("_before")).alias(rank), *([F.col("_all").alias(most)] if most else []))
