"""References whose target does not exist at the reference's own time.

Keys are two independent 64-bit hashes of (referring field, key), so that no text is moved. They are partitioned into ranges of the first hash. Each
range keeps its parents as sorted arrays (hashes, start of validity, and the greatest end so far); batches of references are probed against them by
vectorised binary search. Parents and references of a range meet in one stream sorted by (range, salt, parents first): only the parents of one range
are ever held, references flow through in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.session import shuffle_partitions

ROWS_PER_RANGE = 50_000
FOREVER = np.iinfo(np.int64).max
REASONS = ("", "missing", "deleted", "late")


def key_hashes(field: Column, key: Column) -> tuple[Column, Column]:
    """128 bits for a key of a field; two keys are taken as equal if both hashes are (at 10^9 keys a chance of about 10^-20)."""
    return F.xxhash64(field, key), F.xxhash64(F.lit(0x5BD1E995), key, field)


class _Range:
    """Parents of one range as sorted arrays."""

    def __init__(self, chunks: list[pa.RecordBatch]):
        t = pa.Table.from_batches(chunks)
        h, h2 = t["h"].to_numpy(), t["h2"].to_numpy()
        start, end = t["t"].cast(pa.int64()).to_numpy(), t["t2"].cast(pa.int64()).fill_null(FOREVER).to_numpy()
        order = np.lexsort((start, h2, h))
        h, h2, self.start, end = h[order], h2[order], start[order], end[order]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])])
        self.h, self.h2, self.lo, self.hi = h[first], h2[first], first, np.r_[first[1:], len(h)]
        # The greatest end among the rows of the same key up to each row: doubling steps, all keys at once.
        of, at, step = np.repeat(first, self.hi - first), np.arange(len(h)), 1
        self.top = end.copy()
        while (more := at - step >= of).any():
            top = self.top.copy()
            top[more] = np.maximum(self.top[more], self.top[(at - step)[more]])
            self.top, step = top, step * 2

    def probe(self, h: np.ndarray, h2: np.ndarray, t: np.ndarray) -> np.ndarray:
        """0 valid, 1 missing, 2 deleted, 3 late."""
        g = np.searchsorted(self.h, h)
        inside = np.minimum(g, len(self.h) - 1)
        while (other := (g < len(self.h)) & (self.h[inside] == h) & (self.h2[inside] != h2)).any():  # keys that share the first hash
            g = g + other
            inside = np.minimum(g, len(self.h) - 1)
        known = (g < len(self.h)) & (self.h[inside] == h) & (self.h2[inside] == h2)
        first = self.lo[inside]
        lo, hi = first.copy(), self.hi[inside].copy()
        while (open_ := lo < hi).any():  # rightmost start <= t, for all references at once
            mid = (lo + hi) // 2
            go = open_ & (self.start[np.minimum(mid, len(self.start) - 1)] <= t)
            lo, hi = np.where(go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
        begun = lo > first
        valid = begun & (self.top[np.maximum(lo - 1, 0)] > t)
        return np.where(~known, 1, np.where(valid, 0, np.where(begun, 2, 3)))


def _probe_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, held, index = None, [], None
    for b in batches:
        if not b.num_rows:
            continue
        place, field = (b.column(c).to_numpy() for c in ("place", "field"))
        parent = field < 0
        cuts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (parent[1:] != parent[:-1])])
        for i, j in zip(cuts, np.r_[cuts[1:], b.num_rows], strict=True):
            if at != place[i]:
                at, held, index = place[i], [], None
            part = b.slice(int(i), int(j - i))
            if parent[i]:
                held.append(part)
                continue
            if index is None and held:
                index, held = _Range(held), []
            t = part.column("t").cast(pa.int64()).to_numpy()
            what = np.ones(len(t), dtype=np.int64) if index is None else index.probe(part.column("h").to_numpy(), part.column("h2").to_numpy(), t)
            miss = np.flatnonzero(what)
            if len(miss):
                out = part.take(pa.array(miss))
                yield pa.RecordBatch.from_arrays([out.column("field"), out.column("rec_id"), out.column("tie"), pa.array(what[miss].astype(np.int8)), out.column("t")], names=["field", "rec_id", "tie", "reason", "t"])


def orphan_references(refs: DataFrame, parents: DataFrame, rows_per_range: int = ROWS_PER_RANGE, fields: list[str] | None = None) -> DataFrame:
    """References without a target row valid at their time.

    ``refs``: ref_field string, rec_id bigint, key string, t timestamp_ntz, and optionally tie bigint, which is handed through. ``parents``: ref_field
    string, key string, valid_from, valid_to (null = open). Gives ref_field, rec_id, tie, reason (missing, deleted, late) and t, one row per
    reference row: repeated references give repeated rows.

    ``fields``: the values of ref_field, which are read from ``refs`` unless given.
    Null keys, null ids and null times are no references; parents with a null key or null start are never valid; an empty parent table makes every
    reference ``missing``; repeated parents change nothing; other columns are ignored. A range with more than a fair part of
    the references is hot: it is salted into fair parts and its parents, ``rows_per_range`` or so, are copied to each salt. There can't be more
    hot ranges than parts, which bounds the broadcast of their list.
    """
    spark = refs.sparkSession
    parts = 2 * shuffle_partitions(spark)
    if "tie" not in refs.columns:
        refs = refs.withColumn("tie", F.lit(None).cast("bigint"))
    h, h2 = key_hashes(F.col("ref_field"), F.col("key"))
    parents = parents.where("key is not null and valid_from is not null").select(h.alias("h"), h2.alias("h2"), F.col("valid_from").alias("t"), F.col("valid_to").alias("t2")).distinct()
    n_ranges = max(1, -(-parents.count() // rows_per_range))
    rid = F.least(F.floor((F.col("h").cast("double") / F.lit(2.0**64) + 0.5) * n_ranges), F.lit(n_ranges - 1)).cast("int")
    # Field names travel as numbers; they are at most 127, whether given or read.
    names = fields if fields is not None else [r.ref_field for r in refs.select("ref_field").distinct().orderBy("ref_field").collect()]
    if len(names) > 127:
        raise ValueError("too many referring fields")
    number = F.coalesce(*[F.when(F.col("ref_field") == n, F.lit(k)) for k, n in enumerate(names)], F.lit(0)).cast("tinyint")
    refs = refs.where("key is not null and t is not null and rec_id is not null").select(number.alias("field"), h.alias("h"), h2.alias("h2"), "t", "rec_id", "tie").withColumn("rid", rid)
    parents = parents.withColumn("rid", rid)
    counts = refs.groupBy("rid").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    hot = F.broadcast(counts.join(F.broadcast(total), F.col("_n") * parts > F.col("_total")).select("rid", F.ceil(F.col("_n") * parts / F.col("_total")).cast("int").alias("salts")))
    left = refs.join(hot, "rid", "left").withColumn("salt", F.pmod(F.xxhash64("rec_id", "t"), F.coalesce("salts", F.lit(1))).cast("int"))
    right = parents.join(hot, "rid", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    place = (F.col("rid").cast("bigint") * (1 << 20) + F.col("salt")).alias("place")
    none = lambda kind: F.lit(None).cast(kind)
    both = right.select(place, F.lit(-1).cast("tinyint").alias("field"), "h", "h2", "t", "t2", none("bigint").alias("rec_id"), none("bigint").alias("tie")).unionByName(left.select(place, "field", "h", "h2", "t", none("timestamp_ntz").alias("t2"), "rec_id", "tie"))
    # The field number sorts parents (-1) first.
    found = both.repartition(shuffle_partitions(spark), "place").sortWithinPartitions("place", "field").mapInArrow(_probe_stream, "field tinyint, rec_id bigint, tie bigint, reason tinyint, t timestamp_ntz")
    texts = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]) if values else F.array(F.lit("")), F.col(at).cast("int"))
    return found.select(texts(names, "field").alias("ref_field"), "rec_id", "tie", texts(REASONS, "reason").alias("reason"), "t")
