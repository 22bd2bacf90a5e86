"""Order-dependent folds over clusters of routines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.session import cut


def coalesce_small(clusters: DataFrame, most_members: int = 12, most_bytes: int = 2048, small_members: int = 2, small_bytes: int = 128) -> DataFrame:
    """group_key, pos, merged_pos: adjacent small clusters (members and bytes up to the small limits) of a group are merged while the merged one
    stays within the large limits; a cluster that isn't small ends the run. ``merged_pos`` is the position of the first cluster merged.

    ``clusters``: group_key, pos, members, bytes. A stream sorted by (group, position) is folded in constant memory: a group of any size is never
    held. Equal positions are taken in order of members and bytes; null sizes count as 0. Callers count a routine of size 0 as one byte.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, members, size = None, None, 0, 0
        for b in batches:
            out = []
            for g, p, m, s in zip(*(b.column(c).to_pylist() for c in ("group_key", "pos", "members", "bytes")), strict=True):
                small = m <= small_members and s <= small_bytes
                if small and at == g and first is not None and members + m <= most_members and size + s <= most_bytes:
                    members, size = members + m, size + s
                else:
                    first, members, size = p, m, s
                out.append(first)
                if not small:
                    first = None
                at = g
            yield pa.RecordBatch.from_arrays([b.column("group_key"), b.column("pos"), pa.array(out, pa.int64())], names=["group_key", "pos", "merged_pos"])

    rows = clusters.select(F.col("group_key").cast("string").alias("group_key"), F.col("pos").cast("bigint").alias("pos"), F.coalesce("members", F.lit(0)).cast("bigint").alias("members"), F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"))
    return rows.repartition("group_key").sortWithinPartitions("group_key", "pos", "members", "bytes").mapInArrow(fold, "group_key string, pos bigint, merged_pos bigint")


def unique_names(names: DataFrame, max_rounds: int = 20) -> DataFrame:
    """scope, id, name, unique_name: the first of a scope (by prio, id) keeps its name, others get ``_<id>``, and while that clashes ``_dup``.

    ``names``: scope, id, prio, name. Names are claimed round by round until none is taken twice: a later name may clash with an earlier suffixed
    one. First claims are found by a minimum per name, which combines map-side. Null names become ``unnamed``.
    """
    base = names.select("scope", "id", "prio", F.coalesce("name", F.lit("unnamed")).alias("name"))
    open_ = cut(base.withColumn("want", F.col("name")))
    done = None
    for k in range(max_rounds):
        free = open_ if done is None else open_.join(done.select("scope", F.col("unique_name").alias("want")), ["scope", "want"], "left_anti")
        winner = free.groupBy("scope", "want").agg(F.min(F.struct("prio", "id")).alias("w"))
        won = cut(free.join(winner, ["scope", "want"]).where((F.col("prio") == F.col("w.prio")) & (F.col("id") == F.col("w.id"))).select("scope", "id", "name", F.col("want").alias("unique_name")))
        done = won if done is None else done.unionByName(won)
        suffix = F.concat(F.col("name"), F.lit("_"), F.col("id").cast("string"), F.lit("_dup" * k))
        open_ = cut(open_.join(won.select("scope", "id"), ["scope", "id"], "left_anti").withColumn("want", suffix))
        if open_.isEmpty():
            return done
    raise RuntimeError("names still clash")


def place_new(members: DataFrame, edges: DataFrame, added: DataFrame, rounds: int = 3) -> DataFrame:
    """v, cluster of added nodes: that of the first placed neighbour, callers before callees, smaller ids first; at most ``rounds`` passes; then
    ``discovered``. ``members``: v, cluster; ``edges``: src, dst; ``added``: v."""
    near = edges.select(F.col("dst").alias("v"), F.col("src").alias("n"), F.lit(0).alias("side")).unionByName(edges.select(F.col("src").alias("v"), F.col("dst").alias("n"), F.lit(1).alias("side")))
    near = cut(near.join(added.select("v").distinct(), "v", "left_semi").where("v <> n").distinct())
    known, open_, out = members.select("v", "cluster"), cut(added.select("v").distinct()), None
    for _ in range(rounds):
        best = near.join(open_, "v", "left_semi").join(known.select(F.col("v").alias("n"), "cluster"), "n").groupBy("v").agg(F.min(F.struct("side", "n", "cluster")).alias("x"))
        new = cut(best.select("v", "x.cluster"))
        out = new if out is None else out.unionByName(new)
        known, open_ = known.unionByName(new), cut(open_.join(new, "v", "left_anti"))
    return out.unionByName(open_.withColumn("cluster", F.lit("discovered")))


def preorder(members: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """cluster, v, pos: depth-first pre-order from the cluster's smallest root, then what isn't reached in order of v.

    Clusters hold at most ``most`` members (larger ones are chunked before), so a cluster fits one call; a larger one is refused.
    """

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(pdf["v"].unique())
        if len(nodes) > most:
            raise ValueError(f"cluster {key[0]} has {len(nodes)} members; chunk it to {most} before")
        below: dict[int, list[int]] = {}
        for v, d in zip(pdf["v"], pdf["dst"], strict=True):
            if d == d and d is not None:
                below.setdefault(v, []).append(int(d))
        inside, seen, order = set(nodes), set(), []
        targets = {d for ds in below.values() for d in ds if d in inside}
        start = [v for v in nodes if v not in targets][:1] or nodes[:1]
        for first in start:
            stack = [first]
            while stack:
                v = stack.pop()
                if v not in seen:
                    seen.add(v)
                    order.append(v)
                    stack += [d for d in sorted(below.get(v, []), reverse=True) if d in inside and d not in seen]
        order += [v for v in nodes if v not in seen]
        return pd.DataFrame({"cluster": key[0], "v": order, "pos": range(len(order))})

    own = members.select("cluster", "v").distinct()
    # Only edges inside a cluster reach its call.
    inside = edges.select(F.col("src").alias("v"), "dst").distinct().join(own, "v").join(own.select("cluster", F.col("v").alias("dst")), ["cluster", "dst"], "left_semi")
    inner = own.join(inside, ["cluster", "v"], "left").select("cluster", "v", "dst")
    return inner.groupBy("cluster").applyInPandas(walk, "cluster string, v bigint, pos int")


def chunked(members: DataFrame, size: int = 50) -> DataFrame:
    """cluster (with ``_<chunk>`` where it is larger than ``size``), v: consecutive chunks in order of v."""
    w = Window.partitionBy("cluster")
    n = members.select("cluster", "v").distinct().withColumn("r", F.row_number().over(w.orderBy("v")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return n.select(F.when(F.col("n") > size, F.concat("cluster", F.lit("_"), F.floor(F.col("r") / size).cast("string"))).otherwise(F.col("cluster")).alias("cluster"), "v")
