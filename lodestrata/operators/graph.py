"""Graph operators over edge tables (src, dst within a graph key)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import cut


def reach(seeds: DataFrame, edges: DataFrame, node: list[str], max_rounds: int = 10_000) -> DataFrame:
    """``node`` columns and ``depth`` of everything reachable from ``seeds``, with the least number of steps.

    ``seeds``: the node columns. ``edges``: src_<c> and dst_<c> for each node column c. A frontier moves out one step a round. Edges are made distinct
    and written once, partitioned by their source; what has been reached is written every few rounds, the frontier every round, so lineage stays
    short and no round reads the input again. Repeated edges and seeds change nothing; null nodes are dropped. Raises if rounds run out.
    """
    ok = " and ".join(f"{c} is not null" for c in node)
    src, dst = [f"src_{c}" for c in node], [f"dst_{c}" for c in node]
    edges = cut(edges.select(*src, *dst).where(" and ".join(f"{c} is not null" for c in src + dst)).distinct().repartition(*src))
    found = frontier = cut(seeds.select(*node).where(ok).distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, max_rounds):
        step = frontier.select(*[F.col(c).alias(f"src_{c}") for c in node]).join(edges, src).select(*[F.col(d).alias(c) for d, c in zip(dst, node, strict=True)]).distinct()
        frontier = cut(step.join(found, node, "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)
        if depth % 8 == 0:
            found = cut(found)
    raise RuntimeError("no end of the frontier reached")


def trim(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """Edges without some that can't lie on a cycle: those at nodes with no way in or no way out, a few times over. What is left need not all lie on cycles."""
    for _ in range(rounds):
        alive = edges.select(F.col("src").alias("v")).intersect(edges.select(F.col("dst").alias("v")))
        edges = edges.join(alive.select(F.col("v").alias("src")), "src", "left_semi").join(alive.select(F.col("v").alias("dst")), "dst", "left_semi").select(*edges.columns)
    return cut(edges)


def _components_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """Strong components of two or more nodes of one part of a graph: two passes of depth-first search (Kosaraju), without recursion."""
    forth: dict[int, list[int]] = {}
    back: dict[int, list[int]] = {}
    for s, d in zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True):
        forth.setdefault(s, []).append(d)
        back.setdefault(d, []).append(s)
    finished, seen = [], set()
    for root in forth:
        stack = [(root, iter(forth[root]))] if root not in seen else []
        seen.add(root)
        while stack:
            v, below = stack[-1]
            for d in below:
                if d not in seen:
                    seen.add(d)
                    stack.append((d, iter(forth.get(d, ()))))
                    break
            else:
                finished.append(v)
                stack.pop()
    owner: dict[int, list[int]] = {}
    taken: set[int] = set()
    for root in reversed(finished):
        if root in taken:
            continue
        taken.add(root)
        part, todo = [root], [root]
        while todo:
            for d in back.get(todo.pop(), ()):
                if d not in taken:
                    taken.add(d)
                    part.append(d)
                    todo.append(d)
        if len(part) > 1:
            owner[min(part)] = part
    return pd.DataFrame({"v": [v for p in owner.values() for v in p], "component": [c for c, p in owner.items() for _ in p]}, dtype="int64")


#: Edges of one part of a graph that a single call may hold (some 100 MB); larger parts are searched by all tasks together.
LOCAL_EDGES = 500_000


def strong_components(edges: DataFrame, part: str | None = None, local: int = LOCAL_EDGES, max_rounds: int = 10_000) -> DataFrame:
    """v, component of the nodes on cycles through two or more nodes; ``component`` is the component's smallest node.

    ``edges``: src, dst and, if the graph falls into parts that no edge connects (binaries), the column ``part``. Parts of at most ``local`` edges are
    each searched in one call, in parallel; all larger ones together by rounds of joins (and everything, where no part is named): every node learns
    the smallest node that reaches it and the smallest it reaches; where both are the same the node belongs to that node's component, and among
    nodes that agree in both, which the other components don't leave, the search goes on. Parts of which at most ``local`` edges are left, as most
    are once ends are trimmed and their largest component is found, are finished in one call each. Nodes outside are components of their own and
    aren't listed. Self links, nulls and repeated edges are ignored. Raises if rounds run out.
    """
    ends = [F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")]
    edges = cut(edges.select(*ends, *([F.col(part).alias("_part")] if part else [])).where("src <> dst").distinct())
    done = []

    def larger(edges: DataFrame) -> DataFrame:
        """Edges of the parts too large for one call; those of the others are taken care of."""
        if not part or edges.isEmpty():
            return edges
        sizes = cut(edges.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")))
        small = edges.join(sizes.where(F.col("_n") <= local).select("_part"), "_part", "left_semi")
        done.append(small.groupBy("_part").applyInPandas(_components_of, "v bigint, component bigint"))
        large = sizes.where(F.col("_n") > local).select("_part")
        return edges.limit(0) if large.isEmpty() else cut(edges.join(large, "_part", "left_semi"))

    edges = larger(edges)
    for _ in range(max_rounds):
        edges = edges if edges.isEmpty() else larger(trim(edges))
        if edges.isEmpty():
            break
        state = cut(edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct().select("v", F.col("v").alias("f"), F.col("v").alias("b"), F.lit(True).alias("mf"), F.lit(True).alias("mb")))
        none = F.lit(None).cast("bigint")
        while True:  # only what changed in the last round goes out
            forth = edges.join(state.where("mf").select(F.col("v").alias("src"), "f"), "src").select(F.col("dst").alias("v"), "f", none.alias("b"))
            back = edges.join(state.where("mb").select(F.col("v").alias("dst"), "b"), "dst").select(F.col("src").alias("v"), none.alias("f"), "b")
            news = forth.unionByName(back).groupBy("v").agg(F.min("f").alias("nf"), F.min("b").alias("nb"))
            moved = lambda new, old: F.coalesce(F.col(new) < F.col(old), F.lit(False))
            state = cut(state.join(news, "v", "left").select("v", F.least("f", F.coalesce("nf", "f")).alias("f"), F.least("b", F.coalesce("nb", "b")).alias("b"), moved("nf", "f").alias("mf"), moved("nb", "b").alias("mb")))
            if state.where("mf or mb").isEmpty():
                break
        done.append(state.where("f = b").select("v", F.col("f").alias("component")))
        rest = state.where("f <> b").select("v", "f", "b")
        src, dst = rest.select(F.col("v").alias("src"), F.col("f").alias("fs"), F.col("b").alias("bs")), rest.select(F.col("v").alias("dst"), F.col("f").alias("fd"), F.col("b").alias("bd"))
        edges = edges.join(src, "src").join(dst, "dst").where("fs = fd and bs = bd").select(*edges.columns)
    else:
        raise RuntimeError("strong components: rounds ran out")
    if not done:
        return edges.select(F.col("src").alias("v"), F.col("src").alias("component")).where("false")
    out = reduce(DataFrame.unionByName, done)
    big = out.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return cut(out.join(big.select("component"), "component", "left_semi").select("v", "component"))
