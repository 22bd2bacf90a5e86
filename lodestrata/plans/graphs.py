"""Reachability, roots, cycles and label clustering over the call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.folds import chunked, coalesce_small, place_new, preorder, unique_names
from lodestrata.operators.graph import reach, strong_components
from lodestrata.plans.helpers import Book
from lodestrata.session import cut, table

book = Book()
QUERIES, ORACLE = book.queries, book.oracle
_ROOTS = "roots as (select r.binary_id, r.address from routines r where not imported and not exists (select 1 from calls c where c.binary_id = r.binary_id and c.dst = r.address))"
_EDGES = "edges as (select distinct a.routine_id as src, b.routine_id as dst from calls c join routines a on a.binary_id = c.binary_id and a.address = c.src and not a.thunk join routines b on b.binary_id = c.binary_id and b.address = c.dst and not b.thunk where a.routine_id <> b.routine_id)"
_SCC = f"recursive {_EDGES}, r(s, d) as (select src, dst from edges union select r.s, e.dst from r join edges e on e.src = r.d), scc as (select a.s as routine_id, least(a.s, min(a.d)) as component from r a join r b on b.s = a.d and b.d = a.s where a.s <> a.d group by a.s)"
_REACH = f"""recursive {_ROOTS}, edges as (select distinct c.binary_id, c.src, c.dst from calls c join routines r on r.binary_id = c.binary_id and r.address = c.dst and not r.imported),
walk(binary_id, address, depth) as (select binary_id, address, 0 from roots union select w.binary_id, e.dst, w.depth + 1 from walk w join edges e on e.binary_id = w.binary_id and e.src = w.address where w.depth < 40),
found as (select binary_id, address, min(depth) as depth from walk group by 1, 2)"""


def node_id(binary: str, address: str):
    """One 63-bit number per (binary, address): addresses are 64 bits wide, so it is a hash."""
    return F.xxhash64(binary, address)


def roots(spark, sf) -> DataFrame:
    called = table(spark, sf, "calls").select("binary_id", F.col("dst").alias("address"))
    return table(spark, sf, "routines").where("not imported").select("binary_id", "address", "routine_id").join(called, ["binary_id", "address"], "left_anti")


def reached(spark, sf) -> DataFrame:
    """Routines reachable from the roots with their depth; imported routines are never entered."""
    inside = table(spark, sf, "routines").where("not imported").select("binary_id", F.col("address").alias("dst"))
    edges = table(spark, sf, "calls").select("binary_id", "src", "dst").distinct().join(inside, ["binary_id", "dst"], "left_semi")
    edges = edges.select(F.col("binary_id").alias("src_binary_id"), F.col("src").alias("src_address"), F.col("binary_id").alias("dst_binary_id"), F.col("dst").alias("dst_address"))
    return reach(roots(spark, sf).select("binary_id", "address"), edges, ["binary_id", "address"])


@book.add("e1_reachable", f"with {_REACH} select r.routine_id, f.depth from found f join routines r on r.binary_id = f.binary_id and r.address = f.address")
def reachable(spark, sf):
    return table(spark, sf, "routines").select("routine_id", "binary_id", "address").join(reached(spark, sf), ["binary_id", "address"]).select("routine_id", "depth")


@book.add("d9_reachable_counts", f"with {_REACH} select r.binary_id, count(f.depth) as reachable_n, count(*) filter (where f.depth is null and not r.imported) as unreachable_n, coalesce(max(f.depth), 0) as deepest from routines r left join found f on f.binary_id = r.binary_id and f.address = r.address group by 1")
def reachable_counts(spark, sf):
    j = table(spark, sf, "routines").select("binary_id", "address", "imported").join(reached(spark, sf), ["binary_id", "address"], "left")
    return j.groupBy("binary_id").agg(F.count("depth").alias("reachable_n"), F.count_if(F.col("depth").isNull() & ~F.col("imported")).alias("unreachable_n"), F.coalesce(F.max("depth"), F.lit(0)).alias("deepest"))


@book.add("e5_roots", f"with {_ROOTS} select r.routine_id from routines r join roots on roots.binary_id = r.binary_id and roots.address = r.address")
def root_ids(spark, sf):
    return roots(spark, sf).select("routine_id")


def call_edges(spark, sf) -> DataFrame:
    """Distinct call edges between routines of the inventory, as routine ids, with their binary; thunks left out."""
    r = table(spark, sf, "routines").where("not thunk")
    s, d = r.select("binary_id", F.col("address").alias("src"), F.col("routine_id").alias("a")), r.select("binary_id", F.col("address").alias("dst"), F.col("routine_id").alias("b"))
    return table(spark, sf, "calls").select("binary_id", "src", "dst").distinct().join(s, ["binary_id", "src"]).join(d, ["binary_id", "dst"]).select(F.col("a").alias("src"), F.col("b").alias("dst"), "binary_id")


@book.add("e6_components", f"with {_SCC} select routine_id, component from scc")
def components(spark, sf):
    """Strongly connected components of the call graph with two or more routines."""
    return strong_components(call_edges(spark, sf), "binary_id").select(F.col("v").alias("routine_id"), "component")


@book.add("e7_cycles", f"with {_SCC} select component, count(*) as members, max(routine_id) as largest from scc group by 1")
def cycles(spark, sf):
    """Size of each cycle group. Calls never leave a binary, so each is searched by itself; only those too large for one call take rounds of joins."""
    return strong_components(call_edges(spark, sf), "binary_id").groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.max("v").alias("largest"))


def label_clusters(edges: DataFrame, nodes: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """v, label, shared: components of cycles are condensed; in topological order a component with one distinct predecessor label takes it, any other
    becomes its own label; with several it is ``shared`` as well. ``nodes``: v; ``edges``: src, dst.

    One round per layer of the condensed graph; labels are reduced to their minimum and maximum, which is all it takes to know whether there are
    several, so a component with very many callers is no list in one task. The label of a component is its smallest node.
    """
    scc = strong_components(edges, "binary_id" if "binary_id" in edges.columns else None)
    comp = cut(nodes.select("v").distinct().join(scc, "v", "left").select("v", F.coalesce("component", "v").alias("c")))
    links = edges.join(comp.select(F.col("v").alias("src"), F.col("c").alias("a")), "src").join(comp.select(F.col("v").alias("dst"), F.col("c").alias("b")), "dst").select("a", "b").where("a <> b").distinct()
    links = cut(links)
    open_ = cut(comp.select("c").distinct())
    done = None
    waiting = links
    for i in range(max_rounds):
        ready = cut(open_.join(waiting.select(F.col("b").alias("c")), "c", "left_anti"))
        if ready.isEmpty():
            break
        if done is None:
            new = ready.select("c", F.col("c").alias("label"), F.lit(False).alias("shared"))
        else:
            before = links.join(ready.withColumnRenamed("c", "b"), "b", "left_semi").join(done.select(F.col("c").alias("a"), "label"), "a").groupBy(F.col("b").alias("c")).agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
            new = ready.join(before, "c", "left").select("c", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("c")).alias("label"), F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)).alias("shared"))
        new = cut(new)
        done = new if done is None else done.unionByName(new)
        if i % 8 == 7:
            done = cut(done)
        open_ = cut(open_.join(ready, "c", "left_anti"))
        waiting = cut(waiting.join(ready.withColumnRenamed("c", "a"), "a", "left_anti"))
    else:
        raise RuntimeError("label clusters: rounds ran out")
    return comp.join(done, "c").select("v", "label", "shared")


@book.add("e8_label_clusters", None)
def clusters(spark, sf):
    nodes = table(spark, sf, "routines").where("not thunk and not imported").select(F.col("routine_id").alias("v"))
    edges = call_edges(spark, sf).join(nodes.withColumnRenamed("v", "src"), "src", "left_semi").join(nodes.withColumnRenamed("v", "dst"), "dst", "left_semi")
    return label_clusters(edges, nodes).select(F.col("v").alias("routine_id"), "label", "shared")


@book.add("e9_preorder", None)
def member_preorder(spark, sf):
    """Depth-first order of the routines inside chunks of their source files."""
    members = table(spark, sf, "routines").where("source_file is not null").select(F.concat_ws(":", "binary_id", "source_file").alias("cluster"), F.col("routine_id").alias("v"))
    return preorder(chunked(members), call_edges(spark, sf))


_FOLD = """recursive c as (select binary_id, source_file, count(*) as members, sum(greatest(size, 1)) as bytes, min(routine_id) as pos from routines where source_file is not null group by 1, 2),
o as (select *, row_number() over (partition by binary_id order by pos) as k from c),
w(binary_id, k, pos, first, members, bytes, is_open) as (select binary_id, k, pos, pos, members, bytes, members <= 2 and bytes <= 128 from o where k = 1
union all select o.binary_id, o.k, o.pos, case when j then w.first else o.pos end, case when j then w.members + o.members else o.members end, case when j then w.bytes + o.bytes else o.bytes end, o.members <= 2 and o.bytes <= 128 from w join o on o.binary_id = w.binary_id and o.k = w.k + 1, lateral (select w.is_open and o.members <= 2 and o.bytes <= 128 and w.members + o.members <= 12 and w.bytes + o.bytes <= 2048 as j))"""


@book.add("f7_coalesced", f"with {_FOLD} select binary_id::varchar as group_key, pos, first as merged_pos from w")
def coalesced(spark, sf):
    """Adjacent small source files of a folder merged."""
    c = table(spark, sf, "routines").where("source_file is not null").groupBy("binary_id", "source_file").agg(F.count(F.lit(1)).alias("members"), F.sum(F.greatest("size", F.lit(1))).alias("bytes"), F.min("routine_id").alias("pos"))
    return coalesce_small(c.withColumn("group_key", F.col("binary_id").cast("string")))


_CLAIMS = """q as (select binary_id as scope, routine_id as id, case when imported then 1 else 0 end as prio, coalesce(name, 'unnamed') as name from routines),
u1 as (select * from q qualify row_number() over (partition by scope, name order by prio, id) = 1), r1 as (select *, name || '_' || id as want from q where id not in (select id from u1)),
u2 as (select * from r1 where (scope, want) not in (select scope, name from u1))"""


@book.add("f9_unique_names", f"with {_CLAIMS} select scope, id, name, name as unique_name from u1 union all select scope, id, name, want from u2 union all select scope, id, name, want || '_dup' from r1 where id not in (select id from u2)")
def unique(spark, sf):
    return unique_names(table(spark, sf, "routines").select(F.col("binary_id").alias("scope"), F.col("routine_id").alias("id"), F.when(F.col("imported"), 1).otherwise(0).alias("prio"), "name"))


_PLACED = f"""{_EDGES}, m as (select routine_id as v, binary_id || ':' || source_file as cluster from routines where source_file is not null), a as (select routine_id as v from routines where source_file is null),
near as (select distinct v, n, side from (select dst as v, src as n, 0 as side from edges union all select src, dst, 1 from edges) where v in (select v from a)),
p1 as (select near.v, arg_min(m.cluster, (side, near.n, m.cluster)) as cluster from near join m on m.v = near.n group by 1), k1 as (select * from m union all select * from p1),
p2 as (select near.v, arg_min(k1.cluster, (side, near.n, k1.cluster)) as cluster from near join k1 on k1.v = near.n where near.v not in (select v from p1) group by 1), k2 as (select * from k1 union all select * from p2),
p3 as (select near.v, arg_min(k2.cluster, (side, near.n, k2.cluster)) as cluster from near join k2 on k2.v = near.n where near.v not in (select v from p1) and near.v not in (select v from p2) group by 1), p as (select * from p1 union all select * from p2 union all select * from p3)"""


@book.add("f10_placement", f"with {_PLACED} select a.v, coalesce(p.cluster, 'discovered') as cluster from a left join p on p.v = a.v")
def placement(spark, sf):
    """Routines without a source file placed with the first neighbour that has one."""
    r = table(spark, sf, "routines")
    members = r.where("source_file is not null").select(F.col("routine_id").alias("v"), F.concat_ws(":", "binary_id", "source_file").alias("cluster"))
    return place_new(members, call_edges(spark, sf), r.where("source_file is null").select(F.col("routine_id").alias("v")))
