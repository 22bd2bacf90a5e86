import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import graph
from lodestrata.operators.components import connected_components
from lodestrata.operators.graph import reach, strong_components
from lodestrata.operators.orphans import orphan_references
from lodestrata.operators.ranges import asof_join, interval_join
from lodestrata.operators.skew import heavy_keys, salted_aggregate, salted_count_distinct
from lodestrata.plans.graphs import components, cycles, label_clusters

T = lambda d: dt.datetime(2025, 1, d)
REFS = "ref_field string, rec_id bigint, key string, t timestamp_ntz"
PARENTS = "ref_field string, key string, valid_from timestamp_ntz, valid_to timestamp_ntz"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_orphans_by_reason(spark):
    parents = spark.createDataFrame([("f", "a", T(5), T(10)), ("f", "a", T(5), T(10)), ("f", "a", T(20), None), ("f", None, T(1), None), ("f", "n", None, None), ("g", "z", T(1), None)], PARENTS)
    refs = spark.createDataFrame(
        [("f", 1, "a", T(1)), ("f", 2, "a", T(5)), ("f", 3, "a", T(10)), ("f", 4, "a", T(12)), ("f", 5, "a", T(21)), ("f", 6, "z", T(21)), ("f", 7, None, T(21)), ("f", 8, "a", None), ("f", 6, "z", T(21)), ("f", 9, "n", T(3))], REFS
    )
    got = rows(orphan_references(refs.withColumn("h", F.lit(1)), parents.withColumn("rid", F.lit(1))), "rec_id", "reason")
    assert got == [(1, "late"), (3, "deleted"), (4, "deleted"), (6, "missing"), (6, "missing"), (9, "missing")]  # a reference that comes twice misses twice


def test_orphans_of_empty_tables(spark):
    refs, parents = spark.createDataFrame([("f", 1, "a", T(1))], REFS), spark.createDataFrame([("f", "a", T(1), None)], PARENTS)
    assert rows(orphan_references(refs, parents.limit(0)), "rec_id", "reason") == [(1, "missing")]
    assert rows(orphan_references(refs.limit(0), parents), "rec_id") == []


def test_orphans_against_brute_force_with_a_hot_key(spark):
    import random

    rnd = random.Random(3)
    parents = [("f", f"k{rnd.randrange(40)}", T(rnd.randrange(1, 15)), rnd.choice([None, T(rnd.randrange(10, 28))])) for _ in range(300)]
    refs = [("f", i, "k1" if i % 3 == 0 else f"k{rnd.randrange(60)}", T(rnd.randrange(1, 28))) for i in range(1500)]
    want = []
    for _, i, k, t in refs:
        mine = [p for p in parents if p[1] == k]
        if not any(p[2] <= t and (p[3] is None or p[3] > t) for p in mine):
            want.append((i, "missing" if not mine else "deleted" if any(p[2] <= t for p in mine) else "late"))
    got = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), rows_per_range=20)
    assert rows(got, "rec_id", "reason") == sorted(want, key=repr)


def test_salted_counts(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), ("a", None), ("b", 2)] + [("hot", i % 700) for i in range(3000)], "k string, v int")
    assert rows(salted_count_distinct(df, ["k"], "v", "n"), "k", "n") == sorted([(None, 1), ("a", 0), ("b", 1), ("hot", 700)], key=repr)
    assert rows(salted_aggregate(df, ["k"], {"n": ("count", "*"), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")}), "k", "n", "s", "lo", "hi") == sorted([(None, 2, 2, 1, 1), ("a", 1, None, None, None), ("b", 1, 2, 2, 2), ("hot", 3000, sum(i % 700 for i in range(3000)), 0, 699)], key=repr)
    assert [r.k for r in heavy_keys(df, ["k"], 2).collect()] == ["hot"]
    assert salted_count_distinct(df.limit(0), ["k"], "v", "n").count() == 0


def test_asof_and_interval_joins(spark):
    left = spark.createDataFrame([(1, 5), (1, 70000), (1, 1), (2, 5), (None, 5), (1, None), (1, 5)], "b int, at bigint")
    right = spark.createDataFrame([(1, 3, "x"), (1, 5, "y"), (1, 5, "w"), (1, 900000, "z"), (None, 1, "n"), (1, None, "m")], "b int, s bigint, p string")
    got = asof_join(left.selectExpr("b", "cast(at as decimal(20,0)) as at"), right.selectExpr("b", "cast(s as decimal(20,0)) as s", "p", "p as extra"), ["b"], "at", "s", ["p"])
    assert rows(got.withColumn("at", F.col("at").cast("int")), "b", "at", "p") == sorted([(1, 5, "w"), (1, 70000, "w"), (1, 1, None), (2, 5, None), (None, 5, None), (1, None, None), (1, 5, "w")], key=repr)
    spans = spark.createDataFrame([(1, 0, 10, "late"), (1, 4, 6, "early"), (1, 9, 9, "none"), (1, 60000, 200000, "wide")], "b int, lo bigint, hi bigint, o string")
    got = interval_join(left, spans, ["b"], "at", "lo", "hi", "o", ["o"])
    assert rows(got, "b", "at", "o") == sorted([(1, 5, "early"), (1, 70000, "wide"), (1, 1, "late"), (2, 5, None), (None, 5, None), (1, None, None), (1, 5, "early")], key=repr)


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (5, 7), (1, 2), (8, 7), (None, 1)], "src bigint, dst bigint")
    assert rows(strong_components(e), "v", "component") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    parts = e.withColumn("p", F.lit("x")).union(e.selectExpr("src + 10", "dst + 10", "'y'")).union(spark.createDataFrame([(31, 32, "z"), (32, 31, "z")], "src bigint, dst bigint, p string"))
    for local in (0, 5, 100):  # none, some and all parts in one call each
        assert rows(strong_components(parts, "p", local=local), "v", "component") == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (11, 11), (12, 11), (13, 11), (14, 14), (15, 14), (31, 31), (32, 31)], key=repr)
    assert strong_components(e.limit(0)).count() == 0
    seeds = spark.createDataFrame([(3,), (3,), (None,)], "v bigint")
    assert rows(reach(seeds, e.selectExpr("src as src_v", "dst as dst_v"), ["v"]), "v", "depth") == [(1, 1), (2, 2), (3, 0), (4, 1), (5, 2), (7, 3)]
    assert rows(connected_components(e.selectExpr("src as a", "dst as b")), "node", "component") == [(i, 1) for i in (1, 2, 3, 4, 5, 7, 8)]
    nodes = spark.createDataFrame([(i,) for i in range(1, 9)], "v bigint")
    got = {r.v: (r.label, r.shared) for r in label_clusters(e.where("src is not null"), nodes).collect()}
    assert got == {1: (1, False), 2: (1, False), 3: (1, False), 4: (1, False), 5: (1, False), 6: (6, False), 7: (7, True), 8: (8, False)}


def test_cycles_search_each_binary_by_itself(spark, data, monkeypatch):
    def rounds(*_):
        raise AssertionError("small binaries went through rounds of joins")

    monkeypatch.setattr(graph, "trim", rounds)
    assert rows(cycles(spark, data), "component", "members") == rows(components(spark, data).groupBy("component").agg(F.count("*").alias("members")), "component", "members")


def test_rest_of_a_large_part_is_finished_in_one_call(spark):
    import random

    rnd = random.Random(5)
    pairs = [(a + p * 100, b + p * 100, p) for p, n in ((1, 120), (2, 70), (3, 5)) for a, b in ((rnd.randrange(90), rnd.randrange(90)) for _ in range(n))] + [(i + 90, 90 + (i + 1) % 9, 0) for i in range(9)]
    e = spark.createDataFrame(pairs, "src bigint, dst bigint, p int")
    want = rows(strong_components(e), "v", "component")
    assert want
    for local in (40, 90):
        assert rows(strong_components(e, "p", local=local), "v", "component") == want


@pytest.mark.parametrize("n", [1, 2, 40])
def test_long_chain_is_one_component(spark, n):
    e = spark.createDataFrame([(i, i + 1) for i in range(n)], "a bigint, b bigint")
    assert connected_components(e).select("component").distinct().count() == 1
