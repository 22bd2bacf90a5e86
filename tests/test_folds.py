from lodestrata.operators.folds import chunked, coalesce_small, place_new, preorder, unique_names


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_coalesce_small(spark):
    df = spark.createDataFrame([("a", 0, 1, 10), ("a", 1, 2, 100), ("a", 2, 5, 10), ("a", 3, 1, 10), ("a", 4, 1, 10), ("b", 0, 1, 10)] + [("c", i, 2, 1) for i in range(8)] + [("d", 0, None, None)], "group_key string, pos int, members int, bytes int")
    got = rows(coalesce_small(df), "group_key", "pos", "merged_pos")
    assert got[:6] == [("a", 0, 0), ("a", 1, 0), ("a", 2, 2), ("a", 3, 3), ("a", 4, 3), ("b", 0, 0)]
    assert [m for g, _, m in got if g == "c"] == [0] * 6 + [6] * 2 and got[-1] == ("d", 0, 0)
    assert coalesce_small(df.limit(0)).count() == 0


def test_unique_names(spark):
    df = spark.createDataFrame([("s", 1, 0, "f"), ("s", 2, 0, "f"), ("s", 3, 1, "f_2"), ("s", 4, 0, "f_2"), ("t", 5, 0, "f"), ("s", 6, 0, None)], "scope string, id int, prio int, name string")
    got = {r.id: r.unique_name for r in unique_names(df).collect()}
    assert got[1] == "f" and got[5] == "f" and got[6] == "unnamed" and got[4] == "f_2"
    assert len({got[i] for i in (1, 2, 3, 4, 6)}) == 5


def test_place_preorder_chunk(spark):
    members = spark.createDataFrame([(1, "c1"), (2, "c2")], "v bigint, cluster string")
    edges = spark.createDataFrame([(1, 10), (2, 10), (10, 11), (12, 2), (13, 14)], "src bigint, dst bigint")
    added = spark.createDataFrame([(10,), (11,), (12,), (13,)], "v bigint")
    assert rows(place_new(members, edges, added), "v", "cluster") == [(10, "c1"), (11, "c1"), (12, "c2"), (13, "discovered")]
    m = spark.createDataFrame([("x", i) for i in (1, 2, 3, 4, 9)], "cluster string, v bigint")
    e = spark.createDataFrame([(1, 3), (3, 4), (1, 2), (4, 1)], "src bigint, dst bigint")
    assert [r.v for r in preorder(m, e).orderBy("pos").collect()][-1] in (4, 9)
    many = spark.createDataFrame([("y", i) for i in range(120)], "cluster string, v bigint")
    assert rows(chunked(many).groupBy("cluster").count(), "cluster", "count") == [("y_0", 50), ("y_1", 50), ("y_2", 20)]
