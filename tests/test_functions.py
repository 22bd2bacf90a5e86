import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import scalar as S
from lodestrata.session import ensure_checkpoint_dir
from lodestrata.streaming import editlog, windows


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("x", "y"), [("a b--c", "a_b_c"), ("__x__", "x"), ("é", "unnamed"), ("", "unnamed"), (None, "unnamed"), ("a_ b", "a__b")])
def test_clean_path_component(spark, x, y):
    assert one(spark, x, S.clean_path_component) == y


@pytest.mark.parametrize("x", ["printf", "_printf", "__imp_printf", "sym.imp.printf", "printf@@GLIBC_2.2", "__imp__printf@8"])
def test_link_key(spark, x):
    assert one(spark, x, S.link_key) == "printf"


def test_link_key_of_underscores(spark):
    assert one(spark, "__", S.link_key) == "__"


@pytest.mark.parametrize(("x", "y"), [("int f(char *a)", ("int", "f", "char *a")), ("f(void)", ("undefined8", "f", "void")), ("char **g()", ("char **", "g", "")), ("no parens", None), (None, None)])
def test_prototype(spark, x, y):
    got = one(spark, x, S.prototype_parts)
    assert (tuple(got) if got else None) == y


@pytest.mark.parametrize(("a", "b"), [("unsigned int", "uint32_t"), ("const char *", "char*"), ("_BOOL8", "bool"), ("struct  ctx *", "ctx*")])
def test_normal_type(spark, a, b):
    assert one(spark, a, S.normal_type) == one(spark, b, S.normal_type)


def test_hex_round_trip(spark):
    from decimal import Decimal

    top = Decimal(2**64 - 1)
    assert one(spark, top, S.hex_address, "decimal(20,0)") == "0xffffffffffffffff"
    assert one(spark, "0xffffffffffffffff", S.parse_hex) == top
    assert one(spark, "zz", S.parse_hex) is None


def test_globs(spark):
    df = spark.createDataFrame([("a/b/lib/x.c",), ("lib/x.c",), ("lib/y/x.c",), ("x.c",), (None,)], "p string")
    assert [r.m for r in df.select(S.path_matches(F.col("p"), ["**/lib/*.c"]).alias("m")).collect()] == [True, True, False, False, None]
    assert [r.m for r in df.select(S.path_matches(F.col("p"), ["x.*"]).alias("m")).collect()][:4] == [True] * 4


def test_entropy_and_flags(spark):
    assert one(spark, "aabb", S.shannon_entropy) == 1.0
    assert one(spark, "", S.shannon_entropy) is None
    assert one(spark, None, S.shannon_entropy) is None
    assert one(spark, 5, lambda c: S.flag_names(c, [(1, "public"), (2, "private"), (4, "static")]), "int") == ["public", "static"]


def test_text_search_of_a_bad_pattern(spark):
    assert one(spark, "A(B", lambda c: S.search(c, "a(b")) is True


def test_edit_log(spark, tmp_path):
    ensure_checkpoint_dir(spark)
    log, state = tmp_path / "log", tmp_path / "state"
    log.mkdir()
    put = lambda n, *es: (log / f"{n}.json").write_text("".join(json.dumps(e) + "\n" for e in es))
    base = {"assembly": "A", "token": 1, "name": None, "old": None, "text": None}
    put(1, base | {"seq": 1, "op": "comment", "text": "x"}, base | {"seq": 2, "op": "rename", "old": "a", "name": "b"})
    assert editlog.replay(spark, str(log), str(state)) == 2
    put(2, base | {"seq": 3, "op": "comment", "text": "y"}, base | {"seq": 4, "op": "comment", "token": 2, "text": ""}, base | {"seq": 5, "op": "rename", "old": "b", "name": "c"})
    assert editlog.replay(spark, str(log), str(state)) == 5
    assert editlog.replay(spark, str(log), str(state)) == 5
    s = editlog.state(spark, str(state))
    assert [tuple(r) for r in editlog.comments(s).collect()] == [("A", 1, "y")]
    assert [tuple(r) for r in editlog.renames(s).orderBy("pos").collect()] == [("A", 1, 1, "a", "b"), ("A", 1, 2, "b", "c")]
    assert editlog.pending(s, 4).count() == 1


def test_windows_drop_late_events(spark, tmp_path):
    ensure_checkpoint_dir(spark)
    schema = "event_id int, ts timestamp, user_id int, event_type string, value double"
    at = lambda h, m: dt.datetime(2025, 1, 1, h, m)
    for i, part in enumerate([[(1, at(1, 5), 1, "a", 1.0), (2, at(1, 50), 1, "a", 2.0)], [(3, at(4, 0), 1, "a", 5.0)], [(6, at(4, 5), 1, "a", 5.0)], [(4, at(1, 10), 1, "a", 9.0), (5, at(7, 0), 1, "a", 1.0)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={i}"))
    out = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = windows.tumbling(stream).writeStream.outputMode("append").foreachBatch(lambda b, _: out.extend((r.start_at.hour, r.n, r.total) for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(out)[:1] == [(1, 2, 3.0)]
