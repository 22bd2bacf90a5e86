import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as X


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_rewrite(spark):
    f = X.rewriter(spark, {"sub_1": "main", "sub_10": "helper"})
    assert one(spark, "\x1b[31msub_1\x1b[0m(sub_10, xsub_1, sub_1_)", f) == "main(helper, xsub_1, sub_1_)"
    assert one(spark, None, f) is None
    with pytest.raises(ValueError):
        X.rewriter(spark, {"a": "b", "c": "d"}, most=1)


def test_source_and_names(spark):
    assert one(spark, "\n\nWARNING: x\nint a;  \n}\n\n", X.normal_source) == "int a;\n}"
    assert one(spark, "a/b_c.é;[", X.jni_name) == "a_b_1c__000e9_2_3"
    assert [one(spark, d, X.java_type) for d in ("I", "[[J", "Ljava/lang/String;", "[Lx/A$B;", None)] == ["int", "long[][]", "java.lang.String", "x.A.B[]", None]


def test_components_and_bytes(spark):
    df = spark.createDataFrame([("p.q", ".A"), ("p.q", "B"), ("p.q", "r.C")], "p string, n string")
    assert [r.c for r in df.select(X.component_class(F.col("p"), F.col("n")).alias("c")).collect()] == ["p.q.A", "p.q.B", "r.C"]
    assert one(spark, bytearray(b"aaab"), X.find_bytes(b"aa"), "binary") == [0, 1]
    assert one(spark, bytearray(b"abc"), lambda c: X.read_bytes(c, 1, 4, F.lit(5)), "binary") == bytearray(b"bc\0\0")
    assert one(spark, bytearray(b"abc"), lambda c: X.read_bytes(c, 9, 4, F.lit(5)), "binary") == bytearray(b"")
