"""Sinks, source texts and registered functions."""

import json
import os

from pyspark.sql import functions as F

from lodestrata.functions.extend import register
from lodestrata.functions.source import annotated, arity, edited, il_ranges, java_ranges, noted, strip_notes, symbol_name
from lodestrata.sources import sinks


def test_json_rows_replace_what_was_there(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, [1])], "id int, name string, xs array<int>")
    for _ in range(2):
        assert sinks.json_rows(df, f"{tmp_path}/rows") == 2
    assert not [x for x in os.listdir(tmp_path) if x.endswith(".tmp")]
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/rows").collect()) == ['{"id":1,"name":"a"}', '{"id":2,"xs":[1]}']
    assert sinks.json_rows(df.limit(0), f"{tmp_path}/none") == 0


def test_document_is_one_object(spark, tmp_path):
    sinks.document(spark.createDataFrame([(1, "ü")], "id int, name string"), f"{tmp_path}/doc")
    text = "".join(open(f"{tmp_path}/doc/{f}").read() for f in os.listdir(f"{tmp_path}/doc") if f.startswith("part"))
    assert json.loads(text) == {"id": 1, "name": "ü"}


def test_cluster_texts_and_their_lines(spark, tmp_path):
    m = spark.createDataFrame([("a", 1, "x\ny"), ("a", 0, "p"), ("a", 2, None), ("b", 0, "q")], "cluster string, pos int, text string")
    got = {(r.cluster, r.pos): (r.first_line, r.last_line) for r in sinks.cluster_texts(m, f"{tmp_path}/t").collect()}
    assert got == {("a", 0): (1, 1), ("a", 1): (4, 5), ("a", 2): (None, None), ("b", 0): (1, 1)}
    [part] = [f for f in os.listdir(f"{tmp_path}/t/cluster=a") if f.startswith("part")]
    lines = open(f"{tmp_path}/t/cluster=a/{part}").read().split("\n")
    assert lines[0] == "p" and lines[3:5] == ["x", "y"]


def test_header_manifest_and_sections(spark, tmp_path):
    p = spark.createDataFrame([("int b(void);",), ("int a(void)",), (None,), ("int a(void)",)], "prototype string")
    t = spark.createDataFrame([("typedef", "z", "typedef int z;"), ("struct", "s", "struct s;"), ("base", "b", "typedef char b;"), ("struct", None, "x")], "kind string, name string, c_decl string")
    sinks.header(p, t, f"{tmp_path}/h")
    names = sorted(f for f in os.listdir(f"{tmp_path}/h") if f.startswith("part"))
    lines = "".join(open(f"{tmp_path}/h/{f}").read() for f in names).split("\n")
    assert lines[0] == "#pragma once" and lines[3:8] == ["typedef char b;", "struct s;", "typedef int z;", "int a(void);", "int b(void);"]
    sinks.manifest(spark.createDataFrame([("x", None), ("x", "bad")], "g string, failure string"), f"{tmp_path}/m", "g")
    assert spark.read.json(f"{tmp_path}/m").collect()[0].asDict() == {"g": "x", "rows": 2, "failures": 1}
    sinks.sections(spark.createDataFrame([(".a", "r--", b"\0\1"), ("", "r--", b"x")], "name string, perms string, content binary"), f"{tmp_path}/s")
    assert [(r.name, r.entropy) for r in spark.read.parquet(f"{tmp_path}/s").collect()] == [(".a", 1.0)]


def test_annotation_of_a_source(spark):
    df = spark.createDataFrame([("int f()\n{\n}",), ("no body",)], "s string")
    got = [r[0] for r in df.select(annotated(F.col("s"), F.lit("f"), F.lit("0x10"))).collect()]
    assert got == ["int f()\n{\n    /* f @ 0x10; recovered address annotation. */\n\n}", "/* f @ 0x10 */\nno body"]


def test_symbol_names():
    want = {"_ZN3Foo3barEv": "Foo::bar", "_ZNK3Foo3barEv": "Foo::bar", "_ZN3FooC1Ev": "Foo::Foo", "_ZN3FooD2Ev": "Foo::~Foo", "_Z6launchi": "launch", "_Z3abc": None, "_ZN1AIiE1bEv": None, "printf": None, "": None, "_ZNSt6vectorE": "std::vector", None: None}
    assert {k: symbol_name(k) for k in want} == want


def test_ranges_of_methods():
    assert il_ranges(".method /* 06000001 */ A\n{\n} // end of method A\nx\n.method /*06000002*/ B\n} // end of method B\n") == [{"token": 0x06000001, "first": 1, "last": 3}, {"token": 0x06000002, "first": 5, "last": 6}]
    java = "class A {\n    @Override\n    public int f(int a, Map<K, V> b) {\n        return 1;\n    }\n    int f();\n    void g(int[] x) {\n    }\n}"
    assert java_ranges(java, [(1, "f", 0), (2, "f", 2), (3, "g", 1), (4, "h", 0)]) == {2: (2, 5), 1: (6, 6), 3: (7, 8)}
    assert [arity(x) for x in ("", "int a", "Map<K, V> b, int c", "f(a, b), c")] == [0, 1, 2, 2]


def test_edits_move_ranges():
    text, ranges = edited("a\n  int x = xx;\n}\nb", {1: (2, 3), 2: (4, 4)}, {1: [("x", "y")], 9: [("a", "b")]}, {2: "one\ntwo", 7: "gone"})
    assert text == "a\n  int y = xx;\n}\n// one\n// two\nb" and ranges == {1: (2, 3), 2: (4, 6)}
    text, ranges = edited("a\n  b\nc", {1: (2, 2), 2: (3, 3)}, {}, {1: "note"})
    assert text == "a\n  // note\n  b\nc" and ranges == {1: (2, 3), 2: (4, 4)}


def test_notes_stay_on_their_lines():
    text = 'call(a);\nprintf("call");\n/* call\ncall */ x();\ncall(b); // call'
    once = noted(text, [(1, 9, "call", "to */ f"), (1, 1, "call", "g"), (1, 1, "a", "h"), (1, 1, "a", "i")])
    assert once.split("\n") == ["call(a); /* link: to * / f */ /* link: g */ /* link: h */ /* link: 1 more */", 'printf("call");', "/* call", "call */ x();", "call(b); // call /* link: to * / f */"]
    assert noted(once, [(1, 9, "call", "to */ f"), (1, 1, "call", "g"), (1, 1, "a", "h"), (1, 1, "a", "i")]) == once
    assert "\n".join(map(strip_notes, once.split("\n"))) == text


def test_registered_functions(spark):
    register(spark)
    assert [tuple(r) for r in spark.sql("select * from printable_runs('ab\\u0001cdef', 3)").collect()] == [(3, "cdef")]
    assert spark.sql("select entropy_of_values(x) as e from values (1), (1), (2), (2) as t(x)").first().e == 1.0
