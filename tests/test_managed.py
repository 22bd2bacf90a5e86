"""Readers of managed and Android code on images that are put together here."""

import struct

import pytest

from lodestrata.functions.scalar import glob_pattern
from lodestrata.sources import managed as M
from lodestrata.sources.formats import bound_symbols, chained_imports, export_trie


def make_assembly():
    strings = b"\0Lib\0Core\0App\0Main\0Run\0WriteLine\0Console\0System\0<Module>\0a.dll\0"
    at = lambda s: strings.index(b"\0" + s.encode() + b"\0") + 1
    body = bytes([2 | 12 << 2]) + bytes([0x72, 1, 0, 0, 0x70, 0x28, 1, 0, 0, 0x0A, 0x2A, 0x00])
    rows = {
        0x00: struct.pack("<5H", 0, at("a.dll"), 1, 0, 0), 0x01: struct.pack("<3H", 1 << 2 | 2, at("Console"), at("System")),
        0x02: struct.pack("<I5H", 0, at("<Module>"), 0, 0, 1, 1) + struct.pack("<I5H", 1, at("Main"), at("App"), 0, 1, 1),
        0x06: struct.pack("<IHHHHH", 0x2100, 0, 6, at("Run"), 0, 1), 0x0A: struct.pack("<3H", 1 << 3 | 1, at("WriteLine"), 0),
        0x20: struct.pack("<I4HI3H", 0, 1, 2, 3, 4, 0, 0, at("Lib"), 0), 0x23: struct.pack("<4HI4H", 6, 0, 0, 0, 0, 0, at("Core"), 0, 0),
    }
    counts = {k: {0x02: 2}.get(k, 1) for k in rows}
    tables = struct.pack("<IBBBBQQ", 0, 2, 0, 0, 1, sum(1 << k for k in rows), 0) + b"".join(struct.pack("<I", counts[k]) for k in sorted(rows)) + b"".join(rows[k] for k in sorted(rows))
    tables += b"\0" * (-len(tables) % 4)
    names = [(b"#~\0\0", tables), (b"#Strings\0\0\0\0", strings + b"\0" * (-len(strings) % 4))]
    head = b"BSJB" + struct.pack("<HHII", 1, 1, 0, 12) + b"v4.0.30319\0\0" + struct.pack("<HH", 0, len(names))
    start = len(head) + sum(8 + len(n) for n, _ in names)
    for n, d in names:
        head += struct.pack("<II", start, len(d)) + n
        start += len(d)
    meta = head + b"".join(d for _, d in names)
    text = bytearray(0x1000)
    text[0:72] = struct.pack("<IHHII", 72, 2, 5, 0x2200, len(meta)) + struct.pack("<II", 1, 0x06000001) + b"\0" * 48
    text[0x100 : 0x100 + len(body)] = body
    text[0x200 : 0x200 + len(meta)] = meta
    pe = bytearray(0x200)
    pe[0:2], pe[0x3C:0x40] = b"MZ", struct.pack("<I", 0x80)
    pe[0x80:0x98] = b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 1, 0, 0, 0, 224, 0x2102)
    pe[0x98:0x9A] = struct.pack("<H", 0x10B)
    pe[0x98 + 96 + 8 * 14 : 0x98 + 96 + 8 * 15] = struct.pack("<II", 0x2000, 72)
    pe[0x178 : 0x178 + 40] = b".text\0\0\0" + struct.pack("<8I", 0x1000, 0x2000, 0x1000, 0x200, 0, 0, 0, 0)
    return bytes(pe) + bytes(text)


def test_assembly():
    a = M.assembly(make_assembly())
    assert (a["name"], a["version"], a["entry_point"], a["runtime"], a["il_only"], a["ready_to_run"]) == ("Lib", "1.2.3.4", 0x06000001, "v4.0.30319", True, False)
    assert a["references"] == [("Core", "6.0.0.0")]
    assert a["types"] == [(0x02000001, "", "<Module>", None), (0x02000002, "App", "Main", None)]
    assert a["methods"] == [(0x06000001, 0x02000002, "Run", 6)] and a["members"] == [(0x0A000001, "System.Console", "WriteLine")]
    assert a["uses"] == [(0x06000001, "string", 0x70000001), (0x06000001, "call", 0x0A000001)]
    assert M.input_kind("x.dll", make_assembly()) == "assembly" and M.input_kind("x.nupkg", b"") == "nupkg" and M.input_kind("x", b"") is None


def test_rows_of_files(spark):
    data = make_assembly()
    df = spark.createDataFrame([("a.dll", bytearray(data)), ("cut.dll", bytearray(data[:0x500])), ("text", bytearray(b"hello")), ("none", None)], "path string, content binary")
    got = {r.path: r for r in M.rows(df.where("content is not null")).collect()}
    assert set(got) == {"a.dll", "cut.dll"} and got["a.dll"].uses[1].token == 0x0A000001 and got["cut.dll"].notes
    assert M.rows(df.limit(0)).count() == 0


def test_instructions_of_cil():
    assert M.il_tokens(bytes([0x45, 1, 0, 0, 0, 9, 9, 9, 9, 0xFE, 0x06, 5, 0, 0, 6, 0xFE, 0x0E, 1, 0, 0x1F, 7, 0x7B, 1, 0, 0, 4, 0x24, 0x28, 0, 0, 0, 0])) == [("token", 0x06000005), ("field", 0x04000001)]
    assert M.il_tokens(bytes([0x28, 1])) == [] and M.il_tokens(b"") == [] and M.il_tokens(bytes([0x45, 255, 255, 255, 255])) == []
    fat = struct.pack("<HHII", 0x3003, 8, 2, 0) + b"\0*rest"
    assert M.method_body(b"x" + fat, 1) == b"\0*"
    with pytest.raises(ValueError):
        M.method_body(b"\0", 0)


def test_bundle():
    name = b"\x05a.dll"
    head = struct.pack("<IIi", 6, 0, 1) + b"\x02id" + b"\0" * 40 + struct.pack("<qqq", 10, 20, 0) + b"\x01" + name
    data = b"MZ" + b"\0" * 98 + head
    data += struct.pack("<q", 100) + M.BUNDLE_MARK
    assert M.bundle(data) == [("a.dll", 1, 10, 20, 0)]
    assert M.bundle(b"MZ") == []


def test_instructions_of_dalvik():
    code = bytes([0x1A, 0, 3, 0, 0x6E, 0x10, 7, 0, 0, 0, 0x1B, 0, 1, 0, 1, 0, 0x52, 0x10, 4, 0, 0x22, 0, 2, 0, 0x0E, 0, 0, 1, 0x6E, 0, 9, 0, 0, 0])
    assert M.dex_references(code) == [("string", 3), ("method", 7), ("string", 0x10001), ("field", 4), ("type", 2)]
    assert M.dex_references(b"") == [] and M.dex_references(bytes([0x6E, 0x10, 7, 0])) == []


def test_manifest():
    m = M.manifest('<manifest xmlns:android="http://schemas.android.com/apk/res/android" package="com.app" android:versionCode="3"><uses-sdk android:minSdkVersion="21"/><uses-permission android:name="android.permission.CAMERA"/><application android:name=".App"><activity android:name=".Main"><intent-filter/></activity><service android:name=".S" android:exported="false"/></application></manifest>')
    assert m["package"] == "com.app" and m["min_sdk"] == "21" and m["permissions"] == ["android.permission.CAMERA"]
    assert m["components"] == [("application", ".App", False, None), ("activity", ".Main", True, None), ("service", ".S", False, None)]
    assert M.manifest("<a>")["parse_error"] and M.manifest("")["parse_error"]
    assert M.apk_members(["split_config.en.apk", "b.apk", "base.apk", "x/y.apk", "a.txt"]) == ["base.apk", "b.apk", "split_config.en.apk"]


def test_bind_tables_of_mach_o():
    code = b"\x11\x40_puts\0\x51\x72\x10\x90\x3e\x41_env\0\x90\x90\x00\x12\x40_late\0\x90"
    assert bound_symbols(code) == [("_puts", 1, False), ("_env", -2, True)]
    assert bound_symbols(b"\x11\x40_a\0\x90\x00\x12\x40_b\0\x90\x00", lazy=True) == [("_a", 1, False), ("_b", 2, False)]
    table = struct.pack("<7I", 0, 0, 28, 36, 2, 1, 0) + struct.pack("<II", 1 | 1 << 9, 0xFE | 1 << 8 | 7 << 9) + b"\0_puts\0_env\0"
    assert chained_imports(table, "<") == [("_puts", 1, False), ("_env", -2, True)]


def test_export_trie_absolute_reexport_and_loop():
    assert export_trie(bytes([0, 1]) + b"_a\0" + bytes([6, 2, 2, 0x10, 0]), 0x1000) == [("_a", 0x10, None, None, False)]
    assert export_trie(bytes([0, 1]) + b"_a\0" + bytes([6, 5, 8, 2]) + b"_b\0" + bytes([0]), 0x1000) == [("_a", None, 2, "_b", False)]
    assert export_trie(bytes([0, 1]) + b"_a\0" + bytes([0]), 0) == []


def test_globs():
    import re

    cases = {"a[0-9].c": ("a1.c", "ab.c"), "./lib/*.c": ("lib/x.c", "lib/y/x.c"), "[!a]b": ("cb", "ab"), "x[]]": ("x]", "xy"), "**/t?.h": ("a/b/t1.h", "t.h")}
    for pattern, (yes, no) in cases.items():
        assert re.match(glob_pattern(pattern), yes), pattern
        assert not re.match(glob_pattern(pattern), no), pattern
