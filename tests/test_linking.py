import pytest

from lodestrata.operators.graph import strong_components
from lodestrata.operators.linking import load_order, resolve

SCHEMA = "path string, format string, arch string, kind string, libraries array<struct<name:string,kind:string>>, rpaths array<string>, runpaths array<string>"


def image(path, fmt, libs=(), rpaths=(), runpaths=(), kind="library", arch="x86_64"):
    return (path, fmt, arch, kind, [(x, "needed") for x in libs], list(rpaths), list(runpaths))


def edges(spark, rows):
    return {(r.importer, r.library): (r.target, r.status) for r in resolve(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_elf_rpath_is_inherited_and_runpath_is_not(spark):
    inherit = [image("bin/app", "elf", ["liba.so"], rpaths=["$ORIGIN/../lib"], kind="executable"), image("lib/liba.so", "elf", ["libb.so", "libc.so.6"]), image("lib/libb.so", "elf")]
    got = edges(spark, inherit)
    assert got == {("bin/app", "liba.so"): ("lib/liba.so", "in_folder"), ("lib/liba.so", "libb.so"): ("lib/libb.so", "in_folder"), ("lib/liba.so", "libc.so.6"): (None, "external")}
    own = [image("bin/app", "elf", ["liba.so"], runpaths=["$ORIGIN/../lib"], kind="executable"), *inherit[1:]]
    assert edges(spark, own)["lib/liba.so", "libb.so"] == ("lib/libb.so", "name_match_unreachable")


def test_pe_and_macho(spark):
    rows = [image("App/main.exe", "pe", ["DEP.dll", "kernel32.dll"], kind="executable"), image("App/dep.dll", "pe", ["Old.dll"]), image("App/old.dll", "pe", arch="x86"), image("m/run", "macho", ["@rpath/libx.dylib", "@loader_path/liby.dylib"], rpaths=["@executable_path/../f"], kind="executable"), image("f/libx.dylib", "macho"), image("m/liby.dylib", "macho")]
    got = edges(spark, rows)
    assert got["App/main.exe", "DEP.dll"] == ("App/dep.dll", "in_folder") and got["App/main.exe", "kernel32.dll"][1] == "external"
    assert got["App/dep.dll", "Old.dll"] == ("App/old.dll", "arch_mismatch")
    assert got["m/run", "@rpath/libx.dylib"] == ("f/libx.dylib", "in_folder") and got["m/run", "@loader_path/liby.dylib"] == ("m/liby.dylib", "in_folder")


@pytest.mark.parametrize("n", [3])
def test_cycles_and_load_order(spark, n):
    rows = [image("bin/app", "elf", ["liba.so"], rpaths=["$ORIGIN"], kind="executable"), image("bin/liba.so", "elf", ["libb.so"]), image("bin/libb.so", "elf", ["liba.so"])]
    e = resolve(spark.createDataFrame(rows, SCHEMA))
    assert {(r.target, r.level) for r in load_order(e).collect()} == {("bin/liba.so", 0), ("bin/libb.so", 1)}
    ids = {"bin/app": 0, "bin/liba.so": 1, "bin/libb.so": 2}
    pairs = [(ids[r.importer], ids[r.target]) for r in e.collect()]
    assert {r.v for r in strong_components(spark.createDataFrame(pairs, "src bigint, dst bigint")).collect()} == {1, 2}
    assert resolve(spark.createDataFrame(rows[1:], SCHEMA)).count() == 0
