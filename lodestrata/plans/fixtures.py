"""Small tables of linked files, managed assemblies and Android packages, for queries whose input the test data doesn't hold.

Each is given once; ``frame`` makes a DataFrame of it and ``cte`` the same rows as SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

SQL_TYPES = {"string": "varchar", "int": "int", "bigint": "bigint", "boolean": "boolean", "array<string>": "varchar[]"}


def _literal(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, list):
        return "[" + ", ".join(_literal(x) for x in v) + "]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


@dataclass(frozen=True)
class Fixture:
    name: str
    schema: str
    rows: tuple[tuple, ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    @property
    def cte(self) -> str:
        cols = [c.strip().rsplit(" ", 1) for c in self.schema.split(",")]
        values = ", ".join("(" + ", ".join(_literal(v) for v in r) + ")" for r in self.rows)
        return f"{self.name} as (select {', '.join(f'cast({n} as {SQL_TYPES[t]}) as {n}' for n, t in cols)} from (values {values}) as t({', '.join(n for n, _ in cols)}))"


def _f(name: str, schema: str, *rows: tuple) -> Fixture:
    return Fixture(name, schema, rows)


N = None
EDGES = _f(
    "edges", "path string, lib_idx int, target string, status string",
    ("bin/app", 0, "lib/liba.so", "in_folder"), ("bin/app", 1, "lib/libb.so", "in_folder"), ("bin/app", 2, "other/libc2.so", "name_match_unreachable"), ("bin/app", 3, N, "external"), ("bin/app", 4, "lib/libold.so", "arch_mismatch"), ("lib/liba.so", 0, "lib/libb.so", "in_folder"),
    ("App.exe", 0, "core.dll", "in_folder"), ("App.exe", 1, N, "apiset"), ("App.exe", 2, "sub/extra.dll", "name_match_unreachable"),
    ("Main", 0, "Frame", "in_folder"), ("Main", 1, "Umbrella", "in_folder"), ("Main", 2, N, "system"), ("Umbrella", 0, "PartA", "in_folder"), ("Umbrella", 1, "PartB", "in_folder"), ("PartA", 0, "Umbrella", "in_folder"), ("PartA", 1, "Deep", "in_folder"), ("Frame", 0, "PartB", "in_folder"), ("Frame", 1, N, "system"),
    ("Web.dll", 0, "Lib.dll", "in_folder"), ("Web.dll", 1, N, "framework"), ("Web.dll", 2, "Gone.dll", "in_folder"), ("Web.dll", 5, "native.dll", "in_folder"), ("Web.dll", 5, "libnative.dylib", "in_folder"), ("Web.dll", 6, N, "external"), ("Web.dll", 7, "libplain.so", "in_folder"),
)
IMPORTS = _f(
    "syms", "path string, imp_ord int, name string, lib_idx int, special string, ordinal int, version string, charset string, signature string, owner string, kind string",
    ("bin/app", 0, "open_v", 0, N, N, "V2", N, N, N, N), ("bin/app", 1, "open_v", 0, N, N, "V9", N, N, N, N), ("bin/app", 2, "plain", 0, N, N, "V9", N, N, N, N), ("bin/app", 3, "shared", N, N, N, N, N, N, N, N), ("bin/app", 4, "nowhere", N, N, N, N, N, N, N, N), ("bin/app", 5, "far", 2, N, N, "V1", N, N, N, N),
    ("bin/app", 6, "x", 3, N, N, "V1", N, N, N, N), ("bin/app", 7, "x", 4, N, N, "V1", N, N, N, N), ("bin/app", 8, "x", 9, N, N, "V1", N, N, N, N), ("lib/liba.so", 0, "shared", N, N, N, N, N, N, N, N), ("bin/app", 3, "shared", N, N, N, N, N, N, N, N), ("bin/app", 9, N, N, N, N, N, N, N, N, N),
    ("App.exe", 0, "Run", 0, N, N, N, N, N, N, N), ("App.exe", 1, "#7", 0, N, 7, N, N, N, N, N), ("App.exe", 2, "Fwd", 0, N, N, N, N, N, N, N), ("App.exe", 3, "ToSet", 0, N, N, N, N, N, N, N), ("App.exe", 4, "ToSys", 0, N, N, N, N, N, N, N), ("App.exe", 5, "ToGone", 0, N, N, N, N, N, N, N),
    ("App.exe", 6, "Loop", 0, N, N, N, N, N, N, N), ("App.exe", 7, "None", 0, N, N, N, N, N, N, N), ("App.exe", 8, "Any", 1, N, N, N, N, N, N, N), ("App.exe", 9, "Extra", 2, N, N, N, N, N, N, N), ("App.exe", 10, "ToOrd", 0, N, N, N, N, N, N, N),
    ("Main", 0, "_draw", 0, N, N, N, N, N, N, N), ("Main", 1, "_part", 1, N, N, N, N, N, N, N), ("Main", 2, "_both", 1, N, N, N, N, N, N, N), ("Main", 3, "_none", 1, N, N, N, N, N, N, N), ("Main", 4, "_own", N, "self", N, N, N, N, N, N), ("Main", 5, "_weak", N, "weak_lookup", N, N, N, N, N, N), ("Main", 6, "_flat", N, "flat_lookup", N, N, N, N, N, N),
    ("Frame", 0, "_own", N, "main_executable", N, N, N, N, N, N), ("Main", 7, "_renamed", 0, N, N, N, N, N, N, N), ("Main", 8, "_sys", 0, N, N, N, N, N, N, N), ("Main", 9, "_x", 2, N, N, N, N, N, N, N), ("Main", 10, "_deep", 1, N, N, N, N, N, N, N),
    ("Web.dll", 0, "Load", 0, N, N, N, N, "(string)int", "Lib.A", "code"), ("Web.dll", 1, "Load", 0, N, N, N, N, "(int)int", "Lib.A", "code"), ("Web.dll", 2, "Moved", 0, N, N, N, N, "()void", "Lib.Old", "code"), ("Web.dll", 3, "Count", 0, N, N, N, N, "int", "Lib.A", "data"), ("Web.dll", 4, "Lost", 0, N, N, N, N, "()void", "Lib.A", "code"),
    ("Web.dll", 5, "Away", 0, N, N, N, N, "()void", "Lib.Away", "code"), ("Web.dll", 6, "Write", 1, N, N, N, N, "()void", "System.C", "code"), ("Web.dll", 7, "Gone", 2, N, N, N, N, "()void", "G.X", "code"),
    ("Web.dll", 20, "Beep", 5, N, N, N, "unicode", N, N, "pinvoke"), ("Web.dll", 21, "Beep", 5, N, N, N, "exact", N, N, "pinvoke"), ("Web.dll", 22, "Ansi", 5, N, N, N, N, N, N, "pinvoke"), ("Web.dll", 23, "#3", 5, N, N, N, "exact", N, N, "pinvoke"), ("Web.dll", 24, "Beep", 6, N, N, N, N, N, N, "pinvoke"), ("Web.dll", 25, "Beep", 7, N, N, N, "unicode", N, N, "pinvoke"),
)
EXPORTS = _f(
    "exps", "path string, exp_ord int, name string, address bigint, ordinal int, forwarder string, reexport_lib int, reexport_name string, version string, default_version boolean, weak boolean, signature string",
    ("lib/liba.so", 0, "open_v", 256, N, N, N, N, "V1", False, False, N), ("lib/liba.so", 1, "open_v", 272, N, N, N, N, "V2", True, False, N), ("lib/liba.so", 2, "plain", 288, N, N, N, N, N, N, False, N), ("lib/liba.so", 3, "shared", 304, N, N, N, N, N, N, True, N), ("lib/libb.so", 0, "shared", 512, N, N, N, N, N, N, False, N),
    ("other/libc2.so", 0, "far", 528, N, N, N, N, "V1", True, False, N), ("bin/app", 0, "shared", 16, N, N, N, N, N, N, False, N), (N, 0, N, N, N, N, N, N, N, N, N, N),
    ("core.dll", 0, "Run", 4096, 1, N, N, N, N, N, False, N), ("core.dll", 1, "Seven", 4112, 7, N, N, N, N, N, False, N), ("core.dll", 2, "Again7", 4113, 7, N, N, N, N, N, False, N), ("core.dll", 3, "Fwd", N, 2, "EXTRA.Target", N, N, N, N, False, N), ("core.dll", 4, "ToSet", N, 3, "api-ms-win-core-x.Any", N, N, N, N, False, N), ("core.dll", 5, "ToSys", N, 4, "KERNEL32.Beep", N, N, N, N, False, N),
    ("core.dll", 6, "ToGone", N, 5, "absent.Any", N, N, N, N, False, N), ("core.dll", 7, "Loop", N, 6, "extra.Loop", N, N, N, N, False, N), ("core.dll", 8, "ToOrd", N, 8, "extra.#2", N, N, N, N, False, N), ("sub/extra.dll", 0, "Target", 8192, 1, N, N, N, N, N, False, N), ("sub/extra.dll", 1, "Loop", N, 9, "core.Loop", N, N, N, N, False, N), ("sub/extra.dll", 2, "Extra", 8200, 2, N, N, N, N, N, False, N),
    ("Frame", 0, "_draw", 64, N, N, N, N, N, N, False, N), ("Frame", 1, "_renamed", N, N, N, 0, "_real", N, N, False, N), ("Frame", 2, "_sys", N, N, N, 1, N, N, N, False, N), ("Umbrella", 0, "_head", 65, N, N, N, N, N, N, False, N), ("PartA", 0, "_both", 66, N, N, N, N, N, N, False, N), ("PartB", 0, "_both", 67, N, N, N, N, N, N, False, N), ("PartB", 1, "_part", 68, N, N, N, N, N, N, False, N), ("PartB", 2, "_real", 69, N, N, N, N, N, N, False, N),
    ("Deep", 0, "_deep", 70, N, N, N, N, N, N, False, N), ("PartB", 3, "_deep", 71, N, N, N, N, N, N, False, N), ("Main", 0, "_own", 72, N, N, N, N, N, N, False, N), ("Frame", 3, "_weak", 73, N, N, N, N, N, N, True, N), ("PartA", 1, "_weak", 74, N, N, N, N, N, N, False, N), ("Frame", 4, "_flat", 75, N, N, N, N, N, N, True, N), ("PartA", 2, "_flat", 76, N, N, N, N, N, N, False, N),
    ("Lib.dll", 0, "Load", N, N, N, N, N, N, N, False, "(string)int"), ("Lib.dll", 1, "Load", N, N, N, N, N, N, N, False, "(bool)int"), ("New.dll", 0, "Moved", N, N, N, N, N, N, N, False, "()void"), ("native.dll", 0, "BeepW", 90, 3, N, N, N, N, N, False, N), ("native.dll", 1, "Beep", 91, 4, N, N, N, N, N, False, N), ("native.dll", 2, "AnsiA", 92, 5, N, N, N, N, N, False, N), ("libnative.dylib", 0, "_Beep", 93, N, N, N, N, N, N, False, N), ("libplain.so", 0, "Beep", 94, N, N, N, N, N, N, False, N),
)
SCOPE = _f(
    "scope", "path string, pos int, image string",
    *[(p, k, x) for p in ("bin/app", "lib/liba.so", "lib/libb.so") for k, x in enumerate(("bin/app", "lib/liba.so", "lib/libb.so"))], *[(p, k, x) for p in ("App.exe", "core.dll", "sub/extra.dll") for k, x in enumerate(("App.exe", "core.dll", "sub/extra.dll"))], *[(p, k, x) for p in ("Main", "Frame") for k, x in enumerate(("Main", "Frame", "Umbrella", "PartA", "PartB", "Deep"))],
)
REEXPORTS = _f("reexports", "path string, lib_idx int", ("Umbrella", 0), ("Umbrella", 1), ("PartA", 0), ("PartA", 1))
MAINS = _f("mains", "path string, main string", ("Frame", "Main"), ("Main", "Main"))
FORWARDERS = _f("forwarders", "path string, owner string, assembly string", ("Lib.dll", "Lib.Old", "New"), ("Lib.dll", "Lib.Away", "Absent"))
ASSEMBLIES = _f("assemblies", "assembly string, path string", ("New", "New.dll"), ("New", "zz/New.dll"), ("Lib", "Lib.dll"))
FORMATS = _f("formats", "path string, format string", ("native.dll", "pe"), ("libnative.dylib", "macho"), ("libplain.so", "elf"))

TYPES = _f(
    "types", "assembly int, token int, full_name string, namespace string, name string, visibility string, declaring int, compiler_generated boolean",
    (0, 1, "<Module>", "", "<Module>", "NotPublic", N, False), (0, 2, "Lib.A", "Lib", "A", "Public", N, False), (0, 3, "Lib.A+In", "Lib", "In", "NestedPublic", 2, False), (0, 4, "Lib.A+Hid", "Lib", "Hid", "NestedPrivate", 2, False), (0, 5, "Lib.A+Hid+Deep", "Lib", "Deep", "NestedPublic", 4, False), (0, 6, "Lib.A+<>c", "Lib", "<>c", "NestedPrivate", 2, True), (0, 7, "Lib.A+<Run>d__1", "Lib", "<Run>d__1", "NestedPrivate", 2, True), (0, 8, "Lib.B", "Lib", "B", "NotPublic", N, False), (1, 2, "App.Main", "App", "Main", "Public", N, False), (1, 3, "App.Tool", "App", "Tool", "Public", N, False),
)
METHODS = _f(
    "methods", "id int, assembly int, token int, type_token int, name string, public boolean, is_virtual boolean, is_constructor boolean, unmanaged_entry boolean, compiler_generated boolean, state_machine int, pinvoke_module string, pinvoke_entry string",
    (0, 0, 10, 1, ".cctor", False, False, True, False, False, N, N, N), (1, 0, 11, 2, "Run", True, False, False, False, False, 7, N, N), (2, 0, 12, 2, "Help", False, False, False, False, False, N, N, N), (3, 0, 13, 3, "Show", True, True, False, False, False, N, N, N), (4, 0, 14, 5, "Deep", True, False, False, False, False, N, N, N), (5, 0, 15, 6, "<Help>b__0", False, False, False, False, True, N, N, N), (6, 0, 16, 7, "MoveNext", False, False, False, False, True, N, N, N), (7, 0, 17, 8, "Dispose", False, False, False, False, False, N, N, N),
    (8, 0, 18, 8, "Native", False, False, False, False, False, N, "user32.dll", "MessageBoxW"), (9, 0, 19, 8, "Exported", False, False, False, True, False, N, N, N), (10, 1, 10, 2, "Main", False, False, False, False, False, N, N, N), (11, 1, 11, 2, "Pub", True, False, False, False, False, N, N, N), (12, 1, 12, 3, "<Gone>b__1", False, False, False, False, True, N, N, N), (13, 1, 13, 3, "Beep", False, False, False, False, False, N, "user32.dll", "MessageBeep"), (14, 1, 14, 3, "Unused", False, False, False, False, False, N, N, N),
)
MANAGED = _f("managed", "assembly int, name string, entry_point int, target_framework string", (0, "Lib", N, ".NETStandard,Version=v2.0"), (1, "App", 10, ".NETCoreApp,Version=v6.0"))
MANAGED_CALLS = _f("mcalls", "src int, dst int", (10, 1), (10, 1), (1, 2), (2, 5), (10, 13), (3, 8), (10, 10))
EXTERNAL = _f("external", "src int, scope string, member string", (1, "System.Runtime", "System.Console::WriteLine"), (10, "System.Runtime", "System.Console::WriteLine"), (10, "System.Net.Http", "System.Net.Http.HttpClient::GetAsync"), (2, "System.Runtime", "System.Diagnostics.Process::Start"), (3, "System.Runtime", "System.IO.File::ReadAllText"), (10, "System.Runtime", "System.Console::WriteLine"))
REFERENCES = _f("refs", "caller int, kind string, token int, name string, signature string", (1, "def", 12, N, N), (1, "spec", 90, N, N), (2, "member", 80, "WriteLine", "(string)void"), (10, "member", 81, "Help", "()void"), (10, "def", 99, N, N), (1, "def", 12, N, N))
SPECS = _f("specs", "assembly int, token int, method int", (0, 90, 13))
TFMS = _f("tfms", "tfm string", *[(x,) for x in ("net35", "net472", "net48", "netstandard2.0", "netcoreapp3.1", "net6.0", "net10.0-windows", "monoandroid10", "NET8.0")])
MONIKERS = _f("monikers", "attribute string", *[(x,) for x in (".NETCoreApp,Version=v6.0", ".NETCoreApp,Version=v3.1", ".NETStandard,Version=v2.1", ".NETFramework,Version=v4.7.2", "Silverlight,Version=v5.0", ".NETCoreApp,Version=v10.0")])
CLASSES = _f(
    "classes", "descriptor string, package string, class_index int, superclass string, entry boolean",
    ("Lcom/app/Main;", "com.app", 0, "Landroid/app/Activity;", True), ("Lcom/app/Net;", "com.app", 1, "Ljava/lang/Object;", False), ("Lcom/lib/Util;", "com.lib", 2, "Ljava/lang/Object;", False), ("Lcom/app/App;", "com.app", 3, "Landroid/app/Application;", True),
)
DEX_METHODS = _f("dexm", "id int, class_descriptor string, name string, native boolean, code_size int", (0, "Lcom/app/Main;", "onCreate", False, 40), (1, "Lcom/app/Main;", "load", False, 20), (2, "Lcom/app/Net;", "nativeAdd", True, 0), (3, "Lcom/app/Net;", "get", False, 90), (4, "Lcom/lib/Util;", "join", False, 12), (5, "Lcom/lib/Util;", "unused_1", False, 8), (6, "Lcom/app/App;", "onCreate", False, 8))
DEX_REFS = _f("dexrefs", "src int, kind string, ref int, ord int", (0, "method", 11, 0), (0, "method", 13, 1), (0, "method", 11, 2), (0, "string", 1, 3), (1, "method", 12, 0), (3, "method", 14, 0), (3, "method", 90, 1), (3, "string", 0, 2), (1, "string", 0, 1), (1, "method", 91, 2), (3, "method", 90, 3))
DEX_INDEX = _f("dexidx", "ref int, descriptor string, method_id int", (11, "Lcom/app/Main;->load()V", 1), (12, "Lcom/app/Net;->nativeAdd(II)I", 2), (13, "Lcom/app/Net;->get()V", 3), (14, "Lcom/lib/Util;->join()V", 4), (90, "Ljava/net/URL;->openStream()V", N), (91, "Ljava/lang/Thread;->start()V", N))
DEX_STRINGS = _f("dexs", "ref int, value string", (0, "https://api.example.com/v1"), (1, "hello"), (2, "select name from users"))
COMPONENTS = _f("components", "ord int, kind string, name string, exported boolean, permission string", (0, "activity", ".Main", True, N), (1, "service", "com.app.Gone", False, N), (2, "application", ".App", False, N), (3, "activity", "com.app.Net", True, "com.app.CALL"), (4, "activity", ".Main", True, N))
PERMISSIONS = _f("permissions", "name string", *[(x,) for x in ("android.permission.INTERNET", "android.permission.CAMERA", "android.permission.READ_SMS", "com.app.MY_CAMERA", "android.permission.VIBRATE", "android.permission.ACCESS_FINE_LOCATION")])
NATIVES = _f("natives", "apk_ord int, abi string, name string", (1, "arm64-v8a", "liba.so"), (0, "arm64-v8a", "liba.so"), (2, "x86", "liba.so"), (1, "x86", "libb.so"), (3, "x86", "liba.so"))
FILES = _f(
    "files", "ord int, path string, role string, main boolean, size int, duplicate_of string, archs array<string>",
    (0, "bin/tool", "executable", False, 900, N, ["x86_64"]), (1, "app", "executable", False, 100, N, ["x86", "x86_64"]), (2, "My.app/Contents/MacOS/My", "executable", True, 50, N, ["arm64"]), (3, "copy", "executable", False, 999, "app", ["x86"]), (4, "lib/liba.so", "library", False, 10, N, ["x86_64"]), (5, "lib/libz.so", "library", False, 11, N, ["x86_64"]), (6, "My.app/Contents/Info.plist", "data", False, 1, N, []), (7, "Other.app/Contents/MacOS/Run", "executable", False, 5, N, ["arm64"]), (8, "Other.app/Contents/MacOS/deep/Run2", "executable", False, 6, N, ["arm64"]),
)
CHAINS = _f("chains", "root string, pos int, image string", ("app", 0, "app"), ("app", 1, "lib/liba.so"), ("bin/tool", 0, "bin/tool"), ("bin/tool", 1, "lib/liba.so"), ("lib/libz.so", 0, "lib/libz.so"))
PLISTS = _f("plists", "bundle string, executable string", ("My.app", "My"))
NEEDS = _f("needs", "path string, lib_idx int, name string, kind string", ("web/Web.dll", 0, "Core", "assembly"), ("web/Web.dll", 1, "System.Xml", "assembly"), ("web/Web.dll", 2, "Side", "assembly"), ("web/Web.dll", 3, "Nope", "assembly"), ("web/Web.dll", 4, "Host", "assembly"), ("web/Web.dll", 5, "sqlite", "pinvoke"), ("web/Web.dll", 6, "kern.dll", "pinvoke"))
IMAGES = _f("images", "path string, assembly string", ("Core.DLL", "Core"), ("web/Web.dll", "Web"), ("deep/Side.dll", "Side"), ("Host.exe", "Host"), ("web/libsqlite.so", N), ("web/runtimes/linux/native/libsqlite.so", N), ("web/runtimes/win/native/sqlite.dll", N), ("web/runtimes/win/lib/sqlite.dll", N))
