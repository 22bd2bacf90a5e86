"""Imports bound to exports of other files, by the rules of each loader.

All operators take tables and give one row per import (path, imp_ord). Columns used: ``imports`` path, imp_ord, name, lib_idx, special, ordinal, version;
``exports`` path, exp_ord, name, address, ordinal, forwarder, reexport_lib, reexport_name, version, default_version, weak; ``edges`` path, lib_idx,
target, status (which file a library reference means); ``scope`` path, pos, image (load order that an importer looks through). Exports are reduced to
one row per name before any join, by minima that combine map-side, so a name that everything imports meets one row; repeated import rows count once;
null names bind to nothing. Chains are followed in rounds, each written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.session import cut

MOST_HOPS = 16
KEY = ["path", "imp_ord"]
#: Libraries of the system that are never looked for in a folder (fixed values).
KNOWN_DLLS = "advapi32 clbcatq combase comdlg32 coml2 difxapi gdi32 gdiplus imagehlp imm32 kernel32 kernelbase msctf msvcrt normaliz nsi ntdll ole32 oleaut32 psapi rpcrt4 sechost setupapi shcore shell32 shlwapi user32 wldap32 wow64 wow64cpu wow64win ws2_32".split()


def named(exports: DataFrame) -> DataFrame:
    """path, name, e: the row that a lookup without a version takes: default versions first, then the first row."""
    row = F.struct((~F.coalesce("default_version", F.lit(False))).alias("o"), "exp_ord", "address", "forwarder", "reexport_lib", "reexport_name", F.coalesce("weak", F.lit(False)).alias("weak"))
    return exports.where("name is not null").groupBy("path", "name").agg(F.min(row).alias("e"))


def applied(imports: DataFrame, edges: DataFrame) -> DataFrame:
    """Imports with the ``target`` that their library means (null if it can't be looked into) and the ``status`` of that: ``open`` where it can."""
    first = edges.groupBy("path", "lib_idx").agg(F.min(F.struct("target", "status")).alias("g"))
    inside = F.col("g.status").isin("in_folder", "name_match_unreachable") & F.col("g.target").isNotNull()
    return imports.join(first, ["path", "lib_idx"], "left").withColumns({"status": F.when(F.col("g").isNull(), "external").when(inside, "open").otherwise(F.col("g.status")), "target": F.when(inside, F.col("g.target"))}).drop("g")


def bind_elf(imports: DataFrame, edges: DataFrame, exports: DataFrame, scope: DataFrame) -> DataFrame:
    """path, imp_ord, status, resolution, target, exp_ord, candidates. A versioned import binds in the file that its version names, to that version
    or else to an unversioned row; any other to the first definer in load order besides its own file, the further ones are candidates."""
    i = imports.dropDuplicates(KEY)
    v = applied(i.where("lib_idx is not null"), edges)
    exact = exports.groupBy(F.col("path").alias("target"), "name", "version").agg(F.min("exp_ord").alias("x"))
    plain = exact.where("version is null").select("target", "name", F.col("x").alias("u"))
    free = named(exports).select(F.col("path").alias("target"), "name", F.col("e.exp_ord").alias("d"))
    v = v.join(exact.where("version is not null"), ["target", "name", "version"], "left").join(plain, ["target", "name"], "left").join(free, ["target", "name"], "left")
    hit = F.when(F.col("version").isNull(), F.col("d")).otherwise(F.coalesce("x", "u"))
    none = F.lit(None).cast("array<string>")
    v = v.select(*KEY, F.when(F.col("status") != "open", F.col("status")).when(hit.isNull(), "unresolved_symbol").otherwise("bound").alias("status"), F.when((F.col("status") == "open") & hit.isNotNull(), "versioned").alias("resolution"), "target", hit.alias("exp_ord"), none.alias("candidates"))
    return v.unionByName(scope_lookup(i.where("lib_idx is null"), exports, scope, "global_scope"))


def scope_lookup(imports: DataFrame, exports: DataFrame, scope: DataFrame, mode: str) -> DataFrame:
    """The first definer of a name in the importer's load order; in weak mode its own file counts as well and strong definitions come first."""
    definers = named(exports).where("e.reexport_lib is null").select(F.col("path").alias("image"), "name", "e.exp_ord", "e.weak")
    looked = imports.select(*KEY, "name").join(scope, "path")
    if mode != "weak_lookup":
        looked = looked.where("image <> path")
    order = F.struct(F.when(F.lit(mode == "weak_lookup"), F.col("weak").cast("int")).otherwise(0).alias("w"), "pos", "image", "exp_ord")
    found = looked.join(definers, ["image", "name"]).groupBy(*KEY).agg(F.min(order).alias("b"), F.array_sort(F.collect_list(F.struct("pos", "image"))).alias("all"))  # a load order is a bounded list
    out = imports.select(*KEY).join(found, KEY, "left")
    return out.select(*KEY, F.when(F.col("b").isNull(), "no_definer_in_folder").otherwise("bound").alias("status"), F.lit(mode).alias("resolution"), F.col("b.image").alias("target"), F.col("b.exp_ord").alias("exp_ord"), F.transform(F.filter("all", lambda x: x["image"] != F.col("b.image")), lambda x: x["image"]).alias("candidates"))


def bind_pe(imports: DataFrame, edges: DataFrame, exports: DataFrame, scope: DataFrame) -> DataFrame:
    """path, imp_ord, status, resolution, target, exp_ord, hops. By name or ordinal; forwarders are followed up to 16 hops through the importer's load
    order (by base name, without letter case); API sets and system libraries end a chain."""
    by_name = named(exports).select(F.col("path").alias("target"), F.col("name").alias("want"), F.struct("e.exp_ord", "e.forwarder").alias("n"))
    by_ordinal = exports.where("ordinal is not null").groupBy(F.col("path").alias("target"), F.concat(F.lit("#"), F.col("ordinal").cast("string")).alias("want")).agg(F.min(F.struct("exp_ord", "forwarder")).alias("o"))
    modules = cut(scope.groupBy("path", F.lower(F.regexp_extract("image", "([^/]*)$", 1)).alias("dll")).agg(F.min(F.struct("pos", "image")).alias("m")).select("path", "dll", F.col("m.image").alias("next")))
    known = cut(by_name.join(by_ordinal, ["target", "want"], "full").select("target", "want", F.coalesce("o", "n").alias("e")))
    state = applied(imports.dropDuplicates(KEY), edges).select(*KEY, "target", F.when(F.col("ordinal").isNotNull(), F.concat(F.lit("#"), F.col("ordinal").cast("string"))).otherwise(F.col("name")).alias("want"), F.when(F.col("status") == "open", F.when(F.col("ordinal").isNull(), "name").otherwise("ordinal")).alias("resolution"), "status", F.lit(None).cast("int").alias("exp_ord"), F.lit(0).alias("hops"))
    done = state.where("status <> 'open'")
    state = cut(state.where("status = 'open'"))
    for hop in range(MOST_HOPS + 1):
        if state.isEmpty():
            break
        s = state.join(known, ["target", "want"], "left")
        module, symbol = F.regexp_extract("e.forwarder", r"^(.*)\.([^.]*)$", 1), F.regexp_extract("e.forwarder", r"^(.*)\.([^.]*)$", 2)
        dll = F.lower(F.when(F.lower(module).endswith(".dll"), module).otherwise(F.concat(module, F.lit(".dll"))))
        follow = F.col("e.forwarder").isNotNull()
        s = s.withColumns({"dll": F.when(follow, dll), "symbol": F.when(follow, symbol)}).join(modules, ["path", "dll"], "left")
        ended = F.when(F.col("e").isNull(), "unresolved_symbol").when(~follow, "bound").when(F.lit(hop >= MOST_HOPS), "unresolved_symbol").when(F.col("dll").rlike("^(api|ext)-ms-win-"), "apiset").when(F.col("dll").isin(*[f"{d}.dll" for d in KNOWN_DLLS]), "system").when(F.col("next").isNull(), "external").otherwise("open")
        s = cut(s.withColumn("ended", ended))
        over = F.col("ended").isin("apiset", "system", "external")
        done = done.unionByName(s.where("ended <> 'open'").select(*KEY, F.when(~over, F.col("target")).alias("target"), "want", F.when(follow, "forwarder").otherwise(F.col("resolution")).alias("resolution"), F.col("ended").alias("status"), F.when(F.col("ended") == "bound", F.col("e.exp_ord")).alias("exp_ord"), "hops"))
        state = s.where("ended = 'open'").select(*KEY, F.col("next").alias("target"), F.col("symbol").alias("want"), F.lit("forwarder").alias("resolution"), F.lit("open").alias("status"), F.lit(None).cast("int").alias("exp_ord"), (F.col("hops") + 1).alias("hops"))
    return done.select(*KEY, "status", "resolution", "target", "exp_ord", "hops")


def bind_macho(imports: DataFrame, edges: DataFrame, exports: DataFrame, scope: DataFrame, reexports: DataFrame, mains: DataFrame) -> DataFrame:
    """path, imp_ord, status, resolution, target, exp_ord. Two-level lookup: in the library of the import's ordinal, in the file itself or in the main
    executable of its chain (``mains``: path, main); re-exported symbols are followed, then re-exported libraries (``reexports``: path, lib_idx) are
    searched depth first. Flat and weak lookups and imports without a library go through the load order.

    All branches are followed at once; each carries the list of choices that led to it, and the smallest list that ends is what a depth-first search
    with back-tracking finds first.
    """
    i = imports.dropDuplicates(KEY)
    flat = F.col("special").isin("flat_lookup", "weak_lookup") | F.col("special").isNull() & F.col("lib_idx").isNull()
    weak = F.col("special") == "weak_lookup"
    cols = [*KEY, "status", "resolution", "target", "exp_ord"]
    out = scope_lookup(i.where(flat & ~F.coalesce(weak, F.lit(False))), exports, scope, "flat_lookup").select(*cols).unionByName(scope_lookup(i.where(weak), exports, scope, "weak_lookup").select(*cols))
    two = i.where(~F.coalesce(flat, F.lit(False)))
    begun = applied(two.where("special is null"), edges).withColumn("resolution", F.lit("two_level"))
    own = two.where("special = 'self'").withColumns({"target": F.col("path"), "status": F.lit("open"), "resolution": F.lit("self")})
    top = two.where("special = 'main_executable'").join(mains, "path", "left").withColumns({"target": F.coalesce("main", "path"), "status": F.lit("open"), "resolution": F.lit("main_executable")}).drop("main")
    begun = begun.unionByName(own).unionByName(top.select(*begun.columns))
    out = out.unionByName(begun.where("status <> 'open'").select(*KEY, "status", F.lit(None).cast("string").alias("resolution"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("int").alias("exp_ord")))
    begun = cut(begun.where("status = 'open'").select(*KEY, "name", "target", "resolution"))
    table = cut(named(exports).select(F.col("path").alias("target"), "name", "e"))
    edge = cut(edges.groupBy(F.col("path").alias("target"), "lib_idx").agg(F.min(F.struct("target", "status")).alias("g")).select("target", "lib_idx", F.col("g.target").alias("to"), F.col("g.status").alias("how")))
    lists = reexports.select(F.col("path").alias("target"), "lib_idx").distinct().join(edge.where("how = 'in_folder' and to is not null"), ["target", "lib_idx"]).select("target", F.col("lib_idx").alias("branch"), "to")
    state = begun.withColumn("trail", F.array().cast("array<int>"))
    ends = None
    seen = state.select(*KEY, "target", "name", "trail")
    for _ in range(MOST_HOPS + 1):
        if state.isEmpty():
            break
        s = state.join(table, ["target", "name"], "left").join(edge.withColumnRenamed("lib_idx", "_l"), (F.col("e.reexport_lib") == F.col("_l")) & (state["target"] == edge["target"]), "left").drop(edge["target"])
        s = cut(s.withColumn("what", F.when(F.col("e").isNull(), "branch").when(F.col("e.reexport_lib").isNull(), "bound").when((F.col("how") == "in_folder") & F.col("to").isNotNull(), "follow").otherwise(F.coalesce("how", F.lit("external")))))
        new = s.where("what not in ('branch', 'follow')").select(*KEY, "trail", F.col("what").alias("status"), "resolution", F.when(F.col("what") == "bound", F.col("target")).alias("target"), F.when(F.col("what") == "bound", F.col("e.exp_ord")).alias("exp_ord"))
        ends = new if ends is None else ends.unionByName(new)
        follow = s.where("what = 'follow'").select(*KEY, F.coalesce("e.reexport_name", "name").alias("name"), F.col("to").alias("target"), F.lit("reexport").alias("resolution"), F.concat("trail", F.array(F.lit(0))).alias("trail"))
        spread = s.where("what = 'branch'").drop("to").join(lists, "target").select(*KEY, "name", F.col("to").alias("target"), F.lit("reexport").alias("resolution"), F.concat("trail", F.array(F.col("branch"))).alias("trail"))
        # A file that was reached by an earlier branch can only be worth another look by a still earlier one.
        step = follow.unionByName(spread).groupBy(*KEY, "target", "name", "resolution").agg(F.min("trail").alias("trail"))
        before = seen.groupBy(*KEY, "target", "name").agg(F.min("trail").alias("old"))
        state = cut(step.join(before, [*KEY, "target", "name"], "left").where("old is null or trail < old").drop("old"))
        seen = cut(seen.unionByName(state.select(*KEY, "target", "name", "trail")))
    best = ends.groupBy(*KEY).agg(F.min(F.struct("trail", "status", "resolution", "target", "exp_ord")).alias("b"))
    bound = begun.join(best, KEY, "left").select(*KEY, F.coalesce("b.status", F.lit("unresolved_symbol")).alias("status"), "b.resolution", F.when(F.col("b").isNull(), F.col("target")).otherwise(F.col("b.target")).alias("target"), "b.exp_ord")
    return out.unionByName(bound)


def bind_members(imports: DataFrame, edges: DataFrame, exports: DataFrame, forwarders: DataFrame, assemblies: DataFrame) -> DataFrame:
    """path, imp_ord, status, resolution, target, exp_ord of managed member references, by (name, canonical signature). Where the assembly doesn't
    define it but forwards the owner type (``forwarders``: path, owner, assembly), the search goes on in the first file of that assembly
    (``assemblies``: assembly, path), 16 times at most. Fields bind without a row. ``imports`` has signature, owner and kind as well."""
    key = F.struct("exp_ord").alias("e")
    rows = cut(exports.where("signature is not null").groupBy(F.col("path").alias("target"), "name", "signature").agg(F.min("exp_ord").alias("exp_ord")).select("target", "name", "signature", key))
    there = cut(exports.select(F.col("path").alias("target")).union(assemblies.select("path")).distinct().withColumn("known", F.lit(True)))
    to = cut(forwarders.groupBy(F.col("path").alias("target"), "owner").agg(F.min("assembly").alias("assembly")).join(assemblies.groupBy("assembly").agg(F.min("path").alias("next")), "assembly", "left"))
    cols = [*KEY, "name", "signature", "owner", "kind", "target", "resolution"]
    start = applied(imports.dropDuplicates(KEY), edges).withColumn("resolution", F.lit(None).cast("string"))
    none = F.lit(None).cast("int").alias("exp_ord")
    done = start.where("status <> 'open'").select(*KEY, "status", "resolution", "target", none)
    state = cut(start.where("status = 'open'").select(*cols))
    for hop in range(MOST_HOPS):
        if state.isEmpty():
            return done
        s = state.join(rows, ["target", "name", "signature"], "left").join(there, "target", "left").join(to, ["target", "owner"], "left")
        ended = F.when(F.col("known").isNull(), "unresolved_symbol").when((F.col("kind") == "data") | F.col("e").isNotNull(), "bound").when(F.col("assembly").isNull(), "unresolved_symbol").when(F.col("next").isNull(), "external").otherwise("open")
        how = F.when(ended == "bound", F.when(F.col("kind") == "data", "field").otherwise(F.coalesce("resolution", F.lit("member_ref")))).when(F.col("assembly").isNotNull(), "type_forwarder").otherwise(F.col("resolution"))
        s = cut(s.withColumns({"ended": ended, "how": how}))
        done = done.unionByName(s.where("ended <> 'open'").select(*KEY, F.col("ended").alias("status"), F.col("how").alias("resolution"), F.when(F.col("ended") != "external", F.col("target")).alias("target"), F.when(F.col("kind") != "data", F.col("e.exp_ord")).alias("exp_ord")))
        state = s.where("ended = 'open'").select(*KEY, "name", "signature", "owner", "kind", F.col("next").alias("target"), F.lit("type_forwarder").alias("resolution"))
    return done.unionByName(state.select(*KEY, F.lit("unresolved_symbol").alias("status"), "resolution", "target", none))


def pinvoke_names(name: Column, charset: Column, fmt: Column) -> Column:
    """Names to try for a platform call, in order: as given; in PE files by character set; in Mach-O files with an underscore before."""
    wide, narrow = F.concat(name, F.lit("W")), F.concat(name, F.lit("A"))
    return F.when(fmt == "macho", F.array(F.concat(F.lit("_"), name))).when((fmt != "pe") | (charset == "exact"), F.array(name)).when(charset.isin("unicode", "auto"), F.array(wide, name)).otherwise(F.array(name, narrow))


def bind_pinvoke(imports: DataFrame, edges: DataFrame, exports: DataFrame, formats: DataFrame) -> DataFrame:
    """path, imp_ord, target, status, exp_ord: one row per file that the module name means (every one counts), with the first of the names to try that
    it exports; ``#12`` is an ordinal. ``imports`` has charset as well; ``formats``: path, format."""
    i = imports.dropDuplicates(KEY).select(*KEY, "lib_idx", "name", "charset")
    meant = i.join(edges.select("path", "lib_idx", "target", F.col("status").alias("how")).distinct(), ["path", "lib_idx"], "left")
    inside = F.col("how").isin("in_folder", "name_match_unreachable") & F.col("target").isNotNull()
    open_ = meant.where(inside).join(formats.select(F.col("path").alias("target"), "format"), "target", "left")
    tried = open_.select(*KEY, "target", F.posexplode(pinvoke_names(F.col("name"), F.col("charset"), F.col("format"))).alias("pos", "want"))
    rows = named(exports).select(F.col("path").alias("target"), F.col("name").alias("want"), F.col("e.exp_ord").alias("exp_ord")).unionByName(exports.where("ordinal is not null").groupBy(F.col("path").alias("target"), F.concat(F.lit("#"), F.col("ordinal").cast("string")).alias("want")).agg(F.min("exp_ord").alias("exp_ord")))
    hit = tried.join(rows, ["target", "want"], "left").groupBy(*KEY, "target").agg(F.min(F.when(F.col("exp_ord").isNotNull(), F.struct("pos", "exp_ord"))).alias("b"))
    bound = hit.select(*KEY, "target", F.when(F.col("b").isNull(), "unresolved_symbol").otherwise("bound").alias("status"), "b.exp_ord")
    other = meant.where(~F.coalesce(inside, F.lit(False))).select(*KEY, F.lit(None).cast("string").alias("target"), F.coalesce("how", F.lit("external")).alias("status"), F.lit(None).cast("int").alias("exp_ord"))
    return bound.unionByName(other)
