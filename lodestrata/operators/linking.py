"""Which file each library reference loads, by the loaders' public rules.

A chain is followed from each executable, one round of joins per level. References become candidate paths in the order the loader tries them; the
first that exists wins (an equality join on the path, then a minimum over positions). A file is taken into a chain once, at its first level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.session import cut


def _dir(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _join(folder: Column, name: Column) -> Column:
    """Path with ``.`` and ``..`` steps resolved."""
    parts = F.filter(F.split(F.concat_ws("/", F.nullif(folder, F.lit("")), name), "/"), lambda x: (x != "") & (x != "."))
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when((x == "..") & (F.size(a) > 0), F.slice(a, F.lit(1), F.size(a) - 1)).when(x == "..", a).otherwise(F.concat(a, F.array(x))))
    return F.array_join(done, "/")


def _expand(entries: Column, loader: Column, main: Column) -> Column:
    """Search folders with the loader's variables replaced."""
    return F.transform(entries, lambda e: F.when(e.rlike(r"^(\$ORIGIN|\$\{ORIGIN\}|@loader_path)"), _join(_dir(loader), F.regexp_replace(e, r"^(\$ORIGIN|\$\{ORIGIN\}|@loader_path)/?", ""))).when(e.startswith("@executable_path"), _join(_dir(main), F.regexp_replace(e, "^@executable_path/?", ""))).otherwise(F.regexp_replace(e, "^/", "")))


def resolve(images: DataFrame, max_levels: int = 64) -> DataFrame:
    """root, importer, library, target, status, level of each reference in each chain.

    ``images``: path, format, arch, kind, libraries, rpaths, runpaths as the folder source gives them. status: in_folder; name_match_unreachable (a
    file of that name exists elsewhere in the folder); arch_mismatch (found without the importer's architecture); external. RUNPATH holds for the
    file itself and RPATH, where a file has no RUNPATH, for the files below it as well; PE names and PE paths ignore letter case. Executables start
    chains; a folder without any has none. Null and repeated references are dropped.
    """
    files = images.groupBy(F.col("path").alias("target")).agg(F.collect_set("arch").alias("archs"))  # a file has a handful of slices
    key = F.when(F.col("format") == "pe", F.lower("path")).otherwise(F.col("path"))
    by_path = cut(images.select(key.alias("cand"), "path").groupBy("cand").agg(F.min("path").alias("target")).join(files, "target"))
    names = cut(by_path.groupBy(F.regexp_extract("cand", "([^/]*)$", 1).alias("base")).agg(F.min("target").alias("by_name")))
    refs = cut(images.select("path", "format", "arch", "rpaths", "runpaths", F.explode("libraries").alias("l")).select("path", "format", "arch", "rpaths", "runpaths", F.col("l.name").alias("library")).where("library is not null").distinct())
    own = images.select(F.col("path").alias("importer"), F.when(F.size("runpaths") > 0, F.array().cast("array<string>")).otherwise(F.col("rpaths")).alias("own_rpaths")).dropDuplicates(["importer"])
    none = F.array().cast("array<string>")
    level = cut(images.where("kind = 'executable'").select(F.col("path").alias("root"), F.col("path").alias("importer"), none.alias("lineage")).dropDuplicates(["root"]))
    seen, out = level.select("root", "importer"), None
    for n in range(max_levels):
        r = level.join(refs.withColumnRenamed("path", "importer"), "importer")
        mine = _expand("runpaths", F.col("importer"), F.col("root"))
        rp = F.when(F.size("runpaths") > 0, none).otherwise(_expand("rpaths", F.col("importer"), F.col("root")))
        elf = F.concat(rp, F.when(F.size("runpaths") > 0, none).otherwise(F.col("lineage")), mine)
        search = F.when(F.col("format") == "elf", elf).when(F.col("format") == "pe", F.array(_dir(F.col("root")), _dir(F.col("importer")))).otherwise(F.concat(_expand("rpaths", F.col("importer"), F.col("root")), F.col("lineage")))
        plain = ~F.col("library").contains("/")
        macho = F.when(F.col("library").startswith("@rpath/"), F.transform("search", lambda d: _join(d, F.regexp_replace("library", "^@rpath/", "")))).when(F.col("library").startswith("@"), F.transform(_expand(F.array("library"), F.col("importer"), F.col("root")), lambda x: x)).otherwise(F.array(F.regexp_replace("library", "^/", "")))
        cands = F.when(F.col("format") == "macho", macho).when(plain, F.transform("search", lambda d: _join(d, F.when(F.col("format") == "pe", F.lower("library")).otherwise(F.col("library"))))).otherwise(F.array(F.regexp_replace("library", "^/", "")))
        tried = r.withColumn("search", search).select("root", "importer", "library", "format", "arch", F.posexplode_outer(cands).alias("pos", "cand"))
        tried = tried.withColumn("cand", F.when(F.col("format") == "pe", F.lower("cand")).otherwise(F.col("cand")))
        hit = tried.join(by_path, "cand", "left").groupBy("root", "importer", "library", "format", "arch").agg(F.min(F.when(F.col("target").isNotNull(), F.struct("pos", "target", "archs"))).alias("x"))
        base = F.regexp_extract(F.when(F.col("format") == "pe", F.lower("library")).otherwise(F.col("library")), "([^/]*)$", 1)
        found = hit.withColumn("base", base).join(names, "base", "left").select(
            "root", "importer", "library", F.coalesce("x.target", "by_name").alias("target"),
            F.when(F.col("x").isNotNull(), F.when(F.array_contains("x.archs", F.col("arch")), "in_folder").otherwise("arch_mismatch")).when(F.col("by_name").isNotNull(), "name_match_unreachable").otherwise("external").alias("status"),
            F.lit(n).alias("level"),
        )
        found = cut(found)
        out = found if out is None else out.unionByName(found)
        handed = level.join(own, "importer", "left").select("root", "importer", F.concat(_expand("own_rpaths", F.col("importer"), F.col("root")), F.col("lineage")).alias("lineage"))
        step = found.where("status = 'in_folder'").join(handed, ["root", "importer"]).groupBy("root", F.col("target").alias("importer")).agg(F.min_by("lineage", F.struct("importer")).alias("lineage"))
        level = cut(step.join(seen, ["root", "importer"], "left_anti").select("root", "importer", "lineage"))
        if level.isEmpty():
            return out
        seen = cut(seen.unionByName(level.select("root", "importer")))
    raise RuntimeError("chains deeper than max_levels")


def load_order(edges: DataFrame) -> DataFrame:
    """target, loaded_by (the root of its first chain), level: the first chain by root name, then the smallest level."""
    return edges.where("status = 'in_folder'").groupBy("target").agg(F.min(F.struct("root", "level")).alias("x")).select("target", F.col("x.root").alias("loaded_by"), "x.level")
