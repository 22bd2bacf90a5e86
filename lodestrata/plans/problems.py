"""Queries of the general data problems: orphan references (4) and heavy keys (5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.orphans import orphan_references
from lodestrata.operators.skew import salted_aggregate, salted_count_distinct
from lodestrata.session import table


def clean_dll(c: Column) -> Column:
    """Trimmed, lower-case base name of a library."""
    return F.regexp_replace(F.lower(F.trim(c)), r"^.*[/\\]", "")


def clean_symbol(c: Column) -> Column:
    """Symbol without a leading ``__imp_`` and without everything from the first ``@``."""
    return F.regexp_replace(F.regexp_replace(c, r"^__imp_", ""), r"(?s)@.*$", "")


def clean_path(c: Column) -> Column:
    """Path with forward slashes, no leading ``./`` and no repeated slashes."""
    return F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^\./", ""), r"/+", "/")


def _pair(dll: Column, name: Column) -> Column:
    return F.concat(dll, F.lit("\x00"), name)


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans of the three referring fields, with the reference's time ``t``; ``tie`` is a hash of the dll, which both references of an import share.

    Rows that were delivered twice are not taken out before the shuffle: the few that miss are made distinct in ``_settle``.
    """
    imports, exports = table(spark, sf_dir, "imports"), table(spark, sf_dir, "exports")
    imports = imports.select("import_id", clean_dll(F.col("dll")).alias("dll"), clean_symbol(F.col("name")).alias("name"), F.col("seen_at").alias("t")).where("dll is not null")
    refs = imports.select(F.expr("stack(2, 'imports.dll', dll, 'imports.name', concat(dll, chr(0), name)) as (ref_field, key)"), F.col("import_id").alias("rec_id"), "t", F.xxhash64("dll").alias("tie"))
    files = table(spark, sf_dir, "function_rows").select(F.lit("function_rows.source_file").alias("ref_field"), F.col("function_row_id").alias("rec_id"), clean_path(F.col("source_file")).alias("key"), F.col("exported_at").alias("t"), F.lit(0).cast("bigint").alias("tie"))
    exports = exports.select(clean_dll(F.col("dll")).alias("dll"), clean_symbol(F.col("name")).alias("name"), F.col("added_at").alias("valid_from"), F.col("removed_at").alias("valid_to"))
    parents = (
        exports.select(F.lit("imports.dll").alias("ref_field"), F.col("dll").alias("key"), "valid_from", "valid_to")
        .unionByName(exports.select(F.lit("imports.name").alias("ref_field"), _pair(F.col("dll"), F.col("name")).alias("key"), "valid_from", "valid_to"))
        .unionByName(table(spark, sf_dir, "source_files").select(F.lit("function_rows.source_file").alias("ref_field"), clean_path(F.col("path")).alias("key"), F.col("first_seen").alias("valid_from"), F.col("deleted_at").alias("valid_to")))
    )
    return orphan_references(refs.unionByName(files.select(*refs.columns)), parents, fields=["imports.dll", "imports.name", "function_rows.source_file"])


def _settle(found: DataFrame) -> DataFrame:
    """Drop misses of a name whose dll is itself missed by the same import at the same time, in one aggregation over the misses only."""
    rank = F.when(F.col("ref_field") == "imports.name", 1).otherwise(0)
    group = F.col("ref_field") == "function_rows.source_file"
    ranked = found.groupBy(group.alias("g"), "rec_id", "t", "tie").agg(F.min(rank).alias("first"), F.collect_set(F.struct(rank.alias("r"), "ref_field", "reason")).alias("all"))
    kept = ranked.select("rec_id", "t", F.explode(F.filter("all", lambda x: x["r"] == F.col("first"))).alias("b"))
    return kept.select("b.ref_field", "rec_id", "b.reason", F.substring(F.col("t").cast("string"), 1, 7).alias("period")).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _settle(orphans(spark, sf_dir)).select("ref_field", "rec_id", "reason", "period")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per referring field, month and reason."""
    return p4_found(spark, sf_dir).groupBy("ref_field", "period", "reason").agg(F.count(F.lit(1)).alias("orphans"))


def _indegrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return salted_count_distinct(table(spark, sf_dir, "calls").where("dst is not null"), ["binary_id", "dst"], "src", "callers")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    routines = table(spark, sf_dir, "routines").where("indegree is not null").select("routine_id", "binary_id", F.col("address").alias("dst"), "indegree")
    wrong = routines.join(_indegrees(spark, sf_dir), ["binary_id", "dst"], "left").where("indegree <> coalesce(callers, 0)")
    named = table(spark, sf_dir, "imports").where("name is not null and import_id is not null").select(clean_symbol(F.col("name")).alias("name"), "import_id")
    total = named.agg(F.count_distinct("import_id").alias("total"))
    heavy = salted_count_distinct(named, ["name"], "import_id", "n").join(F.broadcast(total), F.col("n") * 100 >= F.col("total"))
    return wrong.select(F.lit("routine").alias("key_kind"), F.col("routine_id").cast("string").alias("key_value")).unionByName(heavy.select(F.lit("import_name").alias("key_kind"), F.col("name").alias("key_value")))


def p5_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per routine: the recorded indegree, the distinct callers and the call rows."""
    calls = table(spark, sf_dir, "calls").where("dst is not null")
    rows = salted_aggregate(calls.select("binary_id", "dst", "src", "ord"), ["binary_id", "dst"], {"call_rows": ("count", "*"), "last_ord": ("max", "ord")})
    routines = table(spark, sf_dir, "routines").select("routine_id", "binary_id", F.col("address").alias("dst"), "indegree")
    return (
        routines.join(_indegrees(spark, sf_dir), ["binary_id", "dst"], "left")
        .join(rows, ["binary_id", "dst"], "left")
        .select("routine_id", "indegree", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("call_rows", F.lit(0)).alias("call_rows"), "last_ord")
    )


def p5_import_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cleaned import name: rows, first and last sighting."""
    named = table(spark, sf_dir, "imports").where("name is not null").select(clean_symbol(F.col("name")).alias("name"), "import_id", "seen_at", "loaded_at")
    return salted_aggregate(named, ["name"], {"rows": ("count", "*"), "first_seen": ("min", "seen_at"), "last_seen": ("max", "seen_at")})


_CLEAN = r"""
i as (select distinct import_id, regexp_replace(lower(trim(dll)), '^.*[/\\]', '') as dll, regexp_replace(regexp_replace(name, '^__imp_', ''), '@.*$', '', 's') as name, seen_at as t from imports),
e as (select regexp_replace(lower(trim(dll)), '^.*[/\\]', '') as dll, regexp_replace(regexp_replace(name, '^__imp_', ''), '@.*$', '', 's') as name, added_at as a, coalesce(removed_at, timestamp '9999-01-01') as z from exports where added_at is not null),
s as (select regexp_replace(regexp_replace(replace(path, '\', '/'), '^\./', ''), '/+', '/', 'g') as path, first_seen as a, coalesce(deleted_at, timestamp '9999-01-01') as z from source_files where first_seen is not null),
f as (select function_row_id as id, regexp_replace(regexp_replace(replace(source_file, '\', '/'), '^\./', ''), '/+', '/', 'g') as path, exported_at as t from function_rows where source_file is not null and exported_at is not null),
d0 as (select i.import_id, i.t, i.dll, min(e.a) as a, coalesce(bool_or(e.a <= i.t and e.z > i.t), false) as ok from i left join e on e.dll = i.dll where i.dll is not null and i.t is not null group by all),
n0 as (select i.import_id, i.t, i.dll, i.name, min(e.a) as a, coalesce(bool_or(e.a <= i.t and e.z > i.t), false) as ok from i left join e on e.dll = i.dll and e.name = i.name where i.dll is not null and i.name is not null and i.t is not null group by all),
f0 as (select f.id, f.t, f.path, min(s.a) as a, coalesce(bool_or(s.a <= f.t and s.z > f.t), false) as ok from f left join s on s.path = f.path group by all),
found as (
select 'imports.dll' as ref_field, import_id as rec_id, case when a is null then 'missing' when a <= t then 'deleted' else 'late' end as reason, strftime(t, '%Y-%m') as period from d0 where not ok
union select 'imports.name', import_id, case when a is null then 'missing' when a <= t then 'deleted' else 'late' end, strftime(t, '%Y-%m') from n0 where not ok and exists (select 1 from d0 where d0.import_id = n0.import_id and d0.t = n0.t and d0.dll = n0.dll and d0.ok)
union select 'function_rows.source_file', id, case when a is null then 'missing' when a <= t then 'deleted' else 'late' end, strftime(t, '%Y-%m') from f0 where not ok)
"""
_CALLERS = "c as (select binary_id, dst, count(distinct src) as callers, count(*) as call_rows, max(ord) as last_ord from calls where dst is not null group by all)"
_NAME = "regexp_replace(regexp_replace(name, '^__imp_', ''), '@.*$', '', 's')"

QUERIES = {"p4_found": p4_found, "p4_report": p4_report, "p5_found": p5_found, "p5_callers": p5_callers, "p5_import_names": p5_import_names}
ORACLE = {
    "p4_found": f"with {_CLEAN} select ref_field, rec_id, reason, period from found",
    "p4_report": f"with {_CLEAN} select ref_field, period, reason, count(*) as orphans from found group by all",
    "p5_found": f"""with {_CALLERS}, n as (select {_NAME} as name, count(distinct import_id) as n from imports where name is not null group by 1)
select 'routine' as key_kind, cast(routine_id as varchar) as key_value from routines r left join c on c.binary_id = r.binary_id and c.dst = r.address where r.indegree is not null and r.indegree <> coalesce(callers, 0)
union all select 'import_name', name from n where n * 100 >= (select count(distinct import_id) from imports where name is not null)""",
    "p5_callers": f"with {_CALLERS} select routine_id, indegree, coalesce(callers, 0) as callers, coalesce(call_rows, 0) as call_rows, last_ord from routines r left join c on c.binary_id = r.binary_id and c.dst = r.address",
    "p5_import_names": f'select {_NAME} as name, count(*) as "rows", min(seen_at) as first_seen, max(seen_at) as last_seen from imports where name is not null group by 1',
}
