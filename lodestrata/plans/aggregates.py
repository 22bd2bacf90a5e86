"""Aggregations, set operations, ordered folds and windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import scalar as S
from lodestrata.operators.ranges import ranked
from lodestrata.operators.skew import salted_aggregate
from lodestrata.plans.helpers import Book
from lodestrata.plans.joins import _DLL
from lodestrata.plans.problems import clean_dll, clean_path
from lodestrata.session import table

book = Book()
QUERIES, ORACLE = book.queries, book.oracle


@book.add("d1_imports_by_library", f"select coalesce(nullif({_DLL}, ''), nullif(trim(bind), ''), 'unknown') as library, count(*) as import_rows, min(seen_at) as first_seen from imports group by 1")
def imports_by_library(spark, sf):
    i = table(spark, sf, "imports").select(F.coalesce(F.nullif(clean_dll(F.col("dll")), F.lit("")), F.nullif(F.trim("bind"), F.lit("")), F.lit("unknown")).alias("library"), "import_id", "seen_at", "loaded_at")
    return salted_aggregate(i, ["library"], {"import_rows": ("count", "*"), "first_seen": ("min", "seen_at")})


@book.add("d4_top_libraries", f"with n as (select binary_id, {_DLL} as dll, count(*) as n, min(import_id) as first_id from imports where dll is not null group by 1, 2), r as (select *, row_number() over (partition by binary_id order by n desc, first_id) as r from n) select binary_id, string_agg(dll, ', ' order by r) as label from r where r <= 3 group by 1")
def top_libraries(spark, sf):
    """The three most used libraries of a binary in one text; ties by first appearance."""
    n = table(spark, sf, "imports").where("dll is not null").groupBy("binary_id", clean_dll(F.col("dll")).alias("dll")).agg(F.count(F.lit(1)).alias("n"), F.min("import_id").alias("first_id"))
    r = n.withColumn("r", F.row_number().over(Window.partitionBy("binary_id").orderBy(F.desc("n"), "first_id"))).where("r <= 3")
    return r.groupBy("binary_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "dll"))), lambda x: x["dll"]), ", ").alias("label"))


@book.add("d5_package_graph", "select s.source_dir as from_dir, d.source_dir as to_dir, count(*) as calls_n from calls c join routines s on s.binary_id = c.binary_id and s.address = c.src join routines d on d.binary_id = c.binary_id and d.address = c.dst where s.source_dir <> d.source_dir group by 1, 2")
def package_graph(spark, sf):
    r = table(spark, sf, "routines").where("source_dir is not null")
    s, d = r.select("binary_id", F.col("address").alias("src"), F.col("source_dir").alias("from_dir")), r.select("binary_id", F.col("address").alias("dst"), F.col("source_dir").alias("to_dir"))
    return table(spark, sf, "calls").join(s, ["binary_id", "src"]).join(d, ["binary_id", "dst"]).where("from_dir <> to_dir").groupBy("from_dir", "to_dir").agg(F.count(F.lit(1)).alias("calls_n"))


@book.add("d7_cluster_graph", "select distinct c.binary_id, s.source_file as from_file, d.source_file as to_file from calls c join routines s on s.binary_id = c.binary_id and s.address = c.src join routines d on d.binary_id = c.binary_id and d.address = c.dst where s.source_file <> d.source_file")
def cluster_graph(spark, sf):
    r = table(spark, sf, "routines").where("source_file is not null")
    s, d = r.select("binary_id", F.col("address").alias("src"), F.col("source_file").alias("from_file")), r.select("binary_id", F.col("address").alias("dst"), F.col("source_file").alias("to_file"))
    return table(spark, sf, "calls").select("binary_id", "src", "dst").distinct().join(s, ["binary_id", "src"]).join(d, ["binary_id", "dst"]).where("from_file <> to_file").select("binary_id", "from_file", "to_file").distinct()


@book.add("d8_entropy", "with v as (select distinct string_id, value from strings where value <> ''), h as (select string_id, value, hex(encode(value)) as x from v), b as (select string_id, value, x[2 * k - 1 : 2 * k] as b from (select *, unnest(range(1, length(x) // 2 + 1)) as k from h)), c as (select string_id, value, b, count(*) as n from b group by all), t as (select string_id, value, sum(n) as t from c group by all) select c.string_id, round(sum(-(n / t) * log2(n / t)), 6) + 0.0 as entropy from c join t on t.string_id = c.string_id and t.value = c.value group by c.string_id, c.value")
def entropy(spark, sf):
    """Entropy of each string's UTF-8 bytes, counted inside the row: no byte leaves its task."""
    return table(spark, sf, "strings").where("value <> ''").select("string_id", "value").distinct().select("string_id", S.shannon_entropy("value").alias("entropy"))


@book.add("d10_triage", "select binary_id, count(*) as routines_n, count(*) filter (where imported) as imported_n, count(*) filter (where thunk) as thunks_n, sum(size) as total_size, max(size) as largest, count(source_file) as with_source from routines group by 1")
def triage(spark, sf):
    return table(spark, sf, "routines").groupBy("binary_id").agg(F.count(F.lit(1)).alias("routines_n"), F.count_if("imported").alias("imported_n"), F.count_if("thunk").alias("thunks_n"), F.sum("size").alias("total_size"), F.max("size").alias("largest"), F.count("source_file").alias("with_source"))


@book.add("d10_kind_counts", "select code_kind, calltype, count(*) as n from routines group by 1, 2")
def kind_counts(spark, sf):
    return table(spark, sf, "routines").groupBy("code_kind", "calltype").agg(F.count(F.lit(1)).alias("n"))


@book.add("d10_binary_statistics", "with r as (select binary_id, count(*) as routines_n from routines group by 1), s as (select binary_id, count(distinct string_id) as strings_n from strings group by 1), f as (select binary_id, count(*) as files_n from source_files group by 1) select r.binary_id, routines_n, coalesce(strings_n, 0) as strings_n, coalesce(files_n, 0) as files_n from r left join s using (binary_id) left join f using (binary_id)")
def binary_statistics(spark, sf):
    r = table(spark, sf, "routines").groupBy("binary_id").agg(F.count(F.lit(1)).alias("routines_n"))
    s = table(spark, sf, "strings").select("binary_id", "string_id").distinct().groupBy("binary_id").agg(F.count(F.lit(1)).alias("strings_n"))
    f = table(spark, sf, "source_files").groupBy("binary_id").agg(F.count(F.lit(1)).alias("files_n"))
    return r.join(s, "binary_id", "left").join(f, "binary_id", "left").select("binary_id", "routines_n", F.coalesce("strings_n", F.lit(0)).alias("strings_n"), F.coalesce("files_n", F.lit(0)).alias("files_n"))


@book.add("h8_largest_members", "with r as (select binary_id, name, size, row_number() over (partition by binary_id order by size desc, routine_id) as r from routines) select binary_id, string_agg(name || '=' || size, ';' order by r) as members from r where r <= 8 group by 1")
def largest_members(spark, sf):
    """Nested list of the eight largest routines per binary: ranked per salt first, so that nothing unbounded is gathered."""
    order = [F.desc("size"), F.col("routine_id")]
    r = table(spark, sf, "routines").withColumn("salt", F.pmod(F.xxhash64("routine_id"), F.lit(64)))
    r = r.withColumn("r", F.row_number().over(Window.partitionBy("binary_id", "salt").orderBy(*order))).where("r <= 8")
    r = r.withColumn("r", F.row_number().over(Window.partitionBy("binary_id").orderBy(*order))).where("r <= 8")
    item = F.concat("name", F.lit("="), F.col("size").cast("string"))
    return r.groupBy("binary_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", item.alias("item")))), lambda x: x["item"]), ";").alias("members"))


@book.add("d18_degrees", "with o as (select binary_id, src as a, count(*) as out_degree, count(distinct dst) as callees from calls group by 1, 2), i as (select binary_id, dst as a, count(*) as in_degree, count(distinct src) as callers from calls group by 1, 2) select r.routine_id, coalesce(out_degree, 0) as out_degree, coalesce(callees, 0) as callees, coalesce(in_degree, 0) as in_degree, coalesce(callers, 0) as callers from routines r left join o on o.binary_id = r.binary_id and o.a = r.address left join i on i.binary_id = r.binary_id and i.a = r.address")
def degrees(spark, sf):
    """Degrees with repetitions and distinct neighbours, both from counts per edge: the hot callee's rows collapse in the map tasks."""
    edge = table(spark, sf, "calls").groupBy("binary_id", "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    o = edge.groupBy("binary_id", F.col("src").alias("address")).agg(F.sum("n").alias("out_degree"), F.count(F.lit(1)).alias("callees"))
    i = edge.groupBy("binary_id", F.col("dst").alias("address")).agg(F.sum("n").alias("in_degree"), F.count(F.lit(1)).alias("callers"))
    r = table(spark, sf, "routines").select("routine_id", "binary_id", "address").join(o, ["binary_id", "address"], "left").join(i, ["binary_id", "address"], "left")
    return r.select("routine_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("out_degree", "callees", "in_degree", "callers")])


@book.add("d20_scores", "select r.binary_id, round(count(*) filter (where f.name = r.name) / greatest(1, count(*)), 3) as names, round(count(*) filter (where f.size = r.size) / greatest(1, count(*)), 3) as sizes from routines r left join function_rows f on f.binary_id = r.binary_id and f.address = r.address group by 1")
def scores(spark, sf):
    f = table(spark, sf, "function_rows").select("binary_id", "address", F.col("name").alias("fn"), F.col("size").alias("fs"))
    j = table(spark, sf, "routines").join(f, ["binary_id", "address"], "left")
    rate = lambda ok: F.round(F.count_if(ok) / F.greatest(F.lit(1), F.count(F.lit(1))), 3)
    return j.groupBy("binary_id").agg(rate(F.col("fn") == F.col("name")).alias("names"), rate(F.col("fs") == F.col("size")).alias("sizes"))


@book.add("d21_member_hits", "select routine_id, len(list_filter(list_zip(params, local_vars, true), lambda z: lower(struct_extract_at(z, 1).type) = lower(struct_extract_at(z, 2).type))) as hits from routines where params is not null and local_vars is not null")
def member_hits(spark, sf):
    """Positions at which two lists of typed members agree."""
    z = F.filter(F.arrays_zip("params", "local_vars"), lambda x: F.lower(x["params"]["type"]) == F.lower(x["local_vars"]["type"]))
    return table(spark, sf, "routines").where("params is not null and local_vars is not null").select("routine_id", F.size(z).alias("hits"))


@book.add("d25_cube", "select code_kind, segment, count(*) as n, sum(size) as total from routines group by cube (code_kind, segment)")
def cube(spark, sf):
    return table(spark, sf, "routines").cube("code_kind", "segment").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))


@book.add("f2_source_chunks", "select routine_id, source_file, (row_number() over (partition by binary_id, source_file order by address) - 1) // 50 as chunk from routines where source_file is not null")
def source_chunks(spark, sf):
    return table(spark, sf, "routines").where("source_file is not null").select("routine_id", "source_file", F.floor((F.row_number().over(Window.partitionBy("binary_id", "source_file").orderBy("address")) - 1) / 50).alias("chunk"))


@book.add("f3_common_root", "with s as (select distinct binary_id, string_split(path, '/') as p from source_files), d as (select binary_id, p[1:len(p) - 1] as p from s), k as (select binary_id, k, count(distinct p[1:k]) as kinds, min(len(p)) over (partition by binary_id) as shortest, any_value(array_to_string(p[1:k], '/')) as root from (select *, unnest(range(1, len(p) + 1)) as k from d) group by binary_id, k, p), g as (select binary_id, k, count(*) as n, min(root) as lo, max(root) as hi, min(shortest) as shortest from k group by 1, 2), m as (select binary_id, min(len(p)) as shortest from d group by 1) select m.binary_id, coalesce(max(lo) filter (where lo = hi and k <= m.shortest), '') as root from m left join g using (binary_id) group by 1")
def common_root(spark, sf):
    """Longest folder that all paths of a binary begin with. The common start of many sorted texts is that of the smallest and the greatest."""
    d = table(spark, sf, "source_files").select("binary_id", F.split("path", "/").alias("p")).select("binary_id", F.slice("p", F.lit(1), F.size("p") - 1).alias("d"))
    b = d.groupBy("binary_id").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    same = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.size("lo"), F.size("hi")), F.lit(1))), lambda k: F.slice("lo", F.lit(1), k) == F.slice("hi", F.lit(1), k))
    n = F.aggregate(same, F.lit(0), lambda a, x: a + x.cast("int"))
    return b.withColumn("n", n).select("binary_id", F.array_join(F.slice("lo", F.lit(1), F.least(F.col("n"), F.size("lo"))), "/").alias("root"))


@book.add("f4_segment_chunks", "select routine_id, segment || case when count(*) over w > 50 then '_' || ((row_number() over (partition by binary_id, segment order by address) - 1) // 50) else '' end as label from routines where segment is not null window w as (partition by binary_id, segment)")
def segment_chunks(spark, sf):
    """Chunks of fifty by address. Ranks come from counts per address block, so a segment with most routines isn't one task's window."""
    r = ranked(table(spark, sf, "routines").where("segment is not null").select("routine_id", "binary_id", "segment", "address"), ["binary_id", "segment"], "address", "k", most="all")
    return r.select("routine_id", F.concat("segment", F.when(F.col("all") > 50, F.concat(F.lit("_"), F.floor((F.col("k") - 1) / 50).cast("string"))).otherwise("")).alias("label"))


@book.add("f5_support_groups", "select routine_id, code_kind || ':' || coalesce(segment, '-') as grp, (row_number() over (partition by binary_id, code_kind, segment order by address) - 1) // 50 as chunk from routines where code_kind <> 'app'")
def support_groups(spark, sf):
    """Chunks of fifty by address, ranked in blocks of addresses."""
    r = ranked(table(spark, sf, "routines").where("code_kind <> 'app'").select("routine_id", "binary_id", "code_kind", "segment", "address"), ["binary_id", "code_kind", "segment"], "address", "k")
    return r.select("routine_id", F.concat("code_kind", F.lit(":"), F.coalesce("segment", F.lit("-"))).alias("grp"), F.floor((F.col("k") - 1) / 50).alias("chunk"))


@book.add("g4_latest_render", "select binary_id, cast(address as varchar) as address, render_id from renders qualify row_number() over (partition by binary_id, address order by rendered_at desc, render_id desc) = 1")
def latest_render(spark, sf):
    """The last render of each address, null times first; partial maxima in the map tasks."""
    return table(spark, sf, "renders").groupBy("binary_id", "address").agg(F.max(F.struct("rendered_at", "render_id")).alias("x")).select("binary_id", F.col("address").cast("string").alias("address"), "x.render_id")


@book.add("g6_line_offsets", "select function_row_id, coalesce(sum(line_end - line_start + 3) over (partition by binary_id, source_file order by line_start, function_row_id rows between unbounded preceding and 1 preceding), 0) as offset_lines from function_rows where source_file is not null and line_start is not null")
def line_offsets(spark, sf):
    """Running line offset of the functions of a file, two separator lines between them."""
    w = Window.partitionBy("binary_id", "source_file").orderBy("line_start", "function_row_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf, "function_rows").where("source_file is not null and line_start is not null").select("function_row_id", F.coalesce(F.sum(F.col("line_end") - F.col("line_start") + 3).over(w), F.lit(0)).alias("offset_lines"))


@book.add("g8_frames", "select event_id, lag(value) over w as previous, round(avg(value) over (w rows between 2 preceding and current row), 6) as moving, ntile(4) over w as quarter from events window w as (partition by user_id order by ts, event_id)")
def frames(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", F.lag("value").over(w).alias("previous"), F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6).alias("moving"), F.ntile(4).over(w).alias("quarter"))


@book.add("i1_inventory_diff", "select coalesce(r.binary_id, f.binary_id) as binary_id, case when f.address is null then 'added' when r.address is null then 'removed' else 'common' end as state, count(*) as n from (select distinct binary_id, address from routines) r full join (select distinct binary_id, address from function_rows) f on f.binary_id = r.binary_id and f.address = r.address group by 1, 2")
def inventory_diff(spark, sf):
    a = table(spark, sf, "routines").select("binary_id", "address").distinct().withColumn("new", F.lit(True))
    b = table(spark, sf, "function_rows").select("binary_id", "address").distinct().withColumn("old", F.lit(True))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("common")
    return a.join(b, ["binary_id", "address"], "full").groupBy("binary_id", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@book.add("i2_changed_rows", "select r.routine_id, f.function_row_id, case when f.address is null then 'added' when r.address is null then 'removed' when r.name <> f.name then 'renamed' when r.size <> f.size then 'resized' else 'same' end as state from routines r full join function_rows f on f.binary_id = r.binary_id and f.address = r.address")
def changed_rows(spark, sf):
    f = table(spark, sf, "function_rows").select("binary_id", "address", "function_row_id", F.col("name").alias("fn"), F.col("size").alias("fs"))
    r = table(spark, sf, "routines").select("binary_id", "address", "routine_id", "name", "size")
    state = F.when(F.col("function_row_id").isNull(), "added").when(F.col("routine_id").isNull(), "removed").when(F.col("name") != F.col("fn"), "renamed").when(F.col("size") != F.col("fs"), "resized").otherwise("same")
    return r.join(f, ["binary_id", "address"], "full").select("routine_id", "function_row_id", state.alias("state"))


_FILE = r"regexp_extract({}, '([^/\\]*)$', 1)"


@book.add("i5_dirty_set", f"with ch as (select r.binary_id, r.address from routines r join function_rows f on f.binary_id = r.binary_id and f.address = r.address where r.name <> f.name or r.size <> f.size or {_FILE.format('f.source_file')} <> {_FILE.format('r.source_file')}), d as (select * from ch union select c.binary_id, c.src from calls c join ch on ch.binary_id = c.binary_id and ch.address = c.dst) select r.routine_id from routines r join d on d.binary_id = r.binary_id and d.address = r.address")
def dirty_set(spark, sf):
    """Renamed, resized and moved routines and their direct callers, as far as they are in the inventory."""
    file = lambda c: F.regexp_extract(c, r"([^/\\]*)$", 1)
    f = table(spark, sf, "function_rows").select("binary_id", "address", F.col("name").alias("fn"), F.col("size").alias("fs"), file("source_file").alias("ff"))
    r = table(spark, sf, "routines").select("routine_id", "binary_id", "address", "name", "size", file("source_file").alias("rf"))
    changed = r.join(f, ["binary_id", "address"]).where("name <> fn or size <> fs or ff <> rf").select("binary_id", "address")
    callers = table(spark, sf, "calls").select("binary_id", "src", F.col("dst").alias("address")).distinct().join(changed, ["binary_id", "address"], "left_semi").select("binary_id", F.col("src").alias("address"))
    return r.join(changed.unionByName(callers), ["binary_id", "address"], "left_semi").select("routine_id")


@book.add("i6_stale_files", r"select file_id from source_files s where not exists (select 1 from function_rows f where regexp_replace(regexp_replace(replace(f.source_file, '\', '/'), '^\./', ''), '/+', '/', 'g') = s.path)")
def stale_files(spark, sf):
    used = table(spark, sf, "function_rows").select(clean_path(F.col("source_file")).alias("path"))
    return table(spark, sf, "source_files").join(used, "path", "left_anti").select("file_id")


@book.add("i7_unfinished", "select r.routine_id from routines r where not exists (select 1 from renders x where x.binary_id = r.binary_id and x.address = r.address and x.failure is null)")
def unfinished(spark, sf):
    """Routines without a successful render: what a resumed run still has to do."""
    done = table(spark, sf, "renders").where("failure is null").select("binary_id", "address")
    return table(spark, sf, "routines").join(done, ["binary_id", "address"], "left_anti").select("routine_id")


@book.add("j33_islands", "with d as (select distinct binary_id, function_row_id as i from function_rows), g as (select binary_id, i, i - row_number() over (partition by binary_id order by i) as k from d) select binary_id, min(i) as first_i, max(i) as last_i from g group by binary_id, k")
def islands(spark, sf):
    """Consecutive ids of a binary as ranges. Starts and ends are found by self-joins on i-1 and i+1 and paired by rank; ranks are made in blocks of ids."""
    d = table(spark, sf, "function_rows").select("binary_id", F.col("function_row_id").alias("i")).distinct()
    starts = d.join(d.select("binary_id", (F.col("i") + 1).alias("i")), ["binary_id", "i"], "left_anti")
    ends = d.join(d.select("binary_id", (F.col("i") - 1).alias("i")), ["binary_id", "i"], "left_anti")
    a, b = (ranked(x, ["binary_id"], "i", "r").withColumnRenamed("i", name) for x, name in ((starts, "first_i"), (ends, "last_i")))
    return a.join(b, ["binary_id", "r"]).select("binary_id", "first_i", "last_i")
