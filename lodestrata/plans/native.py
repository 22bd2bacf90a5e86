"""Lookups, predicates, summaries and change sets over the inventory of native programs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import scalar as S
from lodestrata.plans.helpers import Book
from lodestrata.session import table

book = Book()
QUERIES, ORACLE = book.queries, book.oracle
_HEX = "'0x' || lower(to_hex({}::ubigint))"


@book.add("a2_collect", "with o as (select binary_id, src as a, count(distinct dst) as n from calls group by 1, 2), i as (select binary_id, dst as a, count(distinct src) as n from calls group by 1, 2) select r.routine_id, coalesce(o.n, 0) as outdegree, coalesce(i.n, 0) as indegree, r.segment is not null as placed from routines r left join o on o.binary_id = r.binary_id and o.a = r.address left join i on i.binary_id = r.binary_id and i.a = r.address where r.name <> ''")
def collect(spark, sf):
    """The inventory with its degree columns overwritten from the call graph."""
    e = table(spark, sf, "calls").select("binary_id", "src", "dst").distinct()
    o = e.groupBy("binary_id", F.col("src").alias("address")).agg(F.count(F.lit(1)).alias("o"))
    i = e.groupBy("binary_id", F.col("dst").alias("address")).agg(F.count(F.lit(1)).alias("i"))
    r = table(spark, sf, "routines").where("name <> ''").select("routine_id", "binary_id", "address", "segment").join(o, ["binary_id", "address"], "left").join(i, ["binary_id", "address"], "left")
    return r.select("routine_id", F.coalesce("o", F.lit(0)).alias("outdegree"), F.coalesce("i", F.lit(0)).alias("indegree"), F.col("segment").isNotNull().alias("placed"))


@book.add("a8_type_catalog", "select x.type as name, count(*) as uses, min(routine_id) as first_in from routines, unnest(params) as t(x) where x.type is not null and x.type <> '' group by 1")
def type_catalog(spark, sf):
    """Types that parameters name; entries without a name or declaration are no types."""
    x = table(spark, sf, "routines").select("routine_id", F.explode("params").alias("x")).where("x.type <> ''")
    return x.groupBy(F.col("x.type").alias("name")).agg(F.count(F.lit(1)).alias("uses"), F.min("routine_id").alias("first_in"))


@book.add("b3_types_by_kind", "select distinct r.return_type as name, r.code_kind as kind from routines r where regexp_matches(r.return_type, '(?i)int|char') and r.code_kind = 'app'")
def types_by_kind(spark, sf):
    return table(spark, sf, "routines").where(S.search(F.col("return_type"), "int|char") & (F.col("code_kind") == "app")).select(F.col("return_type").alias("name"), F.col("code_kind").alias("kind")).distinct()


@book.add("b4_type_lookup", "select min(routine_id) as routine_id, return_type as name from routines where return_type = 'int' group by 2")
def type_lookup(spark, sf):
    """The first exact match of a type name."""
    return table(spark, sf, "routines").where("return_type = 'int'").groupBy(F.col("return_type").alias("name")).agg(F.min("routine_id").alias("routine_id"))


#: File names of runtime libraries (fixed values).
RUNTIME = r"(?i)^(msvc[pr]\d+[a-z]*|vcruntime\d+(_\d+)?|ucrtbased?|concrt\d+|vccorlib\d+|vcomp\d+|mfc\d+[a-z]*|atl\d+|api-ms-win-.*|ext-ms-win-.*|libgcc_s_[a-z0-9_]+-\d+|libstdc\+\+-\d+|libwinpthread-\d+|libgomp-\d+|libc|libm|libdl|librt|libpthread|libresolv|libutil|ld-linux(-[a-z0-9_-]+)?|libstdc\+\+|libgcc_s|libatomic|libgomp|libc\+\+(abi)?|libunwind)(\.dll|\.so(\.[0-9.]+)?|\.dylib|\.[0-9.]+\.dylib)?$"
#: Names of the managed framework (fixed values).
FRAMEWORK = r"(?i)^(System(\..*)?|Microsoft\.(CSharp|VisualBasic(\..*)?|Win32\..*|Extensions\..*)|mscorlib|netstandard|WindowsBase|Presentation(Core|Framework.*))\.dll$"
_BASE = r"regexp_replace(lower(trim(dll)), '^.*[/\\]', '')"


def base_name(c):
    return F.regexp_replace(F.lower(F.trim(c)), r"^.*[/\\]", "")


@book.add("b10_runtime_libraries", f"with d as (select distinct {_BASE} as lib from imports where dll is not null union select unnest(['msvcp140.dll', 'vcruntime140_1.dll', 'libc.so.6', 'libstdc++-6.dll', 'libSystem.dylib', 'app.dll', 'ld-linux-x86-64.so.2', 'libc++abi.1.dylib'])) select lib, regexp_matches(lib, '{RUNTIME}') as runtime from d")
def runtime_libraries(spark, sf):
    known = spark.createDataFrame([(x,) for x in ("msvcp140.dll", "vcruntime140_1.dll", "libc.so.6", "libstdc++-6.dll", "libSystem.dylib", "app.dll", "ld-linux-x86-64.so.2", "libc++abi.1.dylib")], "lib string")
    d = table(spark, sf, "imports").where("dll is not null").select(base_name(F.col("dll")).alias("lib")).union(known).distinct()
    return d.select("lib", F.col("lib").rlike(RUNTIME).alias("runtime"))


@book.add("b11_framework", f"select n as name, regexp_matches(n, '{FRAMEWORK}') as framework from (select unnest(['System.dll', 'System.Text.Json.dll', 'mscorlib.dll', 'Newtonsoft.Json.dll', 'WindowsBase.dll', 'Systematic.dll', 'PresentationFramework.Aero.dll']) as n)")
def framework(spark, sf):
    n = spark.createDataFrame([(x,) for x in ("System.dll", "System.Text.Json.dll", "mscorlib.dll", "Newtonsoft.Json.dll", "WindowsBase.dll", "Systematic.dll", "PresentationFramework.Aero.dll")], "name string")
    return n.select("name", F.col("name").rlike(FRAMEWORK).alias("framework"))


@book.add(
    "b9_job_status",
    f"with first as (select {_BASE} as lib, min(binary_id) as first_id from imports where dll is not null group by 1), j as (select distinct i.binary_id, {_BASE} as lib, kind from imports i where dll is not null) select binary_id, j.lib, kind, case when first_id < binary_id then 'duplicate of ' || first_id when j.lib like '%test%' then 'filtered' when regexp_matches(j.lib, '{RUNTIME}') then 'runtime' when j.lib like '%.so%' then 'no-native' when kind = 'managed' then 'no-managed' else 'pending' end as status from j join first using (lib)",
)
def job_status(spark, sf):
    """The first rule that holds decides what becomes of a file: duplicate, filtered, runtime, kinds that aren't wanted, else pending."""
    j = table(spark, sf, "imports").where("dll is not null").select("binary_id", base_name(F.col("dll")).alias("lib"), "kind").distinct()
    first = j.groupBy("lib").agg(F.min("binary_id").alias("first_id"))
    status = F.when(F.col("first_id") < F.col("binary_id"), F.concat(F.lit("duplicate of "), F.col("first_id").cast("string"))).when(F.contains("lib", F.lit("test")), "filtered").when(F.col("lib").rlike(RUNTIME), "runtime").when(F.contains("lib", F.lit(".so")), "no-native").when(F.col("kind") == "managed", "no-managed").otherwise("pending")
    return j.join(first, "lib").select("binary_id", "lib", "kind", status.alias("status"))


@book.add(
    "b14_interesting_variables",
    "with v as (select routine_id, binary_id, address, x.name as name, x.type as type from routines, unnest(local_vars) as t(x)), w as (select binary_id, dst, count(distinct src) as writers from calls group by 1, 2), k as (select distinct value from strings where value is not null), r as (select distinct v.routine_id, v.name, v.type, concat_ws(',', case when v.type like '%[%' then 'large_byte_array' end, case when k.value is null then 'string_not_in_strings_json' end, case when v.type like '%void*%' or v.type like '%void *%' or contains(lower(v.type), 'code') then 'function_pointer_or_relocation' end, case when w.writers > 1 then 'multiple_writers' end) as reasons from v left join w on w.binary_id = v.binary_id and w.dst = v.address left join k on k.value = v.name where v.name is not null and v.type is not null) select * from r where reasons not in ('', 'string_not_in_strings_json')",
)
def interesting_variables(spark, sf):
    """Variables with the reasons why they are worth a look, beyond a name that no string holds."""
    v = table(spark, sf, "routines").select("routine_id", "binary_id", F.col("address").alias("dst"), F.explode("local_vars").alias("x")).select("routine_id", "binary_id", "dst", "x.name", "x.type").where("name is not null and type is not null")
    w = table(spark, sf, "calls").select("binary_id", "dst", "src").distinct().groupBy("binary_id", "dst").agg(F.count(F.lit(1)).alias("writers"))
    k = table(spark, sf, "strings").where("value is not null").select(F.col("value").alias("name")).distinct().withColumn("known", F.lit(True))
    t = F.col("type")
    reasons = F.concat_ws(",", F.when(F.contains(t, F.lit("[")), "large_byte_array"), F.when(F.col("known").isNull(), "string_not_in_strings_json"), F.when(F.contains(t, F.lit("void*")) | F.contains(t, F.lit("void *")) | F.contains(F.lower(t), F.lit("code")), "function_pointer_or_relocation"), F.when(F.col("writers") > 1, "multiple_writers"))
    j = v.join(w, ["binary_id", "dst"], "left").join(k, "name", "left").select("routine_id", "name", "type", reasons.alias("reasons"))
    return j.where("reasons not in ('', 'string_not_in_strings_json')").distinct()


@book.add("b15_rwx_sections", "select name, perms from (values ('.text', 'r-x'), ('.rwx', 'rwx'), ('.data', 'rw-'), ('.jit', '-rwx'), ('', 'rwx'), (null, null)) as t(name, perms) where contains(perms, 'r') and contains(perms, 'w') and contains(perms, 'x')")
def rwx_sections(spark, sf):
    s = spark.createDataFrame([(".text", "r-x"), (".rwx", "rwx"), (".data", "rw-"), (".jit", "-rwx"), ("", "rwx"), (None, None)], "name string, perms string")
    return s.where(F.contains("perms", F.lit("r")) & F.contains("perms", F.lit("w")) & F.contains("perms", F.lit("x")))


@book.add(
    "b22_compiler_and_packer",
    "with n as (select binary_id, bool_or(regexp_matches(lower(name), 'msvcrt|ucrtbase|vcruntime|__security_check_cookie')) as msvc, bool_or(contains(lower(name), '__gxx')) as gxx, count(distinct import_id) as imports_n from imports group by 1), f as (select binary_id, value from (select distinct binary_id, string_id, value from strings where value is not null) qualify row_number() over (partition by binary_id order by string_id) <= 500), s as (select binary_id, bool_or(regexp_matches(lower(value), 'msvcrt|ucrtbase|vcruntime|__security_check_cookie')) as msvc, bool_or(contains(lower(value), 'libgcc')) as gcc from f group by 1) select binary_id, case when coalesce(n.msvc, false) or coalesce(s.msvc, false) then 'MSVC' when coalesce(s.gcc, false) or coalesce(n.gxx, false) then 'GCC/MinGW' end as compiler, coalesce(n.imports_n, 0) <= 5 as few_imports from n full join s using (binary_id)",
)
def compiler_and_packer(spark, sf):
    """Compiler by tokens in import names and in the first 500 strings (ranked per salt first), and the import side of the packer rule."""
    token = "msvcrt|ucrtbase|vcruntime|__security_check_cookie"
    i = table(spark, sf, "imports")
    n = i.groupBy("binary_id").agg(F.bool_or(F.lower("name").rlike(token)).alias("nm"), F.bool_or(F.contains(F.lower("name"), F.lit("__gxx"))).alias("gxx")).join(i.select("binary_id", "import_id").distinct().groupBy("binary_id").agg(F.count(F.lit(1)).alias("imports_n")), "binary_id", "left")
    v = table(spark, sf, "strings").where("value is not null").select("binary_id", "string_id", "value").distinct().withColumn("salt", F.pmod(F.xxhash64("string_id"), F.lit(64)))
    v = v.withColumn("r", F.row_number().over(Window.partitionBy("binary_id", "salt").orderBy("string_id"))).where("r <= 500")
    v = v.withColumn("r", F.row_number().over(Window.partitionBy("binary_id").orderBy("string_id"))).where("r <= 500")
    s = v.groupBy("binary_id").agg(F.bool_or(F.lower("value").rlike(token)).alias("sm"), F.bool_or(F.contains(F.lower("value"), F.lit("libgcc"))).alias("gcc"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return n.join(s, "binary_id", "full").select("binary_id", F.when(yes("nm") | yes("sm"), "MSVC").when(yes("gcc") | yes("gxx"), "GCC/MinGW").alias("compiler"), (F.coalesce("imports_n", F.lit(0)) <= 5).alias("few_imports"))


@book.add("b23_binary_type", "select path, case when contains(lower(coalesce(kind, '') || ' ' || coalesce(fmt, '') || ' ' || path), 'dll') then 'DLL' when contains(lower(coalesce(kind, '') || ' ' || coalesce(fmt, '') || ' ' || regexp_extract(path, '(\\.[^.]*)$', 1)), 'pe') or lower(os) like 'windows%' then 'EXE' else coalesce(nullif(kind, ''), 'unknown') end as type from (values ('a.dll', 'DLL', 'pe', 'windows'), ('b.exe', 'EXEC', 'pe64', 'windows'), ('c', 'EXEC', 'elf64', 'linux'), ('d.so', null, 'elf', 'linux'), ('e', '', 'raw', 'Windows 10')) as t(path, kind, fmt, os)")
def binary_type(spark, sf):
    t = spark.createDataFrame([("a.dll", "DLL", "pe", "windows"), ("b.exe", "EXEC", "pe64", "windows"), ("c", "EXEC", "elf64", "linux"), ("d.so", None, "elf", "linux"), ("e", "", "raw", "Windows 10")], "path string, kind string, fmt string, os string")
    text = F.lower(F.concat_ws(" ", F.coalesce("kind", F.lit("")), F.coalesce("fmt", F.lit("")), F.regexp_extract("path", r"(\.[^.]*)$", 1)))
    return t.select("path", F.when(F.contains(text, F.lit("dll")), "DLL").when(F.contains(text, F.lit("pe")) | F.lower("os").startswith("windows"), "EXE").otherwise(F.coalesce(F.nullif(F.col("kind"), F.lit("")), F.lit("unknown"))).alias("type"))


@book.add("c7_strings_with_xrefs", f"with u as (select distinct s.binary_id, s.string_id, c.src from strings s join calls c on c.binary_id = s.binary_id and c.dst = s.vaddr) select s.string_id, s.value, coalesce(string_agg({_HEX.format('u.src')}, ',' order by u.src), '') as xrefs from (select distinct binary_id, string_id, value from strings) s left join u on u.binary_id = s.binary_id and u.string_id = s.string_id group by s.binary_id, s.string_id, s.value")
def strings_with_xrefs(spark, sf):
    """Every string keeps its references, none or many."""
    s = table(spark, sf, "strings").select("binary_id", "string_id", "value", "vaddr").distinct()
    c = table(spark, sf, "calls").select("binary_id", "src", F.col("dst").alias("vaddr")).distinct()
    u = s.select("binary_id", "string_id", "vaddr").distinct().join(c, ["binary_id", "vaddr"]).groupBy("binary_id", "string_id").agg(F.array_sort(F.collect_set("src")).alias("xs"))
    hexes = F.array_join(F.transform(F.coalesce("xs", F.array().cast("array<decimal(20,0)>")), S.hex_address), ",")
    return s.select("binary_id", "string_id", "value").distinct().join(u, ["binary_id", "string_id"], "left").select("string_id", "value", hexes.alias("xrefs"))


@book.add("c10_cluster_membership", "select r.routine_id, coalesce(f.source_file, r.source_file) as file, f.line_start, f.function_row_id is not null as in_range from routines r left join function_rows f on f.binary_id = r.binary_id and f.address = r.address where coalesce(f.source_file, r.source_file) is not null")
def cluster_membership(spark, sf):
    """The exported range of a routine, else the file of its cluster."""
    f = table(spark, sf, "function_rows").select("binary_id", "address", "function_row_id", F.col("source_file").alias("ff"), "line_start")
    r = table(spark, sf, "routines").select("routine_id", "binary_id", "address", "source_file").join(f, ["binary_id", "address"], "left")
    return r.select("routine_id", F.coalesce("ff", "source_file").alias("file"), "line_start", F.col("function_row_id").isNotNull().alias("in_range")).where("file is not null")


_KEYED = r"regexp_replace(regexp_replace({}, '@.*$', '', 's'), '^[._]+', '')"


@book.add("c40_import_names", f"with i as (select distinct binary_id, address, {_KEYED.format('name')} as bare from imports where name is not null and address is not null), s as (select r.binary_id, r.address, i.bare from routines r join (select distinct binary_id, bare from i) i on i.binary_id = r.binary_id and i.bare = {_KEYED.format('r.name')} where r.imported or r.thunk) select binary_id, cast(address as varchar) as address, bare from i union select binary_id, cast(address as varchar), bare from s")
def import_names(spark, sf):
    """Address to bare import name, by the import itself or by a stub of the same name."""
    i = table(spark, sf, "imports").where("name is not null and address is not null").select("binary_id", "address", S.bare_name(F.col("name")).alias("bare")).distinct()
    r = table(spark, sf, "routines").where("imported or thunk").select("binary_id", "address", S.bare_name(F.col("name")).alias("bare"))
    stubs = r.join(i.select("binary_id", "bare").distinct(), ["binary_id", "bare"], "left_semi").select("binary_id", "address", "bare")
    return i.unionByName(stubs).select("binary_id", F.col("address").cast("string").alias("address"), "bare").distinct()


@book.add("c42_string_users", "with l as (select distinct binary_id, address, unnest(regexp_extract_all(c_text, '\\w+')) as value from renders where c_text is not null), s as (select distinct string_id, value from strings where value <> '') select s.string_id, count(distinct r.name) as users, min(r.name) as first_user from s join l using (value) join routines r on r.binary_id = l.binary_id and r.address = l.address where r.name is not null group by 1")
def string_users(spark, sf):
    """Strings with the routines whose text holds them as a word: words joined with values, then distinct names."""
    words = table(spark, sf, "renders").where("c_text is not null").select("binary_id", "address", F.explode(F.array_distinct(F.regexp_extract_all("c_text", F.lit(r"\w+"), F.lit(0)))).alias("value"))
    s = table(spark, sf, "strings").where("value <> ''").select("string_id", "value").distinct()
    r = table(spark, sf, "routines").where("name is not null").select("binary_id", "address", "name")
    users = words.join(s.select("value").distinct(), "value", "left_semi").join(r, ["binary_id", "address"]).select("value", "name").distinct()
    return s.join(users.groupBy("value").agg(F.count(F.lit(1)).alias("users"), F.min("name").alias("first_user")), "value").select("string_id", "users", "first_user")


@book.add("d22_grade_means", "select doc_kind as key, round(avg(n_chars), 2) as mean from documents where n_chars is not null group by 1")
def grade_means(spark, sf):
    return table(spark, sf, "documents").where("n_chars is not null").groupBy(F.col("doc_kind").alias("key")).agg(F.round(F.avg("n_chars"), 2).alias("mean"))


@book.add("d23_report_rows", "select binary_id as run, count(*) as functions, round(100.0 * count(*) filter (where failure is null) / count(*), 1) as rendered_pct from renders group by 1")
def report_rows(spark, sf):
    return table(spark, sf, "renders").groupBy(F.col("binary_id").alias("run")).agg(F.count(F.lit(1)).alias("functions"), F.round(F.count_if(F.col("failure").isNull()) * 100.0 / F.count(F.lit(1)), 1).alias("rendered_pct"))


@book.add("d24_kind_counts", "select kind, count(distinct binary_id) as binaries from imports where kind is not null group by 1")
def folder_kinds(spark, sf):
    return table(spark, sf, "imports").where("kind is not null").select("kind", "binary_id").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("binaries"))


@book.add("d25_rollup", "select code_kind, segment, grouping_id(code_kind, segment) as level, count(*) as n from routines group by rollup (code_kind, segment)")
def rollup(spark, sf):
    return table(spark, sf, "routines").rollup("code_kind", "segment").agg(F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("n"))


@book.add("d25_grouping_sets", "select code_kind, segment, calltype, count(*) as n, count(distinct binary_id) as binaries from routines group by grouping sets ((code_kind, segment), (calltype), ())")
def grouping_sets(spark, sf):
    r = table(spark, sf, "routines")
    g = r.groupingSets([[F.col("code_kind"), F.col("segment")], [F.col("calltype")], []], "code_kind", "segment", "calltype")
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("binary_id").alias("binaries"))


@book.add("e14_component_graph", "select c.binary_id, coalesce(s.segment, '-') as a, coalesce(d.segment, '-') as b, count(*) as edges from (select distinct binary_id, src, dst from calls) c join routines s on s.binary_id = c.binary_id and s.address = c.src join routines d on d.binary_id = c.binary_id and d.address = c.dst group by 1, 2, 3")
def component_graph(spark, sf):
    """The call graph projected on groups of routines."""
    r = table(spark, sf, "routines").select("binary_id", "address", F.coalesce("segment", F.lit("-")).alias("g"))
    e = table(spark, sf, "calls").select("binary_id", "src", "dst").distinct()
    j = e.join(r.select("binary_id", F.col("address").alias("src"), F.col("g").alias("a")), ["binary_id", "src"]).join(r.select("binary_id", F.col("address").alias("dst"), F.col("g").alias("b")), ["binary_id", "dst"])
    return j.groupBy("binary_id", "a", "b").agg(F.count(F.lit(1)).alias("edges"))


@book.add("f1_cluster_choice", "with n as (select binary_id, count(*) as n from routines where source_file is null and not imported group by 1) select r.routine_id, case when r.imported then null when r.source_file is not null then 'source:' || r.source_file when n.n >= 500 then 'segment:' || coalesce(r.segment, '-') else 'graph' end as cluster_by from routines r left join n using (binary_id)")
def cluster_choice(spark, sf):
    """How each routine comes into a cluster: its source file; where 500 and more of a binary are without one by segment, else by the graph."""
    r = table(spark, sf, "routines").select("routine_id", "binary_id", "imported", "source_file", "segment")
    n = r.where("source_file is null and not imported").groupBy("binary_id").agg(F.count(F.lit(1)).alias("n"))
    how = F.when(F.col("imported"), F.lit(None)).when(F.col("source_file").isNotNull(), F.concat(F.lit("source:"), "source_file")).when(F.col("n") >= 500, F.concat(F.lit("segment:"), F.coalesce("segment", F.lit("-")))).otherwise("graph")
    return r.join(n, "binary_id", "left").select("routine_id", how.alias("cluster_by"))


@book.add("f6_split_oversize", "select routine_id, source_file || case when n > 50 then '_' || ((k - 1) // 50) else '' end as cluster from (select routine_id, binary_id || ':' || source_file as source_file, count(*) over w as n, row_number() over (partition by binary_id, source_file order by routine_id) as k from routines where source_file is not null window w as (partition by binary_id, source_file))")
def split_oversize(spark, sf):
    """Clusters of more than fifty members in chunks of fifty, ranked in blocks of ids."""
    from lodestrata.operators.ranges import ranked

    r = table(spark, sf, "routines").where("source_file is not null").select("routine_id", F.concat_ws(":", "binary_id", "source_file").alias("cluster"))
    x = ranked(r, ["cluster"], "routine_id", "k", most="n")
    return x.select("routine_id", F.concat("cluster", F.when(F.col("n") > 50, F.concat(F.lit("_"), F.floor((F.col("k") - 1) / 50).cast("string"))).otherwise("")).alias("cluster"))


@book.add("g3_best_variant", "select binary_id, arg_min(import_id, (-coalesce(length(kind), 0)) * 1000000000 + import_id) as import_id from imports group by 1")
def best_variant(spark, sf):
    """Per group the row of greatest rank, the first of equals."""
    return table(spark, sf, "imports").groupBy("binary_id").agg(F.min(F.struct((-F.coalesce(F.length("kind"), F.lit(0))).alias("r"), "import_id")).alias("x")).select("binary_id", "x.import_id")


@book.add("g7_first_appearance", "select r.name, min(d.doc_id) as first_doc from (select distinct doc_id, unnest(regexp_extract_all(text, '[A-Za-z_]\\w*')) as name from documents where text is not null) d join (select distinct name from routines where name is not null) r using (name) group by 1")
def first_appearance(spark, sf):
    """First document that mentions each routine name."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w*"), F.lit(0)))).alias("name"))
    r = table(spark, sf, "routines").where("name is not null").select("name").distinct()
    return d.groupBy("name").agg(F.min("doc_id").alias("first_doc")).join(r, "name", "left_semi")


@book.add("g8_range_frames", "select event_id, lead(value) over w as following, round(percent_rank() over (partition by user_id order by ts, event_id), 6) as rank_part, count(*) over (partition by user_id order by ts range between interval '1 hour' preceding and current row) as last_hour from events window w as (partition by user_id order by ts, event_id)")
def range_frames(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    hour = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return table(spark, sf, "events").select("event_id", F.lead("value").over(w).alias("following"), F.round(F.percent_rank().over(w), 6).alias("rank_part"), F.count(F.lit(1)).over(hour).alias("last_hour"))


@book.add("h5_reachable_order", "with roots as (select r.binary_id, r.address from routines r where not imported and not exists (select 1 from calls c where c.binary_id = r.binary_id and c.dst = r.address)), one as (select distinct c.binary_id, c.dst as address from calls c join roots x on x.binary_id = c.binary_id and x.address = c.src join routines t on t.binary_id = c.binary_id and t.address = c.dst and not t.imported) select routine_id, depth from (select r.routine_id, r.binary_id, r.address, 0 as depth from routines r join roots using (binary_id, address) union all select r.routine_id, r.binary_id, r.address, 1 from routines r join one using (binary_id, address)) order by depth, address, routine_id limit 200")
def reachable_order(spark, sf):
    """The first two hundred of what roots reach in a step, by depth and address."""
    from lodestrata.plans.graphs import roots

    top = roots(spark, sf).select("binary_id", "address", "routine_id")
    r = table(spark, sf, "routines").where("not imported").select("binary_id", "address", "routine_id")
    step = table(spark, sf, "calls").select("binary_id", F.col("src").alias("address"), "dst").join(top.select("binary_id", "address"), ["binary_id", "address"], "left_semi").select("binary_id", F.col("dst").alias("address")).distinct().join(r, ["binary_id", "address"])
    both = top.withColumn("depth", F.lit(0)).unionByName(step.withColumn("depth", F.lit(1)))
    return both.orderBy("depth", "address", "routine_id").limit(200).select("routine_id", "depth")


@book.add("h6_search_text", "select string_id, instr(value, 'lock') - 1 as pos from strings where contains(value, 'lock') order by string_id, pos limit 1000")
def search_text(spark, sf):
    """The first thousand hits of a text."""
    return table(spark, sf, "strings").where(F.contains("value", F.lit("lock"))).select("string_id", (F.instr("value", F.lit("lock")) - 1).alias("pos")).orderBy("string_id", "pos").limit(1000)


@book.add("i3_renamed", "with x as (select binary_id, regexp_replace(regexp_replace(name, '^__imp_', ''), '@.*$', '', 's') as key, import_id, loaded_at, name from imports where name is not null), o as (select binary_id, key, arg_min(name, (loaded_at, import_id, name)) as old_name, arg_max(name, (loaded_at, import_id, name)) as new_name from x group by 1, 2) select * from o where old_name <> new_name")
def renamed(spark, sf):
    """Symbols that go by another name in their last row than in their first; both ends by partial minima and maxima."""
    key = F.regexp_replace(F.regexp_replace("name", "^__imp_", ""), "(?s)@.*$", "")
    row = F.struct("loaded_at", "import_id", "name")
    x = table(spark, sf, "imports").where("name is not null").groupBy("binary_id", key.alias("key")).agg(F.min(row).alias("o"), F.max(row).alias("n"))
    return x.where("o.name <> n.name").select("binary_id", "key", F.col("o.name").alias("old_name"), F.col("n.name").alias("new_name"))


@book.add("j34_json_and_time", "select event_id, json_extract_string(props, '$.k') as k, date_trunc('month', ts) as month, date_diff('day', timestamp '2024-01-01', ts) as days, ts + interval '36 hours' as later from events")
def json_and_time(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month"), F.datediff("ts", F.lit("2024-01-01")).cast("bigint").alias("days"), (F.col("ts") + F.expr("interval 36 hours")).alias("later"))


@book.add("j32_ambiguous_names", "select binary_id, lower(name) as name, count(*) as n, min(routine_id) as first_id from routines where name is not null group by 1, 2 having count(*) > 1")
def ambiguous_names(spark, sf):
    """Names that a lookup without letter case must refuse, with the number of candidates."""
    return table(spark, sf, "routines").where("name is not null").groupBy("binary_id", F.lower("name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("routine_id").alias("first_id")).where("n > 1")


@book.add("k3_word_index", "select word, count(*) as renders, min(render_id) as first_render from (select distinct render_id, unnest(regexp_extract_all(c_text, '[A-Za-z_]\\w*')) as word from renders where c_text is not null) group by 1")
def word_index(spark, sf):
    """Identifier to the renders that hold it."""
    w = table(spark, sf, "renders").where("c_text is not null").select("render_id", F.explode(F.array_distinct(F.regexp_extract_all("c_text", F.lit(r"[A-Za-z_]\w*"), F.lit(0)))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("renders"), F.min("render_id").alias("first_render"))


_CHANGED = "ch as (select r.binary_id, r.address from routines r join function_rows f on f.name = r.name and f.binary_id = r.binary_id where r.size <> f.size), added as (select r.binary_id, r.address from routines r where not exists (select 1 from function_rows f where f.binary_id = r.binary_id and f.name = r.name) and not r.imported)"


@book.add(
    "k1_sync_native",
    f"with {_CHANGED}, d as (select * from ch union select c.binary_id, c.src from calls c join ch on ch.binary_id = c.binary_id and ch.address = c.dst union select c.binary_id, c.src from calls c join added on added.binary_id = c.binary_id and added.address = c.dst union select * from added) select r.routine_id, exists (select 1 from added a where a.binary_id = r.binary_id and a.address = r.address) as is_new from routines r join d on d.binary_id = r.binary_id and d.address = r.address where not r.imported",
)
def sync_native(spark, sf):
    """Routines to render again: changed and new ones with their callers, within the wanted ones."""
    f = table(spark, sf, "function_rows").select("binary_id", "name", F.col("size").alias("fs"))
    r = table(spark, sf, "routines").select("routine_id", "binary_id", "address", "name", "size", "imported")
    changed = r.join(f, ["binary_id", "name"]).where("size <> fs").select("binary_id", "address")
    added = r.where("not imported").join(f.select("binary_id", "name"), ["binary_id", "name"], "left_anti").select("binary_id", "address")
    hit = changed.unionByName(added).distinct()
    callers = table(spark, sf, "calls").select("binary_id", "src", F.col("dst").alias("address")).distinct().join(hit, ["binary_id", "address"], "left_semi").select("binary_id", F.col("src").alias("address"))
    dirty = hit.unionByName(callers).distinct()
    return r.where("not imported").join(dirty, ["binary_id", "address"], "left_semi").join(added.distinct().withColumn("new", F.lit(True)), ["binary_id", "address"], "left").select("routine_id", F.coalesce("new", F.lit(False)).alias("is_new"))


@book.add("k9_resume", "with done as (select distinct binary_id, address from renders where failure is null), o as (select routine_id, binary_id, address, row_number() over (partition by binary_id order by address) - 1 as pos from routines where not imported) select o.routine_id, o.pos from o where not exists (select 1 from done d where d.binary_id = o.binary_id and d.address = o.address)")
def resume(spark, sf):
    """What a resumed run still has to do, with its place in address order."""
    from lodestrata.operators.ranges import ranked

    o = ranked(table(spark, sf, "routines").where("not imported").select("routine_id", "binary_id", "address"), ["binary_id"], "address", "k")
    done = table(spark, sf, "renders").where("failure is null").select("binary_id", "address")
    return o.join(done, ["binary_id", "address"], "left_anti").select("routine_id", (F.col("k") - 1).alias("pos"))


@book.add("k11_render_outcome", "select render_id, case when failure is not null then 'failure' when length(c_text) > 2097152 then 'oversize' when length(c_text) < 40 then 'stub' else 'text' end as outcome from renders")
def render_outcome(spark, sf):
    """A failed or oversized function is a row, never an abort."""
    size = F.length("c_text")
    return table(spark, sf, "renders").select("render_id", F.when(F.col("failure").isNotNull(), "failure").when(size > 2_097_152, "oversize").when(size < 40, "stub").otherwise("text").alias("outcome"))
