"""Joins and lookups: call graph, containment, binding of imports to exports, enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import scalar as S
from lodestrata.operators.ranges import asof_join, interval_join
from lodestrata.plans.helpers import Book
from lodestrata.plans.problems import clean_dll, clean_path, clean_symbol
from lodestrata.session import table

book = Book()
QUERIES, ORACLE = book.queries, book.oracle
_DLL = r"regexp_replace(lower(trim(dll)), '^.*[/\\]', '')"
_SYM = "regexp_replace(regexp_replace(name, '^__imp_', ''), '@.*$', '', 's')"
_EXP = f"e as (select exp_ord, {_DLL} as dll, {_SYM} as name, address, ordinal, forwarder, weak, version from exports)"
_IMP = f"i as (select distinct import_id, binary_id, {_DLL} as dll, {_SYM} as name from imports where dll is not null and name is not null)"


def exports(spark, sf):
    return table(spark, sf, "exports").select("exp_ord", clean_dll(F.col("dll")).alias("dll"), clean_symbol(F.col("name")).alias("name"), "address", "ordinal", "forwarder", "weak", "version")


def imports(spark, sf):
    return table(spark, sf, "imports").where("dll is not null and name is not null").select("import_id", "binary_id", clean_dll(F.col("dll")).alias("dll"), clean_symbol(F.col("name")).alias("name")).distinct()


@book.add("c1_call_graph", "select c.binary_id, cast(c.src as varchar) as src, cast(c.dst as varchar) as dst, c.ord, s.name as src_name, d.name as dst_name from calls c left join routines s on s.binary_id = c.binary_id and s.address = c.src left join routines d on d.binary_id = c.binary_id and d.address = c.dst")
def call_graph(spark, sf):
    r = table(spark, sf, "routines")
    s, d = r.select("binary_id", F.col("address").alias("src"), F.col("name").alias("src_name")), r.select("binary_id", F.col("address").alias("dst"), F.col("name").alias("dst_name"))
    return table(spark, sf, "calls").join(s, ["binary_id", "src"], "left").join(d, ["binary_id", "dst"], "left").select("binary_id", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "ord", "src_name", "dst_name")


_SEGMENTS = "g as (select binary_id, segment, min(address) as lo, max(address + greatest(size, 1)) as hi from routines where segment is not null group by 1, 2)"


@book.add("c2_segment_of", f"with {_SEGMENTS} select f.function_row_id, min(g.segment) as segment from function_rows f left join g on g.binary_id = f.binary_id and f.address >= g.lo and f.address < g.hi group by 1")
def segment_of(spark, sf):
    """First matching segment (by name) of each exported row."""
    r = table(spark, sf, "routines").where("segment is not null").groupBy("binary_id", "segment").agg(F.min("address").alias("lo"), F.max(F.col("address") + F.greatest("size", F.lit(1))).alias("hi"))
    rows = table(spark, sf, "function_rows").select("function_row_id", "binary_id", "address")
    return interval_join(rows, r, ["binary_id"], "address", "lo", "hi", "segment", ["segment"], 1 << 20).select("function_row_id", "segment")


_PROBES = "p as (select binary_id, src, ord, src + ord * 7 as at from calls)"


@book.add("c3_function_of", f"with {_PROBES} select p.binary_id, cast(p.at as varchar) as at, r.routine_id, case when p.at < r.address + greatest(r.size, 1) then r.routine_id end as inside from p asof left join routines r on p.binary_id = r.binary_id and p.at >= r.address")
def function_of(spark, sf):
    """The routine that begins last before an address, and whether the address is inside it."""
    probes = table(spark, sf, "calls").select("binary_id", (F.col("src") + F.col("ord") * 7).cast("decimal(20,0)").alias("at"))
    r = table(spark, sf, "routines").select("binary_id", "address", "routine_id", (F.col("address") + F.greatest("size", F.lit(1))).alias("end_at"))
    found = asof_join(probes, r, ["binary_id"], "at", "address", ["routine_id", "end_at"])
    return found.select("binary_id", F.col("at").cast("string").alias("at"), "routine_id", F.when(F.col("at") < F.col("end_at"), F.col("routine_id")).alias("inside"))


@book.add("c5_exported_row_of", "select r.routine_id, case when r.address = f.address or r.address < f.address + f.size then f.function_row_id end as function_row_id from routines r asof left join function_rows f on f.binary_id = r.binary_id and r.address >= f.address")
def exported_row_of(spark, sf):
    """Exported row that holds a routine; an exact start counts even with size 0."""
    rows = table(spark, sf, "function_rows").select("binary_id", F.col("address").alias("start"), "function_row_id", F.col("start").alias("start_at"), (F.col("start") + F.col("size")).alias("end_at"))
    found = asof_join(table(spark, sf, "routines").select("routine_id", "binary_id", "address"), rows, ["binary_id"], "address", "start", ["function_row_id", "start_at", "end_at"])
    return found.select("routine_id", F.when((F.col("address") == F.col("start_at")) | (F.col("address") < F.col("end_at")), F.col("function_row_id")).alias("function_row_id"))


@book.add("c6_xrefs_of_routines", "select distinct d.routine_id, '0x' || lower(to_hex(c.src::ubigint)) as ref, s.name as ref_name from calls c join routines d on d.binary_id = c.binary_id and d.address = c.dst left join routines s on s.binary_id = c.binary_id and s.address = c.src")
def xrefs_of_routines(spark, sf):
    r = table(spark, sf, "routines")
    edges = table(spark, sf, "calls").select("binary_id", "src", "dst").distinct()
    d, s = r.select("routine_id", "binary_id", F.col("address").alias("dst")), r.select("binary_id", F.col("address").alias("src"), F.col("name").alias("ref_name"))
    return edges.join(d, ["binary_id", "dst"]).join(s, ["binary_id", "src"], "left").select("routine_id", S.hex_address(F.col("src")).alias("ref"), "ref_name").distinct()


@book.add("c8_address_labels", "select binary_id, cast(a as varchar) as address, label, origin from (select *, row_number() over (partition by binary_id, a order by prio, ord) as r from (select binary_id, vaddr as a, value as label, 'string' as origin, 0 as prio, string_id as ord from strings union all select binary_id, address, name, 'routine', 1, routine_id from routines where not imported union all select binary_id, address, name, 'import', 2, import_id from imports where address is not null)) where r = 1 and a is not null")
def address_labels(spark, sf):
    """strings > routines > imports; within one kind the smallest id. Min of a struct: partial in the map tasks."""
    a = table(spark, sf, "strings").select("binary_id", F.col("vaddr").alias("address"), F.col("value").alias("label"), F.lit("string").alias("origin"), F.lit(0).alias("prio"), F.col("string_id").alias("ord"))
    b = table(spark, sf, "routines").where("not imported").select("binary_id", "address", "name", F.lit("routine"), F.lit(1), "routine_id")
    c = table(spark, sf, "imports").select("binary_id", "address", "name", F.lit("import"), F.lit(2), "import_id")
    return a.union(b).union(c).where("address is not null").groupBy("binary_id", "address").agg(F.min(F.struct("prio", "ord", "label", "origin")).alias("x")).select("binary_id", F.col("address").cast("string").alias("address"), "x.label", "x.origin")


@book.add("c9_function_metadata", "select r.routine_id, coalesce(f.name, r.name) as name, f.line_start, f.line_end, n.renders, n.latest from routines r left join function_rows f on f.binary_id = r.binary_id and f.address = r.address left join (select binary_id, address, count(*) as renders, max(rendered_at) as latest from renders group by 1, 2) n on n.binary_id = r.binary_id and n.address = r.address")
def function_metadata(spark, sf):
    f = table(spark, sf, "function_rows").select("binary_id", "address", F.col("name").alias("exported_name"), "line_start", "line_end")
    n = table(spark, sf, "renders").groupBy("binary_id", "address").agg(F.count(F.lit(1)).alias("renders"), F.max("rendered_at").alias("latest"))
    r = table(spark, sf, "routines").select("routine_id", "binary_id", "address", "name").join(f, ["binary_id", "address"], "left").join(n, ["binary_id", "address"], "left")
    return r.select("routine_id", F.coalesce("exported_name", "name").alias("name"), "line_start", "line_end", "renders", "latest")


@book.add("c33_bind_imports", f"with {_EXP}, {_IMP}, b as (select dll, name, exp_ord, address, count(*) over (partition by dll, name) - 1 as others, row_number() over (partition by dll, name order by weak, exp_ord) as r from e) select i.import_id, b.exp_ord, b.address, b.others from i left join b on b.dll = i.dll and b.name = i.name and b.r = 1")
def bind_imports(spark, sf):
    """The strong definition first, then the first in order; ``others`` are further candidates. The export table is reduced to one row per key before the join."""
    best = exports(spark, sf).where("dll is not null and name is not null").groupBy("dll", "name").agg(F.min(F.struct("weak", "exp_ord", "address")).alias("x"), (F.count(F.lit(1)) - 1).alias("others"))
    return imports(spark, sf).join(best, ["dll", "name"], "left").select("import_id", "x.exp_ord", "x.address", "others")


@book.add("g2_newest_version", f"with {_EXP} select exp_ord from (select exp_ord, row_number() over (partition by dll, name order by version is null, version desc, exp_ord) as r from e where dll is not null and name is not null) where r = 1")
def bind_versions(spark, sf):
    """The row of each name that a lookup by the newest version takes; unversioned rows last."""
    e = exports(spark, sf).where("dll is not null and name is not null")
    best = e.groupBy("dll", "name").agg(F.max(F.struct(F.col("version").isNotNull().alias("has"), "version", (-F.col("exp_ord")).alias("o"))).alias("x"))
    return best.select((-F.col("x.o")).alias("exp_ord"))


@book.add("j7_candidate_names", f"with {_EXP}, {_IMP}, k as (select distinct dll, name from i), c as (select dll, name, unnest([name, name || 'W', name || 'A', '_' || name]) as candidate, unnest([0, 1, 2, 3]) as pos from k), e1 as (select distinct dll, name from e) select c.dll, c.name, arg_min(c.candidate, c.pos) as found from c join e1 on e1.dll = c.dll and e1.name = c.candidate group by 1, 2")
def candidate_names(spark, sf):
    keys = imports(spark, sf).select("dll", "name").distinct()
    forms = F.array(F.col("name"), F.concat("name", F.lit("W")), F.concat("name", F.lit("A")), F.concat(F.lit("_"), F.col("name")))
    tried = keys.select("dll", "name", F.posexplode(forms).alias("pos", "candidate"))
    there = exports(spark, sf).select("dll", F.col("name").alias("candidate")).distinct()
    return tried.join(there, ["dll", "candidate"]).groupBy("dll", "name").agg(F.min_by("candidate", "pos").alias("found"))


_PATH = r"regexp_replace(regexp_replace(replace({}, '\', '/'), '^\./', ''), '/+', '/', 'g')"


@book.add("c27_path_lookup", f"with f as (select function_row_id, {_PATH.format('source_file')} as p from function_rows where source_file is not null), s as (select file_id, {_PATH.format('path')} as p from source_files), a as (select p, min(file_id) as id from s group by 1), b as (select lower(p) as p, min(file_id) as id from s group by 1) select f.function_row_id, coalesce(a.id, b.id) as file_id from f left join a on a.p = f.p left join b on b.p = lower(f.p)")
def path_lookup(spark, sf):
    """Exact path, else the path in lower case."""
    s = table(spark, sf, "source_files").select("file_id", clean_path(F.col("path")).alias("p"))
    exact, folded = s.groupBy("p").agg(F.min("file_id").alias("a")), s.groupBy(F.lower("p").alias("lp")).agg(F.min("file_id").alias("b"))
    f = table(spark, sf, "function_rows").where("source_file is not null").select("function_row_id", clean_path(F.col("source_file")).alias("p")).withColumn("lp", F.lower("p"))
    return f.join(exact, "p", "left").join(folded, "lp", "left").select("function_row_id", F.coalesce("a", "b").alias("file_id"))


_FEW = "f as (select binary_id, name, address from function_rows qualify count(*) over (partition by binary_id, name) <= 4), r as (select binary_id, name, address from routines qualify count(*) over (partition by binary_id, name) <= 4)"


@book.add("c30_delta_choice", f"with {_FEW}, d as (select f.binary_id, f.address - r.address as delta, count(*) as votes from f join r on r.binary_id = f.binary_id and r.name = f.name group by 1, 2 having count(*) >= 3), b as (select binary_id, cast(delta as bigint) as delta, votes from d qualify row_number() over (partition by binary_id order by votes desc, delta = 0 desc, delta) = 1) select x.binary_id, coalesce(b.delta, 0) as delta, coalesce(b.votes, 0) as votes, b.delta is not null as confirmed from (select distinct binary_id from function_rows) x left join b using (binary_id)")
def delta_choice(spark, sf):
    """The most confirmed shift between two inventories of a binary: by names on at most four rows of either, with three votes or more; no shift wins
    ties, then the smallest; without any such shift none is assumed, unconfirmed. The limits keep equal names from multiplying."""

    def side(name, at):
        t = table(spark, sf, name).where("name is not null").groupBy("binary_id", "name").agg(F.count(F.lit(1)).alias("n"))
        few = t.where("n <= 4").select("binary_id", "name")
        return table(spark, sf, name).select("binary_id", "name", F.col("address").alias(at)).join(few, ["binary_id", "name"], "left_semi")

    votes = side("function_rows", "a").join(side("routines", "b"), ["binary_id", "name"]).groupBy("binary_id", (F.col("a") - F.col("b")).alias("delta")).agg(F.count(F.lit(1)).alias("votes")).where("votes >= 3")
    best = votes.groupBy("binary_id").agg(F.max(F.struct("votes", (F.col("delta") == 0).alias("none"), (-F.col("delta")).alias("minus"))).alias("x"))
    every = table(spark, sf, "function_rows").select("binary_id").distinct().join(best, "binary_id", "left")
    return every.select("binary_id", F.coalesce((-F.col("x.minus")).cast("bigint"), F.lit(0)).alias("delta"), F.coalesce("x.votes", F.lit(0)).alias("votes"), F.col("x").isNotNull().alias("confirmed"))


_KEY = r"case when regexp_replace(regexp_replace(regexp_replace(name, '@.*$', '', 's'), '^(?:sym\.imp\.|loc\.imp\.|sym\.|imp\.|__imp_)+', ''), '^_+', '') = '' then regexp_replace(regexp_replace(name, '@.*$', '', 's'), '^(?:sym\.imp\.|loc\.imp\.|sym\.|imp\.|__imp_)+', '') else regexp_replace(regexp_replace(regexp_replace(name, '@.*$', '', 's'), '^(?:sym\.imp\.|loc\.imp\.|sym\.|imp\.|__imp_)+', ''), '^_+', '') end"


@book.add("c31_call_sites", f"with k as (select distinct binary_id, {_KEY} as key from imports where name is not null), r as (select binary_id, address, {_KEY} as key, size from routines), stub as (select r.binary_id, r.address, r.key from r join k on k.binary_id = r.binary_id and k.key = r.key where r.size <= 64), site as (select distinct c.binary_id, s.key, c.src from calls c join stub s on s.binary_id = c.binary_id and s.address = c.dst) select binary_id, key, count(*) as sites from site where not exists (select 1 from stub t where t.binary_id = site.binary_id and t.address = site.src) group by 1, 2")
def call_sites(spark, sf):
    """Callers of an import through its stubs (routines of at most 64 bytes under its key); stubs themselves are no call sites."""
    keys = table(spark, sf, "imports").where("name is not null").select("binary_id", S.link_key(F.col("name")).alias("key")).distinct()
    stubs = table(spark, sf, "routines").where("size <= 64").select("binary_id", "address", S.link_key(F.col("name")).alias("key")).join(keys, ["binary_id", "key"], "left_semi")
    sites = table(spark, sf, "calls").select("binary_id", "src", F.col("dst").alias("address")).distinct().join(stubs, ["binary_id", "address"]).select("binary_id", "key", "src").distinct()
    sites = sites.join(stubs.select("binary_id", F.col("address").alias("src")).distinct(), ["binary_id", "src"], "left_anti")
    return sites.groupBy("binary_id", "key").agg(F.count(F.lit(1)).alias("sites"))


@book.add("c33_importers_of_exports", f"with {_EXP}, {_IMP}, n as (select dll, name, count(distinct import_id) as imports, count(distinct binary_id) as binaries from i group by 1, 2) select e.exp_ord, coalesce(n.imports, 0) as imports, coalesce(n.binaries, 0) as binaries from e left join n on n.dll = e.dll and n.name = e.name")
def importers_of_exports(spark, sf):
    """Both distinct counts per export key, over rows spread by import and binary first."""
    i = imports(spark, sf)
    a = i.groupBy("dll", "name", "import_id").count().groupBy("dll", "name").agg(F.count(F.lit(1)).alias("imports"))
    b = i.groupBy("dll", "name", "binary_id").count().groupBy("dll", "name").agg(F.count(F.lit(1)).alias("binaries"))
    return exports(spark, sf).join(a, ["dll", "name"], "left").join(b, ["dll", "name"], "left").select("exp_ord", F.coalesce("imports", F.lit(0)).alias("imports"), F.coalesce("binaries", F.lit(0)).alias("binaries"))


@book.add("c39_xrefs", "select binary_id, cast(src as varchar) as address, 'from' as direction, cast(dst as varchar) as other from calls union select binary_id, cast(dst as varchar), 'to', cast(src as varchar) from calls")
def xrefs(spark, sf):
    c = table(spark, sf, "calls").select("binary_id", "src", "dst").distinct()
    return c.select("binary_id", F.expr("stack(2, cast(src as string), 'from', cast(dst as string), cast(dst as string), 'to', cast(src as string)) as (address, direction, other)"))


@book.add("c43_compare_inventories", "select r.routine_id, f.function_row_id is not null as found, coalesce(f.name = r.name, false) as same_name, coalesce(f.size = r.size, false) as same_size from routines r left join function_rows f on f.binary_id = r.binary_id and f.address = r.address")
def compare_inventories(spark, sf):
    f = table(spark, sf, "function_rows").select("binary_id", "address", "function_row_id", F.col("name").alias("fn"), F.col("size").alias("fs"))
    r = table(spark, sf, "routines").select("routine_id", "binary_id", "address", "name", "size").join(f, ["binary_id", "address"], "left")
    return r.select("routine_id", F.col("function_row_id").isNotNull().alias("found"), F.coalesce(F.col("fn") == F.col("name"), F.lit(False)).alias("same_name"), F.coalesce(F.col("fs") == F.col("size"), F.lit(False)).alias("same_size"))


@book.add("c44_best_type", "with p as (select distinct r.routine_id, r.binary_id, x.name || ' ' || x.type as member from routines r, unnest(r.params) as t(x) where r.code_kind <> 'app' ), q as (select distinct r.routine_id, r.binary_id, x.name || ' ' || x.type as member from routines r, unnest(r.params) as t(x) where r.code_kind = 'app'), n as (select p.routine_id, q.routine_id as best, count(*) as shared from p join q on q.binary_id = p.binary_id and q.member = p.member group by 1, 2) select routine_id, best, shared from n qualify row_number() over (partition by routine_id order by shared desc, best) = 1")
def best_type(spark, sf):
    """For each routine outside the app the app routine of its binary that shares most (name, type) parameters.

    Routines with equal parameters are one kind; kinds are joined on their members, so a parameter that most routines have pairs kinds, not routines.
    """
    r = table(spark, sf, "routines").where("size(params) > 0 and code_kind is not null").select("routine_id", "binary_id", (F.col("code_kind") == "app").alias("app"), F.array_sort(F.array_distinct(F.transform("params", lambda x: F.concat(x["name"], F.lit(" "), x["type"])))).alias("members"))
    r = r.withColumn("members", F.array_compact("members"))
    kinds = r.groupBy("binary_id", "app", "members").agg(F.min("routine_id").alias("first"))  # routines with equal members are one kind
    m = kinds.withColumn("member", F.explode("members"))
    p, q = m.where("not app").select("binary_id", F.col("first").alias("kind"), "member"), m.where("app").select("binary_id", F.col("first").alias("best"), "member")
    n = p.join(q, ["binary_id", "member"]).groupBy("binary_id", "kind", "best").agg(F.count(F.lit(1)).alias("shared"))
    top = n.groupBy("binary_id", "kind").agg(F.max(F.struct("shared", (-F.col("best")).alias("b"))).alias("x"))
    of = kinds.where("not app").select("binary_id", "members", F.col("first").alias("kind")).join(top, ["binary_id", "kind"]).select("binary_id", "members", (-F.col("x.b")).alias("best"), "x.shared")
    return r.where("not app").join(of, ["binary_id", "members"]).select("routine_id", "best", "shared")
