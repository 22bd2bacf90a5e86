"""Managed assemblies, Android packages and folders of files: resolution, ownership, roots, summaries; over small tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.plans import fixtures as X
from lodestrata.plans.helpers import Book
from lodestrata.plans.native import FRAMEWORK
from lodestrata.session import cut

book = Book()
QUERIES, ORACLE = book.queries, book.oracle
VISIBLE = ("Public", "NestedPublic", "NestedFamily", "NestedFamORAssem")
_VIS = f"recursive up(assembly, token, encl, ok, depth) as (select assembly, token, declaring, visibility in {VISIBLE}, 0 from types union all select u.assembly, u.token, t.declaring, u.ok and t.visibility in {VISIBLE}, u.depth + 1 from up u join types t on t.assembly = u.assembly and t.token = u.encl where u.encl is not null), vis as (select assembly, token, bool_and(ok) as visible from up group by 1, 2)"


def visible(types, most: int = 64):
    """assembly, token, visible: public up to the outermost type. One round per level of nesting."""
    ok = F.col("visibility").isin(*VISIBLE)
    parents = cut(types.select("assembly", F.col("token").alias("at"), F.col("declaring").alias("up"), ok.alias("pok")))
    state = types.select("assembly", "token", F.col("declaring").alias("at"), ok.alias("visible"))
    for _ in range(most):
        state = cut(state)
        if state.where("at is not null").isEmpty():
            return state.select("assembly", "token", "visible")
        state = state.join(parents, ["assembly", "at"], "left").select("assembly", "token", F.col("up").alias("at"), (F.col("visible") & F.coalesce("pok", F.lit(True))).alias("visible"))
    raise RuntimeError("types nested too deeply")


@book.add("b20_visible_types", f"with {_VIS.replace('recursive ', f'recursive {X.TYPES.cte}, ')} select assembly, token, visible from vis")
def visible_types(spark, sf):
    return visible(X.TYPES.frame(spark))


#: Permissions that matter for privacy or safety, by the end of their name (fixed values).
DANGEROUS = "READ_SMS SEND_SMS RECEIVE_SMS READ_CONTACTS WRITE_CONTACTS READ_CALL_LOG WRITE_CALL_LOG CALL_PHONE RECORD_AUDIO CAMERA ACCESS_FINE_LOCATION ACCESS_COARSE_LOCATION ACCESS_BACKGROUND_LOCATION READ_EXTERNAL_STORAGE WRITE_EXTERNAL_STORAGE MANAGE_EXTERNAL_STORAGE REQUEST_INSTALL_PACKAGES SYSTEM_ALERT_WINDOW BIND_ACCESSIBILITY_SERVICE BIND_DEVICE_ADMIN READ_PHONE_STATE GET_ACCOUNTS BLUETOOTH_CONNECT QUERY_ALL_PACKAGES RECEIVE_BOOT_COMPLETED PACKAGE_USAGE_STATS BIND_NOTIFICATION_LISTENER_SERVICE".split()


@book.add("b12_dangerous_permissions", f"with {X.PERMISSIONS.cte} select name from permissions where " + " or ".join(f"ends_with(name, '{d}')" for d in DANGEROUS))
def dangerous(spark, sf):
    return X.PERMISSIONS.frame(spark).where(F.col("name").rlike("(?:" + "|".join(DANGEROUS) + ")$"))


@book.add(
    "c37_owners",
    f"""with {X.TYPES.cte}, {X.METHODS.cte}, sm as (select m.id, o.id as owner from methods o join methods m on m.assembly = o.assembly and m.type_token = o.state_machine),
g as (select m.id, m.assembly, m.type_token, regexp_extract(m.name, '^<([^>]+)>[bg]__', 1) as want from methods m where regexp_matches(m.name, '^<([^>]+)>[bg]__') and m.id not in (select id from sm)),
c as (select g.id, 0 as d, m.id as owner from g join methods m on m.assembly = g.assembly and m.type_token = g.type_token and m.name = want and m.id <> g.id union all select g.id, 1, m.id from g join types t on t.assembly = g.assembly and t.token = g.type_token join methods m on m.assembly = g.assembly and m.type_token = t.declaring and m.name = want)
select id, owner from sm union all select id, owner from (select id, owner, row_number() over (partition by id order by d, owner) as r from c) where r = 1""",
)
def owners(spark, sf, most: int = 64):
    """Generated methods with the method they belong to: by the state machine type, else by the name in angle brackets in the nearest enclosing type."""
    m, t = X.METHODS.frame(spark), X.TYPES.frame(spark)
    by_machine = m.where("state_machine is not null").select("assembly", F.col("state_machine").alias("type_token"), F.col("id").alias("owner")).join(m.select("id", "assembly", "type_token"), ["assembly", "type_token"]).groupBy("id").agg(F.min("owner").alias("owner"))
    named = cut(m.groupBy("assembly", F.col("type_token").alias("at"), F.col("name").alias("want")).agg(F.sort_array(F.collect_list("id")).alias("ids")))  # overloads of one name in one type
    up = t.select("assembly", F.col("token").alias("at"), F.col("declaring").alias("up"))
    want = F.regexp_extract("name", r"^<([^>]+)>[bg]__", 1)
    state = cut(m.join(by_machine.select("id"), "id", "left_anti").select("id", "assembly", F.col("type_token").alias("at"), want.alias("want")).where("want <> ''"))
    found = by_machine
    for _ in range(most):
        if state.isEmpty():
            return found
        s = cut(state.join(named, ["assembly", "at", "want"], "left").withColumn("owner", F.get(F.filter("ids", lambda x: x != F.col("id")), 0)))
        found = found.unionByName(s.where("owner is not null").select("id", "owner"))
        state = cut(s.where("owner is null").join(up, ["assembly", "at"]).where("up is not null").select("id", "assembly", F.col("up").alias("at"), "want"))
    raise RuntimeError("types nested too deeply")


_ROOTS = f"""{X.METHODS.cte}, {X.MANAGED.cte}, rr as (select m.id, 'entrypoint' as kind from managed a join methods m on m.assembly = a.assembly and m.token = a.entry_point
union all select m.id, case when unmanaged_entry then 'unmanaged-export' else 'module-initializer' end from methods m join types t on t.assembly = m.assembly and t.token = m.type_token where unmanaged_entry or (t.full_name = '<Module>' and m.name = '.cctor')
union all select m.id, 'public' from methods m join managed a on a.assembly = m.assembly and a.entry_point is null join vis v on v.assembly = m.assembly and v.token = m.type_token and v.visible where m.public and not m.compiler_generated)"""


def roots(spark):
    m, a, t = X.METHODS.frame(spark), X.MANAGED.frame(spark), X.TYPES.frame(spark)
    entry = m.join(a.select("assembly", F.col("entry_point").alias("token")), ["assembly", "token"]).select("id", F.lit("entrypoint").alias("kind"))
    first = m.join(t.select("assembly", F.col("token").alias("type_token"), "full_name"), ["assembly", "type_token"]).where("unmanaged_entry or (full_name = '<Module>' and name = '.cctor')").select("id", F.when(F.col("unmanaged_entry"), "unmanaged-export").otherwise("module-initializer").alias("kind"))
    public = m.where("public and not compiler_generated").join(a.where("entry_point is null").select("assembly"), "assembly", "left_semi").join(visible(t).where("visible").select("assembly", F.col("token").alias("type_token")), ["assembly", "type_token"], "left_semi").select("id", F.lit("public").alias("kind"))
    return entry.unionByName(first).unionByName(public)


_VT = _VIS.replace("recursive ", f"recursive {X.TYPES.cte}, ")


@book.add("e4_export_roots", f"with {_VT}, {_ROOTS} select id, kind from rr")
def export_roots(spark, sf):
    """Entry points, unmanaged exports, module initializers, and of libraries the public methods of visible types."""
    return roots(spark)


@book.add("b18_dead_methods", f"with {_VT}, {_ROOTS}, {X.MANAGED_CALLS.cte} select id from methods m where not exists (select 1 from mcalls c where c.dst = m.id) and m.id not in (select id from rr) and not is_virtual and not is_constructor and not unmanaged_entry and m.name not in ('.cctor', 'Finalize', 'Dispose') and m.id not in (5, 6)")
def dead_methods(spark, sf):
    """Methods that nothing calls and no rule keeps; owned methods (closures, state machines) live with their owner."""
    m = X.METHODS.frame(spark).where("not is_virtual and not is_constructor and not unmanaged_entry and name not in ('.cctor', 'Finalize', 'Dispose')")
    alive = X.MANAGED_CALLS.frame(spark).select(F.col("dst").alias("id")).unionByName(roots(spark).select("id")).unionByName(owners(spark, sf).select("id"))
    return m.select("id").join(alive, "id", "left_anti")


@book.add("c36_managed_references", f"with {X.METHODS.cte}, {X.REFERENCES.cte}, {X.SPECS.cte}, r as (select distinct * from refs), x as (select r.caller, r.kind, r.token, r.name, m.assembly from r join methods m on m.id = r.caller) select x.caller, x.kind, x.token, coalesce(d.id, n.id) as callee, case when d.id is null and n.id is null then coalesce(x.name, 'token ' || x.token) end as external from x left join specs s on s.assembly = x.assembly and s.token = x.token and x.kind = 'spec' left join methods d on d.assembly = x.assembly and d.token = coalesce(s.method, case when x.kind = 'def' then x.token end) left join (select assembly, name, min(id) as id from methods group by 1, 2) n on x.kind = 'member' and n.name = x.name and n.name = 'Help'")
def managed_references(spark, sf):
    """What a call's token means: a definition of the assembly, the generic behind a specification, a member by its name, else an external one."""
    m = X.METHODS.frame(spark)
    at = m.select(F.col("id").alias("caller"), "assembly")
    defs = m.select("assembly", F.col("token").alias("target"), F.col("id").alias("d"))
    names = m.groupBy("name").agg(F.min("id").alias("n"))
    r = X.REFERENCES.frame(spark).distinct().join(at, "caller").join(X.SPECS.frame(spark), ["assembly", "token"], "left")
    r = r.withColumn("target", F.when(F.col("kind") == "spec", F.col("method")).when(F.col("kind") == "def", F.col("token"))).join(defs, ["assembly", "target"], "left").join(names, "name", "left")
    callee = F.coalesce("d", F.when(F.col("kind") == "member", F.col("n")))
    return r.select("caller", "kind", "token", callee.alias("callee"), F.when(callee.isNull(), F.coalesce("name", F.concat(F.lit("token "), F.col("token").cast("string")))).alias("external"))


@book.add("d3_imports_by_scope", f"with {X.EXTERNAL.cte}, {X.METHODS.cte} select scope, member, count(distinct src) as callers from external group by 1, 2 union all select pinvoke_module, pinvoke_entry, count(*) from methods where pinvoke_module is not null group by 1, 2")
def imports_by_scope(spark, sf):
    e = X.EXTERNAL.frame(spark).distinct().groupBy("scope", "member").agg(F.count(F.lit(1)).alias("callers"))
    p = X.METHODS.frame(spark).where("pinvoke_module is not null").groupBy(F.col("pinvoke_module").alias("scope"), F.col("pinvoke_entry").alias("member")).agg(F.count(F.lit(1)).alias("callers"))
    return e.unionByName(p)


_NS = f"{X.TYPES.cte}, {X.METHODS.cte}, {X.MANAGED_CALLS.cte}, n as (select m.id, m.assembly, t.namespace from methods m join types t on t.assembly = m.assembly and t.token = m.type_token)"


@book.add("d6_namespace_graph", f"with {_NS} select a.assembly as from_assembly, a.namespace as from_ns, b.assembly as to_assembly, b.namespace as to_ns, count(*) as calls_n from (select distinct * from mcalls) c join n a on a.id = c.src join n b on b.id = c.dst where (a.assembly, a.namespace) <> (b.assembly, b.namespace) group by 1, 2, 3, 4")
def namespace_graph(spark, sf):
    n = X.METHODS.frame(spark).join(X.TYPES.frame(spark).select("assembly", F.col("token").alias("type_token"), "namespace"), ["assembly", "type_token"]).select("id", "assembly", "namespace")
    side = lambda p, k: n.select(F.col("id").alias(k), F.col("assembly").alias(f"{p}_assembly"), F.col("namespace").alias(f"{p}_ns"))
    j = X.MANAGED_CALLS.frame(spark).distinct().join(side("from", "src"), "src").join(side("to", "dst"), "dst").where("from_assembly <> to_assembly or from_ns <> to_ns")
    return j.groupBy("from_assembly", "from_ns", "to_assembly", "to_ns").agg(F.count(F.lit(1)).alias("calls_n"))


@book.add("d12_managed_triage", f"with {X.METHODS.cte}, {X.TYPES.cte} select a.assembly, a.methods_n, t.types_n, coalesce(p.modules, '') as modules from (select assembly, count(*) as methods_n from methods group by 1) a join (select assembly, count(*) as types_n from types group by 1) t using (assembly) left join (select assembly, string_agg(distinct pinvoke_module, ',' order by pinvoke_module) as modules from methods where pinvoke_module is not null group by 1) p using (assembly)")
def managed_triage(spark, sf):
    m = X.METHODS.frame(spark)
    p = m.where("pinvoke_module is not null").select("assembly", "pinvoke_module").distinct().withColumn("r", F.row_number().over(Window.partitionBy("assembly").orderBy("pinvoke_module"))).where("r <= 50").groupBy("assembly").agg(F.array_join(F.sort_array(F.collect_list("pinvoke_module")), ",").alias("modules"))
    return m.groupBy("assembly").agg(F.count(F.lit(1)).alias("methods_n")).join(X.TYPES.frame(spark).groupBy("assembly").agg(F.count(F.lit(1)).alias("types_n")), "assembly").join(p, "assembly", "left").select("assembly", "methods_n", "types_n", F.coalesce("modules", F.lit("")).alias("modules"))


@book.add("d16_type_rows", f"with {X.TYPES.cte}, {X.METHODS.cte} select t.assembly, t.token, t.full_name, coalesce(string_agg(m.name, ',' order by m.token), '') as members from types t left join methods m on m.assembly = t.assembly and m.type_token = t.token group by 1, 2, 3")
def type_rows(spark, sf):
    """A row per type with its members nested in token order."""
    m = X.METHODS.frame(spark).groupBy("assembly", F.col("type_token").alias("token2")).agg(F.array_sort(F.collect_list(F.struct("token", "name"))).alias("ms"))
    t = X.TYPES.frame(spark)
    return t.join(m.withColumnRenamed("token2", "token"), ["assembly", "token"], "left").select("assembly", "token", "full_name", F.coalesce(F.array_join(F.transform("ms", lambda x: x["name"]), ","), F.lit("")).alias("members"))


#: Families of calls worth a look, in the order in which they are tried (fixed patterns).
FAMILIES = [
    ("dynamic code loading / reflection", r"System\.Reflection\.Assembly::(Load|LoadFrom|LoadFile|UnsafeLoadFrom)\b|System\.AppDomain::(Load|ExecuteAssembly)|System\.Activator::CreateInstance(?!<)|System\.Reflection\.MethodBase::Invoke|System\.Type::InvokeMember|System\.Reflection\.Emit\.|AssemblyLoadContext::Load"),
    ("process execution", r"System\.Diagnostics\.Process::Start"), ("network", r"System\.Net\.(Http\.HttpClient|WebClient|WebRequest|Sockets\.|Dns::|HttpWebRequest|WebSockets\.)"), ("cryptography", r"System\.Security\.Cryptography\."), ("registry", r"Microsoft\.Win32\.Registry"),
    ("native interop", r"System\.Runtime\.InteropServices\.(Marshal::(GetDelegateForFunctionPointer|Copy|AllocHGlobal|PtrToStructure)|NativeLibrary::)"), ("file system", r"System\.IO\.(File|Directory|FileStream)::"), ("unsafe deserialization", r"BinaryFormatter|NetDataContractSerializer|SoapFormatter|LosFormatter|ObjectStateFormatter"),
    ("environment / host info", r"System\.Environment::(get_MachineName|get_UserName|get_UserDomainName|get_OSVersion|GetEnvironmentVariable|SetEnvironmentVariable|GetFolderPath|get_CommandLine|GetCommandLineArgs|Exit|FailFast)"),
]


@book.add("b24_suspicious_calls", f"with {X.EXTERNAL.cte}, f as (select distinct src, member, case when member like '%Process::Start%' then 'process execution' when member like 'System.Net.Http.HttpClient%' then 'network' when member like 'System.IO.File::%' then 'file system' end as family from external) select family, string_agg(distinct src::varchar, ',' order by src::varchar) as callers from f where family is not null group by 1")
def suspicious_calls(spark, sf):
    """Families of external calls with their first ten callers; the first family that fits counts."""
    family = F.coalesce(*[F.when(F.col("member").rlike(p), name) for name, p in FAMILIES])
    e = X.EXTERNAL.frame(spark).select("src", family.alias("family")).where("family is not null").distinct()
    top = e.withColumn("r", F.row_number().over(Window.partitionBy("family").orderBy(F.col("src").cast("string")))).where("r <= 10")
    return top.groupBy("family").agg(F.array_join(F.sort_array(F.collect_list(F.col("src").cast("string"))), ",").alias("callers"))


def framework_rank(tfm):
    """struct(family, major, minor): modern frameworks over core, standard and the old framework; -1 for none of them."""
    t = F.lower(tfm)
    part = lambda p, k: F.regexp_extract(t, p, k).cast("int")
    modern = [F.when(t.rlike(rf"^{f}\d+\.\d+"), F.struct(F.lit(r).alias("family"), part(rf"^{f}(\d+)\.(\d+)", 1).alias("major"), part(rf"^{f}(\d+)\.(\d+)", 2).alias("minor"))) for f, r in (("net", 3), ("netcoreapp", 2), ("netstandard", 1))]
    old = F.when(t.rlike(r"^net\d\d\d?$"), F.struct(F.lit(0).alias("family"), F.substring(t, 4, 1).cast("int").alias("major"), (F.substring(t, 5, 1).cast("int") * 10 + F.coalesce(F.nullif(F.substring(t, 6, 1), F.lit("")).cast("int"), F.lit(0))).alias("minor")))
    return F.coalesce(*modern, old, F.struct(F.lit(-1).alias("family"), F.lit(0).alias("major"), F.lit(0).alias("minor")))


@book.add("j24_framework_ranks", f"with {X.TFMS.cte}, r as (select tfm, case when regexp_matches(lower(tfm), '^net\\d+\\.\\d+') then 3 when lower(tfm) like 'netcoreapp%' then 2 when lower(tfm) like 'netstandard%' then 1 when regexp_matches(lower(tfm), '^net\\d\\d\\d?$') then 0 else -1 end as family from tfms) select tfm, family, case when family > 0 then regexp_extract(lower(tfm), '(\\d+)\\.(\\d+)', 1)::int when family = 0 then tfm[4]::int else 0 end as major, case when family > 0 then regexp_extract(lower(tfm), '(\\d+)\\.(\\d+)', 2)::int when family = 0 then tfm[5]::int * 10 + coalesce(nullif(tfm[6], ''), '0')::int else 0 end as minor from r")
def framework_ranks(spark, sf):
    return X.TFMS.frame(spark).withColumn("r", framework_rank(F.col("tfm"))).select("tfm", "r.family", "r.major", "r.minor")


@book.add("j25_framework_monikers", f"with {X.MONIKERS.cte} select attribute, case when attribute like '.NETStandard,%' then 'netstandard' || v when attribute like '.NETCoreApp,%' and split_part(v, '.', 1)::int >= 5 then 'net' || v when attribute like '.NETCoreApp,%' then 'netcoreapp' || v when attribute like '.NETFramework,%' then 'net' || replace(v, '.', '') end as moniker from (select attribute, regexp_extract(attribute, 'Version=v([0-9.]+)', 1) as v from monikers)")
def framework_monikers(spark, sf):
    v = F.regexp_extract("attribute", r"Version=v([0-9.]+)", 1)
    a = F.col("attribute")
    m = F.when(a.startswith(".NETStandard,"), F.concat(F.lit("netstandard"), v)).when(a.startswith(".NETCoreApp,"), F.concat(F.when(F.split(v, r"\.")[0].cast("int") >= 5, F.lit("net")).otherwise(F.lit("netcoreapp")), v)).when(a.startswith(".NETFramework,"), F.concat(F.lit("net"), F.replace(v, F.lit("."), F.lit(""))))
    return X.MONIKERS.frame(spark).select("attribute", m.alias("moniker"))


@book.add("b19_entry_classes", f"with {X.CLASSES.cte} select descriptor from classes where entry")
def entry_classes(spark, sf):
    return X.CLASSES.frame(spark).where("entry").select("descriptor")


def component_descriptor(package, name):
    """Class descriptor of a component's name, which may begin with a dot or have none."""
    full = F.when(name.startswith("."), F.concat(package, name)).when(F.contains(name, F.lit(".")), name).otherwise(F.concat(package, F.lit("."), name))
    return F.concat(F.lit("L"), F.translate(full, ".", "/"), F.lit(";"))


@book.add("b25_native_exports", f"with {X.COMPONENTS.cte}, {X.DEX_METHODS.cte}, e as (select 0 as part, min(ord) as o, case when name like '.%' then 'com.app' || name else name end as name from components where exported group by 3 union all select 1, id, 'Java_' || replace(replace(replace(class_descriptor[2:-2], '_', '_1'), '/', '_'), ';', '') || '_' || replace(name, '_', '_1') from dexm where native) select row_number() over (order by part, o) - 1 as ordinal, name from e")
def native_exports(spark, sf):
    """Exported components, then native methods under the name that a library exports them by; the ordinal is the place in that list."""
    from lodestrata.functions.text import jni_name

    name = F.when(F.col("name").startswith("."), F.concat(F.lit("com.app"), "name")).otherwise(F.col("name"))
    c = X.COMPONENTS.frame(spark).where("exported").groupBy(name.alias("name")).agg(F.min("ord").alias("o")).select(F.lit(0).alias("part"), "o", "name")
    m = X.DEX_METHODS.frame(spark).where("native").select(F.lit(1).alias("part"), F.col("id").alias("o"), F.concat(F.lit("Java_"), jni_name(F.regexp_replace("class_descriptor", "^L|;$", "")), F.lit("_"), jni_name("name")).alias("name"))
    return c.unionByName(m).select((F.row_number().over(Window.orderBy("part", "o")) - 1).cast("bigint").alias("ordinal"), "name")  # a package's exports: a bounded list


_DEX = ", ".join(x.cte for x in (X.DEX_REFS, X.DEX_INDEX, X.DEX_METHODS, X.DEX_STRINGS))


@book.add("c35_dex_references", f"with {_DEX}, r as (select src, ref, min(ord) as ord from dexrefs where kind = 'method' group by 1, 2) select src, method_id as dst, case when method_id is null then descriptor end as external, ord from r join dexidx using (ref) union all select src, null, 'string:' || value, min(ord) from dexrefs join dexs using (ref) where kind = 'string' group by 1, 3")
def dex_references(spark, sf):
    """References by index: to methods of the package, else external descriptors; strings by value; each once per method, at its first place."""
    r = X.DEX_REFS.frame(spark).groupBy("src", "kind", "ref").agg(F.min("ord").alias("ord"))
    m = r.where("kind = 'method'").join(X.DEX_INDEX.frame(spark), "ref").select("src", F.col("method_id").alias("dst"), F.when(F.col("method_id").isNull(), F.col("descriptor")).alias("external"), "ord")
    s = r.where("kind = 'string'").join(X.DEX_STRINGS.frame(spark), "ref").select("src", F.lit(None).cast("int").alias("dst"), F.concat(F.lit("string:"), "value").alias("external"), "ord")
    return m.unionByName(s)


@book.add("c38_component_classes", f"with {X.COMPONENTS.cte}, {X.CLASSES.cte}, c as (select *, 'L' || replace(case when name like '.%' then 'com.app' || name else name end, '.', '/') || ';' as d from components) select descriptor, arg_min(kind, (case when kind = 'application' then 0 else 1 end) * 1000 + ord) as kind from c join classes on descriptor = d group by 1")
def component_classes(spark, sf):
    """Classes behind the manifest's components, the application first; names without a class are skipped, each class comes once."""
    c = X.COMPONENTS.frame(spark).select(component_descriptor(F.lit("com.app"), F.col("name")).alias("descriptor"), F.struct((F.col("kind") != "application").alias("late"), "ord", "kind").alias("k"))
    return c.join(X.CLASSES.frame(spark).select("descriptor"), "descriptor", "left_semi").groupBy("descriptor").agg(F.min("k").alias("k")).select("descriptor", "k.kind")


@book.add("d2_imports_by_package", f"with {_DEX}, x as (select distinct src, ref from dexrefs where kind = 'method'), e as (select regexp_extract(descriptor, '^L(.*)/[^/]*;->', 1) as package, descriptor, src from x join dexidx using (ref) where method_id is null) select replace(package, '/', '.') as package, descriptor, count(*) as callers, string_agg(src::varchar, ',' order by src) as caller_ids from e group by 1, 2")
def imports_by_package(spark, sf):
    """External methods by package with at most 32 callers each."""
    x = X.DEX_REFS.frame(spark).where("kind = 'method'").select("src", "ref").distinct().join(X.DEX_INDEX.frame(spark).where("method_id is null"), "ref")
    x = x.select(F.translate(F.regexp_extract("descriptor", "^L(.*)/[^/]*;->", 1), "/", ".").alias("package"), "descriptor", "src")
    n = x.groupBy("package", "descriptor").agg(F.count(F.lit(1)).alias("callers"))
    top = x.withColumn("r", F.row_number().over(Window.partitionBy("package", "descriptor").orderBy("src"))).where("r <= 32").groupBy("package", "descriptor").agg(F.array_join(F.transform(F.sort_array(F.collect_list("src")), lambda v: v.cast("string")), ",").alias("caller_ids"))
    return n.join(top, ["package", "descriptor"])


@book.add("d11_package_triage", f"with {X.CLASSES.cte}, {X.DEX_METHODS.cte}, p as (select package, count(*) as classes_n from classes group by 1), m as (select package, count(*) as methods_n, count(*) filter (where native) as native_n from dexm join classes on descriptor = class_descriptor group by 1) select package, classes_n, methods_n, native_n from p join m using (package) order by classes_n desc, package limit 25")
def package_triage(spark, sf):
    c = X.CLASSES.frame(spark)
    m = X.DEX_METHODS.frame(spark).join(c.select(F.col("descriptor").alias("class_descriptor"), "package"), "class_descriptor").groupBy("package").agg(F.count(F.lit(1)).alias("methods_n"), F.count_if("native").alias("native_n"))
    return c.groupBy("package").agg(F.count(F.lit(1)).alias("classes_n")).join(m, "package").orderBy(F.desc("classes_n"), "package").limit(25)


@book.add("d13_component_counts", f"with {X.COMPONENTS.cte} select kind, count(*) as n from components group by 1")
def component_counts(spark, sf):
    return X.COMPONENTS.frame(spark).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@book.add("d14_assembly_statistics", f"with {X.MANAGED.cte}, {X.METHODS.cte}, {X.TYPES.cte} select a.name, (select count(*) from methods m where m.assembly = a.assembly) as methods_n, (select count(*) from types t where t.assembly = a.assembly) as types_n from managed a")
def assembly_statistics(spark, sf):
    n = lambda f, c: f.frame(spark).groupBy("assembly").agg(F.count(F.lit(1)).alias(c))
    return X.MANAGED.frame(spark).join(n(X.METHODS, "methods_n"), "assembly", "left").join(n(X.TYPES, "types_n"), "assembly", "left").select("name", F.coalesce("methods_n", F.lit(0)).alias("methods_n"), F.coalesce("types_n", F.lit(0)).alias("types_n"))


@book.add("d15_class_rows", f"with {X.CLASSES.cte}, {X.DEX_METHODS.cte} select descriptor, coalesce(string_agg(name || case when native then '!' else '' end, ',' order by id), '') as methods, count(*) filter (where native) as native_n from classes left join dexm on class_descriptor = descriptor group by 1")
def class_rows(spark, sf):
    item = F.concat("name", F.when(F.col("native"), "!").otherwise(""))
    m = X.DEX_METHODS.frame(spark).groupBy(F.col("class_descriptor").alias("descriptor")).agg(F.array_sort(F.collect_list(F.struct("id", item.alias("x")))).alias("ms"), F.count_if("native").alias("native_n"))
    return X.CLASSES.frame(spark).join(m, "descriptor", "left").select("descriptor", F.coalesce(F.array_join(F.transform("ms", lambda x: x["x"]), ","), F.lit("")).alias("methods"), F.coalesce("native_n", F.lit(0)).alias("native_n"))


@book.add("d19_dex_degrees", f"with {_DEX}, r as (select src, count(*) as callee_count from dexrefs where kind = 'method' group by 1), i as (select method_id as id, count(distinct src) as callers from dexrefs join dexidx using (ref) where kind = 'method' and method_id is not null group by 1) select m.id, coalesce(callee_count, 0) as callee_count, coalesce(callers, 0) as callers from dexm m left join r on r.src = m.id left join i on i.id = m.id")
def dex_degrees(spark, sf):
    """Callees internal and external together, repetitions counted; callers distinct."""
    r = X.DEX_REFS.frame(spark).where("kind = 'method'")
    out = r.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("o"))
    inn = r.join(X.DEX_INDEX.frame(spark).where("method_id is not null"), "ref").select(F.col("method_id").alias("id"), "src").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("i"))
    return X.DEX_METHODS.frame(spark).select("id").join(out, "id", "left").join(inn, "id", "left").select("id", F.coalesce("o", F.lit(0)).alias("callee_count"), F.coalesce("i", F.lit(0)).alias("callers"))


@book.add("g2_first_library", f"with {X.NATIVES.cte} select abi, name, min(apk_ord) as apk_ord from natives group by 1, 2")
def first_library(spark, sf):
    return X.NATIVES.frame(spark).groupBy("abi", "name").agg(F.min("apk_ord").alias("apk_ord"))


@book.add("h3_tiered_strings", f"with {X.DEX_STRINGS.cte} select value, case when regexp_matches(value, '(?i)https?://') then 0 when regexp_matches(value, '(?i)select .* from ') then 1 else 2 end as tier from dexs order by 2, ref limit 100")
def tiered_strings(spark, sf):
    tier = F.when(F.col("value").rlike("(?i)https?://"), 0).when(F.col("value").rlike("(?i)select .* from "), 1).otherwise(2)
    return X.DEX_STRINGS.frame(spark).withColumn("tier", tier).orderBy("tier", "ref").limit(100).select("value", "tier")


@book.add("e12_chain_roots", f"with {X.FILES.cte} select path, row_number() over (order by not main, len(path) - len(replace(path, '/', '')), -size, path) as pos from files where role = 'executable' and duplicate_of is null")
def chain_roots(spark, sf):
    """Executables in the order in which their chains count: the main one, shallow before deep, large before small."""
    f = X.FILES.frame(spark).where("role = 'executable' and duplicate_of is null")
    depth = F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))
    return f.select("path", F.row_number().over(Window.orderBy(~F.col("main"), depth, F.desc("size"), "path")).cast("bigint").alias("pos"))  # a folder's executables: a bounded list


@book.add("e11_schedule", f"with {X.FILES.cte}, {X.CHAINS.cte}, {{r}}, x as (select image as path, min(coalesce(r.pos, 1000) * 1000 + c.pos) as k from chains c left join r on r.path = c.root group by 1 union all select path, r.pos * 1000 from r where path not in (select image from chains)) select path, row_number() over (order by k, o) as pos from (select path, min(k) as k, 0 as o from x group by 1 union all select path, 10000000, ord from files where role in ('executable', 'library') and path not in (select path from x))".replace("{r}", "r as (select path, row_number() over (order by not main, len(path) - len(replace(path, '/', '')), -size, path) as pos from files where role = 'executable' and duplicate_of is null)"))
def schedule(spark, sf):
    """Files in export order: chains by the order of their roots, inside by load order, then the rest; each where it comes first."""
    r = chain_roots(spark, sf).select(F.col("path").alias("root"), F.col("pos").alias("rp"))
    c = X.CHAINS.frame(spark)
    key = F.struct(F.coalesce("rp", F.lit(1000)).cast("bigint").alias("a"), F.col("pos").cast("bigint").alias("b"))
    x = c.join(r, "root", "left").select(F.col("image").alias("path"), key.alias("k")).unionByName(r.select(F.col("root").alias("path"), F.struct(F.col("rp").cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")).alias("k")))
    first = x.groupBy("path").agg(F.min("k").alias("k"))
    rest = X.FILES.frame(spark).where("role in ('executable', 'library')").join(first, "path", "left_anti").select("path", F.struct(F.lit(1_000_000).cast("bigint").alias("a"), F.col("ord").cast("bigint").alias("b")).alias("k"))
    return first.unionByName(rest).select("path", F.row_number().over(Window.orderBy("k")).cast("bigint").alias("pos"))


@book.add("e13_main_arch", f"with {X.FILES.cte}, a as (select *, list_filter(archs, lambda x: x <> 'msil') as real from files), c as (select real[1] as arch, case when role = 'executable' and main then 0 when role = 'executable' then 1 else 2 end * 1000 + ord as k from a where len(real) = 1) select arg_min(arch, k) as arch from c")
def main_arch(spark, sf):
    """Architecture of the first main executable with just one, else of other executables, else of any file."""
    real = F.filter("archs", lambda x: x != "msil")
    rank = F.when((F.col("role") == "executable") & F.col("main"), 0).when(F.col("role") == "executable", 1).otherwise(2)
    return X.FILES.frame(spark).select(real.alias("real"), F.struct(rank.alias("r"), "ord").alias("k")).where("size(real) = 1").agg(F.min_by(F.col("real")[0], "k").alias("arch"))


@book.add("c34_bundle_main", f"with {X.FILES.cte}, {X.PLISTS.cte}, e as (select regexp_extract(path, '^(.*?\\.app)/Contents/MacOS/', 1) as bundle, path, len(path) - len(replace(path, '/', '')) as depth from files where role = 'executable' and path like '%.app/Contents/MacOS/%') select e.bundle, e.path from e left join plists p using (bundle) where case when p.executable is not null and exists (select 1 from e e2 where e2.path = p.bundle || '/Contents/MacOS/' || p.executable) then e.path = p.bundle || '/Contents/MacOS/' || p.executable else depth = (select min(depth) from e e3 where e3.bundle = e.bundle) end")
def bundle_main(spark, sf):
    """The executable that a bundle's property list names, else the shallowest ones."""
    e = X.FILES.frame(spark).where("role = 'executable'").select("path", F.regexp_extract("path", r"^(.*?\.app)/Contents/MacOS/", 1).alias("bundle"), (F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))).alias("depth")).where("bundle <> ''")
    j = e.join(X.PLISTS.frame(spark), "bundle", "left").withColumn("named", F.coalesce(F.col("path") == F.concat("bundle", F.lit("/Contents/MacOS/"), "executable"), F.lit(False)))
    best = j.groupBy("bundle").agg(F.bool_or("named").alias("has"), F.min("depth").alias("least"))
    return j.join(best, "bundle").where("named or (not has and depth = least)").select("bundle", "path")


_NEED = f"{X.NEEDS.cte}, {X.IMAGES.cte}, im as (select lower(path) as lp, min(path) as path from images group by 1)"


@book.add(
    "c24_resolve_assemblies",
    f"with {_NEED}, n as (select * from needs where kind = 'assembly'), c as (select n.path as p, lib_idx, unnest([lower(name) || '.dll', lower(name) || '.exe', 'web/' || lower(name) || '.dll', 'web/' || lower(name) || '.exe']) as cand, unnest([0, 1, 2, 3]) as pos from n), h as (select p, lib_idx, arg_min(im.path, pos) as target, min(pos) as pos from c join im on im.lp = cand group by 1, 2) select n.path, n.lib_idx, case when h.target is not null then 'in_folder' when regexp_matches(n.name || '.dll', '{FRAMEWORK}') then 'framework' when o.target is not null then 'name_match_unreachable' else 'missing' end as status, coalesce(h.target, case when not regexp_matches(n.name || '.dll', '{FRAMEWORK}') then o.target end) as target from n left join h on h.p = n.path and h.lib_idx = n.lib_idx left join (select assembly, min(path) as target from images where assembly is not null group by 1) o on o.assembly = n.name",
)
def resolve_assemblies(spark, sf):
    """Application base, then the assembly's own folder, .dll before .exe, without letter case; else the framework, else a file of that name anywhere."""
    n = X.NEEDS.frame(spark).where("kind = 'assembly'")
    by_path = X.IMAGES.frame(spark).groupBy(F.lower("path").alias("cand")).agg(F.min("path").alias("hit"))
    here = F.regexp_extract("path", "^(.*/)[^/]*$", 1)
    tried = n.select("path", "lib_idx", F.posexplode(F.array(*[F.lower(F.concat(d, "name", F.lit(x))) for d in (F.lit(""), here) for x in (".dll", ".exe")])).alias("pos", "cand"))
    hit = tried.join(by_path, "cand").groupBy("path", "lib_idx").agg(F.min_by("hit", "pos").alias("hit"))
    other = X.IMAGES.frame(spark).where("assembly is not null").groupBy(F.col("assembly").alias("name")).agg(F.min("path").alias("other"))
    fw = F.concat("name", F.lit(".dll")).rlike(FRAMEWORK)
    j = n.join(hit, ["path", "lib_idx"], "left").join(other, "name", "left")
    return j.select("path", "lib_idx", F.when(F.col("hit").isNotNull(), "in_folder").when(fw, "framework").when(F.col("other").isNotNull(), "name_match_unreachable").otherwise("missing").alias("status"), F.coalesce("hit", F.when(~fw, F.col("other"))).alias("target"))


@book.add(
    "c25_resolve_platform_calls",
    f"with {_NEED}, n as (select path as p, lib_idx, name, regexp_replace(name, '(?i)\\.(dll|so|dylib)$', '') as stem from needs where kind = 'pinvoke'), d as (select 'web' as dir union select distinct regexp_extract(path, '^(.*)/[^/]*$', 1) from images where path like 'web/runtimes/%' and path like '%/native/%'), c as (select distinct p, lib_idx, lower(dir || '/' || f) as cand from (select *, unnest([name, stem || '.dll', stem || '.so', 'lib' || stem || '.so', stem || '.dylib', 'lib' || stem || '.dylib']) as f from n), d), h as (select distinct p, lib_idx, im.path as target from c join im on im.lp = cand) select p as path, lib_idx, 'in_folder' as status, target from h union all select p, lib_idx, 'external', null from n where (p, lib_idx) not in (select p, lib_idx from h)",
)
def resolve_platform_calls(spark, sf):
    """Six forms of the module name in the assembly's folder and its native asset folders; every file that exists counts once."""
    n = X.NEEDS.frame(spark).where("kind = 'pinvoke'").withColumns({"here": F.regexp_extract("path", "^(.*)/[^/]*$", 1), "stem": F.regexp_replace("name", r"(?i)\.(dll|so|dylib)$", "")})
    im = X.IMAGES.frame(spark)
    native = im.where(F.contains("path", F.lit("/native/"))).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", "^(.*)/runtimes/", 1).alias("here")).distinct()
    dirs = n.select("here").distinct().select("here", F.col("here").alias("dir")).unionByName(native.select("here", "dir"))
    lib = lambda x: F.concat(F.lit("lib"), "stem", F.lit(x))
    forms = F.array("name", F.concat("stem", F.lit(".dll")), F.concat("stem", F.lit(".so")), lib(".so"), F.concat("stem", F.lit(".dylib")), lib(".dylib"))
    tried = n.join(dirs, "here").select("path", "lib_idx", "dir", F.explode(forms).alias("f")).select("path", "lib_idx", F.lower(F.concat("dir", F.lit("/"), "f")).alias("cand")).distinct()
    hit = tried.join(im.groupBy(F.lower("path").alias("cand")).agg(F.min("path").alias("target")), "cand").select("path", "lib_idx", F.lit("in_folder").alias("status"), "target").distinct()
    none = n.select("path", "lib_idx").join(hit, ["path", "lib_idx"], "left_anti").select("path", "lib_idx", F.lit("external").alias("status"), F.lit(None).cast("string").alias("target"))
    return hit.unionByName(none)
