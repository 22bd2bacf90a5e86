"""Binding of imports across files, over small tables of linked files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import binding as B
from lodestrata.plans import fixtures as X
from lodestrata.plans.helpers import Book

book = Book()
QUERIES, ORACLE = book.queries, book.oracle
ELF, PE, MACHO = "path like 'bin/%' or path like 'lib/%'", "path = 'App.exe'", "path in ('Main', 'Frame')"
_BASE = ", ".join(f.cte for f in (X.IMPORTS, X.EXPORTS, X.EDGES, X.SCOPE))
_FIRST = "plain as (select path as p, name as n, arg_min(exp_ord, (not coalesce(default_version, false))::int * 1000 + exp_ord) as d from exps where name is not null group by 1, 2)"
_EDGE = "edge as (select distinct on (path, lib_idx) path as ep, lib_idx as el, target as et, status as es from edges order by path, lib_idx, target nulls first)"
_OPEN = "(es in ('in_folder', 'name_match_unreachable') and et is not null)"


def tables(spark):
    return (f.frame(spark) for f in (X.IMPORTS, X.EDGES, X.EXPORTS, X.SCOPE))


def flat(df):
    return df.withColumn("candidates", F.array_join("candidates", ","))


@book.add(
    "c12_bind_elf",
    f"""with {_BASE}, {_FIRST}, {_EDGE}, i as (select distinct on (path, imp_ord) * from syms where {ELF}),
v as (select path, imp_ord, case when et is null and es is null then 'external' when not coalesce({_OPEN}, false) then es when coalesce((select min(exp_ord) from exps e where e.path = et and e.name = i.name and e.version = i.version), (select min(exp_ord) from exps e where e.path = et and e.name = i.name and e.version is null)) is null then 'unresolved_symbol' else 'bound' end as status,
case when {_OPEN} then et end as target, case when {_OPEN} then coalesce((select min(exp_ord) from exps e where e.path = et and e.name = i.name and e.version = i.version), (select min(exp_ord) from exps e where e.path = et and e.name = i.name and e.version is null)) end as exp_ord from i left join edge on ep = path and el = lib_idx where lib_idx is not null),
d as (select i.path, i.imp_ord, s.pos, s.image, e.exp_ord from i join scope s on s.path = i.path and s.image <> i.path join (select p, n, d as exp_ord from plain) e on e.p = s.image and e.n = i.name where i.lib_idx is null),
f as (select path, imp_ord, arg_min(image, pos) as target, arg_min(exp_ord, pos) as exp_ord, min(pos) as pos from d group by 1, 2)
select path, imp_ord, status, case when status = 'bound' then 'versioned' end as resolution, target, exp_ord, null::varchar as candidates from v
union all select i.path, i.imp_ord, case when f.target is null then 'no_definer_in_folder' else 'bound' end, 'global_scope', f.target, f.exp_ord, case when f.target is not null then coalesce((select string_agg(image, ',' order by d.pos) from d where d.path = i.path and d.imp_ord = i.imp_ord and d.pos <> f.pos), '') end from i left join f on f.path = i.path and f.imp_ord = i.imp_ord where i.lib_idx is null""",
)
def elf(spark, sf):
    i, g, e, s = tables(spark)
    return flat(B.bind_elf(i.where(ELF), g, e, s))


@book.add("c13_scope_candidates", f"with {_BASE}, {_FIRST}, i as (select distinct path, imp_ord, name from syms where lib_idx is null and special is null and name is not null) select i.path, i.imp_ord, count(*) as definers, arg_min(s.image, s.pos) as first_definer from i join scope s on s.path = i.path and s.image <> i.path join plain on p = s.image and n = i.name group by 1, 2")
def scope_candidates(spark, sf):
    """All definers in load order of each name that is looked up in it."""
    i, _, e, s = tables(spark)
    got = B.scope_lookup(i.where("lib_idx is null and special is null").dropDuplicates(B.KEY), e, s, "global_scope").where("status = 'bound'")
    return got.select("path", "imp_ord", (F.size("candidates") + 1).cast("bigint").alias("definers"), F.col("target").alias("first_definer"))


@book.add(
    "c14_bind_macho",
    f"""with recursive {_BASE}, {X.REEXPORTS.cte}, {X.MAINS.cte}, {_FIRST}, {_EDGE}, i as (select distinct on (path, imp_ord) * from syms where {MACHO}),
st as (select i.path, imp_ord, name, case special when 'self' then i.path when 'main_executable' then coalesce(main, i.path) else et end as target, case special when 'self' then 'self' when 'main_executable' then special else 'two_level' end as resolution, case when special in ('self', 'main_executable') then 'open' when es is null then 'external' when {_OPEN} then 'open' else es end as status from i left join edge on ep = i.path and el = lib_idx left join mains m on m.path = i.path where special in ('self', 'main_executable') or (special is null and lib_idx is not null)),
x as (select plain.p, plain.n, e.exp_ord, e.reexport_lib, e.reexport_name from plain join exps e on e.path = plain.p and e.name = plain.n and e.exp_ord = plain.d),
walk(path, imp_ord, name, target, resolution, trail, depth, exp_ord, rl, found) as (
select st.path, imp_ord, st.name, target, resolution, '', 0, x.exp_ord, x.reexport_lib, x.p is not null from st left join x on x.p = st.target and x.n = st.name where status = 'open'
union all select w.path, w.imp_ord, nx.name, nx.target, 'reexport', w.trail || nx.step, w.depth + 1, x.exp_ord, x.reexport_lib, x.p is not null
from walk w join lateral (select coalesce(y.reexport_name, w.name) as name, g.et as target, 'a' as step from x y join edge g on g.ep = w.target and g.el = y.reexport_lib where y.p = w.target and y.n = w.name and w.found and w.rl is not null and g.es = 'in_folder'
union all select w.name, g.et, chr(97 + r.lib_idx) from reexports r join edge g on g.ep = r.path and g.el = r.lib_idx where r.path = w.target and not w.found and g.es = 'in_folder') nx on true left join x on x.p = nx.target and x.n = nx.name where w.depth < 6),
ends as (select w.*, case when rl is null then 'bound' else coalesce(g.es, 'external') end as how from walk w left join edge g on g.ep = w.target and g.el = w.rl where found and (rl is null or coalesce(g.es, '') <> 'in_folder')),
b as (select distinct on (path, imp_ord) * from ends order by path, imp_ord, trail),
sc as (select i.path, i.imp_ord, i.special, s.pos, s.image, e.exp_ord, e.weak from i join scope s on s.path = i.path join x on x.p = s.image and x.n = i.name and x.reexport_lib is null join exps e on e.path = x.p and e.exp_ord = x.exp_ord where i.special in ('flat_lookup', 'weak_lookup') and (i.special = 'weak_lookup' or s.image <> i.path)),
sb as (select distinct on (path, imp_ord) * from sc order by path, imp_ord, case when special = 'weak_lookup' then weak::int else 0 end, pos)
select st.path, st.imp_ord, case when st.status <> 'open' then st.status else coalesce(b.how, 'unresolved_symbol') end as status, case when st.status = 'open' then b.resolution end as resolution, case when st.status = 'open' then case when b.path is null then st.target when b.how = 'bound' then b.target end end as target, case when b.how = 'bound' then b.exp_ord end as exp_ord from st left join b on b.path = st.path and b.imp_ord = st.imp_ord
union all select i.path, i.imp_ord, case when sb.path is null then 'no_definer_in_folder' else 'bound' end, i.special, sb.image, sb.exp_ord from i left join sb on sb.path = i.path and sb.imp_ord = i.imp_ord where i.special in ('flat_lookup', 'weak_lookup')""",
)
def macho(spark, sf):
    i, g, e, s = tables(spark)
    return B.bind_macho(i.where(MACHO), g, e, s, X.REEXPORTS.frame(spark), X.MAINS.frame(spark))


@book.add(
    "c15_bind_pe",
    f"""with recursive {_BASE}, {_FIRST}, {_EDGE}, i as (select distinct on (path, imp_ord) * from syms where {PE}),
k as (select coalesce(a.p, b.p) as p, coalesce(a.want, b.want) as want, coalesce(b.o, a.o) as o from (select p, n as want, d as o from plain) a full join (select path as p, '#' || ordinal as want, min(exp_ord) as o from exps where ordinal is not null group by 1, 2) b on a.p = b.p and a.want = b.want),
kk as (select k.*, e.forwarder from k join exps e on e.path = k.p and e.exp_ord = k.o), m as (select path, lower(regexp_extract(image, '([^/]*)$', 1)) as dll, arg_min(image, pos) as nxt from scope group by 1, 2),
st as (select path, imp_ord, case when ordinal is not null then '#' || ordinal else name end as want, case when es is null then 'external' when {_OPEN} then 'open' else es end as status, case when {_OPEN} then et end as target, case when ordinal is null then 'name' else 'ordinal' end as resolution from i left join edge on ep = path and el = lib_idx),
w(path, imp_ord, target, want, resolution, hops, o, fwd, dll, nxt) as (
select st.path, imp_ord, target, st.want, resolution, 0, o, forwarder, case when forwarder is not null then lower(regexp_replace(regexp_extract(forwarder, '^(.*)\\.([^.]*)$', 1), '(?i)\\.dll$', '')) || '.dll' end, m.nxt from st left join kk on kk.p = target and kk.want = st.want left join m on m.path = st.path and m.dll = lower(regexp_extract(forwarder, '^(.*)\\.([^.]*)$', 1)) || '.dll' where status = 'open'
union all select w.path, w.imp_ord, w.nxt, regexp_extract(w.fwd, '^(.*)\\.([^.]*)$', 2), 'forwarder', w.hops + 1, kk.o, kk.forwarder, case when kk.forwarder is not null then lower(regexp_extract(kk.forwarder, '^(.*)\\.([^.]*)$', 1)) || '.dll' end, m.nxt from w left join kk on kk.p = w.nxt and kk.want = regexp_extract(w.fwd, '^(.*)\\.([^.]*)$', 2) left join m on m.path = w.path and m.dll = lower(regexp_extract(kk.forwarder, '^(.*)\\.([^.]*)$', 1)) || '.dll' where w.fwd is not null and w.nxt is not null and w.hops < 16 and w.dll not in ('kernel32.dll') and not regexp_matches(w.dll, '^(api|ext)-ms-win-')),
z as (select distinct on (path, imp_ord) * from w order by path, imp_ord, hops desc)
select path, imp_ord, case when o is null then 'unresolved_symbol' when fwd is null then 'bound' when hops >= 16 then 'unresolved_symbol' when regexp_matches(dll, '^(api|ext)-ms-win-') then 'apiset' when dll = 'kernel32.dll' then 'system' else 'external' end as status, case when fwd is not null then 'forwarder' else resolution end as resolution, case when o is null or fwd is null or hops >= 16 then target end as target, case when fwd is null then o end as exp_ord, hops from z
union all select path, imp_ord, status, null, target, null, 0 from st where status <> 'open'""",
)
def pe(spark, sf):
    i, g, e, s = tables(spark)
    return B.bind_pe(i.where(PE), g, e, s)


@book.add("c16_pe_modules", f"with {_BASE}, m as (select distinct path, lower(regexp_replace(forwarder, '\\.[^.]*$', '')) || '.dll' as dll from exps where forwarder is not null) select m.path, m.dll, (select arg_min(image, pos) from scope s where s.path = m.path and lower(regexp_extract(image, '([^/]*)$', 1)) = m.dll) as module from m")
def pe_modules(spark, sf):
    """The file that a forwarder's module names: by base name in load order, without letter case."""
    _, _, e, s = tables(spark)
    m = e.where("forwarder is not null").select("path", F.concat(F.lower(F.regexp_replace("forwarder", r"\.[^.]*$", "")), F.lit(".dll")).alias("dll")).distinct()
    at = s.groupBy("path", F.lower(F.regexp_extract("image", "([^/]*)$", 1)).alias("dll")).agg(F.min_by("image", "pos").alias("module"))
    return m.join(at, ["path", "dll"], "left")


@book.add(
    "c17_bind_members",
    f"""with recursive {_BASE}, {X.FORWARDERS.cte}, {X.ASSEMBLIES.cte}, {_EDGE}, i as (select distinct on (path, imp_ord) * from syms where path = 'Web.dll' and kind in ('code', 'data')),
fw as (select f.path as fp, f.owner as fo, f.assembly as fa, (select min(a.path) from assemblies a where a.assembly = f.assembly) as nxt from forwarders f),
known as (select path as kp from exps where path is not null union select path from assemblies),
st as (select path, imp_ord, name, signature, owner, kind, case when es is null then 'external' when {_OPEN} then 'open' else es end as status, case when {_OPEN} then et end as target from i left join edge on ep = path and el = lib_idx),
w(path, imp_ord, name, signature, owner, kind, target, res, hops) as (select path, imp_ord, name, signature, owner, kind, target, null::varchar, 0 from st where status = 'open'
union all select w.path, w.imp_ord, w.name, w.signature, w.owner, w.kind, fw.nxt, 'type_forwarder', w.hops + 1 from w join fw on fp = w.target and fo = w.owner where w.kind <> 'data' and fw.nxt is not null and w.hops < 15 and not exists (select 1 from exps e where e.path = w.target and e.name = w.name and e.signature = w.signature)),
z as (select distinct on (path, imp_ord) *, (select min(exp_ord) from exps e where e.path = w.target and e.name = w.name and e.signature = w.signature) as o, exists (select 1 from known where kp = w.target) as k, exists (select 1 from fw where fp = w.target and fo = w.owner) as f from w order by path, imp_ord, hops desc)
select path, imp_ord, case when not k then 'unresolved_symbol' when kind = 'data' or o is not null then 'bound' when f then 'external' else 'unresolved_symbol' end as status, case when k and kind = 'data' then 'field' when k and o is not null then coalesce(res, 'member_ref') when f then 'type_forwarder' else res end as resolution, case when k and kind <> 'data' and o is null and f then null else target end as target, case when kind <> 'data' then o end as exp_ord from z
union all select path, imp_ord, status, null, target, null from st where status <> 'open'""",
)
def members(spark, sf):
    i, g, e, _ = tables(spark)
    return B.bind_members(i.where("path = 'Web.dll' and kind in ('code', 'data')"), g, e, X.FORWARDERS.frame(spark), X.ASSEMBLIES.frame(spark))


@book.add(
    "c18_bind_pinvoke",
    f"""with {_BASE}, {X.FORMATS.cte}, {_FIRST}, i as (select distinct on (path, imp_ord) * from syms where kind = 'pinvoke'), m as (select i.path, imp_ord, name, charset, g.target, g.status as how from i left join (select distinct * from edges) g on g.path = i.path and g.lib_idx = i.lib_idx),
o as (select m.*, f.format from m left join formats f on f.path = m.target where how = 'in_folder'), t as (select *, unnest(case when format = 'macho' then ['_' || name] when format <> 'pe' or charset = 'exact' then [name] when charset in ('unicode', 'auto') then [name || 'W', name] else [name, name || 'A'] end) as want, unnest([0, 1]) as pos from o),
r as (select p, n as want, d from plain union all select path, '#' || ordinal, min(exp_ord) from exps where ordinal is not null group by 1, 2)
select path, imp_ord, target, case when min(d) is null then 'unresolved_symbol' else 'bound' end as status, arg_min(d, pos) filter (where d is not null) as exp_ord from t left join r on r.p = t.target and r.want = t.want where t.want is not null group by 1, 2, 3 union all select path, imp_ord, null, coalesce(how, 'external'), null from m where how is distinct from 'in_folder'""",
)
def pinvoke(spark, sf):
    i, g, e, _ = tables(spark)
    return B.bind_pinvoke(i.where("kind = 'pinvoke'"), g, e, X.FORMATS.frame(spark))


@book.add("c19_export_choice", f"with {_BASE}, {_FIRST} select p as path, n as name, d as exp_ord from plain where p is not null")
def export_choice(spark, sf):
    _, _, e, _ = tables(spark)
    return B.named(e).where("path is not null").select("path", "name", "e.exp_ord")


@book.add("c20_edge_status", f"with {_BASE}, {_EDGE} select path, imp_ord, case when es is null then 'external' when {_OPEN} then 'open' else es end as status, case when {_OPEN} then et end as target from (select distinct on (path, imp_ord) * from syms where lib_idx is not null) left join edge on ep = path and el = lib_idx")
def edge_status(spark, sf):
    """What the edge of an import's library says about the import."""
    i, g, _, _ = tables(spark)
    return B.applied(i.where("lib_idx is not null").dropDuplicates(B.KEY), g).select("path", "imp_ord", "status", "target")


@book.add("c11_binding_rules", f"with {_BASE} select path, imp_ord, case when kind = 'pinvoke' then 'pinvoke' when signature is not null then 'member' when path in ('Main', 'Frame') then 'macho' when path = 'App.exe' then 'pe' else 'elf' end as rule from (select distinct on (path, imp_ord) * from syms)")
def binding_rules(spark, sf):
    """Which loader's rule binds an import, by its kind and the format of its file."""
    fmt = F.when(F.col("path").isin("Main", "Frame"), "macho").when(F.col("path") == "App.exe", "pe").otherwise("elf")
    return X.IMPORTS.frame(spark).dropDuplicates(B.KEY).select("path", "imp_ord", F.when(F.col("kind") == "pinvoke", "pinvoke").when(F.col("signature").isNotNull(), "member").otherwise(fmt).alias("rule"))


@book.add("d17_link_status", f"with {_BASE}, {_EDGE} select coalesce(es, 'none') as status, count(*) as n from (select distinct on (path, imp_ord) * from syms) left join edge on ep = path and el = lib_idx group by 1")
def link_status(spark, sf):
    i, g, _, _ = tables(spark)
    e = g.groupBy("path", "lib_idx").agg(F.min(F.struct("target", "status")).alias("g"))
    return i.dropDuplicates(B.KEY).join(e, ["path", "lib_idx"], "left").groupBy(F.coalesce("g.status", F.lit("none")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
