"""Scans, projections, predicates and paging over the inventory tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import scalar as S
from lodestrata.operators.skew import lookup as by_key
from lodestrata.plans.helpers import Book
from lodestrata.session import table

book = Book()
QUERIES, ORACLE = book.queries, book.oracle
_HEX = "'0x' || lower(to_hex(address::ubigint))"
_KIND = "case when imported then 'import' when library then 'library' when thunk then 'thunk' else code_kind end"


@book.add("a3_first_text", "select import_id, loaded_at, coalesce(nullif(trim(dll), ''), nullif(trim(bind), ''), nullif(trim(kind), '')) as origin from imports")
def first_text(spark, sf):
    return table(spark, sf, "imports").select("import_id", "loaded_at", S.first_text("dll", "bind", "kind").alias("origin"))


@book.add("a4_first_int", "select function_row_id, coalesce(try_cast(regexp_extract(name, '^sub_([0-9]+)$', 1) as bigint), try_cast(cast(token as varchar) as bigint), cast(line_start as bigint)) as number from function_rows")
def first_int(spark, sf):
    return table(spark, sf, "function_rows").select("function_row_id", S.first_int(F.regexp_extract("name", "^sub_([0-9]+)$", 1), F.col("token").cast("string"), "line_start").alias("number"))


@book.add("a5_typed_params", "select routine_id, array_to_string(list_transform(list_filter(params, lambda p: p.type <> ''), lambda p: coalesce(p.name, '') || ':' || p.type), ',') as typed from routines")
def typed_params(spark, sf):
    kept = F.transform(F.filter("params", lambda p: p["type"] != ""), lambda p: F.concat(F.coalesce(p["name"], F.lit("")), F.lit(":"), p["type"]))
    return table(spark, sf, "routines").select("routine_id", F.array_join(kept, ",").alias("typed"))


@book.add(
    "a6_imports_by_address",
    "select binary_id, cast(address as varchar) as address, import_id, name, lib from (select binary_id, address, import_id, name, coalesce(nullif(trim(dll), ''), nullif(trim(bind), '')) as lib, row_number() over (partition by binary_id, address order by loaded_at desc, import_id desc) as r from imports where address <> 0) where r = 1",
)
def imports_by_address(spark, sf):
    """The last row of each address wins; max of a struct combines map-side, so a crowded address is no single task's work."""
    rows = table(spark, sf, "imports").where("address <> 0")
    last = rows.groupBy("binary_id", "address").agg(F.max(F.struct("loaded_at", "import_id", "name", S.first_text("dll", "bind").alias("lib"))).alias("x"))
    return last.select("binary_id", F.col("address").cast("string").alias("address"), "x.import_id", "x.name", "x.lib")


@book.add("a7_routines", f"select routine_id, coalesce(nullif(name, ''), 'sub_' || lower(to_hex(address::ubigint))) as shown, {_KIND} as kind, imported or exists (select 1 from imports i where i.binary_id = r.binary_id and i.address = r.address) or regexp_matches(name, '^(sym\\.imp\\.|loc\\.imp\\.|__imp_)') as is_import from routines r")
def routines(spark, sf):
    known = table(spark, sf, "imports").select("binary_id", "address").distinct().withColumn("hit", F.lit(True))
    r = table(spark, sf, "routines").join(known, ["binary_id", "address"], "left")
    shown = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.concat(F.lit("sub_"), F.substring(S.hex_address(F.col("address")), 3, 16)))
    return r.select("routine_id", shown.alias("shown"), S.kind_of(F.col("imported"), F.col("library"), F.col("thunk"), F.col("code_kind")).alias("kind"), (F.col("imported") | F.coalesce("hit", F.lit(False)) | F.col("name").rlike(r"^(sym\.imp\.|loc\.imp\.|__imp_)")).alias("is_import"))


@book.add("a9_address_domain", "select binary_id, count(*) as addresses from (select binary_id, vaddr as a from strings where vaddr is not null union select binary_id, address from routines where not imported union select binary_id, address from imports where address is not null) group by 1")
def address_domain(spark, sf):
    parts = [table(spark, sf, "strings").select("binary_id", F.col("vaddr").alias("a")), table(spark, sf, "routines").where("not imported").select("binary_id", "address"), table(spark, sf, "imports").select("binary_id", "address")]
    return parts[0].union(parts[1]).union(parts[2]).where("a is not null").distinct().groupBy("binary_id").agg(F.count(F.lit(1)).alias("addresses"))


@book.add("a14_duplicates", "select doc_id, first_id as duplicate_of from (select doc_id, min(doc_id) over (partition by sha256(text)) as first_id from documents where text is not null) where doc_id <> first_id")
def duplicates(spark, sf):
    """The smallest id of each content hash, looked up by the hash: no window holds all copies, and a much-copied text meets a broadcast row."""
    keyed = table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    return by_key(keyed, keyed.groupBy("h").agg(F.min("doc_id").alias("duplicate_of")), ["h"]).where("doc_id <> duplicate_of").select("doc_id", "duplicate_of")


@book.add("a46_function_index", "select function_row_id, '0x' || lower(to_hex(address::ubigint)) as address, source_file, line_start, line_end, line_end - line_start + 1 as lines from function_rows where line_start is not null")
def function_index(spark, sf):
    return table(spark, sf, "function_rows").where("line_start is not null").select("function_row_id", S.hex_address(F.col("address")).alias("address"), "source_file", "line_start", "line_end", (F.col("line_end") - F.col("line_start") + 1).alias("lines"))


@book.add("a48_status_counts", "select binary_id, count(*) as renders, count(failure) as failures, count(asm_text) as with_asm from renders group by 1")
def status_counts(spark, sf):
    return table(spark, sf, "renders").groupBy("binary_id").agg(F.count(F.lit(1)).alias("renders"), F.count("failure").alias("failures"), F.count("asm_text").alias("with_asm"))


@book.add("b1_functions", f"select {_HEX} as address, name, {_KIND} as kind from routines where regexp_matches(name, '(?i)open|close')")
def functions(spark, sf):
    r = table(spark, sf, "routines").where(S.search(F.col("name"), "open|close"))
    return r.select(S.hex_address(F.col("address")).alias("address"), "name", S.kind_of(F.col("imported"), F.col("library"), F.col("thunk"), F.col("code_kind")).alias("kind"))


@book.add("b2_bad_pattern", "select string_id, value from strings where contains(lower(value), '(0x%x')")
def bad_pattern(spark, sf):
    """A pattern that doesn't compile is searched as text."""
    return table(spark, sf, "strings").where(S.search(F.col("value"), "(0x%x")).select("string_id", "value")


@book.add("b5_lookup", "select name, routine_id from routines where contains(lower(name), 'read') order by name, routine_id limit 50")
def lookup(spark, sf):
    return table(spark, sf, "routines").where(F.contains(F.lower("name"), F.lit("read"))).select("name", "routine_id").orderBy("name", "routine_id").limit(50)


@book.add("b6_app_support", "select routine_id, case when not imported and code_kind = 'app' and not library then 'app' when not imported and code_kind <> 'app' then 'support' end as part from routines")
def app_support(spark, sf):
    part = F.when(~F.col("imported") & (F.col("code_kind") == "app") & ~F.col("library"), "app").when(~F.col("imported") & (F.col("code_kind") != "app"), "support")
    return table(spark, sf, "routines").select("routine_id", part.alias("part"))


@book.add("b7_glob", r"select file_id from source_files where regexp_matches(path, '^(?:[^/]+/)*lib/[^/]*\.c$') or regexp_matches(regexp_extract(path, '([^/]*)$', 1), '^cluster_[^/]*\.cs$')")
def glob(spark, sf):
    return table(spark, sf, "source_files").where(S.path_matches(F.col("path"), ["**/lib/*.c", "cluster_*.cs"])).select("file_id")


@book.add("b13_interesting_strings", r"""select string_id, value from strings where regexp_matches(value, '(?i)https?://|ftp://|\\\\[\w.]+\\|[a-z]:\\|\b\d{1,3}(\.\d{1,3}){3}\b|software\\|\.(exe|dll|ini)\b|%[sdx]')""")
def interesting_strings(spark, sf):
    return table(spark, sf, "strings").where(F.col("value").rlike(r"(?i)https?://|ftp://|\\\\[\w.]+\\|[a-z]:\\|\b\d{1,3}(\.\d{1,3}){3}\b|software\\|\.(exe|dll|ini)\b|%[sdx]")).select("string_id", "value")


@book.add("b16_forwarders", r"select exp_ord, dll, regexp_extract(forwarder, '^(.+)\.([^.]+)$', 1) as target_dll, regexp_extract(forwarder, '^(.+)\.([^.]+)$', 2) as target_name from exports where forwarder is not null")
def forwarders(spark, sf):
    return table(spark, sf, "exports").where("forwarder is not null").select("exp_ord", "dll", F.regexp_extract("forwarder", r"^(.+)\.([^.]+)$", 1).alias("target_dll"), F.regexp_extract("forwarder", r"^(.+)\.([^.]+)$", 2).alias("target_name"))


@book.add("b17_entry_seeds", "select address, min(exp_ord) as ord from exports where address is not null and address <> 0 group by 1")
def entry_seeds(spark, sf):
    return table(spark, sf, "exports").where("address is not null and address <> 0").groupBy("address").agg(F.min("exp_ord").alias("ord"))


@book.add(
    "b21_thunks",
    "select r.routine_id from routines r left join (select c.binary_id, c.src, count(distinct c.dst) as n, bool_and(coalesce(t.imported, false)) as all_imported from calls c left join routines t on t.binary_id = c.binary_id and t.address = c.dst group by 1, 2) g on g.binary_id = r.binary_id and g.src = r.address where r.imported or (r.size <= 16 and (n is null or (n = 1 and all_imported)))",
)
def thunks(spark, sf):
    r = table(spark, sf, "routines")
    edges = table(spark, sf, "calls").select("binary_id", "src", F.col("dst").alias("address")).distinct()
    callee = edges.join(r.select("binary_id", "address", "imported"), ["binary_id", "address"], "left").groupBy("binary_id", F.col("src").alias("address")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce("imported", F.lit(False))).alias("all_imported"))
    return r.join(callee, ["binary_id", "address"], "left").where("imported or (size <= 16 and (n is null or (n = 1 and all_imported)))").select("routine_id")


@book.add("b13_api_words", "select family, count(distinct binary_id) as binaries, count(*) as rows_n from (select binary_id, case when regexp_matches(name, '(?i)socket|packet|channel') then 'network' when regexp_matches(name, '(?i)thread|lock') then 'threads' when regexp_matches(name, '(?i)file|stream|journal') then 'files' end as family from imports where name is not null) where family is not null group by 1")
def api_families(spark, sf):
    """The first matching family counts. Distinct binaries are counted over distinct pairs, which combine map-side."""
    family = F.when(F.col("name").rlike("(?i)socket|packet|channel"), "network").when(F.col("name").rlike("(?i)thread|lock"), "threads").when(F.col("name").rlike("(?i)file|stream|journal"), "files")
    pairs = table(spark, sf, "imports").where("name is not null").select("binary_id", family.alias("family")).where("family is not null").groupBy("family", "binary_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("family").agg(F.count(F.lit(1)).alias("binaries"), F.sum("n").alias("rows_n"))


@book.add("h1_page", "select routine_id, binary_id, address from routines order by binary_id, address limit 100 offset 200")
def page(spark, sf):
    return table(spark, sf, "routines").select("routine_id", "binary_id", "address").orderBy("binary_id", "address").offset(200).limit(100)


@book.add(
    "h2_tiered_strings",
    r"select value, tier from (select value, min(case when regexp_matches(value, '(?i)https?://') then 0 when regexp_matches(value, '(?i)select .* from ') then 1 when regexp_matches(value, '/[a-z]+/') then 2 end) as tier, min(string_id) as ord from strings where length(value) between 6 and 512 group by value) where tier is not null order by tier, ord limit 100",
)
def tiered_strings(spark, sf):
    tier = F.when(F.col("value").rlike("(?i)https?://"), 0).when(F.col("value").rlike("(?i)select .* from "), 1).when(F.col("value").rlike("/[a-z]+/"), 2)
    first = table(spark, sf, "strings").where(F.length("value").between(6, 512)).groupBy("value").agg(F.min("string_id").alias("ord")).withColumn("tier", tier).where("tier is not null")
    return first.orderBy("tier", "ord").limit(100).select("value", "tier")


@book.add("h4_export_order", "select exp_ord, row_number() over (order by coalesce(ordinal, 1073741824), name, exp_ord) as pos from exports qualify pos <= 100")
def export_order(spark, sf):
    """The first hundred by ordinal: a top-k, so that the global ranks are made over one hundred rows only."""
    top = table(spark, sf, "exports").orderBy(F.coalesce("ordinal", F.lit(1 << 30)), "name", "exp_ord").limit(100)
    return top.select("exp_ord", F.row_number().over(Window.orderBy(F.coalesce("ordinal", F.lit(1 << 30)), "name", "exp_ord")).alias("pos"))


@book.add("h8_largest_first", "select binary_id, routine_id, size from routines qualify row_number() over (partition by binary_id order by size desc, routine_id) <= 5")
def largest_first(spark, sf):
    """Five per binary; ranks of 64 salts first, so a binary with most routines isn't one task's window."""
    r = table(spark, sf, "routines").select("binary_id", "routine_id", "size").withColumn("salt", F.pmod(F.xxhash64("routine_id"), F.lit(64)))
    order = [F.desc("size"), F.col("routine_id")]
    part = r.withColumn("k", F.row_number().over(Window.partitionBy("binary_id", "salt").orderBy(*order))).where("k <= 5")
    return part.withColumn("k", F.row_number().over(Window.partitionBy("binary_id").orderBy(*order))).where("k <= 5").select("binary_id", "routine_id", "size")
