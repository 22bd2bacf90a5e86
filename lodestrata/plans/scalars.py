"""Scalar functions applied to whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import scalar as S
from lodestrata.plans.helpers import Book
from lodestrata.session import table

book = Book()
QUERIES, ORACLE = book.queries, book.oracle
_CLEAN = "coalesce(nullif(regexp_replace(regexp_replace({}, '[^0-9A-Za-z_]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unnamed')"
_STEM = "regexp_replace(regexp_replace(name, '@.*$', '', 's'), '^(?:sym\\.imp\\.|loc\\.imp\\.|sym\\.|imp\\.|__imp_)+', '')"


@book.add("j1_path_component", f"select string_id, {_CLEAN.format('value')} as component from strings where value is not null")
def path_component(spark, sf):
    return table(spark, sf, "strings").where("value is not null").select("string_id", S.clean_path_component(F.col("value")).alias("component"))


@book.add("j2_bounded_component", "select string_id, case when length(value) <= 40 then value else left(value, 29) || '_' || left(sha1(value), 10) end as component from strings where value is not null")
def bounded_component(spark, sf):
    return table(spark, sf, "strings").where("value is not null").select("string_id", S.bounded(F.col("value"), 40).alias("component"))


@book.add("j3_identifier", "select import_id, case when regexp_matches(regexp_replace(name, '[^0-9A-Za-z_]', '_', 'g'), '^[0-9]') then 'fn_' else '' end || regexp_replace(name, '[^0-9A-Za-z_]', '_', 'g') as identifier from imports where name is not null")
def identifier(spark, sf):
    return table(spark, sf, "imports").where("name is not null").select("import_id", S.clean_identifier(F.col("name")).alias("identifier"))


@book.add("j6_link_key", f"select import_id, case when regexp_replace({_STEM}, '^_+', '') = '' then {_STEM} else regexp_replace({_STEM}, '^_+', '') end as key from imports where name is not null")
def link_key(spark, sf):
    return table(spark, sf, "imports").where("name is not null").select("import_id", S.link_key(F.col("name")).alias("key"))


@book.add("j7_name_variants", "select exp_ord, len(list_distinct([name, regexp_replace(name, '^_+', ''), '_' || name, regexp_replace(name, '@.*$', '', 's')])) as variants from exports where name is not null")
def name_variants(spark, sf):
    forms = F.array_distinct(F.array("name", F.regexp_replace("name", "^_+", ""), F.concat(F.lit("_"), "name"), F.regexp_replace("name", "(?s)@.*$", "")))
    return table(spark, sf, "exports").where("name is not null").select("exp_ord", F.size(forms).alias("variants"))


@book.add("j13_prototype", r"with h as (select routine_id, signature, rtrim(regexp_extract(signature, '^([^(]*)\(', 1)) as head from routines where signature is not null), n as (select *, regexp_extract(head, '([A-Za-z_][\w:~]*)$', 1) as fn from h) select routine_id, fn, case when fn <> '' then coalesce(nullif(rtrim(left(head, length(head) - length(fn))), ''), 'undefined8') end as return_type, case when fn <> '' then trim(regexp_extract(signature, '\((.*)\)', 1)) end as args from n where fn <> ''")
def prototype(spark, sf):
    p = table(spark, sf, "routines").where("signature is not null").select("routine_id", S.prototype_parts(F.col("signature")).alias("p")).where("p is not null")
    return p.select("routine_id", F.col("p.name").alias("fn"), "p.return_type", "p.args")


@book.add("j16_summary_counts", "select render_id, try_cast(regexp_extract(summary_text, '([0-9]+) callers', 1) as bigint) as callers from renders where summary_text is not null")
def summary_counts(spark, sf):
    return table(spark, sf, "renders").where("summary_text is not null").select("render_id", F.regexp_extract("summary_text", "([0-9]+) callers", 1).try_cast("bigint").alias("callers"))


_ALIASES = "case b when 'unsigned int' then 'u32' when 'uint32_t' then 'u32' when '_dword' then 'u32' when 'dword' then 'u32' when 'uint16_t' then 'u16' when '_word' then 'u16' when '__int64' then 'i64' when 'int64_t' then 'i64' when 'size_t' then 'u64' when 'uint64_t' then 'u64' when '_qword' then 'u64' when 'int' then 'i32' when 'int32_t' then 'i32' when '_bool8' then 'bool' when 'bool' then 'bool' when 'uint8_t' then 'u8' when '_byte' then 'u8' when 'unsigned char' then 'u8' else b end"


@book.add("j21_normal_types", rf"with x as (select trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(return_type, '\b(?:const|volatile|struct|enum|union|register|restrict)\b', ' ', 'g'))), '\s+', ' ', 'g'), '\s*\*\s*', '*', 'g')) as t from routines where return_type is not null), y as (select trim(regexp_replace(t, '\*+$', '')) as b, regexp_extract(t, '(\**)$', 1) as stars from x) select {_ALIASES} || stars as normal_type, count(*) as n from y group by 1")
def normal_types(spark, sf):
    """Return types and how often each occurs in normal form."""
    return table(spark, sf, "routines").where("return_type is not null").groupBy(S.normal_type(F.col("return_type")).alias("normal_type")).agg(F.count(F.lit(1)).alias("n"))


@book.add("j22_definitions", r"select render_id, regexp_extract(c_text, '(?:^|\n)[\w \t*]*?\b([A-Za-z_]\w*)\([^;{]*\)\s*\{', 1) as defined from renders where c_text is not null")
def definitions(spark, sf):
    return table(spark, sf, "renders").where("c_text is not null").select("render_id", F.regexp_extract("c_text", r"(?:^|\n)[\w \t*]*?\b([A-Za-z_]\w*)\([^;{]*\)\s*\{", 1).alias("defined"))


@book.add("j23_printable_runs", r"select render_id, len(regexp_extract_all(asm_text, '[\x20-\x7e]{4,}')) as runs from renders where asm_text is not null")
def printable_runs(spark, sf):
    return table(spark, sf, "renders").where("asm_text is not null").select("render_id", F.size(F.regexp_extract_all("asm_text", F.lit(r"[\x20-\x7e]{4,}"), F.lit(0))).alias("runs"))


@book.add("j26_hex", "select routine_id, '0x' || lower(to_hex(address::ubigint)) as address, cast(address as varchar) as back from routines")
def hex_forms(spark, sf):
    h = table(spark, sf, "routines").select("routine_id", S.hex_address(F.col("address")).alias("address"))
    return h.select("routine_id", "address", S.parse_hex(F.col("address")).cast("string").alias("back"))


@book.add("j27_bare_name", "select import_id, regexp_replace(regexp_replace(name, '@.*$', '', 's'), '^[._]+', '') as bare from imports where name is not null")
def bare_name(spark, sf):
    return table(spark, sf, "imports").where("name is not null").select("import_id", S.bare_name(F.col("name")).alias("bare"))


@book.add("j28_clip", "select doc_id, length(case when length(text) > 1000 then left(text, 1000) || '...' else text end) as shown from documents")
def clip(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(S.clip(F.col("text"), 1000, "...")).alias("shown"))


@book.add("j30_order_hash", "select binary_id, bit_xor(hash_n) as order_hash from (select binary_id, ('0x' || left(sha256(cast(address as varchar) || ':' || cast(pos as varchar)), 15))::bigint as hash_n from (select binary_id, address, row_number() over (partition by binary_id order by address) as pos from routines)) group by 1")
def order_hash(spark, sf):
    """Fingerprint of a binary's address order: hashes of (address, position) xor-ed, so that it is aggregated and not concatenated."""
    from pyspark.sql.window import Window

    r = table(spark, sf, "routines").select("binary_id", "address", F.row_number().over(Window.partitionBy("binary_id").orderBy("address")).alias("pos"))
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("address").cast("string"), F.col("pos").cast("string")), 256), 1, 15), 16, 10).cast("bigint")
    return r.groupBy("binary_id").agg(F.bit_xor(h).alias("order_hash"))


@book.add("j31_resolve_names", "with n as (select binary_id, name, min(address) as exact from routines where name is not null group by 1, 2), l as (select binary_id, lower(name) as low, max(address) as folded from routines where name is not null group by 1, 2), q as (select distinct binary_id, name from function_rows where name is not null) select q.binary_id, q.name, cast(coalesce(n.exact, l.folded) as varchar) as address from q left join n on n.binary_id = q.binary_id and n.name = q.name left join l on l.binary_id = q.binary_id and l.low = lower(q.name)")
def resolve_names(spark, sf):
    """Exact name (the first address), else the name in lower case (the last address)."""
    r = table(spark, sf, "routines").where("name is not null")
    exact, folded = r.groupBy("binary_id", "name").agg(F.min("address").alias("exact")), r.groupBy("binary_id", F.lower("name").alias("low")).agg(F.max("address").alias("folded"))
    q = table(spark, sf, "function_rows").where("name is not null").select("binary_id", "name").distinct().withColumn("low", F.lower("name"))
    return q.join(exact, ["binary_id", "name"], "left").join(folded, ["binary_id", "low"], "left").select("binary_id", "name", F.coalesce("exact", "folded").cast("string").alias("address"))


@book.add("k2_mentions", r"with w as (select distinct render_id, unnest(regexp_extract_all(c_text, '[A-Za-z_]\w*')) as word from renders where c_text is not null), t as (select distinct name as word from routines where name is not null) select render_id, count(*) as mentioned from w join t using (word) group by 1")
def mentions(spark, sf):
    """Renders that mention routine names as whole words: an inverted index joined by equality instead of one search per name."""
    w = table(spark, sf, "renders").where("c_text is not null").select("render_id", F.explode(F.array_distinct(F.regexp_extract_all("c_text", F.lit(r"[A-Za-z_]\w*"), F.lit(0)))).alias("word"))
    t = table(spark, sf, "routines").where("name is not null").select(F.col("name").alias("word")).distinct()
    return w.join(t, "word", "left_semi").groupBy("render_id").agg(F.count(F.lit(1)).alias("mentioned"))


@book.add("k7_edit_scope", "with e as (select distinct r.routine_id, r.binary_id, r.address from routines r join renders x on x.binary_id = r.binary_id and x.address = r.address where x.failure is not null) select e.routine_id as edited, r.routine_id as touched from e join calls c on c.binary_id = e.binary_id and c.dst = e.address join routines r on r.binary_id = c.binary_id and r.address = c.src union select routine_id, routine_id from e")
def edit_scope(spark, sf):
    """Each routine whose render failed with itself and its direct callers: what an edit of it makes stale."""
    r = table(spark, sf, "routines").select("routine_id", "binary_id", "address")
    failed = table(spark, sf, "renders").where("failure is not null").select("binary_id", "address")
    e = r.join(failed, ["binary_id", "address"], "left_semi").withColumnRenamed("routine_id", "edited")
    c = table(spark, sf, "calls").select("binary_id", "src", F.col("dst").alias("address")).distinct()
    callers = e.join(c, ["binary_id", "address"]).select("edited", "binary_id", F.col("src").alias("address")).join(r, ["binary_id", "address"]).select("edited", F.col("routine_id").alias("touched"))
    return callers.unionByName(e.select("edited", F.col("edited").alias("touched"))).distinct()


@book.add("k15_windows", "select time_bucket(interval '1 hour', ts) as start_at, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def windows(spark, sf):
    return table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start_at"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@book.add("k15_stream_windows", "select time_bucket(interval '1 hour', ts) as start_at, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_windows(spark, sf):
    """The same windows from a stream over the events, with a watermark; all that the source holds now is read."""
    from lodestrata.streaming.windows import drained, tumbling

    read = table(spark, sf, "events")
    source = spark.readStream.schema(read.schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    got = drained(spark, tumbling(source.withColumn("ts", F.col("ts").cast("timestamp"))))
    return got.select(F.col("start_at").cast("timestamp_ntz").alias("start_at"), "event_type", "n", F.round("total", 4).alias("total"))


@book.add("k15_sessions", "with g as (select user_id, ts, event_id, case when ts - lag(ts) over w <= interval '30 minutes' then 0 else 1 end as fresh from events window w as (partition by user_id order by ts, event_id)), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts, event_id) as k from g) select user_id, min(ts) as start_at, count(*) as n from s group by user_id, k")
def sessions(spark, sf):
    """Sessions of a user: events at most 30 minutes apart."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("user_id", "ts", "event_id")
    fresh = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 30 minutes"), 0).otherwise(1)
    s = e.withColumn("fresh", fresh).withColumn("k", F.sum("fresh").over(w))
    return s.groupBy("user_id", "k").agg(F.min("ts").alias("start_at"), F.count(F.lit(1)).alias("n")).select("user_id", "start_at", "n")
