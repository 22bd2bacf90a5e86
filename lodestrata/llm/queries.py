"""Queries over the operators of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.credentials import secrets
from lodestrata.llm.encoding import garbled
from lodestrata.llm.leakage import leaks
from lodestrata.llm.neardup import expand, similar_classes
from lodestrata.llm.packing import fill, pack
from lodestrata.llm.spam import spam_scores
from lodestrata.operators.components import connected_components
from lodestrata.session import cut, table


def _garbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled(table(spark, sf_dir, "strings").select(F.col("string_id").alias("rec_id"), "value"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _garbled(spark, sf_dir).select(F.col("rec_id").alias("string_id")).distinct()


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled strings with the original as far as it can be restored."""
    return _garbled(spark, sf_dir).select(F.col("rec_id").alias("string_id"), "value", "restored", "complete").distinct()


def _literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    strings = table(spark, sf_dir, "strings").select(F.lit("strings").alias("rec_table"), F.col("string_id").alias("rec_id"), F.col("value").alias("text"))
    return strings.unionByName(table(spark, sf_dir, "renders").select(F.lit("renders").alias("rec_table"), F.col("render_id").alias("rec_id"), F.col("c_text").alias("text")))


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that hold secrets, with the text in which they are masked."""
    return secrets(_literals(spark, sf_dir)).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(_literals(spark, sf_dir)).select("rec_table", "rec_id").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = expand(*similar_classes(table(spark, sf_dir, "renders"), "render_id", ["c_text", "asm_text"]))
    return pairs.select(F.col("a").alias("render_id_a"), F.col("b").alias("render_id_b"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per render in a group of similar ones: the group's smallest render_id and the number of other classes and copies it is linked to."""
    members, pairs = similar_classes(table(spark, sf_dir, "renders"), "render_id", ["c_text", "asm_text"])
    links = pairs.select("a", "b").unionByName(members.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))).distinct()
    groups = connected_components(links)
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    return groups.join(ends, "node").select(F.col("node").alias("render_id"), F.col("component").alias("group_id"), "links")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where("exact_windows > 0").select("doc_id", "item_id")


def p7_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with re-parameterised passages of an item, and the number of such windows."""
    return _leaks(spark, sf_dir).where("template_windows > 0")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked test items with the number of documents that give them away."""
    return p7_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"))


def p6_pack_512(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), 512)


def p6_pack_2048(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), 2048)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and used share of both capacities."""
    return fill(p6_pack_512(spark, sf_dir), 512).withColumn("capacity", F.lit(512)).unionByName(fill(p6_pack_2048(spark, sf_dir), 2048).withColumn("capacity", F.lit(2048)))


def p6_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: documents placed, containers over the capacity, and documents in several pieces though they would fit whole."""
    out = None
    for capacity in (512, 2048):
        placed = cut(pack(table(spark, sf_dir, "documents"), capacity).select("doc_id", "container", "n_tokens"))
        over = placed.groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > capacity).alias("overfull")).withColumn("capacity", F.lit(capacity))
        each = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n"))
        docs = each.agg(F.count(F.lit(1)).alias("docs"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= capacity)).alias("split_short")).withColumn("capacity", F.lit(capacity))
        row = docs.join(over, "capacity").select("capacity", "docs", "overfull", "split_short")
        out = row if out is None else out.unionByName(row)
    return out


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of stuffed text and perplexity of each document."""
    return spam_scores(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_scores(spark, sf_dir).where("stuffed > 0.5").select("doc_id").distinct()


_WINDOWS = """
dw as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents where text is not null),
dg as (select distinct doc_id, array_to_string(w[k:k+12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as k from dw where len(w) >= 13)),
pw as (select item_id, regexp_extract_all(lower(prompt), '[a-z0-9]+') as w from eval_items where prompt is not null),
pg as (select distinct item_id, array_to_string(w[k:k+12], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 11)) as k from pw where len(w) >= 13)),
hit as (select distinct doc_id, item_id from dg join pg using (g))
"""

QUERIES = {"p1_found": p1_found, "p1_restored": p1_restored, "p2_found": p2_found, "p2_redacted": p2_redacted, "p3_found": p3_found, "p3_groups": p3_groups, "p7_found": p7_found, "p7_templates": p7_templates, "p7_items": p7_items, "p6_pack_512": p6_pack_512, "p6_pack_2048": p6_pack_2048, "p6_fill": p6_fill, "p6_conservation": p6_conservation, "p8_found": p8_found, "p8_scores": p8_scores}
_SETS = """
words as (select render_id, 'c' as field, list_filter(regexp_extract_all(lower(c_text), '[a-z0-9_]+'), lambda x: not regexp_matches(x, '^[0-9]')) as w from renders where c_text is not null
union all select render_id, 'a', list_filter(regexp_extract_all(lower(asm_text), '[a-z0-9_]+'), lambda x: not regexp_matches(x, '^[0-9]')) from renders where asm_text is not null),
g as (select distinct render_id, field, w[k] || ' ' || w[k+1] || ' ' || w[k+2] as s from (select render_id, field, w, unnest(range(1, len(w) - 1)) as k from words where len(w) >= 20)),
n as (select render_id, field, count(*) as n from g group by all),
i as (select x.field, x.render_id as a, y.render_id as b, count(*) as c from g x join g y on x.field = y.field and x.s = y.s and x.render_id < y.render_id group by all)
"""

#: Classes of equal sets, links between their first members and to their copies, and components of these links.
_GROUPS = f"""recursive {_SETS}, k as (select render_id, field, md5(string_agg(s, chr(10) order by s)) as class from g group by all), r as (select field, class, min(render_id) as rep from k group by all),
near as (select i.field, i.a, i.b from i join n x on x.render_id = i.a and x.field = i.field join n y on y.render_id = i.b and y.field = i.field where i.c * 5 >= 3 * (x.n + y.n - i.c)),
l as (select distinct least(ra.rep, rb.rep) as a, greatest(ra.rep, rb.rep) as b from near join k ka on ka.render_id = near.a and ka.field = near.field join r ra on ra.field = ka.field and ra.class = ka.class join k kb on kb.render_id = near.b and kb.field = near.field join r rb on rb.field = kb.field and rb.class = kb.class where ra.rep <> rb.rep
union select r.rep, k.render_id from k join r on r.field = k.field and r.class = k.class where k.render_id <> r.rep),
e as (select a, b from l union select b, a from l), walk(v, c) as (select distinct a, a from e union select w.v, e.b from walk w join e on e.a = w.c), ends as (select a as v, count(*) as links from e group by 1)"""

ORACLE = {
    "p6_conservation": "select unnest([512, 2048]) as capacity, (select count(distinct doc_id) from documents where text <> '') as docs, 0 as overfull, 0 as split_short",
    "p3_groups": f"with {_GROUPS} select w.v as render_id, min(w.c) as group_id, any_value(ends.links) as links from walk w join ends on ends.v = w.v group by 1",
    "p3_found": f"with {_SETS} select distinct a as render_id_a, b as render_id_b from i join n x on x.render_id = a and x.field = i.field join n y on y.render_id = b and y.field = i.field where c * 5 >= 3 * (x.n + y.n - c)",
    "p7_found": f"with {_WINDOWS} select doc_id, item_id from hit",
    "p7_items": f"with {_WINDOWS} select item_id, count(*) as docs from hit group by 1",
}
