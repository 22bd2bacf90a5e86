"""Results written as documents, text per cluster, headers and manifests.

Every sink writes a folder beside its target first and renames it when it is whole, through the file system that Spark itself uses, so readers never
see half of it; a run that is repeated replaces what an earlier one left. Nothing is gathered on the driver but counts.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.scalar import shannon_entropy

#: Order of the kinds of types in a header.
TYPE_ORDER = {"base": 0, "struct": 1, "union": 1, "enum": 1, "typedef": 2}


def publish(spark: SparkSession, write: Callable[[str], None], target: str, tries: int = 10) -> None:
    """Run ``write`` on a fresh folder beside ``target`` and rename that to it; renaming is tried again for a while if another program holds it."""
    jvm = spark.sparkContext._jvm
    tmp = f"{target.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    write(tmp)
    to, at = jvm.org.apache.hadoop.fs.Path(target), jvm.org.apache.hadoop.fs.Path(tmp)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k in range(tries):
        fs.delete(to, True)
        if fs.rename(at, to):
            return
        time.sleep(min(0.05 * 2**k, 1.0))
    fs.delete(at, True)
    raise OSError(f"can't put {target} in place")


def json_rows(rows: DataFrame, target: str) -> int:
    """One JSON object per row, nulls left out; gives the number of rows."""
    publish(rows.sparkSession, lambda tmp: rows.write.option("ignoreNullFields", "true").json(tmp), target)
    return rows.sparkSession.read.text(target).count()


def document(head: DataFrame, target: str) -> None:
    """A single row as one indented JSON document."""
    text = head.limit(2).select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value"))
    publish(head.sparkSession, lambda tmp: text.coalesce(1).write.text(tmp), target)


def line_ranges(members: DataFrame, gap: int = 2) -> DataFrame:
    """cluster, pos, first_line, last_line of each member's text when a cluster's texts follow each other with ``gap`` lines between.

    ``members``: cluster, pos, text. Running sums per cluster (clusters hold fifty members at most); null texts take no lines and have null ranges.
    """
    n = F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n"))).otherwise(0)
    w = Window.partitionBy("cluster").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    lines = members.select("cluster", "pos", n.alias("n")).withColumn("before", F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n") + gap)).over(w), F.lit(0)))
    return lines.select("cluster", "pos", F.when(F.col("n") > 0, F.col("before") + 1).alias("first_line"), F.when(F.col("n") > 0, F.col("before") + F.col("n")).alias("last_line"))


def cluster_texts(members: DataFrame, target: str, gap: int = 2) -> DataFrame:
    """Texts of each cluster in one file under ``target``/cluster=<name>; gives ``line_ranges``."""
    text = members.where("text is not null").groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("ts"))
    body = text.select("cluster", F.array_join(F.transform("ts", lambda x: x["text"]), "\n" * (gap + 1)).alias("value"))
    publish(members.sparkSession, lambda tmp: body.write.partitionBy("cluster").text(tmp), target)
    return line_ranges(members, gap)


def manifest(rows: DataFrame, target: str, group: str) -> None:
    """Per ``group`` the number of rows and of failures (``failure`` is not null), as JSON rows."""
    json_rows(rows.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.count("failure").alias("failures")), target)


def sections(segments: DataFrame, target: str) -> None:
    """Sections with their bytes and entropy. ``segments``: name, perms, content; those without a name are left out."""
    publish(segments.sparkSession, lambda tmp: segments.where("name <> ''").withColumn("entropy", shannon_entropy("content")).write.parquet(tmp), target)


def header(prototypes: DataFrame, types: DataFrame, target: str) -> None:
    """C header: types ordered base, aggregate, typedef, other and then by name, then sorted prototypes, each once.

    ``prototypes``: prototype; ``types``: kind, name, c_decl. Lines are range-sorted in Spark; null or empty ones are left out.
    """
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in TYPE_ORDER.items()], F.lit(3))
    a = types.where("name is not null and c_decl <> ''").select(F.lit(0).alias("part"), rank.alias("rank"), "name", F.col("c_decl").alias("value"))
    b = prototypes.where("prototype <> ''").select(F.lit(1).alias("part"), F.lit(0).alias("rank"), F.col("prototype").alias("name"), F.concat(F.rtrim(F.rtrim("prototype"), F.lit(";")), F.lit(";")).alias("value"))
    first = prototypes.sparkSession.createDataFrame([(-1, k, "", x) for k, x in enumerate(("#pragma once", "#include <stdbool.h>", "#include <stdint.h>"))], "part int, rank int, name string, value string")
    lines = first.unionByName(a).unionByName(b).distinct().orderBy("part", "rank", "name", "value").select("value")
    publish(prototypes.sparkSession, lambda tmp: lines.write.text(tmp), target)
