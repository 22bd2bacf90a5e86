"""A folder of files as tables: inventory, duplicates and link facts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestrata.sources.formats import classify, link_facts, zip_flavour

#: Folders that hold no programs: version control, caches, earlier output.
NOISE = r"(?:^|/)(?:\.git|\.hg|\.svn|__pycache__|node_modules|\.cache|[^/]+_decompiler)(?:/|$)"
FACTS = "path string, image int, format string, arch string, bits int, kind string, image_base decimal(20,0), identity string, libraries array<struct<name:string,kind:string>>, rpaths array<string>, runpaths array<string>, imports array<struct<name:string,library:string,ordinal:int,version:string,weak:boolean>>, exports array<struct<name:string,address:decimal(20,0),ordinal:int,forwarder:string,weak:boolean>>, versions array<struct<name:string,version:string,is_default:boolean>>, notes array<string>"


def files(spark: SparkSession, root: str) -> DataFrame:
    """path (below ``root``), size, content of every file outside the noise folders."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(root.rstrip("/") + "/")
    path = F.substring("path", F.locate(root.rstrip("/") + "/", F.col("path")) + F.length(base), F.lit(1 << 20))
    return raw.select(path.alias("path"), F.col("length").alias("size"), "content").where(~F.col("path").rlike(NOISE))


@F.pandas_udf(StringType())
def _kinds(content: pd.Series, path: pd.Series) -> pd.Series:
    def one(c: bytes, p: str) -> str:
        kind = classify(c[:4096])
        return zip_flavour(c, p) if kind == "zip" else kind

    return pd.Series([one(c, p) for c, p in zip(content, path, strict=True)], dtype=object)


def inventory(found: DataFrame) -> DataFrame:
    """path, size, kind, sha256 (of code only) and duplicate_of: the first path with the same code."""
    kinds = found.select("path", "size", _kinds("content", "path").alias("kind"), "content")
    code = F.col("kind").isin("elf", "pe", "macho", "macho_fat")
    hashed = kinds.select("path", "size", "kind", F.when(code, F.sha2("content", 256)).alias("sha256"))
    first = hashed.where("sha256 is not null").groupBy("sha256").agg(F.min("path").alias("first"))
    return hashed.join(first, "sha256", "left").select("path", "size", "kind", "sha256", F.when(F.col("first") != F.col("path"), F.col("first")).alias("duplicate_of"))


def images(found: DataFrame) -> DataFrame:
    """Link facts of every image of every file; a damaged file gives a row with notes."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                for k, f in enumerate(link_facts(content)):
                    row = {"path": path, "image": k, **f}
                    row["libraries"] = [{"name": n, "kind": x} for n, x in f["libraries"]]
                    row["imports"] = [dict(zip(("name", "library", "ordinal", "version", "weak"), x, strict=True)) for x in f["imports"]]
                    row["exports"] = [dict(zip(("name", "address", "ordinal", "forwarder", "weak"), (x[0], _dec(x[1]), *x[2:]), strict=True)) for x in f["exports"]]
                    row["versions"] = [dict(zip(("name", "version", "is_default"), x, strict=True)) for x in f["versions"]]
                    row["image_base"] = _dec(f["image_base"])
                    rows.append(row)
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in FACTS.split(", ")]).astype({"bits": "Int32", "image": "int32"})

    return found.select("path", "content").mapInPandas(read, FACTS)


def _dec(v: int | None):
    from decimal import Decimal

    return None if v is None else Decimal(v)
