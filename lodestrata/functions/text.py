"""Text functions that need code per value: Arrow-batched, or Column expressions where they suffice."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

ANSI = re.compile(r"\x1b\[[0-9;?]*[ -/]*[@-~]")
#: Primitive descriptors of the Dalvik format (fixed values).
PRIMITIVES = {"V": "void", "Z": "boolean", "B": "byte", "S": "short", "C": "char", "I": "int", "J": "long", "F": "float", "D": "double"}


def rewriter(spark: SparkSession, names: dict[str, str], most: int = 200_000):
    """A function of a text column that renames whole identifiers in one pass and drops terminal colours.

    The map is broadcast, so it is refused above ``most`` names; more names are a join on the words of the text (see ``k2_mentions``).
    """
    if len(names) > most:
        raise ValueError(f"{len(names)} names are too many to broadcast")
    shared = spark.sparkContext.broadcast(names)

    @F.pandas_udf(StringType())
    def rewrite(texts: pd.Series) -> pd.Series:
        table = shared.value
        word = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z_.$@?][A-Za-z0-9_.$@?]*")
        return pd.Series([None if t is None else word.sub(lambda m: table.get(m[0], m[0]), ANSI.sub("", t)) for t in texts], dtype=object)

    return rewrite


@F.pandas_udf(StringType())
def normal_source(texts: pd.Series) -> pd.Series:
    """Without leading blank and WARNING lines and trailing blanks."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        lines = [x.rstrip() for x in t.split("\n")]
        k = 0
        while k < len(lines) and (not lines[k] or lines[k].lstrip().startswith("WARNING")):
            k += 1
        return "\n".join(lines[k:]).rstrip()

    return pd.Series([one(t) for t in texts], dtype=object)


@F.pandas_udf(StringType())
def jni_name(parts: pd.Series) -> pd.Series:
    """Escapes of the Java Native Interface: ``_`` ``;`` ``[`` become _1 _2 _3, ``/`` and ``.`` become ``_``, others ``_0xxxx`` per UTF-16 unit."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        out = []
        for c in t:
            if c in "/.":
                out.append("_")
            elif c in "_;[":
                out.append({"_": "_1", ";": "_2", "[": "_3"}[c])
            elif c.isascii() and c.isalnum():
                out.append(c)
            else:
                raw = c.encode("utf-16-be", "surrogatepass")
                out += [f"_0{raw[i]:02x}{raw[i + 1]:02x}" for i in range(0, len(raw), 2)]
        return "".join(out)

    return pd.Series([one(t) for t in parts], dtype=object)


def java_type(c: Column) -> Column:
    """Java spelling of a Dalvik type descriptor."""
    depth = F.length(F.regexp_extract(c, r"^(\[*)", 1))
    base = F.regexp_replace(c, r"^\[+", "")
    table = F.create_map(*[F.lit(x) for kv in PRIMITIVES.items() for x in kv])
    plain = F.when(base.rlike("^L.*;$"), F.translate(F.regexp_replace(base, "^L|;$", ""), "/$", "..")).otherwise(F.coalesce(table[base], base))
    return F.concat(plain, F.repeat(F.lit("[]"), depth))


def component_class(package: Column, name: Column) -> Column:
    """Full class name of a component: ``.X`` and bare names belong to the package."""
    return F.when(name.startswith("."), F.concat(package, name)).when(F.contains(name, F.lit(".")), name).otherwise(F.concat(package, F.lit("."), name))


def find_bytes(pattern: bytes):
    """A function of a binary column: offsets of all hits of a byte string, overlapping ones as well."""

    @F.pandas_udf(ArrayType(LongType()))
    def hits(data: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> list[int] | None:
            if b is None:
                return None
            out, at = [], b.find(pattern) if pattern else -1
            while at >= 0:
                out.append(at)
                at = b.find(pattern, at + 1)
            return out

        return pd.Series([one(b) for b in data], dtype=object)

    return hits


def read_bytes(content: Column, offset: int, size: int, virtual: Column) -> Column:
    """``size`` bytes (64 KiB at most) from ``offset``; what lies behind the stored part but inside the virtual size reads as zeros."""
    n = F.greatest(F.lit(0), F.least(F.lit(min(size, 65536)), virtual - offset)).cast("int")
    raw = F.substring(content, F.lit(offset + 1), n)
    return F.unhex(F.rpad(F.hex(raw), n * 2, F.lit("0")))
