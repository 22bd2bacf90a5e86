"""Scalar functions as Column expressions (no Python on the executors)."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def first_text(*cols: str | Column) -> Column:
    """The first value that isn't blank, trimmed; null if all are."""
    return F.coalesce(*[F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit("")) for c in cols])


def first_int(*cols: str | Column) -> Column:
    """The first value that reads as an integer."""
    return F.coalesce(*[(F.col(c) if isinstance(c, str) else c).try_cast("bigint") for c in cols])


def hex_address(c: Column) -> Column:
    """``0x...`` of an unsigned 64-bit address kept as decimal(20,0)."""
    return F.concat(F.lit("0x"), F.lower(F.conv(c.cast("string"), 10, 16)))


def parse_hex(c: Column) -> Column:
    """decimal(20,0) of ``0x...``; null where it isn't one of 1 to 16 digits."""
    return F.when(c.rlike("^0[xX][0-9a-fA-F]{1,16}$"), F.conv(F.substring(c, 3, 16), 16, 10).cast("decimal(20,0)"))


def kind_of(imported: Column, library: Column, thunk: Column, code_kind: Column) -> Column:
    """import > library > thunk > the code's own kind."""
    return F.when(imported, "import").when(library, "library").when(thunk, "thunk").otherwise(code_kind)


def clean_path_component(c: Column) -> Column:
    """Runs of other characters than ASCII letters, digits and ``_`` become one ``_``; outer ``_`` go; ``unnamed`` if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(c, "[^0-9A-Za-z_]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("unnamed"))


def bounded(c: Column, limit: int = 120, tail: int = 10) -> Column:
    """At most ``limit`` characters; longer values end with the start of their SHA-1, so that they stay distinct."""
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit - tail - 1), F.lit("_"), F.substring(F.sha1(c), 1, tail)))


def clean_identifier(c: Column) -> Column:
    """A C identifier: other characters become ``_``, a leading digit gets ``fn_`` before it."""
    x = F.regexp_replace(c, "[^0-9A-Za-z_]", "_")
    return F.when(x.rlike("^[0-9]"), F.concat(F.lit("fn_"), x)).otherwise(x)


def link_key(c: Column) -> Column:
    """Symbol without version suffix, import prefixes and leading underscores (unless nothing else is left)."""
    x = F.regexp_replace(F.regexp_replace(c, "(?s)@.*$", ""), r"^(?:sym\.imp\.|loc\.imp\.|sym\.|imp\.|__imp_)+", "")
    bare = F.regexp_replace(x, "^_+", "")
    return F.when(bare == "", x).otherwise(bare)


def bare_name(c: Column) -> Column:
    """Cut at ``@``, without leading ``.`` and ``_``."""
    return F.regexp_replace(F.regexp_replace(c, "(?s)@.*$", ""), "^[._]+", "")


def clip(c: Column, limit: int = 200_000, marker: str = "\n... [truncated]") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(marker))).otherwise(c)


def flag_names(flags: Column, table: Iterable[tuple[int, str]]) -> Column:
    """Names of the set bits, in table order."""
    return F.array_compact(F.array(*[F.when(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for bit, name in table]))


def prototype_parts(c: Column) -> Column:
    """struct(return_type, name, args) of a C prototype; stars before the name belong to the type; a missing type is ``undefined8``."""
    head = F.rtrim(F.regexp_extract(c, r"^([^(]*)\(", 1))
    name = F.regexp_extract(head, r"([A-Za-z_][\w:~]*)$", 1)
    kind = F.rtrim(F.substring(head, F.lit(1), F.length(head) - F.length(name)))
    args = F.trim(F.regexp_extract(c, r"\((.*)\)", 1))
    return F.when(name != "", F.struct(F.coalesce(F.nullif(kind, F.lit("")), F.lit("undefined8")).alias("return_type"), name.alias("name"), args.alias("args")))


def normal_type(c: Column) -> Column:
    """A type for comparison: no qualifiers, common aliases, no blanks before stars."""
    x = F.lower(F.trim(F.regexp_replace(c, r"\b(?:const|volatile|struct|enum|union|register|restrict)\b", " ")))
    x = F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"\s*\*\s*", "*")
    x = F.trim(x)
    aliases = {"unsigned int": "u32", "uint32_t": "u32", "_dword": "u32", "dword": "u32", "uint16_t": "u16", "_word": "u16", "__int64": "i64", "int64_t": "i64", "size_t": "u64", "uint64_t": "u64", "_qword": "u64", "int": "i32", "int32_t": "i32", "_bool8": "bool", "bool": "bool", "uint8_t": "u8", "_byte": "u8", "unsigned char": "u8"}
    base, stars = F.trim(F.regexp_replace(x, r"\*+$", "")), F.regexp_extract(x, r"(\**)$", 1)
    return F.concat(F.coalesce(F.element_at(F.create_map(*[F.lit(y) for kv in aliases.items() for y in kv]), base), base), stars)


#: What each piece of a path glob stands for; a class of characters is taken over as it is.
_GLOB = re.compile(r"(?P<dirs>\*\*/)|(?P<all>\*\*)|(?P<some>\*)|(?P<one>\?)|\[(?P<not>!?)(?P<set>\]?[^\]]*)\]|(?P<plain>.)", re.DOTALL)
_GLOB_PARTS = {"dirs": "(?:[^/]+/)*", "all": ".*", "some": "[^/]*", "one": "[^/]"}


def glob_pattern(pattern: str) -> str:
    """Anchored regular expression of a path glob: ``*`` and ``?`` stay inside a folder, ``**/`` stands for any number of folders, ``[a-z]`` and
    ``[!a-z]`` for one character; a leading ``./`` says nothing."""

    def piece(m: re.Match[str]) -> str:
        if m["set"] is not None:
            inside = re.sub(r"([\\\[\]^&])", r"\\\1", m["set"])
            return f"[{'^/' if m['not'] else ''}{inside}]"
        return re.escape(m[0]) if m["plain"] else _GLOB_PARTS[m.lastgroup]

    return f"^{_GLOB.sub(piece, pattern.removeprefix('./'))}$"


def path_matches(path: Column, patterns: Iterable[str]) -> Column:
    """A pattern without ``/`` is held against the base name, others against the whole path."""
    base = F.regexp_extract(path, "([^/]*)$", 1)
    return reduce(lambda a, b: a | b, [(path if "/" in p else base).rlike(glob_pattern(p)) for p in patterns], F.lit(False))


def search(c: Column, pattern: str) -> Column:
    """Case-insensitive regular expression; a pattern that doesn't compile is looked for as plain text. The pattern must compile for the engine that
    runs it: where a session is there, that is asked; forms that only Python knows, as ``(?P<x>..)``, are then text as well."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    try:
        if spark is not None:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(f"(?iu){pattern}")
        else:
            re.compile(pattern)
    except Exception:  # either engine's own error
        return F.contains(F.lower(c), F.lit(pattern.lower()))
    return c.rlike(f"(?iu){pattern}")


@F.pandas_udf(DoubleType())
def shannon_entropy(values: pd.Series) -> pd.Series:
    """Bits per byte of a text's UTF-8 form (or of binary), rounded to 6; null when it is null or empty.

    Arrow-batched: counting symbols inside a row has no built-in short of one row per byte.
    """

    def one(v: str | bytes | None) -> float | None:
        if not v:
            return None
        n = np.bincount(np.frombuffer(v if isinstance(v, bytes) else v.encode("utf-8", "replace"), np.uint8))
        p = n[n > 0] / n.sum()
        return round(float(-(p * np.log2(p)).sum()), 6) + 0.0

    return pd.Series([one(v) for v in values], dtype="float64")


def job_key(*cols: Column) -> Column:
    """24 hex digits that identify the values of the columns."""
    return F.substring(F.sha2(F.to_json(F.struct(*cols)), 256), 1, 24)
