"""Functions of rendered source texts: annotations, line ranges, edits that keep track of lines, symbol names."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

MARK = "link:"
_COMMENT = re.compile(rf"(?: /\* {MARK} (?:(?!\*/).)*\*/)+$")
_IL_START = re.compile(r"^\s*\.method\b.*?/\*\s*(?:0x)?([0-9A-Fa-f]{8})\s*\*/")
_IL_END = re.compile(r"^\s*\}\s*//\s*end of method\b")
_DECLARED = re.compile(r"^ {4}(?:[\w@<>\[\].,? ]+ )?(?P<name>[\w$]+)\((?P<params>[^;{]*)\)[^;{]*(?P<end>[;{])\s*$")
RANGES = ArrayType(StructType([StructField("token", LongType()), StructField("first", IntegerType()), StructField("last", IntegerType())]))


def annotated(source: Column, name: Column, address_hex: Column) -> Column:
    """The source with a comment of its routine's name and address behind the first brace, or before it where there is none."""
    at = F.instr(source, F.lit("{"))
    note = F.concat(F.lit("/* "), name, F.lit(" @ "), address_hex)
    return F.when(at == 0, F.concat(note, F.lit(" */\n"), source)).otherwise(F.concat(F.substring(source, F.lit(1), at), F.lit("\n    "), note, F.lit("; recovered address annotation. */\n"), F.substring(source, at + 1, F.length(source))))


def symbol_name(mangled: str | None) -> str | None:
    """``Class::method`` of a mangled C++ name of a simple shape: nested or plain names without templates, substitutions or operators; else None."""
    m = re.match(r"_*Z(N?)([rVKRO]*)(St)?", mangled or "")
    if not m:
        return None
    nested, i = bool(m[1]), m.end()
    parts = ["std"] if m[3] else []
    if not nested and (m[2] or m[3]):
        return None
    while i < len(mangled):
        if d := re.compile(r"\d+").match(mangled, i):
            size = int(d[0])
            parts.append(mangled[d.end() : d.end() + size])
            i = d.end() + size
            if not nested:
                break
        elif nested and mangled[i] in "CD" and mangled[i + 1 : i + 2].isdigit() and parts:
            parts.append("~" * (mangled[i] == "D") + parts[-1])
            i += 2
        elif nested and mangled[i] == "E":
            break
        else:
            return None
    if not parts or nested and (i >= len(mangled) or mangled[i] != "E"):
        return None
    return "::".join(parts[-2:]) if len(parts) > 1 else parts[0] if len(parts[0]) > 3 else None


@F.pandas_udf(StringType())
def symbol_names(names: pd.Series) -> pd.Series:
    return pd.Series([symbol_name(n) for n in names], dtype=object)


def il_ranges(text: str | None) -> list[dict[str, int]]:
    """Line ranges of the methods of a disassembly, by the token in the comment of each ``.method`` line."""
    out, begun = [], None
    for k, line in enumerate((text or "").split("\n"), 1):
        if m := _IL_START.match(line):
            begun = (int(m[1], 16), k)
        elif begun and _IL_END.match(line):
            out.append({"token": begun[0], "first": begun[1], "last": k})
            begun = None
    return out


@F.pandas_udf(RANGES)
def il_method_ranges(texts: pd.Series) -> pd.Series:
    return pd.Series([il_ranges(t) for t in texts], dtype=object)


def arity(params: str) -> int:
    """Number of parameters of a declaration; commas inside brackets don't count."""
    flat = params
    while (inner := re.sub(r"<[^<>]*>|\([^()]*\)|\[[^\[\]]*\]", "", flat)) != flat:
        flat = inner
    return flat.count(",") + 1 if flat.strip() else 0


def java_ranges(text: str, methods: list[tuple[int, str, int]]) -> dict[int, tuple[int, int]]:
    """Lines of each method (id, name, number of parameters) in a class's text: declarations are matched by name, overloads by their number of
    parameters, then in order; annotations above belong to the method; a body ends at the line that closes its brace."""
    lines = text.split("\n")
    open_ = list(methods)
    out: dict[int, tuple[int, int]] = {}
    for k, line in enumerate(lines):
        m = _DECLARED.match(line)
        fits = [x for x in open_ if m and x[1] == m["name"]]
        if not fits:
            continue
        chosen = next((x for x in fits if x[2] == arity(m["params"])), fits[0])
        open_.remove(chosen)
        first, last = k, k
        while first and lines[first - 1].startswith("    @"):
            first -= 1
        if m["end"] == "{":
            last = next((j for j in range(k + 1, len(lines)) if lines[j].startswith("    }")), len(lines) - 1)
        out[chosen[0]] = (first + 1, last + 1)
    return out


def edited(text: str, ranges: dict[int, tuple[int, int]], renames: dict[int, list[tuple[str, str]]], comments: dict[int, str]) -> tuple[str, dict[int, tuple[int, int]]]:
    """(text, ranges) after whole-word renames inside the lines of their method and comments put before its first line; ranges move along."""
    lines = text.split("\n")
    for token, pairs in renames.items():
        first, last = ranges.get(token, (1, 0))
        for k in range(first - 1, min(last, len(lines))):
            for old, new in pairs:
                lines[k] = re.sub(rf"\b{re.escape(old)}\b", lambda _, new=new: new, lines[k])
    put: dict[int, list[str]] = {}
    for token in sorted(t for t in comments if t in ranges):
        at = ranges[token][0]
        indent = re.match(r"\s*", lines[at - 1])[0] if at <= len(lines) else ""
        put.setdefault(at, []).extend(f"{indent}// {x}" for x in comments[token].split("\n"))
    out: list[str] = []
    shift = [0] * (len(lines) + 2)
    for k, line in enumerate(lines, 1):
        out += put.get(k, [])
        shift[k] = len(out) + 1 - k
        out.append(line)
    own = {t: len(comments[t].split("\n")) for t in comments}
    return "\n".join(out), {t: (a + shift[min(a, len(lines))] - own.get(t, 0), b + shift[min(b, len(lines))]) for t, (a, b) in ranges.items()}


def strip_notes(line: str) -> str:
    return _COMMENT.sub("", line)


def noted(text: str, notes: list[tuple[int, int, str, str]], most: int = 3) -> str:
    """Text with notes (first line, last line, token, note) as comments at the ends of the lines that hold the token in code, at most ``most`` a line.

    Earlier notes are taken off first, so doing it again changes nothing; the number of lines stays; strings and comments hold no tokens.
    """
    lines = [strip_notes(x) for x in text.split("\n")]
    code, inside = [], False
    for x in lines:
        y = re.sub(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'', '""', x)
        if inside:
            head, end, y = y.partition("*/")
            inside = not end
            y = y if end else ""
        y = re.sub(r"/\*.*?\*/|//.*", " ", y)
        if "/*" in y:
            y, inside = y.split("/*", 1)[0], True
        code.append(y)
    put: dict[int, list[str]] = {}
    for first, last, token, note in notes:
        word = re.compile(rf"(?<!\w){re.escape(token)}(?!\w)")
        for k in range(max(first, 1) - 1, min(last, len(lines))):
            if word.search(code[k]) and note not in put.setdefault(k, []):
                put[k].append(note)
    for k, xs in put.items():
        more = [f"{len(xs) - most} more"] if len(xs) > most else []
        lines[k] += "".join(f" /* {MARK} {x.replace('*/', '* /')} */" for x in xs[:most] + more)
    return "\n".join(lines)
