"""Managed assemblies and Android code: metadata, method bodies, references, bundles and manifests, read from the public specifications.

``assembly`` reads the metadata tables of ECMA-335 by their column layouts, which are given below as text; ``il_tokens`` and ``dex_references`` walk
instructions by their lengths. Readers raise ValueError on damage; ``rows`` turns files into rows with notes, so one bad file never ends a job.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from lodestrata.sources.formats import uleb

#: Columns of each metadata table. 2 and 4 are numbers of so many bytes; s, g and b places in the heaps; #n a row of table n; names are
#: coded places, whose tables follow.
TABLES = """
00 2 s g g g|01 ResolutionScope s s|02 4 s s TypeDefOrRef #04 #06|03 #04|04 2 s b|05 #06|06 4 2 2 s b #08|07 #08|08 2 2 s|09 #02 TypeDefOrRef|0A MemberRefParent s b|0B 2 HasConstant b|0C HasCustomAttribute CustomAttributeType b|0D HasFieldMarshal b|0E 2 HasDeclSecurity b
0F 2 4 #02|10 4 #04|11 b|12 #02 #14|13 #14|14 2 s TypeDefOrRef|15 #02 #17|16 #17|17 2 s b|18 2 #06 HasSemantics|19 #02 MethodDefOrRef MethodDefOrRef|1A s|1B b|1C 2 MemberForwarded s #1A|1D 4 #04|1E 4 4|1F 4|20 4 2 2 2 2 4 b s s|21 4|22 4 4 4
23 2 2 2 2 4 b s s b|24 4 #23|25 4 4 4 #23|26 4 s b|27 4 4 s s Implementation|28 4 4 s Implementation|29 #02 #02|2A 2 2 TypeOrMethodDef s|2B MethodDefOrRef b|2C #2A TypeDefOrRef
"""
CODED = {
    "TypeDefOrRef": "02 01 1B", "HasConstant": "04 08 17", "HasCustomAttribute": "06 04 01 02 08 09 0A 00 0E 17 14 11 1A 1B 20 23 26 27 28 2A 2C 2B", "HasFieldMarshal": "04 08", "HasDeclSecurity": "02 06 20", "MemberRefParent": "02 01 1A 06 1B", "HasSemantics": "14 17",
    "MethodDefOrRef": "06 0A", "MemberForwarded": "04 06", "Implementation": "26 23 27", "CustomAttributeType": "3F 3F 06 0A 3F", "ResolutionScope": "00 1A 23 01", "TypeOrMethodDef": "02 06",
}
_LAYOUT = {int(x.split()[0], 16): x.split()[1:] for x in TABLES.replace("\n", "|").split("|") if x.strip()}
_CODED = {k: [int(x, 16) for x in v.split()] for k, v in CODED.items()}
#: Instructions of CIL by the size of their operand (fixed values): opcode ranges, first-last in hexadecimal; behind FE those of two bytes.
IL_SIZES = {1: "0E-13 1F-1F 2B-37 DE-DE", 4: "20-20 22-22 38-44 DD-DD", 8: "21-21 23-23"}
IL_TOKENS = {"string": "72-72", "call": "27-28 6F-6F 73-73", "signature": "29-29", "field": "7B-80", "type": "70-71 74-75 79-79 81-81 8C-8D 8F-8F A3-A5 C2-C2 C6-C6", "token": "D0-D0"}
IL_INVALID = "24-24 77-78 A6-B2 BB-C1 C4-C5 C7-CF E1-FD FF-FF"
IL_TWO = {"token": "06-07 15-16 1C-1C", 2: "09-0E", 1: "12-12 19-19"}
IL_TWO_INVALID = "08-08 10-10 1B-1B 1F-FF"
BUNDLE_MARK = hashlib.sha256(b".net core bundle").digest()
#: Dalvik instructions by their length in units of two bytes and by what their second unit refers to (fixed values).
DEX_LENGTHS = {2: "02-02 05-05 08-08 13-13 15-16 19-1A 1C-1C 1F-20 22-23 29-29 2D-3D 44-6D 90-AF D0-E2 FE-FF", 3: "03-03 06-06 09-09 14-14 17-17 1B-1B 24-26 2A-2C 6E-72 74-78 FC-FD", 4: "FA-FB", 5: "18-18"}
DEX_KINDS = {"string": "1A-1B", "type": "1C-1C 1F-20 22-25", "field": "52-6D", "method": "6E-72 74-78 FA-FB"}


def _ranges(text: str) -> set[int]:
    return {k for r in text.split() for k in range(int(r[:2], 16), int(r[3:], 16) + 1)}


def _by_opcode(table: dict[Any, str]) -> dict[int, Any]:
    return {k: v for v, text in table.items() for k in _ranges(text)}


_IL_SIZE, _IL_TOKEN, _IL_BAD, _IL_TWO, _IL_TWO_BAD = _by_opcode(IL_SIZES), _by_opcode(IL_TOKENS), _ranges(IL_INVALID), _by_opcode(IL_TWO), _ranges(IL_TWO_INVALID)
_DEX_LENGTH, _DEX_KIND = _by_opcode(DEX_LENGTHS), _by_opcode(DEX_KINDS)


class Image:
    """A PE file with a CLR header."""

    def __init__(self, data: bytes):
        self.data = data
        pe = struct.unpack_from("<I", data, 0x3C)[0]
        if data[:2] != b"MZ" or data[pe : pe + 4] != b"PE\0\0":
            raise ValueError("no PE file")
        sections, optional = struct.unpack_from("<H", data, pe + 6)[0], struct.unpack_from("<H", data, pe + 20)[0]
        opt = pe + 24
        plus = struct.unpack_from("<H", data, opt)[0] == 0x20B
        self.sections = [struct.unpack_from("<4I", data, opt + optional + 40 * k + 8) for k in range(sections)]
        rva, size = struct.unpack_from("<II", data, opt + (112 if plus else 96) + 8 * 14)
        if not rva:
            raise ValueError("no CLR header")
        at = self.place(rva)
        self.runtime = struct.unpack_from("<HH", data, at + 4)
        meta, meta_size = struct.unpack_from("<II", data, at + 8)
        self.flags, self.entry_point = struct.unpack_from("<II", data, at + 16)
        native = struct.unpack_from("<II", data, at + 64) if size >= 72 else (0, 0)
        self.il_only, self.ready_to_run = bool(self.flags & 1), bool(native[0])
        self.metadata = data[self.place(meta) : self.place(meta) + meta_size]
        if self.metadata[:4] != b"BSJB":
            raise ValueError("no metadata")
        n = struct.unpack_from("<I", self.metadata, 12)[0]
        self.version = self.metadata[16 : 16 + n].rstrip(b"\0").decode()
        self.streams: dict[str, bytes] = {}
        i = 20 + n
        for _ in range(struct.unpack_from("<H", self.metadata, 18 + n)[0]):
            start, length = struct.unpack_from("<II", self.metadata, i)
            end = self.metadata.index(b"\0", i + 8)
            self.streams[self.metadata[i + 8 : end].decode()] = self.metadata[start : start + length]
            i = i + 8 + (end - i - 8 + 4) // 4 * 4

    def place(self, rva: int) -> int:
        for vs, va, rs, raw in self.sections:
            if va <= rva < va + max(vs, rs):
                return raw + rva - va
        raise ValueError(f"address {rva:#x} isn't in a section")


class Metadata:
    """Rows of the metadata tables."""

    def __init__(self, image: Image):
        self.strings, self.blobs = image.streams.get("#Strings", b""), image.streams.get("#Blob", b"")
        t = image.streams.get("#~") or image.streams.get("#-") or b""
        wide, valid = t[6], struct.unpack_from("<Q", t, 8)[0]
        present = [k for k in range(64) if valid >> k & 1]
        self.count = dict(zip(present, struct.unpack_from(f"<{len(present)}I", t, 24), strict=True))
        heap = {"s": 4 if wide & 1 else 2, "g": 4 if wide & 2 else 2, "b": 4 if wide & 4 else 2}

        def size(c: str) -> int:
            if c in "24":
                return int(c)
            if c in heap:
                return heap[c]
            if c[0] == "#":
                return 4 if self.count.get(int(c[1:], 16), 0) > 0xFFFF else 2
            tables = _CODED[c]
            return 4 if max(self.count.get(x, 0) for x in tables) >> 16 - (len(tables) - 1).bit_length() else 2

        self.rows: dict[int, list[tuple[int, ...]]] = {}
        i = 24 + 4 * len(present)
        for k in present:
            if k not in _LAYOUT:
                raise ValueError(f"table {k:#x}")
            form = struct.Struct("<" + "".join("H" if size(c) == 2 else "I" for c in _LAYOUT[k]))
            self.rows[k] = [form.unpack_from(t, i + j * form.size) for j in range(self.count[k])]
            i += form.size * self.count[k]

    def text(self, at: int) -> str:
        return self.strings[at : self.strings.index(b"\0", at)].decode("utf-8", "replace")

    def coded(self, kind: str, value: int) -> tuple[int, int]:
        """(table, row) of a coded place."""
        bits = (len(_CODED[kind]) - 1).bit_length()
        return _CODED[kind][value & (1 << bits) - 1], value >> bits

    def table(self, k: int) -> list[tuple[int, ...]]:
        return self.rows.get(k, [])

    def type_name(self, table: int, row: int) -> str:
        if table not in (1, 2) or not row:
            return ""
        r = self.table(table)[row - 1]
        name, space = (r[1], r[2]) if table == 1 else (r[1], r[2])
        return ".".join(x for x in (self.text(space), self.text(name)) if x)


def method_body(data: bytes, at: int) -> bytes:
    """Instructions of a method: behind a tiny header of one byte, or a fat one that gives its own length."""
    if data[at] & 3 == 2:
        return data[at + 1 : at + 1 + (data[at] >> 2)]
    if data[at] & 3 != 3:
        raise ValueError("no method header")
    flags, _, size = struct.unpack_from("<HHI", data, at)
    start = at + (flags >> 12) * 4
    return data[start : start + size]


def il_tokens(code: bytes) -> list[tuple[str, int]]:
    """(kind, token) in order; ends at an instruction that doesn't exist or is cut off."""
    out, i = [], 0
    while i < len(code):
        op, i = code[i], i + 1
        if op == 0xFE:
            if i >= len(code) or code[i] in _IL_TWO_BAD:
                break
            what, i = _IL_TWO.get(code[i], 0), i + 1
        elif op in _IL_BAD:
            break
        elif op == 0x45:
            if i + 4 > len(code):
                break
            i += 4 + 4 * struct.unpack_from("<I", code, i)[0]
            continue
        else:
            what = _IL_TOKEN.get(op) or _IL_SIZE.get(op, 0)
        size = 4 if isinstance(what, str) else what
        if i + size > len(code):
            break
        if isinstance(what, str):
            out.append((what, struct.unpack_from("<I", code, i)[0]))
        i += size
    return out


def assembly(data: bytes) -> dict[str, Any]:
    """Name, references, types, methods, member references and who refers to what of a managed assembly."""
    image = Image(data)
    m = Metadata(image)
    out: dict[str, Any] = {"runtime": image.version, "il_only": image.il_only, "ready_to_run": image.ready_to_run, "entry_point": image.entry_point or None, "name": None, "version": None}
    if m.table(0x20):
        r = m.table(0x20)[0]
        out |= {"name": m.text(r[7]), "version": ".".join(map(str, r[1:5]))}
    out["references"] = [(m.text(r[6]), ".".join(map(str, r[:4]))) for r in m.table(0x23)]
    out["modules"] = [m.text(r[0]) for r in m.table(0x1A)]
    nested = {a: b for a, b in m.table(0x29)}
    types = m.table(2)
    out["types"] = [(0x02000001 + k, m.text(r[2]), m.text(r[1]), 0x02000000 + nested[k + 1] if k + 1 in nested else None) for k, r in enumerate(types)]
    owner: dict[int, int] = {}
    for k, r in enumerate(types):
        stop = types[k + 1][5] if k + 1 < len(types) else len(m.table(6)) + 1
        owner.update(dict.fromkeys(range(r[5], stop), 0x02000001 + k))
    out["methods"] = [(0x06000001 + k, owner.get(k + 1), m.text(r[3]), r[2]) for k, r in enumerate(m.table(6))]
    out["members"] = []
    for k, (parent, name, _) in enumerate(m.table(0x0A)):
        table, row = m.coded("MemberRefParent", parent)
        out["members"].append((0x0A000001 + k, m.type_name(table, row), m.text(name)))
    out["pinvokes"] = [(0x06000000 + m.coded("MemberForwarded", f)[1], m.text(n), out["modules"][s - 1] if 0 < s <= len(out["modules"]) else None) for _, f, n, s in m.table(0x1C)]
    out["uses"] = []
    for k, r in enumerate(m.table(6)):
        if r[0]:
            try:
                out["uses"] += [(0x06000001 + k, kind, token) for kind, token in il_tokens(method_body(data, image.place(r[0])))]
            except (ValueError, IndexError, struct.error):
                continue  # a method without a readable body uses nothing
    return out


def bundle(data: bytes) -> list[tuple[str, int, int, int, int]]:
    """(path, kind, offset, size, compressed size) of the files of a single-file program; empty if it is none."""
    at = data.find(BUNDLE_MARK)
    if at < 8:
        return []
    i = struct.unpack_from("<q", data, at - 8)[0]
    if not 0 < i < len(data):
        return []
    major, _, count = struct.unpack_from("<IIi", data, i)

    def text(i: int) -> tuple[str, int]:
        n, i = uleb(data, i)
        return data[i : i + n].decode("utf-8", "replace"), i + n

    _, i = text(i + 12)
    i += 40 if major >= 2 else 0
    out = []
    for _ in range(count):
        offset, size = struct.unpack_from("<qq", data, i)
        i += 16
        packed = 0
        if major >= 6:
            packed, i = struct.unpack_from("<q", data, i)[0], i + 8
        kind = data[i]
        path, i = text(i + 1)
        out.append((path, kind, offset, size, packed))
    return out


def dex_references(code: bytes) -> list[tuple[str, int]]:
    """(kind, index) in order of the strings, types, fields and methods that instructions name; ends at a payload or a cut."""
    out, i = [], 0
    while i + 2 <= len(code):
        op = code[i]
        if op == 0 and code[i + 1]:
            break  # tables of switches and arrays
        length = 2 * _DEX_LENGTH.get(op, 1)
        if i + length > len(code):
            break
        if op in _DEX_KIND:
            out.append((_DEX_KIND[op], struct.unpack_from("<I" if op == 0x1B else "<H", code, i + 2)[0]))
        i += length
    return out


class Dex:
    """Strings, types, methods and classes of a DEX file."""

    def __init__(self, data: bytes):
        if data[:4] != b"dex\n":
            raise ValueError("no DEX file")
        self.data = data
        head = struct.unpack_from("<14I", data, 0x38)
        (ns, s), (nt, t), (np_, p), (_, _), (nm, m), (nc, c) = zip(head[0:12:2], head[1:12:2], strict=True)
        self.strings = [self._text(x) for x in struct.unpack_from(f"<{ns}I", data, s)]
        self.types = [self.strings[x] for x in struct.unpack_from(f"<{nt}I", data, t)]
        protos = [struct.unpack_from("<3I", data, p + 12 * k) for k in range(np_)]
        self.protos = ["(" + "".join(self._types(x)) + ")" + self.types[r] for _, r, x in protos]
        self.methods = [(self.types[a], self.strings[n], self.protos[q]) for a, q, n in (struct.unpack_from("<HHI", data, m + 8 * k) for k in range(nm))]
        self.classes = [struct.unpack_from("<8I", data, c + 32 * k) for k in range(nc)]

    def _text(self, at: int) -> str:
        _, i = uleb(self.data, at)
        return self.data[i : self.data.index(b"\0", i)].replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass")

    def _types(self, at: int) -> list[str]:
        return [self.types[x] for x in struct.unpack_from(f"<{struct.unpack_from('<I', self.data, at)[0]}H", self.data, at + 4)] if at else []

    def code(self) -> Iterator[tuple[int, str, bool, bytes]]:
        """(method index, class, direct, instructions) of each method that a class defines, in order."""
        for cls, _, _, _, _, _, at, _ in self.classes:
            if not at:
                continue
            counts, i = [], at
            for _ in range(4):
                n, i = uleb(self.data, i)
                counts.append(n)
            for _ in range(2 * (counts[0] + counts[1])):
                _, i = uleb(self.data, i)
            for direct, n in ((True, counts[2]), (False, counts[3])):
                index = 0
                for _ in range(n):
                    step, i = uleb(self.data, i)
                    _, i = uleb(self.data, i)
                    place, i = uleb(self.data, i)
                    index += step
                    units = struct.unpack_from("<I", self.data, place + 12)[0] if place else 0
                    yield index, self.types[cls], direct, self.data[place + 16 : place + 16 + 2 * units] if place else b""

    def inventory(self) -> list[tuple[int, str, str, str, list[tuple[str, int]]]]:
        """(running id, class, name, descriptor, references) of each method."""
        return [(k, cls, self.methods[index][1], self.methods[index][2], list(dict.fromkeys(dex_references(code)))) for k, (index, cls, _, code) in enumerate(self.code())]


ANDROID = "{http://schemas.android.com/apk/res/android}"


def manifest(text: str) -> dict[str, Any]:
    """Package, version, SDK levels, permissions and components of a manifest in XML; damage ends up in ``parse_error``."""
    out: dict[str, Any] = {"package": None, "version_name": None, "version_code": None, "min_sdk": None, "target_sdk": None, "permissions": [], "components": [], "parse_error": None}
    try:
        root = ElementTree.fromstring(text)
    except (ElementTree.ParseError, ValueError) as e:
        return out | {"parse_error": str(e)}
    get = lambda e, name: e.get(ANDROID + name)
    out |= {"package": root.get("package"), "version_name": get(root, "versionName"), "version_code": get(root, "versionCode")}
    for sdk in root.iter("uses-sdk"):
        out |= {"min_sdk": get(sdk, "minSdkVersion"), "target_sdk": get(sdk, "targetSdkVersion")}
    out["permissions"] = sorted({get(p, "name") for p in root.iter("uses-permission") if get(p, "name")})
    for kind in ("application", "activity", "activity-alias", "service", "receiver", "provider"):
        for e in root.iter(kind):
            if get(e, "name"):
                told = get(e, "exported")
                out["components"].append((kind, get(e, "name"), told == "true" if told else e.find("intent-filter") is not None, get(e, "permission")))
    return out


def apk_members(names: list[str]) -> list[str]:
    """Top-level packages of a bundle: the base first, then others, then configuration splits, each by name."""
    rank = lambda n: 0 if n == "base.apk" else 2 if n.startswith("split_config.") else 1
    return sorted((n for n in names if n.lower().endswith(".apk") and "/" not in n), key=lambda n: (rank(n), n))


def input_kind(name: str, data: bytes) -> str | None:
    """nupkg, assembly, mixed (managed and native code), bundle or None: the first that a file is."""
    if name.lower().endswith(".nupkg"):
        return "nupkg"
    try:
        return "assembly" if Image(data).il_only else "mixed"
    except (ValueError, IndexError, struct.error):
        return "bundle" if bundle(data) else None


ROWS = "path string, name string, version string, entry_point bigint, types array<struct<token:bigint,namespace:string,name:string,declaring:bigint>>, methods array<struct<token:bigint,type:bigint,name:string,flags:int>>, members array<struct<token:bigint,owner:string,name:string>>, uses array<struct<method:bigint,kind:string,token:bigint>>, notes array<string>"


def rows(files: DataFrame) -> DataFrame:
    """One row per file (path, content) that is a managed assembly, or looks like one and can't be read (then with a note)."""
    names = {"types": ("token", "namespace", "name", "declaring"), "methods": ("token", "type", "name", "flags"), "members": ("token", "owner", "name"), "uses": ("method", "kind", "token")}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, data in zip(b["path"], b["content"], strict=True):
                row = {"path": path, "name": None, "version": None, "entry_point": None, **{k: [] for k in names}, "notes": []}
                try:
                    a = assembly(data)
                    row |= {"name": a["name"], "version": a["version"], "entry_point": a["entry_point"], **{k: [dict(zip(cols, x, strict=True)) for x in a[k]] for k, cols in names.items()}}
                except (ValueError, IndexError, struct.error) as e:
                    if b"BSJB" not in (data or b""):
                        continue
                    row["notes"] = [f"{type(e).__name__}: {e}"]
                out.append(row)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")]).astype({"entry_point": "Int64"})

    return files.select("path", "content").mapInPandas(read, ROWS)
