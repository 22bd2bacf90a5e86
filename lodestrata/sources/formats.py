"""Link facts of ELF, PE and Mach-O images, read from the public format specifications.

Every parser gives one dict per image: format, arch, bits, identity, libraries [(name, kind)], rpaths, runpaths, imports [(name, library, ordinal,
version, weak)], exports [(name, address, ordinal, forwarder, weak)], versions [(name, version, default)] of ELF exports and notes. Damage ends up in ``notes``; nothing is raised.
"""

from __future__ import annotations

import struct
import zipfile
from io import BytesIO
from typing import Any

#: Fixed values of the formats.
ELF_MACHINES = {3: "x86", 40: "arm", 62: "x86_64", 183: "arm64", 8: "mips", 20: "ppc", 21: "ppc64", 243: "riscv"}
PE_MACHINES = {0x14C: "x86", 0x8664: "x86_64", 0x1C0: "arm", 0x1C4: "arm", 0xAA64: "arm64"}
MACHO_CPUS = {7: "x86", 0x01000007: "x86_64", 12: "arm", 0x0100000C: "arm64", 18: "ppc", 0x01000012: "ppc64"}
DT = {"NEEDED": 1, "STRTAB": 5, "SYMTAB": 6, "STRSZ": 10, "SONAME": 14, "RPATH": 15, "RUNPATH": 29, "HASH": 4, "GNU_HASH": 0x6FFFFEF5, "VERSYM": 0x6FFFFFF0, "VERNEED": 0x6FFFFFFE, "VERNEEDNUM": 0x6FFFFFFF, "VERDEF": 0x6FFFFFFC, "VERDEFNUM": 0x6FFFFFFD}
DYLIB_KINDS = {0xC: "needed", 0x80000018: "weak", 0x8000001F: "reexport", 0x20: "lazy", 0x80000023: "upward"}
MOST_SYMBOLS, MOST_MACHO_SYMBOLS = 2_000_000, 4_000_000


def classify(head: bytes) -> str:
    """elf, pe, macho, macho_fat, java_class, zip or data, from the first bytes of a file."""
    if head[:4] == b"\x7fELF":
        return "elf"
    if head[:4] in (b"\xfe\xed\xfa\xce", b"\xce\xfa\xed\xfe", b"\xfe\xed\xfa\xcf", b"\xcf\xfa\xed\xfe"):
        return "macho"
    if head[:4] in (b"\xca\xfe\xba\xbe", b"\xca\xfe\xba\xbf") and len(head) >= 8:
        n = struct.unpack_from(">I", head, 4)[0]  # a Java class has its version here, which is above 30
        first = struct.unpack_from(">I", head, 8)[0] if len(head) >= 12 else 0
        return "macho_fat" if 0 < n <= 30 and first in MACHO_CPUS else "java_class"
    if head[:2] == b"MZ":
        at = struct.unpack_from("<I", head, 0x3C)[0] if len(head) >= 0x40 else 0
        return "pe" if head[at : at + 4] == b"PE\0\0" else "data"
    return "zip" if head[:4] in (b"PK\x03\x04", b"PK\x05\x06") else "data"


def zip_flavour(data: bytes, name: str = "") -> str:
    """apk, jar, nupkg or zip, by suffix or else by what the archive holds."""
    low = name.lower()
    for suffix, kind in ((".apk", "apk"), (".xapk", "apk_set"), (".apks", "apk_set"), (".jar", "jar"), (".nupkg", "nupkg")):
        if low.endswith(suffix):
            return kind
    try:
        names = zipfile.ZipFile(BytesIO(data)).namelist()
    except (zipfile.BadZipFile, OSError, ValueError):
        return "zip"
    return "apk" if "AndroidManifest.xml" in names else "jar" if "META-INF/MANIFEST.MF" in names else "zip"


def facts(fmt: str) -> dict[str, Any]:
    return {"format": fmt, "arch": None, "bits": None, "kind": None, "image_base": None, "identity": None, "libraries": [], "rpaths": [], "runpaths": [], "imports": [], "exports": [], "versions": [], "notes": []}


def text_at(data: bytes, at: int) -> str:
    if not 0 <= at < len(data):
        raise ValueError("string outside of the file")
    end = data.find(b"\0", at)
    return data[at : end if end >= 0 else len(data)].decode("utf-8", "replace")


def parse_elf(data: bytes) -> dict[str, Any]:
    out = facts("elf")
    wide, order = data[4] == 2, "<" if data[5] == 1 else ">"
    kind, machine = struct.unpack_from(order + "HH", data, 16)
    out |= {"bits": 64 if wide else 32, "arch": ELF_MACHINES.get(machine, f"machine_{machine}")}
    phoff = struct.unpack_from(order + ("Q" if wide else "I"), data, 32 if wide else 28)[0]
    phsize, phnum = struct.unpack_from(order + "HH", data, 54 if wide else 42)
    loads, dynamic, interp = [], None, False
    for k in range(phnum):
        if wide:
            p, _, off, va, _, fs, _, _ = struct.unpack_from(order + "IIQQQQQQ", data, phoff + k * phsize)
        else:
            p, off, va, _, fs, _, _, _ = struct.unpack_from(order + "8I", data, phoff + k * phsize)
        if p == 1:
            loads.append((va, off, fs))
        elif p == 2:
            dynamic = (off, fs)
        interp |= p == 3
    out["image_base"] = min((va for va, _, _ in loads), default=0)
    out["kind"] = "executable" if kind == 2 or kind == 3 and interp else "library" if kind == 3 else "object"
    if dynamic is None:
        return out

    def place(va: int) -> int:
        for v, o, n in loads:
            if v <= va < v + n:
                return o + va - v
        raise ValueError(f"address {va:#x} isn't in the file")

    tags: dict[int, list[int]] = {}
    size = 16 if wide else 8
    for k in range(dynamic[1] // size):
        tag, value = struct.unpack_from(order + ("qQ" if wide else "iI"), data, dynamic[0] + k * size)
        if tag == 0:
            break
        tags.setdefault(tag & 0xFFFFFFFF, []).append(value)
    one = lambda name: tags.get(DT[name], [None])[0]
    if one("STRTAB") is None:
        return out
    strings = place(one("STRTAB"))
    text = lambda at: text_at(data, strings + at)
    out["libraries"] = [(text(v), "needed") for v in tags.get(DT["NEEDED"], [])]
    out["identity"] = text(one("SONAME")) if one("SONAME") is not None else None
    for name, field in (("RPATH", "rpaths"), ("RUNPATH", "runpaths")):
        out[field] = [p for v in tags.get(DT[name], []) for p in text(v).split(":") if p]
    try:
        _elf_symbols(data, out, one, place, text, strings, wide, order, machine)
    except (struct.error, ValueError, IndexError) as e:
        out["notes"].append(f"symbols: {e}")
    return out


def _elf_symbols(data: bytes, out: dict[str, Any], one, place, text, strings: int, wide: bool, order: str, machine: int) -> None:
    """Imports and exports of the dynamic symbol table, with the versions that it needs and defines."""
    if one("SYMTAB") is None:
        return
    symbols, step = place(one("SYMTAB")), 24 if wide else 16
    if one("HASH") is not None:
        n = struct.unpack_from(order + "I", data, place(one("HASH")) + 4)[0]
    elif one("GNU_HASH") is not None:
        n = _gnu_count(data, place(one("GNU_HASH")), wide, order)
    else:
        n = max(0, (strings - symbols) // step)
    versions: dict[int, str] = {}
    owners: dict[int, str] = {}
    at = place(one("VERNEED")) if one("VERNEED") is not None else None
    for _ in range(one("VERNEEDNUM") or 0):
        _, count, file, aux, nxt = struct.unpack_from(order + "HHIII", data, at)
        a = at + aux
        for _ in range(count):
            _, _, other, name, step_a = struct.unpack_from(order + "IHHII", data, a)
            versions[other & 0x7FFF], owners[other & 0x7FFF] = text(name), text(file)
            a += step_a
        at += nxt
    at = place(one("VERDEF")) if one("VERDEF") is not None else None
    for _ in range(one("VERDEFNUM") or 0):
        _, flags, index, _, _, aux, nxt = struct.unpack_from(order + "HHHHIII", data, at)
        if not flags & 1:  # the first names the file itself
            versions[index & 0x7FFF] = text(struct.unpack_from(order + "I", data, at + aux)[0])
        at += nxt
    versym = place(one("VERSYM")) if one("VERSYM") is not None else None
    if n > MOST_SYMBOLS:
        out["notes"].append(f"{n} symbols, the first {MOST_SYMBOLS} were read")
    for k in range(1, min(n, MOST_SYMBOLS)):
        if wide:
            name, info, other, shndx, value, _ = struct.unpack_from(order + "IBBHQQ", data, symbols + k * step)
        else:
            name, value, _, info, other, shndx = struct.unpack_from(order + "IIIBBH", data, symbols + k * step)
        bind, hidden = info >> 4, other & 3 in (1, 2)
        if not name or bind not in (1, 2, 10):
            continue
        raw = struct.unpack_from(order + "H", data, versym + 2 * k)[0] if versym is not None else 0
        v = raw & 0x7FFF
        if shndx == 0:
            out["imports"].append((text(name), owners.get(v), None, versions.get(v), bind == 2))
        elif not hidden:
            thumb = 1 if machine == 40 and info & 15 == 2 else 0
            out["exports"].append((text(name), value & ~thumb, None, None, bind == 2))
            if versions.get(v):
                out["versions"].append((text(name), versions[v], not raw & 0x8000))


def _gnu_count(data: bytes, at: int, wide: bool, order: str) -> int:
    """Symbols that a GNU hash table covers: the end of the chain of its greatest bucket."""
    buckets, first, bloom, _ = struct.unpack_from(order + "4I", data, at)
    at += 16 + bloom * (8 if wide else 4)
    last = max(struct.unpack_from(f"{order}{buckets}I", data, at), default=0)
    if last < first:
        return first
    chain = at + 4 * buckets
    while not struct.unpack_from(order + "I", data, chain + 4 * (last - first))[0] & 1:
        last += 1
    return last + 1


def parse_pe(data: bytes) -> dict[str, Any]:
    out = facts("pe")
    pe = struct.unpack_from("<I", data, 0x3C)[0]
    machine, sections = struct.unpack_from("<HH", data, pe + 4)
    optional, flags = struct.unpack_from("<HH", data, pe + 20)
    opt = pe + 24
    plus = struct.unpack_from("<H", data, opt)[0] == 0x20B
    out |= {"arch": PE_MACHINES.get(machine, f"machine_{machine:#x}"), "bits": 64 if plus else 32, "kind": "library" if flags & 0x2000 else "executable", "image_base": struct.unpack_from("<Q" if plus else "<I", data, opt + (24 if plus else 28))[0]}
    dirs_at = opt + (112 if plus else 96)
    dirs = [struct.unpack_from("<II", data, dirs_at + 8 * k) for k in range(min(16, struct.unpack_from("<I", data, dirs_at - 4)[0]))]
    table = [struct.unpack_from("<4I", data, opt + optional + 40 * k + 8) for k in range(sections)]

    def place(rva: int) -> int:
        for vs, va, rs, raw in table:
            if va <= rva < va + max(vs, rs):
                return raw + rva - va
        raise ValueError(f"address {rva:#x} isn't in a section")

    names: list[str] = []

    def thunks(rva: int, dll: str) -> None:
        at, size = place(rva), 8 if plus else 4
        for k in range(1 << 20):
            v = struct.unpack_from("<Q" if plus else "<I", data, at + k * size)[0]
            if not v:
                return
            if v >> (63 if plus else 31):
                out["imports"].append((f"#{v & 0xFFFF}", dll, v & 0xFFFF, None, False))
            else:
                out["imports"].append((text_at(data, place(v & 0x7FFFFFFF) + 2), dll, None, None, False))

    def part(what: str, run) -> None:
        try:
            run()
        except (struct.error, ValueError, IndexError) as e:
            out["notes"].append(f"{what}: {e}")

    def imports() -> None:
        at = place(dirs[1][0])
        while True:
            look, _, _, name, first = struct.unpack_from("<5I", data, at)
            if not name:
                return
            names.append(text_at(data, place(name)))
            out["libraries"].append((names[-1], "needed"))
            thunks(look or first, names[-1])
            at += 20

    def delayed() -> None:
        at = place(dirs[13][0])
        while True:
            attributes, name, _, _, look = struct.unpack_from("<5I", data, at)
            if not name:
                return
            base = 0 if attributes & 1 else out["image_base"]
            names.append(text_at(data, place(name - base)))
            out["libraries"].append((names[-1], "delay"))
            thunks(look - base, names[-1])
            at += 32

    def exports() -> None:
        rva, size = dirs[0]
        at = place(rva)
        dll, base, count, named, funcs, names_at, ords = struct.unpack_from("<7I", data, at + 12)
        out["identity"] = text_at(data, place(dll)) if dll else None
        by_index: dict[int, list[str]] = {}
        for k in range(min(named, 1 << 20)):
            name, index = struct.unpack_from("<I", data, place(names_at) + 4 * k)[0], struct.unpack_from("<H", data, place(ords) + 2 * k)[0]
            by_index.setdefault(index, []).append(text_at(data, place(name)))
        for k in range(min(count, 1 << 20)):
            f = struct.unpack_from("<I", data, place(funcs) + 4 * k)[0]
            if f:
                forward = text_at(data, place(f)) if rva <= f < rva + size else None
                for name in by_index.get(k, [f"#{base + k}"]):
                    out["exports"].append((name, None if forward else out["image_base"] + f, base + k, forward, False))

    for k, what, run in ((1, "imports", imports), (13, "delay imports", delayed), (0, "exports", exports)):
        if len(dirs) > k and dirs[k][0]:
            part(what, run)
    return out


def parse_macho(data: bytes, at: int = 0) -> dict[str, Any]:
    out = facts("macho")
    order = "<" if data[at : at + 4] in (b"\xce\xfa\xed\xfe", b"\xcf\xfa\xed\xfe") else ">"
    magic, cpu, _, kind, ncmds, _, _ = struct.unpack_from(order + "7I", data, at)
    wide = magic == 0xFEEDFACF
    out |= {"arch": MACHO_CPUS.get(cpu, f"cpu_{cpu:#x}"), "bits": 64 if wide else 32, "kind": {2: "executable", 6: "library", 8: "bundle"}.get(kind, "object")}
    p, symtab, trie, base, bind, chained = at + (32 if wide else 28), None, None, 0, None, None
    for _ in range(ncmds):
        cmd, size = struct.unpack_from(order + "II", data, p)
        if size < 8:
            out["notes"].append("load command of no size")
            break
        if cmd in DYLIB_KINDS or cmd == 0xD:
            name = text_at(data, p + struct.unpack_from(order + "I", data, p + 8)[0])
            if cmd == 0xD:
                out["identity"] = name
            else:
                out["libraries"].append((name, DYLIB_KINDS[cmd]))
        elif cmd == 0x8000001C:
            out["rpaths"].append(text_at(data, p + struct.unpack_from(order + "I", data, p + 8)[0]))
        elif cmd == 0x1B and not out["identity"]:
            out["identity"] = data[p + 8 : p + 24].hex()
        elif cmd == 2:
            symtab = struct.unpack_from(order + "4I", data, p + 8)
        elif cmd in (0x22, 0x80000022):
            trie = struct.unpack_from(order + "II", data, p + 40)
            bind = struct.unpack_from(order + "II", data, p + 16), struct.unpack_from(order + "II", data, p + 32)
        elif cmd == 0x80000034:
            chained = struct.unpack_from(order + "II", data, p + 8)
        elif cmd == 0x80000033:
            trie = struct.unpack_from(order + "II", data, p + 8)
        elif cmd in (1, 0x19) and data[p + 8 : p + 24].rstrip(b"\0") == b"__TEXT":
            base = struct.unpack_from(order + ("Q" if wide else "I"), data, p + 24)[0]
        p += size
    out["image_base"] = base
    if trie and trie[1]:
        try:
            out["exports"] = export_trie(data[at + trie[0] : at + sum(trie)], base)
        except (ValueError, IndexError) as e:
            out["notes"].append(f"export trie: {e}")
    known: set[str] = set()

    def take(rows: list[tuple[str, int, bool]]) -> None:
        for name, ordinal, weak in rows:
            if name not in known:
                known.add(name)
                out["imports"].append((name, out["libraries"][ordinal - 1][0] if 0 < ordinal <= len(out["libraries"]) else None, None, None, weak))

    parts = [("chained imports", chained, lambda x: chained_imports(x, order))] + [(what, span, lambda x, lazy=lazy: bound_symbols(x, lazy)) for what, span, lazy in (("binds", bind and bind[0], False), ("lazy binds", bind and bind[1], True))]
    for what, span, read in parts:
        if span and span[1]:
            try:
                take(read(data[at + span[0] : at + sum(span)]))
            except (struct.error, ValueError, IndexError) as e:
                out["notes"].append(f"{what}: {e}")
    if symtab:
        off, n, strings, _ = symtab
        if n > MOST_MACHO_SYMBOLS:
            out["notes"].append(f"{n} symbols, the first {MOST_MACHO_SYMBOLS} were read")
        for k in range(min(n, MOST_MACHO_SYMBOLS)):
            name, kind, _, desc, value = struct.unpack_from(order + ("IBBHQ" if wide else "IBBHI"), data, at + off + k * (16 if wide else 12))
            if kind & 0xE0 or not kind & 1 or not name:  # debugging entries and local symbols
                continue
            text = text_at(data, at + strings + name)
            if kind & 0xE == 0:
                take([(text, desc >> 8, bool(desc & 0x40))])
            elif not trie or not trie[1]:
                out["exports"].append((text, value, None, None, bool(desc & 0x80)))
    return out


def uleb(data: bytes, i: int) -> tuple[int, int]:
    """(value, next place) of an unsigned LEB128 number."""
    v = shift = 0
    while True:
        b = data[i]
        v |= (b & 127) << shift
        i, shift = i + 1, shift + 7
        if b < 128:
            return v, i


def export_trie(trie: bytes, base: int, most: int = 4_000_000) -> list[tuple[str, int | None, int | None, str | None, bool]]:
    """Symbols of a prefix trie, depth first. Re-exports have no address but the ordinal of their library and the name they have there; absolute
    symbols don't move with the image. A node is read once, so a trie that leads back to itself ends."""
    out, stack, seen = [], [(0, b"")], set()
    while stack:
        at, prefix = stack.pop()
        if at in seen:
            continue
        seen.add(at)
        if len(seen) > most:
            raise ValueError("too many nodes")
        size, i = uleb(trie, at)
        if size:
            flags, j = uleb(trie, i)
            name = prefix.decode("utf-8", "replace")
            if flags & 8:
                ordinal, j = uleb(trie, j)
                out.append((name, None, ordinal, trie[j : trie.index(b"\0", j)].decode("utf-8", "replace") or name, bool(flags & 4)))
            else:
                out.append((name, uleb(trie, j)[0] + (0 if flags & 3 == 2 else base), None, None, bool(flags & 4)))
        i += size
        below = []
        for _ in range(trie[i]):
            end = trie.index(b"\0", i + 1)
            child, nxt = uleb(trie, end + 1)
            below.append((child, prefix + trie[i + 1 : end]))
            i = nxt - 1
        stack += reversed(below)
    return out


def chained_imports(data: bytes, order: str) -> list[tuple[str, int, bool]]:
    """(name, library ordinal, weak) of the import table of chained fixups; special ordinals are negative."""
    _, _, imports, symbols, count, form, packed = struct.unpack_from(order + "7I", data, 0)
    if packed:
        raise ValueError("compressed symbol names")
    out = []
    step = {1: 4, 2: 8, 3: 16}.get(form)
    if step is None:
        raise ValueError(f"import format {form}")
    for k in range(min(count, MOST_MACHO_SYMBOLS)):
        if form == 3:
            v = struct.unpack_from(order + "Q", data, imports + k * step)[0]
            ordinal, weak, name, top = v & 0xFFFF, v >> 16 & 1, v >> 32, 0x10000
        else:
            v = struct.unpack_from(order + "I", data, imports + k * step)[0]
            ordinal, weak, name, top = v & 0xFF, v >> 8 & 1, v >> 9, 0x100
        out.append((text_at(data, symbols + name), ordinal if ordinal < top - 16 else ordinal - top, bool(weak)))
    return out


def bound_symbols(code: bytes, lazy: bool = False) -> list[tuple[str, int, bool]]:
    """(name, library ordinal, weak) of each symbol that a program of bind opcodes binds, once, in order. Only the opcodes that choose a library or a
    symbol, or bind, matter; the others are skipped with their operands. Lazy programs have an end after each symbol."""
    operands = {0x2: 1, 0x6: 1, 0x7: 1, 0x8: 1, 0xA: 1, 0xC: 2}  # opcode: number of LEB128 operands
    out: dict[tuple[str, int, bool], None] = {}
    i, ordinal, name, weak = 0, 0, "", False
    while i < len(code):
        op, low = code[i] >> 4, code[i] & 15
        i += 1
        values = []
        if op == 0x4:
            end = code.index(b"\0", i)
            name, weak, i = code[i:end].decode("utf-8", "replace"), bool(low & 1), end + 1
        for _ in range(operands.get(op, 0)):
            v, i = uleb(code, i)
            values.append(v)
        if op == 0x0 and not lazy:
            break
        if op == 0x1:
            ordinal = low
        elif op == 0x2:
            ordinal = values[0]
        elif op == 0x3:
            ordinal = low - 16 if low else 0
        elif op in (0x9, 0xA, 0xB, 0xC) and name:
            out[name, ordinal, weak] = None
    return list(out)


def slices(data: bytes) -> list[int]:
    """Offsets of the images of a fat file."""
    n = struct.unpack_from(">I", data, 4)[0]
    wide = data[:4] == b"\xca\xfe\xba\xbf"
    return [struct.unpack_from(">Q" if wide else ">I", data, 8 + k * (32 if wide else 20) + 8)[0] for k in range(n)]


def link_facts(data: bytes) -> list[dict[str, Any]]:
    """Facts of each image in a file; damage is noted."""
    kind = classify(data[:4096])
    todo = {"elf": lambda: [parse_elf(data)], "pe": lambda: [parse_pe(data)], "macho": lambda: [parse_macho(data)], "macho_fat": lambda: [parse_macho(data, at) for at in slices(data)]}.get(kind)
    if todo is None:
        return []
    try:
        return todo()
    except (struct.error, ValueError, IndexError, OverflowError) as e:
        return [facts(kind) | {"notes": [f"{type(e).__name__}: {e}"]}]


def user_strings(heap: bytes) -> list[tuple[int, str]]:
    """(offset, text) of the records of a CLI user-string heap: a compressed length, UTF-16 text and a flag byte."""
    out, i = [], 1
    while i < len(heap):
        at, b = i, heap[i]
        if b < 0x80:
            n, i = b, i + 1
        elif b < 0xC0 and i + 1 < len(heap):
            n, i = (b & 0x3F) << 8 | heap[i + 1], i + 2
        elif i + 3 < len(heap):
            n, i = (b & 0x1F) << 24 | heap[i + 1] << 16 | heap[i + 2] << 8 | heap[i + 3], i + 4
        else:
            break
        if i + n > len(heap):
            break
        if n > 1:
            out.append((at, heap[i : i + n - 1].decode("utf-16-le", "replace")))
        i += n
    return out
