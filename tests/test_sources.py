import glob
import struct
import sys

import pytest

from lodestrata.sources import folder
from lodestrata.sources.formats import classify, export_trie, link_facts, user_strings, zip_flavour


def small_pe():
    """A 64-bit library with one export by name, one forwarder, one ordinal export, and an import."""
    rva, raw = 0x1000, 0x400
    body = bytearray(0x400)

    def put(at, fmt, *v):
        struct.pack_into("<" + fmt, body, at, *v)

    def text(at, s):
        body[at : at + len(s) + 1] = s.encode() + b"\0"

    put(0, "IIHHIIIIIII", 0, 0, 0, 0, rva + 0x100, 5, 3, 2, rva + 0x40, rva + 0x50, rva + 0x60)
    put(0x40, "III", 0x2000, rva + 0x120, 0x3000)
    put(0x50, "II", rva + 0x140, rva + 0x150)
    put(0x60, "HH", 0, 1)
    for at, s in ((0x100, "own.dll"), (0x120, "other.Func"), (0x140, "First"), (0x150, "Second"), (0x280, "dep.dll")):
        text(at, s)
    put(0x200, "5I", rva + 0x240, 0, 0, rva + 0x280, rva + 0x240)
    put(0x240, "QQQ", rva + 0x2A0, (1 << 63) | 7, 0)
    text(0x2A2, "needed_fn")
    head = bytearray(raw)
    head[:2] = b"MZ"
    struct.pack_into("<I", head, 0x3C, 0x80)
    head[0x80:0x84] = b"PE\0\0"
    struct.pack_into("<HHIIIHH", head, 0x84, 0x8664, 1, 0, 0, 0, 240, 0x2022)
    struct.pack_into("<H", head, 0x98, 0x20B)
    struct.pack_into("<Q", head, 0x98 + 24, 0x180000000)
    struct.pack_into("<I", head, 0x98 + 108, 16)
    struct.pack_into("<IIII", head, 0x98 + 112, rva, 0x180, rva + 0x200, 0x40)
    struct.pack_into("<8sIIII", head, 0x98 + 240, b".rdata", 0x400, rva, 0x400, raw)
    return bytes(head + body)


def test_pe():
    f = link_facts(small_pe())[0]
    assert (f["arch"], f["bits"], f["identity"], f["notes"]) == ("x86_64", 64, "own.dll", [])
    assert f["exports"] == [("First", 0x180002000, 5, None, False), ("Second", None, 6, "other.Func", False), ("#7", 0x180003000, 7, None, False)]
    assert f["imports"] == [("needed_fn", "dep.dll", None, None, False), ("#7", "dep.dll", 7, None, False)]


def test_elf_of_this_machine():
    libs = glob.glob("/usr/lib/x86_64-linux-gnu/libz.so*") + glob.glob("/lib/x86_64-linux-gnu/libm.so*") + [sys.executable]
    f = link_facts(open(libs[0], "rb").read())[0]
    assert f["format"] == "elf" and f["bits"] == 64 and not f["notes"]
    assert f["libraries"] and f["imports"]
    if "libm" in libs[0]:
        assert "cos" in {n for n, *_ in f["exports"]}


def test_macho():
    name = b"/usr/lib/libA.dylib\0".ljust(24, b"\0")
    dylib = struct.pack("<6I", 0xC, 24 + len(name), 24, 0, 0, 0) + name
    strings = b"\0_main\0_puts\0"
    cmds = dylib
    off = 32 + len(cmds) + 24
    symtab = struct.pack("<6I", 2, 24, off, 2, off + 32, len(strings))
    symbols = struct.pack("<IBBHQ", 1, 0xF, 1, 0, 0x1000) + struct.pack("<IBBHQ", 7, 1, 0, 1 << 8, 0)
    data = struct.pack("<8I", 0xFEEDFACF, 0x01000007, 3, 2, 2, len(cmds) + 24, 0, 0) + cmds + symtab + symbols + strings
    f = link_facts(data)[0]
    assert f["libraries"] == [("/usr/lib/libA.dylib", "needed")]
    assert f["exports"] == [("_main", 0x1000, None, None, False)] and f["imports"] == [("_puts", "/usr/lib/libA.dylib", None, None, False)]
    fat = struct.pack(">II5I", 0xCAFEBABE, 1, 0x01000007, 3, 64, len(data), 6).ljust(64, b"\0") + data
    assert classify(fat) == "macho_fat" and link_facts(fat)[0]["exports"] == f["exports"]


def test_macho_symbols_beyond_the_cap_are_noted(monkeypatch):
    from lodestrata.sources import formats

    assert formats.MOST_MACHO_SYMBOLS == 4_000_000
    strings = b"\0_main\0_next\0"
    symtab = struct.pack("<6I", 2, 24, 56, 2, 88, len(strings))
    symbols = struct.pack("<IBBHQ", 1, 0xF, 1, 0, 0x1000) + struct.pack("<IBBHQ", 7, 0xF, 1, 0, 0x2000)
    data = struct.pack("<8I", 0xFEEDFACF, 0x01000007, 3, 2, 1, 24, 0, 0) + symtab + symbols + strings
    assert len(link_facts(data)[0]["exports"]) == 2 and not link_facts(data)[0]["notes"]
    monkeypatch.setattr(formats, "MOST_MACHO_SYMBOLS", 1)
    f = link_facts(data)[0]
    assert len(f["exports"]) == 1 and f["notes"] == ["2 symbols, the first 1 were read"]


def test_export_trie():
    #       root: edge "_a" -> 6            node: flags 0, address 0x10, edge "b" -> 14  leaf: flags 0, address 0x20
    trie = b"\x00\x01_a\x00\x06" + b"\x02\x00\x10\x01b\x00\x0d" + b"\x02\x00\x20\x00"
    assert [(n, a) for n, a, *_ in export_trie(trie, 0x100)] == [("_a", 0x110), ("_ab", 0x120)]


@pytest.mark.parametrize(("head", "kind"), [(b"\x7fELF", "elf"), (b"\xca\xfe\xba\xbe\0\0\0\x34" + b"\0" * 8, "java_class"), (b"PK\x03\x04", "zip"), (b"MZ", "data"), (b"", "data")])
def test_classify(head, kind):
    assert classify(head) == kind


def test_damaged_files_are_noted():
    assert link_facts(b"\x7fELF\x02\x01" + b"\0" * 4)[0]["notes"]
    assert link_facts(small_pe()[:0x500])[0]["notes"]
    assert link_facts(b"text") == []
    assert zip_flavour(b"PK\x03\x04 broken") == "zip"


def test_user_strings():
    s = "hi".encode("utf-16-le") + b"\0"
    assert user_strings(b"\0" + bytes([len(s)]) + s + b"\x01\x00\x09") == [(1, "hi")]


def test_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".git").mkdir()
    for p in ("a/x.dll", "b.dll", ".git/c.dll"):
        (tmp_path / p).write_bytes(small_pe())
    (tmp_path / "n.txt").write_bytes(b"plain")
    (tmp_path / "bad.dll").write_bytes(small_pe()[:0x500])
    f = folder.files(spark, str(tmp_path))
    got = {r.path: (r.kind, r.duplicate_of) for r in folder.inventory(f).collect()}
    assert got == {"a/x.dll": ("pe", None), "b.dll": ("pe", "a/x.dll"), "n.txt": ("data", None), "bad.dll": ("pe", None)}
    facts = {r.path: r for r in folder.images(f).collect()}
    assert len(facts) == 3 and facts["bad.dll"].notes and int(facts["b.dll"].exports[0].address) == 0x180002000
