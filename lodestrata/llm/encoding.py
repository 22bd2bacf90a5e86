"""Texts decoded with the wrong character encoding, and their repair.

1. Words with non-ASCII characters are counted over all distinct texts.
2. Each word is joined with all more frequent near-twins: words that are equal once the non-ASCII characters are stripped, and whose bytes in some
   encoding are its own in another. Aligning the characters of a pair shows which transformation (text encoded as E, decoded as D) turns the frequent word into the rare one; words without ASCII letters are paired
   with the frequent words that a transformation turns into them. Transformations with enough distinct pairs are learned.
3. The learned transformations are applied, also repeatedly, to every word; the readings are joined with the counts of all words, and one that the
   corpus knows much better than the word itself replaces it. Sequences inside words are mapped likewise, so words glued to identifiers are restored.
4. Byte pairs read as UTF-16 units, or units with swapped bytes, leave no ASCII to join on; these two transformations are tried on whole parts of a
   text, and the words of what comes out are joined with the counts of words: a part counts if the corpus knows them and not those of the part.

A replacement character or a C1 control never stands in correct text, so texts with one are garbled even where nothing can be restored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm.batches import chunks
from lodestrata.session import cut

SINGLE = "cp1252 latin-1 cp1250 cp1251 cp1253 cp1254 cp1257 cp1258 cp437 cp850 cp852 cp857 cp866 koi8-r koi8-u mac-roman mac-latin2 mac-cyrillic iso8859-2 iso8859-5 iso8859-7 iso8859-9 iso8859-15 iso8859-16".split()
MULTI = "utf-8 gbk big5 cp932 euc-jp euc-kr".split()
#: A clean word is at least so many times as frequent as its garbled twin; and so often at all.
RATIO, LEAST = 3, 3
#: Share of the letters of a reading as UTF-16 that stand in known words.
KNOWN_SHARE = 1 / 3
#: From this share of known words of three Latin letters on, the counts of what the part reads as it stands don't matter.
WORD_SHARE = 1 / 2
#: Distinct twin pairs that make a transformation learned.
SUPPORT = 3
LEAST_SKELETON = 2
HEAVY_PARTS = 64
_SPACE = re.compile(r"([ \t\r\n]+)")
_PARTS = re.compile(r"( — | / |: |[\r\n]+)")
_EDGE = re.compile(r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$")
_NEVER = re.compile("[�\x80-\x84\x86-\x9f]")
_RUN = re.compile("[^\x00-\x7f]+")
#: Runs of letters with their marks, and the words inside them by case.
_LETTERS = re.compile("(?:(?![\u2e80-\U0010ffff])[^\\W\\d_])+|(?:(?=[\u2e80-\U0010ffff])[^\\W\\d_])+")
_CASES = re.compile(r"[^\W\d_a-z]+(?![a-z])|[^\W\d_a-z]?[^\W\d_A-Z]+")
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _table(codec: str) -> tuple[dict[str, int], list[str]]:
    """Characters to bytes and back; bytes that the codec leaves undefined pass as C1 controls, as common decoders let them."""
    back = []
    for b in range(256):
        try:
            back.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            back.append(chr(b))
    return {c: b for b, c in reversed(list(enumerate(back)))}, back


TABLES = {c: _table(c) for c in SINGLE}
#: Characters that some single-byte encoding makes of the first and the later bytes of a UTF-8 sequence; a few hundred of each.
LEADS = {back[b] for _, back in TABLES.values() for b in range(0xC2, 0xF5)}
TRAILS = {back[b] for _, back in TABLES.values() for b in range(0x80, 0xC0)}


def to_bytes(text: str, codec: str) -> bytes | None:
    if codec in TABLES:
        t = TABLES[codec][0]
        try:
            return bytes([t[c] for c in text])
        except KeyError:
            return None
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        return None


def to_text(raw: bytes, codec: str) -> str | None:
    """Decoded bytes; a UTF-8 character cut off at the end is dropped."""
    if codec in TABLES:
        t = TABLES[codec][1]
        return "".join([t[b] for b in raw])
    try:
        return raw.decode(codec)
    except UnicodeDecodeError as e:
        return raw[: e.start].decode(codec) if e.start and e.start >= len(raw) - 3 and (codec != "utf-8" or "end of data" in e.reason) else None


@lru_cache(200_000)
def undo(word: str, wrong: str, true: str) -> str | None:
    """The word before it was encoded as ``true`` and decoded as ``wrong``; None if it can't have been."""
    raw = to_bytes(word, wrong)
    if raw is None or raw.isascii():
        return None
    text = to_text(raw, true)
    return text if text and text != word else None


TRANSFORMATIONS = [(d, e) for d in SINGLE + MULTI for e in SINGLE + MULTI if d != e]


def tokens_of(text: str) -> list[tuple[str, str, int]]:
    """(token, key, place of the token in the key) of a text parted at ASCII blanks only: others may be parts of a garbled word.

    The key is the word without ASCII punctuation around it. One or two non-ASCII characters on their own (a dash, a sign) say little, so they get
    the words before and after them into their key. ASCII tokens have an empty key.
    """
    parts = _SPACE.split(text)
    out = []
    for i, x in enumerate(parts):
        if x.isascii():
            out.append((x, "", 0))
            continue
        w = _EDGE.sub("", x)
        if len(w) < 3:
            before, after = parts[i - 2] if i > 1 else "", parts[i + 2] if i + 2 < len(parts) else ""
            before, after = before if before.isascii() else "", after if after.isascii() else ""
            if before or after:
                out.append((x, f"{before} {w} {after}", len(before) + 1))
                continue
        out.append((x, w, 0))
    return out


def words_of(text: str) -> list[str]:
    return [key for _, key, _ in tokens_of(text) if key]


def last_key(text: str) -> str:
    """Key of the text's last word; empty if that is ASCII."""
    tokens = tokens_of(_PARTS.split(text)[-1])
    return tokens[-1][1] if tokens else ""


def counts(values: DataFrame) -> DataFrame:
    """kind, item, n: number of distinct values with it. Kinds: v, word or pair of characters as ``items_of`` gives them, also stripped of non-ASCII
    characters; of non-ASCII values also w,
    word with its signs; l, word at the very end; c, character; p, pair of characters that may stand for one in UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[tuple[str, str]] = Counter()

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([k for k, _ in sums], pa.string()), pa.array([_store(x) for _, x in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], names=["kind", "item", "n"])
            sums.clear()
            return b

        for _, texts in chunks(batches, "value"):
            for t in texts:
                items = set(items_of(t))
                if not t.isascii():
                    items |= {y for x in items if len(y := _RUN.sub("", x)) > 2}
                sums.update({("v", x) for x in items})
                if t.isascii():
                    continue
                sums.update({("w", w) for part in _PARTS.split(t) for w in words_of(part)})
                if key := last_key(t):
                    sums["l", key] += 1
                sums.update({("c", c) for c in t})
                sums.update({("p", r[i : i + 2]) for r in _RUN.findall(t) for i in range(len(r) - 1) if r[i] in LEADS and r[i + 1] in TRAILS})
                if len(sums) > 200_000:
                    yield flush()
        if sums:
            yield flush()

    return values.mapInArrow(run, "kind string, item string, n bigint").groupBy("kind", "item").agg(F.sum("n").alias("n"))


def _store(s: str) -> str:
    return s.encode("utf-8", "replace").decode()


def twins(words: DataFrame) -> DataFrame:
    """garbled, clean: all pairs of words with the same skeleton of which one is much more frequent and that are the same bytes in two encodings.
    ``words``: item, n.

    All encodings keep ASCII, so what ``align`` explains are words whose bytes, in whole, are equal. Each word gives its different byte forms (of at
    most as many encodings as there are), and words meet by skeleton and form. A form is the bytes of hardly more words than there are encodings, so
    no key is hot, however many words share a skeleton, and no partner has to be left out.
    """

    def forms(cols: dict[str, list]) -> Iterator[tuple]:
        for w, skeleton, n in zip(cols["item"], cols["skeleton"], cols["n"], strict=True):
            for raw in {raw for c in SINGLE + MULTI if (raw := to_bytes(w, c)) is not None and not raw.isascii()}:
                yield skeleton, raw, w, n

    keyed = words.withColumn("skeleton", F.lower(F.regexp_replace("item", "[^A-Za-z0-9]", ""))).where(F.length("skeleton") >= LEAST_SKELETON)
    formed = keyed.mapInArrow(_per_row(forms, ["skeleton", "raw", "item", "n"], [pa.string(), pa.binary(), pa.string(), pa.int64()]), "skeleton string, raw binary, item string, n bigint")
    met = formed.groupBy("skeleton", "raw").agg(F.collect_list(F.struct("item", "n")).alias("ws")).where(F.size("ws") > 1)
    pairs = met.select(F.explode("ws").alias("g"), "ws").select("g", F.explode("ws").alias("c"))
    return pairs.where((F.col("c.n") >= LEAST) & (F.col("c.n") >= F.col("g.n") * RATIO) & (F.col("g.item") != F.col("c.item"))).select(F.col("g.item").alias("garbled"), F.col("c.item").alias("clean")).distinct()


def align(garbled: str, clean: str) -> list[tuple[str, str]]:
    """Transformations that turn ``clean`` into ``garbled``, found where their characters differ: equal ends are stripped, and what is left of the
    garbled word must decode to what is left of the clean one."""
    i = 0
    while i < min(len(garbled), len(clean)) and garbled[i] == clean[i] and garbled[i].isascii():
        i += 1
    j = 0
    while j < min(len(garbled), len(clean)) - i and garbled[-1 - j] == clean[-1 - j] and garbled[-1 - j].isascii():
        j += 1
    g, c = garbled[i : len(garbled) - j], clean[i : len(clean) - j]
    if not g or not c or g.isascii():
        return []
    true: dict[bytes, list[str]] = {}
    for e in SINGLE + MULTI:
        if (raw := to_bytes(c, e)) is not None and not raw.isascii():
            true.setdefault(raw, []).append(e)
    return [(d, e) for d in SINGLE + MULTI if (raw := to_bytes(g, d)) in true for e in true[raw] if d != e]


def learn(words: DataFrame) -> list[tuple[str, str]]:
    """Transformations with at least SUPPORT distinct twin pairs of their own, the best supported first.

    Encodings overlap, so a pair is often explained by several; the first pass counts for all of them, the second credits the best supported only.
    Words without ASCII letters have no skeleton: their readings under all transformations are joined with the words themselves.
    """
    place = {h: k for k, h in enumerate(TRANSFORMATIONS)}

    def explained(cols: dict[str, list]) -> Iterator[tuple]:
        for w, clean in zip(cols["garbled"], cols["clean"], strict=True):
            if options := [place[h] for h in align(w, clean)]:
                yield w, clean, options

    def bare(cols: dict[str, list]) -> Iterator[tuple]:
        for w, n in zip(cols["item"], cols["n"], strict=True):
            if len(w) > 2:
                found: dict[str, list[int]] = {}
                for h, k in place.items():
                    if (r := undo(w, *h)) is not None and not _NEVER.search(r):
                        found.setdefault(_store(r), []).append(k)
                for r, options in found.items():
                    yield w, n, r, options

    ints = pa.list_(pa.int32())
    a = twins(words).mapInArrow(_per_row(explained, ["garbled", "clean", "options"], [pa.string(), pa.string(), ints]), "garbled string, clean string, options array<int>").select("garbled", "options")
    plain = words.where(F.length(F.regexp_replace("item", "[^A-Za-z]", "")) < LEAST_SKELETON)
    known = words.where(F.col("n") >= LEAST).select(F.col("item").alias("clean"), F.col("n").alias("nc"))
    read = plain.mapInArrow(_per_row(bare, ["garbled", "ng", "clean", "options"], [pa.string(), pa.int64(), pa.string(), ints]), "garbled string, ng bigint, clean string, options array<int>")
    b = read.join(known, "clean").where(F.col("nc") >= F.col("ng") * RATIO).groupBy("garbled").agg(F.array_distinct(F.flatten(F.collect_list("options"))).alias("options"))
    pairs = cut(a.unionByName(b))
    counted = lambda df: {r.h: r.n for r in df.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT).collect()}  # noqa: E731  at most len(TRANSFORMATIONS) rows
    support = counted(pairs.select(F.explode("options").alias("h")))
    order = F.array(*[F.lit(-support.get(k, 0)) for k in range(len(TRANSFORMATIONS))])
    best = F.array_min(F.transform("options", lambda k: F.struct(F.get(order, k).alias("s"), k.alias("h"))))
    own = counted(pairs.select(best["h"].alias("h")))
    return [TRANSFORMATIONS[k] for k in sorted(own, key=lambda k: (-own[k], k))]


class Repairer:
    """Restores texts from the repairs of their words; what needs no corpus-wide lookup (single characters) is decided here."""

    def __init__(self, chars: dict[str, int], pairs: dict[str, int], learned: list[tuple[str, str]]):
        self.chars, self.pairs, self.learned = chars, pairs, learned
        self.utf8 = [d for d, e in learned if e == "utf-8" and d in TABLES]

    def along(self, w: str, h: tuple[str, str]) -> str | None:
        """The word before the transformation, if every character of the result is known."""
        r = undo(w, *h)
        return r if r and not _NEVER.search(r) and all(self.chars.get(c, 0) >= LEAST for c in r) else None

    def sequences(self, w: str) -> str:
        """``w`` with each sequence that is UTF-8 read in a learned single-byte encoding decoded, where its character is much better known."""
        for _ in range(3):
            for d in self.utf8:
                t = TABLES[d][0]
                raw = bytes([t.get(c, 255) for c in w])
                out, last = [], 0
                for m in _UTF8.finditer(raw):
                    a, b = m.span()
                    g = w[a:b]
                    if any(c.isascii() for c in g):
                        continue
                    c = m[0].decode("utf-8", "ignore")
                    if c and not _NEVER.match(c) and self.chars.get(c, 0) >= max(LEAST, RATIO * self.pairs.get(g[:2], 0)):
                        out += [w[last:a], c]
                        last = b
                if out:
                    w = "".join(out) + w[last:]
                    break
            else:
                return w
        return w

    def repair(self, text: str, words: dict[str, str], cut_off: str | None = None, rare: frozenset[str] | set[str] = frozenset(), units: dict[int, str] | None = None) -> tuple[str, bool]:
        """(restored text, garbled). Equal to the input where nothing can be restored.

        ``words``: key -> known word it was; ``cut_off``: what the last key was the beginning of; ``rare``: keys that the corpus hardly knows;
        ``units``: number of a part (-1: the whole text) -> what its UTF-16 units were.
        """
        units = units or {}
        if -1 in units:
            return units[-1], True
        parts = _PARTS.split(text)
        bad = bool(_NEVER.search(text))
        out = []
        for k, part in enumerate(parts):
            if part.isascii():
                out.append(part)
                continue
            if k in units:
                out.append(units[k])
                bad = True
                continue
            tokens = tokens_of(part)
            new: list[str | None] = []
            how: Counter[tuple[str, str]] = Counter()
            for j, (x, key, at) in enumerate(tokens):
                core = _EDGE.sub("", x) if key else ""
                w = words.get(key) if key else None
                if w is None and cut_off is not None and k == len(parts) - 1 and j == len(tokens) - 1:
                    w = cut_off
                if w is not None:
                    how.update([next((h for h in self.learned if undo(key, *h) == w), ("", ""))])
                    w = w[at : len(w) - (len(key) - at - len(core))] if key != core else w
                elif key and (s := self.sequences(core)) != core:
                    w = s
                new.append(w)
            bad |= any(w is not None for w in new)
            same = how.most_common(1)[0][0] if how else ("", "")
            for (x, key, _), w in zip(tokens, new, strict=True):
                core = _EDGE.sub("", x) if key else ""
                if w is None and key and same[0] and key in rare:
                    w = self.along(core, same)  # what the corpus can't tell went the way of the words around it
                begin = x.find(core)
                out.append(x if w is None else x[:begin] + w + x[begin + len(core) :])
        return "".join(out), bad


def readings(word: str, learned: list[tuple[str, str]]) -> dict[str, int]:
    """What ``word`` may have been, with the number of transformations undone (at most three; steps in between through UTF-8)."""
    out: dict[str, int] = {}
    level = [word]
    for depth in (1, 2, 3):
        deeper = []
        for x in level:
            for h in learned:
                r = undo(x, *h)
                if r is None or r == word or r in out:
                    continue
                out[r] = depth
                if h[1] == "utf-8":
                    deeper.append(r)
        level = deeper
    return out


def _per_row(make: Callable[[dict[str, list]], Iterator[tuple]], names: list[str], types: list[pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that turns the columns of a batch into tuples, put out in batches of a bounded number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        for b in batches:
            for row in make({n: b.column(n).to_pylist() for n in b.schema.names}):
                held.append(row)
                if len(held) >= 20_000:
                    yield batch()
        if held:
            yield batch()

    return run


def word_repairs(words: DataFrame, ends: DataFrame, learned: list[tuple[str, str]]) -> DataFrame:
    """item, n, best (the much better known word that ``item`` was), cut_best (the same for an item cut off at the end of a text).

    ``words``: item, n; ``ends``: item, the last words of texts. All readings of all words are joined with the counts of all words, whatever their
    frequency; a repair that is itself repairable is followed twice more.
    """
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(learned)

    def read(cols: dict[str, list]) -> Iterator[tuple]:
        for w, n in zip(cols["item"], cols["n"], strict=True):
            if len(w) > 2 and any(c.isalpha() for c in w):
                for r, depth in readings(w, shared.value).items():
                    if not _NEVER.search(r):
                        yield w, n, _store(r), depth

    read_ = words.mapInArrow(_per_row(read, ["item", "n", "reading", "depth"], [pa.string(), pa.int64(), pa.string(), pa.int32()]), "item string, n bigint, reading string, depth int")
    known = words.where(F.col("n") >= LEAST).select(F.col("item").alias("reading"), F.col("n").alias("known"))
    best = read_.join(known, "reading").where(F.col("known") >= F.col("n") * RATIO).groupBy("item").agg(F.max(F.struct(-F.col("depth"), "known", "reading")).alias("x")).select("item", F.col("x.reading").alias("best"))
    best = cut(best)
    for _ in range(2):
        best = best.join(best.select(F.col("item").alias("best"), F.col("best").alias("next")), "best", "left").select("item", F.coalesce("next", "best").alias("best"))
    out = words.join(cut(best), "item", "left")

    def begin(cols: dict[str, list]) -> Iterator[tuple]:
        for w in cols["item"]:
            yield w, w, True
            for h in shared.value:
                r = undo(w, *h)
                if r is not None and len(r) > 3:
                    yield w, _store(r), False

    open_ = ends.where(F.length("item") > 3).join(best.select("item"), "item", "left_anti")
    starts = open_.mapInArrow(_per_row(begin, ["item", "start", "own"], [pa.string(), pa.string(), pa.bool_()]), "item string, start string, own boolean").distinct()
    asked = starts.select("start").distinct()
    prefixes = words.where(F.length("item") > 3).select("n", F.explode(F.transform(F.sequence(F.lit(4), F.length("item")), lambda k: F.substring(F.col("item"), F.lit(1), k))).alias("start")).join(asked, "start", "left_semi").groupBy("start").agg(F.max("n").alias("known"))
    found = starts.join(prefixes, "start").groupBy("item").agg(F.max(F.when(F.col("own"), F.col("known"))).alias("self"), F.max(F.when(~F.col("own"), F.struct("known", "start"))).alias("x"))
    cut_off = found.where(F.col("x.known") >= F.greatest(F.lit(LEAST), F.coalesce("self", F.lit(0)) * RATIO)).select("item", F.col("x.start").alias("cut_best"))
    return out.join(cut_off, "item", "left")


def items_of(text: str) -> list[str]:
    """Lower-case words of at least two letters, parted at changes of case; of scripts without blanks the pairs of characters."""
    out = []
    for run in _LETTERS.findall(text):
        if ord(run[0]) >= 0x2E80:
            out += [run[i : i + 2] for i in range(len(run) - 1)]
        else:
            out += [p.lower() for p in _CASES.findall(run) if len(p) > 1]
    return out


def unit_readings(part: str) -> dict[str, None]:
    """What a part may have been before its bytes were taken for UTF-16 units, or its units' bytes were swapped; only readings that look like text."""
    if len(part) < 2 or sum(not c.isascii() for c in part) * 2 < len(part) or not any(c.isalpha() or ord(c) >= 0xD800 for c in part):
        return {}
    out: dict[str, None] = {}
    for wrong in ("utf-16-le", "utf-16-be"):
        raw = part.encode(wrong, "surrogatepass")
        for true in ("utf-16-be" if wrong == "utf-16-le" else "utf-16-le", "utf-8", "cp1252", "cp1251", "cp1250"):
            t = raw.decode(true, "ignore") if true.startswith("utf-16") else to_text(raw.rstrip(b"\0"), true)
            if t and len(t) * 2 >= len(part) and not _NEVER.search(t) and not any(c < " " and c not in "\r\n\t" for c in t) and 2 * sum(c.isalnum() for c in t) >= sum(not c.isspace() for c in t) and items_of(t):
                out[t] = None
    return out


def unit_repairs(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """h, part (-1: the whole text), restored: texts and parts of texts that were UTF-16 read wrongly.

    ``texts``: h, value; ``vocabulary``: item, n. A reading counts if the corpus knows words of three letters (pairs of characters in
    scripts without blanks) with a third of its letters and knows its words, by the geometric mean of their counts, RATIO times as well as those of the
    part as it stands. Lost letters are no obstacle, as the corpus's words are counted without their non-ASCII letters as well.
    """

    def read(cols: dict[str, list]) -> Iterator[tuple]:
        for h, text in zip(cols["h"], cols["value"], strict=True):
            parts = _PARTS.split(text)
            for k, part in [(-1, text), *(enumerate(parts) if len(parts) > 1 else ())]:
                if part.isascii():
                    continue
                got = unit_readings(part)
                for t in [part, *got] if got else ():
                    for item, n in (Counter(items_of(t)) or {"": 1}).items():
                        yield h, k, _store(t), t != part, _store(item), n * len(item)

    asked = texts.mapInArrow(_per_row(read, ["h", "part", "reading", "new", "item", "weight"], [pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.int64()]), "h string, part int, reading string, new boolean, item string, weight bigint")
    n, w, paired = F.coalesce("n", F.lit(0)), F.greatest("weight", F.lit(1)), F.col("item").rlike(r"^[^\x00-\u2e7f]")
    part = lambda told: F.sum(F.when((n >= LEAST) & told, w).otherwise(0)) / F.sum(w)
    scored = asked.join(vocabulary, "item", "left").groupBy("h", "part", "reading", "new").agg((F.sum(F.log(n + 0.5) * w) / F.sum(w)).alias("score"), part((F.length("item") > 2) & ~paired).alias("words"), part((F.length("item") > 2) & F.col("item").rlike("^[a-z\u00df-\u024f]+$")).alias("latin"), part(paired).alias("pairs"))
    fair = F.col("new") & (F.col("words") + F.col("pairs") >= KNOWN_SHARE)
    own = F.max(F.when(~F.col("new"), F.col("score"))).over(Window.partitionBy("h", "part"))  # at most eleven readings of a part
    better = scored.withColumn("own", own).where(fair & ((F.col("latin") >= WORD_SHARE) | (F.col("score") >= F.col("own") + math.log(RATIO))))
    return better.groupBy("h", "part").agg(F.max(F.struct("score", "reading")).alias("x")).select("h", "part", F.col("x.reading").alias("restored"))


def garbled(texts: DataFrame) -> DataFrame:
    """rec_id, value, restored, complete of each text that was decoded wrongly; ``complete``: nothing lost or undecodable is left in ``restored``.

    ``texts``: rec_id, value. Null, empty and ASCII texts are never garbled; repeated rows give repeated rows; other columns are ignored; an empty
    table gives none. Whole texts are judged. All counts are over the distinct texts, so that one frequent garbled text doesn't pass as correct.
    Words are never looked up in a dictionary on the driver: words, readings and repairs meet in joins, so rare words count as at any size. What is
    broadcast is bounded by Unicode: counts of single characters, and of pairs that some single-byte encoding makes of UTF-8.
    """
    spark = texts.sparkSession
    rows = texts.select(F.col("rec_id").cast("bigint").alias("rec_id"), F.md5("value").alias("h"), "value")
    all_ = cut(counts(rows.where("value <> ''").select("value").distinct()))
    chars, pairs = ({r.item: r.n for r in all_.where(F.col("kind") == k).select("item", "n").toLocalIterator()} for k in ("c", "p"))
    words = all_.where("kind = 'w'").select("item", "n")
    learned = learn(words)
    fixer = spark.sparkContext.broadcast(Repairer(chars, pairs, learned))
    odd = rows.where(F.col("value").rlike(r"[^\x00-\x7f]"))
    distinct = odd.select("h", "value").distinct()

    def keys(cols: dict[str, list]) -> Iterator[tuple]:
        for h, text in zip(cols["h"], cols["value"], strict=True):
            last = last_key(text)
            for key in dict.fromkeys(w for part in _PARTS.split(text) for w in words_of(part)):
                yield h, _store(key), key == last

    repairs = word_repairs(words, all_.where("kind = 'l'").select("item"), learned)
    keyed = distinct.mapInArrow(_per_row(keys, ["h", "item", "last"], [pa.string(), pa.string(), pa.bool_()]), "h string, item string, last boolean")
    # Words in one of HEAVY_PARTS texts and more meet a broadcast (their number is bounded by the words of so many texts), the others are shuffled.
    repairs, many = cut(repairs), distinct.count()
    heavy = F.broadcast(repairs.where(F.col("n") * HEAVY_PARTS > many))
    light = keyed.join(F.broadcast(heavy.select("item")), "item", "left_anti").join(repairs, "item")
    told = light.unionByName(keyed.join(heavy, "item").select(*light.columns)).where(F.col("best").isNotNull() | F.col("last") & F.col("cut_best").isNotNull() | (F.col("n") < LEAST))
    told = told.groupBy("h").agg(F.collect_list(F.struct("item", "best", F.when(F.col("last"), F.col("cut_best")).alias("cut_best"), (F.col("n") < LEAST).alias("rare"))).alias("words"))
    units = unit_repairs(distinct, all_.where("kind = 'v'").select("item", "n")).groupBy("h").agg(F.collect_list(F.struct("part", "restored")).alias("units"))

    def fix(cols: dict[str, list]) -> Iterator[tuple]:
        f = fixer.value
        for h, text, ws, us in zip(cols["h"], cols["value"], cols["words"], cols["units"], strict=True):
            ws = ws or []
            r, bad = f.repair(text, {x["item"]: x["best"] for x in ws if x["best"] is not None}, next((x["cut_best"] for x in ws if x["cut_best"] is not None), None), {x["item"] for x in ws if x["rare"]}, {x["part"]: x["restored"] for x in us or []})
            if bad:
                yield h, _store(r), not _NEVER.search(r)

    judged = distinct.join(told, "h", "left").join(units, "h", "left")
    found = judged.mapInArrow(_per_row(fix, ["h", "restored", "complete"], [pa.string(), pa.string(), pa.bool_()]), "h string, restored string, complete boolean")
    return odd.join(found, "h").select("rec_id", "value", "restored", "complete")
