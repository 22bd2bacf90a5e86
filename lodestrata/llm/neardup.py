"""Near-duplicate texts by min-max hashing.

Each permutation gives two values of the signature, the minimum and the maximum of the permuted set, so N permutations make 2N rows to band: half the
hash evaluations for the same number of values, which are unbiased and slightly negatively correlated. Bands only nominate pairs; every nominated
pair is decided by the exact Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.batches import chunks, mix
from lodestrata.operators.skew import lookup
from lodestrata.session import cut, shuffle_partitions

_WORD = re.compile("[A-Za-z0-9_]+")
SHINGLE, LEAST_WORDS = 3, 20
#: 64 bands of 4 values: at similarity 0.6 a pair is nominated with probability 1 - (1 - 0.6^4)^64 = 0.99986, at 0.65 0.999996. Bands of 3 values
#: would do with 36, but on short functions that share their frame they nominate hundreds of times as many pairs.
BANDS, ROWS = 64, 4
#: Members of a hot bucket compared by one task with one block of the others; a bucket is hot from one in so many nodes on; nodes looked at to tell.
BLOCK, HOT_PARTS, SAMPLED = 2_000, 512, 16
#: Pairs that a task looks at and puts out at once.
CHUNK = 100_000
#: Band rows that a task holds; partitions at least, if the session has so many; bits of a node's outline.
TASK_ROWS, LEAST_PARTS, OUTLINE = 4_000_000, 12, 192
#: Bits of the map that tells which sets are asked for.
ASKED_BITS = 1 << 22


def shingles(text: str, size: int = SHINGLE, least: int = LEAST_WORDS) -> np.ndarray | None:
    """Sorted distinct 64-bit hashes of ``size`` consecutive words; None under ``least`` words."""
    words = [w for w in _WORD.findall(text.lower() if text.isascii() else _lower(text)) if not "0" <= w[0] <= "9"]
    if len(words) < max(least, size):
        return None
    return _hash(words, size)


def _lower(text: str) -> str:
    """Lower-case A-Z only: other letters separate words and must not turn into ASCII."""
    return text.translate(_ASCII_LOWER)


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_memo: dict[str, int] = {}


def _word(w: str) -> int:
    """Stable 64-bit hash of a word (the first 8 bytes of BLAKE2b), remembered in the worker."""
    if len(_memo) > 500_000:
        _memo.clear()
    _memo[w] = h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
    return h


def _hash(words: list[str], size: int) -> np.ndarray:
    get = _memo.get
    ids = np.array([get(w) or _word(w) for w in words], dtype=np.uint64)
    n = len(ids) - size + 1
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n])
    return np.unique(h)


class MinMax:
    """Signatures of ``bands`` x ``rows`` values from half as many permutations."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 7):
        self.bands, self.rows = bands, rows
        self.keys = mix(np.arange(seed * 1000, seed * 1000 + bands * rows // 2))

    def bands_of(self, sh: np.ndarray) -> np.ndarray:
        low, high = np.empty(len(self.keys), np.uint64), np.empty(len(self.keys), np.uint64)
        with np.errstate(over="ignore"):
            wide = 128 if len(sh) <= 2_000 else 32  # bounded memory for very long texts
            for a in range(0, len(self.keys), wide):
                for b in range(0, len(sh), 20_000):
                    p = (sh[None, b : b + 20_000] ^ self.keys[a : a + wide, None]) * np.uint64(0xFF51AFD7ED558CCD)
                    p ^= p >> np.uint64(32)
                    p *= np.uint64(0xC4CEB9FE1A85EC53)
                    lo, hi = p.min(axis=1), p.max(axis=1)
                    low[a : a + wide] = lo if b == 0 else np.minimum(low[a : a + wide], lo)
                    high[a : a + wide] = hi if b == 0 else np.maximum(high[a : a + wide], hi)
            values = np.r_[low, high].reshape(self.bands, self.rows)
            h = np.arange(self.bands, dtype=np.uint64)
            for k in range(self.rows):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + values[:, k])
        return h


def packed(values: np.ndarray) -> bytes:
    """The upper 48 bits of sorted hashes, six bytes each: what is kept of a shingle set to compare it (two shingles of one pair of sets of 300 are
    mixed up with a chance of 10^-9)."""
    return np.unique(values >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def outline(values: np.ndarray) -> np.ndarray:
    """OUTLINE bits in three integers; each says whether an odd number of the set's elements fall on it. Where two outlines differ, the sets differ in
    an element at least, so the number of differing bits is never above the number of elements that only one of the sets has."""
    odd = np.bincount((values % np.uint64(OUTLINE)).astype(np.int64), minlength=OUTLINE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketches(df: DataFrame, id_col: str, fields: list[str], size: int = SHINGLE, least: int = LEAST_WORDS, seed: int = 0) -> DataFrame:
    """id, field, node, class, n, x0, x1, x2, sh of each text with enough words: its packed shingle set of n elements with its outline, the 128-bit hash
    of the field and the set (``class``: equal sets are copies) and the first half of it (``node``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for field in fields:
                narrow = pa.RecordBatch.from_arrays([b.column("id"), b.column(field)], names=["id", "text"])
                for part, texts in chunks(iter([narrow]), limit=500_000):
                    got = [(i, s) for i, t in zip(part.column("id").to_pylist(), texts, strict=True) if t and (s := shingles(t, size, least)) is not None]
                    if not got:
                        continue
                    classes = [hashlib.blake2b(s.tobytes(), digest_size=16, key=f"{seed} {field}".encode()[:64]).digest() for _, s in got]
                    sets = [packed(s) for _, s in got]
                    lines = np.array([outline(unpacked(x)) for x in sets])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i for i, _ in got], pa.int64()), pa.array([field] * len(got), pa.string()), pa.array(np.frombuffer(b"".join(c[:8] for c in classes), np.int64)), pa.array(classes, pa.binary()), pa.array([len(x) // 6 for x in sets], pa.int32()), *[pa.array(lines[:, k]) for k in range(3)], pa.array(sets, pa.binary())],
                        names=["id", "field", "node", "class", "n", "x0", "x1", "x2", "sh"],
                    )

    return df.select(F.col(id_col).cast("bigint").alias("id"), *fields).where("id is not null").mapInArrow(run, "id bigint, field string, node bigint, class binary, n int, x0 bigint, x1 bigint, x2 bigint, sh binary")


def _bands(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Of each batch the places of nodes that the task hasn't met yet (copies have the same bands), and their band keys."""
    mm = MinMax(bands, rows)
    met: set[int] = set()
    for b in batches:
        at, keys = [], []
        for k, (field, node) in enumerate(zip(b.column("field").to_pylist(), b.column("node").to_pylist(), strict=True)):
            if node not in met:
                if len(met) > 2_000_000:
                    met.clear()
                met.add(node)
                at.append(k)
                keys.append(mm.bands_of(unpacked(b.column("sh")[k].as_py())) ^ np.uint64(_word(field)))  # texts of different fields never meet
        if at:
            yield b, np.array(at), np.array(keys)


def banded(sets: DataFrame, bands: int, rows: int, only: np.ndarray | None = None) -> DataFrame:
    """key, node: the band keys of every node, or those of them that are in ``only`` (sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at, keys in _bands(batches, bands, rows):
            key, node = keys.ravel().view(np.int64), np.repeat(b.column("node").to_numpy()[at], bands)
            if only is not None:
                mine = _among(key, only)
                key, node = key[mine], node[mine]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], names=["key", "node"])

    return sets.select("field", "node", "sh").mapInArrow(run, "key bigint, node bigint")


def _among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values if len(some) else np.zeros(len(values), bool)


#: A node in one part of the band keys: its size, outline and number of keys in the part; the keys (40 bits each) stand behind all nodes.
_HEAD = np.dtype([("node", "<i8"), ("x", "<i8", 3), ("n", "<i4"), ("keys", "<u2")])


def parted(sets: DataFrame, bands: int, rows: int, parts: int, without: np.ndarray) -> DataFrame:
    """part, body: the band keys that aren't in ``without`` (sorted), parted by key; a body holds the nodes of a batch with their keys in that part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at, keys in _bands(batches, bands, rows):
            key, place = keys.ravel(), np.repeat(np.arange(len(at)), bands)
            if len(without):
                light = ~_among(key.view(np.int64), without)
                key, place = key[light], place[light]
            part = ((key >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((place, part))
            key, place, part = key[order], place[order], part[order]
            head = np.zeros(len(at), _HEAD)
            head["node"], head["n"], head["x"] = b.column("node").to_numpy()[at], b.column("n").to_numpy()[at], np.stack([b.column(f"x{k}").to_numpy()[at] for k in range(3)], axis=1)
            ends = np.searchsorted(part, np.arange(parts + 1))
            held = [int(p) for p in range(parts) if ends[p] < ends[p + 1]]
            bodies = []
            for p in held:
                mine = slice(ends[p], ends[p + 1])
                who, many = np.unique(place[mine], return_counts=True)
                heads = head[who]
                heads["keys"] = many
                bodies.append(len(who).to_bytes(4, "little") + heads.tobytes() + key[mine].view(np.uint8).reshape(-1, 8)[:, :5].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(bodies, pa.binary())], names=["part", "body"])

    return sets.select("field", "node", "n", "x0", "x1", "x2", "sh").mapInArrow(run, "part int, body binary")


def _pairs_of(numerator: int, denominator: int):
    """A mapInArrow function: of one part the distinct pairs (a, b; a < b) of nodes that share a key and that size and outline allow to be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, keys = [], []
        for b in batches:
            for body in b.column("body"):
                raw = body.as_buffer()
                size = 4 + int.from_bytes(raw[:4].to_pybytes(), "little") * _HEAD.itemsize
                heads.append(np.frombuffer(raw[4:size], _HEAD).copy())
                wide = np.zeros(((raw.size - size) // 5, 8), np.uint8)
                wide[:, :5] = np.frombuffer(raw[size:], np.uint8).reshape(-1, 5)
                keys.append(wide.view(np.uint64).ravel())
        if not heads:
            return
        head, key = np.concatenate(heads), np.concatenate(keys)
        node, first, place = np.unique(head["node"], return_index=True, return_inverse=True)
        who = np.repeat(place, head["keys"]).astype(np.int64)
        n, x = head["n"][first].astype(np.int64), head["x"][first].view(np.uint64)
        order = np.lexsort((who, key))
        key, who = key[order], who[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (who[1:] != who[:-1])]  # copies that different tasks put out
        key, who = key[new], who[new]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        end = np.repeat(start + size, size)
        del key, order, new, heads, keys
        told, held = np.empty(0, np.int64), []

        def allowed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            both = n[i] + n[j]
            fits = np.minimum(n[i], n[j]) * denominator >= np.maximum(n[i], n[j]) * numerator
            return fits & (np.bitwise_count(x[i] ^ x[j]).sum(axis=1, dtype=np.int64) * (denominator + numerator) <= both * (denominator - numerator))

        at, step = np.arange(len(who)), 0
        while len(at):  # each member with the one ``step`` places behind it
            step += 1
            at = at[at + step < end[at]]
            for c in range(0, len(at), CHUNK):
                i, j = who[at[c : c + CHUNK]], who[at[c : c + CHUNK] + step]
                good = allowed(i, j)
                held.append(i[good] * len(node) + j[good])
            if sum(map(len, held)) > TASK_ROWS:  # put out what is new; told twice is told once after the shuffle
                told, held = np.unique(np.concatenate(held)), []
                yield from _told(told, node)
        yield from _told(np.unique(np.concatenate(held)) if held else told[:0], node)

    return run


def _told(pairs: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
    for c in range(0, len(pairs), CHUNK):
        i, j = np.divmod(pairs[c : c + CHUNK], len(node))
        yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])


def nominated(sets: DataFrame, reps: DataFrame, bands: int, rows: int, numerator: int, denominator: int, block: int = BLOCK) -> DataFrame:
    """Distinct pairs (a, b; a < b) of nodes that share a key, without those that can't be similar. ``sets``: as ``sketches`` gives them; ``reps``:
    node, n, x0, x1, x2, each node once.

    Most pairs that share a key have little else in common, and their number grows faster than the nodes. So sizes and outlines travel with the keys,
    and a pair whose outlines differ in more bits than similar sets have elements apart is never written; no similar pair is lost by that.

    One shuffle by key, in bodies that name a node once in each part; a task holds one part. A key on more than ``block`` nodes and more than
    1 / HOT_PARTS of them is hot: it goes another way, where each member meets the others block by block in tasks of their own, so no task reads a
    whole hot bucket. Hot keys are told from one node in SAMPLED, chosen by hash; this only decides which way a bucket takes, every pair comes out
    either way. There can't be more than bands x HOT_PARTS hot keys, which bounds their broadcast.
    """
    nodes = reps.count()
    most = max(block, nodes // HOT_PARTS)
    sample = banded(sets.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLED)) == 0), bands, rows)
    hot = cut(sample.distinct().groupBy("key").agg((F.count(F.lit(1)) * SAMPLED).alias("m")).where(F.col("m") > most).select("key", F.ceil(F.col("m") / block).cast("int").alias("blocks")))
    keys = np.array(sorted(r.key for r in hot.select("key").toLocalIterator()), np.int64)
    parts = max(min(shuffle_partitions(sets.sparkSession), LEAST_PARTS), -(-nodes * bands // TASK_ROWS))
    out = parted(sets, bands, rows, parts, keys).repartitionById(parts, F.col("part")).mapInArrow(_pairs_of(numerator, denominator), "a bigint, b bigint")
    if len(keys):
        facts = reps.select("node", "n", "x0", "x1", "x2")
        shared = banded(sets, bands, rows, keys).distinct().join(F.broadcast(hot), "key").join(facts, "node")
        side = lambda c: [F.col("node").alias(c), F.col("n").alias(f"n{c}"), *[F.col(f"x{k}").alias(f"{c}{k}") for k in range(3)]]
        left = shared.select("key", *side("a"), F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("blk"))
        right = shared.select("key", *side("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"))
        apart = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(1, 3)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
        fits = F.least("na", "nb") * denominator >= F.greatest("na", "nb") * numerator
        heavy = left.join(right, ["key", "blk"]).where((F.col("a") < F.col("b")) & fits & (apart * (denominator + numerator) <= (F.col("na") + F.col("nb")) * (denominator - numerator)))
        out = out.unionByName(heavy.select("a", "b"))
    return out.distinct()


def _of(df: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of ``df`` whose node is in ``asked``, each there once. A bitmap of ASKED_BITS bits, 64 to a row, is broadcast first, so that the others aren't
    shuffled (the last join is no semi join, which Spark would move before that)."""
    slot = F.pmod("node", F.lit(ASKED_BITS))
    word, bit = F.shiftright(slot, 6).alias("_word"), F.expr(f"shiftleft(1L, cast(pmod(node, {ASKED_BITS}L) & 63L as int))")
    marks = asked.select(word, bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    some = df.withColumn("_word", word).join(F.broadcast(marks), "_word").where(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")
    return some.join(asked, "node")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sa, sb = b.column("sa"), b.column("sb")
        shared = [len(np.intersect1d(unpacked(sa[k].as_py()), unpacked(sb[k].as_py()), assume_unique=True)) for k in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), b.column("na"), b.column("nb"), pa.array(shared, pa.int32())], names=["a", "b", "na", "nb", "shared"])


def similar_classes(df: DataFrame, id_col: str, fields: list[str], numerator: int = 3, denominator: int = 5, size: int = SHINGLE, least: int = LEAST_WORDS, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(membership, pairs): each text's representative, and pairs of representatives with similarity >= numerator/denominator.

    ``membership``: field, id, rep (the smallest id with the same shingle set). ``pairs``: field, a, b, shared, united with a < b. A text that is null,
    empty or has too few words takes part in neither; copies collapse to their representative before any pair is made; rows that repeat an id
    count once; other columns of ``df`` are ignored; an empty table gives two empty tables.
    """
    for seed in range(8):
        all_ = cut(sketches(df, id_col, fields, size, least, seed))
        facts = [F.first(c).alias(c) for c in ("field", "n", "x0", "x1", "x2")]
        reps = cut(all_.groupBy("node").agg(F.min("id").alias("rep"), *facts, F.min("class").alias("lo"), F.max("class").alias("hi")))
        if reps.where("lo <> hi").isEmpty():  # no two classes share their first half
            break
    else:
        raise RuntimeError("hashes of classes keep meeting")
    members = lookup(all_.select("field", "id", "node"), reps.select("node", "rep"), ["node"]).select("field", "id", "rep").distinct()
    na, nb = (reps.select(F.col("node").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    pairs = cut(nominated(all_, reps, bands, rows, numerator, denominator, block).join(na, "a").join(nb, "b"))
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _of(all_.select("node", "sh"), asked).dropDuplicates(["node"])
    a, b = (sets.select(F.col("node").alias(x), F.col("sh").alias(f"s{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "sa", "sb")
    near = both.mapInArrow(_compare, "a bigint, b bigint, na int, nb int, shared int").withColumn("united", F.col("na") + F.col("nb") - F.col("shared")).where(F.col("shared") * denominator >= F.col("united") * numerator)
    ra, rb = reps.select(F.col("node").alias("a"), F.col("rep").alias("x"), "field"), reps.select(F.col("node").alias("b"), F.col("rep").alias("y"))
    return members, near.join(ra, "a").join(rb, "b").select("field", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared", "united")


def expand(members: DataFrame, pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs of ids (a < b): of different representatives, and of copies of one. Copies of one text meet in blocks of ``block`` of them."""
    ma, mb = members.select("field", F.col("id").alias("x"), F.col("rep").alias("a")), members.select("field", F.col("id").alias("y"), F.col("rep").alias("b"))
    far = pairs.select("field", "a", "b").join(ma, ["field", "a"]).join(mb, ["field", "b"]).select("x", "y")
    many = members.groupBy("field", "rep").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("field", "rep", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    copies = lookup(members, many, ["field", "rep"])
    left = copies.select("field", "rep", F.col("id").alias("x"), F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("blk"))
    right = copies.select("field", "rep", F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"))
    near = left.join(right, ["field", "rep", "blk"]).where("x < y").select("x", "y")
    return far.unionByName(near).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
