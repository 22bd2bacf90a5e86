"""Texts packed into containers of a fixed capacity.

The lengths modulo the capacity form a histogram of at most ``capacity`` bins, whatever the corpus. Shallow combinations of lengths that fill a
container exactly are enumerated, non-negative least squares finds how often to repeat each to use up the histogram, the counts are rounded down, and
what remains is packed greedily, again on the histogram. The resulting plan (pattern, repeats) is bounded by the capacity; texts find their place in
it by their rank within their length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm.batches import chunks
from lodestrata.session import cut

TOKENIZERS = "/opt/tokenizers"
#: Rows whose rank within a length one task finds.
RANK_ROWS = 200_000
#: Split pattern of the byte-level BPE vocabulary (fixed value of its public definition).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def encoding(folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken"):
    """The public byte-level BPE tokenizer from its rank file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(folder, name).read_bytes().splitlines())}
    return tiktoken.Encoding("bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, n_tokens of every non-empty text, counted over the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(folder).encode_ordinary
        for rows, texts in chunks(batches):
            n = [len(encode(t)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null and text <> ''").mapInArrow(run, "doc_id bigint, n_tokens bigint").where("n_tokens > 0")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x that minimises |a x - b|, by multiplicative updates (a and b are non-negative), which scale to many columns."""
    x = np.full(a.shape[1], b.sum() / max(a.sum(), 1))
    ab, aa = a.T @ b, a.T @ a
    for _ in range(rounds):
        x *= ab / np.maximum(aa @ x, 1e-12)
    return x


def combinations(hist: np.ndarray, capacity: int, most: int) -> list[tuple[int, ...]]:
    """Pairs and triples of present lengths that fill a container exactly, those with the most items to use first.

    ``most`` bounds the columns of the least-squares problem, not the items: what the combinations leave is packed greedily.
    """
    present = np.flatnonzero(hist)
    out: list[tuple[float, tuple[int, ...]]] = [(float(hist[capacity]), (capacity,))] if hist[capacity] else []
    for i, a in enumerate(present):
        if a * 2 <= capacity and hist[capacity - a]:
            out.append((float(min(hist[a], hist[capacity - a])), (int(capacity - a), int(a))))
        if a * 3 > capacity:
            continue
        b = present[i:]
        c = capacity - a - b
        ok = (c >= b) & (hist[np.clip(c, 0, capacity)] > 0)
        weight = np.minimum(np.minimum(hist[a], hist[b]), hist[np.clip(c, 0, capacity)])[ok]
        top = np.argsort(-weight, kind="stable")[:12]  # the best partners of each shortest length
        out += [(float(weight[k]), (int(c[ok][k]), int(b[ok][k]), int(a))) for k in top]
    out.sort(key=lambda x: (-x[0], x[1]))
    return [p for _, p in out[:most]]


def plan(hist: np.ndarray, capacity: int, most: int = 1500) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use up ``hist`` (items by length, index 0 unused) exactly."""
    left = hist.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    shapes = combinations(left, capacity, most)
    if shapes:
        a = np.zeros((capacity + 1, len(shapes)))
        for k, p in enumerate(shapes):
            for n in p:
                a[n, k] += 1
        scale = 1 / np.sqrt(np.maximum(left, 1.0))  # relative misfit: rare lengths count as well
        x = np.floor(nnls(a * scale[:, None], left * scale))
        for p, n in sorted(zip(shapes, x, strict=True), key=lambda y: -y[1]):
            need = {m: p.count(m) for m in p}
            n = int(min([n, *(left[m] // c for m, c in need.items())]))  # rounding must not overdraw a length
            if n > 0:
                out.append((p, n))
                for m, c in need.items():
                    left[m] -= n * c
    # Residuals: the longest first, then always the longest that still fits, repeated as often as the counts allow.
    at = capacity
    while True:
        while at > 0 and not left[at]:
            at -= 1
        if at == 0:
            return out
        shape, room, take = [at], capacity - at, left.copy()
        take[at] -= 1
        while room > 0:
            fits = np.flatnonzero(take[1 : room + 1])
            if not len(fits):
                break
            m = int(fits[-1]) + 1
            k = int(min(take[m], room // m))
            shape += [m] * k
            take[m] -= k
            room -= k * m
        need = {m: shape.count(m) for m in shape}
        n = int(min(left[m] // c for m, c in need.items()))
        out.append((tuple(shape), n))
        for m, c in need.items():
            left[m] -= n * c


class Slots:
    """Where the r-th item of each length goes: sorted intervals of ranks per length."""

    def __init__(self, shapes: list[tuple[tuple[int, ...], int]], capacity: int):
        used = np.zeros(capacity + 1, np.int64)
        length, start, container, offset = [], [], [], []
        base = 0
        for p, n in shapes:
            at = 0
            for m in p:
                length.append(m)
                start.append(used[m])
                container.append(base)
                offset.append(at)
                used[m] += n
                at += m
            base += n
        order = np.lexsort((start, length))
        self.key = np.array(length, np.int64)[order].astype(np.float64)
        self.length, self.start = np.array(length, np.int64)[order], np.array(start, np.int64)[order]
        self.container, self.offset, self.total = np.array(container, np.int64)[order], np.array(offset, np.int64)[order], base
        self.first = np.searchsorted(self.length, np.arange(capacity + 2))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = self.first[length], self.first[length + 1]
        begin = lo.copy()
        while (go := lo < hi).any():
            mid = (lo + hi) // 2
            right = go & (self.start[np.minimum(mid, len(self.start) - 1)] <= rank)
            lo, hi = np.where(right, mid + 1, lo), np.where(go & ~right, mid, hi)
        k = np.maximum(lo - 1, begin)
        return self.container[k] + rank - self.start[k], self.offset[k]


def pack(docs: DataFrame, capacity: int, folder: str = TOKENIZERS, rank_rows: int = RANK_ROWS) -> DataFrame:
    """doc_id, part, first_token, n_tokens, container, at: where each piece of each non-empty text lies.

    Texts up to ``capacity`` tokens are one piece; longer ones are cut into full containers and one rest. Null and empty texts have no piece; equal
    texts and repeated ids are placed once per row; an empty table gives none; other columns are ignored. Only the token counts are shuffled, never
    the texts; ranks are found in buckets of about ``rank_rows`` rows, so that a length shared by very many texts isn't one task's work.
    """
    spark = docs.sparkSession
    counts = cut(token_counts(docs, folder))
    rows = counts.count()
    buckets = max(1, -(-rows // rank_rows))
    rest = F.pmod("n_tokens", F.lit(capacity))
    pieces = counts.select("doc_id", "n_tokens", F.floor(F.col("n_tokens") / capacity).alias("full"), rest.cast("int").alias("rest"), F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket"))
    # Items by length and bucket: at most capacity x buckets counts; their sums over buckets are the histogram.
    sizes = pieces.where("rest > 0").groupBy("rest", "bucket").agg(F.count(F.lit(1)).alias("n"))
    hist = np.zeros(capacity + 1, np.int64)
    for r in sizes.groupBy("rest").agg(F.sum("n").alias("n")).collect():  # at most capacity - 1 rows
        hist[r.rest] = r.n
    slots = Slots(plan(hist, capacity), capacity)
    shared = spark.sparkContext.broadcast(slots)
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("rest").orderBy("bucket")) - F.col("n")).drop("n")
    ranked = pieces.where("rest > 0").withColumn("r", F.row_number().over(Window.partitionBy("rest", "bucket").orderBy("doc_id")) - 1).join(before, ["rest", "bucket"]).select("doc_id", "full", "rest", (F.col("r") + F.col("before")).cast("bigint").alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank, full = (b.column(c).to_numpy().astype(np.int64) for c in ("rest", "rank", "full"))
            container, at = shared.value.place(length, rank)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(full), pa.array(full * capacity), pa.array(length), pa.array([f"r{c}" for c in container]), pa.array(at)], names=["doc_id", "part", "first_token", "n_tokens", "container", "at"])

    out = "doc_id bigint, part bigint, first_token bigint, n_tokens bigint, container string, at bigint"
    # Rows that repeat a doc_id get containers of their own: their copies are numbered.
    long = pieces.where("full > 0").withColumn("copy", F.row_number().over(Window.partitionBy("doc_id").orderBy("n_tokens")))
    whole = long.select("doc_id", "copy", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("part")).select(
        "doc_id", "part", (F.col("part") * capacity).alias("first_token"), F.lit(capacity).cast("bigint").alias("n_tokens"), F.concat_ws(".", F.concat(F.lit("f"), F.col("doc_id")), "copy", "part").alias("container"), F.lit(0).cast("bigint").alias("at")
    )
    return ranked.mapInArrow(place, out).unionByName(whole)


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, and the fraction of the space that is used."""
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("filled"))
