"""Evaluation passages inside a corpus, by template canonicalisation.

Words (maximal runs of a-z and 0-9 after lower-casing) of prompts and documents are replaced by typed placeholders where they are numbers, units or
names; all windows of 13 canonical words of the documents are looked up in the hash table of the prompts' windows; matching windows are then checked
slot by slot. Equal values in all slots make an exact leak, a consistent one-to-one renaming of the slot values makes a re-parameterised one.
Canonicalisation works word by word, so equal windows of words always have equal canonical windows: no exact leak is lost.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.batches import chunks, mix

WINDOW = 13
#: Characters of prompts whose windows are broadcast at once; a larger test set is searched for in blocks of this size.
BLOCK_CHARS = 8_000_000
#: A word in fewer prompts than this fraction is a name; the others are the words of the templates.
NAME_SHARE = 0.05
UNITS = frozenset("bit bits byte bytes kb mb gb kib mib gib ms us ns sec seconds minutes hours hz khz mhz ghz percent".split())
NUMBER, UNIT, NAME = 0, 1, 2
_WORD = re.compile("[a-z0-9]+")


class _Numbers(dict):
    """Word -> running number."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Templates:
    """Windows of a block of prompts, ready to be probed."""

    def __init__(self, items: list[tuple[int, str]], lexicon: set[str]):
        self.vocabulary = _Numbers()
        words = [(i, _WORD.findall(p.lower())) for i, p in items]
        self.lexicon = {w: k + 3 for k, w in enumerate(sorted(lexicon))}
        ids, item, where = [], [], []
        for i, ws in words:
            start = len(ids)
            ids += map(self.vocabulary.__getitem__, ws)
            where += range(start, len(ids) - WINDOW + 1)
            item += [i] * max(0, len(ws) - WINDOW + 1)
        self.ids = np.array(ids, dtype=np.int64)
        self.kinds = self.canonical(list(self.vocabulary))
        pos = np.array(where, dtype=np.int64)
        h = self.hashes(self.kinds[self.ids])[pos] if len(pos) else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.h, self.pos, self.item = h[order], pos[order], np.array(item, dtype=np.int64)[order]
        self.filter = np.zeros(1 << 22, dtype=bool)
        self.filter[(self.h & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def canonical(self, words: list[str]) -> np.ndarray:
        lexicon = self.lexicon
        return np.array([NUMBER if "0" <= w[0] <= "9" else UNIT if w in UNITS else lexicon.get(w, NAME) for w in words], dtype=np.int64)

    @staticmethod
    def hashes(canonical: np.ndarray) -> np.ndarray:
        n = len(canonical) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        m, out = mix(canonical), np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(WINDOW):
                out += m[k : k + n] * (mix(np.array([k + 1_000_003]))[0] | np.uint64(1))
        return out

    def search(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching windows as (row, item, exact)."""
        vocabulary = _Numbers(self.vocabulary)
        ids, ends = [], []
        for t in texts:
            if t:
                ids += map(vocabulary.__getitem__, _WORD.findall(t.lower()))
            ends.append(len(ids))
        none = np.zeros(0, np.int64)
        if len(ids) < WINDOW or not len(self.h):
            return none, none, none.astype(bool)
        ids, ends = np.array(ids, dtype=np.int64), np.array(ends)
        known = len(self.vocabulary)
        kinds = np.r_[self.kinds, self.canonical(list(vocabulary)[known:])] if len(vocabulary) > known else self.kinds
        h = self.hashes(kinds[ids])
        at = np.flatnonzero(self.filter[(h & np.uint64(len(self.filter) - 1)).astype(np.int64)])
        row = np.searchsorted(ends, at, side="right")
        inside = at + WINDOW <= ends[row]
        at, row = at[inside], row[inside]
        lo, hi = np.searchsorted(self.h, h[at], "left"), np.searchsorted(self.h, h[at], "right")
        n = hi - lo
        out = []
        step = 200_000  # pairs of windows looked at together
        edges = np.r_[0, np.flatnonzero(np.diff(np.cumsum(n) // step)) + 1, len(at)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if not n[a:b].sum():
                continue
            k = np.repeat(np.arange(a, b), n[a:b])
            q = np.arange(n[a:b].sum()) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b]) + lo[k]
            mine = ids[at[k][:, None] + np.arange(WINDOW)]
            theirs = self.ids[self.pos[q][:, None] + np.arange(WINDOW)]
            exact = (mine == theirs).all(axis=1)
            fits = exact.copy()
            rest = np.flatnonzero(~exact)
            if len(rest):
                fits[rest] = _consistent(mine[rest], theirs[rest], kinds)
            out.append((row[k[fits]], self.item[q[fits]], exact[fits]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none.astype(bool))


def _consistent(mine: np.ndarray, theirs: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Same canonical words, and the slot values correspond one to one."""
    ok = (kinds[mine] == kinds[theirs]).all(axis=1)
    for i in range(WINDOW):
        for j in range(i):
            ok &= (mine[:, i] == mine[:, j]) == (theirs[:, i] == theirs[:, j])
    return ok


def leaks(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, exact_windows, template_windows for each document and item that share a window.

    ``docs`` has doc_id and text, ``items`` item_id and prompt. Null and empty texts, and prompts under 13 words, match nothing; equal rows of
    ``docs`` add up to one row; whole texts are searched; an empty table on either side gives no rows. Documents are read once per block of
    prompts and never shuffled as text; only the matches are.
    """
    spark = docs.sparkSession
    items = items.where("prompt is not null").select("item_id", "prompt")
    blocks = -(-(items.agg(F.sum(F.length("prompt"))).first()[0] or 0) // block_chars)
    n_items = items.count()
    # Words of the templates: counted over all prompts, pre-aggregated; at most (words per prompt) / NAME_SHARE of them can pass.
    words = items.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("prompt"), F.lit("([a-z0-9]+)"), 1))).alias("w"))
    lexicon = {r.w for r in words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(2, NAME_SHARE * n_items)).select("w").toLocalIterator()} if blocks else set()
    found = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).distinct().collect()
        shared = spark.sparkContext.broadcast(Templates([(r.item_id, r.prompt) for r in part], lexicon))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            templates = shared.value
            for rows, texts in chunks(batches):
                row, item, exact = templates.search(texts)
                if len(row):
                    doc = np.asarray(rows.column("doc_id").to_pylist(), dtype=object)
                    counts: Counter = Counter(zip(row.tolist(), item.tolist(), exact.tolist(), strict=True))
                    keys = {(r, i): None for r, i, _ in counts}
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc[r] for r, _ in keys], pa.int64()), pa.array([i for _, i in keys], pa.int64()), pa.array([counts[r, i, True] for r, i in keys], pa.int64()), pa.array([counts[r, i, False] for r, i in keys], pa.int64())],
                        names=["doc_id", "item_id", "exact_windows", "template_windows"],
                    )

        hits = docs.select("doc_id", "text").mapInArrow(search, "doc_id bigint, item_id bigint, exact_windows bigint, template_windows bigint")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, exact_windows bigint, template_windows bigint")
    return found.groupBy("doc_id", "item_id").agg(F.max("exact_windows").alias("exact_windows"), F.max("template_windows").alias("template_windows"))
