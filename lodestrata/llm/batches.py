"""Helpers for operators that read text in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters handled at once inside a Python worker; a single longer text is handled alone.
CHUNK_CHARS = 2_000_000


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches with at most ``limit`` characters of ``text`` (or one row)."""
    for b in batches:
        texts = b.column(text).to_pylist()
        start, size = 0, 0
        for i, t in enumerate(texts):
            n = len(t) if t else 0
            if i > start and size + n > limit:
                yield b.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += n
        if start < len(texts):
            yield b.slice(start), texts[start:]


def mix(ids: np.ndarray) -> np.ndarray:
    """64-bit mixing of integers (splitmix64)."""
    x = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
