"""Whole texts as one byte buffer, for numpy inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def chunks(batch: pa.RecordBatch, column: int, most: int = 1 << 20, gap: int = 4) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, buffer, starts, ends): texts of a binary column laid out with ``gap`` spaces around each.

    A chunk holds about ``most`` bytes; a longer text is a chunk of its own.
    """
    texts = [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= most):
            size += len(texts[end])
            end += 1
        pad = b" " * gap
        buffer = np.frombuffer(pad + pad.join(texts[at:end]) + pad, np.uint8)
        lengths = np.fromiter(map(len, texts[at:end]), np.int64, end - at)
        ends = np.cumsum(lengths + gap)
        yield at, end, buffer, ends - lengths, ends
        at = end
