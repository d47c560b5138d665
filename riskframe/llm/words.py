"""Whole texts as lists of words, batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Characters and rows that are handled together at most (one text may be longer).
PART_CHARS = 2_000_000
PART_ROWS = 512


def parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with bounded text in ``column``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (held + n > PART_CHARS or i - start >= PART_ROWS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def split_words(text: str | None) -> list[bytes]:
    """Runs between ASCII white space (0x20, 0x09 to 0x0D), in order, in UTF-8."""
    return text.encode("utf-8", "replace").split() if text else []
