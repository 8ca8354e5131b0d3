"""Arrow batches in and out of the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Texts are worked on in pieces of about this many characters, whole texts each, however long one is.
PIECE_CHARS = 2_000_000


def pieces(texts: list[str | None], chars: int = PIECE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together have about so many characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow, fn being given one batch after another; an empty batch gives nothing."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(work, schema)
