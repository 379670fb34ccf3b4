"""Arrow helpers and fold columns shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows, and bytes of text, that a Python step holds at once.
ROWS, BYTES = 2048, 16 << 20


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most ``rows`` rows and, unless a single row is larger, about ``most`` bytes."""
    for b in batches:
        at = 0
        step = max(1, min(rows, int(b.num_rows * most / max(b.nbytes, 1)) or 1))
        while at < b.num_rows:
            yield b.slice(at, step)
            at += step


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``f`` over bounded slices of ``df``, without a shuffle; ``f`` may return None for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if b.num_rows and (out := f(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def fold(doc_id: str | Column, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8")) % k


def utf8(c: str) -> Column:
    """UTF-8 bytes of a text column, null as empty."""
    return F.encode(F.coalesce(F.col(c), F.lit("")), "UTF-8")
