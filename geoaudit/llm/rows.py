"""Groups of rows out of sorted Arrow batches, without gathering more than one group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import utf8


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with the same first ``keys`` columns (not null), from sorted rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            column = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= column[1:] != column[:-1]
            new[0] |= not held or held[-1].column(k)[-1].as_py() != column[0]
        at = [*np.flatnonzero(new).tolist(), batch.num_rows]
        if at[0] and held:
            held.append(batch.slice(0, at[0]))
        for b, e in zip(at[:-1], at[1:], strict=True):
            if held:
                yield pa.Table.from_batches(held)
            held = [batch.slice(b, e - b)]
    if held:
        yield pa.Table.from_batches(held)


def with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` as struct ``row``, and ``text`` beside it unless it is one of them, so that it is sent once."""
    row = F.struct(*(F.col("text").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in columns)).alias("row")
    return docs.select(row) if "text" in columns else docs.select(row, F.col("text").cast("string").alias("text"))


def text_of(batch: pa.RecordBatch) -> pa.Array:
    """The text that ``with_text`` has put in a batch."""
    if "text" in batch.schema.names:
        return batch.column("text")
    row = batch.column("row")
    return row.field(row.type.get_field_index("text"))


def document_batches(rows: Iterator[pa.RecordBatch], most_docs: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Whole documents in batches of bounded size, across those they came in; a longer document is one of its own."""
    held: list[pa.RecordBatch] = []
    docs = size = 0
    for batch in rows:
        _, at = utf8(batch.column("text"))
        row = 0
        while row < batch.num_rows:
            fit = int(np.searchsorted(at, at[row] + most_bytes - size, side="right")) - 1
            end = min(batch.num_rows, row + most_docs - docs, max(fit, row if held else row + 1))
            if end > row:
                held.append(batch.slice(row, end - row))
                docs, size, row = docs + end - row, size + int(at[end] - at[row]), end
            if row < batch.num_rows or docs == most_docs:
                yield _joined(held)
                held, docs, size = [], 0, 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
