"""Arrow helpers for operators that work batch by batch in Python workers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20, max_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about max_bytes in ``column`` (a single longer row makes a slice of its own)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if i > start and (total + size > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if len(sizes) > start:
            yield batch.slice(start, len(sizes) - start)


def with_columns(batch: pa.RecordBatch, keep: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    arrays = [batch.column(k) for k in keep] + list(new.values())
    return pa.RecordBatch.from_arrays(arrays, names=[*keep, *new])


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def record_batch(columns: Iterable[Iterable], schema: pa.Schema) -> pa.RecordBatch:
    """Python values column by column, in the types of the schema."""
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
