"""Arrow batches inside tasks: rows one by one in, batches of bounded bytes out.

What Python makes of a row (strings, lists, dictionaries) takes many times the bytes of
the row, so no more rows than fill a small batch are held at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes that the rows of a batch are made of (a single larger row is one).
SLICE = 1 << 20
#: What a row counts for besides its bytes.
ROW = 256


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        columns = [(name, batch.column(k)) for k, name in enumerate(batch.schema.names)]
        for k in range(batch.num_rows):
            yield {name: column[k].as_py() for name, column in columns}


def batched(rows: Iterator[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows, given with the number of bytes that each is made of, as batches."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n + ROW
        if size >= SLICE:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)
