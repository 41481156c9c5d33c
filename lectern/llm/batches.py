"""Arrow batches inside tasks: slices of bounded bytes and cached tokenizers."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that a task handles at a time (a single longer text is handled alone).
SLICE_BYTES = 8 << 20

_tokenizers: dict = {}


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose ``column`` has about ``most`` bytes at most."""
    ends = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < batch.num_rows:
        past = ends[at - 1] if at else 0
        to = max(at + 1, int(ends.searchsorted(past + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def tokenizer(path: str):
    """The tokenizer of a .json file, once per worker process."""
    if path not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def specials(path: str) -> list[str]:
    return [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
