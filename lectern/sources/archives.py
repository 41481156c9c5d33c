"""Entries of zip archives as rows: a data source that reads archives in parallel, large ones by parts.

``spark.read.format("zip_entries").load(place)`` gives a row per entry; the reader lists the
archives under the place, deals small ones out by bytes, and of a large one reads the
directory to deal out its entries. ``entries`` makes the same rows of a ``binaryFile`` read,
for stores that only Spark's own readers open; there an archive is one value.

Edge cases: a file that is no archive gives one row with an error and no entry, and so does
an entry that cannot be unpacked (with its name); of entries with one name the last counts;
folders are no entries; an empty file or a place without files gives no rows but errors.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "zip_entries"
SCHEMA = "path string, entry string, size long, content binary, error string"
_ARROW = pa.schema([("path", pa.string()), ("entry", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
#: Packed bytes of a partition; a larger archive is dealt out by entries.
SPLIT = 64 << 20
#: Unpacked bytes of a batch (a larger entry is one).
BATCH = 16 << 20


def failed(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def unpacked(path: str, opened: BinaryIO, wanted: re.Pattern, names: tuple[str, ...] | None = None) -> Iterator[tuple]:
    """Rows of an archive, or of some of its entries; what cannot be read is a row with an error."""
    try:
        archive = zipfile.ZipFile(opened)
        listed = {i.filename: i for i in archive.infolist() if not i.is_dir()}
    except Exception as error:  # noqa: BLE001 (whatever a damaged archive leads to)
        yield path, None, None, None, failed(error)
        return
    for name in listed if names is None else names:
        info, content, said = listed[name], None, None
        if wanted.search(name):
            try:
                content = archive.read(info)
            except Exception as error:  # noqa: BLE001
                said = failed(error)
        yield path, name, info.file_size, content, said


def batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3] or b"")
        if size > BATCH or len(held) >= 10_000:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


@dataclass
class Part(InputPartition):
    """Archives, each whole or (with names) by some of its entries."""

    archives: list[tuple[str, tuple[str, ...] | None]]


class ZipReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.place, self.split = options["path"], int(options.get("split", SPLIT))
        self.wanted = options.get("entries", "")

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.place) if re.match(r"\w+:/", self.place) else (fs.LocalFileSystem(), self.place)

    def partitions(self) -> list[Part]:
        store, place = self._store()
        info = store.get_file_info(place)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(place, recursive=True))
        parts, held, size = [], [], 0
        for f in sorted((f for f in found if f.is_file), key=lambda f: f.path):
            if f.size > self.split and (pieces := self._pieces(store, f.path)):
                parts += [Part([(f.path, names)]) for names in pieces]
                continue
            if held and size + f.size > self.split:
                parts.append(Part(held))
                held, size = [], 0
            held.append((f.path, None))
            size += f.size
        return [*parts, Part(held)] if held or not parts else parts

    def _pieces(self, store: fs.FileSystem, path: str) -> list[tuple[str, ...]]:
        """The entries of a large archive in runs of bounded packed size; none if its directory cannot be read."""
        try:
            with store.open_input_file(path) as opened:
                listed = {i.filename: i for i in zipfile.ZipFile(opened).infolist() if not i.is_dir()}
        except Exception:  # noqa: BLE001 (the task that reads it says what is wrong)
            return []
        runs, size = [[]], 0
        for name, info in listed.items():
            if runs[-1] and size + info.compress_size > self.split:
                runs.append([])
                size = 0
            runs[-1].append(name)
            size += info.compress_size
        return [tuple(r) for r in runs if r]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()
        wanted = re.compile(self.wanted)

        def rows() -> Iterator[tuple]:
            for path, names in partition.archives:
                try:
                    opened = store.open_input_file(path)
                except OSError as error:
                    yield path, None, None, None, failed(error)
                    continue
                with opened:
                    yield from unpacked(path, opened, wanted, names)

        yield from batches(rows())


class ZipEntries(DataSource):
    """Options: ``split`` (packed bytes of a partition), ``entries`` (a pattern: others are listed without content)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ZipReader:
        return ZipReader(self.options)


def zip_entries(spark: SparkSession, place: str, **options: object) -> DataFrame:
    """path, entry, size, content, error of all entries of the archives under a place."""
    spark.dataSource.register(ZipEntries)
    return spark.read.format(FORMAT).options(**{k: str(v) for k, v in options.items()}).load(place)


def entries(files: DataFrame, wanted: str = "") -> DataFrame:
    """The same rows of archives as values (path, content)."""

    def read(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(wanted)
        for batch in given:
            for k in range(batch.num_rows):
                content = batch.column("content")[k].as_py()
                yield from batches(unpacked(batch.column("path")[k].as_py(), io.BytesIO(content or b""), pattern))

    return files.select("path", "content").mapInArrow(read, SCHEMA)
