"""Tables of rows with an id that several writers add to and change, as Parquet folders and a list of versions.

A version is a small file that names the folders of rows and of changes that make up the
table. It is written by whoever is first to create the next number; a writer that comes
second looks at what the other one added, refuses ids that are there by now, and tries the
next number. Folders that no version names do not exist for readers, so a job that fails or
is killed leaves the table as it was. Changes are merged when the table is read: of each
field the last change that has it counts. ``compact`` writes rows and changes together as
rows, and ``sweep`` deletes folders that no version needs.

Edge cases: rows with an id that the table has are refused (left out), and of rows with one
id in a batch the smallest is added; rows with a null id are refused, for an id is what
tells rows apart; changes of ids that the table does not have wait for them; a change that
leaves a field null leaves it as it is; a table without versions is empty.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.storage import delete, put_if_absent

#: Commits that may fail because others were first, before giving up.
ATTEMPTS = 100
_VERSION = re.compile(r"^(\d{12})\.json$")


@dataclass
class Version:
    number: int = 0
    rows: list[str] = field(default_factory=list)
    changes: list[str] = field(default_factory=list)


@dataclass
class Table:
    spark: SparkSession
    path: str
    schema: StructType
    key: str = "id"

    def _names(self) -> list[str]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []

    def version(self, number: int | None = None) -> Version:
        """The last version, or one by number."""
        numbers = [int(m[1]) for n in self._names() if (m := _VERSION.match(n))]
        if number is None:
            number = max(numbers, default=0)
        if number == 0:
            return Version()
        said = self.spark.read.text(f"{self.path}/versions/{number:012d}.json", wholetext=True).first()[0]
        return Version(number, **json.loads(said))

    def _commit(self, base: Version, rows: list[str], changes: list[str]) -> bool:
        text = json.dumps({"rows": rows, "changes": changes})
        return put_if_absent(self.spark, f"{self.path}/versions/{base.number + 1:012d}.json", text)

    def _new_folder(self, data: DataFrame) -> str:
        name = uuid.uuid4().hex
        data.write.parquet(f"{self.path}/data/{name}")
        return name

    def _drop_folder(self, name: str) -> None:
        delete(self.spark, f"{self.path}/data/{name}")

    def _read(self, folders: list[str], schema: StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def _last(self, changes: list[str]) -> DataFrame:
        """By id the last value of each field in some folders of changes."""
        fields = [c for c in self.schema.names if c != self.key]
        told = reduce(DataFrame.unionByName, [self._read([name], self.schema).withColumn("_n", F.lit(n)) for n, name in enumerate(changes)])
        return told.groupBy(self.key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_n"))).alias(c) for c in fields])

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of the last version, or of another one, with their changes."""
        at = self.version(number)
        rows = self._read(at.rows, self.schema)
        fields = [c for c in self.schema.names if c != self.key]
        if not at.changes or not fields:
            return rows
        last = self._last(at.changes).withColumnsRenamed({c: f"_{c}" for c in fields})
        return rows.join(last, self.key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in self.schema.names])

    def append(self, rows: DataFrame) -> int:
        """Adds the rows whose id is new, all of them or none; gives the number of the version that has them."""
        rows = rows.select(*self.schema.names).filter(F.col(self.key).isNotNull())
        once = rows.groupBy(self.key).agg(F.min(F.struct(*self.schema.names)).alias("_row")).select("_row.*")
        base = self.version()
        known = self._read(base.rows, self.schema).select(self.key)
        folder = self._new_folder(once.join(known, self.key, "left_anti").select(*self.schema.names) if base.rows else once)
        try:
            for _ in range(ATTEMPTS):
                if self._commit(base, [*base.rows, folder], base.changes):
                    return base.number + 1
                # Only what others added since then can have ids of ours.
                now = self.version()
                since = [f for f in now.rows if f not in base.rows]
                mine = self._read([folder], self.schema)
                theirs = self._read(since, self.schema).select(self.key)
                if since and not mine.join(theirs, self.key, "left_semi").isEmpty():
                    older, folder = folder, self._new_folder(mine.join(theirs, self.key, "left_anti").select(*self.schema.names))
                    self._drop_folder(older)
                base = now
            raise RuntimeError(f"{self.path}: others were first {ATTEMPTS} times")
        except BaseException:
            self._drop_folder(folder)
            raise

    def change(self, changes: DataFrame) -> int:
        """Sets fields of rows by id (fields that are missing or null stay); gives the number of the version that says so."""
        missing = [f for f in self.schema if f.name not in changes.columns]
        told = changes.select(*changes.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing]).select(*self.schema.names)
        folder = self._new_folder(told.filter(F.col(self.key).isNotNull()))
        return self._rebased(lambda base: (base.rows, [*base.changes, folder]), [folder])

    def compact(self) -> int:
        """Rows and changes written together as rows; what comes in meanwhile is kept, and changes that wait for their rows."""
        base = self.version()
        folders = [self._new_folder(self.read(base.number))]
        if base.changes:
            waiting = self._last(base.changes).join(self._read(base.rows, self.schema).select(self.key), self.key, "left_anti")
            folders.append(self._new_folder(waiting.select(*self.schema.names)))

        def told(now: Version) -> tuple[list[str], list[str]]:
            if now.rows[: len(base.rows)] != base.rows or now.changes[: len(base.changes)] != base.changes:
                raise RuntimeError(f"{self.path}: compacted by another writer")
            return [folders[0], *now.rows[len(base.rows) :]], [*folders[1:], *now.changes[len(base.changes) :]]

        return self._rebased(told, folders)

    def _rebased(self, told: Callable[[Version], tuple[list[str], list[str]]], folders: list[str]) -> int:
        try:
            for _ in range(ATTEMPTS):
                base = self.version()
                if self._commit(base, *told(base)):
                    return base.number + 1
            raise RuntimeError(f"{self.path}: others were first {ATTEMPTS} times")
        except BaseException:
            for f in folders:
                self._drop_folder(f)
            raise

    def sweep(self, keep: int = 1) -> None:
        """Deletes folders that none of the last versions names, and older versions; only while nobody writes."""
        last = self.version().number
        kept = [self.version(n) for n in range(max(1, last - keep + 1), last + 1)]
        needed = {f for v in kept for f in v.rows + v.changes}
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for s in files.listStatus(place) if files.exists(place) else []:
            if s.getPath().getName() not in needed:
                files.delete(s.getPath(), True)
        for n in self._names():
            if (m := _VERSION.match(n)) and int(m[1]) <= last - keep:
                delete(self.spark, f"{self.path}/versions/{n}")
