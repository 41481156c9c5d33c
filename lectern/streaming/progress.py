"""Progress events as a stream: the latest state of every job, kept by an aggregation, and the tail of each job, kept as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from threading import Event

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lectern.operators.jobs import TERMINAL, latest
from lectern.storage import discard, new_path, written

#: What events say of a job.
FIELDS = {"status": "string", "progress_pct": "double", "current_chapter": "string"}


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Events from Parquet files as they appear under a path or glob."""
    return spark.readStream.schema(schema).parquet(path)


def subscribe(stream: DataFrame, job_id, take: Callable[[Iterator[Row]], None], checkpoint: str) -> StreamingQuery:
    """Hands the events of one job to ``take`` as they arrive, those already there first; the driver holds a partition of them at a time."""

    def batch(rows: DataFrame, _: int) -> None:
        take(rows.orderBy("ts", "event_id").toLocalIterator())

    return stream.filter(F.col("job_id") == F.lit(job_id)).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(spark: SparkSession, path: str, schema, job_id, take: Callable[[Iterator[Row]], None], checkpoint: str, seconds: int = 1) -> None:
    """Hands ``take`` the state of a job as it is now, then its other events as they arrive; ends with the terminal one, or at once if the job is over.

    One read of the job's events gives both the state and what the tail knows already, so
    an event that is written meanwhile comes through the tail, whatever its time.
    """
    own = written(spark.read.schema(schema).parquet(path).filter(F.col("job_id") == F.lit(job_id)))
    now = fold(own).first()
    take(iter([] if now is None else [now]))
    if now is not None and not own.filter(F.col("status").isin(*TERMINAL)).isEmpty():
        discard(own)
        return
    over = Event()

    def batch(rows: DataFrame, _: int) -> None:
        # The rows of a batch would be made, and the state changed, once for each use.
        table = written(rows)
        take(table.orderBy("n").toLocalIterator())
        if not table.filter("last").isEmpty():
            over.set()
        discard(table)

    stream = event_stream(spark, path, schema).filter(F.col("job_id") == F.lit(job_id))
    query = _started(tail(stream, own), batch, checkpoint, {"processingTime": f"{seconds} seconds"})
    while query.isActive and not over.wait(0.2):
        pass
    failure = query.exception()
    query.stop()
    discard(own)
    if failure is not None:
        raise failure


def _started(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict) -> StreamingQuery:
    """A query with its state in RocksDB, which keyed state needs; the session's own choice comes back."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return stream.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    finally:
        conf.set(name, before)


class _Tail(StatefulProcessor):
    """Of a job the ids of its events, and each field as the latest event that has it says."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "event_id long", "at long")
        fields = ", ".join(f"{f} {kind}, {f}_at long, {f}_id long" for f, kind in FIELDS.items())
        self.now = handle.getValueState("now", f"n long, over boolean, at long, id long, {fields}")

    def _state(self) -> dict:
        names = ["n", "over", "at", "id", *(f"{f}{x}" for f in FIELDS for x in ("", "_at", "_id"))]
        return dict(zip(names, self.now.get() if self.now.exists() else (0, False, *[None] * (len(names) - 2)), strict=True))

    def _add(self, now: dict, event: Row) -> bool | None:
        """Adds an event; whether it is late, or null where it changes nothing."""
        if now["over"] or (event.event_id is not None and self.seen.containsKey((event.event_id,))):
            return None
        place = _place(event.at, event.event_id)
        if event.event_id is not None:
            self.seen.updateValue((event.event_id,), (event.at,))
        late = now["n"] > 0 and place < _place(now["at"], now["id"])
        now["n"] += 1
        if not late:
            now["at"], now["id"] = event.at, event.event_id
        for f in FIELDS:
            told = (now[f] is not None and place < _place(now[f"{f}_at"], now[f"{f}_id"])) or event[f] is None
            if not told:
                now[f], now[f"{f}_at"], now[f"{f}_id"] = event[f], event.at, event.event_id
        now["over"] = event.status in TERMINAL
        return late

    def _keep(self, now: dict) -> None:
        self.now.update(tuple(now.values()))
        if now["over"]:
            # Nothing changes a job that is over: only that is remembered.
            self.seen.clear()

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        now = self._state()
        if self._add(now, initialState) is not None:
            self._keep(now)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        now, changed = self._state(), False
        for event in sorted(rows, key=lambda e: _place(e.at, e.event_id)):
            late = self._add(now, event)
            if late is not None:
                changed = True
                told = {f"{f}_now": now[f] for f in FIELDS}
                yield Row(job_id=key[0], event_id=event.event_id, at=event.at, **{f: event[f] for f in FIELDS}, n=now["n"], late=late, last=now["over"], **told)
        if changed:
            self._keep(now)

    def close(self) -> None:
        pass


def _place(at: int | None, event_id: int | None) -> tuple:
    """Nulls come first."""
    return (at is not None, at or 0, event_id is not None, event_id or 0)


def tail(stream: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Each new event once, with the number it has in its job, whether it is late and whether it is the last, and the fields as they are then.

    ``stream`` has job_id, event_id, ts and the fields; ``known`` are events that are not
    told again. State is kept by job: repeated events (by id) change nothing, late ones
    (before an event that came already) are told but change no field that a later event
    set, and after a terminal one the job is over. Events of a batch come in order of time
    and id; a batch (``maxFilesPerTrigger``) bounds what a task sorts. An event without id
    is never taken for a repeat.
    """
    kind = stream.schema["ts"].dataType.simpleString()
    columns = ["job_id", F.col("event_id").cast("long").alias("event_id"), _number(F.col("ts"), kind).alias("at"), *[F.col(f).cast(t).alias(f) for f, t in FIELDS.items()]]
    fields = ", ".join(f"{f} {t}" for f, t in FIELDS.items())
    schema = f"job_id {stream.schema['job_id'].dataType.simpleString()}, event_id long, at long, {fields}, n long, late boolean, last boolean, " + ", ".join(f"{f}_now {t}" for f, t in FIELDS.items())
    told = stream.select(*columns).groupBy("job_id").transformWithState(_Tail(), schema, "Append", "None", None if known is None else known.select(*columns).groupBy("job_id"))
    return told.withColumn("at", _time(F.col("at"), kind)).withColumnRenamed("at", "ts")


_DAY, _HOUR, _MINUTE = 86_400_000_000, 3_600_000_000, 60_000_000


def _number(ts: Column, kind: str) -> Column:
    """A time as a whole number, of microseconds where it is a timestamp; one without zone never passes through the session's."""
    if kind == "timestamp_ntz":
        return F.unix_date(ts.cast("date")).cast("long") * _DAY + F.hour(ts).cast("long") * _HOUR + F.minute(ts).cast("long") * _MINUTE + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return F.unix_micros(ts) if kind == "timestamp" else ts.cast("long")


def _time(at: Column, kind: str) -> Column:
    if kind == "timestamp_ntz":
        day, rest = F.date_from_unix_date(F.floor(at / _DAY).cast("int")), F.pmod(at, F.lit(_DAY))
        clock = [F.floor(rest / _HOUR).cast("int"), F.floor(F.pmod(rest, F.lit(_HOUR)) / _MINUTE).cast("int"), F.pmod(rest, F.lit(_MINUTE)).cast("decimal(20,6)") / 1_000_000]
        return F.make_timestamp_ntz(F.year(day), F.month(day), F.day(day), *clock)
    return F.timestamp_micros(at) if kind == "timestamp" else at.cast(kind)


def tail_available(stream: DataFrame) -> DataFrame:
    """The tail of all events that are there now, a table in the shared folder."""
    spark, told = stream.sparkSession, tail(stream)
    base, made = new_path(spark), []

    def batch(rows: DataFrame, number: int) -> None:
        path = f"{base}/table-{number}"
        rows.write.mode("overwrite").parquet(path)
        made.append(path)

    _started(told, batch, f"{base}/checkpoint", {"availableNow": True}).awaitTermination()
    return spark.read.schema(told.schema).parquet(*made) if made else spark.createDataFrame([], told.schema)


def fold(events: DataFrame) -> DataFrame:
    """By job the last status, percentage and chapter; replayed events change nothing, ties go to the higher id."""
    return latest(events, "job_id", ["ts", "event_id"], list(FIELDS))


def fold_available(stream: DataFrame) -> DataFrame:
    """The fold of all events that are there now, by a streaming query that ends with them; a table in the shared folder, of which the driver holds no row."""
    spark, folded = stream.sparkSession, fold(stream)
    base, last = new_path(spark), []

    def batch(rows: DataFrame, number: int) -> None:
        path = f"{base}/table-{number}"
        rows.write.mode("overwrite").parquet(path)
        last[:] = [path]

    query = folded.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(folded.schema).parquet(*last) if last else spark.createDataFrame([], folded.schema)
