"""WAV bytes to samples and back, chunks joined to chapters, voice levels, and the place where a speech engine plugs in."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.speech import QUIET, SAMPLE_RATE, WEAK, rms, with_silence
from lectern.operators.chapters import with_ahead

#: Silence between the chunks of a chapter.
GAP_MS = 300
#: Samples of a part of a chapter (4 MB).
PART = 1 << 20


class Unspeakable(Exception):
    """What an engine raises for a text without anything to say."""


class Engine(Protocol):
    """What a speech engine offers; each Python worker makes one of its own."""

    def synthesize(self, text: str, voice: str, speed: float) -> np.ndarray: ...


def synthesized(chunks: DataFrame, engine: Callable[[], Engine], voice: str, speed: float = 1.0, attempts: int = 3) -> DataFrame:
    """All columns and ``samples`` of the ``text`` of each chunk; results that are nearly silent are tried again, the last one counts; an unspeakable text is silence of no length."""

    def speak(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = engine()
        for batch in batches:
            made = []
            for text in batch["text"]:
                for _ in range(attempts):
                    try:
                        samples = np.asarray(own.synthesize(text, voice, speed), "float32")
                    except Unspeakable:
                        samples = np.zeros(0, "float32")
                        break
                    if len(samples) and np.sqrt(np.mean(samples.astype(float) ** 2)) >= QUIET:
                        break
                made.append(samples)
            yield batch.assign(samples=made)

    return chunks.mapInPandas(speak, T.StructType([*chunks.schema.fields, T.StructField("samples", T.ArrayType(T.FloatType()))]))


def to_wav(samples: np.ndarray, rate: int = SAMPLE_RATE) -> bytes:
    """Mono 16-bit WAV."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(np.asarray(samples, float), -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def from_wav(content: bytes) -> tuple[np.ndarray, int]:
    with wave.open(io.BytesIO(content)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("samples are not of 16 bits")
        return np.frombuffer(w.readframes(w.getnframes()), "<i2").astype("float32") / 32767, w.getframerate()


def wav_samples(files: DataFrame) -> DataFrame:
    """path, samples, sample_rate, error of a ``binaryFile`` read; a file that is no 16-bit WAV has only an error."""

    def one(content: bytes | None) -> tuple:
        try:
            return *from_wav(content or b""), None
        except (wave.Error, EOFError, ValueError) as error:
            return None, None, f"{type(error).__name__}: {error}"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            samples, rate, error = zip(*map(one, batch["content"]), strict=True) if len(batch) else ((), (), ())
            yield pd.DataFrame({"path": batch["path"], "samples": samples, "sample_rate": pd.array(rate, "Int32"), "error": error})

    return files.select("path", "content").mapInPandas(read, "path string, samples array<float>, sample_rate int, error string")


def wav_files(sounds: DataFrame, rate: int = SAMPLE_RATE) -> DataFrame:
    """path, content: a WAV file for the ``samples`` of each path."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "content": [to_wav(s, rate) for s in batch["samples"]]})

    return sounds.select("path", "samples").mapInPandas(made, "path string, content binary")


def assembled(chunks: DataFrame, silence_ms: int = GAP_MS, rate: int = SAMPLE_RATE) -> DataFrame:
    """book, chapter_index, samples: the chunks (chunk_index, samples) of a chapter in order, silence between them; chapters without chunks do not occur."""
    silence = F.array_repeat(F.lit(0.0).cast("float"), max(0, silence_ms) * rate // 1000)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "samples"))), lambda c: c["samples"])
    made = chunks.groupBy("book", "chapter_index").agg(parts.alias("parts"))
    return made.select("book", "chapter_index", with_silence(F.col("parts"), silence).alias("samples"))


def sample_offsets(chunks: DataFrame, silence_ms: int = GAP_MS, rate: int = SAMPLE_RATE) -> DataFrame:
    """book, chapter_index, chunk_index, n_samples, at, length: where each chunk begins in its chapter, in samples.

    ``chunks`` has a row for each (chunk_index, n_samples). Sums come in two steps over
    cells, so a chapter may have any number of chunks; whole numbers are exact whatever
    the order of adding. ``length`` is that of the chapter, without silence after the last.
    """
    gap = max(0, silence_ms) * rate // 1000
    order = ["chapter_index", "chunk_index"]
    sizes = chunks.select("book", *order, F.col("n_samples").cast("long").alias("n_samples"))
    placed = with_ahead(sizes, sizes.groupBy("book", *order).agg(F.sum(F.col("n_samples") + gap).alias("_n")), *order)
    spans = placed.groupBy("book", "chapter_index").agg(F.min("_ahead").alias("_from"), (F.max(F.col("_ahead") + F.col("n_samples")) - F.min("_ahead")).alias("length"))
    spans = spans.withColumnsRenamed({"book": "_book", "chapter_index": "_chapter"})
    told = placed.join(spans, F.col("book").eqNullSafe(F.col("_book")) & F.col("chapter_index").eqNullSafe(F.col("_chapter")))
    return told.select("book", *order, "n_samples", (F.col("_ahead") - F.col("_from")).alias("at"), "length")


def assembled_parts(chunks: DataFrame, silence_ms: int = GAP_MS, rate: int = SAMPLE_RATE, part: int = PART) -> DataFrame:
    """book, chapter_index, part, length, samples: each chapter cut into parts of so many samples (the last one has what is left).

    Chunks are met with their offsets, cut where parts end, and laid into their parts, which
    are silent elsewhere: no value holds a chapter. A chapter of a single empty chunk has no
    parts.
    """
    keys = ["book", "chapter_index", "chunk_index"]
    offsets = sample_offsets(chunks.select(*keys, F.size("samples").alias("n_samples")), silence_ms, rate).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.col("book").eqNullSafe(F.col("_book")) & F.col("chapter_index").eqNullSafe(F.col("_chapter_index")) & (F.col("chunk_index") == F.col("_chunk_index"))
    met = chunks.join(offsets, same).filter("n_samples > 0")
    first, last = F.floor(F.col("at") / part), F.floor((F.col("at") + F.col("n_samples") - 1) / part)
    begin = F.greatest(F.col("part") * part - F.col("at"), F.lit(0))
    end = F.least((F.col("part") + 1) * part - F.col("at"), F.col("n_samples"))
    pieces = met.select("*", F.explode(F.sequence(first, last)).alias("part")).select("book", "chapter_index", "part", "length", (F.col("at") + begin - F.col("part") * part).alias("at"), F.slice("samples", (begin + 1).cast("int"), (end - begin).cast("int")).alias("piece"))
    # Parts that only hold silence have no chunk: they are made of the lengths.
    lengths = offsets.select(F.col("_book").alias("book"), F.col("_chapter_index").alias("chapter_index"), "length").distinct().filter("length > 0")
    every = lengths.select("book", "chapter_index", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / part))).alias("part"), "length", F.lit(None).cast("long").alias("at"), F.lit(None).cast("array<float>").alias("piece"))
    laid = pieces.unionByName(every).groupBy("book", "chapter_index", "part", "length").agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "piece")))).alias("pieces"))
    size = F.least(F.lit(part), F.col("length") - F.col("part") * part)
    silent = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n.cast("int"))
    ends = lambda i: F.coalesce(F.get("pieces", i)["at"] + F.size(F.get("pieces", i)["piece"]), F.lit(0))
    filled = F.flatten(F.transform("pieces", lambda x, i: F.concat(silent(x["at"] - ends(i - 1)), x["piece"])))
    return laid.select("book", "chapter_index", "part", "length", F.concat(filled, silent(size - F.size(filled))).alias("samples"))


def wav_header(length: Column, rate: int = SAMPLE_RATE) -> Column:
    """The 44 bytes before mono 16-bit samples, from their number; the sizes of longer files than 4 GB are cut to what fits."""
    little = lambda n, width: F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.lpad(F.hex(F.pmod(F.floor(n / F.pow(F.lit(256.0), k)).cast("long"), F.lit(256))), 2, "0")), ""))
    size = F.least(length * 2, F.lit(2**32 - 37))
    text = lambda t: F.encode(F.lit(t), "UTF-8")
    return F.concat(text("RIFF"), little(size + 36, 4), text("WAVEfmt "), little(F.lit(16), 4), little(F.lit(1), 2), little(F.lit(1), 2), little(F.lit(rate), 4), little(F.lit(rate * 2), 4), little(F.lit(2), 2), little(F.lit(16), 2), text("data"), little(size, 4))


def wav_parts(parts: DataFrame, rate: int = SAMPLE_RATE) -> DataFrame:
    """book, chapter_index, part, content: the bytes of the WAV file of each chapter, by parts in order; the header is made last, when the length is known, and comes as part -1."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(content=[(np.clip(np.asarray(s, float), -1, 1) * 32767).astype("<i2").tobytes() for s in batch["samples"]]).drop(columns="samples")

    kinds = {f.name: f.dataType.simpleString() for f in parts.schema}
    schema = f"book {kinds['book']}, chapter_index {kinds['chapter_index']}, part long, content binary"
    body = parts.select("book", "chapter_index", "part", "samples").mapInPandas(packed, schema)
    head = parts.filter("part = 0").select("book", "chapter_index", F.lit(-1).cast("long").alias("part"), wav_header(F.col("length"), rate).alias("content"))
    return head.unionByName(body)


def voice_quality(samples: DataFrame) -> DataFrame:
    """By voice: the weakest level and whether all are loud enough; ``samples`` has voice and samples."""
    weakest = F.min(rms(F.col("samples")))
    return samples.groupBy("voice").agg(weakest.alias("rms"), F.when(weakest >= WEAK, "OK").otherwise("FLAG").alias("verdict"))
