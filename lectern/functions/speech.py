"""Speech plans: segments, pauses, voices, cache keys and sample arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.binding import let
from lectern.functions.patterns import SP
from lectern.functions.spoken import replace_each

SENTENCE_PAUSE, CLAUSE_PAUSE = 0.4, 0.18
SAMPLE_RATE = 24_000
QUIET, WEAK = 0.001, 0.005
#: What the letters of a voice id stand for.
LANGUAGES = {"a": "en-us", "b": "en-gb", "j": "ja", "z": "zh", "e": "es", "f": "fr", "h": "hi", "i": "it", "p": "pt-br"}
GENDERS = {"f": "female", "m": "male"}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def segments(text: Column) -> Column:
    """Parts after each mark, those with a letter or digit of ASCII."""
    return F.filter(F.split(text, rf"(?<=[.!?…,;:—]){SP}+", -1), lambda s: s.rlike("[a-zA-Z0-9]"))


def pause(segment: Column) -> Column:
    """Seconds of silence after a segment by its last mark."""
    last = F.right(F.regexp_replace(segment, rf"{SP}+\z", ""), F.lit(1))
    return F.when(last.isin(*".!?…"), SENTENCE_PAUSE).when(last.isin(*",;:—"), CLAUSE_PAUSE).otherwise(0.0)


def plan(text: Column) -> Column:
    """(segment, pause) in order; none after the last."""
    told = F.transform(segments(text), lambda s: F.struct(s.alias("segment"), pause(s).alias("pause")))
    # The last one again, without its pause; an empty list has no last one.
    return let(told, lambda t: F.transform(t, lambda x, i: F.struct(x["segment"].alias("segment"), F.when(i == F.size(t) - 1, 0.0).otherwise(x["pause"]).alias("pause"))))


def voice(voice_id: Column) -> Column:
    """(id, name, language, gender) of an id such as ``af_heart``."""
    prefix = F.when(voice_id.contains("_"), F.substring_index(voice_id, "_", 1)).otherwise("")
    rest = F.when(voice_id.contains("_"), F.substring(voice_id, F.length(prefix) + 2, F.length(voice_id))).otherwise(voice_id)
    # Every run of letters begins with a capital, also after a quote, a hyphen or a digit.
    name = replace_each(F.replace(rest, F.lit("_"), F.lit(" ")), r"\p{L}+", F.initcap)
    known = voice_id.rlike("(?s)^.[fm]")
    language = F.when(known, F.try_element_at(_map(LANGUAGES), F.substring(voice_id, 1, 1)))
    return F.struct(voice_id.alias("id"), name.alias("name"), language.alias("language"), F.when(known, F.try_element_at(_map(GENDERS), F.substring(voice_id, 2, 1))).alias("gender"))


def preview_key(voice_id: Column, text: Column, speed: Column) -> Column:
    """Name under which a preview is cached."""
    return F.substring(F.sha2(F.concat_ws("|", voice_id, text, speed.cast("double").cast("string")), 256), 1, 32)


def rms(samples: Column) -> Column:
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(0.0)


def quantized(samples: Column) -> Column:
    """16-bit samples of floats: clipped to one, scaled, truncated."""
    return F.transform(samples, lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) * 32767).cast("smallint"))


def dequantized(samples: Column) -> Column:
    return F.transform(samples, lambda x: (x / 32767.0).cast("float"))


def audio(parts: Column, pauses: Column, rate: int = SAMPLE_RATE) -> Column:
    """Samples of a chunk: those of its segments (array of arrays), each followed by its pause; a chunk without segments is empty."""
    quiet = lambda seconds: F.array_repeat(F.lit(0.0).cast("float"), (seconds * rate).cast("int"))
    return F.flatten(F.zip_with(parts, pauses, lambda samples, seconds: F.concat(samples, quiet(seconds))))


def with_silence(chunks: Column, silence: Column) -> Column:
    """Arrays of samples one after another, silence between them."""
    apart = F.transform(chunks, lambda x, i: F.when(i == 0, F.array(x)).otherwise(F.array(silence, x)))
    return F.flatten(F.flatten(apart))
