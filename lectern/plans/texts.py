"""Registered queries over texts: cleaning rules, spoken numbers, chunks, speech.

The driver's texts hold few of the things that the rules look for, so each query
decorates them, and its SQL does the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import rules, speech, spoken
from lectern.operators import chunks


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(decorated: str, made) -> object:
    """A query over documents: doc_id and ``text``, a function of the decorated text."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, sf_dir, "documents").select("doc_id", F.expr(decorated).alias("t")).select("doc_id", made(F.col("t")).alias("text"))

    return query


def _over(table: str, columns: dict[str, str], made) -> object:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        first, (name, expression) = list(columns.items())[:-1], list(columns.items())[-1]
        rows = read(spark, sf_dir, table).select(*[F.expr(e).alias(n) for n, e in first], F.expr(expression).alias("t"))
        return rows.select(*[n for n, _ in first], made(F.col("t")).alias(name))

    return query


QUERIES: dict = {}
ORACLES: dict = {}

_SPACED = "concat(replace(text, ' the ', ' \\t  the  '), ' \\n\\n\\n\\n', lang, '  ')"
QUERIES["clean_white_space"] = _docs(_SPACED, rules.tidy_white_space)
ORACLES["clean_white_space"] = r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(concat(replace(text, ' the ', ' ' || chr(9) || '  the  '), ' ' || repeat(chr(10), 4), lang, '  '),
  '[ \t]+\n', chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents"""

QUERIES["clean_quotes_dashes"] = _docs("concat('“', replace(replace(text, ' de ', ' \\n– '), ' the ', ' ‘the’—'), '”')", rules.plain_quotes_and_dashes)
ORACLES["clean_quotes_dashes"] = r"""
SELECT doc_id, regexp_replace(translate(concat('“', replace(replace(text, ' de ', ' ' || chr(10) || '– '), ' the ', ' ‘the’—'), '”'), '‘’“”', '''''""'), '\s*[–—]\s*', ' — ', 'g') AS text FROM documents"""

QUERIES["clean_footnotes"] = _docs("concat(replace(text, '. ', concat('. [', doc_id % 100, '] ')), ' x[1]. y(12) z [1234] é(3) \"(4)')", rules.drop_footnotes)
ORACLES["clean_footnotes"] = r"""
SELECT doc_id, regexp_replace(concat(replace(text, '. ', concat('. [', doc_id % 100, '] ')), ' x[1]. y(12) z [1234] é(3) "(4)'), '([a-zA-Z.,!?"''])\s*(?:\[\d{1,3}\]|\(\d{1,3}\)|[¹²³⁰-⁹]+)(\s|$)', '\1\2', 'g') AS text FROM documents"""

QUERIES["clean_split_words"] = _docs("replace(text, 'en', 'e-\\nn')", rules.join_split_words)
ORACLES["clean_split_words"] = r"SELECT doc_id, regexp_replace(replace(text, 'en', 'e-' || chr(10) || 'n'), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g') AS text FROM documents"

QUERIES["clean_marks"] = _docs("replace(replace(text, '.', ' .'), ',', '\\n ,')", rules.close_up_marks)
ORACLES["clean_marks"] = r"SELECT doc_id, regexp_replace(replace(replace(text, '.', ' .'), ',', chr(10) || ' ,'), '\s+([.,!?;:])', '\1', 'g') AS text FROM documents"

QUERIES["clean_tables"] = _docs("concat(text, '\\n| a | b |\\n|c|d|\\n\\n|e|f|\\nend\\n')", rules.skip_tables)
ORACLES["clean_tables"] = r"""
WITH l AS (SELECT doc_id, list_transform(string_split(concat(text, chr(10), '| a | b |', chr(10), '|c|d|', chr(10), chr(10), '|e|f|', chr(10), 'end'), chr(10)),
  lambda x: CASE WHEN regexp_matches(x, '\|.*\|') THEN '[table content skipped]' ELSE x END) AS l FROM documents)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: NOT (x = '[table content skipped]' AND i > 1 AND l[i - 1] = '[table content skipped]')), chr(10)) AS text FROM l"""

QUERIES["clean_abbreviations"] = _docs("concat('Dr. ', lang, ' met Mr. X, e.g. at no. ', n_chars, ' (St. John) vs. Mrs. Y, Prof. Z Jr. etc. but nono. ', replace(text, '. ', ' approx. '))", rules.expand_abbreviations)
_ABBREVIATED = "concat('Dr. ', lang, ' met Mr. X, e.g. at no. ', n_chars, ' (St. John) vs. Mrs. Y, Prof. Z Jr. etc. but nono. ', replace(text, '. ', ' approx. '))"
for _key, _value in list(rules.ABBREVIATIONS.items()) * 2:
    _ABBREVIATED = f"regexp_replace({_ABBREVIATED}, '(^|[^\\p{{L}}\\p{{N}}_]){_key.replace('.', chr(92) + '.')}($|[^\\p{{L}}\\p{{N}}_])', '\\1{_value}\\2', 'g')"
ORACLES["clean_abbreviations"] = f"SELECT doc_id, {_ABBREVIATED} AS text FROM documents"

QUERIES["clean_markup"] = _docs("concat('<p class=\"x\">', replace(text, ' ', ' <b>&amp;</b> '), '&lt;i&gt;</p>')", rules.strip_markup)
ORACLES["clean_markup"] = "SELECT doc_id, concat(regexp_replace(replace(text, ' ', ' & '), '<[^>]+>', '', 'g'), '<i>') AS text FROM documents"


def clean_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule in order, over texts that hold something for each."""
    text = "concat('<p>It cost $', n_chars, '[', doc_id % 100, '] in 1999 &amp; Dr. “X”–3rd of 42 .</p>\\n\\n\\n', text)"
    return read(spark, sf_dir, "documents").select("doc_id", rules.cleaned(F.expr(text)).alias("text"), rules.foreign_phrases(F.col("text")).alias("foreign_phrases"))


QUERIES["clean_all"] = clean_all


QUERIES["clean_custom"] = _docs("concat('<b>', replace(text, ' ', '  \\t '), '</b>\\n\\n\\n&lt;')", lambda t: rules.cleaned(t, [rules.strip_markup, rules.tidy_white_space]))
ORACLES["clean_custom"] = r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(concat(regexp_replace(replace(text, ' ', '  ' || chr(9) || ' '), '<[^>]+>', '', 'g'), repeat(chr(10), 3), '<'),
  '[ \t]+\n', chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents"""


def foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(rules.foreign_phrases(F.concat("text", F.lit(" 早稲田大学 “”–—")))).alias("phrase"))


QUERIES["foreign_phrases"] = foreign
ORACLES["foreign_phrases"] = r"SELECT doc_id, unnest(regexp_extract_all(concat(text, ' 早稲田大学 “”–—'), '[^\x00-\x7F]{4,}')) AS phrase FROM documents"

# Spoken numbers: the expected words are built from the values, not from the text.
_SMALL = "s AS (SELECT [" + ", ".join(f"'{w}'" for w in spoken.SMALL) + "] AS w)"


def _said(x: str) -> str:
    """SQL: words of a whole number under a billion; ``s.w`` has those of 0 to 99."""
    part = lambda k: f"(({x}) // {1000**k} % 1000)"
    group = lambda g: f"CASE WHEN {g} < 100 THEN w[{g} + 1] ELSE w[{g} // 100 + 1] || ' hundred' || CASE WHEN {g} % 100 > 0 THEN ' and ' || w[{g} % 100 + 1] ELSE '' END END"
    high = ", ".join(f"CASE WHEN {part(k)} > 0 THEN {group(part(k))} || ' {name}' END" for k, name in ((2, "million"), (1, "thousand")))
    tied = f"CASE WHEN {part(0)} = 0 THEN '' WHEN ({x}) < 1000 THEN {group(part(0))} WHEN {part(0)} < 100 THEN ' and ' || {group(part(0))} ELSE ', ' || {group(part(0))} END"
    return f"CASE WHEN ({x}) = 0 THEN 'zero' ELSE array_to_string(list_filter([{high}], lambda q: q IS NOT NULL), ', ') || {tied} END"


QUERIES["spoken_cardinal"] = _over("orders", {"o_orderkey": "o_orderkey", "said": "concat('I have ', o_orderkey * 397, ' apples, ', o_custkey, ' pears; not ', o_custkey, '. or x', o_custkey)"}, spoken.speak_plain)
ORACLES["spoken_cardinal"] = f"WITH {_SMALL} SELECT o_orderkey, concat('I have ', {_said('o_orderkey * 397')}, ' apples, ', {_said('o_custkey')}, ' pears; not ', o_custkey, '. or x', o_custkey) AS said FROM orders, s"



def clean_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule at once, over texts whose cleaned form can be written down."""
    text = "concat('<p class=\"c\">It  cost $', o_custkey, ' once[7] in 1999 &amp; Dr. “X”–3rd of 42 .</p>\n\n\n\n | a | ', o_orderkey, ' |\n|c|d|\nexam-\nple \n')"
    return read(spark, sf_dir, "orders").select("o_orderkey", rules.cleaned(F.expr(text)).alias("text"))


QUERIES["clean_orders"] = clean_orders
ORACLES["clean_orders"] = f"""WITH {_SMALL} SELECT o_orderkey, concat('It cost ', {_said('o_custkey')}, ' dollars once in nineteen ninety-nine & Doctor "X" — third of forty-two.', chr(10), chr(10), '[table content skipped]', chr(10), 'example') AS text FROM orders, s"""

QUERIES["spoken_decimal"] = _over("orders", {"o_orderkey": "o_orderkey", "said": "concat('about ', o_custkey, '.', lpad(o_orderkey % 1000, 3, '0'), ' of it')"}, spoken.speak_decimals)
ORACLES["spoken_decimal"] = f"WITH {_SMALL} SELECT o_orderkey, concat('about ', {_said('o_custkey')}, ' point ', w[o_orderkey // 100 % 10 + 1], ' ', w[o_orderkey // 10 % 10 + 1], ' ', w[o_orderkey % 10 + 1], ' of it') AS said FROM orders, s"

QUERIES["spoken_currency"] = _over("orders", {"o_orderkey": "o_orderkey", "said": "concat('It cost $', o_custkey, ' or £ ', o_orderkey, '.5 or €', format_number(o_orderkey + 1000, 0), ', then')"}, spoken.speak_currency)
ORACLES["spoken_currency"] = f"WITH {_SMALL} SELECT o_orderkey, concat('It cost ', {_said('o_custkey')}, ' dollars or ', {_said('o_orderkey')}, ' point five pounds or ', {_said('o_orderkey + 1000')}, ' euros then') AS said FROM orders, s"

QUERIES["spoken_year"] = _over("orders", {"o_orderkey": "o_orderkey", "said": "concat('in ', year(o_orderdate), ' and ', 1000 + o_custkey % 1100, '.')"}, spoken.speak_years)
_YEAR = lambda y: f"CASE WHEN ({y}) // 100 % 10 = 0 AND ({y}) % 100 < 10 THEN {_said(y)} ELSE w[({y}) // 100 + 1] || ' ' || CASE WHEN ({y}) % 100 = 0 THEN 'hundred' WHEN ({y}) % 100 < 10 THEN 'oh-' || w[({y}) % 100 + 1] ELSE w[({y}) % 100 + 1] END END"
ORACLES["spoken_year"] = f"WITH {_SMALL} SELECT o_orderkey, concat('in ', {_YEAR('year(o_orderdate)')}, ' and ', {_YEAR('1000 + o_custkey % 1100')}, '.') AS said FROM orders, s"

QUERIES["spoken_ordinal"] = _over("orders", {"o_orderkey": "o_orderkey", "said": "concat('the ', o_custkey, 'th and ', o_orderkey, 'ST time')"}, spoken.speak_ordinals)
_LAST = "CASE " + " ".join(f"WHEN last = '{k}' THEN '{v}'" for k, v in spoken.IRREGULAR.items()) + " WHEN ends_with(last, 'y') THEN left(last, length(last) - 1) || 'ieth' ELSE last || 'th' END"
ORACLES["spoken_ordinal"] = f"""WITH {_SMALL}, c AS (SELECT o_orderkey, unnest([1, 2]) AS k, unnest([{_said('o_custkey')}, {_said('o_orderkey')}]) AS said FROM orders, s),
o AS (SELECT o_orderkey, k, regexp_extract(said, '[a-z]+$') AS last, regexp_replace(said, '[a-z]+$', '') AS head FROM c)
SELECT o_orderkey, concat('the ', max(CASE WHEN k = 1 THEN head || {_LAST} END), ' and ', max(CASE WHEN k = 2 THEN head || {_LAST} END), ' time') AS said FROM o GROUP BY o_orderkey"""

# Chunks.
_PARAGRAPHS = "replace(text, '\\n', '\\n\\n')"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", F.expr(_PARAGRAPHS).alias("text"))
    return chunks.chunked(docs)


def chunk_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc_id", "chunk_index", "text", "paragraph_start", "paragraph_end")


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"), F.max(F.length("text")).cast("long").alias("longest"))


def long_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.flatten(F.transform(chunks.paragraphs(F.expr(_PARAGRAPHS)), chunks.sentences))).alias("sentence"))
    return docs.select("doc_id", F.explode(chunks.split_long(F.col("sentence"), 60)).alias("piece"))


def _pieces_sql(most: int) -> str:
    """SQL expressions for ``sent``: the sentence list split by marks and words, as nested lists."""
    strip = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    steps, last = [], "sents"
    for k, mark in enumerate(chunks.CLAUSE_MARKS):
        parts = f"list_filter(list_transform(string_split(p, '{mark}'), lambda q: {strip('q')}), lambda q: q <> '')"
        steps.append(f"flatten(list_transform({last}, lambda p: CASE WHEN length(p) > {most} AND len({parts}) > 1 THEN string_split(array_to_string({parts}, '{mark}' || chr(1)), chr(1)) ELSE [p] END)) AS l{k}")
        last = f"l{k}"
    first = "list_transform(list_filter(string_split(p, ' '), lambda q: q <> ''), lambda q: {'done': []::VARCHAR[], 'open': q})"
    fold = f"list_reduce({first}, lambda a, x: CASE WHEN length(a.open) + 1 + length(x.open) <= {most} THEN {{'done': a.done, 'open': a.open || ' ' || x.open}} ELSE {{'done': list_append(a.done, a.open), 'open': x.open}} END)"
    steps.append(f"flatten(list_transform({last}, lambda p: CASE WHEN length(p) > {most} THEN list_append(({fold}).done, ({fold}).open) ELSE [p] END)) AS pieces")
    return ", ".join(steps)


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(para, '([.!?][\"'')\]]{0,2})\s+', '\1' || chr(1), 'g'), chr(1)), lambda q: regexp_replace(q, '^\s+|\s+$', '', 'g')), lambda q: q <> '')".replace('\\"', '"')
_PARA_SQL = r"p AS (SELECT doc_id, lang, list_filter(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: regexp_matches(x, '\S')) AS ps FROM documents), e AS (SELECT doc_id, lang, unnest(ps) AS para, unnest(range(len(ps))) AS i FROM p), x AS (SELECT doc_id, lang, i, " + _SENTENCES + " AS sents FROM e)"
QUERIES["long_sentence_split"] = long_sentences
ORACLES["long_sentence_split"] = f"WITH {_PARA_SQL}, y AS (SELECT doc_id, {_pieces_sql(60)} FROM x) SELECT doc_id, unnest(pieces) AS piece FROM y"

_CHUNKS_SQL = f"""{_PARA_SQL}, y AS (SELECT doc_id, lang, i, {_pieces_sql(400)} FROM x),
z AS (SELECT doc_id, lang, flatten(list(list_transform(pieces, lambda q: {{'t': q, 'i': i}}) ORDER BY i)) AS l FROM y GROUP BY doc_id, lang),
r AS (SELECT doc_id, lang, list_reduce(list_transform(l, lambda q: {{'done': []::STRUCT(t VARCHAR, a BIGINT, b BIGINT)[], 'open': {{'t': q.t, 'a': q.i, 'b': q.i}}}}),
  lambda a, x: CASE WHEN length(a.open.t) + 1 + length(x.open.t) <= 400 THEN {{'done': a.done, 'open': {{'t': a.open.t || ' ' || x.open.t, 'a': a.open.a, 'b': x.open.b}}}} ELSE {{'done': list_append(a.done, a.open), 'open': x.open}} END) AS f FROM z WHERE len(l) > 0),
c AS (SELECT doc_id, lang, list_append(f.done, f.open) AS cs FROM r), u AS (SELECT doc_id, lang, unnest(cs) AS c, unnest(range(len(cs))) AS k FROM c)"""
QUERIES["chunk_lineage"] = chunk_lineage
ORACLES["chunk_lineage"] = f"WITH {_CHUNKS_SQL} SELECT doc_id, k::INT AS chunk_index, c.t AS text, c.a::INT AS paragraph_start, c.b::INT AS paragraph_end FROM u"
QUERIES["chunk_stats"] = chunk_stats
ORACLES["chunk_stats"] = f"WITH {_CHUNKS_SQL} SELECT lang, count(*) AS n_chunks, sum(length(c.t))::BIGINT AS n_chars, max(length(c.t))::BIGINT AS longest FROM u GROUP BY lang"

# Speech.


def speech_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("text", F.lit(" ] ... !! wait — now; привет. (end"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(speech.plan(text)).alias("place", "s")).select("conv_id", "turn", "place", "s.segment", "s.pause")


_SEGMENTS = r"s AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(concat(text, ' ] ... !! wait — now; привет. (end'), '([.!?…,;:—])\s+', '\1' || chr(1), 'g'), chr(1)), lambda q: regexp_matches(q, '[a-zA-Z0-9]')) AS l FROM conversations), e AS (SELECT conv_id, turn, unnest(l) AS segment, unnest(range(len(l))) AS place, len(l) AS n FROM s)"
_PAUSE = r"CASE WHEN place = n - 1 THEN 0.0 WHEN regexp_matches(segment, '[.!?…]\s*$') THEN 0.4 WHEN regexp_matches(segment, '[,;:—]\s*$') THEN 0.18 ELSE 0.0 END::DOUBLE"
QUERIES["speech_segments"] = speech_segments
ORACLES["speech_segments"] = f"WITH {_SEGMENTS} SELECT conv_id, turn, place::INT AS place, segment, {_PAUSE} AS pause FROM e"


def pause_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = speech_segments(spark, sf_dir)
    return s.groupBy("conv_id").agg(F.count("*").alias("n_segments"), F.round(F.sum("pause"), 6).alias("pause_sec"), F.sum(F.length("segment")).alias("n_chars"))


QUERIES["pause_plan"] = pause_plan
ORACLES["pause_plan"] = f"WITH {_SEGMENTS} SELECT conv_id, count(*) AS n_segments, round(sum({_PAUSE}), 6) AS pause_sec, sum(length(segment))::BIGINT AS n_chars FROM e GROUP BY conv_id"

_VOICE = "concat(substring('abjzefhipx', (n_nationkey % 10) + 1, 1), substring('fmq', (n_nationkey % 3) + 1, 1), CASE WHEN n_nationkey % 4 = 1 THEN 'x' ELSE '' END, '_', lower(n_name), '-o', chr(39), 'neil')"


def voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(speech.voice(F.expr(_VOICE)).alias("v")).select("v.*")


QUERIES["voice_dimension"] = voices
ORACLES["voice_dimension"] = f"""WITH v AS (SELECT {_VOICE} AS id, n_nationkey AS k FROM nation)
SELECT id, concat('Nation ', k, '-O''Neil') AS name, CASE WHEN k % 3 < 2 THEN CASE substring(id, 1, 1) {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in speech.LANGUAGES.items())} END END AS language,
CASE k % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' END AS gender FROM v"""


def preview_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", speech.preview_key(F.concat(F.lit("af_"), "lang"), F.col("text"), F.lit(1.0)).alias("key"))


QUERIES["preview_keys"] = preview_keys
ORACLES["preview_keys"] = "SELECT doc_id, left(sha256(concat('af_', lang, '|', text, '|1.0')), 32) AS key FROM documents"


def pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").withColumn("q", speech.quantized(F.transform("embedding", lambda x: x * 4)))
    level = speech.rms(F.col("embedding"))
    return e.select("vec_id", F.round(level, 6).alias("rms"), (level < speech.QUIET).alias("quiet"), F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum16"), F.round(F.aggregate(speech.dequantized(F.col("q")), F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("sum_back"))


QUERIES["pcm_levels"] = pcm
ORACLES["pcm_levels"] = """WITH q AS (SELECT *, list_transform(embedding, lambda x: trunc(greatest(-1.0, least(1.0, (x * 4::FLOAT)::DOUBLE)) * 32767)::BIGINT) AS q, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)) AS r FROM embeddings)
SELECT vec_id, round(r, 6) AS rms, r < 0.001 AS quiet, list_sum(q)::BIGINT AS sum16, round(list_sum(list_transform(q, lambda x: (x / 32767.0)::FLOAT::DOUBLE)), 4) AS sum_back FROM q"""


def interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks_ = F.array(*[F.slice("embedding", 1 + 16 * k, 16) for k in range(4)])
    silence = F.array_repeat(F.lit(0.0).cast("float"), 3)
    made = read(spark, sf_dir, "embeddings").select("vec_id", speech.with_silence(chunks_, silence).alias("a"))
    placed = F.transform("a", lambda x, i: x.cast("double") * i)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x.cast("double"))
    return made.select("vec_id", F.size("a").cast("long").alias("n"), F.get("a", F.lit(16)).alias("gap"), F.get("a", F.lit(19)).alias("next"), F.round(total(F.col("a")), 4).alias("total"), F.round(total(placed), 3).alias("placed"))


QUERIES["chunks_with_silence"] = interleaved
ORACLES["chunks_with_silence"] = """SELECT vec_id, len(embedding)::BIGINT + 9 AS n, 0::FLOAT AS gap, embedding[17] AS next, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total,
round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * (i - 1 + 3 * ((i - 1) // 16)))), 3) AS placed FROM embeddings"""


def speech_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of each turn at a hundred a second, two for each character of a segment; unspeakable turns are empty."""
    text = F.expr("CASE WHEN turn % 5 = 2 THEN '] ... !!' ELSE text END")
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", speech.plan(text).alias("plan"))
    parts = F.transform("plan", lambda s: F.array_repeat(F.lit(0.5).cast("float"), F.length(s["segment"]) * 2))
    made = c.select("conv_id", "turn", speech.audio(parts, F.transform("plan", lambda s: s["pause"]), 100).alias("a"))
    return made.select("conv_id", "turn", F.size("a").alias("n"), F.aggregate("a", F.lit(0.0), lambda t, x: t + x.cast("double")).alias("total"))


QUERIES["speech_audio"] = speech_audio
ORACLES["speech_audio"] = r"""WITH s AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(CASE WHEN turn % 5 = 2 THEN '] ... !!' ELSE text END, '([.!?…,;:—])\s+', '\1' || chr(1), 'g'), chr(1)), lambda q: regexp_matches(q, '[a-zA-Z0-9]')) AS l FROM conversations),
p AS (SELECT *, list_sum(list_transform(l[:-2], lambda q: CASE WHEN regexp_matches(q, '[.!?…]\s*$') THEN 40 WHEN regexp_matches(q, '[,;:—]\s*$') THEN 18 ELSE 0 END)) AS quiet, list_sum(list_transform(l, lambda q: length(q))) AS chars FROM s)
SELECT conv_id, turn, (coalesce(chars, 0) * 2 + coalesce(quiet, 0))::INT AS n, coalesce(chars, 0)::DOUBLE AS total FROM p"""
