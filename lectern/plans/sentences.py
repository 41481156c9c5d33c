"""Registered queries over sentence ends learnt from the corpus, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import chunks, sentences
from lectern.plans.texts import _pieces_sql, read

#: Few of the driver's texts have abbreviations: each gets some before and behind it.
_TEXT = "concat('Dr. Lee met J. Roe at 5 p.m. in the U.S. Army camp. It rained etc. all day. ', text, ' No. ', doc_id, ' is by St. Ann. ')"
_FLAGS = ("starts", "upper_mid", "upper_seen", "lower_seen", "lower_start")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "lang", F.expr(_TEXT).alias("text"))


def sentence_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the corpus says of each type of word."""
    types = sentences.trained(_texts(spark, sf_dir)).types
    return types.select("kind", "n_period", "n_plain", F.round("score", 6).alias("score"), "is_abbreviation", *_FLAGS)


def sentence_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Initials and numbers, and the words that go with them."""
    return sentences.trained(_texts(spark, sf_dir)).collocations


def trained_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    masked = sentences.protected(texts, sentences.trained(texts))
    told = F.flatten(F.transform(chunks.paragraphs(F.col("text")), lambda p: F.transform(chunks.sentences(p), sentences.unmasked)))
    return masked.select("doc_id", F.posexplode(told).alias("place", "sentence"))


def trained_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    return chunks.chunked(texts.drop("lang"), model=sentences.trained(texts))


def _core(x: str) -> str:
    return f"""regexp_replace(regexp_replace({x}, '^[("''\\[{{«“‘]+', ''), '[)"''\\]}}»”’,;:]+$', '')"""


def _kind(core: str) -> str:
    base = f"lower(CASE WHEN ends_with({core}, '.') AND NOT ends_with({core}, '..') THEN left({core}, length({core}) - 1) ELSE {core} END)"
    return f"CASE WHEN regexp_matches({base}, '{sentences._NUMBER}') THEN '##' ELSE {base} END"


def _ending(core: str) -> str:
    return f"CASE WHEN ends_with({core}, '..') THEN 'dots' WHEN ends_with({core}, '.') THEN 'period' WHEN regexp_matches({core}, '[!?]$') THEN 'mark' ELSE 'word' END"


def _binomial(hits: str, tries: str, p: str) -> str:
    return f"(CASE WHEN {hits} > 0 THEN ({hits}) * ln({p}) ELSE 0 END + CASE WHEN {tries} - ({hits}) > 0 THEN ({tries} - ({hits})) * ln(1 - {p}) ELSE 0 END)"


def _association(ab: str, a: str, b: str) -> str:
    alone = f"{_binomial(ab, a, f'({b}::DOUBLE / t)')} + {_binomial(f'({b} - {ab})', f'(t - {a})', f'({b}::DOUBLE / t)')}"
    tied = f"{_binomial(ab, a, f'({ab}::DOUBLE / {a})')} + {_binomial(f'({b} - {ab})', f'(t - {a})', f'(({b} - {ab})::DOUBLE / (t - {a}))')}"
    return f"(-2 * ({alone} - ({tied})))"


_LENGTHS = "length(kind) - length(replace(kind, '.', ''))"
_SCORE = f"-2 * ({_binomial('n_period', '(n_period + n_plain)', '(p::DOUBLE / t)')} - {_binomial('n_period', '(n_period + n_plain)', '0.99')}) * exp(-length(replace(kind, '.', ''))) * ({_LENGTHS} + 1) * pow(length(replace(kind, '.', ''))::DOUBLE, -n_plain)"
_MODEL = f"""d AS (SELECT doc_id, {_TEXT} AS text FROM documents),
w AS (SELECT list_filter(string_split_regex(unnest(string_split(text, chr(10) || chr(10))), '\\s+'), lambda x: x <> '') AS ts FROM d),
pairs AS MATERIALIZED (SELECT token, CASE WHEN b IS NULL OR regexp_matches(b, '[.!?]') THEN b ELSE '-' END AS b, count(*) AS n FROM (SELECT ts[i] AS token, CASE WHEN i > 1 THEN ts[i - 1] END AS b FROM w, unnest(range(1, len(ts) + 1)) u(i)) GROUP BY ALL),
cores AS MATERIALIZED (SELECT *, {_core('token')} AS c, CASE WHEN b <> '-' THEN {_core('b')} END AS bc FROM pairs),
kinds AS MATERIALIZED (SELECT *, {_kind('c')} AS kind, {_ending('c')} AS own, {_kind('bc')} AS k, CASE WHEN b IS NULL THEN 'none' WHEN b = '-' THEN 'word' ELSE {_ending('bc')} END AS ending,
  CASE WHEN regexp_matches(c, '^\\p{{Lu}}') THEN 'upper' WHEN regexp_matches(c, '^\\p{{Ll}}') THEN 'lower' ELSE 'none' END AS letters, coalesce(regexp_matches(bc, '^\\p{{L}}\\.$') OR {_kind('bc')} = '##', false) AS loose FROM cores),
counts AS MATERIALIZED (SELECT kind, sum(CASE WHEN own = 'period' THEN n ELSE 0 END)::BIGINT AS n_period, sum(CASE WHEN own = 'period' THEN 0 ELSE n END)::BIGINT AS n_plain FROM kinds WHERE c <> '' GROUP BY kind),
total AS MATERIALIZED (SELECT sum(n_period + n_plain) AS t, sum(n_period) AS p FROM counts),
scored AS MATERIALIZED (SELECT *, score >= 0.3 AS is_abbreviation FROM (SELECT kind, n_period, n_plain, CASE WHEN n_period > 0 AND regexp_matches(kind, '\\p{{L}}') THEN {_SCORE} ELSE 0 END AS score FROM counts, total)),
told AS MATERIALIZED (SELECT *, CASE WHEN ending = 'dots' OR (ending = 'period' AND (short OR loose)) THEN 'unknown' WHEN ending IN ('none', 'mark') OR (ending = 'period' AND NOT short) THEN 'start' ELSE 'mid' END AS spot, ending = 'period' AND NOT short AND NOT loose AS ends
  FROM (SELECT kinds.*, kinds.k IN (SELECT kind FROM scored WHERE is_abbreviation) AND kinds.k IS NOT NULL AS short FROM kinds WHERE kind <> '')),
breaks AS MATERIALIZED (SELECT sum(n) AS br FROM told WHERE ends),
usage AS (SELECT kind, sum(n) AS n, sum(CASE WHEN ends THEN n ELSE 0 END) AS f, bool_or(letters = 'upper' AND spot = 'mid') AS upper_mid, bool_or(letters = 'upper') AS upper_seen, bool_or(letters = 'lower') AS lower_seen, bool_or(letters = 'lower' AND spot = 'start') AS lower_start FROM told GROUP BY kind),
flags AS MATERIALIZED (SELECT usage.*, f > 0 AND t::DOUBLE / br > n::DOUBLE / f AND regexp_matches(kind, '^\\p{{L}}') AND {_association('f', 'br', 'n')} >= 30 AS starts FROM usage, total, breaks),
colls AS MATERIALIZED (SELECT k AS before, kind FROM (SELECT m.*, x.n_period + x.n_plain AS a, y.n_period + y.n_plain AS b FROM (SELECT k, kind, sum(n) AS ab FROM told WHERE ending = 'period' AND loose GROUP BY k, kind HAVING sum(n) > 1 AND regexp_matches(kind, '^\\p{{L}}')) m JOIN counts x ON m.k = x.kind JOIN counts y ON m.kind = y.kind), total
  WHERE ab <= least(a, b) AND t::DOUBLE / a > b::DOUBLE / ab AND {_association('ab', 'a', 'b')} >= 7.88)"""
_PARTS = f"""para AS MATERIALIZED (SELECT doc_id, i, ps[i] AS p FROM (SELECT doc_id, list_filter(string_split(text, chr(10) || chr(10)), lambda x: regexp_matches(x, '\\S')) AS ps FROM d), unnest(range(1, len(ps) + 1)) u(i)),
cut AS (SELECT doc_id, i, string_split(regexp_replace(p, '([.!?]["'')\\]]{{0,2}})\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ps, regexp_extract_all(p, '[.!?]["'')\\]]{{0,2}}(\\s+)', 1) AS gs FROM para),
part AS MATERIALIZED (SELECT doc_id, i, j, ps[j] AS s, gs[j] AS g, {_core("regexp_extract(ps[j], '(\\S+)$', 1)")} AS bc, {_core("regexp_extract(ps[j + 1], '^\\S+')")} AS nc FROM cut, unnest(range(1, len(ps) + 1)) u(j)),
seen AS (SELECT part.*, {_kind('bc')} AS k, {_kind('nc')} AS nk, regexp_matches(bc, '^\\p{{L}}\\.$') AS initial, regexp_matches(nc, '^\\p{{Lu}}') AS up, regexp_matches(nc, '^\\p{{Ll}}') AS low FROM part),
flagged AS (SELECT seen.*, coalesce(s.is_abbreviation, false) AS short, c.before IS NOT NULL AS tied, coalesce(starts, false) AS starts, coalesce(upper_mid, false) AS um, coalesce(upper_seen, false) AS us, coalesce(lower_seen, false) AS ls, coalesce(lower_start, false) AS lb FROM seen LEFT JOIN scored s ON s.kind = k LEFT JOIN flags f ON f.kind = nk LEFT JOIN colls c ON c.before = k AND c.kind = nk),
settled AS (SELECT doc_id, i, j, s, CASE WHEN ends_with(bc, '.') AND NOT ends_with(bc, '..') AND (short OR initial OR k = '##') AND (tied OR CASE WHEN short AND NOT initial THEN NOT (up AND ls AND NOT um) AND NOT (up AND starts)
  ELSE regexp_matches(nc, '^[;:,.!?]') OR (low AND (us OR NOT lb)) OR (NOT (up AND ls AND NOT um) AND initial AND up AND NOT ls) END) THEN g END AS held FROM flagged),
numbered AS (SELECT *, sum(CASE WHEN before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, i ORDER BY j) AS no FROM (SELECT *, lag(held) OVER (PARTITION BY doc_id, i ORDER BY j) AS before FROM settled)),
sents AS MATERIALIZED (SELECT * FROM (SELECT doc_id, i, no, regexp_replace(string_agg(s || coalesce(held, ''), '' ORDER BY j), '^\\s+|\\s+$', '', 'g') AS sentence FROM numbered GROUP BY doc_id, i, no) WHERE sentence <> '')"""
_CHUNKS = f"""x AS (SELECT doc_id, i - 1 AS i, list(sentence ORDER BY no) AS sents FROM sents GROUP BY doc_id, i), y AS (SELECT doc_id, i, {_pieces_sql(400)} FROM x),
z AS (SELECT doc_id, flatten(list(list_transform(pieces, lambda q: {{'t': q, 'i': i}}) ORDER BY i)) AS l FROM y GROUP BY doc_id),
r AS (SELECT doc_id, list_reduce(list_transform(l, lambda q: {{'done': []::STRUCT(t VARCHAR, a BIGINT, b BIGINT)[], 'open': {{'t': q.t, 'a': q.i, 'b': q.i}}}}),
  lambda a, x: CASE WHEN length(a.open.t) + 1 + length(x.open.t) <= 400 THEN {{'done': a.done, 'open': {{'t': a.open.t || ' ' || x.open.t, 'a': a.open.a, 'b': x.open.b}}}} ELSE {{'done': list_append(a.done, a.open), 'open': x.open}} END) AS f FROM z WHERE len(l) > 0),
u AS (SELECT doc_id, unnest(list_append(f.done, f.open)) AS c, unnest(range(len(f.done) + 1)) AS k FROM r)"""

QUERIES = {
    "sentence_model": sentence_model,
    "sentence_collocations": sentence_collocations,
    "trained_sentences": trained_sentences,
    "trained_chunks": trained_chunks,
}
ORACLES = {
    "sentence_model": f"WITH {_MODEL} SELECT kind, n_period, n_plain, round(score, 6) AS score, is_abbreviation, {', '.join(f'coalesce({c}, false) AS {c}' for c in _FLAGS)} FROM scored LEFT JOIN flags USING (kind)",
    "sentence_collocations": f"WITH {_MODEL} SELECT * FROM colls",
    "trained_sentences": f"WITH {_MODEL}, {_PARTS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, no) - 1)::INT AS place, sentence FROM sents",
    "trained_chunks": f"WITH {_MODEL}, {_PARTS}, {_CHUNKS} SELECT doc_id, k::INT AS chunk_index, c.t AS text, c.a::INT AS paragraph_start, c.b::INT AS paragraph_end FROM u",
}
