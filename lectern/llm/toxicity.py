"""Operator 5: toxicity by a convolutional text classifier trained in numpy.

Words (runs of letters, in lower case) have two hashed embeddings each, so that a
chance collision in one table is seen in the other. Filters of several widths run
over them, the greatest response of each filter over the text is kept, and a
linear layer gives the logit. The embeddings start from how much more often a
bucket's words occur in toxic training texts; all weights are then trained by
gradient steps through the maxima. Thresholds are calibrated by the language that
the text itself shows (its accented letters), and a score is shifted so that the
threshold of its language is 0.7.

Training sees a bounded sample of the labelled rows outside the held-out fold: whole
texts of ``MAX_POSITIVE`` and ``MAX_NEGATIVE`` ids by hash, one text an id, those of at
most ``MAX_BYTES`` bytes (so 104 MB in all at most). Labels, lang, source and id are no
inputs of a score.

Edge cases: a null or empty text has no words and gets the score of the bias
alone; without labels of both kinds every score is the same low number; labels
that are null are left out; repeated rows get equal scores; of the texts that share a
labelled id the least one trains; a null id is a valid row that is not held out; very
long texts are scored whole; of equal logits none is cut off from the others; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.batches import slices
from lectern.llm.common import table

MAX_POSITIVE, MAX_NEGATIVE = 2500, 4000
MAX_BYTES = 16 << 10
BUCKETS, SIZE = 1 << 17, 8
WIDTHS, FILTERS = (1, 2, 3), 8
EPOCHS, BATCH = 4, 32
#: Contrast (in standard deviations) that chance alone does not reach often.
NOISE = 6.0
#: Score at the threshold of a language.
CUT = 0.7
#: Letters that show a language or a script; texts with few of them are "plain".
MARKS = {
    "de": "[äöüß]",
    "fr": "[éèêçàùîïô]",
    "es": "[ñóíáú]",
    "pt": "[ãõ]",
    "pl": "[ąćęłńśźż]",
    "nordic": "[åøæ]",
    "tr": "[ğış]",
    "cyrillic": r"\p{Cyrillic}",
    "greek": r"\p{Greek}",
    "arabic": r"\p{Arabic}",
    "hebrew": r"\p{Hebrew}",
    "indic": r"[\p{Devanagari}\p{Bengali}\p{Tamil}]",
    "han": r"\p{Han}",
    "kana": r"[\p{Hiragana}\p{Katakana}]",
    "hangul": r"\p{Hangul}",
}
#: A language shows if its letters are one in so many.
SHARE = 150
#: Positives in the calibration part that a threshold of its own takes.
OWN_CUT = 15


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, the word at each place, and where each text begins (one more at the end)."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL]+", " ")
    lists = pc.split_pattern(pc.utf8_trim(plain, " "), " ")
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
    real = np.fromiter((w != "" for w in names), bool, len(names))
    which = coded.indices.to_numpy(zero_copy_only=False)
    held = real[which] if len(which) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(held)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return hashes, which[held], ends


def shown(texts: pa.Array) -> np.ndarray:
    """The language each text shows, as a number; 0 is plain."""
    texts, found = pc.fill_null(texts, ""), np.zeros(len(texts), int)
    beyond = np.flatnonzero(~pc.string_is_ascii(texts).to_numpy(zero_copy_only=False)) if len(texts) else found
    if len(beyond):
        texts = pc.utf8_lower(texts.take(pa.array(beyond)))
        counts = np.stack([pc.count_substring_regex(texts, m).to_numpy(zero_copy_only=False) for m in MARKS.values()], axis=1)
        length = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        found[beyond] = np.where(counts.max(axis=1) * SHARE >= length, counts.argmax(axis=1) + 1, 0)
    return found


def buckets(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes % np.uint64(BUCKETS)).astype(np.int64), ((hashes >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Model:
    """Two embedding tables side by side, kernels and offsets by width, the linear layer, thresholds by language."""

    one: np.ndarray
    two: np.ndarray
    kernels: dict = field(default_factory=dict)
    offsets: dict = field(default_factory=dict)
    out: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    bias: float = -3.0
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(len(MARKS) + 1))

    def responses(self, hashes: np.ndarray, which: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The greatest response of each filter over each text, not under 0."""
        a, b = buckets(hashes)
        words = np.concatenate([self.one[a], self.two[b]], axis=1)
        n, filled = len(which), np.flatnonzero(np.diff(ends))
        found = np.zeros((len(ends) - 1, len(self.out)), np.float32)
        for k, w in enumerate(WIDTHS):
            if n < w:
                continue
            runs = np.broadcast_to(self.offsets[w], (n - w + 1, FILTERS)).copy()
            for o in range(w):
                runs += (words @ self.kernels[w][o])[which[o : n - w + 1 + o]]
            # Windows that begin in one text and end in the next count for none.
            runs = np.concatenate([runs, np.full((w - 1, FILTERS), -np.inf, np.float32)])
            for o in range(1, w):
                runs[ends[1:][ends[1:] >= o] - o] = -np.inf
            if len(filled):
                found[filled, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(runs, ends[filled], axis=0)
        return np.maximum(found, 0)

    def logits(self, texts: pa.Array) -> np.ndarray:
        return self.responses(*tokens(texts)) @ self.out + self.bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        return squash(self.logits(texts) - self.cuts[shown(texts)] + np.log(CUT / (1 - CUT)))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.asarray(x, float), -30, 30)))


def contrast(bucket: np.ndarray, text: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How much surer than chance a bucket speaks for label 1: the signed root of the log-likelihood ratio of its document frequencies."""
    at = np.unique(text.astype(np.int64) * BUCKETS + bucket)
    seen = np.unique(text)
    hot = y[at // BUCKETS] == 1
    pos, neg = (np.bincount(at[m] % BUCKETS, minlength=BUCKETS).astype(float) for m in (hot, ~hot))
    share = y[seen].mean()
    part = lambda k, p: k * np.log(np.maximum(k, 1e-9) / np.maximum((pos + neg) * p, 1e-9))
    ratio = np.sqrt(np.maximum(2 * (part(pos, share) + part(neg, 1 - share)), 0))
    return np.clip(np.where(pos > (pos + neg) * share, ratio, -ratio) / NOISE, -1, 2).astype(np.float32)


def started(seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    small = lambda *shape: (rng.standard_normal(shape) * 0.05).astype(np.float32)
    m = Model(small(BUCKETS, SIZE), small(BUCKETS, SIZE))
    for w in WIDTHS:
        m.kernels[w] = small(w, 2 * SIZE, FILTERS)
        for f in range(FILTERS):
            m.kernels[w][f % w, [0, SIZE], f] = 0.7
        m.offsets[w] = np.full(FILTERS, -0.7, np.float32)
    m.out = np.full(len(WIDTHS) * FILTERS, 0.3, np.float32)
    m.bias = -1.0
    return m


def train(texts: pa.Array, labels: np.ndarray) -> Model:
    """A model of the given texts and 0/1 labels; a fifth of them only sets the thresholds."""
    y = np.asarray(labels, int)
    if not 0 < y.sum() < len(y):
        m = started()
        m.out[:] = 0
        m.bias = -3.0
        return m
    rng = np.random.default_rng(11)
    order = rng.permutation(len(y))
    tuned, learnt = order[: len(y) // 5], order[len(y) // 5 :]
    if not 0 < y[learnt].sum() < len(learnt):
        tuned, learnt = order[:0], order
    m = started()
    hashes, which, ends = tokens(texts)
    a, b = (x.astype(np.int32)[which] for x in buckets(hashes))
    del hashes, which
    text = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(ends))
    inside = np.isin(np.arange(len(y)), learnt)[text]
    text = text[inside]
    m.one[:, 0], m.two[:, 0] = contrast(a[inside], text, y), contrast(b[inside], text, y)
    weight = np.where(y == 1, min(8.0, (len(learnt) - y[learnt].sum()) / y[learnt].sum()), 1.0)
    memory = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in _dense(m).items()}
    step = 0
    for _ in range(EPOCHS):
        learnt = rng.permutation(learnt)
        for at in range(0, len(learnt), BATCH):
            step += 1
            _learn(m, memory, step, learnt[at : at + BATCH], a, b, ends, y, weight)
    _calibrate(m, texts, y, tuned if len(tuned) else learnt)
    return m


def _dense(m: Model) -> dict:
    return {**{f"k{w}": m.kernels[w] for w in WIDTHS}, **{f"o{w}": m.offsets[w] for w in WIDTHS}, "out": m.out}


def _learn(m: Model, memory: dict, step: int, rows: np.ndarray, a: np.ndarray, b: np.ndarray, ends: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
    """One gradient step over a few texts."""
    grads = {k: np.zeros_like(v) for k, v in _dense(m).items()}
    touched: list[tuple[np.ndarray, np.ndarray]] = []
    bias = 0.0
    for r in rows:
        i, j = a[ends[r] : ends[r + 1]], b[ends[r] : ends[r + 1]]
        words = np.concatenate([m.one[i], m.two[j]], axis=1)
        best, value = {}, np.zeros(len(m.out), np.float32)
        for k, w in enumerate(WIDTHS):
            if len(i) >= w:
                runs = m.offsets[w] + sum(words[o : len(i) - w + 1 + o] @ m.kernels[w][o] for o in range(w))
                best[w] = runs.argmax(axis=0)
                value[k * FILTERS : (k + 1) * FILTERS] = np.maximum(runs[best[w], np.arange(FILTERS)], 0)
        error = float(squash(value @ m.out + m.bias) - y[r]) * weight[r] / len(rows)
        bias += error
        grads["out"] += error * value
        for k, w in enumerate(WIDTHS):
            for f in np.flatnonzero(value[k * FILTERS : (k + 1) * FILTERS]) if w in best else ():
                g, p = error * m.out[k * FILTERS + f], best[w][f]
                grads[f"o{w}"][f] += g
                grads[f"k{w}"][:, :, f] += g * words[p : p + w]
                touched += [((i[p + o], j[p + o]), g * m.kernels[w][o, :, f]) for o in range(w)]
    for (i, j), g in touched:
        m.one[i] -= 0.5 * g[:SIZE]
        m.two[j] -= 0.5 * g[SIZE:]
    m.bias -= 0.05 * bias
    for k, v in _dense(m).items():
        first, second = memory[k]
        first += 0.1 * (grads[k] - first)
        second += 0.001 * (grads[k] ** 2 - second)
        v -= 0.005 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)


def _calibrate(m: Model, texts: pa.Array, y: np.ndarray, rows: np.ndarray) -> None:
    """The threshold of each language with most right answers by F1, in the middle of the gap it lies in."""
    part = texts.take(pa.array(rows))
    logit, lang, y = m.logits(part), shown(part), y[rows]
    m.cuts[:] = _cut(logit, y)
    for k in range(len(m.cuts)):
        own = lang == k
        if y[own].sum() >= OWN_CUT:
            m.cuts[k] = _cut(logit[own], y[own])


def _cut(logit: np.ndarray, y: np.ndarray) -> float:
    if not y.any():
        return 0.0
    order = np.argsort(-logit, kind="stable")
    x, hit = logit[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(x) + 1) + y.sum())
    f1[:-1][x[:-1] == x[1:]] = -1
    k = int(f1.argmax())
    return float((x[k] + x[k + 1]) / 2 if k + 1 < len(x) else x[k] - 1)


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Model:
    """The model of a bounded sample of the labelled rows outside the held-out fold."""
    usable = labels.filter(F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    parts = [usable.filter(F.col("y") == v).orderBy(F.xxhash64("id"), "id").limit(n) for v, n in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE))]
    # At most MAX_POSITIVE + MAX_NEGATIVE ids are broadcast, and as many texts of at most MAX_BYTES come back.
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.octet_length("text") <= MAX_BYTES)
    chosen = chosen.join(F.broadcast(parts[0].unionAll(parts[1])), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    got = chosen.toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    return train(got["text"].cast(pa.string()).combine_chunks(), got["y"].to_numpy())


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """id, held_out, score, predicted for every row."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, id_col, text_col, label_col))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(model.value.scores(part.column("text")), pa.float64())], ["id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    made = rows.mapInArrow(scored, "id long, held_out boolean, score double")
    return made.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
