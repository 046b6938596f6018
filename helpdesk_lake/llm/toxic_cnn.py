"""Toxicity by a convolutional text classifier trained in numpy.

Words (runs of letters and digits of the lower-cased text) are hashed into
``BUCKETS`` embeddings: a word's vector is the sum of those of the word and of
its beginnings of ``STEMS`` letters, so that inflected words share. Filters of widths ``WIDTHS`` slide over them, each keeps
its largest response anywhere in the text (max pooling), and a logistic layer
scores the pooled values. Pooling over the whole text finds one toxic phrase in
a very long document.

The fit reads at most ``SAMPLE_ROWS`` labelled rows (their word buckets go to the
driver; rows of more than ``SAMPLE_WORDS`` words are passed over for training,
never for scoring). Thresholds are calibrated per language on all labelled rows
outside the fold, by counts of (language, score bucket, label) made in Spark: the
``flagged`` column is the score against its language's threshold, or against
the overall one for languages with under ``FEW`` labels of either class. The
language chooses a threshold only; it is no input of the score.

Edge cases: null and empty texts are scored as texts of padding words; a null id
is returned and not held out; repeated rows are scored one by one; an empty
table gives no rows; without labels of both classes the score is the constant
class share (0.5 without any label). Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_rows, stored, training_rows

SAMPLE_ROWS, SAMPLE_WORDS, FEW = 6_000, 5_000, 20
BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 16, 16, 16, (1, 2, 3)
STEMS = (4, 5)
EPOCHS, BATCH, RATE = 6, 32, 0.05
#: Score buckets to one unit of log odds, for the thresholds.
FINE = 100
#: Words whose responses are held at a time.
BLOCK = 8_192
#: Words whose buckets a worker remembers.
REMEMBERED = 200_000
BITS, MASK = 20, (1 << 20) - 1
PAD = sum(BUCKETS << BITS * k for k in range(1 + len(STEMS)))

_WORD = re.compile(r"[^\W_]+")


@lru_cache(REMEMBERED)
def _features(word: str) -> int:
    """The buckets of a word and its beginnings, BITS bits each; a short word has no beginnings."""
    h = lambda x: xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) % BUCKETS
    packed = h(word)
    for k, size in enumerate(STEMS, 1):
        packed |= (h(f"{word[:size]}*{size}") if len(word) >= size else BUCKETS) << BITS * k
    return packed


def buckets(text: str | None) -> np.ndarray:
    """Packed word buckets of a whole text, padded to the widest filter."""
    found = _WORD.findall(text.lower()) if text else []
    out = np.full(max(len(found), max(WIDTHS)), PAD, np.int64)
    out[:len(found)] = np.fromiter(map(_features, found), np.int64, len(found))
    return out


def _vectors(table: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    x = table[tokens & MASK]
    for k in range(1, 1 + len(STEMS)):
        x += table[(tokens >> BITS * k) & MASK]
    return x


@dataclass
class ToxicModel:
    """``words``: (BUCKETS + 1, SIZE); ``filters``: per width (width, SIZE, FILTERS); the logistic layer; thresholds by language."""

    words: np.ndarray | None
    filters: list[np.ndarray]
    shift: np.ndarray
    weights: np.ndarray
    bias: float
    thresholds: dict[str, float]
    threshold: float = 0.5

    def pooled(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of every filter over all places, and where it is."""
        best, place, widest = np.full(len(self.weights), -np.inf, np.float32), np.zeros(len(self.weights), np.int64), max(WIDTHS)
        for at in range(0, max(1, len(tokens) - widest + 1), BLOCK):
            x = _vectors(self.words, tokens[at:at + BLOCK + widest - 1])
            for k, f in enumerate(self.filters):
                w = len(f)
                count = min(len(x) - w + 1, BLOCK + widest - w)
                r = x[:count] @ f[0]
                for j in range(1, w):
                    r += x[j:j + count] @ f[j]
                top, own = r.argmax(0), slice(k * FILTERS, (k + 1) * FILTERS)
                value = r[top, np.arange(FILTERS)]
                more = value > best[own]
                best[own], place[own] = np.where(more, value, best[own]), np.where(more, top + at, place[own])
        return best, place

    def score(self, tokens: np.ndarray) -> float:
        if self.words is None:
            return float(1 / (1 + np.exp(-self.bias)))
        z = float(np.maximum(self.pooled(tokens)[0] + self.shift, 0) @ self.weights + self.bias)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(texts: list[np.ndarray], y: np.ndarray) -> ToxicModel:
    """Adagrad over the logistic loss with classes weighted alike; the gradient of a pooled value reaches its own words only."""
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    model = ToxicModel(None, [], np.zeros(0), np.zeros(0), float(np.log(share / (1 - share))), {})
    if not len(y) or y.min() == y.max():
        return model
    rng, n = np.random.default_rng(11), FILTERS * len(WIDTHS)
    model.words = rng.normal(0, 0.3, (BUCKETS + 1, SIZE)).astype(np.float32)
    model.words[BUCKETS] = 0
    model.filters = [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    model.shift = np.zeros(n, np.float32)
    model.weights = rng.normal(0, 0.3, n).astype(np.float32)
    state = {"words": np.full((BUCKETS + 1, SIZE), 1e-3, np.float32), "shift": np.full(n, 1e-3), "weights": np.full(n, 1e-3), "bias": 1e-3,
             **{k: np.full(f.shape, 1e-3, np.float32) for k, f in enumerate(model.filters)}}
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            g_words: dict[int, np.ndarray] = {}
            g_filters = [np.zeros_like(f) for f in model.filters]
            g_shift, g_weights, g_bias = np.zeros(n, np.float32), np.zeros(n, np.float32), 0.0
            for i in rows:
                best, place = model.pooled(texts[i])
                hidden = np.maximum(best + model.shift, 0)
                p = 1 / (1 + np.exp(-np.clip(float(hidden @ model.weights + model.bias), -30, 30)))
                d = np.float32((p - y[i]) * weight[i] / len(rows))
                g_weights += d * hidden
                g_bias += float(d)
                back = d * model.weights * (hidden > 0)
                g_shift += back
                for k, w in enumerate(WIDTHS):
                    own = slice(k * FILTERS, (k + 1) * FILTERS)
                    for j in range(w):
                        at_words = texts[i][place[own] + j]
                        g_filters[k][j] += _vectors(model.words, at_words).T * back[own]
                        for word, part, on in zip(at_words.tolist(), (model.filters[k][j] * back[own]).T, back[own] != 0):
                            if on:
                                for b in range(0, BITS * (1 + len(STEMS)), BITS):
                                    bucket = (word >> b) & MASK
                                    g_words[bucket] = g_words[bucket] + part if bucket in g_words else part
            for name, value, g in (("shift", model.shift, g_shift), ("weights", model.weights, g_weights), *((k, f, g_filters[k]) for k, f in enumerate(model.filters))):
                state[name] += g * g
                value -= (RATE * g / np.sqrt(state[name])).astype(np.float32)
            state["bias"] += g_bias * g_bias
            model.bias -= RATE * g_bias / np.sqrt(state["bias"])
            touched = [k for k in g_words if k != BUCKETS]
            if touched:
                g = np.stack([g_words[k] for k in touched])
                state["words"][touched] += g * g
                model.words[touched] -= RATE * g / np.sqrt(state["words"][touched])
    return model


def _threshold(counts: dict[int, tuple[int, int]]) -> float:
    """The score in the middle between the last bucket of the best F1 and the next one; counts: (negatives, positives) by bucket."""
    places = sorted(counts, reverse=True)
    hit, rows = np.cumsum([counts[k][1] for k in places]), np.cumsum([sum(counts[k]) for k in places])
    k = int(np.argmax(2 * hit / (rows + hit[-1])))
    odds = lambda x: float(1 / (1 + np.exp(-x / FINE)))
    return (odds(places[k]) + (odds(places[k + 1] + 1) if k + 1 < len(places) else 0.0)) / 2


def calibrate(model: ToxicModel, scored: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", parts: int = 4, part: int = 2) -> ToxicModel:
    """The model with thresholds from all labelled rows of ``scored`` (id, lang, score) outside the fold."""
    bucket = F.floor(F.log(F.col("score") / (1 - F.col("score"))) * FINE).cast("int")
    rows = scored.join(labelled_rows(labels, id_col, label_col, parts, part), F.col("id") == F.col("_id"))
    found = rows.groupBy("lang", bucket.alias("bucket")).agg(F.sum(1 - F.col("_label")).alias("no"), F.sum("_label").alias("yes")).collect()
    by_lang: dict[str | None, dict[int, tuple[int, int]]] = {}
    for r in found:
        by_lang.setdefault(r["lang"], {})[r["bucket"]] = (r["no"], r["yes"])
    every: dict[int, tuple[int, int]] = {}
    for counts in by_lang.values():
        for k, (no, yes) in counts.items():
            every[k] = (every.get(k, (0, 0))[0] + no, every.get(k, (0, 0))[1] + yes)
    sums = lambda counts: [sum(c[k] for c in counts.values()) for k in (0, 1)]
    whole = _threshold(every) if every and min(sums(every)) else model.threshold
    return replace(model, threshold=whole, thresholds={k: _threshold(c) for k, c in by_lang.items() if k is not None and min(sums(c)) >= FEW})


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [buckets(t) for t in batch.column("text").to_pylist()]
        keep = pa.array([len(g) <= SAMPLE_WORDS for g in got], pa.bool_())
        rows = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("lang"), pa.array([g.tobytes() for g in got], pa.binary())],
                                          ["id", "label", "lang", "tokens"])
        yield rows.filter(keep)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                 label_col: str = "toxic", parts: int = 4, part: int = 2, bound: int = SAMPLE_ROWS) -> ToxicModel:
    rows = training_rows(labels, id_col, label_col, parts, part, bound)
    kind = docs.schema[id_col].dataType.simpleString()
    got = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
           .join(F.broadcast(rows), "_id").select(F.col("_id").alias("id"), F.col("_label").alias("label"), "lang", "text")
           .mapInArrow(_sample, f"id {kind}, label int, lang string, tokens binary").collect())
    got = sorted(got, key=lambda r: (r[0], r[1], r[3]))[:bound]
    return fit([np.frombuffer(r[3], np.int64) for r in got], np.array([r[1] for r in got], float))


def with_toxicity(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, lang, score) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores = [m.score(buckets(batch.column(1)[k].as_py())) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64())], ["id", "lang", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col, F.col(lang_col).cast("string").alias("_lang")).mapInArrow(run, f"id {kind}, lang string, score double")


def flagged(model: ToxicModel, lang: str = "lang", score: str = "score") -> Column:
    limit = F.lit(model.threshold)
    for name, value in model.thresholds.items():
        limit = F.when(F.col(lang) == name, F.lit(value)).otherwise(limit)
    return F.col(score) >= limit


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3) and flagged (threshold of the language) for every document."""
    model = fit_toxicity(docs, labels)
    scored = stored(with_toxicity(docs, model), "scored")
    model = calibrate(model, scored, labels)
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id"), 4, 2).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"), flagged(model).alias("flagged"))
