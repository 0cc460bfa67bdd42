"""Quality by co-training: a classifier of the text and one of the page metadata teach each other.

* Text view: shares of character classes, repetition of words and lines, word lengths. Metadata view: source and lang
  (hashed into buckets) and n_chars.
* Each view starts from labelled rows. The pool is all unlabelled rows. In each round every view labels the rows of the pool
  that it is most sure of (beyond CONFIDENT, about a share of the pool per round) for the other view, with half weight.
  Then both views take STEPS turns of Newton's method, whose sums over the pool are added up on executors.
* Which rows a view is most sure of is told by a histogram of its log odds: the bins from the surest down that
  hold at most the share, and the surest in any case, so rows that are equally sure are treated alike.
* The pool's features are a stage table. A row's labels follow from the models and bounds of the rounds so far, so nothing is written per round.
* On labelled rows that trained neither view, each view is calibrated and the two are combined by a logistic model, so
  that a view that says nothing weighs nothing. All documents are scored by both views.

Learning takes at most SAMPLE labelled rows (smallest hash of doc_id); pool and scores cover all rows.

Cases: rows without doc_id are in the pool; of rows with one doc_id each counts; null and empty texts are scored by their (zero) shares; null metadata are a value of their own; without labels
all scores are 0.5; a null label is none. Each row gives one row.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import dropped
from ..functions.lineage import stage as written
from .logistic import Logistic
from .text import BLANK_SPLIT, Words, list_array, map_pieces, text_bytes
from .toxicity import labelled_sample

SAMPLE = 20_000
ROUNDS, CONFIDENT, PER_ROUND, HALF = 4, 0.95, 0.1, 0.5
#: Turns of Newton's method in a round; bins of log odds, from those of CONFIDENT to MOST.
STEPS, BINS, MOST = 2, 4096, 35.0
SOURCES, LANGS = 32, 8

_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", "!", "?", ".", ",", "%*&#$@", "|", "\"'`", "<>{}[]()", ":;/\\-_=+~^"]
_CLASS_OF = np.full(256, len(_CLASSES), np.int64)
for _i, _letters in enumerate(_CLASSES):
    _CLASS_OF[list(_letters.encode())] = _i
_LINES = np.ones(256, bool)
_LINES[[0x0A, 0x0D]] = False
TEXT_FEATURES = len(_CLASSES) + 1 + 7
META_FEATURES = SOURCES + LANGS + 3


def _distinct_share(words: Words) -> np.ndarray:
    """Distinct words (or lines) over all, of each text; 1 for none."""
    n = words.counts()
    pairs = np.unique((words.doc_of_word().astype(np.uint64) << np.uint64(44)) | (words.hashes() >> np.uint64(20)))
    distinct = np.bincount((pairs >> np.uint64(44)).astype(np.int64), minlength=len(n))
    return np.where(n > 0, distinct / np.maximum(n, 1), 1.0)


def text_features(column: pa.Array) -> np.ndarray:
    raw, bounds = text_bytes(column)
    n, size = len(column), np.maximum(np.diff(bounds), 1)
    classes, width = _CLASS_OF[raw], len(_CLASSES) + 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    shares = np.bincount(doc * width + classes, minlength=n * width).reshape(n, width) / size[:, None]
    words, lines = Words(raw, bounds, BLANK_SPLIT), Words(raw, bounds, _LINES)
    count = words.counts()
    length = np.bincount(words.doc_of_word(), words.ends - words.starts, n) / np.maximum(count, 1)
    last = words.raw[words.ends - 1] if len(words) else np.zeros(0, np.uint8)
    odd = np.isin(_CLASS_OF[last], [5, 9, 10])
    odd_share = np.bincount(words.doc_of_word(), odd, n) / np.maximum(count, 1)
    extra = [np.log1p(count), length, _distinct_share(words), _distinct_share(lines), odd_share, np.log1p(lines.counts()), count / np.maximum(lines.counts(), 1) / 100]
    return np.column_stack([shares, *extra])


def meta_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    out = np.zeros((len(source), META_FEATURES))
    bucket = lambda x, most: zlib.crc32(b"\0" if x is None else str(x).encode()) % most
    for i, (s, l, c) in enumerate(zip(source, lang, n_chars, strict=True)):
        out[i, bucket(s, SOURCES)] = 1
        out[i, SOURCES + bucket(l, LANGS)] = 1
        size = np.log1p(max(c or 0, 0))
        out[i, -3:] = size, size * size / 10, c is None
    return out


def labelled_by(history: list, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether no view has labelled each row yet, and the label that each row has for the text and the metadata view (NaN for none).

    history: of each round the models of both views and the least log odds by which they label.
    """
    free, given = np.ones(len(text), bool), np.full((2, len(text)), np.nan)
    for models, least in history:
        now = free.copy()
        for view, (model, x) in enumerate(zip(models, (text, meta), strict=True)):
            z = model.logit(x)
            sure = now & (np.abs(z) >= least[view])
            given[1 - view, sure] = z[sure] >= 0
            free &= ~sure
    return free, given


def _sureness(history: list, models: tuple):
    """A histogram of how sure each view is of the free rows, both one after the other."""
    lowest = np.log(CONFIDENT / (1 - CONFIDENT))

    def counts(text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        free, _ = labelled_by(history, text, meta)
        out = []
        for model, x in zip(models, (text, meta), strict=True):
            z = np.abs(model.logit(x[free]))
            cell = ((np.minimum(z[z >= lowest], MOST) - lowest) * (BINS / (MOST - lowest))).astype(np.int64)
            out.append(np.bincount(np.minimum(cell, BINS - 1), minlength=BINS))
        return np.concatenate(out).astype(float)

    return counts


def _least(counts: np.ndarray, most: float) -> float:
    """The log odds from which on at most so many rows lie, or the surest bin."""
    if not counts.any():
        return np.inf
    above = np.cumsum(counts[::-1])[::-1]
    first = min(int(np.argmax(above <= most)) if above[-1] <= most else BINS, int(np.flatnonzero(counts)[-1]))
    lowest = np.log(CONFIDENT / (1 - CONFIDENT))
    return lowest + first * ((MOST - lowest) / BINS)


def _newton(history: list, models: tuple):
    """Of the pool's labelled rows the sums of Newton's method for both views, and how many they are, as one array."""

    def sums(text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        _, given = labelled_by(history, text, meta)
        out = []
        for model, x, y in zip(models, (text, meta), given, strict=True):
            at = ~np.isnan(y)
            out += [a.ravel() for a in model.sums(x[at], y[at], np.full(at.sum(), HALF))] + [np.array([at.sum()], float)]
        return np.concatenate(out)

    return sums


class Pool:
    """Unlabelled rows: x, the features of both views."""

    def __init__(self, rows: DataFrame):
        self.rows, self.size = rows, rows.count()

    def summed(self, function: Callable[[np.ndarray, np.ndarray], np.ndarray], length: int) -> np.ndarray:
        """The sum over all rows of what the function gives for the features of some."""

        def parts(batches):
            total = np.zeros(length)
            for batch in batches:
                x = _matrix(batch.column("x"))
                total += function(x[:, :TEXT_FEATURES], x[:, TEXT_FEATURES:])
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["i", "v"])

        found = self.rows.mapInArrow(parts, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(length)
        out[found.column("i").to_numpy()] = found.column("v").to_numpy()
        return out


class CoTrained:
    """Both views, their calibration and their combination; fit() learns all."""

    def __init__(self):
        self.text: Logistic | None = None
        self.history, self.used = [], 0

    def fit(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, calibrate: np.ndarray, pool: Pool) -> CoTrained:
        if not len(y):
            return self
        views, own = (text[~calibrate], meta[~calibrate]), y[~calibrate]
        models = [Logistic(v, own) for v in views]
        sizes = [len(m.w) for m in models]
        for _ in range(ROUNDS if pool.size and len(np.unique(own)) == 2 else 0):
            now = tuple(copy(m) for m in models)
            counts = pool.summed(_sureness(self.history, now), 2 * BINS).reshape(2, BINS)
            if not counts.any():
                break
            self.history.append((now, [_least(c, PER_ROUND * pool.size) for c in counts]))
            for _ in range(STEPS):
                both = pool.summed(_newton(self.history, tuple(models)), sum(k * k + k + 1 for k in sizes))
                self.used = 0
                for model, v, k in zip(models, views, sizes, strict=True):
                    part, both = both[: k * k + k + 1], both[k * k + k + 1 :]
                    curvature, gradient = model.sums(v, own, np.ones(len(own)))
                    model.step(curvature + part[: k * k].reshape(k, k), gradient + part[k * k : -1])
                    self.used += int(part[-1])
        self.text, self.meta = models
        held = calibrate if calibrate.any() else np.ones(len(y), bool)
        z = [m.logit(v[held])[:, None] for m, v in ((self.text, text), (self.meta, meta))]
        self.calibrated = [Logistic(x, y[held]) for x in z]
        self.both = Logistic(np.column_stack([c.logit(x) for c, x in zip(self.calibrated, z, strict=True)]), y[held])
        return self

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text, by metadata, combined."""
        if self.text is None:
            half = np.full(len(text), 0.5)
            return half, half, half
        z = [c.logit(m.logit(v)[:, None]) for c, m, v in ((self.calibrated[0], self.text, text), (self.calibrated[1], self.meta, meta))]
        return tuple(1 / (1 + np.exp(-np.clip(x, -35, 35))) for x in z) + (self.both.probability(np.column_stack(z)),)


def _views(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return text_features(piece.column("text")), meta_features(*(piece.column(c).to_pylist() for c in ("source", "lang", "n_chars")))


def _rows(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"), *more)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, TEXT_FEATURES + META_FEATURES)


def _feature_rows(piece: pa.RecordBatch) -> pa.RecordBatch:
    x = np.column_stack(_views(piece)).astype(np.float32)
    return pa.record_batch([piece.column("doc_id"), list_array(x.ravel(), np.arange(len(x) + 1) * x.shape[1])], ["doc_id", "x"])


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, most: int = SAMPLE) -> CoTrained:
    # texts are read once; what is joined are features
    rows = written(map_pieces(_rows(docs), _feature_rows, "doc_id long, x array<float>"))
    found = rows.join(F.broadcast(labelled_sample(docs, labels, "quality", most, learn_from)), "doc_id").toArrow()
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    free = written(rows.join(labelled, "doc_id", "left_anti").select("x"))
    x = _matrix(found.column("x"))
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    x, q, ids = x[order], found.column("quality").to_numpy().astype(float)[order], found.column("doc_id").to_numpy()[order]
    calibrate = np.array([zlib.crc32(f"calibrate {i}".encode()) % 3 == 0 for i in ids.tolist()], bool)
    model = CoTrained().fit(x[:, :TEXT_FEATURES], x[:, TEXT_FEATURES:], (q > 0).astype(float), calibrate, Pool(free))
    dropped(rows, free)
    return model


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, text_score, meta_score, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(piece: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([piece.column("doc_id"), *map(pa.array, shared.value.scores(*_views(piece)))], ["doc_id", "text_score", "meta_score", "score"])

    return map_pieces(_rows(docs), rows, "doc_id long, text_score double, meta_score double, score double")
