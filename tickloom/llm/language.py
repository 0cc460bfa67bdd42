"""Language identification by rank-order profiles.

A profile is the most frequent letter n-grams (1 to 3, word ends marked) in order of frequency. Those of the
languages count all n-grams of all training documents; a document goes to the language whose profile its own
is least out of place with.

Cases: null texts and texts without a letter are `und` with score 0; without any training row all are `und`.
A document without lang trains nothing. n-grams of equal count are ordered by code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import map_pieces

DEPTH = 300
UNKNOWN = "und"
_BITS = 17
#: Bytes of text whose n-grams are counted at once: each byte takes some 200.
PIECE = 1 << 18
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Document and n-gram number of each n-gram. A character counts with its low 17 bits; 1 marks a word's end."""
    chars = np.frombuffer("\0".join((t or "").replace("\0", " ") for t in texts).lower().encode("utf-32-le", "replace"), np.uint32)
    doc = np.cumsum(chars == 0).astype(np.uint64)
    c = np.where(_is_letter()[chars], chars & ((1 << _BITS) - 1), 1).astype(np.uint64)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 1) | (c[:-1] != 1) | (chars[1:] == 0)
    c, doc = np.concatenate([[1], c[keep], [1]]).astype(np.uint64), np.concatenate([doc[:1], doc[keep], doc[-1:]]) if len(doc) else np.zeros(2, np.uint64)
    letter = c != 1
    s1, s2, s3 = np.uint64(2 * _BITS), np.uint64(_BITS), np.uint64(0)
    one, two, three = letter, letter[:-1] | letter[1:], letter[1:-1]
    grams = [(c << s1)[one], ((c[:-1] << s1) | (c[1:] << s2))[two], ((c[:-2] << s1) | (c[1:-1] << s2) | (c[2:] << s3))[three]]
    # an n-gram belongs to the document of a letter in it
    docs = [doc[one], np.where(letter[:-1], doc[:-1], doc[1:])[two], doc[1:-1][three]]
    return np.concatenate(docs), np.concatenate(grams)


def _counted(key: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, n-gram) in order, with counts. Keys are below 4096."""
    both = np.sort((key << np.uint64(3 * _BITS)) | gram)
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([first, [len(both)]]))
    both = both[first]
    return (both >> np.uint64(3 * _BITS)).astype(np.int64), both & np.uint64((1 << 3 * _BITS) - 1), counts


def _parts(piece: pa.RecordBatch):
    for at in range(0, piece.num_rows, 4000):
        yield piece.slice(at, 4000)


def _training_rows(piece: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for part in _parts(piece):
        langs = part.column("lang").to_pylist()
        names = sorted(set(langs))
        number = {x: i for i, x in enumerate(names)}
        doc, gram = _grams(part.column("text").to_pylist())
        key, gram, n = _counted(np.array([number[x] for x in langs], np.uint64)[doc.astype(np.int64)], gram)
        out.append(pa.record_batch([pa.array(names).take(pa.array(key)), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"]))
    return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(x.num_rows for x in out) else None


class Profiles:
    def __init__(self, rows: list, depth: int):
        """rows: lang, gram, place from 0."""
        self.depth, self.langs = depth, sorted({r["lang"] for r in rows})
        self.grams = np.unique(np.array([r["gram"] for r in rows], np.int64).view(np.uint64))
        self.places = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        for r in rows:
            self.places[np.searchsorted(self.grams, np.uint64(r["gram"])), self.langs.index(r["lang"])] = r["place"]

    def distances(self, n_docs: int, doc: np.ndarray, gram: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Out-of-place distance of each document to each language, and the n-grams compared."""
        order = np.argsort((doc << 40) - count, kind="stable")
        doc, gram = doc[order], gram[order]
        place = np.arange(len(doc)) - np.searchsorted(doc, np.arange(n_docs))[doc]
        top = place < self.depth
        doc, gram, place = doc[top], gram[top], place[top]
        at = np.searchsorted(self.grams, gram)
        at[(at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] != gram)] = len(self.grams)
        there = self.places[at]
        away = np.where(there < 0, self.depth, np.abs(there - place[:, None]))
        return np.stack([np.bincount(doc, away[:, i], n_docs) for i in range(len(self.langs))], 1), np.bincount(doc, minlength=n_docs)


def _predictor(shared):
    def rows(piece: pa.RecordBatch) -> pa.RecordBatch:
        profiles, preds, scores = shared.value, [], []
        names = [*profiles.langs, UNKNOWN]
        for part in _parts(piece):
            n = part.num_rows
            doc, gram = _grams(part.column("text").to_pylist())
            key, gram, count = _counted(doc, gram)
            if not profiles.langs:
                preds += [UNKNOWN] * n
                scores.append(np.zeros(n))
                continue
            d, m = profiles.distances(n, key, gram, count)
            d = d / np.maximum(m, 1)[:, None]
            best = d.argmin(1)
            p = 1 / np.exp((d.min(1)[:, None] - d) / 10).sum(1)
            preds += [names[b] for b in np.where(m > 0, best, len(names) - 1)]
            scores.append(np.where(m > 0, p, 0.0))
        return pa.record_batch([*(c for c, x in zip(piece.columns, piece.schema.names, strict=True) if x != "text"), pa.array(preds, pa.string()), pa.array(np.concatenate(scores))], [*(x for x in piece.schema.names if x != "text"), "lang_pred", "score"])

    return rows


def learn_profiles(training: DataFrame, depth: int = DEPTH) -> Profiles:
    """Profiles of the languages of text, lang rows; depth n-grams a language come to the driver."""
    rows = training.select("text", "lang").filter("text is not null and lang is not null")
    counts = map_pieces(rows, _training_rows, "lang string, gram long, n long", most=PIECE).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # a limit that Spark knows to keep before the exchange, too
    top = counts.withColumn("i", F.row_number().over(by)).filter(F.col("i") <= depth)
    return Profiles(top.select("lang", "gram", (F.col("i") - 1).alias("place")).collect(), depth)


def identify(docs: DataFrame, profiles: Profiles, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns of `keep`), lang_pred, score for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    if keep is None:
        return map_pieces(docs.select("doc_id", "text"), _predictor(shared), "doc_id long, lang_pred string, score double", most=PIECE)
    rows = docs.select(F.struct(*keep).alias("row"), "text")
    return map_pieces(rows, _predictor(shared), f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double", most=PIECE).select("row.*", "lang_pred", "score")
