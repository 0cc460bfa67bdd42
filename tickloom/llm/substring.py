"""Substring deduplication by level-wise doubling.

A window of `length` words is removed where its word sequence has already started earlier (smaller doc_id,
or the same document further up). Candidates are found at a short length first, and only what repeats there
is looked at with twice the length, until the full length is reached:

1. Of the `base`-word windows inside each full window the one with the smallest fingerprint stands for it
   (equal windows choose alike). Those that occur once are done with: their full windows can't repeat.
2. Each survivor is extended to twice the length, to the right where that stays inside the full window, else
   to the left. What occurs once is dropped again. This repeats up to half the full length.
3. Full windows whose every level survived are fingerprinted; the first occurrence of each stays.

From the second level on the texts are dealt out to meet their survivors; all other shuffles carry fingerprints and
positions, and what a level shuffled goes once its survivors are written. Counts combine before the shuffle, and rows come back to their key by a join that AQE may split,
so a passage shared by a third of all documents makes no task that holds it whole.

Cases: null and empty texts have no words. A row without doc_id keeps all its words. Rows that share a
doc_id are at one place: repeated rows don't remove each other, and each row loses its own words only, those of windows
that start earlier. Fingerprints have 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import dropped
from ..functions.lineage import stage as written
from .text import BLANK_SPLIT, Words, map_pieces, mix, signed, text_bytes, window_hashes

LENGTH, BASE = 20, 5


def _leftmost_smallest(h: np.ndarray, width: int) -> np.ndarray:
    """For each i the index of the leftmost smallest of h[i:i+width]; the last few are cut short."""
    best, have = np.arange(len(h)), 1
    while have < width:
        step = min(have, width - have)
        right = np.concatenate([best[step:], np.full(min(step, len(best)), len(h) - 1)])[: len(best)]
        best = np.where(h[right] < h[best], right, best)
        have += step
    return best


class _Anchored:
    """Full windows of some texts, and the short window that stands for each."""

    def __init__(self, piece: pa.RecordBatch, length: int, base: int):
        self.words = Words(*text_bytes(piece.column("text")), BLANK_SPLIT)
        self.hashes = self.words.hashes()
        self.full = self.words.window_starts(length)
        n = len(self.words)
        starts = np.arange(max(0, n - base + 1))
        self.short = window_hashes(self.hashes, starts, base)
        self.anchor = _leftmost_smallest(self.short, length - base + 1)[self.full] if len(self.full) else self.full
        self.doc_start = self.words.offsets[:-1]

    def anchors(self) -> np.ndarray:
        """Distinct, ascending: the anchor never moves left as the window moves right."""
        a = self.anchor
        return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def _anchor_rows(length: int, base: int):
    def rows(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        found = _Anchored(piece, length, base)
        at = found.anchors()
        if not len(at):
            return None
        doc = np.searchsorted(found.words.offsets, at, side="right") - 1
        return pa.record_batch([pa.array(signed(found.short[at])), piece.column("r").take(pa.array(doc)), pa.array((at - found.doc_start[doc]).astype(np.int32))], ["h", "r", "at"])

    return rows


def _marks(piece: pa.RecordBatch, found: _Anchored, side: str, fill: bool) -> np.ndarray:
    """A flag for each word: is it the start of a surviving anchor."""
    lists = piece.column(side)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(lists.offsets.to_numpy()) if lists.null_count == 0 else np.array([len(x) if x is not None else 0 for x in lists.to_pylist()])
    mark = np.full(len(found.words), fill)
    mark[np.repeat(found.doc_start, sizes) + flat] = True
    return mark


def _extended_rows(length: int, base: int, level: int):
    """For each surviving anchor the fingerprints of its windows of `level` words to the right and to the left."""

    def rows(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        found = _Anchored(piece, length, base)
        out = []
        for kind, side in enumerate(("right", "left")):
            at = np.flatnonzero(_marks(piece, found, side, False))
            doc = np.searchsorted(found.words.offsets, at, side="right") - 1
            start = at if kind == 0 else at + base - level
            ok = (start >= found.doc_start[doc]) & (start + level <= found.words.offsets[doc + 1])
            at, doc, start = at[ok], doc[ok], start[ok]
            out.append((mix(window_hashes(found.hashes, start, level) + np.uint64(kind)), doc, at - found.doc_start[doc], np.full(len(at), kind == 1)))
        h, doc, at, left = map(np.concatenate, zip(*out, strict=True))
        return pa.record_batch([pa.array(signed(h)), piece.column("r").take(pa.array(doc)), pa.array(at.astype(np.int32)), pa.array(left)], ["h", "r", "at", "is_left"])

    return rows


def _full_rows(length: int, base: int):
    """Full windows whose anchor survived on the side that the window holds at every level."""

    def rows(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        found = _Anchored(piece, length, base)
        if not len(found.full):
            return None
        by_right = found.anchor + length // 2 <= found.full + length
        alive = np.where(by_right, _marks(piece, found, "right", False)[found.anchor], _marks(piece, found, "left", False)[found.anchor])
        start = found.full[alive]
        doc = np.searchsorted(found.words.offsets, start, side="right") - 1
        return pa.record_batch([pa.array(signed(window_hashes(found.hashes, start, length))), piece.column("tag").take(pa.array(doc)), piece.column("doc_id").take(pa.array(doc)), pa.array((start - found.doc_start[doc]).astype(np.int32))], ["h", "tag", "doc_id", "at"])

    return rows


def _survivors(rows: DataFrame) -> DataFrame:
    """By text the positions of the rows whose fingerprint occurs more than once; the rows are written, as they are read twice."""
    rows = written(rows)
    often = rows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    out = written(_by_row(rows.join(often, "h", "left_semi")))
    dropped(rows)
    return out


def _by_row(rows: DataFrame) -> DataFrame:
    """One row a text with the positions that survive on either side."""
    if "is_left" not in rows.columns:
        return rows.groupBy("r").agg(F.collect_set("at").alias("right")).withColumn("left", F.col("right"))
    side = lambda left: F.collect_set(F.when(F.col("is_left") == left, F.col("at")))
    return rows.groupBy("r").agg(side(False).alias("right"), side(True).alias("left"))


def later_windows(texts: DataFrame, length: int = LENGTH, base: int = BASE) -> DataFrame:
    """doc_id, tag, starts: the windows of each row whose word sequence starts earlier somewhere.

    texts has doc_id, text, r (a fingerprint of both) and tag (half of it, to tell rows of a doc_id apart). length is base
    times a power of two.
    """
    if base < 1 or length % base or (length // base) & (length // base - 1) or length < 2 * base:
        raise ValueError("length must be base times 2, 4, 8, ...")
    rows = texts.filter(F.col("doc_id").isNotNull())
    survivors = _survivors(map_pieces(rows.select("r", "text"), _anchor_rows(length, base), "h long, r long, at int"))
    level = 2 * base
    while level < length:
        extended = map_pieces(rows.select("r", "text").join(survivors, "r"), _extended_rows(length, base, level), "h long, r long, at int, is_left boolean")
        last, survivors = survivors, _survivors(extended)
        dropped(last)
        level *= 2
    full = written(map_pieces(rows.join(survivors, "r"), _full_rows(length, base), "h long, tag int, doc_id long, at int"))
    dropped(survivors)
    first = full.groupBy("h").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = written(full.join(first, "h").filter(F.struct("doc_id", "at") > F.col("first")).groupBy("doc_id", "tag").agg(F.collect_set("at").alias("starts")))
    dropped(full)
    return later


def _kept(length: int, whole: bool):
    def rows(piece: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(*text_bytes(piece.column("text")), BLANK_SPLIT)
        n, doc_start = len(words), words.offsets[:-1]
        lists = piece.column("starts")
        sizes = np.array([len(x) for x in lists]) if lists.null_count == 0 else np.array([len(x) if x.is_valid else 0 for x in lists])
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.repeat(doc_start, sizes) + flat
        at = at[at + length <= np.repeat(words.offsets[1:], sizes)]
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
        gone = np.cumsum(cover[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[words.offsets[1:]] - total[words.offsets[:-1]]
        texts = []
        raw = words.raw.tobytes()
        for d in range(piece.num_rows):
            a, b = words.offsets[d], words.offsets[d + 1]
            if whole and not removed[d]:
                texts.append(raw[words.bounds[d] : words.bounds[d + 1]])
                continue
            texts.append(b" ".join(raw[s:e] for s, e, g in zip(words.starts[a:b].tolist(), words.ends[a:b].tolist(), gone[a:b].tolist(), strict=True) if not g))
        columns = {"row": piece.column("row"), "n_words": pa.array(words.counts().astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)), "kept": pa.array(texts, pa.binary()).cast(pa.string())}
        return pa.record_batch(list(columns.values()), list(columns))

    return rows


def substring_dedup(docs: DataFrame, length: int = LENGTH, base: int = BASE, keep: list[str] | None = None, whole: bool = False) -> DataFrame:
    """doc_id (or the columns of `keep`), n_words, n_removed, kept: the words left of each document, joined by one space.

    whole: a document that loses nothing keeps its text as it is.
    """
    row, doc_id, r = F.struct(*keep) if keep else F.struct("doc_id"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text")
    texts = docs.select(doc_id, F.coalesce("text", F.lit("")).alias("text"), r.alias("r"), r.bitwiseAND(0x7FFFFFFF).cast("int").alias("tag"), row.alias("row"))
    starts = later_windows(texts.drop("row"), length, base)
    out = map_pieces(texts.drop("r").join(starts, ["doc_id", "tag"], "left"), _kept(length, whole), f"row {texts.schema['row'].dataType.simpleString()}, n_words long, n_removed long, kept string")
    return out.select("row.*", "n_words", "n_removed", "kept")
