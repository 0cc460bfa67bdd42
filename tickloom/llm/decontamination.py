"""Benchmark decontamination: an FM-index of each training shard is searched for all test phrases.

The corpus never moves: each task cuts its documents into shards, indexes each and searches it for every
phrase (10 consecutive words of an item, or a whole shorter item), locates the occurrences and merges their
word spans. A word that no phrase has cannot be in an occurrence, so such words cut a document into runs,
and runs shorter than the shortest phrase are left out of the index; this loses no occurrence.

The phrases are read in blocks of at most PHRASES, each broadcast on its own; one pass over the corpus per
block. With one block each row goes through the search itself; with several the rows are written once with a number
of their own, and the blocks' spans are merged by that. Words are compared by 64-bit fingerprints.

Cases: null or wordless texts (document or item) have no words and no phrase; items without item_id are no
test items; repeated rows of the benchmark count once, repeated documents each have their own row, and so have
documents without doc_id and those that share a doc_id but not their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..functions.lineage import stage as written
from .fmindex import FMIndex
from .text import ALNUM_SPLIT, Words, list_array, map_pieces, pieces, signed, small_batches, text_bytes

WINDOW = 10
#: Phrases in one broadcast: at most so many times WINDOW numbers of 8 bytes.
PHRASES = 500_000
#: Indexed words in a shard, and words read for it, at most (or one piece of text).
SHARD, SHARD_WORDS = 1 << 20, 8 << 20

SPAN = StructType([StructField("first", IntegerType()), StructField("last", IntegerType())])
FOUND = StructType([StructField("n_words", LongType()), StructField("spans", ArrayType(SPAN)), StructField("items", ArrayType(LongType()))])


def _phrase_rows(window: int):
    def rows(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        words = Words(*text_bytes(piece.column("text")), ALNUM_SPLIT, lower=True)
        h, counts = words.hashes(), words.counts()
        starts = words.window_starts(window)
        short = words.offsets[:-1][(counts > 0) & (counts < window)]
        at = np.concatenate([starts, short])
        doc = np.searchsorted(words.offsets, at, side="right") - 1
        sizes = np.minimum(window, words.offsets[doc + 1] - at)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        flat = h[np.repeat(at - offsets[:-1], sizes) + np.arange(offsets[-1])] if len(at) else h[:0]
        return pa.record_batch([piece.column("item_id").take(pa.array(doc)), list_array(signed(flat), offsets)], ["item_id", "phrase"])

    return rows


class PhraseBook:
    """The distinct phrases of a block by length, the items of each, and the vocabulary."""

    def __init__(self, items: list[int], phrases: list[list[int]]):
        by_length: dict[int, tuple[list, list]] = {}
        for item, phrase in zip(items, phrases, strict=True):
            a, b = by_length.setdefault(len(phrase), ([], []))
            a.append(phrase)
            b.append(item)
        self.vocabulary = np.unique(np.array([x for p in phrases for x in p], np.int64).view(np.uint64))
        self.groups = []  # of one length: matrix of symbols, offsets into items, items
        for length, (rows, owners) in sorted(by_length.items()):
            matrix = np.searchsorted(self.vocabulary, np.array(rows, np.int64).view(np.uint64)) + 1
            distinct, inverse = np.unique(matrix, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([inverse.ravel(), np.array(owners, np.int64)], 1), axis=0)
            self.groups.append((length, distinct, np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1]))
        self.shortest = min(by_length, default=1)
        self.sieve = np.zeros(1 << 18, bool)
        self.sieve[(self.vocabulary & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """1.. for words of the vocabulary, else 0."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.sieve[(hashes & np.uint64((1 << 18) - 1)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at + 1, 0)
        return out


class _Shard:
    def __init__(self, book: PhraseBook, carried: list[str]):
        self.book, self.carried, self.rows, self.counts = book, carried, [], []
        self.text, self.doc, self.word = [], [], []
        self.docs = self.indexed = self.words = 0

    def add(self, piece: pa.RecordBatch) -> None:
        words = Words(*text_bytes(piece.column("text")), ALNUM_SPLIT, lower=True)
        symbols = self.book.symbols(words.hashes())
        known = symbols > 0
        begins = known.copy()
        begins[1:] &= ~known[:-1]
        edge = words.offsets[1:-1]
        edge = edge[edge < len(words)]
        begins[edge] |= known[edge]
        at = np.flatnonzero(known)
        run = np.cumsum(begins)[at] - 1
        sizes = np.bincount(run, minlength=1)
        at = at[sizes[run] >= self.book.shortest] if len(at) else at
        doc = np.searchsorted(words.offsets, at, side="right") - 1
        lead = begins[at].astype(np.int64)
        place = np.arange(len(at)) + np.cumsum(lead)
        size = len(at) + int(lead.sum())
        for kept, values in ((self.text, symbols[at]), (self.doc, doc + self.docs), (self.word, at - words.offsets[doc])):
            x = np.zeros(size, np.int64)
            x[place] = values
            kept.append(x)
        self.rows.append(piece.select(self.carried))
        self.counts.append(words.counts())
        self.docs += piece.num_rows
        self.indexed += size
        self.words += len(words)

    def found(self) -> pa.RecordBatch:
        text, doc, word = (np.concatenate([*x, [0]]) for x in (self.text, self.doc, self.word))
        cover, pairs = np.zeros(len(text) + 1, np.int64), [np.zeros((0, 2), np.int64)]
        index = FMIndex(text) if len(text) > 1 else None
        for length, phrases, offsets, owners in self.book.groups if index else []:
            low, high = index.search(phrases)
            n = high - low
            which = np.repeat(np.arange(len(phrases)), n)
            rows = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            at = index.locate(rows)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
            seen = np.unique(doc[at] * len(phrases) + which)
            d, which = seen // len(phrases), seen % len(phrases)
            m = offsets[which + 1] - offsets[which]
            item = owners[np.repeat(offsets[which] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())] if len(m) else owners[:0]
            pairs.append(np.stack([np.repeat(d, m), item], 1))
        hit = np.cumsum(cover[:-1]) > 0
        edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        spans = pa.StructArray.from_arrays([pa.array(word[first].astype(np.int32)), pa.array(word[last].astype(np.int32))], ["first", "last"])
        items = np.unique(np.concatenate(pairs), axis=0)
        every = np.arange(self.docs + 1)
        rows = [pa.concat_arrays([x.column(c) for x in self.rows]) for c in self.carried]
        return pa.record_batch(
            [*rows, pa.array(np.concatenate(self.counts).astype(np.int64)), list_array(spans, np.searchsorted(doc[first], every)), list_array(items[:, 1], np.searchsorted(items[:, 0], every))],
            [*self.carried, *FOUND.names],
        )


def _search(docs: DataFrame, book, carried: list[str]) -> DataFrame:
    """The carried columns, n_words, spans and items of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(book.value, carried)
        for batch in batches:
            for piece in pieces(batch):
                shard.add(piece)
                if shard.indexed >= SHARD or shard.words >= SHARD_WORDS:
                    yield shard.found()
                    shard = _Shard(book.value, carried)
        if shard.docs:
            yield shard.found()

    small_batches(docs.sparkSession)
    rows = docs.select(*carried, *(["text"] if "text" not in carried else []))
    return rows.mapInArrow(run, StructType([*(StructField(c, rows.schema[c].dataType) for c in carried), *FOUND]))


def _merged(spans):
    """Sorted spans as few that don't overlap or touch."""
    entry = "struct<first:int,last:int>"
    return F.aggregate(
        F.array_sort(F.flatten(spans)),
        F.array().cast(f"array<{entry}>"),
        lambda done, x: F.when((F.size(done) > 0) & (x["first"] <= F.element_at(done, -1)["last"] + 1), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["last"], x["last"]).alias("last"))))).otherwise(
            F.concat(done, F.array(x))
        ),
    )


def find_phrases(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = PHRASES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, n_words, spans (first and last word of each hit stretch, from 0), items found, of every row."""
    phrases = map_pieces(benchmark.filter("item_id is not null").select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), _phrase_rows(window), "item_id long, phrase array<long>")
    phrases = written(phrases)
    blocks, keep = max(1, -(-phrases.count() // (most // 2 or 1))), list(keep)
    rows, carried = docs, keep
    if blocks > 1:
        columns = [*keep, *(["text"] if "text" not in keep else [])]
        rows, carried = written(docs.select(*columns, F.monotonically_increasing_id().alias("_row"))), ["_row"]
    context, found = docs.sparkSession.sparkContext, []
    for block in range(blocks):
        part = phrases.filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == block).toArrow()
        book = PhraseBook(part.column("item_id").to_pylist(), part.column("phrase").to_pylist())
        found.append(_search(rows, context.broadcast(book), carried))
    if blocks == 1:
        return found[0]
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x.filter(F.size("spans") > 0))
    every = every.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return rows.select("_row", *keep).join(every.withColumn("spans", _merged(F.col("spans"))), "_row").select(*keep, *FOUND.names)


def _cut(piece: pa.RecordBatch) -> pa.RecordBatch:
    texts = []
    for text, spans in zip(piece.column("text").to_pylist(), piece.column("spans").to_pylist(), strict=True):
        if not spans or text is None:
            texts.append(text)
            continue
        raw = text.encode()
        words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM_SPLIT, lower=True)
        out, at = [], 0
        for s in spans:
            out.append(raw[at : words.starts[s["first"]]])
            at = int(words.ends[s["last"]])
        texts.append(b"".join([*out, raw[at:]]).decode())
    return pa.record_batch([piece.column("row"), pa.array(texts, pa.string())], ["row", "text"])


def cut_phrases(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, most: int = PHRASES) -> DataFrame:
    """The columns of `keep` of every row, its text without the words inside an occurrence."""
    rows = docs.select("text", F.struct(*(c for c in keep if c != "text")).alias("row"))
    found = find_phrases(rows, benchmark, window, most, ("row", "text")).select("row", "text", "spans")
    cut = map_pieces(found, _cut, f"row {rows.schema['row'].dataType.simpleString()}, text string")
    return cut.select(*(F.col("text") if c == "text" else F.col(f"row.{c}").alias(c) for c in keep))
