"""Near-duplicate classes: ProbMinHash signatures, banding, exact verification, connected components.

1. Documents with one word sequence are one node: the smallest doc_id stands for all.
2. ProbMinHash: each distinct shingle (5 words) of a document sends points of a Poisson process whose rate is its
   weight, each into a random register; a register keeps the earliest arrival. A shingle stops once its next point
   comes after the latest register, so most end after a point or two. Two documents agree in a register with the
   probability Jaccard of their weights. The weight is 1 + ln(occurrences). Classes are decided by the shingle sets,
   so a document that repeats a shingle has a second signature with equal weights, whose share of equal registers is
   the set Jaccard; for the others both are the same.
3. Banding: 24 bands of 4 registers of either signature. A pair at a set Jaccard of 0.8 shares no band of equal weights
   once in 300,000 times.
4. In a bucket each member is held against three leaders (the member with most company, smallest doc_id, smallest
   hash), never all pairs. Pairs far below the threshold by their signatures of equal weights go; the others are verified on
   their shingle sets.
5. What leaders can't settle: members of a bucket that ended in different components and were not compared. Two of them
   that are alike share a shingle which the first leader has not, but for pairs that their sizes and the shingles in
   common with the leader let pass, which are compared. The others fall into groups by such shingles (of those that occur
   in several components the rarest that must hold a shared one), each with leaders of its own, until no group is left. Groups of at most SMALL members have no need of leaders.
6. Components by alternating large and small stars.

Cases: texts of one to four words are one shingle; wordless texts (not null) are copies if their bytes are equal; a
null text has no partner; a row without doc_id has no class. Rows that share a doc_id are one document. No row is
lost or added; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import stage as written
from .text import ALNUM_SPLIT, Words, list_array, map_pieces, mix, range_hashes, signed, text_bytes, window_hashes

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
#: Pairs whose share of equal registers (of equal weights) is lower than the threshold by this (5 standard errors) aren't verified.
MARGIN = 0.2
#: Members of a group of at most so many, once split, are all compared.
SMALL = 32
_U = np.uint64
_HASH_BITS = 44


def _shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and fingerprint of each shingle."""
    h, counts = words.hashes(), words.counts()
    full = words.window_starts(size)
    short = np.flatnonzero((counts > 0) & (counts < size))
    doc = np.searchsorted(words.offsets, full, side="right") - 1
    return np.concatenate([doc, short]), np.concatenate([window_hashes(h, full, size), range_hashes(h, words.offsets[short], words.offsets[short + 1])])


def _distinct(doc: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text, 44 bits of the fingerprint) as one number, and counts."""
    return np.unique((doc.astype(np.uint64) << _U(_HASH_BITS)) | (shingle >> _U(64 - _HASH_BITS)), return_counts=True)


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """The element that arrives first in each register of each document (0 without any)."""
    best, who = np.full(n_docs * registers, np.inf), np.zeros(n_docs * registers, np.uint64)
    seed, x, live, turn = mix(element + _U(0x51ED270B)), np.zeros(len(element)), np.arange(len(element)), 0
    while len(live):
        turn += 1
        u = mix(seed[live] + _U(turn * 0x9E3779B97F4A7C15 % 2**64))
        x[live] -= np.log1p(-((u >> _U(11)).astype(np.float64) * 2.0**-53)) / weight[live]
        register = doc[live] * registers + (mix(u) % _U(registers)).astype(np.int64)
        sooner = np.flatnonzero(x[live] < best[register])
        sooner = sooner[np.argsort(-x[live[sooner]], kind="stable")]
        best[register[sooner]] = x[live[sooner]]
        who[register[sooner]] = element[live[sooner]]
        open_docs = np.unique(doc[live])
        latest = np.zeros(n_docs)
        latest[open_docs] = best.reshape(n_docs, registers)[open_docs].max(1)
        live = live[x[live] < latest[doc[live]]]
    return who.reshape(n_docs, registers)


def _hashed_rows(bands: int, rows: int, size: int):
    def hashed(piece: pa.RecordBatch) -> pa.RecordBatch:
        column = piece.column("text")
        words, n = Words(*text_bytes(column), ALNUM_SPLIT, lower=True), piece.num_rows
        present = column.is_valid().to_numpy(zero_copy_only=False)
        key = range_hashes(words.hashes(), words.offsets[:-1], words.offsets[1:])
        bare = np.flatnonzero((words.counts() == 0) & present)
        for d in bare:
            raw = words.raw[words.bounds[d] : words.bounds[d + 1]].astype(np.uint64)
            key[d] = range_hashes(raw + _U(3), np.array([0]), np.array([len(raw)]))[0] ^ _U(0xABCDEF)
        both, count = _distinct(*_shingles(words, size))
        doc, element = (both >> _U(_HASH_BITS)).astype(np.int64), both & _U((1 << _HASH_BITS) - 1)
        who = prob_minhash(doc, element, 1 + np.log(count), n, bands * rows)
        some, repeating = np.unique(doc), np.unique(doc[count > 1])
        of = np.isin(doc, repeating)
        equal = who.copy()
        equal[repeating] = prob_minhash(np.searchsorted(repeating, doc[of]), element[of], np.ones(of.sum()), len(repeating), bands * rows)
        sketch = [s.tobytes() for s in (equal & _U(0xFFFF)).astype(np.uint16)]
        owner = np.concatenate([some, repeating])
        order = np.argsort(owner, kind="stable")
        signature = np.concatenate([who[some], equal[repeating]])[order].reshape(len(owner), bands, rows)
        flat = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93), (len(owner), bands)).copy()
        for i in range(rows):
            flat = mix(flat + signature[:, :, i] * _U(0x9E3779B97F4A7C15))
        return pa.record_batch(
            [piece.column("doc_id"), pa.array(signed(key), mask=~present), list_array(signed(flat.ravel()), np.searchsorted(owner[order], np.arange(n + 1)) * bands), pa.array(sketch, pa.binary()), pa.array(np.bincount(doc, minlength=n).astype(np.int32))],
            ["doc_id", "key", "bands", "sketch", "size"],
        )

    return hashed


def _agreeing(least: float):
    def rows(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
            yield batch.select(["a", "b"]).filter(pa.array((a == b).mean(1) >= least))

    return rows


def _verified(size: int, threshold: float):
    def rows(piece: pa.RecordBatch) -> pa.RecordBatch:
        sets = []
        for c in ("text_a", "text_b"):
            sets.append(_distinct(*_shingles(Words(*text_bytes(piece.column(c)), ALNUM_SPLIT, lower=True), size))[0])
        n = piece.num_rows
        in_both = np.intersect1d(*sets, assume_unique=True)
        a, b, both = (np.bincount((x >> _U(_HASH_BITS)).astype(np.int64), minlength=n) for x in (*sets, in_both))
        similarity = both / np.maximum(a + b - both, 1)
        return pa.record_batch([piece.column("a"), piece.column("b"), pa.array(similarity)], ["a", "b", "similarity"]).filter(pa.array(similarity >= threshold))

    return rows


def _verify(pairs: DataFrame, texts: DataFrame, sketches: DataFrame, size: int, threshold: float) -> DataFrame:
    """a, b, similarity of the pairs at or over the threshold."""
    held = pairs.join(sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sketch_a")).hint("merge"), "a").join(sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sketch_b")).hint("merge"), "b")
    likely = written(held.mapInArrow(_agreeing(threshold - MARGIN), "a long, b long"))
    text = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    both = likely.hint("shuffle_hash").join(text("b"), "b").join(text("a").hint("merge"), "a")
    return map_pieces(both, _verified(size, threshold), "a long, b long, similarity double", "text_b")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of the edges a, b, by large and small stars."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = written(small.filter("u <> v").distinct())
        roots = now.select("v").distinct()
        # done once all are stars: no node has two centres, and no centre has one
        if now.unionByName(roots.select(F.col("v").alias("u"), "v")).groupBy("u").count().filter("count > 1").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))


def _outside(size: int, threshold: float):
    """What each document has besides its group's first leader: one row with `most` (h null), one row a shingle h.

    A pair at the threshold shares threshold / (1 + threshold) of both sizes together. If all of it is in the leader, the
    partner has at most `most` shingles; else they share at least `need` of the rows h.
    """

    def rows(piece: pa.RecordBatch) -> pa.RecordBatch:
        own, lead = (_distinct(*_shingles(Words(*text_bytes(piece.column(c)), ALNUM_SPLIT, lower=True), size))[0] for c in ("text", "text_leader"))
        n, share = piece.num_rows, threshold / (1 + threshold)
        inside = np.isin(own, lead, assume_unique=True)
        doc = (own >> _U(_HASH_BITS)).astype(np.int64)
        x, both = np.bincount(doc, minlength=n), np.bincount(doc[inside], minlength=n)
        least = np.maximum(piece.column("least").to_numpy(), threshold * x)
        need = np.maximum(1, np.ceil(share * (x + least) - 1e-9).astype(np.int64) - both)
        keep = np.flatnonzero(~inside & (x - both >= need)[doc])
        at = np.concatenate([np.arange(n), doc[keep]])
        h = pa.array(np.concatenate([np.zeros(n, np.int64), signed(own[keep] & _U((1 << _HASH_BITS) - 1))]), mask=np.arange(len(at)) < n)
        most = np.floor(both / share - x + 1e-9).astype(np.int32)
        return pa.record_batch([*(piece.column(c).take(pa.array(at)) for c in ("g", "doc_id", "component", "size", "least")), pa.array(need[at].astype(np.int32)), pa.array(most[at]), h], ["g", "doc_id", "component", "size", "least", "need", "most", "h"])

    return rows


def _mixed(rows: DataFrame, *key: str) -> DataFrame:
    """The keys whose rows are of several components, with n and the smallest size."""
    found = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("size").alias("least"), F.min("component").alias("low"), F.max("component").alias("high"))
    return found.filter("low < high").drop("low", "high")


def _led(groups: DataFrame, small: int = 0) -> DataFrame:
    """g, doc_id, size with the group's leaders, first the member with most company; all members of groups of at most `small`. groups: g, doc_id, size."""
    by_hash = F.min(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id"))["doc_id"]
    sizes = groups.groupBy("g").agg(F.count("*").alias("n"), F.array(F.min("doc_id"), by_hash).alias("more")).filter("n > 1")
    shared = written(groups.join(sizes, "g"))
    company = shared.groupBy("doc_id").agg(F.sum("n").alias("company"))
    popular = shared.join(company, "doc_id").groupBy("g").agg(F.max(F.struct("company", (-F.col("doc_id")).alias("x")))["x"].alias("x"))
    led = shared.join(popular, "g")
    more = F.col("more")
    if small:
        every = shared.filter(F.col("n") <= small).groupBy("g").agg(F.array_sort(F.collect_set("doc_id")).alias("every"))
        led, more = led.join(every, "g", "left"), F.coalesce("every", "more")
    return written(led.select("g", "doc_id", "size", F.array_distinct(F.concat(F.array(-F.col("x")), more)).alias("leaders")))


def _pairs(led: DataFrame) -> DataFrame:
    rows = led.select("doc_id", F.explode("leaders").alias("leader")).filter("doc_id <> leader")
    return rows.select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")).distinct()


def _split(led: DataFrame, texts: DataFrame, labels: DataFrame, by_leader: bool, size: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Groups (g, doc_id, size) of documents that share a shingle their leader has not, pairs a, b that may be alike without one, and their texts."""
    open_ = led.filter(~F.array_contains("leaders", F.col("doc_id"))).join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    open_ = open_.select("g", "doc_id", "size", F.col("leaders")[0].alias("leader"), F.coalesce("component", "doc_id").alias("component"))
    open_ = open_.join(_mixed(open_, "g").select("g"), "g")
    if by_leader:
        open_ = open_.withColumn("g", F.col("leader")).distinct()
    open_ = written(open_)
    if open_.isEmpty():
        return None
    open_ = open_.join(_mixed(open_, "g").select("g", "least"), "g")
    texts = written(texts.join(open_.select("doc_id").union(open_.select("leader")).distinct(), "doc_id", "left_semi"))
    both = open_.join(texts, "doc_id").join(texts.select(F.col("doc_id").alias("leader"), F.col("text").alias("text_leader")), "leader")
    rows = written(map_pieces(both, _outside(size, threshold), "g long, doc_id long, component long, size int, least int, need int, most int, h long"))
    inside = rows.filter("h is null and most >= least")
    inside = inside.join(_mixed(inside, "g").select("g"), "g")
    other = inside.select("g", F.col("doc_id").alias("b"), F.col("component").alias("component_b"), F.col("size").alias("size_b"), F.col("most").alias("most_b"))
    pairs = inside.withColumnRenamed("doc_id", "a").join(other, "g").filter("component <> component_b and a < b and size_b <= most and size <= most_b").select("a", "b").distinct()
    # what two documents of different components share is in known; so many of its rarest hold a shared one
    tokens = rows.filter("h is not null")
    known = tokens.drop("least").join(_mixed(tokens, "g", "h").drop("least"), ["g", "h"])
    by = Window.partitionBy("g", "doc_id")
    known = known.withColumn("known", F.count("*").over(by)).filter("known >= need").withColumn("i", F.row_number().over(by.orderBy("n", "h"))).filter(F.col("i") <= F.col("known") - F.col("need") + 1)
    fine = known.select(F.xxhash64("g", "h").alias("g"), "doc_id", "component", "size")
    fine = written(fine.join(_mixed(fine, "g").select("g"), "g").select("g", "doc_id", "size"))
    same = fine.groupBy("g").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("x")).groupBy("n", "x").agg(F.min("g").alias("g"))
    return fine.join(same.select("g"), "g"), pairs, texts


def _between(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges a, b as edges of the components that labels gives their ends."""
    for x in ("a", "b"):
        edges = edges.join(labels.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")), x, "left").withColumn(f"of_{x}", F.coalesce(f"of_{x}", x))
    return edges.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))


def _joined(labels: DataFrame, over: DataFrame) -> DataFrame:
    """labels once components are joined as over says (its nodes are components, or nodes without one)."""
    over = over.select(F.col("node").alias("component"), F.col("component").alias("of"))
    moved = labels.join(over, "component", "left").select("node", F.coalesce("of", "component").alias("component"))
    return moved.unionByName(over.select(F.col("component").alias("node"), F.col("of").alias("component"))).distinct()


def near_classes(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) for every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = written(map_pieces(docs, _hashed_rows(bands, rows, size), "doc_id long, key long, bands array<long>, sketch binary, size int"))
    classes = hashed.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("node"))
    nodes = hashed.join(classes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sketches = nodes.filter(F.size("bands") > 0).select("doc_id", "sketch").dropDuplicates(["doc_id"])
    led = _led(nodes.select("doc_id", "size", F.explode("bands").alias("g")).dropDuplicates(["g", "doc_id"]))
    texts = written(docs.join(led.select("doc_id").distinct(), "doc_id", "left_semi"))
    labels, first = components(written(_verify(_pairs(led), texts, sketches, size, threshold))), True
    while (found := _split(led, texts, labels, first, size, threshold)) is not None:
        groups, pairs, texts = found
        if groups.isEmpty() and pairs.isEmpty():
            break
        led, first = _led(groups, SMALL), False
        extra = written(_verify(_pairs(led).unionByName(pairs).distinct(), texts, sketches, size, threshold))
        if not extra.isEmpty():
            labels = _joined(labels, components(_between(extra, labels)))
    node = hashed.select("doc_id", "key").join(classes, "key", "left").withColumn("node", F.coalesce("node", "doc_id"))
    # rows of one doc_id are one document, whatever their texts
    return node.join(labels, "node", "left").select("doc_id", F.coalesce("component", "node").alias("class_id"))
