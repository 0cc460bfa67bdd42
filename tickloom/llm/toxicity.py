"""Toxicity: a learned lexicon, Levenshtein automata against its trie, and the context of each hit.

1. Words much commoner in toxic than in other labelled documents become the lexicon; a word's weight is its smoothed
   log odds. All words of the labelled sample are counted.
2. A word that is no term itself is matched against the trie of all terms of SHORTEST_FUZZY letters or more by a
   Levenshtein automaton (one edit, a swap of neighbours included). Words within one edit of a term are equal to it once
   each has lost a letter at most; other words aren't tried.
3. Each hit is judged by its context window: quotation marks at the word and reporting verbs nearby make it a
   quotation, second person nearby makes it abuse.
4. A logistic model over the sums of both kinds gives the score. It learns from each half of the sample by the lexicon
   of the other half, so that it sees hits as they are on unseen texts; texts are scored by the lexicon of both halves.
   How much commoner a term must be is chosen by the log loss of a model of one part of the sample on the other.

At most SAMPLE labelled rows are learned from (those with the smallest hash of doc_id), which bounds the lexicon: all words
over the bound Z are terms.

Cases: null and empty texts have no hits and the score of a text without hits; without labelled rows all scores are
0.5; a null label is none; of several labels for a doc_id the highest counts; rows without doc_id are scored, not
learned from. Each row gives one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import stage as written
from .logistic import Logistic
from .text import ALNUM_SPLIT, Words, list_array, map_pieces, signed, text_bytes

#: Labelled rows learned from, and words on each side of a hit, at most.
SAMPLE, WINDOW = 40_000, 5
#: A term is at least so many standard deviations commoner in toxic documents than by chance (one of Z, the first where
#: nothing tells them apart), and in so many of them.
Z, LEAST = (6.0, 5.0, 4.5, 4.0), 3
SHORTEST_FUZZY = 4
#: Words that report what others say, and words that address the reader, in English, German, French, Spanish.
REPORTING = tuple("""
said says quote quoted quotes called wrote term word words reported insult slur phrase writes mentioned
sagte sagt schrieb nannte genannt wort wörter zitat zitierte begriff beleidigung
dit écrit écrivit appelé mot mots terme citation cité insulte
dijo dice escribió llamó llamado palabra palabras término cita citó insulto
""".split())
ADDRESSING = tuple("""
you your youre u ur yourself
du dich dir dein deine euch ihr
tu toi te ton ta vous votre
tú ti tus usted vosotros
""".split())


def edits_within_one(word: str, trie: dict) -> list[str]:
    """Terms of the trie within one edit (insert, delete, replace, swap): the automaton of `word` is run down the trie.

    A state is a set of (letters read, edits, letter owed by a swap).
    """
    n, found = len(word), []

    def closed(states: set) -> set:
        return states | {(i + 1, 1, None) for i, e, owed in states if e == 0 and owed is None and i < n}

    def step(states: set, letter: str) -> set:
        out = set()
        for i, e, owed in states:
            if owed is not None:
                if letter == owed:
                    out.add((i, e, None))
                continue
            if i < n and word[i] == letter:
                out.add((i + 1, e, None))
            if e == 0:
                out.add((i, 1, None))
                if i < n:
                    out.add((i + 1, 1, None))
                if i + 1 < n and word[i + 1] == letter:
                    out.add((i + 2, 1, word[i]))
        return closed(out)

    def walk(node: dict, states: set) -> None:
        if not states:
            return
        if (term := node.get("")) is not None and any(i == n and owed is None for i, _, owed in states):
            found.append(term)
        for letter, child in node.items():
            if letter:
                walk(child, step(states, letter))

    walk(trie, closed({(0, 0, None)}))
    return found


def trie_of(terms: list[str]) -> dict:
    root: dict = {}
    for term in terms:
        node = root
        for letter in term:
            node = node.setdefault(letter, {})
        node[""] = term
    return root


def _hash(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw]).astype(np.int64)
    w = Words(np.frombuffer(b" ".join(raw), np.uint8), np.array([0, len(b" ".join(raw))]), ALNUM_SPLIT)
    assert len(w) == len(ends)
    return w.hashes()


class Read:
    """The words of some texts with what each lexicon asks of them: hashes, the distinct ones, and these less a letter."""

    def __init__(self, column: pa.Array, shortest: int, longest: int):
        self.words = words = Words(*text_bytes(column), ALNUM_SPLIT, lower=True)
        self.h = words.hashes()
        self.distinct, self.first, self.inverse = np.unique(self.h, return_index=True, return_inverse=True)
        self.size = (words.ends - words.starts)[self.first]
        at = np.flatnonzero((self.size >= shortest) & (self.size <= longest))
        place, self.less = words.hashes_less_a_letter(self.first[at])
        self.owner = at[place]


class Lexicon:
    def __init__(self, terms: list[tuple[str, float]]):
        """terms: word and weight, the strongest first."""
        self.size = len(terms)
        h = _hash([t for t, _ in terms]) if terms else np.zeros(0, np.uint64)
        order = np.argsort(h)
        self.hashes, self.weights = h[order], np.array([w for _, w in terms])[order] if terms else np.zeros(0)
        fuzzy = [t for t, _ in terms if len(t) >= SHORTEST_FUZZY]
        self.weight_of, self.trie = dict(terms), trie_of(fuzzy)
        raw = " ".join(fuzzy).encode()
        words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM_SPLIT)
        self.reach = np.unique(np.concatenate([words.hashes(), words.hashes_less_a_letter(np.arange(len(words)))[1]]))
        self.sieve = np.zeros(1 << 18, bool)
        self.sieve[(self.reach & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
        lengths = [len(t.encode()) for t in fuzzy] or [0]
        self.lengths = min(lengths) - 4, max(lengths) + 4
        self.reporting, self.addressing = np.sort(_hash(list(REPORTING))), np.sort(_hash(list(ADDRESSING)))
        self.cache: dict[int, float] = {}

    def _reached(self, h: np.ndarray) -> np.ndarray:
        ok = self.sieve[(h & np.uint64((1 << 18) - 1)).astype(np.int64)]
        ok[ok] = self.reach[np.minimum(np.searchsorted(self.reach, h[ok]), len(self.reach) - 1)] == h[ok]
        return ok

    def hits(self, read: Read) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers, weights, and whether by the automaton."""
        h, first = read.h, read.first
        place = np.searchsorted(self.hashes, h)
        exact = np.flatnonzero((place < self.size) & (self.hashes[np.minimum(place, self.size - 1)] == h)) if self.size else np.zeros(0, np.int64)
        weight = np.zeros(len(h))
        weight[exact] = self.weights[place[exact]]
        near = np.zeros(0, np.int64)
        if len(self.reach):
            # whether a term is within one edit of a word, but for some that a lost letter each makes equal by chance
            ok = self._reached(read.distinct)
            ok[read.owner[self._reached(read.less)]] = True
            may = np.flatnonzero(ok & (weight[first] == 0) & (read.size >= self.lengths[0]) & (read.size <= self.lengths[1]))
            w = np.zeros(len(first))
            for i, key in zip(may.tolist(), read.distinct[may].tolist(), strict=True):
                if (known := self.cache.get(key)) is None:
                    if len(self.cache) > 500_000:
                        self.cache.clear()
                    known = self.cache[key] = max((self.weight_of[t] for t in edits_within_one(read.words.word(int(first[i])), self.trie)), default=0.0)
                w[i] = known
            if len(may):
                near = np.flatnonzero(w[read.inverse] > 0)
                weight[near] = w[read.inverse][near]
        at = np.sort(np.concatenate([exact, near]))
        return at, weight[at], np.isin(at, near)


#: Quotation marks of other scripts, read as plain ones.
_MARKS = ("“", "”", "„", "«", "»", "‘", "’")
_QUOTE = np.zeros(256, bool)
_QUOTE[[0x22, 0x27, 0x60]] = True
FEATURES = 8


def _nearby(words: Words, at: np.ndarray, doc: np.ndarray, hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether a wanted word of the same text stands within the window of each hit."""
    place = np.searchsorted(wanted, hashes)
    flag = np.concatenate([[0], np.cumsum(wanted[np.minimum(place, len(wanted) - 1)] == hashes)])
    first = np.maximum(at - WINDOW, words.offsets[doc])
    last = np.minimum(at + WINDOW + 1, words.offsets[doc + 1])
    return flag[last] > flag[first]


def features(column: pa.Array, *lexicons: Lexicon) -> np.ndarray:
    """Of each text by each lexicon, side by side."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for mark in _MARKS:
        column = pc.replace_substring(column, mark, '"')
    read = Read(column, min(x.lengths[0] for x in lexicons), max(x.lengths[1] for x in lexicons))
    raw = np.concatenate([[0x20], read.words.raw, [0x20]])
    return np.concatenate([_by_lexicon(read, raw, len(column), x) for x in lexicons], 1)


def _by_lexicon(read: Read, raw: np.ndarray, n: int, lexicon: Lexicon) -> np.ndarray:
    words, h = read.words, read.h
    at, weight, fuzzy = lexicon.hits(read)
    doc = np.searchsorted(words.offsets, at, side="right") - 1
    marked = _QUOTE[raw[words.starts[at]]] | _QUOTE[raw[words.ends[at] + 1]]
    addressing = _nearby(words, at, doc, h, lexicon.addressing)
    quoted = marked | (_nearby(words, at, doc, h, lexicon.reporting) & ~addressing)
    addressed = addressing & ~quoted
    total = lambda mask: np.bincount(doc[mask], weight[mask], n)
    best = np.zeros(n)
    np.maximum.at(best, doc[~quoted & ~fuzzy], weight[~quoted & ~fuzzy])
    abuse = total(~quoted & ~fuzzy)
    return np.stack([np.log1p(abuse), np.log1p(total(quoted & ~fuzzy)), best, np.log1p(total(~quoted & fuzzy)), np.log1p(total(quoted & fuzzy)), np.log1p(total(addressed)), (abuse > 0).astype(float), np.log1p(words.counts())], 1)


def _counted_words(piece: pa.RecordBatch) -> pa.RecordBatch:
    """Each word with the documents, and toxic documents, of each half of the piece that hold it."""
    words = Words(*text_bytes(piece.column("text")), ALNUM_SPLIT, lower=True)
    toxic, half = (piece.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("toxic", "half"))
    distinct, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
    pairs = np.unique(inverse.astype(np.int64) * piece.num_rows + words.doc_of_word()) if len(distinct) else np.zeros(0, np.int64)
    word, doc = pairs // max(piece.num_rows, 1), pairs % max(piece.num_rows, 1)
    sums = [np.bincount(word, x, len(distinct)).astype(np.int64) for k in (0, 1) for x in ((half[doc] == k).astype(float), toxic[doc] * (half[doc] == k))]
    return pa.record_batch([pa.array(signed(distinct)), pa.array([words.word(i) for i in first.tolist()], pa.string()), *map(pa.array, sums)], ["h", "word", "n0", "t0", "n1", "t1"])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, learn: Column) -> DataFrame:
    """doc_id and label of at most `most` labelled documents, those with the smallest hash; small enough to broadcast."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias(label)).filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).filter(learn)
    return known.groupBy("doc_id").agg(F.max(label).alias(label)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


class Toxicity:
    def __init__(self, lexicon: Lexicon, model: Logistic | None):
        self.lexicon, self.model = lexicon, model

    def score(self, column: pa.Array) -> np.ndarray:
        return self.model.probability(features(column, self.lexicon)) if self.model else np.full(len(column), 0.5)


def _feature_rows(shared):
    """Features by the lexicons of the other half than each row's."""

    def rows(piece: pa.RecordBatch) -> pa.RecordBatch:
        half, x = piece.column("half").to_numpy(), np.zeros((piece.num_rows, len(Z) * FEATURES))
        for k in np.unique(half).tolist():
            x[half == k] = features(piece.column("text").filter(pa.array(half == k)), *shared.value[1 - k])
        return pa.record_batch([piece.column("toxic"), piece.column("part"), list_array(x.ravel(), np.arange(len(x) + 1) * x.shape[1])], ["toxic", "part", "x"])

    return rows


def _best(x: np.ndarray, y: np.ndarray, part: np.ndarray) -> int:
    """Which lexicon's features (rows, lexicons, FEATURES) predict part 1 best from part 0, by log loss."""
    if min(len(np.unique(y[part == i])) for i in (0, 1)) < 2:
        return 0
    loss = []
    for k in range(x.shape[1]):
        p = np.clip(Logistic(x[part == 0, k], y[part == 0]).probability(x[part == 1, k]), 1e-6, 1 - 1e-6)
        loss.append(-np.log(np.where(y[part == 1] > 0, p, 1 - p)).mean())
    return int(np.argmin(np.round(loss, 6)))


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, most: int = SAMPLE) -> Toxicity:
    """Learns from the labelled documents for which learn_from (over doc_id) holds."""
    sample = labelled_sample(docs, labels, "toxic", most, learn_from)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null").join(F.broadcast(sample), "doc_id")
    h = F.xxhash64("doc_id")
    rows = rows.withColumn("half", F.pmod(h, F.lit(2)).cast("int")).withColumn("part", F.pmod(F.shiftright(h, 1), F.lit(2)).cast("int"))
    share = sample.agg(F.count("*").alias("n"), F.avg("toxic").alias("p")).first()
    if not share["n"]:
        return Toxicity(Lexicon([]), None)
    p = min(max(share["p"], 1e-3), 1 - 1e-3)
    counts = map_pieces(rows, _counted_words, "h long, word string, n0 long, t0 long, n1 long, t1 long").groupBy("h").agg(F.min("word").alias("word"), *(F.sum(c).alias(c) for c in ("n0", "t0", "n1", "t1")))
    counts = written(counts.filter(F.col("t0") + F.col("t1") >= LEAST))

    def lexicons(n: Column, t: Column) -> list[Lexicon]:
        """One for each Z, by so many documents and toxic documents of each word."""
        z = (t - n * p) / F.sqrt(n * (p * (1 - p)))
        odds = F.log((t + 4 * p) / (n - t + 4 * (1 - p))) - float(np.log(p / (1 - p)))
        terms = counts.filter(t >= LEAST).select("word", odds.alias("w"), z.alias("z")).filter(F.col("z") >= min(Z)).orderBy(F.desc("z"), "word").collect()
        return [Lexicon([(r["word"], r["w"]) for r in terms if r["z"] >= least]) for least in Z]

    n, t = [F.col("n0"), F.col("n1")], [F.col("t0"), F.col("t1")]
    halves = [lexicons(n[k], t[k]) for k in (0, 1)]
    found = map_pieces(rows, _feature_rows(docs.sparkSession.sparkContext.broadcast(halves)), "toxic int, part int, x array<double>").toArrow()
    x = found.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(Z), FEATURES)
    y = (found.column("toxic").to_numpy() > 0).astype(float)
    best = _best(x, y, found.column("part").to_numpy())
    return Toxicity(lexicons(n[0] + n[1], t[0] + t[1])[best], Logistic(x[:, best], y))


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """doc_id, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(piece: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([piece.column("doc_id"), pa.array(shared.value.score(piece.column("text")))], ["doc_id", "score"])

    return map_pieces(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), rows, "doc_id long, score double")
