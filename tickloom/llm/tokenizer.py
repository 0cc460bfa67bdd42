"""SentencePiece encoding and decoding as shortest paths through a composed transducer.

Three machines are compiled from a model file into arrays of states and arcs:

* the normaliser, one state with an arc a character (spaces to U+2581, all others to themselves) and an initial output
  (the space prefixed);
* the pieces, a trie over characters whose final states write a piece's id; a character that ends in no final state
  has an arc that writes its UTF-8 byte pieces (or the unknown piece);
* an acceptor of neighbouring pieces. Scores of unigram models add up, so there it lets all pass and the arcs of the
  pieces weigh minus their scores. Scores of BPE models are merge ranks and don't add up: there pieces weigh nothing, and
  two neighbours weigh 0 or infinity, the latter if merging their characters by rank would join something across them. A
  piece's own merges, in order, with the symbols at its edges, are compiled once; two of these lists run side by side.

Composing the machines with a text gives a lattice: its states are places in the text (with the piece that led there on
the best way), its arcs pieces. Relaxing the arcs from left to right in the (min, +) semiring gives the cheapest way to
each place, and the arcs back from the end are the encoding. In BPE models exactly one way to each place is finite, as
each prefix of a text has one encoding. All distinct segments of a batch of texts are relaxed side by side.

No piece spans a place where a non-space meets U+2581, so texts are cut there into segments.

Cases: null and empty texts have no pieces and decode to an empty text. A U+2581 in a text decodes as a space.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import list_array, map_pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, BYTE = 1, 6
#: Places of the table in which a worker keeps which neighbours pass.
KNOWN = 1 << 20
#: Characters of segments that are relaxed at once (or one segment).
LATTICE = 1 << 18


def merged(text: str, scores: dict[str, float]) -> tuple[list[str], list[tuple[float, str, str]]]:
    """Pieces by merging, the best-scored neighbours first, the leftmost of equals; and each merge with the text's first and last symbol after it."""
    parts: list[str | None] = list(text)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    queue: list[tuple[float, int, int, str]] = []
    steps, first, last = [], text[:1], text[-1:]

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < len(parts) and (s := scores.get(both := parts[i] + parts[j])) is not None:
            heapq.heappush(queue, (-s, i, j, both))

    for i in range(len(parts) - 1):
        offer(i, i + 1)
    while queue:
        cost, i, j, both = heapq.heappop(queue)
        if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j] = both, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        first, last = both if i == 0 else first, both if after[i] == len(parts) else last
        steps.append((cost, first, last))
        offer(before[i], i)
        offer(i, after[i])
    return [p for p in parts if p is not None], steps


class Neighbours:
    """The acceptor of BPE models: for each symbol its merges in order (cost) with its first and last symbol before each and at the end."""

    def __init__(self, symbols: list[str], scores: dict[str, float]):
        self.n, number = len(symbols), {s: i for i, s in enumerate(symbols)}
        lists = [merged(s, scores) for s in symbols]
        #: Whether merging the symbol's characters gives the symbol.
        self.whole = np.array([len(parts) == 1 for parts, _ in lists])
        sizes = np.array([len(steps) if ok else 0 for (_, steps), ok in zip(lists, self.whole, strict=True)])
        self.begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        total = int((sizes + 1).sum())
        self.cost, self.first, self.last = np.full(total, np.inf), np.zeros(total, np.int64), np.zeros(total, np.int64)
        for at, symbol, (_, steps), ok in zip(self.begin.tolist(), symbols, lists, self.whole, strict=True):
            edges = [(symbol[0], symbol[-1]), *((a, b) for _, a, b in steps)] if ok else [(symbol, symbol)]
            for k, (a, b) in enumerate(edges):
                self.first[at + k], self.last[at + k] = number[a], number[b]
                if k < len(edges) - 1:
                    self.cost[at + k] = steps[k][0]
        pairs = {(number[s[:k]], number[s[k:]]): -scores[s] for s in symbols if s in scores for k in range(1, len(s)) if s[:k] in number and s[k:] in number}
        keys = np.array([a * self.n + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair, self.pair_cost = keys[order], np.array(list(pairs.values()))[order] if pairs else np.zeros(0)
        self.known, self.passed = np.full(KNOWN, -1, np.int64), np.zeros(KNOWN, bool)

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What merging the symbols a and b costs; infinite where they don't merge."""
        if not len(self.pair):
            return np.full(len(a), np.inf)
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.pair_cost[at], np.inf)

    def _run(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Both lists of merges side by side, the cheaper next; whether nothing is joined across."""
        i, j, ok = self.begin[left], self.begin[right], np.ones(len(left), bool)
        live = np.arange(len(left))
        while len(live):
            a, b = self.cost[i[live]], self.cost[j[live]]
            across = self._joined(self.last[i[live]], self.first[j[live]])
            # of equal costs the leftmost goes first: left's own, then across, then right's own
            joins = (across < a) & (across <= b)
            ok[live[joins]] = False
            go_left, go_right = ~joins & (a <= b) & (a < np.inf), ~joins & (b < a)
            i[live[go_left]] += 1
            j[live[go_right]] += 1
            live = live[go_left | go_right]
        return ok

    def passes(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each two neighbours weigh 0; left is -1 at a segment's beginning."""
        out = left < 0
        at = np.flatnonzero(~out)
        key = left[at] * self.n + right[at]
        slot = (key * 0x9E3779B97F4A7C1 & 0x7FFFFFFFFFFFFFFF) >> 43
        new = np.flatnonzero(self.known[slot] != key)
        out[at] = self.passed[slot]
        if len(new):
            distinct, inverse = np.unique(key[new], return_inverse=True)
            ok = self._run(distinct // self.n, distinct % self.n)
            out[at[new]] = ok[inverse]
            self.known[slot[new]], self.passed[slot[new]] = key[new], ok[inverse]
        return out


class Transducer:
    """A compiled model; picklable and small (arrays over its pieces)."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        n = model.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces:
            raise ValueError("only the identity normaliser with escaped spaces is compiled")
        self.compile(list(model.pieces), model.trainer_spec.model_type == 2, n.add_dummy_prefix, model.trainer_spec.unk_id)

    def compile(self, pieces: list, bpe: bool, prefix: bool, unknown: int) -> None:
        """pieces: each with piece, score, type."""
        self.prefix, self.bpe, self.unknown = prefix, bpe, unknown
        self.normaliser = {" ": SPACE}
        ids = {p.piece: i for i, p in enumerate(pieces) if p.type == NORMAL}
        scores = {p.piece: p.score for p in pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(pieces) if p.type == BYTE}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in ids):
            raise ValueError("a piece goes on after a word's end")
        self.spelt = [p.piece.replace(SPACE, " ").encode() if p.type == NORMAL else bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else b"" for p in pieces]
        lone = "" if any("\n" in p for p in ids) else "\n"
        self.cut = re.compile(f"{SPACE}+[^{SPACE}{lone}]*|[^{SPACE}{lone}]+" + ("|\n" if lone else ""))
        # symbols: pieces, characters that only occur inside pieces, and one for all other characters
        inside = sorted({c for p in ids for c in p} - set(ids))
        symbols = [*ids, *inside, "\0" if "\0" not in ids and "\0" not in inside else "\uffff"]
        self.id_of = np.array([*ids.values(), *[-1] * (len(inside) + 1)])
        self.other = len(symbols) - 1
        self.neighbours = Neighbours(symbols, scores) if bpe else None
        worst = min(scores.values(), default=0.0) - 10
        self.weight = np.zeros(len(symbols)) if bpe else np.array([*(-scores[p] for p in ids), *[-worst] * (len(inside) + 1)])
        # the trie: characters by class, states by arrays; arcs (state * classes + class) in order
        letters = sorted({c for p in ids for c in p})
        self.letters, self.classes = np.array([ord(c) for c in letters], np.uint32), len(letters) + 1
        arcs, final = {}, [-1]
        for number, symbol in enumerate(symbols[:-1]):
            if len(symbol) > 1 and bpe and not self.neighbours.whole[number]:
                continue
            state = 0
            for c in symbol:
                key = state * self.classes + int(np.searchsorted(self.letters, ord(c)))
                if key not in arcs:
                    arcs[key] = len(final)
                    final.append(-1)
                state = arcs[key]
            final[state] = number
        order = np.argsort(np.array(list(arcs), np.int64))
        self.arcs, self.targets, self.final = np.array(list(arcs), np.int64)[order], np.array(list(arcs.values()), np.int64)[order], np.array(final)

    def _lattice(self, chars: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First character, characters and symbol of each arc. ends: where the segment of each character ends."""
        at = np.minimum(np.searchsorted(self.letters, chars), max(len(self.letters) - 1, 0))
        kind = np.where(self.letters[at] == chars, at, self.classes - 1) if len(self.letters) else np.zeros(len(chars), np.int64)
        start, state, out, size = np.arange(len(chars)), np.zeros(len(chars), np.int64), [], 0
        while len(start):
            key = state * self.classes + kind[start + size]
            place = np.minimum(np.searchsorted(self.arcs, key), max(len(self.arcs) - 1, 0))
            there = self.arcs[place] == key if len(self.arcs) else np.zeros(len(key), bool)
            size += 1
            if size == 1:
                # a character that is no symbol of its own has an arc all the same
                symbol = np.where(there, self.final[self.targets[place]], -1) if len(self.arcs) else np.full(len(key), -1)
                out.append((start, np.where(symbol < 0, self.other, symbol), size))
                start, state = start[there], self.targets[place[there]]
            else:
                start, state = start[there], self.targets[place[there]]
                done = self.final[state] >= 0
                out.append((start[done], self.final[state[done]], size))
            more = start + size < ends[start]
            start, state = start[more], state[more]
        return np.concatenate([s for s, _, _ in out]), np.concatenate([np.full(len(s), n) for s, _, n in out]), np.concatenate([y for _, y, _ in out])

    def _paths(self, chars: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The arcs of the shortest paths, one segment after the other: first character, symbol, and the segment of each."""
        n = len(bounds) - 1
        sizes = np.diff(bounds)
        segment = np.repeat(np.arange(n), sizes)
        start, size, symbol = self._lattice(chars, np.repeat(bounds[1:], sizes))
        offset = start - bounds[segment[start]]
        order = np.argsort(offset, kind="stable")
        start, size, symbol = start[order], size[order], symbol[order]
        steps = np.searchsorted(offset[order], np.arange((sizes.max() if n else 0) + 1))
        place = start + segment[start]
        cost, via = np.full(len(chars) + n, np.inf), np.full(len(chars) + n, -1)
        cost[bounds[:-1] + np.arange(n)] = 0
        for a, b in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
            i, y = place[a:b], symbol[a:b]
            led = via[i]
            new = cost[i] + self.weight[y]
            if self.neighbours is not None:
                new[~self.neighbours.passes(np.where(led < 0, -1, symbol[led]), y)] = np.inf
            to = i + size[a:b]
            less = np.flatnonzero(new < cost[to])
            cost[to[less]], via[to[less]] = new[less], a + less
        at, out = bounds[1:] + np.arange(n), []
        if np.isinf(cost[at]).any():
            raise ValueError("a text has no path")
        at = at[sizes > 0]
        while len(at):
            arc = via[at]
            out.append(arc)
            at = place[arc]
            at = at[via[at] >= 0]
        arc = np.concatenate([*out, np.zeros(0, np.int64)]).astype(np.int64)
        arc = arc[np.argsort(start[arc])]
        return start[arc], symbol[arc], segment[start[arc]]

    def encoded(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all segments, and where each one's begin."""
        ids, counts, at = [], [], 0
        while at < len(segments):
            to, size = at, 0
            while to < len(segments) and (to == at or size + len(segments[to]) <= LATTICE):
                size += len(segments[to])
                to += 1
            part = segments[at:to]
            chars = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
            start, symbol, segment = self._paths(chars, np.concatenate([[0], np.cumsum([len(s) for s in part])]))
            own = self.id_of[symbol]
            bare = np.flatnonzero(own < 0)
            n = np.ones(len(own), np.int64)
            if len(bare):
                letters, inverse = np.unique(chars[start[bare]], return_inverse=True)
                spelt = [[self.bytes[x] for x in chr(c).encode("utf-8", "replace")] if self.bytes else [self.unknown] for c in letters.tolist()]
                sizes = np.array([len(x) for x in spelt])
                n[bare] = sizes[inverse]
                flat = np.repeat(own, n)
                first, flat_of = np.concatenate([[0], np.cumsum(n)[:-1]])[bare], np.concatenate([[0], np.cumsum(sizes)[:-1]])[inverse]
                more = np.arange(n[bare].sum()) - np.repeat(np.cumsum(n[bare]) - n[bare], n[bare])
                flat[np.repeat(first, n[bare]) + more] = np.concatenate(spelt)[np.repeat(flat_of, n[bare]) + more]
                own = flat
            ids.append(own.astype(np.int32))
            counts.append(np.bincount(segment, n, len(part)).astype(np.int64))
            at = to
        return np.concatenate([*ids, np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum(np.concatenate([*counts, np.zeros(0, np.int64)]))])

    def normalised(self, text: str) -> str:
        """The normaliser's output; its arcs are taken one character after the other, as none writes what another reads."""
        for read, write in self.normaliser.items():
            text = text.replace(read, write)
        return (SPACE if self.prefix and text else "") + text

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each one's begin."""
        number: dict[str, int] = {}
        which, counts = [], []
        for text in texts:
            found = self.cut.findall(self.normalised(text))
            counts.append(len(found))
            which += [number.setdefault(s, len(number)) for s in found]
        ids, begin = self.encoded(list(number))
        which = np.array(which, np.int64)
        sizes = (begin[1:] - begin[:-1])[which]
        ends = np.cumsum(sizes)
        flat = ids[np.repeat(begin[which] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return flat, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]

    def decoded(self, ids: list[int]) -> bytes:
        spelt = self.spelt
        out = b"".join([spelt[i] for i in ids])
        return out[1:] if self.prefix and out[:1] == b" " else out


def _encoder(shared):
    def rows(piece: pa.RecordBatch) -> pa.RecordBatch:
        ids = list_array(*shared.value.encode(piece.column("text").to_pylist()))
        at = piece.schema.get_field_index("text")
        return pa.RecordBatch.from_arrays([*(c for i, c in enumerate(piece.columns) if i != at), ids], names=[*(n for n in piece.schema.names if n != "text"), "ids"])

    return rows


def _decoder(shared):
    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column("ids")
                values = ids.flatten().to_numpy(zero_copy_only=False)
                sizes = [len(x) if x.is_valid else 0 for x in ids]
                texts, to = [], 0
                for n in sizes:
                    texts.append(shared.value.decoded(values[to : to + n].tolist()).decode("utf-8", "replace"))
                    to += n
                k = part.schema.get_field_index("ids")
                yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(part.columns) if i != k), pa.array(texts, pa.string())], names=[*(n for n in part.schema.names if n != "ids"), "text"])

    return rows


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids: the pieces of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(Transducer(model))
    return map_pieces(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), _encoder(shared), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text of every row of ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(Transducer(model))
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(shared), "doc_id long, text string")


def _round_trip(shared):
    to_ids = _encoder(shared)

    def rows(piece: pa.RecordBatch) -> pa.RecordBatch:
        ids = to_ids(piece).column("ids")
        flat, at = ids.flatten().to_numpy(), ids.offsets.to_numpy()
        texts = [shared.value.decoded(flat[a:b].tolist()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([*piece.columns, ids, pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=[*piece.schema.names, "ids", "decoded"])

    return rows


def encode_decode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text, ids and decoded: every text, its pieces and what they decode to."""
    shared = docs.sparkSession.sparkContext.broadcast(Transducer(model))
    return map_pieces(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), _round_trip(shared), "doc_id long, text string, ids array<int>, decoded string")
