"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue, exact reranking.

* The forest is fitted on a sample of at most SAMPLE vectors (smallest hash of vec_id): each split is the hyperplane
  between two random sample vectors, at the median of the sample rows that reach it. Depth is bounded, so the forest
  in the broadcast is too. All rows are indexed: each is dealt to one leaf of every tree.
* A query walks all trees through one shared queue ordered by the smallest margin on the way to a node, and opens
  leaves until their rows, counted again in each tree, amount to LEAST and `share` of the table.
* Rows and queries meet in blocks of bounded size. In a block the rows of a query's opened leaves are its candidates;
  each is reranked once by its exact cosine in double precision, and the best of all blocks stay.

Equal vectors are indexed once with their k + 1 smallest ids (no later one can be among k nearest, as ties go to the
smaller id), and equal queries are searched once. A row travels once with its vector and its leaf in each tree.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose length is
not the commonest (the smaller of two as common); a row without vec_id takes no part. With fewer candidates than k
all come. Repeated rows of one vec_id count once.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import stage as written
from .text import list_array

TREES, LEAF = 32, 20
#: Vectors the forest is fitted on, at most; its leaves hold LEAF of them, so this bounds its depth (and its broadcast) too.
SAMPLE = 20_000
#: Rows opened for a query: LEAST and so many of the table's; a row counts once a tree, so fewer distinct ones are.
SHARE = 0.35
#: Tables of LEAST rows or fewer are one leaf.
LEAST = 1000
#: Rows and queries that meet in one group.
BLOCK, QUERIES = 4096, 4096


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Forest:
    """normals[tree, node] and cuts of complete binary trees; node 0 is the root."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 7):
        rng, unit = np.random.default_rng(seed), _unit(sample)
        self.depth, self.leaf_rows = depth, None
        nodes = (1 << depth) - 1
        self.normals, self.cuts = np.zeros((trees, nodes, sample.shape[1]), np.float32), np.zeros((trees, nodes))
        for t in range(trees):
            inside = {0: np.arange(len(unit))}
            for node in range(nodes):
                own = inside.pop(node)
                pick = own if len(own) > 1 else np.arange(len(unit))
                a, b = rng.choice(pick, 2) if len(pick) > 1 else (pick[0], pick[0])
                normal = unit[a] - unit[b]
                if not np.any(normal):
                    normal = rng.standard_normal(unit.shape[1])
                self.normals[t, node] = normal / np.linalg.norm(normal)
                p = unit[own] @ self.normals[t, node].astype(np.float64)
                self.cuts[t, node] = np.median(p) if len(own) else 0.0
                right = p > self.cuts[t, node]
                inside[2 * node + 1], inside[2 * node + 2] = own[~right], own[right]

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree, counted from 0."""
        out = []
        for normals, cuts in zip(self.normals, self.cuts, strict=True):
            node = np.zeros(len(unit), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + ((unit * normals[node]).sum(1) > cuts[node])
            out.append(node - len(cuts))
        return np.stack(out, 1)

    def opened(self, unit: np.ndarray, budget: float) -> list[tuple[int, int]]:
        """Leaves (tree, number) for one query, nearest first, until their rows reach the budget."""
        margins = [normals @ unit - cuts for normals, cuts in zip(self.normals, self.cuts, strict=True)]
        queue = [(-np.inf, t, 0) for t in range(len(margins))]
        out, rows, nodes = [], 0, self.cuts.shape[1]
        while queue and rows < budget:
            away, t, node = heapq.heappop(queue)
            if node >= nodes:
                size = self.leaf_rows.get((t, node - nodes), 0)
                if size:
                    out.append((t, node - nodes))
                    rows += size
                continue
            m = margins[t][node]
            near, far = (2, 1) if m > 0 else (1, 2)
            heapq.heappush(queue, (away, t, 2 * node + near))
            heapq.heappush(queue, (max(away, abs(m)), t, 2 * node + far))
        return out


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the rows that take part."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(finite & F.exists("embedding", lambda x: x != 0))
    width = rows.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    rows = rows.filter(F.size("embedding") == (width["w"] if width else 0))
    # -0.0 and 0.0 are one number but different group keys
    return rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))


def _indexed(shared):
    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                leaf = shared.value.leaves(_unit(_matrix(part.column("embedding"))))
                yield pa.record_batch([part.column("node"), part.column("embedding"), list_array(leaf.ravel().astype(np.int32), np.arange(len(leaf) + 1) * leaf.shape[1])], ["node", "embedding", "leaves"])

    return rows


def _search(shared, budget: float):
    """The numbers of the opened leaves (tree * leaves a tree + leaf) of each query."""

    def rows(batches):
        forest = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [np.sort(np.array([t << forest.depth | leaf for t, leaf in forest.opened(u, budget)], np.int32)) for u in _unit(_matrix(part.column("embedding")))]
                yield pa.record_batch([part.column("query"), part.column("embedding"), list_array(np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])]))], ["query", "embedding", "opened"])

    return rows


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def _rerank(k: int, depth: int):
    """The k + 1 best candidates of one block for each of its queries; the first row says how many there were."""

    def rows(queries: pa.Table, members: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        if queries.num_rows and members.num_rows:
            m, node, leaf = _matrix(members.column("embedding")), members.column("node").to_numpy(), _matrix(members.column("leaves")).astype(np.int64)
            order = np.argsort(node)
            m, node, leaf = m[order], node[order], leaf[order]
            unit, trees = _unit(m), leaf.shape[1]
            key = (leaf + (np.arange(trees) << depth)).ravel()
            by_leaf = np.argsort(key, kind="stable")
            first = np.searchsorted(key[by_leaf], np.arange((trees << depth) + 1))
            row = by_leaf // trees
            opened = queries.column("opened").combine_chunks()
            flat, bounds = opened.flatten().to_numpy(), opened.offsets.to_numpy() - opened.offsets[0].as_py()
            for i, (q, query) in enumerate(zip(_matrix(queries.column("embedding")), queries.column("query").to_numpy(), strict=True)):
                of = flat[bounds[i] : bounds[i + 1]]
                sizes = first[of + 1] - first[of]
                mark = np.zeros(len(m), bool)
                mark[row[np.repeat(first[of] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]] = True
                at = np.flatnonzero(mark)
                if not len(at):
                    continue
                scores, keep = unit[at] @ _unit(q[None])[0], min(k + 1, len(at))
                # ties at the edge: all rows that reach the last kept score come
                at = at[scores >= np.partition(scores, len(at) - keep)[len(at) - keep] - 1e-12]
                s = _cosines(np.broadcast_to(q, (len(at), len(q))), m[at])
                best = np.lexsort((node[at], -s))[:keep]
                out.append((np.full(len(best), query), node[at[best]], s[best], np.where(np.arange(len(best)) == 0, mark.sum(), 0)))
        q, n, s, c = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query": q, "node": n, "score": s, "candidates": c})

    return rows


def _blocks(df: DataFrame, key: str, most: int, other: int, names: tuple[str, str]) -> DataFrame:
    """Each row in one of the blocks of names[0], once for each of the `other` blocks of names[1]."""
    df = df.withColumn(names[0], F.pmod(F.xxhash64(key), F.lit(most)).cast("int"))
    return df.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.lit(other - 1))))


def neighbours(rows: DataFrame, queries: DataFrame, k: int = 5, trees: int = TREES, leaf: int = LEAF, share: float = SHARE, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, itself left out; opened: candidates reranked for it."""
    spark = rows.sparkSession
    rows, queries = usable(rows), usable(queries)
    same = Window.partitionBy("embedding").orderBy("vec_id")
    first = rows.distinct().withColumn("i", F.row_number().over(same)).filter(F.col("i") <= k + 1)
    members = written(first.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.array_sort(F.collect_set("vec_id")).alias("ids")))
    asked = written(queries.groupBy("embedding").agg(F.min("vec_id").alias("query")))
    n, m = members.count(), asked.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, opened long")
    depth = 0 if n <= LEAST else int(np.ceil(np.log2(min(n, sample) / leaf)))
    fit = members.select("embedding").orderBy(F.xxhash64("node"), "node").limit(sample).toArrow()
    forest = Forest(_matrix(fit.column("embedding")), trees if depth else 1, depth)
    index = written(members.select("node", "embedding").mapInArrow(_indexed(spark.sparkContext.broadcast(forest)), "node long, embedding array<double>, leaves array<int>"))
    counts = index.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count()
    forest.leaf_rows = {(r["tree"], r["leaf"]): r["count"] for r in counts.collect()}
    opened = written(asked.mapInArrow(_search(spark.sparkContext.broadcast(forest), LEAST + share * n), "query long, embedding array<double>, opened array<int>"))
    blocks, chunks = -(-n // BLOCK), max(1, -(-m // QUERIES))
    opened, index = _blocks(opened, "query", chunks, blocks, ("chunk", "block")), _blocks(index, "node", blocks, chunks, ("block", "chunk"))
    found = opened.groupBy("block", "chunk").cogroup(index.groupBy("block", "chunk")).applyInArrow(_rerank(k, depth), "query long, node long, score double, candidates long")
    by = Window.partitionBy("query")
    found = found.withColumn("opened", F.sum("candidates").over(by)).withColumn("i", F.row_number().over(by.orderBy(F.desc("score"), "node")))
    near = found.filter(F.col("i") <= k + 1).join(members.select("node", "ids"), "node").select("query", "score", "opened", F.explode("ids").alias("vec_id"))
    every = queries.distinct().join(asked, "embedding").select(F.col("vec_id").alias("query_id"), "query")
    near = every.join(near, "query").filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.select("query_id", rank.alias("rank"), "vec_id", "score", "opened").filter(F.col("rank") <= k)
