"""Merkle manifest of a dataset: a tree a source over its documents' digests, a tree over the sources, proofs of inclusion.

A node store in files, one Parquet table a level, written from the leaves up; nothing is held whole anywhere.

* Every row's leaf digest, and that of its tampered form, is worked out in one pass over the texts and written. From there on
  no text travels.
* The leaves are dealt by ranges of (source, doc_id, leaf) and sorted within them: each range is a run, written as it streams
  by with every leaf's place among its source's leaves of the run. A source that goes on from earlier runs is the first of its
  run, so one number a run (RUNS at most) turns places within runs into coordinates (tree, idx); a source with a third of
  all rows is many runs.
* Level k + 1 reads level k: FAN neighbours by coordinate become a node, which is stored with its children. Trees that are
  done before others pass their top on as it is.
* Proofs go down again: a level's nodes, each with the siblings on its way to the root, meet the level below by
  coordinate in a merge join. A step of the way is the digests left of the node and those right of it, so folding puts the
  node between them. The way is worked out once for all FAN leaves of a lowest node.

H is the lower-case hex sha256 of its inputs one after the other, digests as hex text.

Cases: null fields are `-`; null doc_ids come first, equal ones go by leaf; repeated rows are leaves of their own; the null
source is a tree like any and comes before all others, also before ''. A source with one document has that leaf as its
subroot, and a single subroot is the root. An empty table has no node and gives no row. Other columns of the table are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import dropped, shared_folder, stage
from .text import remainder

FAN = 16
#: Runs are so many at most: one number of each is held by the driver and by every task.
RUNS = 20_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*fields: Column) -> Column:
    """H of fields as they stand in a leaf: `-` if null, else count of UTF-8 bytes, `:`, value."""
    told = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*told), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree (of the source: text that sorts as sources do, null first), doc_id, leaf, forged (the leaf after tampering)."""
    own = [F.col(f) for f in FIELDS]
    forged = F.when(remainder(F.col("doc_id"), 5) == 0, digest(*own[:-1], F.translate("text", _UPPER, _LOWER))).otherwise(F.col("leaf"))
    tree = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))
    return docs.select(*FIELDS).withColumn("leaf", digest(*own)).select(tree.alias("tree"), "doc_id", "leaf", forged.alias("forged"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's run, and its place among the rows of its tree in the run. The rows come sorted; only the last tree and its count are held."""
    run, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        tree = batch.column("tree").dictionary_encode()
        codes = tree.indices.to_numpy()
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        at = np.arange(batch.num_rows) - np.repeat(first, np.diff(np.append(first, batch.num_rows)))
        if tree.dictionary[codes[0]].as_py() == last:
            at[: first[1] if len(first) > 1 else None] += count
        last, count = tree.dictionary[codes[-1]].as_py(), int(at[-1]) + 1
        yield pa.record_batch([pa.array(np.full(batch.num_rows, run, np.int32)), pa.array(at.astype(np.int64)), *batch.columns], ["run", "at", *batch.schema.names])


def coordinates(rows: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """The rows with idx, their place in their tree by the order, from 0; and the table of sorted runs behind it."""
    spark = rows.sparkSession
    runs = min(RUNS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(runs, "tree", *order).sortWithinPartitions("tree", *order)
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    sorted_runs = stage(dealt.mapInArrow(_placed, f"run int, at long, {kinds}"))
    # of a run: its first tree, its last one, and how many rows the last one has in it
    ends = sorted_runs.groupBy("run").agg(F.min("tree").alias("first"), F.max(F.struct("tree", "at")).alias("last")).orderBy("run").collect()
    known, tree, n = [], None, 0
    for r in ends:
        before = n if r["first"] == tree else 0
        known.append((r["run"], r["first"], before))
        n = r["last"]["at"] + 1 + (before if r["first"] == r["last"]["tree"] else 0)
        tree = r["last"]["tree"]
    table = F.broadcast(spark.createDataFrame(known, "run int, first string, before long"))
    placed = sorted_runs.join(table, "run").withColumn("idx", F.col("at") + F.when(F.col("tree") == F.col("first"), F.col("before")).otherwise(0))
    return placed.drop("run", "at", "first", "before"), sorted_runs


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda x: x["digest"]), "")


#: A node over nothing but the first node of the level is of a tree that has come to its end: it is that node again.
_ENDED = "idx = 0 AND size(children) = 1"


class Store:
    """The levels of some trees from the leaves up; levels[0] are the nodes over the leaves. The last level has one node a tree."""

    def __init__(self, leaves: DataFrame):
        """leaves: tree, idx, digest, and columns that go with them."""
        spark = leaves.sparkSession
        self.leaves, self.levels, self.path = leaves, [], shared_folder(spark)
        most, level = leaves.agg(F.max("idx")).first()[0], leaves
        while most:
            own = [c for c in level.columns if c not in ("tree", "idx", "children")]
            up = level.groupBy("tree", F.floor(F.col("idx") / FAN).alias("up")).agg(F.array_sort(F.collect_list(F.struct("idx", *own))).alias("children"))
            up = up.withColumnRenamed("up", "idx").withColumn("digest", F.when(F.expr(_ENDED), F.col("children")[0]["digest"]).otherwise(F.sha2(_joined(F.col("children")), 256)))
            level = stage(up, f"{self.path}/level={len(self.levels) + 1}")
            self.levels.append(level)
            most //= FAN

    def roots(self) -> DataFrame:
        """tree, digest of each tree's top."""
        return (self.levels[-1] if self.levels else self.leaves).select("tree", "digest")

    def ways(self, tops: DataFrame) -> DataFrame:
        """The leaves and their columns, way (to the top of all: steps with what is left and right, nearest first), and tops' other columns.

        tops: tree, way of each tree's top node, and other columns.
        """
        extra = [c for c in tops.columns if c not in ("tree", "way")]
        own = [c for c in self.leaves.columns if c not in ("tree", "idx")]
        if not self.levels:
            return self.leaves.join(tops.hint("merge"), "tree").select("tree", *own, "way", *extra)
        ways = tops.withColumn("idx", F.lit(0).cast("long"))
        for k in reversed(range(len(self.levels))):
            down = self.levels[k].drop("digest").join(ways.hint("merge"), ["tree", "idx"])
            side = F.struct(_joined(F.slice("children", 1, F.col("i"))).alias("left"), _joined(F.slice("children", F.col("i") + 2, FAN)).alias("right"))
            way = F.when(F.expr(_ENDED), F.col("way")).otherwise(F.concat(F.array(side), F.col("way")))
            down = down.select("tree", "idx", "children", "way", *extra, F.posexplode("children").alias("i", "c"))
            names = own if k == 0 else ["idx"]
            ways = down.select("tree", *(F.col("c")[n].alias(n) for n in names), way.alias("way"), *extra)
        return ways


def folded(leaf: Column, way: Column) -> Column:
    """The root that a leaf and its way give."""
    return F.aggregate(way, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def siblings(way: Column) -> Column:
    """H of all digests of a way, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(way, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf, forged, way, subroot, root of every row."""
    digests = stage(leaves(docs))
    placed, runs = coordinates(digests, "doc_id", "leaf", "forged")
    dropped(digests)
    store = Store(placed.withColumnRenamed("leaf", "digest"))
    if store.levels:
        dropped(runs)
    subroots, _ = coordinates(store.roots().select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "name")
    upper = Store(subroots)
    root = upper.roots().select("tree", F.array().cast("array<struct<left: string, right: string>>").alias("way"), F.col("digest").alias("root"))
    tops = upper.ways(root).select(F.col("name").alias("tree"), "way", F.col("digest").alias("subroot"), "root")
    return store.ways(stage(tops)).withColumnRenamed("digest", "leaf")
