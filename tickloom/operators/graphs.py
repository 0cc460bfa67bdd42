"""Cross-asset graphs as edge tables (src, dst, w), built on the training split."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG, Config


#: Assets and bins of a tile: two are multiplied as dense matrices in one task.
BLOCK, SPAN = 256, 8192


def tiles(x: DataFrame, blocks: int, side: str, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """One row a bin and block of assets (r: its assets and values), once for each block of the other side: bi, bj, rng, t (the bin), r."""
    own, other = ("bi", "bj") if side == "left" else ("bj", "bi")
    packed = x.groupBy("bin_idx", F.floor(F.col("asset") / block).cast("int").alias(own)).agg(F.collect_list(F.struct("asset", "z")).alias("r"))
    return packed.select("bin_idx", own, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias(other), F.floor(F.col("bin_idx") / span).alias("rng"), "r").select("bi", "bj", "rng", F.col("bin_idx").alias("t"), "r")


def pair_products(left: DataFrame, right: DataFrame, c: Config = CONFIG, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """src, dst, s, n: of each pair of assets the sum of products of their z over the bins that both have, and how many those are.

    Inputs: asset, bin_idx, z. Few assets are paired in each bin. More than a block are multiplied tile by tile, a tile being
    some bins of a block of assets: a row travels once a block of the other side, not once an asset, and the pairs of
    a tile leave its task summed.
    """
    if c.assets <= block:
        a, b = left.select(F.col("asset").alias("src"), "bin_idx", F.col("z").alias("za")), right.select(F.col("asset").alias("dst"), "bin_idx", F.col("z").alias("zb"))
        return a.join(b, "bin_idx").groupBy("src", "dst").agg(F.sum(F.col("za") * F.col("zb")).alias("s"), F.count("*").alias("n"))
    blocks = -(-c.assets // block)

    def dense(t: pa.Table, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The tile's values and where there are any: bins x assets of the block."""
        r = t.column("r").combine_chunks()
        flat, sizes = r.flatten(), np.diff(r.offsets.to_numpy())
        row, column = np.repeat(np.searchsorted(at, t.column("t").to_numpy()), sizes), flat.field("asset").to_numpy() - k * block
        z, there = np.zeros((len(at), block)), np.zeros((len(at), block))
        z[row, column], there[row, column] = flat.field("z").to_numpy(zero_copy_only=False), 1.0
        return z, there

    def multiply(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        i, j = key[0].as_py(), key[1].as_py()
        at = np.intersect1d(a.column("t").to_numpy(), b.column("t").to_numpy())
        a, b = (t.filter(pa.array(np.isin(t.column("t").to_numpy(), at))) for t in (a, b))
        (za, ha), (zb, hb) = dense(a, at, i), dense(b, at, j)
        s, n = za.T @ zb, ha.T @ hb
        src, dst = np.nonzero(n)
        return pa.table([pa.array((src + i * block).astype(np.int32)), pa.array((dst + j * block).astype(np.int32)), pa.array(s[src, dst]), pa.array(n[src, dst].astype(np.int64))], ["src", "dst", "s", "n"])

    keys = ["bi", "bj", "rng"]
    x = tiles(left, blocks, "left", block, span).groupBy(*keys).cogroup(tiles(right, blocks, "right", block, span).groupBy(*keys))
    return x.applyInArrow(multiply, "src int, dst int, s double, n long").groupBy("src", "dst").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def correlation(left: DataFrame, right: DataFrame, c: Config = CONFIG, guard: bool = True) -> DataFrame:
    """src, dst, w: population z-scores multiplied and divided by n - 1, clipped, zero on the diagonal. Inputs: asset, bin_idx, v.

    guard: columns whose deviation is at most 1e-10 count as zero.
    """

    def scored(x: DataFrame) -> DataFrame:
        m = x.groupBy("asset").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
        z = (F.col("v") - F.col("m")) / (F.col("s") + c.tiny)
        return x.join(F.broadcast(m), "asset").select("asset", "bin_idx", (F.when(F.col("s") > 1e-10, z).otherwise(0.0) if guard else z).alias("z"))

    pairs = pair_products(scored(left), scored(right), c).withColumn("r", F.col("s") / F.greatest(F.col("n") - 1, F.lit(1)))
    return pairs.select("src", "dst", F.when(F.col("src") == F.col("dst"), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "r"))).alias("w"))


def train_values(values: DataFrame, tau: int = 1, c: Config = CONFIG) -> DataFrame:
    """Bins of the purged training split in which every asset has a value."""
    x = values.filter(F.col("bin_idx") < c.train_end - tau)
    whole = x.groupBy("bin_idx").agg(F.count_if(F.col("v").isNull() | F.isnan("v")).alias("bad")).filter("bad = 0")
    return x.join(whole, "bin_idx", "left_semi")


def coactivity(mask: DataFrame, c: Config = CONFIG) -> DataFrame:
    m = mask.filter((F.col("bin_idx") < c.train_end) & (F.col("mask") == 1))
    one = m.select("asset", "bin_idx", F.lit(1.0).alias("z"))
    both = pair_products(one, one, c).select("src", "dst", (F.col("n") / c.train_end).alias("w"))
    assets = mask.sparkSession.range(c.assets).select(F.col("id").cast("int").alias("src"))
    every = assets.join(assets.select(F.col("src").alias("dst")), F.lit(True))
    return every.join(both, ["src", "dst"], "left").select("src", "dst", F.when(F.col("src") == F.col("dst"), 0.0).otherwise(F.coalesce("w", F.lit(0.0))).alias("w"))


def transposed(g: DataFrame) -> DataFrame:
    return g.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("back"))


def variants(base: DataFrame, coact: DataFrame) -> DataFrame:
    """base: name, src, dst, w. Symmetrised, signed or absolute (after averaging), plain or times coactivity: graph, src, dst, w."""
    back = base.select("name", F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("back"))
    s = base.join(back, ["name", "src", "dst"]).withColumn("half", (F.col("w") + F.col("back")) / 2)
    s = s.join(F.broadcast(coact.select("src", "dst", F.col("w").alias("co"))), ["src", "dst"])
    return s.selectExpr("name", "src", "dst", "stack(4, 'signed', half, 'abs', abs(half), 'signed_mask', half * co, 'abs_mask', abs(half) * co) AS (kind, w)").select(F.concat_ws("_", "name", "kind").alias("graph"), "src", "dst", "w")


def row_normalized(g: DataFrame, c: Config = CONFIG) -> DataFrame:
    """Rows divided by their absolute sum."""
    by = Window.partitionBy(*(["graph"] if "graph" in g.columns else []), "src")
    return g.withColumn("w", F.col("w") / (F.sum(F.abs("w")).over(by) + c.tiny))


def row_normalized_symmetric(g: DataFrame, c: Config = CONFIG) -> DataFrame:
    """Then symmetrised, zero on the diagonal and clipped to [0, 1]; rows need not sum to 1."""
    keys = [k for k in ("graph", "src", "dst") if k in g.columns]
    n = row_normalized(g, c)
    half = n.join(n.select(*(k for k in keys if k == "graph"), F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("back")), keys).withColumn("half", (F.col("w") + F.col("back")) / 2)
    return half.select(*keys, F.when(F.col("src") == F.col("dst"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "half"))).alias("w"))


def neighbours(std: DataFrame, g: DataFrame) -> DataFrame:
    """asset, bin_idx, f, x: each asset's weighted sum over its neighbours. The graph is a small table and broadcast."""
    e = F.broadcast(g.select(F.col("src"), F.col("dst").alias("asset"), "w"))
    return std.join(e, "asset").groupBy("src", "bin_idx", "f").agg(F.sum(F.col("w") * F.col("x")).alias("x")).withColumnRenamed("src", "asset")
