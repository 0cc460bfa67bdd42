"""Message flow, the 51 features in long form, standardisation, targets and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CLASSES, CONFIG, Config
from .bins import SPAN, clean, part
from .book import mid_spread, obi, ofi


def flow(msg: DataFrame, mids: DataFrame, c: Config = CONFIG) -> DataFrame:
    """For each bin and class: size, volume-weighted price less mid, signed quantity; and executed value."""
    x = clean(msg, c)
    ok = (F.col("size") >= 0) & (F.col("size") < float("inf")) & ~F.isnan("price") & (F.abs("price") < float("inf"))
    aggs = [F.sum(F.when(F.col("event_type").isin(*CLASSES["exe"]), F.col("size") * F.col("price"))).alias("traded")]
    for name, types in CLASSES.items():
        inside = F.col("event_type").isin(*types) & ok
        sign = F.col("direction") if name == "sub" else -F.col("direction")
        aggs += [F.sum(F.when(inside, v)).alias(f"{what}_{name}") for what, v in (("size", F.col("size")), ("value", F.col("size") * F.col("price")), ("q", sign * F.col("size")))]
    rows = mids.select("asset", "bin_idx", "mid").join(x.groupBy("asset", "bin_idx").agg(F.count("*").alias("n"), *aggs), ["asset", "bin_idx"], "left").na.fill(0)
    delta = [F.when(F.col(f"size_{k}") > 0, F.col(f"value_{k}") / (F.col(f"size_{k}") + c.eps) - F.col("mid")).otherwise(0.0).alias(f"dp_{k}") for k in CLASSES]
    return rows.select("asset", "bin_idx", *(f"size_{k}" for k in CLASSES), *(F.col(f"q_{k}") for k in CLASSES), *delta, "traded", (F.col("n") > 0).cast("int").alias("mask"))


def features(msg: DataFrame, book: DataFrame, c: Config = CONFIG) -> DataFrame:
    """asset, bin_idx, f (0 to 50), x."""
    mids = mid_spread(book, c)
    by_level = ofi(book).join(obi(book, c), ["asset", "bin_idx", "h"])
    stacked = by_level.selectExpr("asset", "bin_idx", "h", "stack(4, 0, ofi_share, 10, ofi_dollar, 20, obi_share, 30, obi_dollar) AS (base, x)")
    per_bin = mids.join(flow(msg, mids, c), ["asset", "bin_idx"])
    named = ["spread", "weighted_mid", "size_exe", "traded", "dp_sub", "q_sub", "dp_can", "q_can", "dp_exe", "q_exe", "mask"]
    flat = per_bin.selectExpr("asset", "bin_idx", f"stack({len(named)}, {', '.join(f'{40 + i}, cast({n} AS double)' for i, n in enumerate(named))}) AS (f, x)")
    return stacked.select("asset", "bin_idx", (F.col("base") + F.col("h") - 1).alias("f"), "x").unionByName(flat)


def scaler(feats: DataFrame, c: Config = CONFIG) -> DataFrame:
    """Train mean and population deviation of each (asset, f); a deviation below 1e-10 is read as 1."""
    s = feats.filter(F.col("bin_idx") < c.train_end).groupBy("asset", "f").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sigma"))
    return s.withColumn("sigma_safe", F.when(F.col("sigma") < 1e-10, 1.0).otherwise(F.col("sigma")))


def standardized(feats: DataFrame, c: Config = CONFIG) -> DataFrame:
    """The scaler has assets x 51 rows, so it is broadcast."""
    return feats.join(F.broadcast(scaler(feats, c)), ["asset", "f"]).select("asset", "bin_idx", "f", ((F.col("x") - F.col("mu")) / F.col("sigma_safe")).alias("x"))


def phi_bar(std: DataFrame) -> DataFrame:
    return std.filter("f < 10").groupBy("asset", "bin_idx").agg(F.avg("x").alias("phi"))


def targets(mids: DataFrame, c: Config = CONFIG, span: int = SPAN) -> DataFrame:
    """tau, log return y and spread-normalised return z; null where the horizon passes the end.

    Ranges of bins look ahead by themselves: the first bins of a range, as many as the longest horizon, go to the range before too.
    """
    if span < max(c.taus):
        raise ValueError(f"a range of {span} bins is shorter than the horizon {max(c.taus)}")
    by, own = Window.partitionBy("asset", "part").orderBy("bin_idx"), part(span)
    if c.bins > span:
        early = (F.col("bin_idx") % span < max(c.taus)) & (own > 0)
        mids = mids.withColumn("part", F.explode(F.when(early, F.array(own, own - 1)).otherwise(F.array(own))))
    else:
        mids = mids.withColumn("part", own)
    x = mids.select("asset", "bin_idx", "part", "mid", "spread", *(F.lead("mid", t).over(by).alias(f"m{t}") for t in c.taus))
    x = x.filter(F.col("part") == own) if c.bins > span else x
    x = x.selectExpr("*", f"stack({len(c.taus)}, {', '.join(f'{t}, m{t}' for t in c.taus)}) AS (tau, ahead)")
    return x.select("asset", "bin_idx", "tau", (F.log("ahead") - F.log("mid")).alias("y"), ((F.col("ahead") - F.col("mid")) / (F.col("spread") + c.eps)).alias("z"))


def split_name(tau: F.Column, c: Config = CONFIG) -> F.Column:
    """Chronological split of bin_idx; the last tau bins of each belong to none."""
    b = F.col("bin_idx")
    return F.when(b < c.train_end - tau, "train").when((b >= c.train_end) & (b < c.val_end - tau), "val").when((b >= c.val_end) & (b < c.bins - tau), "test")
