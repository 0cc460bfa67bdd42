"""Time bins: cleaning, event summaries, last row of a bin, carry-forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CLASSES, CONFIG, Config

#: Bins that one task fills at once.
SPAN = 1 << 16


def family() -> F.Column:
    t = F.col("event_type")
    return F.when(t.isin(*CLASSES["sub"]), "submission").when(t.isin(*CLASSES["can"]), "cancellation").when(t.isin(*CLASSES["exe"]), "execution").otherwise("other")


def clean(msg: DataFrame, c: Config = CONFIG) -> DataFrame:
    """Rows in the grid, of event types 1 to 5 with price, family and bin_id."""
    keep = F.col("bin_idx").between(0, c.bins - 1) & F.col("event_type").between(1, 5)
    return msg.filter(keep).select("asset", "row_idx", "bin_idx", (F.col("bin_idx") + 1).alias("bin_id"), "event_type", family().alias("event_family"), "size", (F.col("price_int") / 10000).alias("price"), "direction")


def grid(spark: SparkSession, c: Config = CONFIG, bins: int | None = None) -> DataFrame:
    """Every (asset, bin_idx): a dimension of fixed size."""
    return spark.range(c.assets * (bins or c.bins)).select((F.col("id") % c.assets).cast("int").alias("asset"), F.floor(F.col("id") / c.assets).alias("bin_idx"))


def bin_event_summary(msg: DataFrame, c: Config = CONFIG) -> DataFrame:
    """Counts and volumes of each bin by family; bins without events hold zeros."""
    x = clean(msg, c)
    per = [f(F.when(F.col("event_family") == name, v)).alias(f"{short}_{what}") for short, name in (("sub", "submission"), ("can", "cancellation"), ("exe", "execution")) for what, f, v in (("count", F.count, F.lit(1)), ("volume", F.sum, F.col("size")))]
    agg = x.groupBy("asset", "bin_idx").agg(F.count("*").alias("n_valid_events"), *per)
    return grid(msg.sparkSession, c).join(agg, ["asset", "bin_idx"], "left").na.fill(0).withColumn("event_mask", (F.col("n_valid_events") > 0).cast("int"))


def last_row_per_bin(msg: DataFrame, c: Config = CONFIG) -> DataFrame:
    """The largest row index of each non-empty bin, of all in-window rows."""
    return msg.filter(F.col("bin_idx").between(0, c.bins - 1)).groupBy("asset", "bin_idx").agg(F.max("row_idx").alias("last_row"))


def part(span: int) -> F.Column:
    """The range of so many bins that a bin is in."""
    return F.floor(F.col("bin_idx") / span)


def carry_forward(msg: DataFrame, c: Config = CONFIG, span: int = SPAN) -> DataFrame:
    """The latest row at or before each bin; leading bins take the first observation.

    Bins are filled range by range, so an asset is as many tasks as it has ranges. What a range starts with comes from a pass
    over the ranges (their first and last rows, one row a range), not from its bins. A grid of one range needs no such pass.
    """
    seen = last_row_per_bin(msg, c)
    rows = grid(msg.sparkSession, c).join(seen, ["asset", "bin_idx"], "left").withColumn("part", part(span))
    own = Window.partitionBy("asset", "part").orderBy("bin_idx")
    held = F.last("last_row", True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    if c.bins <= span:
        first = F.first("last_row", True).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return rows.select("asset", "bin_idx", F.coalesce(held, first).alias("last_row"))
    ranges = grid(msg.sparkSession, c, -(-c.bins // span)).withColumnRenamed("bin_idx", "part")
    ends = seen.groupBy("asset", part(span).alias("part")).agg(F.min_by("last_row", "bin_idx").alias("a"), F.max_by("last_row", "bin_idx").alias("b"))
    by = Window.partitionBy("asset").orderBy("part")
    carried = F.last("b", True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first("a", True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    start = ranges.join(ends, ["asset", "part"], "left").select("asset", "part", F.coalesce(carried, first).alias("start"))
    return rows.withColumn("held", held).join(start, ["asset", "part"]).select("asset", "bin_idx", F.coalesce("held", "start").alias("last_row"))
