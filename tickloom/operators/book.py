"""The order book on the grid: binned levels, validity, mid and spread, order-flow and order-book imbalance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG, Config
from .bins import carry_forward


def wanted_rows(msg: DataFrame, c: Config = CONFIG) -> DataFrame:
    """row_idx of the messages that some bin holds: assets x bins at most."""
    return carry_forward(msg, c).select(F.col("last_row").alias("row_idx")).distinct()


def binned_book(msg: DataFrame, book: DataFrame, c: Config = CONFIG) -> DataFrame:
    """asset, bin_idx, h, row_idx, prices in ticks, sizes, and whether the level is valid. book: row_idx, h, ask_p, ask_q, bid_p, bid_q.

    Row i of the book belongs to message i; where files hold several tickers, both have an asset too.
    """
    held = carry_forward(msg, c).withColumnRenamed("last_row", "row_idx")
    x = held.join(book, ["asset", "row_idx"] if "asset" in book.columns else "row_idx")
    valid = (F.col("ask_p").between(1, 9999999998)) & (F.col("bid_p") > 0) & (F.col("ask_q") > 0) & (F.col("bid_q") > 0) & (F.col("ask_p") > F.col("bid_p"))
    return x.withColumn("valid", valid)


def assert_best(book: DataFrame) -> DataFrame:
    """Raises while running if any best level is invalid."""
    return book.withColumn("valid", F.when((F.col("h") == 1) & ~F.col("valid"), F.raise_error(F.lit("invalid best level"))).otherwise(F.col("valid")))


def mid_spread(book: DataFrame, c: Config = CONFIG) -> DataFrame:
    a, b = F.col("ask_p") / 10000, F.col("bid_p") / 10000
    weighted = (a * F.col("bid_q") + b * F.col("ask_q")) / (F.col("ask_q") + F.col("bid_q") + c.eps)
    return book.filter("h = 1").select("asset", "bin_idx", ((a + b) / 2).alias("mid"), (a - b).alias("spread"), weighted.alias("weighted_mid"))


def ofi(book: DataFrame) -> DataFrame:
    """Per-level flow in shares and dollars. A falling ask adds its new quantity, a rising one takes its old."""
    by = Window.partitionBy("asset", "h").orderBy("bin_idx")
    was = {x: F.lag(x).over(by) for x in ("ask_p", "ask_q", "bid_p", "bid_q", "valid")}
    x = book.select("*", *(v.alias(f"was_{k}") for k, v in was.items()))

    def flow(amount_b: F.Column, was_b: F.Column, amount_a: F.Column, was_a: F.Column) -> F.Column:
        bid = F.when(F.col("bid_p") > F.col("was_bid_p"), amount_b).when(F.col("bid_p") == F.col("was_bid_p"), amount_b - was_b).otherwise(-was_b)
        ask = F.when(F.col("ask_p") < F.col("was_ask_p"), amount_a).when(F.col("ask_p") == F.col("was_ask_p"), was_a - amount_a).otherwise(-was_a)
        return F.when(F.col("valid") & F.col("was_valid"), bid + ask).otherwise(0).cast("double")

    dollar = {s: F.col(f"{s}_p") / 10000 * F.col(f"{s}_q") for s in ("bid", "ask", "was_bid", "was_ask")}
    return x.select("asset", "bin_idx", "h", flow(F.col("bid_q"), F.col("was_bid_q"), F.col("ask_q"), F.col("was_ask_q")).alias("ofi_share"), flow(dollar["bid"], dollar["was_bid"], dollar["ask"], dollar["was_ask"]).alias("ofi_dollar"))


def obi(book: DataFrame, c: Config = CONFIG) -> DataFrame:
    """Imbalance cumulated over levels; invalid levels count zero."""
    by = Window.partitionBy("asset", "bin_idx").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)

    def share(b: F.Column, a: F.Column) -> F.Column:
        b, a = (F.when(F.col("valid"), x).otherwise(0) for x in (b, a))
        return F.sum(b - a).over(by) / (F.sum(b + a).over(by) + c.eps)

    return book.select("asset", "bin_idx", "h", share(F.col("bid_q"), F.col("ask_q")).alias("obi_share"), share(F.col("bid_p") / 10000 * F.col("bid_q"), F.col("ask_p") / 10000 * F.col("ask_q")).alias("obi_dollar"))
