"""The events table seen as messages and an order book: stands in for log files in the registered queries (FIXTURES.md).

Library code takes messages and books as tables; only the registered queries use this. `zips` writes them as real logs first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CONFIG, Config
from ..functions.lineage import shared_folder
from ..sinks.logs import zip_logs


def messages(spark: SparkSession, sf_dir: str, c: Config = CONFIG) -> DataFrame:
    """asset, row_idx, bin_idx, k, event_type, direction, size, price_int of each event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("long")
    names = F.create_map(*(F.lit(x) for pair in {"signup": 1, "view": 2, "error": 3, "click": 4, "purchase": 5}.items() for x in pair))
    return e.select(
        (F.col("user_id") % c.assets).cast("int").alias("asset"),
        F.col("event_id").alias("row_idx"),
        F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{c.start}', ts) div {c.bin_us}").alias("bin_idx"),
        k.alias("k"),
        F.when(k >= 97, 7).otherwise(names[F.col("event_type")]).alias("event_type"),
        F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("direction"),
        k.cast("double").alias("size"),
        (1000000 + F.round(F.col("value") * 100)).cast("long").alias("price_int"),
    )


def levels(rows: DataFrame, c: Config = CONFIG) -> DataFrame:
    """The rows (row_idx, k) once for each level h, with the book's prices in ticks and sizes."""
    x = rows.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(c.levels))))
    dummy = (F.col("h") >= 8) & (F.col("row_idx") % 11 == 0)
    mid, half = 1000000 + F.col("k") % 7 * 100, 50 * (1 + F.col("row_idx") % 3)
    away = 100 * (F.col("h") - 1)
    return x.select(
        *rows.columns,
        "h",
        F.when(dummy, F.lit(9999999999)).otherwise(mid + half + away).alias("ask_p"),
        F.when(dummy, F.lit(0)).otherwise(1 + (F.col("row_idx") * 7 + F.col("h") * 13) % 50).cast("long").alias("ask_q"),
        F.when(dummy, F.lit(-9999999999)).otherwise(mid - half - away).alias("bid_p"),
        F.when(dummy, F.lit(0)).otherwise(1 + (F.col("row_idx") * 11 + F.col("h") * 17) % 50).cast("long").alias("bid_q"),
    )


def book(msg: DataFrame, wanted: DataFrame | None = None, c: Config = CONFIG) -> DataFrame:
    """row_idx, h and the level's prices and sizes, of the wanted rows (row_idx) or all."""
    rows = msg.select("row_idx", "k")
    return levels(rows if wanted is None else rows.join(wanted, "row_idx", "left_semi"), c).drop("k")


TICKERS = [f"A{i}" for i in range(CONFIG.assets)]


def timed(spark: SparkSession, sf_dir: str, c: Config = CONFIG) -> DataFrame:
    """The events as messages of tickers in order of time: ticker, row_idx (from 0 in each), a message's columns (time in seconds from the start), asset and k."""
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{c.start}', ts) / 1e6").alias("time"))
    x = messages(spark, sf_dir, c).join(ids, F.col("row_idx") == F.col("event_id")).withColumnRenamed("row_idx", "order_id")
    x = x.withColumn("row_idx", F.row_number().over(Window.partitionBy("asset").orderBy("time", "order_id")).cast("long") - 1)
    return x.select(F.concat(F.lit("A"), F.col("asset").cast("string")).alias("ticker"), "row_idx", "time", "event_type", "order_id", "size", F.col("price_int").alias("price"), "direction", "asset", "bin_idx", "k")


def zips(spark: SparkSession, sf_dir: str, c: Config = CONFIG) -> tuple[str, DataFrame]:
    """A folder in the shared place with the events as zipped logs, a zip a ticker, and the messages written to them."""
    folder, msg = shared_folder(spark), timed(spark, sf_dir, c)
    book = levels(msg.select("row_idx", "k", "ticker"), c)
    zip_logs(msg, book, folder, c).collect()
    return folder, msg
