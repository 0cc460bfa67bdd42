"""Earlier results read back: features, targets, graphs, event summaries, result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CONFIG, Config
from ..operators.features import targets


def features(spark: SparkSession, folder: str, c: Config = CONFIG) -> DataFrame:
    """asset, bin_idx, f, x of the standardised features; from the raw ones and the scaler where they were not written."""
    try:
        return spark.read.parquet(f"{folder}/standardized")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    raw, scaler = spark.read.parquet(f"{folder}/features"), spark.read.parquet(f"{folder}/scaler")
    return raw.join(scaler, ["asset", "f"]).select("asset", "bin_idx", "f", ((F.col("x") - F.col("mu")) / F.col("sigma_safe")).alias("x"))


def event_mask(spark: SparkSession, folder: str, c: Config = CONFIG) -> DataFrame:
    """asset, bin_idx, mask: the last feature, 0 or 1."""
    raw = spark.read.parquet(f"{folder}/features").filter(F.col("f") == c.features - 1)
    return raw.select("asset", "bin_idx", (F.col("x") > 0).cast("int").alias("mask"))


def log_returns(spark: SparkSession, folder: str, c: Config = CONFIG) -> DataFrame:
    """asset, bin_idx, tau, y; horizons that were not written are worked out from the mids."""
    written = spark.read.parquet(f"{folder}/targets").select("asset", "bin_idx", "tau", "y")
    missing = set(c.taus) - {r["tau"] for r in written.select("tau").distinct().collect()}
    if not missing:
        return written
    again = targets(spark.read.parquet(f"{folder}/mids"), c).filter(F.col("tau").isin(*missing))
    return written.unionByName(again.select("asset", "bin_idx", "tau", "y"))


def graph(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """src, dst, w of one graph; raises if there is none of that name."""
    found = spark.read.parquet(f"{folder}/graphs").filter(F.col("graph") == name).select("src", "dst", "w")
    if found.isEmpty():
        raise KeyError(name)
    return found


def results(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """Rows of a JSON result: one document a file (an object or an array of them), or an object a line."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def activity(spark: SparkSession, path: str) -> DataFrame:
    """bin_idx, event_mask of event summaries in CSV files; other columns aren't parsed."""
    return spark.read.option("header", True).csv(path).select(F.col("bin_idx").cast("long").alias("bin_idx"), F.col("event_mask").cast("int").alias("event_mask"))
