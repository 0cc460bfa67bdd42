"""Tables, CSV, JSON and Markdown that other tools read."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.summary import markdown


def event_summaries(summary: DataFrame, tickers: list[str], path: str) -> None:
    """CSV with header, a folder a ticker, in order of bins; bin_id counts from 1."""
    names = F.array(*map(F.lit, tickers))
    rows = summary.select(names[F.col("asset")].alias("ticker"), "bin_idx", (F.col("bin_idx") + 1).alias("bin_id"), *(c for c in summary.columns if c not in ("asset", "bin_idx")))
    rows.repartition("ticker").sortWithinPartitions("ticker", "bin_idx").write.partitionBy("ticker").option("header", True).mode("overwrite").csv(path)


def feature_tables(folder: str, **tables: DataFrame) -> None:
    """Parquet tables by name: features, standardized, scaler, mids, targets, graphs, phi_bar, ..."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")


def csv(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """One CSV file with header, of the given columns in order; a column that is missing is empty. For results of a few rows."""
    picked = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns)) if columns else rows
    picked.coalesce(1).write.option("header", True).mode("overwrite").csv(path)


def results_json(rows: DataFrame, path: str) -> None:
    """An object a line."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def text(spark: SparkSession, content: str, path: str) -> None:
    """A small text, with a newline at its end, on any file system that Spark writes."""
    spark.createDataFrame([(content.removesuffix("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def metadata(spark: SparkSession, values: dict, path: str) -> None:
    """Settings and audits as one JSON object; values that aren't JSON become text."""
    text(spark, json.dumps(values, indent=2, default=str), path)


def scalar(value: object) -> str:
    """A number of a report: eight significant digits; tuples and lists item by item."""
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return f"{value:.8g}"
    if isinstance(value, list | tuple):
        return "(" + ", ".join(map(scalar, value)) + ")"
    return str(value)


def report(title: str, facts: dict[str, object], sections: dict[str, DataFrame]) -> str:
    """Markdown: a title, facts as a list, and each table of a few rows under its heading."""
    lines = [f"# {title}", "", *(f"- {k}: {scalar(v)}" for k, v in facts.items())]
    for heading, rows in sections.items():
        lines += ["", f"## {heading}", "", markdown(rows, rows.columns)]
    return "\n".join(lines) + "\n"


