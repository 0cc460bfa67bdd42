"""Message and order-book logs: headerless CSV members of one zip a ticker.

The zips are found by name on any file system that Spark reads. One task reads one zip, member by member in chunks; row
numbers are the places in the member, and row i of the book belongs to message i.
"""

from __future__ import annotations

import fnmatch
import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CONFIG, Config

#: The columns of a message, in order, and their types.
MESSAGE = {"time": "float64", "event_type": "int16", "order_id": "int64", "size": "float64", "price": "float64", "direction": "int16"}
SPARK_TYPES = {"float64": "double", "int16": "short", "int64": "long"}
#: The columns of a level of the book, in order.
LEVEL = ("ask_p", "ask_q", "bid_p", "bid_q")
#: Rows of a member that are parsed at once.
CHUNK = 100_000


def fitting(names: list[tuple[str, str]], ticker: str, patterns: Sequence[str] = ()) -> str | None:
    """Of (name, path) in order, the first path whose name fits the first pattern that any fits."""
    for pattern in patterns or ("*{ticker}*.zip",):
        for name, path in names:
            if fnmatch.fnmatchcase(name, pattern.format(ticker=ticker)):
                return path
    return None


def find_zip(spark: SparkSession, folder: str, ticker: str, *patterns: str) -> str:
    """The path of the ticker's zip: the first in order of name that fits the first pattern that any fits.

    patterns: globs with {ticker}; without any, the ticker anywhere in the name.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ticker}*.zip").load(folder).select("path")
    path = fitting(sorted((p.rpartition("/")[2], p) for (p,) in found.collect()), ticker, patterns)
    if path is None:
        raise FileNotFoundError(f"no zip of {ticker} in {folder}")
    return path


def member(names: list[str], kind: str, ticker: str = "") -> str:
    """The first CSV member whose name holds kind ("message" or "orderbook", in any case), and the ticker if one is given."""
    for name in names:
        base = name.rpartition("/")[2]
        if kind in base.lower() and base.lower().endswith(".csv") and ticker in base:
            return name
    raise FileNotFoundError(f"no {kind} member of {ticker or 'any ticker'} among {names}")


def _zips(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """ticker, content of each zip; one partition each."""
    files = spark.read.format("binaryFile").load(list(paths.values())).select("path", "content")
    tickers = F.create_map(*(F.lit(x) for t, p in paths.items() for x in (p, t)))
    return files.select(tickers[F.col("path")].alias("ticker"), "content").repartition(len(paths), "ticker")


def messages(spark: SparkSession, paths: dict[str, str], columns: tuple[str, ...] = tuple(MESSAGE)) -> DataFrame:
    """ticker, row_idx and the wanted columns of every message; only those are parsed. paths: of each ticker's zip.

    A row with another number of columns, or one that is no number, raises.
    """
    unknown = set(columns) - set(MESSAGE)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ticker, content in zip(batch["ticker"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member(z.namelist(), "message", ticker)) as f:
                    first = f.readline()
                    if first.strip() and first.count(b",") != len(MESSAGE) - 1:
                        raise ValueError(f"messages of {ticker} have {first.count(b',') + 1} columns, not {len(MESSAGE)}")
                    f.seek(0)
                    at = 0
                    for chunk in pd.read_csv(f, header=None, names=list(MESSAGE), usecols=list(columns), dtype={c: MESSAGE[c] for c in columns}, chunksize=CHUNK) if first else ():
                        chunk.insert(0, "row_idx", range(at, at + len(chunk)))
                        chunk.insert(0, "ticker", ticker)
                        at += len(chunk)
                        yield chunk[["ticker", "row_idx", *columns]]

    return _zips(spark, paths).mapInPandas(rows, "ticker string, row_idx long, " + ", ".join(f"{c} {SPARK_TYPES[MESSAGE[c]]}" for c in columns))


def book_rows(spark: SparkSession, paths: dict[str, str], c: Config = CONFIG, first: int | None = None) -> DataFrame:
    """ticker, row_idx, level h and its prices (ticks) and sizes, of every row of the book, or of the first so many.

    A row that has not four columns a level raises.
    """
    width = len(LEVEL) * c.levels

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ticker, content in zip(batch["ticker"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member(z.namelist(), "orderbook", ticker)) as f:
                    lines, at = (x.decode() for x in f), 0
                    while part := [x for _, x in zip(range(CHUNK // c.levels if first is None else min(CHUNK // c.levels, first - at)), lines, strict=False)]:
                        wide = [x.rstrip("\r\n").split(",") for x in part]
                        odd = next((i for i, x in enumerate(wide) if len(x) != width), None)
                        if odd is not None:
                            raise ValueError(f"row {at + odd} of the book of {ticker} has {len(wide[odd])} columns, not {width}")
                        values = pd.DataFrame(wide).astype("float64").astype("int64").to_numpy().reshape(-1, len(LEVEL))
                        out = pd.DataFrame(values, columns=list(LEVEL))
                        out.insert(0, "h", [h for _ in part for h in range(1, c.levels + 1)])
                        out.insert(0, "row_idx", [i for i in range(at, at + len(part)) for _ in range(c.levels)])
                        out.insert(0, "ticker", ticker)
                        at += len(part)
                        yield out

    return _zips(spark, paths).mapInPandas(rows, "ticker string, row_idx long, h int, ask_p long, ask_q long, bid_p long, bid_q long")


def counts_match(messages: DataFrame, book: DataFrame) -> DataFrame:
    """ticker, message_rows, book_rows of each ticker; raises while running where they differ."""
    a = messages.groupBy("ticker").agg(F.count("*").alias("message_rows"))
    b = book.filter("h = 1").groupBy("ticker").agg(F.count("*").alias("book_rows"))
    x = a.join(b, "ticker", "full").na.fill(0, ["message_rows", "book_rows"])
    both = F.concat_ws(" ", F.lit("messages and book rows differ:"), "ticker", "message_rows", "book_rows")
    return x.select("ticker", "message_rows", F.when(F.col("message_rows") == F.col("book_rows"), F.col("book_rows")).otherwise(F.raise_error(both).cast("long")).alias("book_rows"))


def binned(messages: DataFrame, tickers: list[str], start: float, width: float, c: Config = CONFIG) -> DataFrame:
    """Messages as the operators take them: asset (place in tickers), row_idx, bin_idx of bins of `width` seconds from `start`, and the rest.

    Rows outside the grid are left out by a filter on time, before any computed column.
    """
    asset = F.array_position(F.array(*map(F.lit, tickers)), F.col("ticker")).cast("int") - 1
    inside = messages.filter((F.col("time") >= start) & (F.col("time") < start + width * c.bins) & F.col("ticker").isin(tickers))
    return inside.select(asset.alias("asset"), "row_idx", F.floor((F.col("time") - start) / width).cast("long").alias("bin_idx"), F.col("event_type").cast("int").alias("event_type"), F.col("direction").cast("int").alias("direction"), "size", F.col("price").cast("long").alias("price_int"))
