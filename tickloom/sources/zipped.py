"""Zipped logs as a data source: spark.read.format("zipped_logs").

One zip a ticker, found by name in a folder, with a CSV member of messages and one of the order book, both without header;
a row's number is its place in the member. Options:

* path (a folder), tickers (joined by commas), kind (messages or book), patterns (globs with {ticker}, joined by |);
* levels: of the book;
* index: a table by `restart_points`; members are then read by as many tasks as they have points. Without it a task reads
  a member;
* wanted: a Parquet folder with ticker and row_idx; only these rows of the book are parsed, and reading ends at the last.

Columns of messages that the schema given to the reader lacks aren't parsed: Spark tells a Python source no columns, so
pruning is by `.schema(...)`. Filters on ticker, row_idx and time are taken over (spark.sql.python.filterPushdown.enabled):
zips and points outside aren't opened, lines outside aren't parsed, and as logs are in order of time, reading ends at
the first line after the last wanted time.

Files are opened on the executors by Arrow's file systems (local, HDFS, object stores). `logs.messages` and
`logs.book_rows` give the same rows by Spark's own binary reader, for stores that only Spark reaches.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..config import CONFIG, Config
from ..functions.lineage import stage
from .inflate import Point, library, points, text_from
from .logs import LEVEL, MESSAGE, SPARK_TYPES, fitting, member

NAME = "zipped_logs"
#: Bytes of text between two restart points, about.
SPAN = 32 << 20
SCHEMAS = {
    "messages": "ticker string, row_idx long, " + ", ".join(f"{c} {SPARK_TYPES[t]}" for c, t in MESSAGE.items()),
    "book": "ticker string, row_idx long, h int, " + ", ".join(f"{c} long" for c in LEVEL),
}
_MEMBER = {"messages": "message", "book": "orderbook"}
_POINTS = "ticker string, kind string, number int, offset long, bits int, out long, row long, window binary, lines long"


def place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def find(folder: str, ticker: str, patterns: Sequence[str] = ()) -> str:
    """The path, in its file system, of the ticker's zip."""
    fs, root = place(folder)
    names = sorted((i.base_name, i.path) for i in fs.get_file_info(pafs.FileSelector(root)) if i.is_file and ticker in i.base_name and i.base_name.endswith(".zip"))
    found = fitting(names, ticker, patterns)
    if found is None:
        raise FileNotFoundError(f"no zip of {ticker} in {folder}")
    return found


@dataclass
class Span(InputPartition):
    """Lines of a member that begin in [start.out, end) bytes of its text; rows: of line numbers, what is known."""

    ticker: str
    file: str
    start: Point
    end: int | None = None
    rows: tuple[int, int | None] = (0, None)


@dataclass
class Bounds:
    """What filters ask for: tickers, and the first and last value of row_idx and time (each may be open)."""

    tickers: set[str] | None = None
    low: dict[str, tuple[float, bool]] = field(default_factory=dict)
    high: dict[str, tuple[float, bool]] = field(default_factory=dict)

    def take(self, f: Filter) -> bool:
        """Whether the filter is wholly taken over."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if name in ("ticker", "row_idx", "time") and isinstance(f, IsNotNull):
            return True
        if name == "ticker" and isinstance(f, EqualTo | In):
            own = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.tickers = own if self.tickers is None else self.tickers & own
        elif name in ("row_idx", "time") and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and isinstance(f.value, int | float) and f.value == f.value:
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                # the later of two bounds, and of equal ones the open one
                self.low[name] = max(self.low.get(name, (f.value, False)), (f.value, isinstance(f, GreaterThan)))
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                self.high[name] = min(self.high.get(name, (f.value, True)), (f.value, not isinstance(f, LessThan)))
        else:
            return False
        return True

    def inside(self, name: str, x: np.ndarray) -> np.ndarray:
        keep = np.ones(len(x), bool)
        if name in self.low:
            v, open_ = self.low[name]
            keep &= x > v if open_ else x >= v
        if name in self.high:
            v, closed = self.high[name]
            keep &= x <= v if closed else x < v
        return keep

    def over(self, name: str, x: float) -> bool:
        """Whether x and all above are out."""
        return name in self.high and x > self.high[name][0]


class ZippedLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "messages")]

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(dict(self.options), schema.names)


class LogReader(DataSourceReader):
    """parsed: lines and values that were parsed, of what this object read itself."""

    def __init__(self, options: dict[str, str], columns: list[str]):
        self.kind, self.folder = options.get("kind", "messages"), options["path"]
        self.tickers = [t for t in options["tickers"].split(",") if t]
        self.patterns = [p for p in options.get("patterns", "").split("|") if p]
        self.levels, self.index, self.wanted = int(options.get("levels", CONFIG.levels)), options.get("index"), options.get("wanted")
        self.columns, self.bounds, self.parsed = columns, Bounds(), {"lines": 0, "values": 0}
        known = [f.split()[0] for f in SCHEMAS[self.kind].split(", ")]
        if set(columns) - set(known):
            raise ValueError(f"no such columns: {sorted(set(columns) - set(known))}")
        if self.wanted and self.kind != "book":
            raise ValueError("wanted rows are of a book")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.bounds.take(f):
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        for t in self.tickers:
            if self.bounds.tickers is not None and t not in self.bounds.tickers:
                continue
            file = find(self.folder, t, self.patterns)
            known = self._points(t)
            for i, p in enumerate(known):
                end = known[i + 1] if i + 1 < len(known) else None
                rows = (p.row, end.row if end else None)
                first, last = self.bounds.low.get("row_idx"), self.bounds.high.get("row_idx")
                if (first and rows[1] is not None and rows[1] - 1 < first[0]) or (last and rows[0] > last[0]):
                    continue
                out.append(Span(t, file, p, end.out if end else None, rows))
        return out

    def _points(self, ticker: str) -> list[Point]:
        if not self.index:
            return [Point()]
        fs, root = place(self.index)
        rows = ds.dataset(root, filesystem=fs, format="parquet").to_table(filter=(ds.field("ticker") == ticker) & (ds.field("kind") == self.kind)).sort_by("number").to_pylist()
        if not rows:
            raise ValueError(f"the index has no {self.kind} of {ticker}")
        return [Point(r["offset"], r["bits"], r["out"], r["row"], r["window"]) for r in rows]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        fs, _ = place(self.folder)
        wanted = self._wanted(span) if self.wanted else None
        if wanted is not None and not len(wanted):
            return
        with fs.open_input_file(span.file) as f:
            with zipfile.ZipFile(f) as z:
                info = z.getinfo(member(z.namelist(), _MEMBER[self.kind], span.ticker))
                text = text_from(f, info, span.start) if self.index else iter(lambda opened=z.open(info): opened.read(1 << 20), b"")
                took = 0
                for row, block, starts, ends in lines(text, span.start, span.end):
                    if self.kind == "book":
                        numbers = np.arange(row, row + len(starts))
                        keep = np.flatnonzero(self.bounds.inside("row_idx", numbers))
                        if wanted is not None:
                            a, b = np.searchsorted(wanted, [row, row + len(starts)])
                            keep, took = np.intersect1d(keep, wanted[a:b] - row, assume_unique=True), b
                        if len(keep):
                            yield self._book(span.ticker, block, starts[keep], ends[keep], numbers[keep])
                    else:
                        out, over = self._messages(span.ticker, block, starts, ends, row)
                        if out is not None:
                            yield out
                        if over:
                            return
                    if (wanted is not None and took == len(wanted)) or self.bounds.over("row_idx", row + len(starts) - 1):
                        return
                if wanted is not None and took < len(wanted) and span.end is None:
                    raise ValueError(f"the book of {span.ticker} has no row {wanted[took]}")

    def _wanted(self, span: Span) -> np.ndarray:
        fs, root = place(self.wanted)
        asked = (ds.field("ticker") == span.ticker) & (ds.field("row_idx") >= span.rows[0])
        if span.rows[1] is not None:
            asked &= ds.field("row_idx") < span.rows[1]
        return np.unique(ds.dataset(root, filesystem=fs, format="parquet").to_table(columns=["row_idx"], filter=asked).column("row_idx").to_numpy())

    def _checked(self, what: str, ticker: str, block: bytes, starts: np.ndarray, ends: np.ndarray, numbers: np.ndarray, width: int) -> bytes:
        """The lines, one after the other; raises at the first with another number of columns."""
        whole = len(starts) > 0 and (starts[1:] == ends[:-1] + 1).all()
        text = (block[starts[0] : ends[-1]] if whole else b"\n".join(block[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))) + b"\n"
        commas = np.add.reduceat((np.frombuffer(text, np.uint8) == 44).astype(np.int64), np.concatenate([[0], np.cumsum(ends - starts + 1)[:-1]]))
        odd = np.flatnonzero(commas != width - 1)
        if len(odd):
            raise ValueError(f"row {numbers[odd[0]]} of the {what} of {ticker} has {commas[odd[0]] + 1} columns, not {width}")
        self.parsed["lines"] += len(starts)
        return text

    def _book(self, ticker: str, block: bytes, starts: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
        width = len(LEVEL) * self.levels
        text = self._checked("book", ticker, block, starts, ends, numbers, width)
        wide = pd.read_csv(io.BytesIO(text), header=None, dtype="float64").to_numpy()
        self.parsed["values"] += wide.size
        deep = wide.reshape(-1, len(LEVEL)).astype(np.int64)
        n = len(starts)
        every = {"ticker": lambda: pa.array([ticker]).take(pa.array(np.zeros(n * self.levels, np.int32))), "row_idx": lambda: pa.array(np.repeat(numbers, self.levels)), "h": lambda: pa.array(np.tile(np.arange(1, self.levels + 1, dtype=np.int32), n))}
        every |= {c: lambda i=i: pa.array(deep[:, i]) for i, c in enumerate(LEVEL)}
        return pa.record_batch([every[c]() for c in self.columns], self.columns)

    def _messages(self, ticker: str, block: bytes, starts: np.ndarray, ends: np.ndarray, row: int) -> tuple[pa.RecordBatch | None, bool]:
        """The wanted rows of a block, and whether all further rows are too late."""
        numbers, over, timed = np.arange(row, row + len(starts)), False, "time" in self.bounds.low or "time" in self.bounds.high
        keep = self.bounds.inside("row_idx", numbers)
        if timed:
            text = block[starts[0] : ends[-1]]
            times = pd.read_csv(io.BytesIO(text), header=None, usecols=[0], dtype="float64")[0].to_numpy()
            self.parsed["values"] += len(times)
            keep, over = keep & self.bounds.inside("time", times), self.bounds.over("time", float(times[-1]))
        at = np.flatnonzero(keep)
        if not len(at):
            return None, over
        asked = [c for c in MESSAGE if c in self.columns and not (timed and c == "time")]
        text = self._checked("messages", ticker, block, starts[at], ends[at], numbers[at], len(MESSAGE))
        every = {"ticker": pa.array([ticker]).take(pa.array(np.zeros(len(at), np.int32))), "row_idx": pa.array(numbers[at])}
        if asked:
            frame = pd.read_csv(io.BytesIO(text), header=None, names=list(MESSAGE), usecols=asked, dtype={c: MESSAGE[c] for c in asked})
            self.parsed["values"] += frame.size
            every |= {c: pa.array(frame[c].to_numpy()) for c in asked}
        if timed:
            every["time"] = pa.array(times[at])
        return pa.record_batch([every[c] for c in self.columns], self.columns), over


def lines(text: Iterator[bytes], start: Point, end: int | None) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """Blocks of whole lines that begin in [start.out, end): number of the first, bytes, where each begins and ends (without its line end)."""
    rest, at, row = b"", start.out, start.row
    skip = bool(start.window) and start.window[-1:] != b"\n"
    for piece in _with_end(text):
        data = rest + piece if piece is not None else rest + (b"\n" if rest and not rest.endswith(b"\n") else b"")
        if skip:
            cut = data.find(b"\n") + 1
            if not cut:
                # the line that came before goes on
                at, rest = at + len(data), b""
                continue
            data, at, skip = data[cut:], at + cut, False
        whole = data.rfind(b"\n") + 1
        block, rest = data[:whole], data[whole:]
        if whole:
            ends = np.flatnonzero(np.frombuffer(block, np.uint8) == 10)
            starts = np.concatenate([[0], ends[:-1] + 1])
            n = len(starts) if end is None else int(np.searchsorted(starts + at, end))
            if n:
                yield row, block, starts[:n], ends[:n]
            if n < len(starts):
                return
            row, at = row + n, at + whole
        if end is not None and at >= end:
            return


def _with_end(text: Iterator[bytes]) -> Iterator[bytes | None]:
    yield from text
    yield None


def reader(spark: SparkSession, folder: str, tickers: Sequence[str], kind: str = "messages", patterns: Sequence[str] = (), index: str | None = None, **options: object):
    """A reader of the source with its options; the session then knows the source and passes filters on."""
    spark.dataSource.register(ZippedLogs)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    r = spark.read.format(NAME).option("tickers", ",".join(tickers)).option("kind", kind).option("patterns", "|".join(patterns))
    for k, v in {"index": index, **options}.items():
        r = r.option(k, str(v)) if v is not None else r
    return Opened(r, folder)


@dataclass
class Opened:
    read: object
    folder: str

    def load(self, *columns: str) -> DataFrame:
        """All columns, or messages with these alone (others aren't parsed)."""
        kinds = dict(f.split() for f in SCHEMAS["messages"].split(", "))
        return (self.read.schema(", ".join(f"{c} {kinds[c]}" for c in columns)) if columns else self.read).load(self.folder)


def restart_points(spark: SparkSession, folder: str, tickers: Sequence[str], patterns: Sequence[str] = (), span: int = SPAN) -> DataFrame:
    """A row for each point of each ticker's two members, with the member's number of lines. A task passes over a member once."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = place(folder)
        for batch in batches:
            for ticker, kind in zip(batch["ticker"], batch["kind"], strict=True):
                with fs.open_input_file(find(folder, ticker, patterns)) as f:
                    with zipfile.ZipFile(f) as z:
                        info = z.getinfo(member(z.namelist(), _MEMBER[kind], ticker))
                    found, count = points(f, info, span)
                yield pd.DataFrame([(ticker, kind, i, p.offset, p.bits, p.out, p.row, p.window, count) for i, p in enumerate(found)], columns=[c.split()[0] for c in _POINTS.split(", ")])

    if library() is None:
        raise OSError("zlib's C library isn't there: read without an index")
    every = spark.createDataFrame([(t, k) for t in tickers for k in SCHEMAS], "ticker string, kind string")
    return every.repartition(2 * len(tickers), "ticker", "kind").mapInPandas(rows, _POINTS)


def line_counts(index: DataFrame) -> DataFrame:
    """ticker, message_rows, book_rows of an index; raises while running where they differ."""
    x = index.groupBy("ticker").agg(*(F.max(F.when(F.col("kind") == k, F.col("lines"))).alias(n) for k, n in (("messages", "message_rows"), ("book", "book_rows"))))
    both = F.concat_ws(" ", F.lit("messages and book rows differ:"), "ticker", "message_rows", "book_rows")
    return x.select("ticker", "message_rows", F.when(F.col("message_rows") == F.col("book_rows"), F.col("book_rows")).otherwise(F.raise_error(both).cast("long")).alias("book_rows"))


def selected_book(spark: SparkSession, folder: str, wanted: DataFrame, tickers: Sequence[str], patterns: Sequence[str] = (), index: str | None = None, c: Config = CONFIG) -> DataFrame:
    """The book's levels of the wanted rows (ticker, row_idx and what else they have); no other row is parsed.

    Each task reads the numbers of its own lines from a sorted table of them. A row that isn't there raises.
    """
    ids = stage(wanted.select("ticker", "row_idx").distinct().repartitionByRange("ticker", "row_idx").sortWithinPartitions("ticker", "row_idx"))
    path = ids.inputFiles()[0].rpartition("/")[0]
    book = reader(spark, folder, tickers, "book", patterns, index, wanted=path, levels=c.levels).load()
    return book if set(wanted.columns) == {"ticker", "row_idx"} else wanted.join(book, ["ticker", "row_idx"])
