"""Messages and order books as zipped logs: a zip a ticker with two headerless CSV members, as `sources` read them."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG, Config
from ..sources.logs import LEVEL, MESSAGE
from ..sources.zipped import place

_NAMES = ("message", "orderbook")


def zip_logs(messages: DataFrame, book: DataFrame, folder: str, c: Config = CONFIG) -> DataFrame:
    """ticker, file, message_rows, book_rows of the zips, written when this runs. Rows are in order of row_idx.

    messages: ticker, row_idx and the columns of a message; book: ticker, row_idx, h and the level's columns. Lines are made
    by Spark; a task writes a ticker's zip as its sorted lines stream by, under another name until it is whole.
    """
    a = messages.select("ticker", F.lit(0).alias("kind"), "row_idx", F.concat_ws(",", *(F.coalesce(F.col(x).cast("string"), F.lit("")) for x in MESSAGE)).alias("line"))
    level = F.struct("h", F.concat_ws(",", *(F.col(x).cast("string") for x in LEVEL)).alias("v"))
    b = book.groupBy("ticker", "row_idx").agg(F.array_sort(F.collect_list(level)).alias("r"))
    b = b.select("ticker", F.lit(1).alias("kind"), "row_idx", F.array_join(F.transform("r", lambda e: e["v"]), ",").alias("line"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = place(folder)
        now, z, member, counts, done = None, None, None, [0, 0], []

        def close(kind: int | None = None) -> None:
            """Ends the open member; with no kind the zip too."""
            nonlocal z, member
            if member is not None:
                member.close()
                member = None
            if kind is None and z is not None:
                z.close()
                stream.close()
                fs.move(hidden, f"{root}/{now[0]}_{c.levels}.zip")
                done.append((now[0], f"{root}/{now[0]}_{c.levels}.zip", *counts))
                z = None

        fs.create_dir(root)
        for batch in batches:
            for ticker, kind, line in zip(*(batch.column(n).to_pylist() for n in ("ticker", "kind", "line")), strict=True):
                if (ticker, kind) != now:
                    close(kind if now and now[0] == ticker else None)
                    if z is None:
                        hidden, counts = f"{root}/.{uuid.uuid4().hex}", [0, 0]
                        stream = fs.open_output_stream(hidden)
                        z = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
                    now, member = (ticker, kind), z.open(f"{ticker}_{_NAMES[kind]}_{c.levels}.csv", "w", force_zip64=True)
                member.write(line.encode() + b"\n")
                counts[kind] += 1
        close()
        yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*done, strict=True) if done else ((),) * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["ticker", "file", "message_rows", "book_rows"])

    every = a.unionByName(b).repartition("ticker").sortWithinPartitions("ticker", "kind", "row_idx")
    return every.mapInArrow(write, "ticker string, file string, message_rows long, book_rows long")
