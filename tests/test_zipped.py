"""Zipped logs as a data source: pruning, filters, restart points, wanted rows, and the sink that writes them."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan

from tickloom.config import Config
from tickloom.sinks.logs import zip_logs
from tickloom.sources import inflate, logs, zipped

C = Config(levels=2)
N = 60_000


def texts(n=N, end="\n"):
    rng = np.random.default_rng(5)
    msg = [f"{i / 10:.1f},{1 + i % 5},{i},{rng.integers(1, 500)},{1_000_000 + int(rng.integers(-500, 500)) * 100},{1 if i % 2 else -1}" for i in range(n)]
    book = [f"{1000100 + i},{i % 9 + 1},{1000000 - i},{i % 7 + 1},{1000200 + i},3,{999900 - i},4" for i in range(n)]
    return end.join(msg) + end, end.join(book) + end


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    f = tmp_path_factory.mktemp("zips")
    for ticker, how in (("AAA", zipfile.ZIP_DEFLATED), ("BBB", zipfile.ZIP_STORED)):
        with zipfile.ZipFile(f / f"{ticker}_2012-06-21_2.zip", "w", how) as z:
            for name, text in zip(("message", "orderbook"), texts(), strict=True):
                z.writestr(f"d/{ticker}_{name}_2.csv", text)
    return str(f)


def rows(df):
    return sorted(map(tuple, df.collect()))


def local(folder, columns=None, filters=(), **options):
    """A reader in this process, what it left of the filters, and all rows it gives, one list a partition."""
    kind = options.get("kind", "messages")
    r = zipped.LogReader({"path": folder, "tickers": "AAA,BBB", "levels": "2", **options}, columns or [f.split()[0] for f in zipped.SCHEMAS[kind].split(", ")])
    left = list(r.pushFilters(list(filters)))
    return r, left, [[tuple(x.values()) for b in r.read(p) for x in b.to_pylist()] for p in r.partitions()]


def test_same_rows_as_by_sparks_binary_reader(spark, folder):
    paths = {t: logs.find_zip(spark, folder, t) for t in ("AAA", "BBB")}
    index = zipped.restart_points(spark, folder, ["AAA", "BBB"], span=20_000)
    index.write.parquet(folder + "/index")
    assert {(r["ticker"], r["message_rows"], r["book_rows"]) for r in zipped.line_counts(index).collect()} == {("AAA", N, N), ("BBB", N, N)}
    for at in (None, folder + "/index"):
        msg = zipped.reader(spark, folder, ["AAA", "BBB"], index=at).load()
        assert rows(msg) == rows(logs.messages(spark, paths))
        parts = msg.rdd.getNumPartitions()
        assert parts == 2 if at is None else parts > 4, parts
        few = zipped.reader(spark, folder, ["AAA", "BBB"], index=at).load("ticker", "size", "time")
        assert rows(few.select("ticker", "time", "size")) == rows(logs.messages(spark, paths, ("time", "size")).select("ticker", "time", "size"))
        book = zipped.reader(spark, folder, ["AAA", "BBB"], "book", index=at, levels=2).load()
        assert rows(book) == rows(logs.book_rows(spark, paths, C))
        part = msg.filter("ticker = 'BBB' and time >= 100.0 and time < 200.05 and event_type = 3")
        assert rows(part) == rows(logs.messages(spark, paths).filter("ticker = 'BBB' and time >= 100.0 and time < 200.05 and event_type = 3"))
        plan = part._jdf.queryExecution().executedPlan().toString()
        left = plan[plan.index("Filter") :].split("\n")[0]
        assert "event_type" in left and "time" not in left and "ticker" not in left


def test_only_wanted_columns_and_rows_are_parsed(folder):
    r, _, got = local(folder, ["row_idx", "size"])
    assert r.parsed == {"lines": 2 * N, "values": 2 * N} and [len(p) for p in got] == [N, N]
    r, left, got = local(folder, ["row_idx", "size"], [EqualTo(("ticker",), "AAA"), GreaterThanOrEqual(("row_idx",), 10), LessThan(("row_idx",), 15), IsNotNull(("size",))])
    assert [type(f) for f in left] == [IsNotNull] and r.parsed == {"lines": 5, "values": 5} and [x[0] for x in got[0]] == [10, 11, 12, 13, 14] and len(got) == 1
    r, left, got = local(folder, ["row_idx", "price"], [In(("ticker",), ("BBB", "CCC")), GreaterThanOrEqual(("time",), 1.0), LessThan(("time",), 2.0), EqualTo(("size",), 1.0)])
    assert len(left) == 1 and [x[0] for x in got[0]] == list(range(10, 20)) and r.parsed["lines"] == 10
    # reading ended at the first block after the last wanted time
    assert r.parsed["values"] < 10 + N


def test_points_outside_are_not_opened(spark, folder, tmp_path):
    zipped.restart_points(spark, folder, ["AAA", "BBB"], span=20_000).write.parquet(str(tmp_path / "i"))
    r, _, got = local(folder, ["row_idx"], [GreaterThanOrEqual(("row_idx",), N - 10)], index=str(tmp_path / "i"))
    assert [x[0] for p in got for x in p] == list(range(N - 10, N)) * 2 and len(got) <= 4
    r, _, got = local(folder, None, [], index=str(tmp_path / "i"), kind="book")
    assert len(got) > 6 and sum(map(len, got)) == 4 * N and r.parsed["lines"] == 2 * N


def test_wanted_rows_of_the_book(spark, folder, tmp_path):
    zipped.restart_points(spark, folder, ["AAA", "BBB"], span=20_000).write.parquet(str(tmp_path / "i"))
    ids = [N - 1, 5, 0, 41_700, 41_701, 5]
    wanted = spark.createDataFrame([("AAA", i, n) for n, i in enumerate(ids)], "ticker string, row_idx long, place int")
    paths = {"AAA": logs.find_zip(spark, folder, "AAA")}
    for index in (None, str(tmp_path / "i")):
        got = zipped.selected_book(spark, folder, wanted, ["AAA"], index=index, c=C)
        assert rows(got.select("ticker", "row_idx", "h", *logs.LEVEL).distinct()) == rows(logs.book_rows(spark, paths, C).filter(F.col("row_idx").isin(ids)))
        # the caller's order comes back with the rows
        assert [r["row_idx"] for r in got.filter("h = 1").orderBy("place").collect()] == ids
        with pytest.raises(Exception, match=f"the book of AAA has no row {N}"):
            zipped.selected_book(spark, folder, spark.createDataFrame([("AAA", N)], "ticker string, row_idx long"), ["AAA"], index=index, c=C).collect()
    wanted.select("ticker", "row_idx").write.parquet(str(tmp_path / "w"))
    r, _, got = local(folder, kind="book", wanted=str(tmp_path / "w"), index=str(tmp_path / "i"))
    assert r.parsed == {"lines": 5, "values": 5 * 8} and sorted({x[1] for p in got for x in p}) == sorted(set(ids))


def test_odd_members(spark, tmp_path):
    def zipped_up(name, msg, book):
        (tmp_path / name).mkdir()
        with zipfile.ZipFile(tmp_path / name / "AAA.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("AAA_message.csv", msg)
            z.writestr("AAA_orderbook.csv", book)
        return str(tmp_path / name)

    read = lambda f, kind: zipped.reader(spark, f, ["AAA"], kind, levels=2).load()
    msg, book = texts(50)
    # no line end at the end, other line ends, nothing at all
    f = zipped_up("a", msg.rstrip("\n"), book.replace("\n", "\r\n"))
    assert read(f, "messages").count() == 50 and rows(read(f, "book"))[-1][:3] == ("AAA", 49, 2)
    f = zipped_up("b", "", "")
    assert read(f, "messages").count() == 0 and read(f, "book").count() == 0
    assert rows(zipped.line_counts(zipped.restart_points(spark, f, ["AAA"]))) == [("AAA", 0, 0)]
    f = zipped_up("c", msg + "1,2,3\n", book + "1,2,3,4\n")
    with pytest.raises(Exception, match="row 50 of the messages of AAA has 3 columns, not 6"):
        read(f, "messages").collect()
    with pytest.raises(Exception, match="row 50 of the book of AAA has 4 columns, not 8"):
        read(f, "book").collect()
    # a broken row that isn't wanted isn't looked at, but it is counted
    assert zipped.selected_book(spark, f, spark.createDataFrame([("AAA", 7)], "ticker string, row_idx long"), ["AAA"], c=C).count() == 2
    f = zipped_up("d", msg, book[: book.index("\n") + 1])
    with pytest.raises(Exception, match="messages and book rows differ: AAA 50 1"):
        zipped.line_counts(zipped.restart_points(spark, f, ["AAA"])).collect()
    with pytest.raises(FileNotFoundError):
        zipped.find(f, "ZZZ")


def test_restart_points_by_brute_force(tmp_path):
    rng = np.random.default_rng(6)
    for how in (zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED):
        for text in (b"", b"\n", texts(20_000)[0].encode(), bytes(rng.integers(9, 12, 300_000).astype(np.uint8)), b"no line end" * 50_000):
            with zipfile.ZipFile(tmp_path / "a.zip", "w", how) as z:
                z.writestr("m", text)
                info = z.getinfo("m")
            with open(tmp_path / "a.zip", "rb") as f:
                found, count = inflate.points(f, info, 40_000)
                assert count == text.count(b"\n") + (text[-1:] not in (b"", b"\n"))
                for p in found:
                    assert b"".join(inflate.text_from(f, info, p)) == text[p.out :]
                    assert p.row == text[: p.out].count(b"\n") + (p.out > 0 and text[p.out - 1 : p.out] != b"\n")


def test_sink_writes_what_the_source_reads(spark, tmp_path, folder):
    paths = {t: logs.find_zip(spark, folder, t) for t in ("AAA", "BBB")}
    msg, book = logs.messages(spark, paths), logs.book_rows(spark, paths, C)
    written = zip_logs(msg, book, str(tmp_path / "out"), C)
    assert {(r["ticker"], r["message_rows"], r["book_rows"]) for r in written.collect()} == {("AAA", N, N), ("BBB", N, N)}
    assert rows(zipped.reader(spark, str(tmp_path / "out"), ["AAA", "BBB"]).load()) == rows(msg)
    assert rows(zipped.reader(spark, str(tmp_path / "out"), ["AAA", "BBB"], "book", levels=2).load()) == rows(book)
    assert zip_logs(msg.limit(0), book.limit(0), str(tmp_path / "none"), C).count() == 0
