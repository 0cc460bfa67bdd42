"""Zipped logs, earlier results, and what is written and read back."""

import json
import zipfile

import pytest

from tickloom.config import Config
from tickloom.operators import bins, book
from tickloom.sinks import tables as sinks
from tickloom.sources import logs
from tickloom.sources import tables as sources

C = Config(bins=4, train_end=2, val_end=3, assets=2, levels=2, taus=(1,))
MESSAGES = ["0.1,1,11,100,1000000,1", "0.2,4,12,50,1000100,-1", "1.5,3,13,10,1000000,1", "9.0,1,14,10,1000000,1"]
BOOK = ["1000100,10,1000000,20,1000200,1,999900,2", "1000200,10,1000000,20,1000300,1,999900,2", "1000100,11,1000000,21,9999999999,0,-9999999999,0", "1000100,10,1000000,20,1000200,1,999900,2"]


def zipped(folder, name, messages=MESSAGES, levels=BOOK, ticker="AAA"):
    with zipfile.ZipFile(folder / name, "w") as z:
        if messages is not None:
            z.writestr(f"x/{ticker}_message_2.csv", "".join(f"{r}\n" for r in messages))
        if levels is not None:
            z.writestr(f"x/{ticker}_OrderBook_2.csv", "".join(f"{r}\n" for r in levels))
    return f"file:{folder}/{name}"


def test_zip_is_found_by_the_first_pattern_that_fits(spark, tmp_path):
    for name in ("B_AAA_2012-06-22_10.zip", "A_AAA_other.zip", "S_AAA_2012-06-21_10.zip", "S_AAA_2012-06-21_10b.zip", "S_BBB_2012-06-21_10.zip"):
        zipped(tmp_path, name)
    name = lambda *p: logs.find_zip(spark, str(tmp_path), "AAA", *p).rpartition("/")[2]
    assert name() == "A_AAA_other.zip"
    assert name("*{ticker}*2012-06-21*10*.zip") == "S_AAA_2012-06-21_10.zip"
    assert name("nothing_{ticker}*.zip", "B_{ticker}*.zip") == "B_AAA_2012-06-22_10.zip"
    with pytest.raises(FileNotFoundError):
        logs.find_zip(spark, str(tmp_path), "AAA", "*{ticker}*1999*.zip")


def test_logs_to_binned_book(spark, tmp_path):
    paths = {"AAA": zipped(tmp_path, "AAA.zip"), "BBB": zipped(tmp_path, "BBB.zip", MESSAGES[:2], BOOK[:2], "BBB")}
    msg = logs.messages(spark, paths)
    assert msg.filter("ticker = 'AAA'").orderBy("row_idx").select("row_idx", "time", "size", "direction").first() == (0, 0.1, 100.0, 1)
    assert logs.messages(spark, paths, ("time", "size")).columns == ["ticker", "row_idx", "time", "size"]
    levels = logs.book_rows(spark, paths, C)
    assert {r["ticker"]: (r["message_rows"], r["book_rows"]) for r in logs.counts_match(msg, levels).collect()} == {"AAA": (4, 4), "BBB": (2, 2)}
    assert logs.book_rows(spark, paths, C, first=1).count() == 2 * C.levels
    binned = logs.binned(msg, ["AAA", "BBB"], 0.0, 1.0, C)
    assert [tuple(r) for r in bins.last_row_per_bin(binned, C).orderBy("asset", "bin_idx").collect()] == [(0, 0, 1), (0, 1, 2), (1, 0, 1)]
    named = levels.join(spark.createDataFrame([("AAA", 0), ("BBB", 1)], "ticker string, asset int"), "ticker").drop("ticker")
    got = book.assert_best(book.binned_book(binned, named, C)).filter("asset = 0 and h = 2").orderBy("bin_idx").collect()
    assert [(r["bin_idx"], r["row_idx"], r["valid"]) for r in got] == [(0, 1, True), (1, 2, False), (2, 2, False), (3, 2, False)]


def test_broken_logs_raise(spark, tmp_path):
    run = lambda df: df.collect()
    short = {"AAA": zipped(tmp_path, "short.zip", MESSAGES, BOOK[:3])}
    with pytest.raises(Exception, match="messages and book rows differ: AAA 4 3"):
        run(logs.counts_match(logs.messages(spark, short), logs.book_rows(spark, short, C)))
    with pytest.raises(Exception, match="row 1 of the book of AAA has 7 columns"):
        run(logs.book_rows(spark, {"AAA": zipped(tmp_path, "w.zip", MESSAGES, [BOOK[0], "1,2,3,4,5,6,7"])}, C))
    with pytest.raises(Exception, match="no orderbook member of AAA"):
        run(logs.book_rows(spark, {"AAA": zipped(tmp_path, "m.zip", MESSAGES, None)}, C))
    with pytest.raises(Exception, match="messages of AAA have 5 columns"):
        run(logs.messages(spark, {"AAA": zipped(tmp_path, "c.zip", ["1,2,3,4,5"])}))
    with pytest.raises(Exception, match="no message member of AAA"):
        run(logs.messages(spark, {"AAA": zipped(tmp_path, "t.zip", ticker="ZZZ")}))
    with pytest.raises(ValueError, match="no such columns"):
        logs.messages(spark, short, ("colour",))
    assert logs.messages(spark, {"AAA": zipped(tmp_path, "e.zip", [], [])}).count() == 0


def test_tables_written_and_read_back(spark, tmp_path):
    f = str(tmp_path / "f")
    c = Config(assets=1, features=2, taus=(1, 2))
    feats = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, 1.0), (0, 1, 0, 3.0), (0, 1, 1, 0.0)], "asset int, bin_idx long, f int, x double")
    scaler = spark.createDataFrame([(0, 0, 2.0, 1.0, 1.0), (0, 1, 0.5, 0.5, 0.5)], "asset int, f int, mu double, sigma double, sigma_safe double")
    mids = spark.createDataFrame([(0, b, 100.0 * 2**b, 1.0) for b in range(3)], "asset int, bin_idx long, mid double, spread double")
    one = spark.createDataFrame([(0, 0, 1, 0.5)], "asset int, bin_idx long, tau int, y double")
    g = spark.createDataFrame([("a", 0, 0, 0.0)], "graph string, src int, dst int, w double")
    sinks.feature_tables(f, features=feats, scaler=scaler, mids=mids, targets=one, graphs=g)
    assert sorted(r["x"] for r in sources.features(spark, f, c).collect()) == [-1.0, -1.0, 1.0, 1.0]
    sinks.feature_tables(f, standardized=feats)
    assert sources.features(spark, f, c).count() == 4
    assert [r["mask"] for r in sources.event_mask(spark, f, c).orderBy("bin_idx").collect()] == [1, 0]
    y = {(r["tau"], r["bin_idx"]): r["y"] for r in sources.log_returns(spark, f, c).collect()}
    assert y[1, 0] == 0.5 and y[2, 0] == pytest.approx(2 * 0.6931471805599453) and y[2, 2] is None
    assert sources.graph(spark, f, "a").count() == 1
    with pytest.raises(KeyError, match="b"):
        sources.graph(spark, f, "b")


def test_csv_json_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, "x"), (2, 1e-9, "y")], "tau int, mse double, model string")
    sinks.csv(rows, str(tmp_path / "c"), ["model", "tau", "missing"])
    assert sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "c")).collect())) == [("x", "1", None), ("y", "2", None)]
    sinks.results_json(rows, str(tmp_path / "j"))
    assert sorted(r["mse"] for r in sources.results(spark, str(tmp_path / "j"), "tau int, mse double", lines=True).collect()) == [1e-09, 0.5]
    (tmp_path / "r.json").write_text(json.dumps([{"tau": 1, "best": {"mse": 2.0}}, {"tau": 2, "best": {"mse": 3.0}}], indent=2))
    assert [r["mse"] for r in sources.results(spark, str(tmp_path / "r.json")).orderBy("tau").select("best.mse").collect()] == [2.0, 3.0]
    sinks.metadata(spark, {"taus": (1, 2), "path": tmp_path}, str(tmp_path / "m"))
    part = next((tmp_path / "m").glob("part-*")).read_text()
    assert json.loads(part) == {"taus": [1, 2], "path": str(tmp_path)}
    summary = spark.createDataFrame([(0, 0, 3, 1), (0, 1, 0, 0)], "asset int, bin_idx long, n_valid_events int, event_mask int")
    sinks.event_summaries(summary, ["AAA"], str(tmp_path / "e"))
    assert [tuple(r) for r in sources.activity(spark, str(tmp_path / "e")).orderBy("bin_idx").collect()] == [(0, 1), (1, 0)]
    text = sinks.report("Title", {"rows": 2, "range": (0.123456789012, 1)}, {"Results": rows.orderBy("tau")})
    assert text == "# Title\n\n- rows: 2\n- range: (0.12345679, 1)\n\n## Results\n\n| tau | mse | model |\n|---|---|---|\n| 1 | 0.500000 | x |\n| 2 | 1e-09 | y |\n"
