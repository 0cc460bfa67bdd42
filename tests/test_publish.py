"""Runs that appear whole or not at all: gates, revoked passes, raising stages, races, observed metrics."""

import pytest
from pyspark.sql import functions as F

from tickloom.sinks import publish as P


def gate(most):
    return lambda tables, seen: P.observed_checks(tables["a"].sparkSession, "02", seen, {"rows": ("a", f"n BETWEEN 1 AND {most}", f"1 to {most}"), "largest": ("a", "high < 100", "< 100")})


@pytest.fixture
def metrics(spark):
    return {"a": [F.count("*").alias("n"), F.max("v").alias("high")]}


def rows(df):
    return sorted(r["v"] for r in df.collect())


def test_a_failed_gate_takes_back_the_pass_and_leaves_the_result(spark, tmp_path, metrics):
    f = str(tmp_path / "out")
    put = lambda *v, most=3: P.publish(spark, f, {"a": spark.createDataFrame([(x,) for x in v], "v long"), "b": spark.range(2)}, gate(most), metrics)
    assert P.status(spark, f) is None
    with pytest.raises(P.GateFailed, match="no run has ended"):
        P.require_pass(spark, f)
    with pytest.raises(FileNotFoundError):
        P.current(spark, f, "a")
    assert put(1, 2)["status"] == "PASS" and rows(P.current(spark, f, "a")) == [1, 2]
    P.require_pass(spark, f)
    told = put(1, 2, 3, 4, 500)
    assert told["failed"] == ["largest", "rows"] and P.status(spark, f) == "FAIL" and rows(P.current(spark, f, "a")) == [1, 2]
    with pytest.raises(P.GateFailed, match="failed largest, rows"):
        P.require_pass(spark, f)
    assert put(7)["number"] == 3 and rows(P.current(spark, f, "a")) == [7] and [r["status"] for r in P.runs(spark, f)] == ["PASS", "FAIL", "PASS"]
    P.require_pass(spark, f)


def test_a_raising_stage_changes_nothing(spark, tmp_path, metrics):
    f = str(tmp_path / "out")
    a = spark.createDataFrame([(1,)], "v long")
    P.publish(spark, f, {"a": a}, gate(3), metrics)
    held = P.current(spark, f, "a")
    broken = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("v"))
    with pytest.raises(Exception, match="lost"):
        P.publish(spark, f, {"a": a.withColumn("v", F.lit(9).cast("long")), "b": broken}, gate(3), metrics)

    def bad(tables, seen):
        assert rows(P.current(spark, f, "a")) == [1] and rows(tables["a"]) == [9]
        raise RuntimeError("gate broke")

    with pytest.raises(RuntimeError, match="gate broke"):
        P.publish(spark, f, {"a": a.withColumn("v", F.lit(9).cast("long"))}, bad, metrics)
    assert len(P.runs(spark, f)) == 1 and P.status(spark, f) == "PASS" and rows(P.current(spark, f, "a")) == [1] and rows(held) == [1]


def test_of_two_runs_at_once_the_later_raises(spark, tmp_path, metrics):
    f = str(tmp_path / "out")
    put = lambda v, g: P.publish(spark, f, {"a": spark.createDataFrame([(v,)], "v long")}, g, metrics)

    def while_other(tables, seen):
        put(1, gate(3))
        return gate(3)(tables, seen)

    with pytest.raises(RuntimeError, match="another run ended as number 1"):
        put(2, while_other)
    assert rows(P.current(spark, f, "a")) == [1] and len(P.runs(spark, f)) == 1


def test_metrics_come_from_the_pass_that_writes(spark, tmp_path):
    passes = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            passes.add(b.num_rows)
            yield b

    found = {}

    def keep(tables, seen):
        found.update(seen)
        return P.observed_checks(spark, "02", seen, {"finite": ("a", "finite", "true"), "null": ("a", "missing", "never true")})

    told = P.publish(spark, str(tmp_path / "o"), {"a": spark.range(1000).mapInArrow(count, "id long")}, keep, {"a": [F.count("*").alias("n"), F.bool_and(F.col("id") >= 0).alias("finite"), F.max(F.lit(None).cast("boolean")).alias("missing")]})
    assert found["a"] == {"n": 1000, "finite": True, "missing": None} and passes.value == 1000
    assert told["status"] == "FAIL" and told["failed"] == ["null"]


def test_partitioned_tables(spark, tmp_path):
    df = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v long")
    ok = lambda tables, seen: P.observed_checks(spark, "01", {"a": {"n": tables["a"].count()}}, {"n": ("a", "n = 2", "2")})
    P.publish(spark, str(tmp_path / "o"), {"a": df}, ok, partition_by={"a": ["k"]})
    assert rows(P.current(spark, str(tmp_path / "o"), "a").filter("k = 'y'")) == [2]
