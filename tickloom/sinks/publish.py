"""Results that appear whole or not at all, and only behind their gate.

A run writes its tables to a place of its own, so readers of earlier runs see nothing of it. Metrics are observed by the
same pass that writes (no table is scanned for them); the gate judges them, and what else it wants to read of the written
tables. Then one small file, put in place by a rename, ends the run: PASS makes its tables the current ones, FAIL leaves the
current ones readable but takes back the folder's PASS, so later steps that ask for it stop. A run that raises leaves no such
file and changes nothing. Two runs at once: the one that ends later finds its number taken, and raises.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.gates import statuses

Metrics = dict[str, dict[str, object]]
#: Rows of checks (step, name, status, observed, expected) of the written tables and the metrics of their writing.
Gate = Callable[[dict[str, DataFrame], Metrics], DataFrame]


class GateFailed(Exception):
    """The last run of a folder didn't pass, or none has run."""


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _ends(spark: SparkSession, folder: str) -> list[str]:
    """The names of the files that ended runs, in order."""
    fs, path = _fs(spark, folder)
    if not fs.exists(path(f"{folder}/_ends")):
        return []
    return sorted(n for s in fs.listStatus(path(f"{folder}/_ends")) if (n := s.getPath().getName()).endswith(".json"))


def runs(spark: SparkSession, folder: str) -> list[dict]:
    """What each ended run left: number, run, status, tables, failed checks. In order."""
    names = _ends(spark, folder)
    if not names:
        return []
    rows = spark.read.text([f"{folder}/_ends/{n}" for n in names], wholetext=True).collect()
    return sorted((json.loads(r["value"]) for r in rows), key=lambda x: x["number"])


def _end(spark: SparkSession, folder: str, told: dict) -> None:
    fs, path = _fs(spark, folder)
    fs.mkdirs(path(f"{folder}/_ends"))
    hidden, last = path(f"{folder}/_ends/.{told['run']}"), path(f"{folder}/_ends/{told['number']:08d}.json")
    out = fs.create(hidden, True)
    out.write(bytearray(json.dumps(told).encode()))
    out.close()
    if fs.exists(last) or not fs.rename(hidden, last):
        fs.delete(hidden, False)
        raise RuntimeError(f"another run ended as number {told['number']} of {folder}")


def publish(spark: SparkSession, folder: str, tables: Mapping[str, DataFrame], gate: Gate, metrics: Mapping[str, Sequence[Column]] | None = None, partition_by: Mapping[str, Sequence[str]] | None = None) -> dict:
    """Writes the tables, gates them, ends the run; returns what it left. metrics: aggregates to observe while a table is written."""
    number, run, seen = len(_ends(spark, folder)) + 1, uuid.uuid4().hex, {}
    for name, rows in tables.items():
        observed = Observation(f"{name}_{run}") if metrics and name in metrics else None
        rows = rows.observe(observed, *metrics[name]) if observed else rows
        rows.write.partitionBy(*(partition_by or {}).get(name, ())).parquet(f"{folder}/{run}/{name}")
        if observed:
            seen[name] = observed.get
    checks = gate({n: spark.read.schema(t.schema).parquet(f"{folder}/{run}/{n}") for n, t in tables.items()}, seen)
    checks.write.parquet(f"{folder}/{run}/_checks")
    checks = spark.read.schema(checks.schema).parquet(f"{folder}/{run}/_checks")
    passed = all(r["status"] == "PASS" for r in statuses(checks).collect())
    failed = [] if passed else sorted(r["name"] for r in checks.filter("status <> 'PASS'").select("name").limit(1000).collect())
    told = {"number": number, "run": run, "status": "PASS" if passed else "FAIL", "tables": sorted(tables), "failed": failed}
    _end(spark, folder, told)
    return told


def status(spark: SparkSession, folder: str) -> str | None:
    """PASS or FAIL of the last ended run; none has ended: None."""
    ended = runs(spark, folder)
    return ended[-1]["status"] if ended else None


def require_pass(spark: SparkSession, folder: str) -> None:
    """Raises unless the last ended run passed: an earlier PASS doesn't count."""
    ended = runs(spark, folder)
    if not ended or ended[-1]["status"] != "PASS":
        raise GateFailed(f"{folder}: {'no run has ended' if not ended else 'failed ' + ', '.join(ended[-1]['failed'])}")


def current(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the last run that passed; a later run that failed or is under way doesn't show."""
    for told in reversed(runs(spark, folder)):
        if told["status"] == "PASS" and name in told["tables"]:
            return spark.read.parquet(f"{folder}/{told['run']}/{name}")
    raise FileNotFoundError(f"no run of {folder} with {name} has passed")


def observed_checks(spark: SparkSession, step: str, metrics: Metrics, checks: Mapping[str, tuple[str, str, str]]) -> DataFrame:
    """Rows of checks on observed metrics. checks: of each name the table, a condition over its metrics in SQL, and what is expected in words."""
    parts = []
    for name, (table, condition, expected) in checks.items():
        values = metrics[table]
        row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
        parts.append(row.select(F.lit(step).alias("step"), F.lit(name).alias("name"), F.when(F.coalesce(F.expr(condition), F.lit(False)), "PASS").otherwise("FAIL").alias("status"), F.lit(", ".join(f"{k}={v}" for k, v in values.items())).alias("observed"), F.lit(expected).alias("expected")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
