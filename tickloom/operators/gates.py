"""Quality gates: named checks of each step with what was observed, as rows; a step passes if all of its checks do.

Each family of checks is one aggregation; its columns become rows by stack(), none is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG, Config
from . import bins

#: name, observed (a number or a truth value), whether that is right, what is expected.
Check = tuple[str, Column, Column, str]


def rows_of(found: DataFrame, step: str, checks: list[Check], prefix: Column | None = None) -> DataFrame:
    """step, name, status, observed, expected: a row for every check and every row of found. prefix: of the names."""
    parts = [F.array(*(F.struct(F.lit(n).alias("name"), o.cast("double").alias("observed"), F.coalesce(ok, F.lit(False)).alias("ok"), F.lit(e).alias("expected")) for n, o, ok, e in checks))]
    x = found.select((prefix if prefix is not None else F.lit("")).alias("prefix"), F.explode(parts[0]).alias("c"))
    return x.select(F.lit(step).alias("step"), F.concat("prefix", "c.name").alias("name"), F.when(F.col("c.ok"), "PASS").otherwise("FAIL").alias("status"), "c.observed", "c.expected")


def equals(name: str, column: str, value: float) -> Check:
    return name, F.col(column), F.col(column) == value, f"{value:g}"


def positive(name: str, column: str) -> Check:
    return name, F.col(column), F.col(column) > 0, "> 0"


def holds(name: str, column: str) -> Check:
    return name, F.col(column), F.col(column), "1"


def stacked(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def statuses(checks: DataFrame) -> DataFrame:
    """step, status, checks, failed: PASS if every check of the step is."""
    return checks.groupBy("step").agg(F.when(F.bool_and(F.col("status") == "PASS"), "PASS").otherwise("FAIL").alias("status"), F.count("*").alias("checks"), F.count_if(F.col("status") != "PASS").alias("failed"))


def _asset(c: Column | str = "asset") -> Column:
    return F.concat(F.lit("asset_"), F.col(c).cast("string"), F.lit("_"))


def raw(msg: DataFrame, book: DataFrame, c: Config = CONFIG, sample: int = 500) -> DataFrame:
    """Step 01, of messages and the book (long form, with row_idx): rows on both sides, ends of the grid, bins, a sample of the book."""
    a = msg.groupBy("asset").agg(F.count("*").alias("message_rows"), F.min("bin_idx").alias("first_bin"), F.max("bin_idx").alias("last_bin"))
    ev = bins.clean(msg, c)
    a = a.join(ev.groupBy("asset").agg(F.countDistinct("bin_idx").alias("event_bins")), "asset")
    ids = msg.select("row_idx", "asset")
    b = book.join(ids, "row_idx")
    best, first = F.col("h") == 1, F.col("row_idx") < sample
    b = b.groupBy("asset").agg(
        F.count_if(best).alias("book_rows"), F.max("h").alias("levels"),
        F.min(F.when(best & first, (F.col("ask_p") - F.col("bid_p")) / 10000)).alias("spread_min"),
        F.coalesce(F.bool_and(F.when(best & first, (F.col("ask_q") > 0) & (F.col("bid_q") > 0))), F.lit(True)).alias("sizes_positive"),
    )
    per = [
        positive("message_rows", "message_rows"),
        ("book_rows", F.col("book_rows"), F.col("book_rows") == F.col("message_rows"), "message rows"),
        ("first_bin", F.col("first_bin"), F.col("first_bin").between(0, c.bins - 1), "in the grid"),
        ("last_bin", F.col("last_bin"), F.col("last_bin").between(0, c.bins - 1), "in the grid"),
        positive("event_bins", "event_bins"), equals("levels", "levels", c.levels),
        ("sample_spread_positive", F.col("spread_min"), (F.col("spread_min") > 0) | F.col("spread_min").isNull(), "> 0"), holds("sample_best_sizes_positive", "sizes_positive"),
    ]
    every = ev.agg(F.countDistinct("bin_idx").alias("bins"))
    return stacked(rows_of(a.join(b, "asset"), "01", per, _asset()), rows_of(every, "01", [("any_asset_event_bins", F.col("bins"), F.col("bins").between(1, c.bins), "1 to bins")]))


def features(feats: DataFrame, std: DataFrame, mids: DataFrame, targets: DataFrame, msg: DataFrame, c: Config = CONFIG) -> DataFrame:
    """Step 02: contract of grid and splits, per asset shape, bins, positive mid and spread, finite features; scaler and target audits."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    one = std.sparkSession.range(1).select(F.lit(c.bins).alias("bins"), F.lit(c.train_end + (c.val_end - c.train_end) + (c.bins - c.val_end)).alias("split_bins"), F.lit(4 * c.levels + 11).alias("width"))
    contract = [equals("time_bins", "bins", c.bins), equals("chronological_split", "split_bins", c.bins), equals("feature_dimension", "width", c.features)]
    f = feats.groupBy("asset").agg(F.count("*").alias("values"), F.bool_and(finite(F.col("x"))).alias("finite"), F.sum(F.when(F.col("f") == c.features - 1, F.col("x"))).alias("mask"))
    m = mids.groupBy("asset").agg(F.min("mid").alias("mid"), F.min("spread").alias("spread"))
    e = bins.clean(msg, c).groupBy("asset").agg(F.countDistinct("bin_idx").alias("event_bins"))
    per = [equals("values", "values", c.bins * c.features), ("event_bins", F.col("mask"), F.col("mask") == F.col("event_bins"), "bins with events"), positive("spread_positive", "spread"), positive("mid_positive", "mid"), holds("features_finite", "finite")]
    whole = feats.agg(F.count("*").alias("values"), F.bool_and(finite(F.col("x"))).alias("finite"))
    active = feats.filter((F.col("f") == c.features - 1) & (F.col("x") > 0)).agg(F.countDistinct("bin_idx").alias("bins"))
    s = std.agg(F.count("*").alias("values"), F.bool_and(finite(F.col("x"))).alias("finite"))
    by = std.filter(F.col("bin_idx") < c.train_end).groupBy("asset", "f").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    by = by.agg(F.max(F.abs("m")).alias("mean"), F.max(F.when(F.col("s") > 0.5, F.abs(F.col("s") - 1))).alias("std"))
    audit = [("train_mean_close_to_zero", F.round("mean", 6), F.col("mean") < 1e-4, "< 1e-4"), ("train_std_close_to_one", F.round("std", 6), F.coalesce(F.col("std"), F.lit(0.0)) < 1e-4, "< 1e-4")]
    tail = F.col("bin_idx") >= c.bins - F.col("tau")
    t = targets.groupBy("tau").agg(F.bool_and(finite(F.col("y")) | tail).alias("y"), F.bool_and(finite(F.col("z")) | tail).alias("z"), F.bool_and(~tail | (F.col("y").isNull() & F.col("z").isNull())).alias("tail"))
    n = c.bins * c.assets * c.features
    return stacked(
        rows_of(one, "02", contract), rows_of(f.join(m, "asset").join(e, "asset", "left"), "02", per, _asset()),
        rows_of(whole, "02", [equals("feature_values", "values", n), holds("features_all_finite", "finite")]),
        rows_of(active, "02", [("any_asset_event_bins", F.col("bins"), F.col("bins").between(1, c.bins), "1 to bins")]),
        rows_of(s, "02", [equals("standardized_values", "values", n), holds("standardized_all_finite", "finite")]), rows_of(by, "02", audit),
        rows_of(t, "02", [holds("logret_finite", "y"), holds("spread_return_finite", "z"), holds("tail_empty", "tail")], F.concat(F.lit("tau_"), F.col("tau").cast("string"), F.lit("_"))),
    )


def graphs(std: DataFrame, mask: DataFrame, targets: DataFrame, variants: DataFrame, c: Config = CONFIG) -> DataFrame:
    """Step 03, of its inputs and the 12 graphs: shapes, finite features, a binary mask, targets of every horizon, zero diagonals."""
    finite = ~F.isnan("x") & (F.abs("x") < float("inf"))
    x = std.agg(F.count("*").alias("values"), F.bool_and(finite).alias("finite"))
    m = mask.agg(F.count("*").alias("values"), F.bool_and(F.col("mask").isin(0, 1)).alias("binary"))
    t = targets.groupBy("tau").agg(F.count("*").alias("values"), F.count("y").alias("there"))
    g = variants.groupBy("graph").agg(F.count("*").alias("edges"), F.bool_and(~F.isnan("w") & (F.abs("w") < float("inf"))).alias("finite"), F.max(F.when(F.col("src") == F.col("dst"), F.abs("w"))).alias("diagonal"))
    return stacked(
        rows_of(x, "03", [equals("standardized_values", "values", c.bins * c.assets * c.features), holds("standardized_finite", "finite")]),
        rows_of(m, "03", [equals("mask_values", "values", c.bins * c.assets), holds("mask_binary", "binary")]),
        rows_of(t, "03", [positive("target_exists", "there"), equals("target_values", "values", c.bins * c.assets)], F.concat(F.lit("tau_"), F.col("tau").cast("string"), F.lit("_"))),
        rows_of(g, "03", [equals("edges", "edges", c.assets * c.assets), holds("finite", "finite"), ("diagonal_zero", F.round("diagonal", 7), F.col("diagonal") < 1e-7, "0")], F.concat(F.lit("graph_"), F.col("graph"), F.lit("_"))),
    )


def baselines(selected: DataFrame) -> DataFrame:
    """Step 03, of its results."""
    r = selected.agg(F.count("*").alias("n"), F.bool_and(~F.isnan("mse") & (F.abs("mse") < float("inf"))).alias("finite"), F.min("da").alias("low"), F.max("da").alias("high"))
    return rows_of(r, "03", [positive("results", "n"), holds("mse_finite", "finite"), ("da_range", F.col("high"), (F.col("low") >= 0) & (F.col("high") <= 1), "[0,1]")])


def robust(step: str, evaluated: DataFrame, least: float = -1e-14, share: float = 0.9, radius: tuple[str, float, float] | None = None, there: float | None = 0.75) -> DataFrame:
    """Steps 04, 04b and 05, of their rows: all metrics finite, accuracy in range, degradation mostly there and not negative.

    there: the share of rows with any degradation, if that is asked for;
    radius: a column, and the share of rows in which it must be over a number (that the attack uses its radius).
    """
    numbers = [n for n, kind in evaluated.dtypes if kind == "double"]
    fine = reduce(lambda a, b: a & b, (F.coalesce(~F.isnan(n) & (F.abs(n) < float("inf")), F.lit(False)) for n in numbers))
    deg = F.col("deg_mse_r010")
    mean = lambda x: F.avg(x.cast("double"))
    r = evaluated.agg(F.count("*").alias("n"), F.bool_and(fine).alias("finite"), F.min("clean_da").alias("low"), F.max("clean_da").alias("high"), mean(F.abs(deg) > 1e-14).alias("there"), mean(deg >= least).alias("up"), F.bool_or(F.col("rho") > 0).alias("robust"), (mean(F.col(radius[0]) > radius[1]) if radius else F.lit(1.0)).alias("radius"))
    checks = [positive("results", "n"), holds("metrics_finite", "finite"), ("clean_da_range", F.col("high"), (F.col("low") >= 0) & (F.col("high") <= 1), "[0,1]"), ("degradation_mostly_not_negative", F.col("up"), F.col("up") >= share, f">= {share:.0%}"), holds("has_robust_models", "robust")]
    if there is not None:
        checks.append(("degradation_there", F.col("there"), F.col("there") >= there, f">= {there:.0%}"))
    if radius:
        checks.append(("attack_uses_radius", F.col("radius"), F.col("radius") >= radius[2], f">= {radius[2]:.0%}"))
    return rows_of(r, step, checks)


def edges(step: str, g: DataFrame, c: Config = CONFIG) -> DataFrame:
    """Steps 04 to 05, of the graph they use: shape, zero diagonal, weights in [0, 1]."""
    r = g.agg(F.count("*").alias("n"), F.max(F.when(F.col("src") == F.col("dst"), F.abs("w"))).alias("diagonal"), F.min("w").alias("low"), F.max("w").alias("high"))
    return rows_of(r, step, [equals("graph_edges", "n", c.assets * c.assets), ("graph_diagonal_zero", F.col("diagonal"), F.col("diagonal") < 1e-8, "0"), ("graph_range", F.col("high"), (F.col("low") >= -1e-8) & (F.col("high") <= 1 + 1e-8), "[0,1]")])


def inputs(steps: list[str], std: DataFrame, targets: DataFrame, c: Config = CONFIG) -> DataFrame:
    """Steps 04 to 05, of what they are trained on: as many values as bins, assets and features, and targets of every horizon."""
    r = std.agg(F.count("*").alias("values")).join(targets.filter("y is not null").agg(F.countDistinct("tau").alias("taus")), F.lit(True))
    return stacked(*(rows_of(r, s, [equals("standardized_values", "values", c.bins * c.assets * c.features), equals("targets_available", "taus", len(c.taus))]) for s in steps))


def horizons(parts: dict[str, DataFrame], c: Config = CONFIG) -> DataFrame:
    """Step 06, of the results of earlier steps: each has every horizon."""
    return stacked(*(rows_of(rows.agg(F.countDistinct("tau").alias("taus")), "06", [equals(f"all_horizons_in_{step}", "taus", len(c.taus))]) for step, rows in parts.items()))


def final(table: DataFrame, earlier: DataFrame, c: Config = CONFIG) -> DataFrame:
    """Step 06: earlier steps passed, every horizon is there, gains of graph (all horizons) and feature (some) models."""
    r = table.agg(F.countDistinct("tau").alias("taus"), F.count("*").alias("n"), F.bool_and(F.col("graph_gain") > 0).alias("graph"), F.bool_or(F.col("feature_gain") > 0).alias("feature"))
    before = rows_of(statuses(earlier), "06", [("status_pass", (F.col("status") == "PASS"), F.col("status") == "PASS", "1")], F.concat(F.lit("step_"), F.col("step"), F.lit("_")))
    return stacked(before, rows_of(r, "06", [equals("all_horizons", "taus", len(c.taus)), equals("rows", "n", len(c.taus)), holds("graph_gain_at_all_horizons", "graph"), holds("feature_gain_at_some_horizon", "feature")]))
