"""The registered market queries: each operator over the whole events table."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CONFIG as C
from ..functions.lineage import shared_folder, stage
from ..operators import attacks, bins, book, evaluation, features, gates, graphs, models, summary, training
from ..operators.panel import moments as panel_moments
from ..operators.panel import panel
from ..operators.selection import best_of_tau, selection
from ..operators.selection import ridge_path as ridge_path_of
from ..sources import logs, zipped
from . import fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Models that SQL can follow too: the fixed parameters times a factor, under the radius and steps they stand for.
SHRUNK = [(0.0, 1, 1.0), (0.05, 1, 0.9), (0.05, 3, 0.8), (0.1, 1, 0.7), (0.1, 3, 0.6)]


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def _round(df: DataFrame, **digits: int) -> DataFrame:
    return df.select(*((F.round(c, digits[c]) + 0.0).alias(c) if c in digits else F.col(c) for c in df.columns))


class Market:
    """The pipeline's stages on one folder of tables, each built when asked for; those that many stages read are written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.msg = spark, fixture.messages(spark, sf_dir)
        self.theta = models.fixed_theta()

    @cached_property
    def book(self) -> DataFrame:
        return stage(book.binned_book(self.msg, fixture.book(self.msg, book.wanted_rows(self.msg))))

    @property
    def mids(self) -> DataFrame:
        return book.mid_spread(self.book)

    @property
    def flow(self) -> DataFrame:
        return features.flow(self.msg, self.mids)

    @cached_property
    def feats(self) -> DataFrame:
        return stage(features.features(self.msg, self.book))

    @cached_property
    def std(self) -> DataFrame:
        return stage(features.standardized(self.feats))

    def y(self, tau: int = 1) -> DataFrame:
        return features.targets(self.mids).filter(F.col("tau") == tau).select("asset", "bin_idx", "y")

    def base(self, *names: str) -> dict[str, DataFrame]:
        ret = stage(graphs.train_values(self.y().withColumnRenamed("y", "v")))
        out = {"return": graphs.correlation(ret, ret)}
        if names != ("return",):
            phi = stage(graphs.train_values(features.phi_bar(self.std).withColumnRenamed("phi", "v")))
            out |= {"ofi": graphs.correlation(phi, phi), "cross_ofi": graphs.correlation(phi, ret, guard=False)}
        return out

    def coactivity(self) -> DataFrame:
        return graphs.coactivity(self.flow)

    def variants(self) -> DataFrame:
        """12 graphs of assets x assets edges."""
        named = [g.select(F.lit(n).alias("name"), "src", "dst", "w") for n, g in self.base().items()]
        return stage(graphs.variants(stage(named[0].unionByName(named[1]).unionByName(named[2])), self.coactivity()))

    def graph(self) -> DataFrame:
        """The return_abs graph with rows summing to 1."""
        c = stage(self.base("return")["return"])
        g = c.join(graphs.transposed(c), ["src", "dst"]).select("src", "dst", F.abs((F.col("w") + F.col("back")) / 2).alias("w"))
        return stage(graphs.row_normalized(g))

    def matrix(self, g: DataFrame) -> np.ndarray:
        """assets x assets numbers on the driver."""
        out = np.zeros((C.assets, C.assets))
        for r in g.collect():
            out[r["src"], r["dst"]] = r["w"]
        return out

    def split(self, rows: DataFrame, name: str, tau: int = 1) -> DataFrame:
        a, b = C.split(name, tau)
        return rows.filter((F.col("bin_idx") >= a) & (F.col("bin_idx") < b))

    def scored(self, g: DataFrame, split: str = "test", tau: int = 1) -> DataFrame:
        """asset, bin_idx, s, p, pred, y, e with the fixed parameters."""
        rows = models.predicted(models.projections(self.split(self.std, split, tau), self.theta), g, float(self.theta[-1]))
        return stage(rows.join(self.y(tau), ["asset", "bin_idx"]).withColumn("e", F.col("pred") - F.col("y")))

    def design(self, g: DataFrame, split: str, tau: int = 1) -> DataFrame:
        std = self.split(self.std, split, tau)
        return models.design(std, graphs.neighbours(std, g), self.y(tau))

    @cached_property
    def panel(self) -> DataFrame:
        """One row a bin with all assets' features and targets."""
        return stage(panel(self.std, features.targets(self.mids)))

    def matrices(self) -> dict[str, np.ndarray]:
        """The unsigned graphs with rows summing to 1, on the driver: assets x assets numbers each."""
        out: dict[str, np.ndarray] = {}
        for r in graphs.row_normalized(self.variants()).filter("graph like '%abs%'").orderBy("graph").collect():
            out.setdefault(r["graph"], np.zeros((C.assets, C.assets)))[r["src"], r["dst"]] = r["w"]
        return out

    @cached_property
    def selected(self) -> DataFrame:
        return stage(selection(self.panel, self.matrices()))

    def symmetric(self) -> DataFrame:
        return graphs.row_normalized_symmetric(self.graph())

    @cached_property
    def feature_robust(self) -> DataFrame:
        g = self.matrix(self.graph())
        return stage(evaluation.evaluate_features(self.panel, training.train(self.panel, g, "feature"), g))

    @cached_property
    def raw_robust(self) -> DataFrame:
        g = self.matrix(self.graph())
        return stage(evaluation.evaluate_features(self.panel, training.train(self.panel, g, "raw"), g, evaluation.RAW_RHOS, steps=evaluation.RAW_STEPS, raw=True))

    @cached_property
    def graph_robust(self) -> DataFrame:
        g = self.matrix(self.symmetric())
        return stage(evaluation.evaluate_graphs(self.panel, training.train(self.panel, g, "graph"), g))

    def shrunk(self, kind: str) -> DataFrame:
        """tau, rho, r_adv, clean_mse, deg_mse, sensitivity of the shrunk models, attacked by seven steps of radius 0.1."""
        cells = [training.Cell(i, tau, rho, steps, 0, best=0.0, kept=self.theta * k) for i, (tau, (rho, steps, k)) in enumerate((t, s) for t in C.taus for s in SHRUNK)]
        evaluate, g = (evaluation.evaluate_features, self.graph()) if kind == "feature" else (evaluation.evaluate_graphs, self.symmetric())
        return stage(evaluate(self.panel, cells, self.matrix(g), (0.1,)).select("tau", "rho", "r_adv", "clean_mse", F.col("deg_mse_r010").alias("deg_mse"), "sensitivity"))

    def shrunk_ablation(self) -> DataFrame:
        r = self.shrunk("feature")
        base = summary.best_by(r, ["tau"], "clean_mse", "rho", "r_adv").select("tau", F.col("clean_mse").alias("best_clean_mse"))
        return summary.ablation(base, summary.robust_vs_plain(r), summary.robust_vs_plain(self.shrunk("graph")))

    def final(self) -> DataFrame:
        """Selected, feature-robust and graph-robust models side by side per horizon."""
        best = best_of_tau(self.selected).select("tau", F.col("model").alias("best_model"), F.col("graph").alias("best_graph"), F.col("mse").alias("best_clean_mse"), F.col("da").alias("best_da"))
        robust = [summary.robust_vs_plain(x.withColumn("deg_mse", F.col("deg_mse_r010"))) for x in (self.feature_robust, self.graph_robust)]
        return summary.ablation(best, *robust)


@query
def flagship(spark, sf_dir):
    m = Market(spark, sf_dir)
    keys = ["asset", "bin_idx"]
    x = bins.carry_forward(m.msg).join(m.mids, keys).join(book.ofi(m.book.filter("h = 1")).drop("h", "ofi_dollar"), keys).join(m.y(), keys)
    return x.select(*keys, "last_row", F.round("mid", 6).alias("mid"), (F.round("ofi_share", 6) + 0.0).alias("ofi_share_h1"), (F.round(F.col("y") * 10000, 6) + 0.0).alias("ret_bps"))


@query
def clean_messages(spark, sf_dir):
    return bins.clean(fixture.messages(spark, sf_dir))


@query
def event_type_counts(spark, sf_dir):
    return fixture.messages(spark, sf_dir).groupBy("asset", "event_type").agg(F.count("*").alias("n"))


@query
def family_volume(spark, sf_dir):
    return fixture.messages(spark, sf_dir).groupBy(bins.family().alias("event_family")).agg(F.count("*").alias("n"), F.sum("size").alias("volume"))


@query
def bin_event_summary(spark, sf_dir):
    return bins.bin_event_summary(fixture.messages(spark, sf_dir))


@query
def event_bins(spark, sf_dir):
    return bins.clean(fixture.messages(spark, sf_dir)).groupBy("asset").agg(F.countDistinct("bin_idx").alias("bins"))


@query
def any_asset_bins(spark, sf_dir):
    return bins.clean(fixture.messages(spark, sf_dir)).agg(F.countDistinct("bin_idx").alias("bins"))


@query
def duplicate_rows(spark, sf_dir):
    return fixture.messages(spark, sf_dir).groupBy("row_idx").agg(F.count("*").alias("n")).filter("n > 1")


@query
def book_sample_audit(spark, sf_dir):
    x = fixture.levels(fixture.messages(spark, sf_dir).filter("row_idx < 500").select("row_idx", "k")).filter("h = 1")
    a, b = F.col("ask_p") / 10000, F.col("bid_p") / 10000
    return x.agg(F.count("*").alias("sample_rows"), F.round(F.min(a), 6).alias("ask1_min"), F.round(F.min(b), 6).alias("bid1_min"), F.round(F.min(a - b), 6).alias("spread_min"), F.round(F.median(a - b), 6).alias("spread_median"), F.bool_and((F.col("ask_q") > 0) & (F.col("bid_q") > 0)).alias("sizes_positive"))


@query
def last_row_per_bin(spark, sf_dir):
    return bins.last_row_per_bin(fixture.messages(spark, sf_dir))


@query
def carry_forward_grid(spark, sf_dir):
    return bins.carry_forward(fixture.messages(spark, sf_dir))


@query
def selected_book_rows(spark, sf_dir):
    msg = fixture.messages(spark, sf_dir)
    return fixture.book(msg, book.wanted_rows(msg))


@query
def message_book_counts(spark, sf_dir):
    """Messages and book rows of each asset; raises where they differ."""
    msg = fixture.messages(spark, sf_dir)
    named = msg.withColumn("ticker", F.concat(F.lit("A"), F.col("asset").cast("string")))
    return logs.counts_match(named, fixture.book(msg).filter("h = 1").join(named.select("row_idx", "ticker"), "row_idx"))


@query
def zipped_messages(spark, sf_dir):
    """The events written as zipped logs and read back by restart points: some columns, and hours 100 to 300 by time."""
    folder, _ = fixture.zips(spark, sf_dir)
    index = shared_folder(spark)
    stage(zipped.restart_points(spark, folder, fixture.TICKERS, span=1 << 20), index)
    msg = zipped.reader(spark, folder, fixture.TICKERS, index=index).load("ticker", "row_idx", "time", "size", "price")
    return _round(msg.filter((F.col("time") >= 360_000.0) & (F.col("time") < 1_080_000.0)), time=3)


@query
def zipped_selected_book(spark, sf_dir):
    """The last row of each ticker and bin, read from the zipped books; other rows aren't parsed."""
    folder, msg = fixture.zips(spark, sf_dir)
    wanted = msg.filter(F.col("bin_idx").between(0, C.bins - 1)).groupBy("ticker", "bin_idx").agg(F.max("row_idx").alias("row_idx"))
    return zipped.selected_book(spark, folder, wanted, fixture.TICKERS)


@query
def zipped_line_counts(spark, sf_dir):
    folder, _ = fixture.zips(spark, sf_dir)
    return zipped.line_counts(stage(zipped.restart_points(spark, folder, fixture.TICKERS)))


@query
def ticker_stats(spark, sf_dir):
    """Statistics in a fixed order of tickers; a ticker without any has zeros."""
    msg = fixture.messages(spark, sf_dir)
    tickers = spark.range(C.assets).select(F.col("id").cast("int").alias("asset"), (F.col("id") + 1).alias("ord"), F.concat(F.lit("A"), F.col("id").cast("string")).alias("ticker"))
    per = msg.groupBy("asset").agg(F.count("*").alias("message_rows"))
    events = bins.clean(msg).groupBy("asset").agg(F.countDistinct("bin_idx").alias("event_bins"))
    return tickers.join(per, "asset", "left").join(events, "asset", "left").na.fill(0).drop("asset")


@query
def binned_book(spark, sf_dir):
    return book.assert_best(Market(spark, sf_dir).book).drop("valid")


@query
def level_validity(spark, sf_dir):
    by = book.Window.partitionBy("asset", "h").orderBy("bin_idx")
    return Market(spark, sf_dir).book.select("asset", "bin_idx", "h", "valid", F.coalesce(F.col("valid") & F.lag("valid").over(by), F.lit(False)).alias("pair_valid"))


@query
def mid_spread_wmid(spark, sf_dir):
    return _round(Market(spark, sf_dir).mids, mid=6, spread=6, weighted_mid=6)


def _book_query(name: str, function: Callable, digits: int) -> None:
    QUERIES[name] = lambda spark, sf_dir: _round(function(Market(spark, sf_dir).book).select("asset", "bin_idx", "h", name), **{name: digits})


for _name, _function, _digits in (("ofi_share", book.ofi, 6), ("ofi_dollar", book.ofi, 4), ("obi_share", book.obi, 6), ("obi_dollar", book.obi, 6)):
    _book_query(_name, _function, _digits)


def _flow_query(name: str, digits: dict[str, int]) -> None:
    QUERIES[name] = lambda spark, sf_dir: _round(Market(spark, sf_dir).flow.select("asset", "bin_idx", *digits), **digits)


for _name, _k in (("flow_submission", "sub"), ("flow_cancellation", "can"), ("flow_execution", "exe")):
    _flow_query(_name, {f"size_{_k}": 4, f"dp_{_k}": 6, f"q_{_k}": 4})
_flow_query("traded_value", {"traded": 3})


@query
def event_mask(spark, sf_dir):
    return Market(spark, sf_dir).flow.select("asset", "bin_idx", "mask")


@query
def asset_feature_summary(spark, sf_dir):
    m = Market(spark, sf_dir)
    b = m.book
    s = m.mids.groupBy("asset").agg(*(F.round(f(v), 6).alias(n) for n, f, v in (("min_spread", F.min, "spread"), ("median_spread", F.median, "spread"), ("max_spread", F.max, "spread"), ("min_mid", F.min, "mid"), ("max_mid", F.max, "mid"))))
    moved = " or ".join(f"{x} <> 0" for x in ("size_exe", "traded", *(f"{v}_{k}" for v in ("dp", "q") for k in ("sub", "can", "exe"))))
    s = s.join(m.flow.groupBy("asset").agg(F.count_if(F.expr(moved)).alias("flow_bins")), "asset")
    return s.join(b.groupBy("asset").agg(F.count_if(~F.col("valid")).alias("invalid_cells")), "asset").join(book.ofi(b).groupBy("asset").agg(F.count_if(F.col("ofi_share") != 0).alias("nonzero_ofi")), "asset")


@query
def targets_logret(spark, sf_dir):
    return features.targets(Market(spark, sf_dir).mids).select("asset", "bin_idx", "tau", (F.round(F.col("y") * 10000, 6) + 0.0).alias("y_bps"))


@query
def targets_spread(spark, sf_dir):
    return _round(features.targets(Market(spark, sf_dir).mids).select("asset", "bin_idx", "tau", "z"), z=6)


@query
def purged_splits(spark, sf_dir):
    x = spark.range(C.bins).select(F.col("id").alias("bin_idx"), F.explode(F.array(*map(F.lit, C.taus))).alias("tau"))
    return x.withColumn("split", features.split_name(F.col("tau"))).filter("split is not null").groupBy("tau", "split").agg(F.count("*").alias("bins"))


@query
def feature_matrix(spark, sf_dir):
    return _round(Market(spark, sf_dir).feats, x=4)


@query
def scaler(spark, sf_dir):
    return _round(features.scaler(Market(spark, sf_dir).feats), mu=5, sigma=5, sigma_safe=5)


@query
def standardized(spark, sf_dir):
    return _round(Market(spark, sf_dir).std, x=5)


@query
def standardize_audit(spark, sf_dir):
    s = Market(spark, sf_dir).std.filter(F.col("bin_idx") < C.train_end).groupBy("asset", "f").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return s.agg(F.round(F.max(F.abs("m")), 6).alias("max_abs_mean"), F.round(F.max(F.when(F.col("s") > 0.5, F.abs(F.col("s") - 1))), 6).alias("max_abs_std_error"))


@query
def target_audit(spark, sf_dir):
    return features.targets(Market(spark, sf_dir).mids).groupBy("tau").agg(F.round(F.max(F.abs("y")) * 10000, 6).alias("max_abs_bps"), F.count("y").alias("samples"))


@query
def phi_bar(spark, sf_dir):
    return _round(features.phi_bar(Market(spark, sf_dir).std), phi=6)


for _name, _k in (("corr_return", "return"), ("corr_ofi", "ofi"), ("corr_cross_ofi", "cross_ofi")):
    QUERIES[_name] = lambda spark, sf_dir, k=_k: _round(Market(spark, sf_dir).base()[k], w=8)


@query
def coactivity(spark, sf_dir):
    return _round(Market(spark, sf_dir).coactivity(), w=8)


@query
def graph_variants(spark, sf_dir):
    return _round(Market(spark, sf_dir).variants(), w=8)


@query
def graph_summary(spark, sf_dir):
    return Market(spark, sf_dir).variants().groupBy("graph").agg(F.round(F.min("w"), 8).alias("min_w"), F.round(F.max("w"), 8).alias("max_w"), F.round(F.avg(F.abs("w")), 8).alias("mean_abs"), F.count_if(F.abs("w") > 1e-10).alias("edges"))


@query
def graph_rownorm(spark, sf_dir):
    return _round(graphs.row_normalized(Market(spark, sf_dir).variants()), w=8)


@query
def graph_rownorm_sym(spark, sf_dir):
    return _round(graphs.row_normalized_symmetric(Market(spark, sf_dir).variants()), w=8)


@query
def neighbor_features(spark, sf_dir):
    m = Market(spark, sf_dir)
    return _round(graphs.neighbours(m.std, m.graph()), x=5)


@query
def graph_design(spark, sf_dir):
    m = Market(spark, sf_dir)
    std = m.std.filter(F.col("bin_idx") >= C.val_end)
    near = graphs.neighbours(std, m.graph()).withColumn("f", F.col("f") + C.features)
    return std.unionByName(near).select("asset", "bin_idx", F.col("f").alias("k"), (F.round("x", 5) + 0.0).alias("d"))


@query
def gram_matrix(spark, sf_dir):
    m = Market(spark, sf_dir)
    return _round(models.gram(m.design(m.graph(), "test")), v=3)


@query
def metrics_fixed_theta(spark, sf_dir):
    m = Market(spark, sf_dir)
    return _round(models.metrics(m.scored(m.graph())), mse=8, mae=8, da=8, sharpe=5)


@query
def legacy_predict_metrics(spark, sf_dir):
    m = Market(spark, sf_dir)
    std = m.split(m.std, "test")
    rows = models.legacy_predicted(std, graphs.neighbours(std, m.graph()), m.theta).join(m.y(), ["asset", "bin_idx"])
    return _round(models.metrics(rows), mse=8, mae=8, da=8, sharpe=5)


@query
def grad_theta_fixed(spark, sf_dir):
    m = Market(spark, sf_dir)
    g = m.graph()
    return _round(models.grad_theta(m.split(m.std, "test"), m.scored(g).select("asset", "bin_idx", "e"), g, m.theta, 1e-4), g=8)


@query
def grad_x_norm_fixed(spark, sf_dir):
    m = Market(spark, sf_dir)
    g = m.graph()
    x = attacks.feature_gradient(m.scored(g).select("asset", "bin_idx", "e"), g, m.theta)
    return x.groupBy("bin_idx").agg(F.round(F.sqrt(F.sum("norm2")) * 1000, 8).alias("norm"))


@query
def grad_g_fixed(spark, sf_dir):
    m = Market(spark, sf_dir)
    return _round(attacks.graph_gradient(m.scored(m.graph())), g=8)


@query
def feature_attack_1step(spark, sf_dir):
    m = Market(spark, sf_dir)
    g = m.graph()
    x = attacks.feature_gradient(m.scored(g).select("asset", "bin_idx", "e"), g, m.theta)
    return _round(attacks.feature_step(x, 0.1, 1), a=5, b=5, norm2=8)


def _gradient(m: Market) -> DataFrame:
    g = m.graph()
    return attacks.feature_gradient(m.scored(g).select("asset", "bin_idx", "e"), g, m.theta)


@query
def project_feature_ball(spark, sf_dir):
    """The gradients, made large, back into the ball of radius 0.05."""
    x = _gradient(Market(spark, sf_dir)).select("asset", "bin_idx", (F.col("a") * 1000).alias("a"), (F.col("b") * 1000).alias("b"), (F.col("norm2") * 1e6).alias("norm2"))
    return _round(attacks.project_features(x, 0.05), a=5, b=5, norm2=8)


@query
def raw_attack_1step(spark, sf_dir):
    """First of five steps of the older attack."""
    x = attacks.raw_feature_step(_gradient(Market(spark, sf_dir)), 0.1, 5)
    return x.select("asset", "bin_idx", *((F.round(F.col(n) * k, 6) + 0.0).alias(n) for n, k in (("a", 1e4), ("b", 1e4), ("norm2", 1e8))))


@query
def graph_attack_1step(spark, sf_dir):
    m = Market(spark, sf_dir)
    return _round(attacks.graph_step(attacks.graph_gradient(m.scored(m.graph())), stage(m.symmetric()), 0.1, 7), d=8)


def _degraded(m: Market, rows: DataFrame, matrix: np.ndarray, rhos: tuple[float, ...], steps: int, raw: bool = False) -> DataFrame:
    """rho, clean, mse of the fixed model attacked on its features; rows: a test split as one batch, of one row a bin and asset."""
    x = attacks.attacked(attacks.packed(rows, "s", "p", "y"), matrix, m.theta, rhos, steps, rows.count(), raw=raw)
    return x.groupBy("rho").agg(*(F.avg(F.pow(F.col(c) - F.col("y"), 2)).alias(n) for c, n in (("clean", "clean"), ("pred", "mse"))))


@query
def raw_attack_curve(spark, sf_dir):
    """Degradation of the fixed model by the older attack of five steps, by radius."""
    m = Market(spark, sf_dir)
    g = m.graph()
    x = _degraded(m, m.scored(g), m.matrix(g), (0.05, 0.1), 5, raw=True)
    return x.select("rho", *(F.round(v * k, d).alias(n) for n, v, k, d in (("clean_mse_ppm", F.col("clean"), 1e6, 4), ("mse_ppm", F.col("mse"), 1e6, 4), ("deg_mse_e12", F.col("mse") - F.col("clean"), 1e12, 3))))


@query
def ridge_solved(spark, sf_dir):
    """Ridge of penalty 0.01 from the test split's moments; the intercept is free."""
    m = Market(spark, sf_dir)
    theta = models.ridge(models.gram_matrix(m.design(m.graph(), "test")), 1e-2, np.arange(2 * C.features + 1))
    return spark.createDataFrame([(k, round(float(v) * 1e4, 5) + 0.0) for k, v in enumerate(theta)], "k int, theta_bps double")


@query
def ridge_path(spark, sf_dir):
    """Ridge on the return_abs graph for the next bin: the validation error of every penalty, and which one is chosen."""
    m = Market(spark, sf_dir)
    path = ridge_path_of(panel_moments(m.panel), m.matrix(m.graph()), 1, np.arange(2 * C.features + 1), free=False)
    best = min(range(len(path)), key=lambda i: path[i][1])
    return spark.createDataFrame([(a, round(e * 1e8, 4), i == best) for i, (a, e, _) in enumerate(path)], "alpha double, val_mse_e8 double, chosen boolean")


@query
def sensitivity_fixed(spark, sf_dir):
    m = Market(spark, sf_dir)
    g = m.graph()
    x = attacks.feature_gradient(m.scored(g).select("asset", "bin_idx", "e"), g, m.theta).groupBy("bin_idx").agg(F.sqrt(F.sum("norm2")).alias("norm"))
    first, end = C.split("test", 1)
    batches = F.broadcast(spark.createDataFrame([(i, first + (end - first - 32) * i // 7) for i in range(8)], "i int, s long"))
    per = x.join(batches, (F.col("bin_idx") >= F.col("s")) & (F.col("bin_idx") < F.col("s") + 32)).groupBy("i").agg(F.avg("norm").alias("n"))
    return per.agg(F.round(F.avg("n") * 1000, 6).alias("sensitivity"))


def _ppm(df: DataFrame) -> DataFrame:
    """All doubles times a million, to four digits."""
    return df.select(*((F.round(F.col(n) * 1e6, 4) + 0.0).alias(f"{n}_ppm") if kind == "double" and n != "rho" else F.col(n) for n, kind in df.dtypes))


@query
def best_by_tau(spark, sf_dir):
    """Of the shrunk models the best per horizon by their error on the test split."""
    return _ppm(summary.best_by(Market(spark, sf_dir).shrunk("feature"), ["tau"], "clean_mse", "rho", "r_adv").select("tau", "rho", "r_adv", "clean_mse"))


@query
def robust_vs_erm(spark, sf_dir):
    return _ppm(summary.robust_vs_plain(Market(spark, sf_dir).shrunk("feature")))


@query
def ablation_join(spark, sf_dir):
    """Three summaries of the shrunk models side by side: clean, under attack on features, under attack on the graph."""
    return _ppm(Market(spark, sf_dir).shrunk_ablation())


@query
def verdict(spark, sf_dir):
    """Which kind of robustness pays among the shrunk models."""
    return _ppm(summary.verdicts(Market(spark, sf_dir).shrunk_ablation()))


@query
def checks(spark, sf_dir):
    """The gates of raw data, features and graphs."""
    m = Market(spark, sf_dir)
    targets = stage(features.targets(m.mids))
    return gates.stacked(gates.raw(m.msg, fixture.book(m.msg)), gates.features(m.feats, m.std, m.mids, targets, m.msg), gates.graphs(m.std, m.flow, targets, m.variants()))


@query
def checks_trained(spark, sf_dir):
    """The gates of selected and trained models, and of the summary."""
    m = Market(spark, sf_dir)
    g = stage(m.graph())
    older = gates.stacked(
        gates.baselines(m.selected), gates.inputs(["04", "04b", "05"], m.std, features.targets(m.mids)),
        gates.edges("04", g), gates.robust("04", m.raw_robust, least=-1e-12, there=None),
        gates.edges("04b", g), gates.robust("04b", m.feature_robust),
        gates.edges("05", stage(m.symmetric())), gates.robust("05", m.graph_robust, share=0.8, radius=("delta_fro_r010", 0.09, 0.75)),
    )
    older = stage(older)
    return gates.stacked(older, gates.horizons({"03": m.selected, "04b": m.feature_robust, "05": m.graph_robust}), gates.final(m.final(), older))


@query
def check_statuses(spark, sf_dir):
    """One row a step."""
    return gates.statuses(checks(spark, sf_dir))


@query
def selected_models(spark, sf_dir):
    """Own ridge, own lasso and ridge on six graphs for every horizon: 32 rows with test metrics."""
    return Market(spark, sf_dir).selected


@query
def best_models(spark, sf_dir):
    return best_of_tau(Market(spark, sf_dir).selected)


@query
def feature_robust(spark, sf_dir):
    """28 models trained against attacks on features, evaluated clean and attacked."""
    return Market(spark, sf_dir).feature_robust


@query
def raw_robust(spark, sf_dir):
    """28 models trained against the older attack on features, along the gradient as it is, and judged by five steps of it."""
    return Market(spark, sf_dir).raw_robust


@query
def graph_robust(spark, sf_dir):
    """28 models trained against attacks on the graph, evaluated clean and attacked."""
    return Market(spark, sf_dir).graph_robust


@query
def robustness_verdict(spark, sf_dir):
    """The summary of all trained models per horizon."""
    table = Market(spark, sf_dir).final()
    return table.join(summary.verdicts(table), "tau")


@query
def attack_curve(spark, sf_dir):
    """Degradation of the fixed model by seven steps on features and on the graph, by radius."""
    m = Market(spark, sf_dir)
    g = m.graph()
    matrix, rows, rhos = m.matrix(g), m.scored(g), (0.01, 0.05, 0.1, 0.2)
    by_feature = _degraded(m, rows, matrix, rhos, 7).select("rho", F.lit("feature").alias("kind"), (F.col("mse") - F.col("clean")).alias("deg"))
    loss = attacks.graph_loss(rows, float(m.theta[-1]))
    clean = loss.mse(matrix)
    by_graph = spark.createDataFrame([(r, "graph", loss.mse(matrix + loss.attack(matrix, r, 7)) - clean) for r in rhos], "rho double, kind string, deg double")
    return by_feature.unionByName(by_graph).select("rho", "kind", F.round(F.col("deg") * 1e6, 4).alias("deg_mse_ppm"))
