"""Hand-made fixtures with known answers, and the registered queries against their SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.config import CONFIG as C
from tickloom.config import Config
from tickloom.operators import attacks, bins, book, evaluation, features, gates, graphs, models, selection, summary, training
from tickloom.operators import panel as panels
from tickloom.plans.market import QUERIES
from tickloom.plans.market_sql import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["flagship", "bin_event_summary", "carry_forward_grid", "ofi_dollar", "obi_share", "flow_execution", "purged_splits", "scaler", "graph_rownorm_sym", "metrics_fixed_theta", "robust_vs_erm", "checks", "ablation_join", "verdict", "graph_attack_1step", "raw_attack_1step", "ticker_stats"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda x: sorted(tuple("" if v is None else f"{v:.5g}" if isinstance(v, float) else str(v) for v in r) for r in x)
    assert rows(tuple(r) for r in got.select(*want.columns).collect()) == rows(want.fetchall())


def test_ofi_signs_of_both_sides(spark):
    # bid up, equal, down; then ask down, equal, up; then an invalid level
    rows = [(0, 10, 5, 8, 4), (1, 10, 5, 9, 6), (2, 10, 5, 9, 9), (3, 10, 5, 7, 2), (4, 9, 7, 7, 2), (5, 9, 4, 7, 2), (6, 12, 3, 7, 2)]
    df = spark.createDataFrame([(0, b, 1, ap, aq, bp, bq, True) for b, ap, aq, bp, bq in rows] + [(0, 7, 1, 12, 3, 7, 2, False), (0, 8, 1, 12, 3, 7, 2, True)], "asset int, bin_idx long, h int, ask_p long, ask_q long, bid_p long, bid_q long, valid boolean")
    got = [r["ofi_share"] for r in book.ofi(df).orderBy("bin_idx").collect()]
    # ask unchanged adds 0; bid up +6, equal +3, down -9; ask down +7, equal 7 - 4, up -4
    assert got == [0, 6, 3, -9, 7, 3, -4, 0, 0]


def test_constant_feature_is_standardised_by_one(spark):
    df = spark.createDataFrame([(0, b, 0, 3.0) for b in range(4)], "asset int, bin_idx long, f int, x double")
    assert [r["x"] for r in features.standardized(df).collect()] == [0.0] * 4


def test_crossed_best_level_raises(spark):
    df = spark.createDataFrame([(1, False)], "h int, valid boolean")
    with pytest.raises(Exception, match="invalid best level"):
        book.assert_best(df).collect()


def test_absolute_graph_is_taken_after_averaging(spark):
    base = spark.createDataFrame([("x", 0, 1, 0.5), ("x", 1, 0, -0.5)], "name string, src int, dst int, w double")
    co = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "src int, dst int, w double")
    assert {r["w"] for r in graphs.variants(base, co).collect()} == {0.0}


def test_zero_prediction_is_a_miss(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0), (0, 0.0, 1.0), (1, 2.0, 1.0)], "bin_idx long, y double, pred double")
    assert models.metrics(df).first()["da"] == 0.5


def test_ridge_and_lasso_from_moments():
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.standard_normal((200, 4)), np.ones(200)])
    y = x @ np.array([1, 0, -2, 0.5, 3]) + 0.01 * rng.standard_normal(200)
    a = np.column_stack([x, y])
    m, cols = a.T @ a, np.arange(5)
    want = np.linalg.solve(x.T @ x + np.diag([0.1] * 4 + [0]), x.T @ y)
    assert np.allclose(models.ridge(m, 0.1, cols), want)
    theta = models.lassos([m], (0.05,), cols)[0][0]
    grad = x[:, :4].T @ (x @ theta - y) / 200
    assert np.all(np.abs(grad) <= 0.05 + 1e-6) and np.allclose(np.abs(grad[np.abs(theta[:4]) > 0]), 0.05, atol=1e-5)
    assert np.isclose(models.mse_of(m, theta), np.mean((x @ theta - y) ** 2))


def test_lasso_paths_meet_the_conditions():
    rng = np.random.default_rng(8)
    alphas, problems = (1e-4, 1e-1, 1e-2, 1e4, 1e-3), []
    for n in (60, 200):
        x = rng.standard_normal((n, 12)) @ rng.standard_normal((12, 12))
        # a constant column, a repeated one and its opposite
        x[:, 3], x[:, 5], x[:, 6] = 0, x[:, 4], -x[:, 4]
        y = x[:, 0] - 2 * x[:, 7] + rng.standard_normal(n)
        problems.append((x.T @ x / n, x.T @ y / n))
    for a, b in problems:
        w = models.lasso_path(a, b, alphas)
        for v, alpha in zip(w, alphas, strict=True):
            grad, on = b - a @ v, v != 0
            assert (np.abs(grad) <= alpha + 1e-9).all() and np.allclose(grad[on], alpha * np.sign(v[on]), atol=1e-9)
        assert (w[:, 3] == 0).all() and (w[3] == 0).all() and (w[0] != 0).sum() > 2


def test_feature_attack_equals_the_direct_one():
    rng = np.random.default_rng(2)
    x, y, theta = rng.standard_normal((6, 5, C.features)), rng.standard_normal((6, 5)), rng.standard_normal(103) / 10
    g = np.abs(rng.standard_normal((5, 5)))
    w0, w1 = theta[: C.features], theta[C.features : -1]
    u = np.zeros_like(x)
    for _ in range(4):
        p = (x + u) @ w0 + np.einsum("ij,tj->ti", g, (x + u) @ w1) + theta[-1]
        c = 2 * (p - y) / y.size
        d = c[..., None] * w0 + (c @ g)[..., None] * w1
        u = u + 0.1 / 4 * d / np.linalg.norm(d.reshape(6, -1), axis=1)[:, None, None]
        u *= np.minimum(1, 0.1 / np.sqrt(5) / np.linalg.norm(u, axis=2))[..., None]
        u *= np.minimum(1, 0.1 / np.linalg.norm(u.reshape(6, -1), axis=1))[:, None, None]
    a, b = attacks.feature_attack(x @ w0, x @ w1, y, g, theta, 0.1, 4, y.size)
    assert np.allclose(a[..., None] * w0 + b[..., None] * w1, u, atol=1e-9)


def test_graph_projection_stays_in_the_ball():
    g = np.full((5, 5), 0.2)
    np.fill_diagonal(g, 0)
    d = attacks.project_graph(np.random.default_rng(0).standard_normal((5, 5)), g, 0.1)
    assert np.linalg.norm(d) <= 0.1 + 1e-9 and np.allclose(np.diag(g + d), 0) and ((g + d) >= 0).all() and np.allclose(d, d.T)


@pytest.fixture(scope="module")
def market(spark):
    """A panel whose targets follow a known model, and its arrays."""
    rng, c = np.random.default_rng(3), C
    x, g = rng.standard_normal((c.bins, c.assets, c.features)), np.eye(5)[::-1] * 0.5
    np.fill_diagonal(g, 0)
    theta = rng.standard_normal(2 * c.features + 1) / 10
    y = x @ theta[: c.features] + (x @ theta[c.features : -1]) @ g.T + theta[-1] + 0.01 * rng.standard_normal((c.bins, c.assets))
    std = spark.createDataFrame([(i, b, f, float(x[b, i, f])) for b in range(c.bins) for i in range(c.assets) for f in range(c.features)], "asset int, bin_idx long, f int, x double")
    targets = spark.createDataFrame([(i, b, t, float(y[b, i]) if b < c.bins - t else None) for b in range(c.bins) for i in range(c.assets) for t in c.taus], "asset int, bin_idx long, tau int, y double")
    return panels.panel(std, targets).cache(), x, y, g, theta


def test_pooled_moments_equal_the_direct_ones(market):
    rows, x, y, g, _ = market
    m = panels.moments(rows)
    for split, tau in (("train", 1), ("test", 20)):
        at = slice(*C.split(split, tau))
        d = np.concatenate([x[at], np.einsum("ij,tjd->tid", g, x[at]), np.ones((*x[at].shape[:2], 1)), y[at][..., None]], 2).reshape(-1, 104)
        assert np.allclose(panels.pooled(m[split, tau], g), d.T @ d)


def test_training_learns_and_evaluation_equals_the_direct_one(market):
    rows, x, y, g, theta = market
    assert len(training.grid()) == 28
    cells = [(1, 0.0, 1), (2, 0.1, 3)]
    for kind, evaluate in (("feature", evaluation.evaluate_features), ("graph", evaluation.evaluate_graphs)):
        done = training.train(rows, g, kind, 2, 11, cells)
        got = {r["tau"]: r for r in evaluate(rows, done, g).collect()}
        for cell in done:
            at = slice(*C.split("test", cell.tau))
            pred = x[at] @ cell.kept[: C.features] + (x[at] @ cell.kept[C.features : -1]) @ g.T + cell.kept[-1]
            assert np.isclose(got[cell.tau]["clean_mse"], np.mean((pred - y[at]) ** 2)) and got[cell.tau]["clean_mse"] < 0.1 * y.var()
            assert np.isclose(got[cell.tau]["clean_da"], np.mean(np.sign(pred) == np.sign(y[at])))
            assert got[cell.tau]["deg_mse_r010"] > 0 and got[cell.tau]["sensitivity"] > 0
            if kind == "graph":
                assert got[cell.tau]["delta_fro_r010"] <= 0.1 + 1e-9
        fine = {r["name"]: r["status"] for r in gates.robust("05", evaluate(rows, done, g)).collect()}
        assert set(fine.values()) == {"PASS"}


def _trained_directly(x, y, g, kind, epochs, seed, cells, size):
    """The plain loop over all bins: ridge start, attacked batches, the best epoch by validation error."""
    d, out = C.features, []
    design = lambda x, g: np.concatenate([x, np.einsum("ij,tjd->tid", g, x), np.ones((*x.shape[:2], 1))], 2)
    for tau, rho, steps in cells:
        train, val = (np.arange(*C.split(s, tau)) for s in ("train", "val"))
        a, b = design(x[train], g).reshape(-1, 103), y[train].ravel()
        theta = np.linalg.solve(a.T @ a + np.diag([1e-2] * 102 + [0]), a.T @ b)
        cell = training.Cell(0, tau, rho, steps, seed + tau + int(1000 * rho) + steps)
        best, kept = np.inf, None
        for epoch in range(epochs):
            batch = training.batch_of(train, cell, epoch, size)
            assert sorted(np.bincount(batch)) == sorted([size] * (len(train) // size) + [len(train) % size] * (len(train) % size > 0))
            for k in range(batch.max() + 1):
                xb, yb, around = x[train[batch == k]], y[train[batch == k]], g
                w0, w1 = theta[:d], theta[d:-1]
                if kind == "graph" and rho:
                    e, p = xb @ w0 + theta[-1] - yb, xb @ w1
                    around = g + attacks.GraphLoss(e.T @ p, p.T @ p, (e * e).sum(), e.size).attack(g, rho, steps)
                elif rho:
                    u = np.zeros_like(xb)
                    for _ in range(steps):
                        e = (2 / yb.size) * ((xb + u) @ w0 + ((xb + u) @ w1) @ g.T + theta[-1] - yb)
                        grad = e[..., None] * w0 + (e @ g)[..., None] * w1
                        u = u + (1.25 * rho / steps * grad if kind == "raw" else rho / steps * grad / (np.linalg.norm(grad.reshape(len(grad), -1), axis=1)[:, None, None] + 1e-12))
                        u *= np.minimum(1, rho / np.sqrt(5) / (np.linalg.norm(u, axis=2) + 1e-12))[..., None]
                        u *= np.minimum(1, rho / (np.linalg.norm(u.reshape(len(u), -1), axis=1) + 1e-12))[:, None, None]
                    xb = xb + u
                z = design(xb, around).reshape(-1, 103)
                grad = 2 / yb.size * z.T @ (z @ theta - yb.ravel()) + 2e-4 * np.append(theta[:-1], 0)
                theta = theta - 0.03 * grad / max(1, np.linalg.norm(grad))
            error = np.mean((design(x[val], g) @ theta - y[val]) ** 2)
            if error < best:
                best, kept = error, theta
        out.append((best, kept))
    return out


@pytest.mark.parametrize("kind", ["feature", "raw", "graph"])
def test_training_equals_the_direct_loop(spark, market, kind):
    rows, x, y, g, _ = market
    cells, tracker = [(1, 0.0, 1), (2, 0.2, 3), (20, 0.05, 1)], spark.sparkContext.statusTracker()
    jobs = lambda: len(tracker.getJobIdsForGroup(None))
    training.train(rows, g, kind, 1, 11, cells, size=512, tasks=1)
    before = jobs()
    done = training.train(rows, g, kind, 3, 11, cells, size=90, tasks=3)
    few = jobs()
    # six batches an epoch over three tasks
    for cell, (best, kept) in zip(done, _trained_directly(x, y, g, kind, 3, 11, cells, 90), strict=True):
        assert np.allclose(cell.kept, kept, rtol=0, atol=1e-9) and np.isclose(cell.best, best, rtol=1e-9)
    training.train(rows, g, kind, 1, 11, cells, size=20, tasks=3)
    assert jobs() - few == few - before


def test_grid_of_radii():
    assert training.grid((1,)) == [(1, 0.0, 1), (1, 0.05, 1), (1, 0.05, 3), (1, 0.1, 1), (1, 0.1, 3), (1, 0.2, 1), (1, 0.2, 3)]
    assert training.KINDS == {"raw": (8, 7), "feature": (6, 11), "graph": (7, 23)} and training.BATCH == 512


def test_ranges_of_bins_give_the_same(spark):
    c = Config(bins=300, assets=3, taus=(1, 2, 10, 20))
    rng = np.random.default_rng(9)
    # asset 0 is seen late, with long silences; asset 1 in one bin; asset 2 never
    seen = sorted(rng.choice(np.arange(70, 300), 25, replace=False).tolist())
    msg = spark.createDataFrame([(0, i, int(b)) for i, b in enumerate(seen)] + [(1, 900, 150)], "asset int, row_idx long, bin_idx long")
    got = {(r["asset"], r["bin_idx"]): r["last_row"] for r in bins.carry_forward(msg, c, span=23).collect()}
    for a, rows in ((0, dict(zip(seen, range(25)))), (1, {150: 900}), (2, {})):
        for b in range(300):
            before = [i for x, i in rows.items() if x <= b]
            assert got[a, b] == (before[-1] if before else next(iter(rows.values()), None))
    assert sorted(got.items()) == sorted(((r["asset"], r["bin_idx"]), r["last_row"]) for r in bins.carry_forward(msg, c).collect())
    plan = bins.carry_forward(msg, c, span=23)._jdf.queryExecution().executedPlan().toString()
    assert all("part" in line for line in plan.split("\n") if " Window " in line)
    mids = spark.createDataFrame([(a, b, float(v), 1.0) for a in range(3) for b, v in enumerate(rng.random(300) + 1)], "asset int, bin_idx long, mid double, spread double")
    rows = lambda x: sorted(map(tuple, x.na.fill(-1.0).collect()))
    assert rows(features.targets(mids, c, span=23)) == rows(features.targets(mids, c)) and features.targets(mids, c, span=20).count() == 3600
    with pytest.raises(ValueError, match="shorter than the horizon"):
        features.targets(mids, c, span=19)


def test_blocks_of_assets_give_the_same_products(spark):
    rng = np.random.default_rng(10)
    v = [(a, b, float(rng.standard_normal())) for a in range(5) for b in range(100) if rng.random() < 0.8]
    w = [(a, b, float(rng.standard_normal())) for a in range(5) for b in range(100) if rng.random() < 0.8]
    x, y = (spark.createDataFrame(r, "asset int, bin_idx long, z double") for r in (v, w))
    rows = lambda df: {(r["src"], r["dst"]): (round(r["s"], 9), r["n"]) for r in df.collect()}
    assert rows(graphs.pair_products(x, y, C)) == rows(graphs.pair_products(x, y, C, block=2, span=17))
    # thousands of assets: rows grow with blocks, not with assets squared in each bin
    c, bins_ = Config(assets=2000, bins=40, train_end=40), 40
    z = rng.standard_normal((bins_, 2000))
    many = spark.range(bins_ * 2000).select((F.col("id") % 2000).cast("int").alias("asset"), F.floor(F.col("id") / 2000).alias("bin_idx"))
    listed = spark.createDataFrame([(b, z[b].tolist()) for b in range(bins_)], "bin_idx long, z array<double>")
    many = many.join(listed, "bin_idx").select("asset", "bin_idx", F.expr("z[asset]").alias("z"))
    assert graphs.tiles(many, 8, "left").count() == bins_ * 8 * 8
    got = graphs.pair_products(many, many, c).toPandas()
    assert len(got) == 2000 * 2000 and (got.n == bins_).all()
    assert np.abs(got.s.to_numpy() - (z.T @ z)[got.src, got.dst]).max() < 1e-9


def test_keyed_permutation():
    for n in (1, 2, 3, 16, 17, 1000, 4097):
        a, b = (training.shuffled(np.arange(n), n, k) for k in (1, 2))
        assert sorted(a) == sorted(b) == list(range(n)) and (n < 17 or (a != b).any())
        # a part of the places goes where it goes among all
        assert (training.shuffled(np.arange(n)[::3], n, 1) == a[::3]).all()
    a = training.shuffled(np.arange(100_000), 100_000, 5)
    assert abs(np.corrcoef(a, np.arange(100_000))[0, 1]) < 0.02


def test_selection_has_a_row_for_every_model_and_takes_the_best_penalty(market):
    rows, x, y, g, _ = market
    found = selection.fitted(rows, {"g": g})
    assert [(m, t) for m, _, t, *_ in found] == [(m, t) for t in C.taus for m in ("ridge_own", "lasso_own", "graph_ridge")]
    table = selection.selection(rows, {"g": g}).collect()
    assert len(table) == 12 and all(r["mse"] > 0 and 0 <= r["da"] <= 1 for r in table)
    _, _, tau, alpha, error, theta = found[2]
    val = slice(*C.split("val", tau))
    assert np.isclose(error, np.mean((x[val] @ theta[: C.features] + (x[val] @ theta[C.features : -1]) @ g.T + theta[-1] - y[val]) ** 2))
    assert [r["model"] for r in selection.best_of_tau(selection.selection(rows, {"g": g})).collect()] == ["graph_ridge"] * 4


def test_graph_loss_equals_the_direct_one():
    rng = np.random.default_rng(5)
    e, p, g = rng.standard_normal((30, 5)), rng.standard_normal((30, 5)), np.abs(rng.standard_normal((5, 5))) / 5
    g = (g + g.T) / 2
    np.fill_diagonal(g, 0)
    loss = attacks.GraphLoss(e.T @ p, p.T @ p, (e * e).sum(), e.size)
    assert np.isclose(loss.mse(g), np.mean((e + p @ g.T) ** 2))
    raw = 2 * (e + p @ g.T).T @ p / e.size
    assert np.allclose(loss.gradient(g), (raw + raw.T) / 2 - np.diag(np.diag(raw)))
    assert loss.mse(g + loss.attack(g, 0.1, 7)) > loss.mse(g)


def test_verdict(spark):
    t = spark.createDataFrame([(1, 0.1, -0.1, 1.0, 1.0, 1.0)], "tau int, graph_gain double, feature_gain double, feature_robust_clean_mse double, graph_robust_clean_mse double, erm_clean_mse_reference double")
    assert summary.verdicts(t).first()["robustness_pays"] == "graph"
    assert summary.cell(0.0000123) == "1.23e-05" and summary.cell(1.5) == "1.500000"


def test_null_safe_bins(spark):
    df = spark.createDataFrame([(0, 0, None)], "asset int, bin_idx long, v double")
    assert graphs.train_values(df).count() == 0
