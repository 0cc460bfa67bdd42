"""Attacks of several steps and ridge solutions in DuckDB SQL: recursion over steps, assets and matrix rows in lists."""

from __future__ import annotations

#: Fixed values of the registered curves.
_STEPS = {"normalised": 7, "raw": 5}


def feature_curve(kind: str, rhos: tuple[float, ...], base: str = "(SELECT *, 1::DOUBLE AS f FROM tst)", keys: str = "f") -> str:
    """The keys, rad, clean, mse: mean squared errors of models before and after an attack on features of radius rad. base:
    asset, bin_idx, s, p, y of each model, which is the fixed one times f. A row a model, radius and bin has the lists over assets of
    both coefficients, a and b; each step moves, caps each asset, then caps the bin. sens: mean norm of a bin's first gradient."""
    steps = _STEPS[kind]
    size = "sqrt(list_sum(n2))"
    move = f"1.25::DOUBLE * rad / {steps}" if kind == "raw" else f"rad / {steps} / ({size} + 1e-12::DOUBLE)"
    norms = "list_transform(range(1, 6), lambda i: greatest(0, {a}[i] * {a}[i] * p + 2 * {a}[i] * {b}[i] * q + {b}[i] * {b}[i] * r))"
    pred = "list_transform(range(1, 6), lambda i: s[i] + a[i] * p + b[i] * q + list_inner_product(g[i], list_transform(range(1, 6), lambda j: x[j] + a[j] * q + b[j] * r)) + t)"
    return f"""SELECT {keys}, rad, avg(clean) AS clean, avg(moved) AS mse, avg(first) AS sens FROM (WITH RECURSIVE
bb AS (SELECT {keys}, bin_idx, list(s ORDER BY asset) AS s, list(p ORDER BY asset) AS x, list(y ORDER BY asset) AS y FROM {base} GROUP BY ALL),
gl AS (SELECT list(l ORDER BY src) AS g FROM (SELECT src, list(w ORDER BY dst) AS l FROM g GROUP BY src)),
gc AS (SELECT list(l ORDER BY dst) AS gt FROM (SELECT dst, list(w ORDER BY src) AS l FROM g GROUP BY dst)),
k AS (SELECT bb.*, g, gt, p * f * f AS p, q * f * f AS q, r * f * f AS r, f * (SELECT t FROM th WHERE k = 102) AS t, sum(len(s)) OVER (PARTITION BY {keys}) AS n FROM bb, gl, gc, ww),
rec AS (SELECT 0 AS step, {keys}, rad, bin_idx, [0.0, 0, 0, 0, 0]::DOUBLE[] AS a, [0.0, 0, 0, 0, 0]::DOUBLE[] AS b, 0::DOUBLE AS first FROM bb, (SELECT unnest({list(rhos)})::DOUBLE AS rad)
UNION ALL SELECT step + 1, {keys}, rad, bin_idx, list_transform(a, lambda v: v * c), list_transform(b, lambda v: v * c), first FROM (SELECT *, least(1, rad / ({size} + 1e-12::DOUBLE)) AS c
  FROM (SELECT * EXCLUDE (n2), {norms.format(a="a", b="b")} AS n2
  FROM (SELECT * EXCLUDE (a, b), list_transform(range(1, 6), lambda i: a[i] * least(1, rad / sqrt(5) / (sqrt(n2[i]) + 1e-12::DOUBLE))) AS a, list_transform(range(1, 6), lambda i: b[i] * least(1, rad / sqrt(5) / (sqrt(n2[i]) + 1e-12::DOUBLE))) AS b
  FROM (SELECT *, {norms.format(a="a", b="b")} AS n2
  FROM (SELECT * EXCLUDE (a, b, n2, first), list_transform(range(1, 6), lambda i: a[i] + h * da[i]) AS a, list_transform(range(1, 6), lambda i: b[i] + h * db[i]) AS b, CASE WHEN step = 0 THEN {size} ELSE first END AS first
  FROM (SELECT *, {move} AS h FROM (SELECT *, {norms.format(a="da", b="db")} AS n2
  FROM (SELECT *, list_transform(range(1, 6), lambda j: list_inner_product(gt[j], da)) AS db
  FROM (SELECT *, list_transform(range(1, 6), lambda i: 2 * (pred[i] - y[i]) / n) AS da
  FROM (SELECT *, {pred} AS pred FROM rec JOIN k USING ({keys}, bin_idx) WHERE step < {steps})))))))))))
SELECT {keys}, rad, first, unnest(list_transform(range(1, 6), lambda i: pow(pred[i] - y[i], 2))) AS moved, unnest(list_transform(range(1, 6), lambda i: pow(s[i] + list_inner_product(g[i], x) + t - y[i], 2))) AS clean
FROM (SELECT *, {pred} AS pred FROM rec JOIN k USING ({keys}, bin_idx) WHERE step = {steps})) GROUP BY ALL"""


def graph_curve(rhos: tuple[float, ...], base: str = "(SELECT *, 1::DOUBLE AS f FROM tst)", keys: str = "f", graph: str = "g") -> str:
    """The keys, rad, clean, mse of models before and after seven steps on the graph. A row a model and radius has the change as
    lists of rows; the loss is a function of sums over bins. sens: norm of the first gradient."""
    cells = "list_transform(range(1, 6), lambda i: list_transform(range(1, 6), lambda j: {v}))"
    loss = "(ee + 2 * list_sum(list_transform(range(1, 6), lambda i: list_inner_product({g}[i], ep[i]))) + list_sum(list_transform(range(1, 6), lambda i: list_sum(list_transform(range(1, 6), lambda j: {g}[i][j] * list_inner_product({g}[i], pp[j])))))) / n"
    length = "sqrt(list_sum(list_transform({v}, lambda l: list_inner_product(l, l))))"
    own = f"WITH own AS (SELECT *, f * (SELECT t FROM th WHERE k = 102) AS t FROM {base}) SELECT"
    return f"""SELECT {keys}, rad, {loss.format(g="g")} AS clean, {loss.format(g="h")} AS mse, first AS sens FROM (WITH RECURSIVE
ss AS ({own} {keys}, a.asset AS i, b.asset AS j, sum((a.s + a.t - a.y) * b.p) AS ep, sum(a.p * b.p) AS pp FROM own a JOIN own b USING ({keys}, bin_idx) GROUP BY ALL),
ll AS (SELECT {keys}, i, list(ep ORDER BY j) AS ep, list(pp ORDER BY j) AS pp FROM ss GROUP BY ALL),
nn AS ({own} {keys}, count(*) AS n, sum(pow(s + t - y, 2)) AS ee FROM own GROUP BY ALL),
k AS (SELECT {keys}, (SELECT list(l ORDER BY src) FROM (SELECT src, list(w ORDER BY dst) AS l FROM {graph} GROUP BY src)) AS g, list(ep ORDER BY i) AS ep, list(pp ORDER BY i) AS pp, any_value(n) AS n, any_value(ee) AS ee FROM ll JOIN nn USING ({keys}) GROUP BY {keys}),
rec AS (SELECT 0 AS step, {keys}, rad, {cells.format(v="0.0::DOUBLE")} AS d, 0::DOUBLE AS first FROM k, (SELECT unnest({list(rhos)})::DOUBLE AS rad)
UNION ALL SELECT step + 1, {keys}, rad, {cells.format(v="CASE WHEN i = j THEN -g[i][i] ELSE (g[i][j] + g[j][i]) / 2 + fr[i][j] * CASE WHEN len > rad THEN rad / (len + 1e-12::DOUBLE) ELSE 1 END - g[i][j] END")}, CASE WHEN step = 0 THEN gn ELSE first END FROM (SELECT *, {length.format(v="fr")} AS len
  FROM (SELECT *, {cells.format(v="CASE WHEN i = j THEN 0 ELSE least(1, greatest(0, (g[i][j] + g[j][i] + x[i][j] + x[j][i]) / 2)) - (g[i][j] + g[j][i]) / 2 END")} AS fr
  FROM (SELECT *, {cells.format(v="d[i][j] + rad / 7 * gr[i][j] / (gn + 1e-12::DOUBLE)")} AS x FROM (SELECT *, {length.format(v="gr")} AS gn
  FROM (SELECT *, {cells.format(v="CASE WHEN i = j THEN 0 ELSE raw[i][j] + raw[j][i] END")} AS gr
  FROM (SELECT *, {cells.format(v="(ep[i][j] + list_inner_product(h[i], pp[j])) / n")} AS raw FROM (SELECT *, {cells.format(v="g[i][j] + d[i][j]")} AS h FROM rec JOIN k USING ({keys}) WHERE step < 7))))))))
SELECT {keys}, rad, first, g, ep, pp, n, ee, {cells.format(v="g[i][j] + d[i][j]")} AS h FROM rec JOIN k USING ({keys}) WHERE step = 7)"""


def ridge(design: str, alphas: tuple[float, ...], size: int, free: bool) -> str:
    """alpha, k, theta of the normal equations of a design (columns 0..size-1 and size, the target), with a penalty on all
    columns, or all but the last if that is free: elimination column by column, a row of the extended matrix in a list. The
    penalty makes pivots positive."""
    return f"""SELECT alpha, i AS k, row[{size} + 1] / row[i + 1] AS theta FROM (WITH RECURSIVE
m AS MATERIALIZED (SELECT a.k AS i, b.k AS j, sum(a.d * b.d) AS v FROM {design} a JOIN {design} b USING (asset, bin_idx) GROUP BY ALL),
rec AS (SELECT -1 AS step, alpha, i, list(v + CASE WHEN i = j AND i < {size - 1 if free else size} THEN alpha ELSE 0 END ORDER BY j) AS row FROM m, (SELECT unnest({list(alphas)})::DOUBLE AS alpha) WHERE i < {size} GROUP BY alpha, i
UNION ALL SELECT step + 1, alpha, i, CASE WHEN i = step + 1 THEN row ELSE list_transform(range(1, {size} + 2), lambda c: row[c] - row[step + 2] / piv[step + 2] * piv[c]) END
  FROM (SELECT *, first_value(row) OVER (PARTITION BY alpha ORDER BY i <> step + 1 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS piv FROM rec WHERE step < {size} - 1))
SELECT alpha, i, row FROM rec WHERE step = {size} - 1)"""


def error_of(theta: str, design: str, size: int) -> str:
    """alpha, mse of each parameter vector (alpha, k, theta) on a design."""
    return f"SELECT alpha, avg(pow(pred - y, 2)) AS mse FROM (SELECT alpha, asset, bin_idx, sum(d * theta) AS pred FROM {design} JOIN ({theta}) USING (k) GROUP BY ALL) JOIN (SELECT asset, bin_idx, d AS y FROM {design} WHERE k = {size}) USING (asset, bin_idx) GROUP BY alpha"
