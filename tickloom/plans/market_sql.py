"""The market queries in DuckDB SQL: named parts, each built on the ones before it."""

from __future__ import annotations

import re

from ..operators.models import RIDGE_ALPHAS
from .attack_sql import error_of, feature_curve, graph_curve, ridge

PARTS = {
    "msg": """SELECT (user_id % 5)::INT AS asset, event_id AS row_idx, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 AS bin_idx, (props::JSON->>'$.k')::BIGINT AS k,
  CASE WHEN (props::JSON->>'$.k')::BIGINT >= 97 THEN 7 WHEN event_type = 'signup' THEN 1 WHEN event_type = 'view' THEN 2 WHEN event_type = 'error' THEN 3 WHEN event_type = 'click' THEN 4 ELSE 5 END AS event_type,
  CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS direction, ((props::JSON->>'$.k')::BIGINT)::DOUBLE AS size, (1000000 + round(value * 100))::BIGINT AS price_int FROM events""",
    "zlg": "SELECT 'A' || asset AS ticker, bin_idx, k, size, price_int, time, row_number() OVER (PARTITION BY asset ORDER BY time, event_id) - 1 AS row_idx FROM (SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6::DOUBLE AS time FROM events) JOIN msg ON row_idx = event_id",
    "cln": """SELECT asset, row_idx, bin_idx, bin_idx + 1 AS bin_id, event_type, CASE WHEN event_type = 1 THEN 'submission' WHEN event_type IN (2, 3) THEN 'cancellation' WHEN event_type IN (4, 5) THEN 'execution' ELSE 'other' END AS event_family,
  size, price_int / 10000 AS price, direction FROM msg WHERE bin_idx BETWEEN 0 AND 719 AND event_type BETWEEN 1 AND 5""",
    "axis": "SELECT a::INT AS asset, b AS bin_idx FROM range(5) t(a), range(720) u(b)",
    "summ": """SELECT asset, bin_idx, coalesce(n, 0) AS n_valid_events, coalesce(c1, 0) AS sub_count, coalesce(v1, 0) AS sub_volume, coalesce(c2, 0) AS can_count, coalesce(v2, 0) AS can_volume, coalesce(c3, 0) AS exe_count, coalesce(v3, 0) AS exe_volume, (coalesce(n, 0) > 0)::INT AS event_mask
  FROM axis LEFT JOIN (SELECT asset, bin_idx, count(*) AS n, count_if(event_type = 1) AS c1, sum(size) FILTER (event_type = 1) AS v1, count_if(event_type IN (2, 3)) AS c2, sum(size) FILTER (event_type IN (2, 3)) AS v2, count_if(event_type IN (4, 5)) AS c3, sum(size) FILTER (event_type IN (4, 5)) AS v3 FROM cln GROUP BY ALL) USING (asset, bin_idx)""",
    "lst": "SELECT asset, bin_idx, max(row_idx) AS last_row FROM msg WHERE bin_idx BETWEEN 0 AND 719 GROUP BY ALL",
    "grd": """SELECT asset, bin_idx, coalesce(last_value(last_row IGNORE NULLS) OVER (PARTITION BY asset ORDER BY bin_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(last_row IGNORE NULLS) OVER (PARTITION BY asset ORDER BY bin_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS last_row
  FROM axis LEFT JOIN lst USING (asset, bin_idx)""",
    "raw": """SELECT g.asset, g.bin_idx, last_row AS row_idx, h::INT AS h, h >= 8 AND last_row % 11 = 0 AS inv, 1000000 + k % 7 * 100 AS m, 50 * (1 + last_row % 3) AS hf FROM grd g JOIN msg ON msg.row_idx = last_row, range(1, 11) t(h)""",
    "bk": """SELECT *, ask_p BETWEEN 1 AND 9999999998 AND bid_p > 0 AND ask_q > 0 AND bid_q > 0 AND ask_p > bid_p AS valid FROM (SELECT asset, bin_idx, row_idx, h, CASE WHEN inv THEN 9999999999 ELSE m + hf + 100 * (h - 1) END AS ask_p, CASE WHEN inv THEN 0 ELSE 1 + (row_idx * 7 + h * 13) % 50 END AS ask_q,
  CASE WHEN inv THEN -9999999999 ELSE m - hf - 100 * (h - 1) END AS bid_p, CASE WHEN inv THEN 0 ELSE 1 + (row_idx * 11 + h * 17) % 50 END AS bid_q FROM raw)""",
    "mids": "SELECT asset, bin_idx, (ask_p / 10000 + bid_p / 10000) / 2 AS mid, ask_p / 10000 - bid_p / 10000 AS spread, (ask_p / 10000 * bid_q + bid_p / 10000 * ask_q) / (ask_q + bid_q + 1e-8::DOUBLE) AS weighted_mid FROM bk WHERE h = 1",
    "was": "SELECT *, lag(ask_p) OVER w AS ap, lag(ask_q) OVER w AS aq, lag(bid_p) OVER w AS bp, lag(bid_q) OVER w AS bq, lag(valid) OVER w AS wv FROM bk WINDOW w AS (PARTITION BY asset, h ORDER BY bin_idx)",
    "ofi": """SELECT asset, bin_idx, h,
  CASE WHEN valid AND wv THEN CASE WHEN bid_p > bp THEN bid_q WHEN bid_p = bp THEN bid_q - bq ELSE -bq END + CASE WHEN ask_p < ap THEN ask_q WHEN ask_p = ap THEN aq - ask_q ELSE -aq END ELSE 0 END::DOUBLE AS ofi_share,
  CASE WHEN valid AND wv THEN CASE WHEN bid_p > bp THEN bid_p / 10000 * bid_q WHEN bid_p = bp THEN bid_p / 10000 * bid_q - bp / 10000 * bq ELSE -(bp / 10000 * bq) END + CASE WHEN ask_p < ap THEN ask_p / 10000 * ask_q WHEN ask_p = ap THEN ap / 10000 * aq - ask_p / 10000 * ask_q ELSE -(ap / 10000 * aq) END ELSE 0 END::DOUBLE AS ofi_dollar FROM was""",
    "obi": """SELECT asset, bin_idx, h, sum(CASE WHEN valid THEN bid_q - ask_q ELSE 0 END) OVER w / (sum(CASE WHEN valid THEN bid_q + ask_q ELSE 0 END) OVER w + 1e-8::DOUBLE) AS obi_share,
  sum(CASE WHEN valid THEN bid_p / 10000 * bid_q - ask_p / 10000 * ask_q ELSE 0 END) OVER w / (sum(CASE WHEN valid THEN bid_p / 10000 * bid_q + ask_p / 10000 * ask_q ELSE 0 END) OVER w + 1e-8::DOUBLE) AS obi_dollar FROM bk WINDOW w AS (PARTITION BY asset, bin_idx ORDER BY h)""",
    "cls": """SELECT asset, bin_idx, sum(size) FILTER (event_type = 1) AS s1, sum(size * price) FILTER (event_type = 1) AS p1, sum(direction * size) FILTER (event_type = 1) AS q1, sum(size) FILTER (event_type IN (2, 3)) AS s2, sum(size * price) FILTER (event_type IN (2, 3)) AS p2, sum(-direction * size) FILTER (event_type IN (2, 3)) AS q2,
  sum(size) FILTER (event_type IN (4, 5)) AS s3, sum(size * price) FILTER (event_type IN (4, 5)) AS p3, sum(-direction * size) FILTER (event_type IN (4, 5)) AS q3, count(*) AS n FROM cln GROUP BY ALL""",
    "flow": """SELECT m.asset, m.bin_idx, coalesce(s1, 0) AS size_sub, coalesce(s2, 0) AS size_can, coalesce(s3, 0) AS size_exe, coalesce(q1, 0) AS q_sub, coalesce(q2, 0) AS q_can, coalesce(q3, 0) AS q_exe, CASE WHEN s1 > 0 THEN p1 / (s1 + 1e-8::DOUBLE) - mid ELSE 0 END AS dp_sub, CASE WHEN s2 > 0 THEN p2 / (s2 + 1e-8::DOUBLE) - mid ELSE 0 END AS dp_can,
  CASE WHEN s3 > 0 THEN p3 / (s3 + 1e-8::DOUBLE) - mid ELSE 0 END AS dp_exe, coalesce(p3, 0) AS traded, (coalesce(n, 0) > 0)::INT AS mask FROM mids m LEFT JOIN cls USING (asset, bin_idx)""",
    "feat": """SELECT asset, bin_idx, h - 1 AS f, ofi_share AS x FROM ofi UNION ALL SELECT asset, bin_idx, h + 9, ofi_dollar FROM ofi UNION ALL SELECT asset, bin_idx, h + 19, obi_share FROM obi UNION ALL SELECT asset, bin_idx, h + 29, obi_dollar FROM obi
  UNION ALL SELECT asset, bin_idx, unnest(range(40, 51)), unnest([spread, weighted_mid, size_exe, traded, dp_sub, q_sub, dp_can, q_can, dp_exe, q_exe, mask]) FROM mids JOIN flow USING (asset, bin_idx)""",
    "scl": "SELECT asset, f, mu, sigma, CASE WHEN sigma < 1e-10 THEN 1.0 ELSE sigma END AS sigma_safe FROM (SELECT asset, f, avg(x) AS mu, stddev_pop(x) AS sigma FROM feat WHERE bin_idx < 504 GROUP BY ALL)",
    "sdz": "SELECT asset, bin_idx, f, (x - mu) / sigma_safe AS x FROM feat JOIN scl USING (asset, f)",
    "phi": "SELECT asset, bin_idx, avg(x) AS v FROM sdz WHERE f < 10 GROUP BY ALL",
    "tgt": "SELECT asset, bin_idx, tau, ln(a) - ln(mid) AS y, (a - mid) / (spread + 1e-8::DOUBLE) AS z FROM (SELECT m.asset, m.bin_idx, tau, m.mid, m.spread, n.mid AS a FROM mids m CROSS JOIN (VALUES (1), (2), (10), (20)) t(tau) LEFT JOIN mids n ON n.asset = m.asset AND n.bin_idx = m.bin_idx + tau)",
    "ret": "SELECT asset, bin_idx, y AS v FROM tgt WHERE tau = 1 AND bin_idx < 503",
    "pht": "SELECT * FROM phi WHERE bin_idx < 503",
    "zr": "SELECT asset, bin_idx, CASE WHEN s > 1e-10 THEN (v - m) / (s + 1e-12::DOUBLE) ELSE 0 END AS z, (v - m) / (s + 1e-12::DOUBLE) AS u FROM ret JOIN (SELECT asset, avg(v) AS m, stddev_pop(v) AS s FROM ret GROUP BY ALL) USING (asset)",
    "zp": "SELECT asset, bin_idx, CASE WHEN s > 1e-10 THEN (v - m) / (s + 1e-12::DOUBLE) ELSE 0 END AS z, (v - m) / (s + 1e-12::DOUBLE) AS u FROM pht JOIN (SELECT asset, avg(v) AS m, stddev_pop(v) AS s FROM pht GROUP BY ALL) USING (asset)",
    "cr": "SELECT a.asset AS src, b.asset AS dst, CASE WHEN a.asset = b.asset THEN 0.0 ELSE greatest(-1, least(1, sum(a.z * b.z) / (count(*) - 1))) END AS w FROM zr a JOIN zr b USING (bin_idx) GROUP BY a.asset, b.asset",
    "co": "SELECT a.asset AS src, b.asset AS dst, CASE WHEN a.asset = b.asset THEN 0.0 ELSE greatest(-1, least(1, sum(a.z * b.z) / (count(*) - 1))) END AS w FROM zp a JOIN zp b USING (bin_idx) GROUP BY a.asset, b.asset",
    "cx": "SELECT a.asset AS src, b.asset AS dst, CASE WHEN a.asset = b.asset THEN 0.0 ELSE greatest(-1, least(1, sum(a.u * b.u) / (count(*) - 1))) END AS w FROM zp a JOIN zr b USING (bin_idx) GROUP BY a.asset, b.asset",
    "coact": "SELECT a.asset AS src, b.asset AS dst, CASE WHEN a.asset = b.asset THEN 0.0 ELSE sum(a.mask * b.mask) / 504 END AS w FROM flow a JOIN flow b USING (bin_idx) WHERE bin_idx < 504 GROUP BY a.asset, b.asset",
    "base": "SELECT 'return' AS name, * FROM cr UNION ALL SELECT 'ofi', * FROM co UNION ALL SELECT 'cross_ofi', * FROM cx",
    "vars": """SELECT name || '_' || kind AS graph, src, dst, CASE kind WHEN 'signed' THEN half WHEN 'abs' THEN abs(half) WHEN 'signed_mask' THEN half * co ELSE abs(half) * co END AS w
  FROM (SELECT b.name, b.src, b.dst, (b.w + t.w) / 2 AS half, coact.w AS co FROM base b JOIN base t ON b.name = t.name AND b.src = t.dst AND b.dst = t.src JOIN coact ON coact.src = b.src AND coact.dst = b.dst) CROSS JOIN (VALUES ('signed'), ('abs'), ('signed_mask'), ('abs_mask')) k(kind)""",
    "nrm": "SELECT graph, src, dst, w / (sum(abs(w)) OVER (PARTITION BY graph, src) + 1e-12::DOUBLE) AS w FROM vars",
    "nsy": "SELECT a.graph, a.src, a.dst, CASE WHEN a.src = a.dst THEN 0.0 ELSE greatest(0, least(1, (a.w + b.w) / 2)) END AS w FROM nrm a JOIN nrm b ON a.graph = b.graph AND a.src = b.dst AND a.dst = b.src",
    "g": "SELECT src, dst, w FROM nrm WHERE graph = 'return_abs'",
    "near": "SELECT src AS asset, bin_idx, f, sum(w * x) AS x FROM sdz JOIN g ON g.dst = sdz.asset GROUP BY ALL",
    "th": "SELECT k::INT AS k, ((k * 37) % 11 - 5) / 1000 AS t FROM range(103) r(k)",
    "proj": "SELECT asset, bin_idx, sum(x * a.t) AS s, sum(x * b.t) AS p FROM sdz JOIN th a ON a.k = f JOIN th b ON b.k = f + 51 GROUP BY ALL",
    "prd": "SELECT p.asset, p.bin_idx, any_value(p.s) AS s, any_value(p.p) AS p, any_value(p.s) + sum(g.w * q.p) + (SELECT t FROM th WHERE k = 102) AS pred FROM proj p JOIN g ON g.src = p.asset JOIN proj q ON q.asset = g.dst AND q.bin_idx = p.bin_idx GROUP BY p.asset, p.bin_idx",
    "tst": "SELECT prd.*, y, pred - y AS e FROM prd JOIN tgt USING (asset, bin_idx) WHERE tau = 1 AND bin_idx >= 612 AND bin_idx < 719",
    "lgc": "SELECT asset, bin_idx, d * (SELECT sum(t) FROM th) AS pred, y FROM (SELECT asset, bin_idx, sum(x) + 1 AS d FROM (SELECT * FROM sdz UNION ALL BY NAME SELECT * FROM near) GROUP BY ALL) JOIN tgt USING (asset, bin_idx) WHERE tau = 1 AND bin_idx >= 612 AND bin_idx < 719",
    "bke": "SELECT g.dst AS asset, bin_idx, sum(w * e) AS eb FROM tst JOIN g ON g.src = tst.asset GROUP BY ALL",
    "gt": """SELECT k, 2 * v / (SELECT count(*) FROM tst) + CASE WHEN k < 102 THEN 2 * 1e-4::DOUBLE * t ELSE 0 END AS g FROM (SELECT f AS k, sum(x * e) AS v FROM sdz JOIN tst USING (asset, bin_idx) GROUP BY ALL UNION ALL SELECT f + 51, sum(x * eb) FROM sdz JOIN bke USING (asset, bin_idx) GROUP BY ALL UNION ALL SELECT 102, sum(e) FROM tst) JOIN th USING (k)""",
    "ww": "SELECT sum(a.t * a.t) AS p, sum(a.t * b.t) AS q, sum(b.t * b.t) AS r FROM th a JOIN th b ON b.k = a.k + 51 WHERE a.k < 51",
    "fg": "SELECT asset, bin_idx, a, b, greatest(0, a * a * p + 2 * a * b * q + b * b * r) AS norm2 FROM (SELECT asset, bin_idx, 2 * e / (SELECT count(*) FROM tst) AS a, 2 * eb / (SELECT count(*) FROM tst) AS b FROM tst JOIN bke USING (asset, bin_idx)), ww",
    "f1": "SELECT asset, bin_idx, a * k AS a, b * k AS b, norm2 * k * k AS norm2 FROM (SELECT *, 0.1::DOUBLE / (sqrt(sum(norm2) OVER (PARTITION BY bin_idx)) + 1e-12::DOUBLE) AS k FROM fg)",
    "f2": "SELECT asset, bin_idx, a * k AS a, b * k AS b, norm2 * k * k AS norm2 FROM (SELECT *, least(1, 0.1::DOUBLE / sqrt(5) / (sqrt(norm2) + 1e-12::DOUBLE)) AS k FROM f1)",
    "f3": "SELECT asset, bin_idx, a * k AS a, b * k AS b, norm2 * k * k AS norm2 FROM (SELECT *, least(1, 0.1::DOUBLE / (sqrt(sum(norm2) OVER (PARTITION BY bin_idx)) + 1e-12::DOUBLE)) AS k FROM f2)",
    "gr": "SELECT a.asset AS src, b.asset AS dst, 2 * sum(a.e * b.p) / (SELECT count(*) FROM tst) AS v FROM tst a JOIN tst b USING (bin_idx) GROUP BY ALL",
    "gg": "SELECT a.src, a.dst, CASE WHEN a.src = a.dst THEN 0.0 ELSE (a.v + b.v) / 2 END AS g FROM gr a JOIN gr b ON a.src = b.dst AND a.dst = b.src",
    "dz": "SELECT asset, bin_idx, f AS k, x AS d FROM sdz WHERE bin_idx >= 612 AND bin_idx < 719 UNION ALL SELECT asset, bin_idx, f + 51, x FROM near WHERE bin_idx >= 612 AND bin_idx < 719 UNION ALL SELECT asset, bin_idx, 102, 1.0 FROM tst UNION ALL SELECT asset, bin_idx, 103, y FROM tst",
    "dzt": "SELECT s.* FROM (SELECT asset, bin_idx, f AS k, x AS d FROM sdz UNION ALL SELECT asset, bin_idx, f + 51, x FROM near UNION ALL SELECT asset, bin_idx, 102, 1.0 FROM axis UNION ALL SELECT asset, bin_idx, 103, y FROM tgt WHERE tau = 1) s WHERE bin_idx < 503",
    "dzv": "SELECT s.* FROM (SELECT asset, bin_idx, f AS k, x AS d FROM sdz UNION ALL SELECT asset, bin_idx, f + 51, x FROM near UNION ALL SELECT asset, bin_idx, 102, 1.0 FROM axis UNION ALL SELECT asset, bin_idx, 103, y FROM tgt WHERE tau = 1) s WHERE bin_idx >= 504 AND bin_idx < 611",
    "cel": "SELECT rho::DOUBLE AS rho, r_adv, f::DOUBLE AS f FROM (VALUES (0.0, 1, 1.0), (0.05, 1, 0.9), (0.05, 3, 0.8), (0.1, 1, 0.7), (0.1, 3, 0.6)) v(rho, r_adv, f)",
    "tsm": "SELECT tau, rho, r_adv, f, bin_idx, asset, s * f AS s, p * f AS p, y FROM prd JOIN tgt USING (asset, bin_idx), cel WHERE bin_idx >= 612 AND bin_idx < 720 - tau",
    "ngs": "SELECT src, dst, w FROM nsy WHERE graph = 'return_abs'",
    "res": f"SELECT tau, rho, r_adv, clean AS clean_mse, mse - clean AS deg_mse, sens AS sensitivity FROM ({feature_curve('normalised', (0.1,), 'tsm', 'tau, rho, r_adv, f')})",
    "rsg": f"SELECT tau, rho, r_adv, clean AS clean_mse, mse - clean AS deg_mse, sens AS sensitivity FROM ({graph_curve((0.1,), 'tsm', 'tau, rho, r_adv, f', 'ngs')})",
}


def sql(query: str) -> str:
    """The query with the parts it needs, in order."""
    need, names = set(), list(PARTS)
    todo = [query]
    while todo:
        text = todo.pop()
        for n in names:
            if n not in need and re.search(rf"(FROM|JOIN|,)\s+{n}\b", text):
                need.add(n)
                todo.append(PARTS[n])
    parts = ", ".join(f"{n} AS MATERIALIZED ({PARTS[n]})" for n in names if n in need)
    return f"WITH {parts} {query}" if parts else query


def _rounded(table: str, keys: str, values: dict[str, int], scale: str = "") -> str:
    return f"SELECT {keys}, {', '.join(f'round({v}{scale}, {n}) + 0.0 AS {v}' for v, n in values.items())} FROM {table}"


_METRICS = """SELECT round(avg(e * e), 8) AS mse, round(avg(abs(e)), 8) AS mae, round((sum((sign(pred) = sign(y))::INT) FILTER (y <> 0)) / (count(*) FILTER (y <> 0)), 8) AS da, (SELECT round(avg(pnl) / (stddev_pop(pnl) + 1e-12::DOUBLE), 5) FROM (SELECT bin_idx, sum(pred * y) / (sum(abs(pred)) + 1e-12::DOUBLE) AS pnl FROM {t} GROUP BY ALL)) AS sharpe FROM (SELECT *, pred - y AS e FROM {t})"""

_ROBUST = "(SELECT b.tau, p.clean_mse AS erm_clean_mse, b.clean_mse AS robust_clean_mse, p.deg_mse - b.deg_mse AS gain, p.sensitivity - b.sensitivity AS sens, 'rho=' || b.rho || ',R=' || b.r_adv AS choice FROM (SELECT *, row_number() OVER (PARTITION BY tau ORDER BY deg_mse, rho, r_adv) AS i FROM {t} WHERE rho > 0) b JOIN (SELECT * FROM {t} WHERE rho = 0) p ON p.tau = b.tau WHERE i = 1)"
_ABLATION = f"SELECT f.tau, (SELECT min(clean_mse) FROM res WHERE res.tau = f.tau) AS best_clean_mse, f.robust_clean_mse AS feature_robust_clean_mse, f.gain AS feature_gain, f.choice AS feature_robust_choice, g.erm_clean_mse AS erm_clean_mse_reference, g.robust_clean_mse AS graph_robust_clean_mse, g.gain AS graph_gain, g.sens AS sensitivity_improvement, g.choice AS graph_robust_choice FROM {_ROBUST.format(t='res')} f JOIN {_ROBUST.format(t='rsg')} g ON g.tau = f.tau"


def _checks(step: str, table: str, checks: list[tuple[str, str, str, str]], prefix: str = "''") -> str:
    """Rows step, name, status, observed, expected: name, observed, whether right, expected of each check over the rows of table."""
    packed = ", ".join(f"{{'name': '{n}', 'observed': ({o})::DOUBLE, 'ok': coalesce({ok}, false), 'expected': '{e}'}}" for n, o, ok, e in checks)
    return f"SELECT '{step}' AS step, prefix || c.name AS name, CASE WHEN c.ok THEN 'PASS' ELSE 'FAIL' END AS status, c.observed AS observed, c.expected AS expected FROM (SELECT {prefix} AS prefix, unnest([{packed}]) AS c FROM ({table}))"


def _is(name: str, column: str, value: int) -> tuple[str, str, str, str]:
    return name, column, f"{column} = {value}", str(value)


def _over_zero(name: str, column: str) -> tuple[str, str, str, str]:
    return name, column, f"{column} > 0", "> 0"


def _true(name: str, column: str) -> tuple[str, str, str, str]:
    return name, f"{column}::INT", column, "1"


_BINS = ("bins", "bins BETWEEN 1 AND 720", "1 to bins")
_CHECKS = [
    _checks("01", "SELECT asset, count(*) AS message_rows, count(*) AS book_rows, min(bin_idx) AS first_bin, max(bin_idx) AS last_bin, (SELECT count(DISTINCT bin_idx) FROM cln WHERE cln.asset = msg.asset) AS event_bins, 10 AS levels, min(100 * (1 + row_idx % 3)) FILTER (row_idx < 500) / 10000 AS spread_min, coalesce(bool_and(1 + (row_idx * 7 + 13) % 50 > 0 AND 1 + (row_idx * 11 + 17) % 50 > 0) FILTER (row_idx < 500), true) AS sizes FROM msg GROUP BY asset",
        [_over_zero("message_rows", "message_rows"), ("book_rows", "book_rows", "book_rows = message_rows", "message rows"), ("first_bin", "first_bin", "first_bin BETWEEN 0 AND 719", "in the grid"), ("last_bin", "last_bin", "last_bin BETWEEN 0 AND 719", "in the grid"), _over_zero("event_bins", "event_bins"), _is("levels", "levels", 10), ("sample_spread_positive", "spread_min", "spread_min > 0 OR spread_min IS NULL", "> 0"), _true("sample_best_sizes_positive", "sizes")], "'asset_' || asset || '_'"),
    _checks("01", "SELECT count(DISTINCT bin_idx) AS bins FROM cln", [("any_asset_event_bins", *_BINS)]),
    _checks("02", "SELECT 720 AS bins, 504 + 108 + 108 AS split_bins, count(DISTINCT f) AS width FROM feat", [_is("time_bins", "bins", 720), _is("chronological_split", "split_bins", 720), _is("feature_dimension", "width", 51)]),
    _checks("02", "SELECT asset, count(*) AS v, sum(x) FILTER (f = 50) AS mask, (SELECT count(DISTINCT bin_idx) FROM cln WHERE cln.asset = feat.asset) AS event_bins, (SELECT min(mid) FROM mids WHERE mids.asset = feat.asset) AS mid, (SELECT min(spread) FROM mids WHERE mids.asset = feat.asset) AS spread, bool_and(isfinite(x)) AS fin FROM feat GROUP BY asset",
        [_is("values", "v", 36720), ("event_bins", "mask", "mask = event_bins", "bins with events"), _over_zero("spread_positive", "spread"), _over_zero("mid_positive", "mid"), _true("features_finite", "fin")], "'asset_' || asset || '_'"),
    _checks("02", "SELECT count(*) AS v, bool_and(isfinite(x)) AS fin FROM feat", [_is("feature_values", "v", 183600), _true("features_all_finite", "fin")]),
    _checks("02", "SELECT count(DISTINCT bin_idx) AS bins FROM feat WHERE f = 50 AND x > 0", [("any_asset_event_bins", *_BINS)]),
    _checks("02", "SELECT count(*) AS v, bool_and(isfinite(x)) AS fin FROM sdz", [_is("standardized_values", "v", 183600), _true("standardized_all_finite", "fin")]),
    _checks("02", "SELECT max(abs(m)) AS mean, max(abs(s - 1)) FILTER (s > 0.5) AS std FROM (SELECT asset, f, avg(x) AS m, stddev_pop(x) AS s FROM sdz WHERE bin_idx < 504 GROUP BY ALL)", [("train_mean_close_to_zero", "round(mean, 6)", "mean < 1e-4", "< 1e-4"), ("train_std_close_to_one", "round(std, 6)", "coalesce(std, 0) < 1e-4", "< 1e-4")]),
    _checks("02", "SELECT tau, bool_and(coalesce(isfinite(y), false) OR bin_idx >= 720 - tau) AS y, bool_and(coalesce(isfinite(z), false) OR bin_idx >= 720 - tau) AS z, bool_and(bin_idx < 720 - tau OR (y IS NULL AND z IS NULL)) AS tail FROM tgt GROUP BY tau", [_true("logret_finite", "y"), _true("spread_return_finite", "z"), _true("tail_empty", "tail")], "'tau_' || tau || '_'"),
    _checks("03", "SELECT count(*) AS v, bool_and(isfinite(x)) AS fin FROM sdz", [_is("standardized_values", "v", 183600), _true("standardized_finite", "fin")]),
    _checks("03", "SELECT count(*) AS v, bool_and(mask IN (0, 1)) AS b FROM flow", [_is("mask_values", "v", 3600), _true("mask_binary", "b")]),
    _checks("03", "SELECT tau, count(y) AS there, count(*) AS v FROM tgt GROUP BY tau", [_over_zero("target_exists", "there"), _is("target_values", "v", 3600)], "'tau_' || tau || '_'"),
    _checks("03", "SELECT graph, count(*) AS edges, bool_and(isfinite(w)) AS fin, max(abs(w)) FILTER (src = dst) AS diagonal FROM vars GROUP BY graph", [_is("edges", "edges", 25), _true("finite", "fin"), ("diagonal_zero", "round(diagonal, 7)", "diagonal < 1e-7", "0")], "'graph_' || graph || '_'"),
]

ORACLES = {
    name: sql(query)
    for name, query in {
        "flagship": "SELECT g.asset, g.bin_idx, last_row, round(mid, 6) AS mid, round(o.ofi_share, 6) + 0.0 AS ofi_share_h1, round(y * 10000, 6) + 0.0 AS ret_bps FROM grd g JOIN mids USING (asset, bin_idx) JOIN ofi o ON o.asset = g.asset AND o.bin_idx = g.bin_idx AND o.h = 1 JOIN tgt t ON t.asset = g.asset AND t.bin_idx = g.bin_idx AND tau = 1",
        "clean_messages": "SELECT * FROM cln",
        "event_type_counts": "SELECT asset, event_type, count(*) AS n FROM msg GROUP BY ALL",
        "family_volume": "SELECT CASE WHEN event_type = 1 THEN 'submission' WHEN event_type IN (2, 3) THEN 'cancellation' WHEN event_type IN (4, 5) THEN 'execution' ELSE 'other' END AS event_family, count(*) AS n, sum(size) AS volume FROM msg GROUP BY ALL",
        "bin_event_summary": "SELECT * FROM summ",
        "event_bins": "SELECT asset, count(DISTINCT bin_idx) AS bins FROM cln GROUP BY ALL",
        "any_asset_bins": "SELECT count(DISTINCT bin_idx) AS bins FROM cln",
        "duplicate_rows": "SELECT row_idx, count(*) AS n FROM msg GROUP BY ALL HAVING count(*) > 1",
        "book_sample_audit": "SELECT count(*) AS sample_rows, round(min(a), 6) AS ask1_min, round(min(b), 6) AS bid1_min, round(min(a - b), 6) AS spread_min, round(median(a - b), 6) AS spread_median, bool_and(qa > 0 AND qb > 0) AS sizes_positive FROM (SELECT 1 + (row_idx * 7 + 13) % 50 AS qa, 1 + (row_idx * 11 + 17) % 50 AS qb, (1000000 + k % 7 * 100 + 50 * (1 + row_idx % 3)) / 10000 AS a, (1000000 + k % 7 * 100 - 50 * (1 + row_idx % 3)) / 10000 AS b FROM msg WHERE row_idx < 500)",
        "last_row_per_bin": "SELECT * FROM lst",
        "carry_forward_grid": "SELECT * FROM grd",
        "selected_book_rows": "SELECT DISTINCT row_idx, h, ask_p, ask_q, bid_p, bid_q FROM bk",
        "binned_book": "SELECT asset, bin_idx, h, row_idx, ask_p, ask_q, bid_p, bid_q FROM bk",
        "level_validity": "SELECT asset, bin_idx, h, valid, coalesce(valid AND wv, false) AS pair_valid FROM was",
        "mid_spread_wmid": _rounded("mids", "asset, bin_idx", {"mid": 6, "spread": 6, "weighted_mid": 6}),
        "ofi_share": _rounded("ofi", "asset, bin_idx, h", {"ofi_share": 6}),
        "ofi_dollar": _rounded("ofi", "asset, bin_idx, h", {"ofi_dollar": 4}),
        "obi_share": _rounded("obi", "asset, bin_idx, h", {"obi_share": 6}),
        "obi_dollar": _rounded("obi", "asset, bin_idx, h", {"obi_dollar": 6}),
        "flow_submission": _rounded("flow", "asset, bin_idx", {"size_sub": 4, "dp_sub": 6, "q_sub": 4}),
        "flow_cancellation": _rounded("flow", "asset, bin_idx", {"size_can": 4, "dp_can": 6, "q_can": 4}),
        "flow_execution": _rounded("flow", "asset, bin_idx", {"size_exe": 4, "dp_exe": 6, "q_exe": 4}),
        "traded_value": _rounded("flow", "asset, bin_idx", {"traded": 3}),
        "event_mask": "SELECT asset, bin_idx, mask FROM flow",
        "asset_feature_summary": "SELECT asset, round(min(spread), 6) AS min_spread, round(median(spread), 6) AS median_spread, round(max(spread), 6) AS max_spread, round(min(mid), 6) AS min_mid, round(max(mid), 6) AS max_mid, (SELECT count_if(size_exe <> 0 OR traded <> 0 OR dp_sub <> 0 OR q_sub <> 0 OR dp_can <> 0 OR q_can <> 0 OR dp_exe <> 0 OR q_exe <> 0) FROM flow WHERE flow.asset = mids.asset) AS flow_bins, (SELECT count_if(NOT valid) FROM bk WHERE bk.asset = mids.asset) AS invalid_cells, (SELECT count_if(ofi_share <> 0) FROM ofi WHERE ofi.asset = mids.asset) AS nonzero_ofi FROM mids GROUP BY asset",
        "targets_logret": "SELECT asset, bin_idx, tau, round(y * 10000, 6) + 0.0 AS y_bps FROM tgt",
        "targets_spread": "SELECT asset, bin_idx, tau, round(z, 6) + 0.0 AS z FROM tgt",
        "purged_splits": "SELECT tau, split, count(*) AS bins FROM (SELECT tau, CASE WHEN b < 504 - tau THEN 'train' WHEN b >= 504 AND b < 612 - tau THEN 'val' WHEN b >= 612 AND b < 720 - tau THEN 'test' END AS split FROM range(720) r(b), (VALUES (1), (2), (10), (20)) t(tau)) WHERE split IS NOT NULL GROUP BY ALL",
        "feature_matrix": "SELECT asset, bin_idx, f, round(x, 4) + 0.0 AS x FROM feat",
        "scaler": _rounded("scl", "asset, f", {"mu": 5, "sigma": 5, "sigma_safe": 5}),
        "standardized": _rounded("sdz", "asset, bin_idx, f", {"x": 5}),
        "standardize_audit": "SELECT round(max(abs(m)), 6) AS max_abs_mean, round(max(abs(s - 1)) FILTER (s > 0.5), 6) AS max_abs_std_error FROM (SELECT asset, f, avg(x) AS m, stddev_pop(x) AS s FROM sdz WHERE bin_idx < 504 GROUP BY ALL)",
        "target_audit": "SELECT tau, round(max(abs(y)) * 10000, 6) AS max_abs_bps, count(y) AS samples FROM tgt GROUP BY ALL",
        "phi_bar": "SELECT asset, bin_idx, round(v, 6) + 0.0 AS phi FROM phi",
        "corr_return": _rounded("cr", "src, dst", {"w": 8}),
        "corr_ofi": _rounded("co", "src, dst", {"w": 8}),
        "corr_cross_ofi": _rounded("cx", "src, dst", {"w": 8}),
        "coactivity": _rounded("coact", "src, dst", {"w": 8}),
        "graph_variants": _rounded("vars", "graph, src, dst", {"w": 8}),
        "graph_summary": "SELECT graph, round(min(w), 8) AS min_w, round(max(w), 8) AS max_w, round(avg(abs(w)), 8) AS mean_abs, count_if(abs(w) > 1e-10) AS edges FROM vars GROUP BY ALL",
        "graph_rownorm": _rounded("nrm", "graph, src, dst", {"w": 8}),
        "graph_rownorm_sym": _rounded("nsy", "graph, src, dst", {"w": 8}),
        "neighbor_features": _rounded("near", "asset, bin_idx, f", {"x": 5}),
        "graph_design": "SELECT asset, bin_idx, f AS k, round(x, 5) + 0.0 AS d FROM sdz WHERE bin_idx >= 612 UNION ALL SELECT asset, bin_idx, f + 51, round(x, 5) FROM near WHERE bin_idx >= 612",
        "gram_matrix": "SELECT a.k AS i, b.k AS j, round(sum(a.d * b.d), 3) + 0.0 AS v FROM dz a JOIN dz b USING (asset, bin_idx) GROUP BY ALL",
        "metrics_fixed_theta": _METRICS.format(t="tst"),
        "legacy_predict_metrics": _METRICS.format(t="lgc"),
        "grad_theta_fixed": "SELECT k, round(g, 8) + 0.0 AS g FROM gt",
        "grad_x_norm_fixed": "SELECT bin_idx, round(sqrt(sum(norm2)) * 1000, 8) AS norm FROM fg GROUP BY ALL",
        "grad_g_fixed": "SELECT src, dst, round(g, 8) + 0.0 AS g FROM gg",
        "feature_attack_1step": "SELECT asset, bin_idx, round(a, 5) + 0.0 AS a, round(b, 5) + 0.0 AS b, round(norm2, 8) AS norm2 FROM f3",
        "sensitivity_fixed": "SELECT round(avg(n) * 1000, 6) AS sensitivity FROM (SELECT s, avg(norm) AS n FROM (SELECT bin_idx, sqrt(sum(norm2)) AS norm FROM fg GROUP BY ALL) JOIN (SELECT DISTINCT i, 612 + (75 * i) // 7 AS s FROM range(8) r(i)) ON bin_idx >= s AND bin_idx < s + 32 GROUP BY i, s)",
        "best_by_tau": "SELECT tau, rho, r_adv, round(clean_mse * 1e6::DOUBLE, 4) AS clean_mse_ppm FROM (SELECT *, row_number() OVER (PARTITION BY tau ORDER BY clean_mse, rho, r_adv) AS i FROM res) WHERE i = 1",
        "robust_vs_erm": "SELECT b.tau, " + ", ".join(f"round(({v}) * 1e6::DOUBLE, 4) + 0.0 AS {n}_ppm" for n, v in {"erm_clean_mse": "p.clean_mse", "robust_clean_mse": "b.clean_mse", "erm_deg_mse": "p.deg_mse", "robust_deg_mse": "b.deg_mse", "deg_mse_improvement": "p.deg_mse - b.deg_mse", "sensitivity_improvement": "p.sensitivity - b.sensitivity"}.items()) + ", 'rho=' || b.rho || ',R=' || b.r_adv AS robust_choice FROM (SELECT *, row_number() OVER (PARTITION BY tau ORDER BY deg_mse, rho, r_adv) AS i FROM res WHERE rho > 0) b JOIN (SELECT * FROM res WHERE rho = 0) p ON p.tau = b.tau WHERE i = 1",
        "checks": " UNION ALL ".join(_CHECKS),
        "check_statuses": f"SELECT step, CASE WHEN bool_and(status = 'PASS') THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS checks, count_if(status <> 'PASS') AS failed FROM ({' UNION ALL '.join(_CHECKS)}) GROUP BY step",
        "ticker_stats": "SELECT 'A' || i AS ticker, i + 1 AS ord, coalesce(message_rows, 0) AS message_rows, coalesce(event_bins, 0) AS event_bins FROM range(5) r(i) LEFT JOIN (SELECT asset, count(*) AS message_rows FROM msg GROUP BY ALL) m ON m.asset = i LEFT JOIN (SELECT asset, count(DISTINCT bin_idx) AS event_bins FROM cln GROUP BY ALL) c ON c.asset = i",
        "message_book_counts": "SELECT 'A' || asset AS ticker, count(*) AS message_rows, count(*) AS book_rows FROM msg GROUP BY asset",
        "attack_curve": f"SELECT rad AS rho, kind, round((mse - clean) * 1e6::DOUBLE, 4) AS deg_mse_ppm FROM (SELECT *, 'feature' AS kind FROM ({feature_curve('normalised', (0.01, 0.05, 0.1, 0.2))}) UNION ALL SELECT *, 'graph' AS kind FROM ({graph_curve((0.01, 0.05, 0.1, 0.2))}))",
        "raw_attack_curve": f"SELECT rad AS rho, round(clean * 1e6::DOUBLE, 4) AS clean_mse_ppm, round(mse * 1e6::DOUBLE, 4) AS mse_ppm, round((mse - clean) * 1e12::DOUBLE, 3) AS deg_mse_e12 FROM ({feature_curve('raw', (0.05, 0.1))})",
        "ridge_solved": f"SELECT k, round(theta * 1e4::DOUBLE, 5) + 0.0 AS theta_bps FROM ({ridge('dz', (0.01,), 103, True)})",
        "ridge_path": f"SELECT alpha, round(mse * 1e8::DOUBLE, 4) AS val_mse_e8, alpha = min_by(alpha, mse) OVER () AS chosen FROM ({error_of(ridge('dzt', RIDGE_ALPHAS, 103, False), 'dzv', 103)})",
        "zipped_messages": "SELECT ticker, row_idx, round(time, 3) AS time, size, price_int::DOUBLE AS price FROM zlg WHERE time >= 360000 AND time < 1080000",
        "zipped_selected_book": """SELECT ticker, row_idx, bin_idx, h::INT AS h, CASE WHEN inv THEN 9999999999 ELSE 1000000 + k % 7 * 100 + hf + 100 * (h - 1) END AS ask_p, CASE WHEN inv THEN 0 ELSE 1 + (row_idx * 7 + h * 13) % 50 END AS ask_q, CASE WHEN inv THEN -9999999999 ELSE 1000000 + k % 7 * 100 - hf - 100 * (h - 1) END AS bid_p, CASE WHEN inv THEN 0 ELSE 1 + (row_idx * 11 + h * 17) % 50 END AS bid_q
  FROM (SELECT *, h >= 8 AND row_idx % 11 = 0 AS inv, 50 * (1 + row_idx % 3) AS hf FROM (SELECT ticker, bin_idx, max(row_idx) AS row_idx, max_by(k, row_idx) AS k FROM zlg WHERE bin_idx BETWEEN 0 AND 719 GROUP BY ALL), range(1, 11) t(h))""",
        "zipped_line_counts": "SELECT ticker, count(*) AS message_rows, count(*) AS book_rows FROM zlg GROUP BY ALL",
        "project_feature_ball": "SELECT asset, bin_idx, round(a * k, 5) + 0.0 AS a, round(b * k, 5) + 0.0 AS b, round(norm2 * k * k, 8) AS norm2 FROM (SELECT *, least(1, 0.05::DOUBLE / (sqrt(sum(norm2) OVER (PARTITION BY bin_idx)) + 1e-12::DOUBLE)) AS k FROM (SELECT asset, bin_idx, a * k AS a, b * k AS b, norm2 * k * k AS norm2 FROM (SELECT asset, bin_idx, a * 1000 AS a, b * 1000 AS b, norm2 * 1e6::DOUBLE AS norm2, least(1, 0.05::DOUBLE / sqrt(5) / (sqrt(norm2) * 1000 + 1e-12::DOUBLE)) AS k FROM fg)))",
        "raw_attack_1step": "SELECT asset, bin_idx, round(a * k * 1e4::DOUBLE, 6) + 0.0 AS a, round(b * k * 1e4::DOUBLE, 6) + 0.0 AS b, round(norm2 * k * k * 1e8::DOUBLE, 6) + 0.0 AS norm2 FROM (SELECT *, least(1, 0.1::DOUBLE / (sqrt(sum(norm2) OVER (PARTITION BY bin_idx)) + 1e-12::DOUBLE)) AS k FROM (SELECT asset, bin_idx, a * k AS a, b * k AS b, norm2 * k * k AS norm2 FROM (SELECT asset, bin_idx, a * 0.025::DOUBLE AS a, b * 0.025::DOUBLE AS b, norm2 * 0.000625::DOUBLE AS norm2, least(1, 0.1::DOUBLE / sqrt(5) / (sqrt(norm2) * 0.025::DOUBLE + 1e-12::DOUBLE)) AS k FROM fg)))",
        "graph_attack_1step": "SELECT src, dst, round(d * CASE WHEN fro > 0.1::DOUBLE THEN 0.1::DOUBLE / (fro + 1e-12::DOUBLE) ELSE 1 END, 8) + 0.0 AS d FROM (SELECT *, sqrt(sum(d * d) OVER ()) AS fro FROM (SELECT gg.src, gg.dst, CASE WHEN gg.src = gg.dst THEN 0.0 ELSE greatest(0, least(1, w + g * (0.1::DOUBLE / 7) / (sqrt(sum(g * g) OVER ()) + 1e-12::DOUBLE))) - w END AS d FROM gg JOIN nsy ON nsy.src = gg.src AND nsy.dst = gg.dst AND nsy.graph = 'return_abs'))",
        "ablation_join": "SELECT tau, feature_robust_choice, graph_robust_choice, " + ", ".join(f"round({v} * 1e6::DOUBLE, 4) + 0.0 AS {v}_ppm" for v in ("best_clean_mse", "feature_robust_clean_mse", "feature_gain", "erm_clean_mse_reference", "graph_robust_clean_mse", "graph_gain", "sensitivity_improvement")) + f" FROM ({_ABLATION})",
        "verdict": f"SELECT tau, round((feature_robust_clean_mse - erm_clean_mse_reference) * 1e6::DOUBLE, 4) + 0.0 AS clean_cost_feature_ppm, round((graph_robust_clean_mse - erm_clean_mse_reference) * 1e6::DOUBLE, 4) + 0.0 AS clean_cost_graph_ppm, CASE WHEN feature_gain > 0 AND graph_gain > 0 THEN 'both' WHEN graph_gain > 0 THEN 'graph' WHEN feature_gain > 0 THEN 'feature' ELSE 'neither' END AS robustness_pays FROM ({_ABLATION})",
    }.items()
}
