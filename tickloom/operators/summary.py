"""Selection and comparison of results: best rows, robust against plain models, verdicts, checks, report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_by(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key; give a last column that breaks ties as they stand."""
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_i = 1").drop("_i")


def robust_vs_plain(rows: DataFrame) -> DataFrame:
    """Per tau the plain model (rho 0) and the robust one that loses least. rows: tau, rho, r_adv, clean_mse, deg_mse, sensitivity."""
    plain = rows.filter("rho = 0").select("tau", F.col("clean_mse").alias("erm_clean_mse"), F.col("deg_mse").alias("erm_deg_mse"), F.col("sensitivity").alias("erm_sensitivity"))
    best = best_by(rows.filter("rho > 0"), ["tau"], "deg_mse", "rho", "r_adv")
    x = best.join(plain, "tau")
    return x.select("tau", "erm_clean_mse", F.col("clean_mse").alias("robust_clean_mse"), "erm_deg_mse", F.col("deg_mse").alias("robust_deg_mse"), (F.col("erm_deg_mse") - F.col("deg_mse")).alias("deg_mse_improvement"), (F.col("erm_sensitivity") - F.col("sensitivity")).alias("sensitivity_improvement"), F.concat(F.lit("rho="), F.col("rho").cast("string"), F.lit(",R="), F.col("r_adv").cast("string")).alias("robust_choice"))


def ablation(base: DataFrame, feature: DataFrame, graph: DataFrame) -> DataFrame:
    """Three summaries side by side per tau."""
    f = feature.select("tau", F.col("robust_clean_mse").alias("feature_robust_clean_mse"), F.col("deg_mse_improvement").alias("feature_gain"), F.col("robust_choice").alias("feature_robust_choice"))
    g = graph.select("tau", F.col("erm_clean_mse").alias("erm_clean_mse_reference"), F.col("robust_clean_mse").alias("graph_robust_clean_mse"), F.col("deg_mse_improvement").alias("graph_gain"), "sensitivity_improvement", F.col("robust_choice").alias("graph_robust_choice"))
    return base.join(f, "tau").join(g, "tau")


def verdicts(table: DataFrame) -> DataFrame:
    """Whose robust models lose less under attack than the plain one, and what they cost without one."""
    f, g = F.col("feature_gain") > 0, F.col("graph_gain") > 0
    text = F.when(f & g, "both").when(g, "graph").when(f, "feature").otherwise("neither")
    cost = lambda kind: (F.col(f"{kind}_robust_clean_mse") - F.col("erm_clean_mse_reference")).alias(f"clean_cost_{kind}")
    return table.select("tau", cost("feature"), cost("graph"), text.alias("robustness_pays"))


def cell(value: object) -> str:
    """Report format: six digits in scientific form for very small or large numbers, else six decimals."""
    if isinstance(value, bool) or not isinstance(value, float):
        return str(value)
    return f"{value:.6g}" if value != 0 and (abs(value) < 1e-3 or abs(value) > 1e4) else f"{value:.6f}"


def markdown(rows: DataFrame, columns: list[str]) -> str:
    """A Markdown table of a result of a few rows (it comes to the driver)."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows.select(columns).collect()])
