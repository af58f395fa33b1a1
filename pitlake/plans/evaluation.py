"""Evaluation of factors from the command line, and a panel with planted factors to try it on.

``python -m pitlake.plans.evaluation demo|gates|ladder|reversal|profile|decoupling|all --panel PATH | --tables FOLDER [--factor NAME ...]``
"""

from __future__ import annotations

import argparse
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitlake.operators import evaluate
from pitlake.plans.views import table
from pitlake.sources.panels import read_panel

#: Planted factors of ``planted_panel`` and whether each should survive the reversal retest.
VERDICTS = {"premium": True, "fading": False, "mirror": False, "shadow": False, "stepped": False}
FACTORS = list(VERDICTS)
CONTROLS = ["discount", "lot", "price", "frozen"]


def _noise(name: str) -> Column:
    """A standard normal number for each code and date: two hashes, turned by Box and Muller's rule."""
    u = lambda salt: (F.pmod(F.xxhash64(F.lit(f"{name}{salt}"), "code", "date"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return F.sqrt(-2 * F.ln(u("a"))) * F.cos(2 * math.pi * u("b"))


def planted_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly panel of sold parts with planted factors; controls come from the tables, noise from hashes of the keys.

    ``premium`` earns in both eras; ``fading`` only in the first, train; ``mirror`` is the past return turned round, which
    future returns partly undo; ``shadow`` is the discount, which earns, with little else; ``stepped`` has two values, so that it cannot be grouped.
    The control ``frozen`` does not vary in the train era, and ``price`` is the part's price at every date.
    """
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    sold = li.groupBy(F.col("l_partkey").alias("code"), F.to_date(F.trunc("l_shipdate", "quarter")).alias("date"))
    rows = sold.agg(F.avg("l_discount").alias("discount"), F.avg("l_quantity").alias("lot")).join(part.select(F.col("p_partkey").alias("code"), F.col("p_retailprice").alias("price")), "code")
    over = Window.partitionBy("date")
    rows = rows.withColumn("_d", (F.col("discount") - F.avg("discount").over(over)) / F.stddev_samp("discount").over(over))
    train = F.col("date") < F.lit("1998-07-01").cast("date")
    rows = rows.withColumns({"era": F.when(train, "train").otherwise("test"), "past_return": 0.06 * _noise("past"), "premium": _noise("premium"), "fading": _noise("fading")})
    rows = rows.withColumns({
        "mirror": -F.col("past_return") + 0.006 * _noise("mirror"), "shadow": F.col("_d") + 0.1 * _noise("shadow"), "stepped": (F.col("premium") > 0.4).cast("double"), "frozen": F.when(train, 3.5).otherwise(F.col("lot")),
        "forward_return": 0.02 * F.col("premium") + F.when(train, 0.03).otherwise(0.0) * F.col("fading") - 0.35 * F.col("past_return") + 0.012 * F.col("_d") + 0.04 * _noise("left"),
    })
    return rows.drop("_d")


def _stack(rows: list[tuple[str, DataFrame]]) -> DataFrame:
    out = None
    for name, df in rows:
        one = df.select(F.lit(name).alias("factor"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def gates(panel: DataFrame, factors: list[str], controls: list[str]) -> dict[str, DataFrame]:
    """Which factors can be grouped, and which controls vary, before anything is scored."""
    return {
        "groupability": _stack([(f, evaluate.groupability(panel, f)) for f in factors]),
        "constant controls": evaluate.control_audit(panel, controls).where("constant"),
        "collinear controls": evaluate.collinear_controls(panel, controls),
    }


def ladder(panel: DataFrame, factors: list[str], controls: list[str]) -> dict[str, DataFrame]:
    layers = [("none", []), ("styles", controls[:4]), ("all", controls[4:])]
    return {"ablation ladder": _stack([(f, evaluate.ablation_ladder(panel, f, layers)) for f in factors])}


def reversal(panel: DataFrame, factors: list[str], controls: list[str], past: str = "past_return") -> dict[str, DataFrame]:
    return {"reversal retest": _stack([(f, evaluate.reversal_retest(panel, f, past, controls, len(factors))) for f in factors if f != past])}


def profile(panel: DataFrame, factors: list[str], controls: list[str]) -> dict[str, DataFrame]:
    return {"quantile profile": _stack([(f, evaluate.quantile_profile(panel, f)) for f in factors])}


def decoupling(panel: DataFrame, factors: list[str], controls: list[str]) -> dict[str, DataFrame]:
    """Whether what a factor ranks is also earned by its top bucket."""
    return {"decoupling": _stack([(f, evaluate.decoupling(panel, f)) for f in factors])}


REPORTS = {"gates": gates, "ladder": ladder, "reversal": reversal, "profile": profile, "decoupling": decoupling}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser()
    p.add_argument("report", choices=["demo", "all", *REPORTS])
    p.add_argument("--panel", help="parquet or CSV")
    p.add_argument("--tables", help="folder of the standard tables, from which the planted panel is made")
    p.add_argument("--factor", action="append")
    p.add_argument("--control", action="append")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if not (a.panel or a.tables) or (a.report == "demo" and not a.tables):
        p.error("--panel or --tables is needed, --tables for demo")
    panel = read_panel(spark, a.panel) if a.panel and a.report != "demo" else planted_panel(spark, a.tables)
    panel = panel.cache()
    try:
        for name in REPORTS if a.report in ("demo", "all") else [a.report]:
            for title, df in REPORTS[name](panel, a.factor or FACTORS, a.control or CONTROLS).items():
                print(title)
                df.show(200, truncate=False)
    finally:
        panel.unpersist()


if __name__ == "__main__":
    main()
