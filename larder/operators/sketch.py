"""Medians from mergeable quantile sketches, stored by week, where exact ones would gather a hot group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a sketch; its ranks are off by less than ``RANK_ERROR`` of the group with 99 % certainty.
K, RANK_ERROR = 200, 0.0165


def weekly_sketches(rows: DataFrame, value: str, *by: str, k: int = K) -> DataFrame:
    """A sketch of the values of each group and week (some kilobytes, whatever the group's size).

    They are built in the map tasks and merged after the shuffle, so that no task gathers a group.
    """
    kept = rows.where(F.col(value).isNotNull()).select(*by, "d", F.col(value).cast("double").alias("x"))
    return kept.groupBy(*by, "d").agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("x", F.lit(k)).alias("sketch"))


def quantiles(sketches: DataFrame, *by: str, at: tuple[float, ...] = (0.5,)) -> DataFrame:
    """Quantiles of each group over all its weeks, from the weeks' sketches alone: n, then q0, q1, ..."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("merged"))
    return merged.select(*by, "n", *[F.kll_sketch_get_quantile_double("merged", F.lit(q)).alias(f"q{k}") for k, q in enumerate(at)])


def rank_errors(rows: DataFrame, found: DataFrame, value: str, *by: str, at: float = 0.5) -> DataFrame:
    """Approximate quantiles (by, q0, ...) with how far from ``at`` their ranks are, by counting; 0 if ``at`` lies among their copies.

    ``found`` is read once, as a sketch's quantiles may differ between two runs.
    """
    x = F.col(value)
    ranks = rows.where(x.isNotNull()).select(*by, value).join(found, [*by]).groupBy(*found.columns)
    ends = ranks.agg((F.count_if(x < F.col("q0")) / F.count(F.lit(1))).alias("below"), (F.count_if(x <= F.col("q0")) / F.count(F.lit(1))).alias("upto"))
    return ends.select(*found.columns, F.greatest(F.lit(0.0), F.col("below") - at, at - F.col("upto")).alias("error"))
