"""Aggregates that Spark lacks in the wanted form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Ranges into which a group's values are cut; a task ranks one of them.
RANGES = 64


def upper_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """The middle value of each group, the upper one of an even number. Nulls don't count; a group of nulls is left out.

    Values are counted first with map-side combine, so a hot group moves no more rows than it has distinct values. Approximate quantiles cut these
    into ranges, exact counts of the ranges find the one that has the middle, and only its values are ranked, so no task sorts a whole group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.struct(*keys).alias("_key"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    cuts = F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)], 1000)
    spans = counts.groupBy("_key").agg(cuts.alias("_cuts"), F.sum("_n").alias("_all"))
    placed = counts.join(spans, "_key").select("_key", "_v", "_n", "_all", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_at"))
    ranges = placed.groupBy("_key", "_all", "_at").agg(F.sum("_n").alias("_m"))
    before = F.coalesce(F.sum("_m").over(W.partitionBy("_key").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    half = F.floor(F.col("_all") / 2)
    middle = ranges.withColumn("_before", before).filter((F.col("_before") <= half) & (F.col("_before") + F.col("_m") > half)).select("_key", "_at", "_before")
    upto = F.col("_before") + F.sum("_n").over(W.partitionBy("_key").orderBy("_v"))
    ranked = placed.join(middle, ["_key", "_at"]).withColumn("_upto", upto)
    return ranked.filter(F.col("_upto") > half).groupBy("_key").agg(F.min("_v").alias(name)).select("_key.*", name)


def evenly_spaced(index: str, total: str, n: int = 12):  # noqa: ANN201
    """Whether a row's 0-based index is one of n evenly spaced ones out of total."""
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col(total) / n).cast("int"))
    return F.array_contains(at, F.col(index).cast("int"))
