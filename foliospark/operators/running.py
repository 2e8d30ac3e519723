"""Running sums and neighbours over a document's elements, taken by segments of pages, so that no task holds a document.

What a segment needs of the others comes from a row for each segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.operators import assembly

KEY = ("doc_id", "_seg")


def in_segments(els: DataFrame) -> DataFrame:
    return els.withColumn("_seg", F.floor(F.col("seq") / (assembly.PAGE * assembly.SEGMENT_PAGES)))


def running_sums(els: DataFrame, **values: Column) -> DataFrame:
    """The elements (doc_id, seq, ...) with the sums of the values up to each of them, its own included."""
    within, before = W.partitionBy(*KEY).orderBy("seq"), W.partitionBy("doc_id").orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    rows = in_segments(els).withColumns({f"_v_{n}": c.cast("long") for n, c in values.items()})
    sums = rows.groupBy(*KEY).agg(*(F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values))
    offsets = sums.select(*KEY, *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values))
    own = rows.withColumns({n: F.sum(f"_v_{n}").over(within) for n in values})
    return own.join(offsets, [*KEY]).withColumns({n: F.coalesce(n, F.lit(0)) + F.col(f"_o_{n}") for n in values}).select(*els.columns, *values)


def neighbours(els: DataFrame, value: str, before: str, after: str) -> DataFrame:
    """The elements with the value of the one before and the one after; null at a document's ends."""
    within, segments = W.partitionBy(*KEY).orderBy("seq"), W.partitionBy("doc_id").orderBy("_seg")
    rows = in_segments(els).withColumn("_own", F.struct(F.col(value).alias("v")))
    edges = rows.groupBy(*KEY).agg(F.min_by("_own", "seq").alias("_first"), F.max_by("_own", "seq").alias("_last"))
    edges = edges.select(*KEY, F.lag("_last").over(segments).alias("_left"), F.lead("_first").over(segments).alias("_right"))
    near = rows.withColumn("_b", F.lag("_own").over(within)).withColumn("_a", F.lead("_own").over(within)).join(edges, [*KEY])
    return near.withColumn(before, F.coalesce("_b", "_left")["v"]).withColumn(after, F.coalesce("_a", "_right")["v"]).select(*els.columns, before, after)
