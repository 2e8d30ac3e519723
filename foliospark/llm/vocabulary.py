"""Exact word counts joined to the texts that ask for them, without a table of the corpus on the driver or in a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import cut

#: Bytes of text in a bucket, about.
BUCKET = 1 << 20


def in_buckets(rows: DataFrame, text: str = "text") -> DataFrame:
    """The rows, written once, with the number of a bucket of about BUCKET bytes of text in the column `bucket`."""
    rows = cut(rows)
    n = max(1, -(-(rows.agg(F.sum(F.octet_length(text))).first()[0] or 0) // BUCKET))
    return rows.withColumn("bucket", F.pmod(F.xxhash64(text, F.monotonically_increasing_id()), F.lit(n)).cast("int"))


def informed(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows, which have (bucket, asks), by bucket; before each bucket's the counts of the words it asks about, as rows with told = true.

    `counts` has (word, n) and may have more columns. The result has told, counts' columns and the rows' own but asks; partitions hold whole buckets.
    """
    asked = rows.select("bucket", F.explode("asks").alias("word")).distinct()
    told = asked.join(counts, "word").withColumn("told", F.lit(True))
    both = rows.drop("asks").withColumn("told", F.lit(False)).unionByName(told, allowMissingColumns=True)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that few bytes of much work aren't put into few tasks
    return both.repartition(parts, "bucket").sortWithinPartitions("bucket", F.desc("told"))
