"""Recognised blocks as a stream: pages are assembled as they come and written once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions import text as X
from foliospark.operators.furniture import FURNITURE


def block_stream(spark: SparkSession, folder: str, schema: T.StructType, files_at_once: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def line_stream(blocks: DataFrame) -> DataFrame:
    """A stateless stage: content blocks with their normalised, rejoined and joined text."""
    body = X.join_lines(X.dehyphenate(X.normalise(F.col("text"))))
    return blocks.filter(~F.coalesce(F.col("type").isin(*FURNITURE), F.lit(False))).select("doc_id", "page_index", "block_id", "block_order", "type", body.alias("text")).filter("text <> ''")


def page_counts(pages: DataFrame, time: str = "recognised_at", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(start, n_pages): pages recognised in each window; rows that come later than `late` after the newest are dropped by the watermark, repeated pages count once."""
    once = pages.withWatermark(time, late).dropDuplicatesWithinWatermark(["page_id"])
    return once.groupBy(F.window(time, window)).agg(F.count("*").alias("n_pages")).select(F.col("window.start").alias("start"), "n_pages")


def write_pages(stream: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """Starts writing; a restart goes on after the last committed batch, and a batch done again replaces itself by its number."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
