"""Figures to be cut out of page images: which, where, and under what name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAST_AREA, LEAST_SIDE = 0.01, 16


def figure_crops(blocks: DataFrame, pages: DataFrame, least_area: float = LEAST_AREA) -> DataFrame:
    """(doc_id, block_id, page_index, left, top, right, bottom, name): figures without an image of their own that cover enough of their page.

    Boxes are whole pixels within the page; those under 16 pixels a side are left out. Names number a document's figures through. Figures
    without a position, and of pages without a size, give none.
    """
    sized = blocks.filter("type = 'figure' AND coalesce(image_path, '') = ''").join(pages.select("doc_id", "page_index", "page_width", "page_height"), ["doc_id", "page_index"])
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / F.greatest(F.lit(1.0), F.col("page_width") * F.col("page_height"))
    boxed = sized.filter(area >= least_area).select(
        "doc_id", "block_id", "page_index", "block_order",
        F.greatest(F.lit(0), F.col("x0").cast("int")).alias("left"), F.greatest(F.lit(0), F.col("y0").cast("int")).alias("top"),
        F.least(F.col("page_width"), F.col("x1").cast("int")).alias("right"), F.least(F.col("page_height"), F.col("y1").cast("int")).alias("bottom"),
    )
    kept = boxed.filter((F.col("right") - F.col("left") >= LEAST_SIDE) & (F.col("bottom") - F.col("top") >= LEAST_SIDE))
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("page_index", "block_order", "block_id")) - 1
    name = F.format_string("images/p%04d_%02d.jpg", F.col("page_index"), number)
    return kept.select("doc_id", "block_id", "page_index", "left", "top", "right", "bottom", name.alias("name"))


def with_figures(blocks: DataFrame, crops: DataFrame) -> DataFrame:
    """The blocks, those that are cut out with the name as image_path."""
    named = crops.select("doc_id", "block_id", F.col("name").alias("_name"))
    return blocks.join(named, ["doc_id", "block_id"], "left").withColumn("image_path", F.coalesce("_name", "image_path")).select(*blocks.columns)
