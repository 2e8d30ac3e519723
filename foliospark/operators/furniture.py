"""Running heads, feet and page numbers by repetition in the page's bands; headings by form; page numbers by page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as X

FURNITURE = ("header", "footer", "page_number")


def pages_of(ocr_pages: DataFrame) -> DataFrame:
    """(doc_id, page_index, width, height), one row for each page; of repeated rows the largest size."""
    return ocr_pages.groupBy("doc_id", "page_index").agg(F.max("width").alias("page_width"), F.max("height").alias("page_height"))


def mark_furniture(blocks: DataFrame, pages: DataFrame, band: float = 0.09, min_repeat: float = 0.30) -> DataFrame:
    """The blocks with furniture: the type they get, null for others.

    Page numbers need no repetition. A line is head or foot if its repeat key stands in its band of the document max(3, 30 % of
    pages) times. Counts go by aggregation and join, so a long document is no single task. Blocks of pages that are
    not in `pages`, and blocks without text or position, are no furniture.
    """
    sized = blocks.join(pages.select("doc_id", "page_index", "page_height"), ["doc_id", "page_index"], "left")
    h = F.when(F.col("page_height") > 0, F.col("page_height")).otherwise(1)
    where = F.when(F.col("y1") <= h * band, "top").when(F.col("y0") >= h * (1 - band), "bottom")
    flat = F.col("page_height").isNotNull() & ~F.coalesce(F.col("type").isin("figure", "table"), F.lit(False)) & (F.col("y1") - F.col("y0") <= h * 0.06)
    # texts are looked at only in the bands
    key = F.when(flat & where.isNotNull(), X.let(X.strip(F.col("text")), lambda t: F.when(F.length(t).between(1, 120), F.nullif(X.repeat_key(t), F.lit("")))))
    tagged = sized.withColumn("_key", key).withColumn("_band", F.when(F.col("_key").isNotNull(), where))
    counts = tagged.filter("_band IS NOT NULL").groupBy("doc_id", "_band", "_key").agg(F.count("*").alias("_n"))
    need = pages.groupBy("doc_id").agg(F.greatest(F.lit(3), (F.count("*") * min_repeat).cast("int")).alias("_need"))
    often = counts.join(need, "doc_id").filter("_n >= _need").select("doc_id", "_band", "_key", F.lit(True).alias("_often"))
    joined = tagged.join(often, ["doc_id", "_band", "_key"], "left")
    furniture = F.when(F.col("_band").isNull(), F.lit(None).cast("string")).when(X.is_folio(F.col("text")), "page_number").when(F.col("_often"), F.when(F.col("_band") == "top", "header").otherwise("footer"))
    return joined.withColumn("furniture", furniture).select(*blocks.columns, "furniture")


def promote_headings(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """The blocks, short emphatic text blocks as headings with their level."""
    sized = blocks.join(pages.select("doc_id", "page_index", "page_height"), ["doc_id", "page_index"], "left")
    yes = (F.col("type") == "text") & X.is_heading(F.col("text"))
    level = X.heading_level(F.col("text"), F.coalesce("level", F.lit(0)), F.col("y1") - F.col("y0"), F.coalesce("page_height", F.lit(1)))
    judged = sized.withColumn("_yes", F.coalesce(yes, F.lit(False))).withColumn("_level", F.when(F.col("_yes"), level))
    return judged.withColumn("level", F.coalesce("_level", "level")).withColumn("type", F.when(F.col("_yes"), "heading").otherwise(F.col("type"))).select(*blocks.columns)


def folio_map(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_index, folio): the first number, arabic or roman, of each page's first page number block that has one."""
    folio = F.regexp_extract("text", r"(\p{Nd}+|[ivxlcdmIVXLCDM]+)", 1)
    found = blocks.filter(F.col("type") == "page_number").withColumn("folio", folio).filter("folio <> ''")
    return found.groupBy("doc_id", "page_index").agg(F.min_by("folio", F.struct("block_order", "block_id")).alias("folio"))


def page_text(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_index, plain): a page's texts that are no furniture, in order, one to a line. A page's blocks are few."""
    kept = blocks.filter(~F.coalesce(F.col("type").isin(*FURNITURE), F.lit(False)) & (X.strip(F.col("text")) != ""))
    return kept.groupBy("doc_id", "page_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_order", "block_id", "text"))), lambda x: x["text"]), "\n").alias("plain"))


def weak_pages(plain: DataFrame, pages: DataFrame, least_chars: int = 60, share: float = 0.02) -> DataFrame:
    """(doc_id, page_index): pages to be read again: under least_chars of text, where a document has max(2, 2 % of pages) such."""
    lengths = pages.select("doc_id", "page_index").join(plain, ["doc_id", "page_index"], "left").withColumn("_weak", F.coalesce(F.length(X.strip(F.col("plain"))), F.lit(0)) < least_chars)
    gate = lengths.groupBy("doc_id").agg(F.count_if("_weak").alias("_n"), F.count("*").alias("_all")).filter(F.col("_n") >= F.greatest(F.lit(2.0), F.col("_all") * share))
    return lengths.filter("_weak").join(gate.select("doc_id"), "doc_id", "left_semi").select("doc_id", "page_index")


def take_longer(base: DataFrame, other: DataFrame) -> DataFrame:
    """Base pages (doc_id, page_index, plain, engine), replaced by the other reading only where that is strictly longer."""
    o = other.select("doc_id", "page_index", F.col("plain").alias("_plain"), F.col("engine").alias("_engine"))
    better = F.coalesce(F.length(X.strip(F.col("_plain"))) > F.coalesce(F.length(X.strip(F.col("plain"))), F.lit(0)), F.lit(False))
    joined = base.join(o, ["doc_id", "page_index"], "left")
    return joined.select("doc_id", "page_index", F.when(better, F.col("_plain")).otherwise(F.col("plain")).alias("plain"), F.when(better, F.concat_ws("+", "engine", "_engine")).otherwise(F.col("engine")).alias("engine"))
