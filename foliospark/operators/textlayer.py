"""The text runs of a searchable page: units, plain glyphs, boxes in points, font sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as X

MOST_PT, SPACING, MEAN_WIDTH = 14_000.0, 1.20, 0.5


def page_geometry(pages: DataFrame) -> DataFrame:
    """(doc_id, page_index, width_pt, height_pt, scale): page sizes in points; a missing or zero dpi counts as 300."""
    dpi = F.when(F.col("dpi") > 0, F.col("dpi")).otherwise(300.0)
    by = pages.groupBy("doc_id", "page_index").agg(F.max("width").alias("_w"), F.max("height").alias("_h"), F.max(dpi).alias("_d"))
    size = [F.least(F.lit(MOST_PT), F.col(c) * 72 / F.col("_d")) for c in ("_w", "_h")]
    return by.select("doc_id", "page_index", size[0].alias("width_pt"), size[1].alias("height_pt"), (72 / F.col("_d")).alias("scale"))


def font_size(text: Column, width: Column, height: Column) -> Column:
    """The size at which the text fills its box, no larger than one line of it allows."""
    at_one = F.length(text) * MEAN_WIDTH
    size = F.least(F.sqrt(height * width / (SPACING * at_one)), width / at_one, height / SPACING, F.lit(300.0))
    return F.when((at_one > 0) & (width > 0) & (height > 0), F.greatest(F.lit(0.5), size)).otherwise(1.0)


# Widths of a plain sans-serif font's letters, as parts of the size, by class.
WIDTHS = (("[ijlItf.,:;'|!()\\[\\] ]", 0.28), ("[mwMW@%]", 0.87), ("[A-Z\u00c0-\u00de]", 0.69))
OTHER_WIDTH = 0.55
SHRINK, TRIES, SMALLEST = 0.82, 7, 0.5


def text_width(text: Column) -> Column:
    """The width of a text set at size 1."""
    counts = [F.length(text) - F.length(F.regexp_replace(text, pattern, "")) for pattern, _ in WIDTHS]
    known = sum((n * w for n, (_, w) in zip(counts, WIDTHS, strict=True)), F.lit(0.0))
    return known + (F.length(text) - sum(counts, F.lit(0))) * OTHER_WIDTH


def fitted_size(text: Column, width: Column, height: Column) -> Column:
    """The estimated size, shrunk step by step until the wrapped text is within its box; the smallest one where nothing helps."""
    at_one = text_width(text)
    longest = F.coalesce(F.array_max(F.transform(F.split(text, " "), text_width)), F.lit(0.0))
    start = font_size(text, width, height)
    sizes = F.transform(F.sequence(F.lit(0), F.lit(TRIES - 1)), lambda k: start * F.pow(F.lit(SHRINK), k))
    fits = F.filter(sizes, lambda s: (s >= SMALLEST) & (longest * s <= width) & (F.ceil(at_one * s / width) * s * SPACING <= height))
    return F.coalesce(F.get(fits, F.lit(0)), F.lit(SMALLEST))


def effective_dpi(images: DataFrame) -> DataFrame:
    """(doc_id, page_index, dpi, coverage) of pages' embedded images (doc_id, page_index, image_no, width, height, x0, y0, x1, y1, page_width, page_height; boxes in points).

    The image that covers most of the page counts, the first of equals; its resolution is the larger of both ways. A page whose images have
    no size has 300 and no coverage, as has one without an area.
    """
    across, down = (F.greatest(F.lit(1e-6), F.col(b) - F.col(a)) for a, b in (("x0", "x1"), ("y0", "y1")))
    dpi = F.greatest(F.col("width") / (across / 72), F.col("height") / (down / 72))
    area = F.col("page_width") * F.col("page_height")
    real = (F.col("width") > 0) & (F.col("height") > 0) & F.col("x0").isNotNull() & (area > 0)
    rated = images.withColumn("_c", F.when(real, across * down / area)).withColumn("_d", F.when(real, dpi))
    best = F.max_by("_d", F.when(F.col("_c") > 0, F.struct(F.col("_c").alias("c"), (-F.col("image_no")).alias("n"))))
    by = rated.groupBy("doc_id", "page_index").agg(best.alias("dpi"), F.max("_c").alias("coverage"))
    return by.select("doc_id", "page_index", F.coalesce(F.when(F.col("dpi") > 0, F.col("dpi")), F.lit(300.0)).alias("dpi"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def text_runs(blocks: DataFrame, lines: DataFrame, geometry: DataFrame) -> DataFrame:
    """(doc_id, page_index, block_id, line_no, text, x0, y0, x1, y1, size): a run for each line, or for the block where it has none (line_no -1).

    Boxes are clipped to the page; those under 2 x 1 points, and blank texts, give no run.
    """
    of_line = lines.select("block_id", "line_no", "text", "x0", "y0", "x1", "y1").join(blocks.select("block_id", "doc_id", "page_index"), "block_id")
    rest = blocks.join(lines.select("block_id").distinct(), "block_id", "left_anti").select("block_id", F.lit(-1).alias("line_no"), "text", "x0", "y0", "x1", "y1", "doc_id", "page_index")
    both = of_line.unionByName(rest).withColumn("text", X.squeeze(X.plain_glyphs(F.col("text")))).filter("text <> ''")
    placed = both.join(geometry, ["doc_id", "page_index"])
    for c, most in (("x0", "width_pt"), ("y0", "height_pt"), ("x1", "width_pt"), ("y1", "height_pt")):
        placed = placed.withColumn(c, F.greatest(F.lit(0.0), F.least(F.col(c) * F.col("scale"), F.col(most))))
    kept = placed.filter("x1 - x0 >= 2 AND y1 - y0 >= 1")
    return kept.select("doc_id", "page_index", "block_id", "line_no", "text", "x0", "y0", "x1", "y1", fitted_size(F.col("text"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("size"))
