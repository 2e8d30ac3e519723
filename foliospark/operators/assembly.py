"""From ordered blocks and native pages to stitched elements.

An element has doc_id, seq (a position that orders a document's elements), type, text, level, image_path, html and page_index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions import text as X
from foliospark.operators import html
from foliospark.operators.furniture import FURNITURE, mark_furniture, promote_headings
from foliospark.session import cut

CONTENT = ("text", "list", "table", "figure", "formula", "heading", "caption", "footnote")
OPEN_END = r"[\p{L}\p{N}\-\x{2010}\x{2011}\x{ad}\x{2013},;]$"
#: Positions on a page; a page's blocks are numbered below this.
PAGE = 100_000
#: Pages of a document that one task stitches.
SEGMENT_PAGES = 64


def page_breaks(pages: DataFrame) -> DataFrame:
    """An element for each page's beginning."""
    return pages.select("doc_id", (F.col("page_index").cast("long") * PAGE).alias("seq"), F.lit("page_break").alias("type"), F.lit("").alias("text"), *_empty(), "page_index").distinct()


def _empty() -> list[Column]:
    return [F.lit(0).alias("level"), F.lit(None).cast("string").alias("image_path"), F.lit(None).cast("string").alias("html")]


def content(blocks: DataFrame, pages: DataFrame, furniture: bool = True, headings: bool = True) -> DataFrame:
    """Pages' content in order: lines joined, words rejoined in running text, blanks left out.

    Ties in block_order go by block_id. seq is page_index * PAGE + the block's place, so a document needs no pass over all its rows. Places are
    counted before anything is filtered: the window keeps Catalyst from pushing filters, with the whole labelling in them, below.
    """
    b = blocks
    if furniture:
        b = mark_furniture(b, pages).withColumn("type", F.coalesce("furniture", "type")).drop("furniture")
    if headings:
        b = promote_headings(b, pages)
    b = b.withColumn("_place", F.row_number().over(W.partitionBy("doc_id", "page_index").orderBy("block_order", "block_id")))
    kind = F.col("type")
    b = b.filter(~F.coalesce(kind.isin(*FURNITURE), F.lit(False))).withColumn("_text", X.normalise(F.coalesce("text", F.lit(""))))
    text = F.col("_text")
    body = F.when(kind.isin("table", "figure", "formula"), text).when(kind.isin("heading", "caption", "footnote"), X.join_lines(text)).otherwise(X.join_lines(X.dehyphenate(text)))
    # a body is blank just if its text is, so the filter is on the input
    kept = b.filter(F.when(kind == "figure", F.col("image_path").isNotNull()).when(kind.isin("table", "formula"), F.lit(True)).otherwise(F.col("text").rlike(X.SHOWN)))
    return kept.select(
        "doc_id",
        (F.col("page_index").cast("long") * PAGE + F.col("_place")).alias("seq"),
        F.when(kind.isin(*CONTENT), kind).otherwise("text").alias("type"),
        body.alias("text"),
        F.when(kind == "heading", F.when(F.col("level") != 0, F.col("level")).otherwise(2)).otherwise(0).cast("int").alias("level"),
        F.when(kind == "figure", F.col("image_path")).alias("image_path"),
        F.when(kind.isin("table", "formula"), F.col("html")).alias("html"),
        "page_index",
    )


def elements(blocks: DataFrame, pages: DataFrame, furniture: bool = True, headings: bool = True) -> DataFrame:
    """A page break for each page, and the content."""
    return page_breaks(pages).unionByName(content(blocks, pages, furniture, headings))


def paragraph_starts(els: DataFrame, least: int) -> DataFrame:
    """(doc_id, seq, _start): for each element the place where its paragraph starts.

    A text is merged if it goes on from the one before and that, or a merged text before it, is long enough. A document is cut into segments of SEGMENT_PAGES pages;
    windows run over segments, and what a segment needs of those before it (its last element, whether a run of merges is open and
    long enough, where the last paragraph started) comes from a row for each segment, so no task holds a document.
    """
    t = X.strip_right(F.col("text"))
    is_text = F.col("type") == "text"
    row = els.select(
        "doc_id", "seq", F.floor(F.col("seq") / (PAGE * SEGMENT_PAGES)).alias("_seg"), F.coalesce(is_text, F.lit(False)).alias("_t"),
        F.coalesce(is_text & t.rlike(OPEN_END), F.lit(False)).alias("_open"), F.coalesce(F.length(t) >= least, F.lit(False)).alias("_long"),
        F.coalesce(is_text & (X.strip(F.col("text")) != "") & ~X.is_list_start(X.strip(F.col("text"))), F.lit(False)).alias("_joins"),
    )
    key = ["doc_id", "_seg"]
    within, segments = W.partitionBy(*key).orderBy("seq"), W.partitionBy("doc_id").orderBy("_seg")
    own = F.struct("_open", "_long")
    row = cut(row.withColumn("_prev", F.lag(own).over(within)).withColumn("_own", own), costly=False)
    ends = row.groupBy(*key).agg(F.max_by("_own", "seq").alias("_last")).withColumn("_carried", F.lag("_last").over(segments)).drop("_last")
    row = row.join(ends, key).withColumn("_prev", F.coalesce("_prev", "_carried"))
    a = F.coalesce(F.col("_joins") & F.col("_prev._open"), F.lit(False))
    row = row.select(*key, "seq", a.alias("_a"), (a & F.coalesce(F.col("_prev._long"), F.lit(False))).alias("_b"))
    row = row.withColumn("_island", F.sum(F.when(F.col("_a"), 0).otherwise(1)).over(within))
    row = cut(row.withColumn("_seen", F.max("_b").over(W.partitionBy(*key, "_island").orderBy("seq"))), costly=False)
    breaks = row.groupBy(*key).agg(F.max(~F.col("_a")).alias("_breaks"), F.max_by("_seen", "seq").alias("_seen_last"))
    breaks = breaks.withColumn("_group", F.sum(F.col("_breaks").cast("int")).over(segments))
    breaks = breaks.withColumn("_state", F.max("_seen_last").over(W.partitionBy("doc_id", "_group").orderBy("_seg"))).withColumn("_state", F.lag("_state").over(segments)).select(*key, "_state")
    goes = F.col("_a") & (F.col("_seen") | ((F.col("_island") == 0) & F.coalesce("_state", F.lit(False))))
    row = row.join(breaks, key).select(*key, "seq", F.when(~goes, F.col("seq")).alias("_new"))
    row = cut(row.withColumn("_start", F.last("_new", ignorenulls=True).over(within)), costly=False)
    last = row.groupBy(*key).agg(F.max("_new").alias("_end"))
    last = last.withColumn("_from", F.last("_end", ignorenulls=True).over(segments.rowsBetween(W.unboundedPreceding, -1))).drop("_end")
    return row.join(last, key).select("doc_id", "seq", F.coalesce("_start", "_from").alias("_start"))


def stitch(els: DataFrame, breaks: DataFrame | None = None, least: int = 40) -> DataFrame:
    """Paragraphs split across columns and pages put together; page breaks stay where they are.

    A paragraph takes the seq of its first part; pages are all pages of its parts. The elements are written once to the checkpoint folder, as they are
    read twice: for where paragraphs start, and to put them together. No row is collected into one value but a paragraph's parts.
    Page breaks are taken out of els, or given apart.
    """
    els = cut(els)
    here = els.filter("type <> 'page_break'") if breaks is None else els
    numbered = here.join(paragraph_starts(here, least), ["doc_id", "seq"])
    part = F.struct("seq", "text", "page_index")
    merged = numbered.groupBy("doc_id", F.col("_start").alias("seq")).agg(
        F.min_by("type", "seq").alias("type"),
        F.array_sort(F.collect_list(part)).alias("_parts"),
        F.min_by("level", "seq").alias("level"),
        F.min_by("image_path", "seq").alias("image_path"),
        F.min_by("html", "seq").alias("html"),
    )

    def glue(done: Column, x: Column) -> Column:
        return X.let(F.struct(X.strip_right(done).alias("tail"), X.strip_left(x["text"]).alias("head")), joined)

    def joined(z: Column) -> Column:
        tail, head = z["tail"], z["head"]
        broken = tail.rlike(f"[{X.HYPHENS}]$") & head.rlike(r"^\p{Ll}")
        return F.when(broken, F.concat(F.substring(tail, F.lit(1), F.length(tail) - 1), head)).otherwise(F.concat(tail, F.lit(" "), head))

    parts = F.col("_parts")
    text = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, 1)["text"], glue)
    pages = F.array_sort(F.array_distinct(F.transform(parts, lambda x: x["page_index"])))
    out = merged.select("doc_id", "seq", "type", text.alias("text"), "level", "image_path", "html", pages.alias("pages"), F.size("_parts").alias("n_parts"))
    apart = els.filter("type = 'page_break'") if breaks is None else breaks
    breaks = apart.select("doc_id", "seq", "type", "text", "level", "image_path", "html", F.array("page_index").alias("pages"), F.lit(1).alias("n_parts"))
    return out.unionByName(breaks)


def native_content(pages: DataFrame) -> DataFrame:
    """Native pages (doc_id, page_index, native_text) cut at blank lines, normalised, words rejoined, lines joined.

    It reads the plain text only; native_elements sends pages with HTML through foliospark.operators.html instead. Repeated pages should be dropped before.
    """
    paras = pages.select("doc_id", "page_index", F.posexplode(F.split(X.strip(F.coalesce("native_text", F.lit(""))), f"\\n{X.WS}*\\n")).alias("_i", "_t"))
    body = X.join_lines(X.normalise(X.dehyphenate(F.col("_t"))))
    return paras.filter(F.col("_t").rlike(X.SHOWN)).select("doc_id", (F.col("page_index").cast("long") * PAGE + 1 + F.col("_i")).alias("seq"), F.lit("text").alias("type"), body.alias("text"), *_empty(), "page_index")


def native_elements(pages: DataFrame) -> DataFrame:
    """The content of native pages (doc_id, page_index, native_text, native_html): the HTML's elements where a page has any, else its plain text's.

    HTML gives its elements normalised with lines joined, and those left without text go, but for figures. Repeated pages should be dropped before.
    """
    marked = F.coalesce(F.col("native_html") != "", F.lit(False))
    of_html = html.html_elements(pages.filter(marked)).withColumn("text", X.join_lines(X.normalise(F.col("text")))).filter("text <> '' OR type = 'figure'")
    return of_html.unionByName(native_content(pages.filter(~marked)))


def infer_title(meta: DataFrame, els: DataFrame, first: int = 40) -> DataFrame:
    """(doc_id, title): where the title is missing or a placeholder, the first heading of 3 to 120 characters among the first elements, else the file's stem."""
    name = F.regexp_extract("source_file", r"([^/\\]*)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    docs = meta.groupBy("doc_id").agg(F.min("title").alias("title"), F.min("source_file").alias("source_file"))
    at = els.withColumn("_r", F.row_number().over(W.partitionBy("doc_id").orderBy("seq"))).filter(F.col("_r") <= first)
    heading = at.filter("type = 'heading'").withColumn("_h", X.squeeze(F.col("text"))).filter(F.length("_h").between(3, 120)).groupBy("doc_id").agg(F.min_by("_h", "seq").alias("_h"))
    given = X.strip(F.coalesce("title", F.lit("")))
    missing = (given == "") | F.lower(given).isin("untitled", "unknown") | (F.lower(given) == F.lower(stem)) | (F.lower(given) == F.lower(name))
    return docs.join(heading, "doc_id", "left").select("doc_id", F.when(F.coalesce(missing, F.lit(True)), F.coalesce("_h", F.when(given != "", F.col("title")), stem)).otherwise(F.col("title")).alias("title"))
