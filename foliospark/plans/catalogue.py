"""The registered queries of the library's own operators, over whole tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions import aggregates, similarity
from foliospark.functions import text as X
from foliospark import config
from foliospark.operators import assembly, chunking, correction, figures, furniture, html, layout, quality, textlayer
from foliospark.plans import pipeline, render
from foliospark.session import table as t
from foliospark.sources import files, ingest

Query = Callable[[SparkSession, str], DataFrame]


def blocks(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "blocks").dropDuplicates(["block_id"])


def lines(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "block_lines").dropDuplicates(["block_id", "line_no"])


def pages(s: SparkSession, d: str) -> DataFrame:
    return furniture.pages_of(t(s, d, "ocr_pages"))


def native(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "source_pages").filter("native_text IS NOT NULL").select("doc_id", "page_index", "page_id", "native_text").dropDuplicates(["page_id"])


def native_pages(s: SparkSession, d: str) -> DataFrame:
    """Every native page, whether it has plain text, HTML or both."""
    some = t(s, d, "source_pages").filter("native_text IS NOT NULL OR native_html IS NOT NULL")
    return some.select("doc_id", "page_index", "page_id", "native_text", "native_html").dropDuplicates(["page_id"])


def native_stitched(s: SparkSession, d: str) -> DataFrame:
    p = native_pages(s, d)
    return assembly.stitch(assembly.native_elements(p), assembly.page_breaks(p))


def elements(s: SparkSession, d: str) -> DataFrame:
    return assembly.elements(blocks(s, d), pages(s, d))


def stitched(s: SparkSession, d: str) -> DataFrame:
    p = pages(s, d)
    return assembly.stitch(assembly.content(blocks(s, d), p), assembly.page_breaks(p))


def _by_block(f: Callable, name: str) -> Query:
    return lambda s, d: blocks(s, d).filter("text IS NOT NULL").select("block_id", f(F.col("text")).alias(name))


def repeat_key_counts(s: SparkSession, d: str) -> DataFrame:
    return lines(s, d).filter("text IS NOT NULL").select(X.repeat_key(F.col("text")).alias("repeat_key")).groupBy("repeat_key").agg(F.count("*").alias("n"))


def heading_promote(s: SparkSession, d: str) -> DataFrame:
    got = furniture.promote_headings(blocks(s, d), pages(s, d))
    return got.filter("type = 'heading'").select("block_id", F.col("level").cast("int").alias("level"))


def furniture_labels(s: SparkSession, d: str) -> DataFrame:
    return furniture.mark_furniture(blocks(s, d), pages(s, d)).filter("furniture IS NOT NULL").select("block_id", "furniture")


def furniture_stats(s: SparkSession, d: str) -> DataFrame:
    got = furniture.mark_furniture(blocks(s, d), pages(s, d)).groupBy("doc_id")
    return got.agg(*(F.count_if(F.coalesce(F.col("furniture") == k, F.lit(False))).alias(f"n_{k}") for k in furniture.FURNITURE))


def weak_page_gate(s: SparkSession, d: str) -> DataFrame:
    return furniture.weak_pages(furniture.page_text(blocks(s, d)), pages(s, d), least_chars=400)


def take_longer(s: SparkSession, d: str) -> DataFrame:
    """The second reading here is the pages' lines, of which weak engines keep few."""
    base = furniture.page_text(blocks(s, d)).withColumn("engine", F.lit("layout"))
    of_lines = lines(s, d).filter("text IS NOT NULL").join(blocks(s, d).select("block_id", "page_index"), "block_id")
    other = of_lines.groupBy("doc_id", "page_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_id", "line_no", "text"))), lambda x: x["text"]), "\n").alias("plain")).withColumn("engine", F.lit("lines"))
    return furniture.take_longer(base, other).select("doc_id", "page_index", F.length("plain").alias("n_chars"), "engine")


def stitch_paragraphs(s: SparkSession, d: str) -> DataFrame:
    return stitched(s, d).filter("type <> 'page_break'").select("doc_id", "seq", "type", "text", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), F.col("n_parts").cast("int").alias("n_parts"))


def native_assembly(s: SparkSession, d: str) -> DataFrame:
    """Pages' plain text alone, as SQL can express it; native_documents has all native pages."""
    n = native(s, d)
    got = assembly.stitch(assembly.native_content(n), assembly.page_breaks(n))
    return got.groupBy("doc_id").agg(F.count_if(F.col("type") == "text").alias("n_paragraphs"), F.count_if(F.col("type") == "page_break").alias("n_pages"), F.sum(X.word_count(F.col("text"))).cast("long").alias("n_words"))


def native_documents(s: SparkSession, d: str) -> DataFrame:
    """Elements and words of every native document, from HTML where a page has it, else from plain text."""
    kind = F.col("type")
    return native_stitched(s, d).groupBy("doc_id").agg(
        F.count_if(kind == "page_break").alias("n_pages"),
        F.count_if(kind == "heading").alias("n_headings"),
        F.count_if(kind == "figure").alias("n_figures"),
        F.count_if(~kind.isin("page_break", "heading", "figure")).alias("n_paragraphs"),
        F.sum(X.word_count(F.col("text"))).cast("long").alias("n_words"),
    )


def infer_titles(s: SparkSession, d: str) -> DataFrame:
    return assembly.infer_title(t(s, d, "document_meta"), elements(s, d))


def guard_pairs(s: SparkSession, d: str) -> DataFrame:
    """Each block's text against the one after it on the page: few are alike, so every reason occurs."""
    nxt = F.lead("text").over(W.partitionBy("doc_id", "page_index").orderBy("block_order", "block_id"))
    return blocks(s, d).filter("type = 'text' AND text IS NOT NULL").select("block_id", F.col("text").alias("original"), F.coalesce(nxt, F.col("text")).alias("candidate"))


def guard_bound(s: SparkSession, d: str) -> DataFrame:
    return guard_pairs(s, d).select("block_id", F.round(X.similarity_bound(F.col("original"), F.col("candidate")), 6).alias("bound"))


def guard_reasons(s: SparkSession, d: str) -> DataFrame:
    return guard_pairs(s, d).select("block_id", X.guard_reason(F.col("original"), F.col("candidate")).alias("reason"))


def guard_similarity(s: SparkSession, d: str) -> DataFrame:
    return similarity.guarded(guard_pairs(s, d)).select("block_id", "similarity", "reason")


def correction_pass(s: SparkSession, d: str) -> DataFrame:
    return correction.correction_stats(correction.correct(stitched(s, d))[1])


def reason_histogram(s: SparkSession, d: str) -> DataFrame:
    runs = t(s, d, "clean_stats").dropDuplicates(["run_id"])
    return runs.select(F.explode("reasons").alias("reason", "n")).groupBy("reason").agg(F.sum("n").cast("long").alias("n"), F.count("*").alias("n_runs"))


def page_metrics_score(s: SparkSession, d: str) -> DataFrame:
    """Metrics stand in from page sizes, angles and resolutions, as images aren't there."""
    p = t(s, d, "source_pages").dropDuplicates(["page_id"]).join(t(s, d, "ocr_pages").groupBy("page_id").agg(F.max("deskew_angle").alias("skew_deg")), "page_id", "left")
    m = p.select("page_id", (F.col("width") % 130).cast("double").alias("sharpness"), (F.col("height") % 61).cast("double").alias("contrast"), "skew_deg", (F.col("page_index") % 13).cast("double").alias("noise"), (F.col("width") % 71).cast("double").alias("illumination_range"), ((F.col("height") % 20) / 100.0).alias("border_ratio"))
    score = quality.quality_score(F.col("sharpness"), F.col("contrast"), F.col("skew_deg"), F.col("noise"), F.col("illumination_range"))
    return m.select("page_id", F.round(score, 6).alias("score"), F.array_join(quality.planned_actions(), ",").alias("actions"))


def upper_medians(s: SparkSession, d: str) -> DataFrame:
    return aggregates.upper_median(t(s, d, "blocks").dropDuplicates(["block_id"]), ["type"], "confidence")


def reading_order(s: SparkSession, d: str) -> DataFrame:
    return layout.reading_order(blocks(s, d), pages(s, d))


def method_histogram(s: SparkSession, d: str) -> DataFrame:
    """How the order of how many pages was found."""
    return reading_order(s, d).select("doc_id", "page_index", "method").distinct().groupBy("method").agg(F.count("*").alias("n_pages"))


def column_detect(s: SparkSession, d: str) -> DataFrame:
    return reading_order(s, d).select("doc_id", "page_index", "n_columns", "confidence").distinct()


def xy_cut_order(s: SparkSession, d: str) -> DataFrame:
    """Every page ordered by cuts, whatever order its engine gave."""
    return layout.reading_order(blocks(s, d), pages(s, d), prefer_engine=False).select("doc_id", "page_index", "block_id", "new_order")


def order_checks(s: SparkSession, d: str) -> DataFrame:
    """The given order held against the columns that are detected."""
    columns = reading_order(s, d).select("block_id", F.col("new_column").alias("column_no"))
    return layout.column_switches(blocks(s, d).drop("column_no").join(columns, "block_id"))


def noted_methods(s: SparkSession, d: str) -> DataFrame:
    """The methods that recognised pages carry in their notes."""
    by_page = t(s, d, "ocr_pages").dropDuplicates(["page_id"]).select(F.try_element_at("notes", F.lit("order_method")).alias("method"))
    return by_page.filter("method IS NOT NULL").groupBy("method").agg(F.count("*").alias("n_pages"))


def axis_split(s: SparkSession, d: str) -> DataFrame:
    return layout.split_axis(blocks(s, d), "y0", "y1", 2339 * 0.012).select("block_id", F.col("axis_group").cast("int").alias("axis_group"))


def largest_gaps(s: SparkSession, d: str) -> DataFrame:
    return layout.largest_gap(blocks(s, d), "y0", "y1")


def order_validation(s: SparkSession, d: str) -> DataFrame:
    return layout.column_switches(blocks(s, d).withColumn("column_no", (F.col("block_order") % 3).cast("int")))


def group_lines(s: SparkSession, d: str) -> DataFrame:
    of_page = lines(s, d).join(blocks(s, d).select("block_id", "page_index"), "block_id")
    return layout.group_lines(of_page.withColumn("line_id", F.col("block_id") * 10_000 + F.col("line_no")), pages(s, d))


def chapters(s: SparkSession, d: str) -> DataFrame:
    return chunking.split_chapters(stitched(s, d)).groupBy("doc_id", "chapter").agg(F.min("title").alias("title"), F.count("*").alias("n_elements"))


def native_chapters(s: SparkSession, d: str) -> DataFrame:
    return chunking.split_chapters(native_stitched(s, d)).groupBy("doc_id", "chapter").agg(F.min("title").alias("title"), F.count("*").alias("n_elements"))


def html_elements(s: SparkSession, d: str) -> DataFrame:
    some = t(s, d, "source_pages").filter("native_html IS NOT NULL").select("doc_id", "page_index", "page_id", "native_html").dropDuplicates(["page_id"])
    return html.html_elements(some).select("doc_id", "seq", "type", "text", "level")


def latest_meta(s: SparkSession, d: str) -> DataFrame:
    """A document's newest metadata."""
    own = ("title", "author", "language", "source_file")
    newest = F.max_by(F.struct(*own), F.struct("ingested_at", *(F.coalesce(c, F.lit("")) for c in own)))
    return t(s, d, "document_meta").groupBy("doc_id").agg(newest.alias("_m")).select("doc_id", "_m.*")


def front_matter(s: SparkSession, d: str) -> DataFrame:
    """The heads of all documents' Markdown, with the titles they were given."""
    n_pages = t(s, d, "source_pages").groupBy("doc_id").agg(F.countDistinct("page_index").alias("pages"))
    return render.markdown_heads(latest_meta(s, d).join(n_pages, "doc_id"), "2025-01-01")


def markdown(s: SparkSession, d: str) -> DataFrame:
    """Each document's head and the Markdown of its elements, place by place."""
    els = stitched(s, d)
    titles = assembly.infer_title(t(s, d, "document_meta"), elements(s, d))
    n_pages = els.filter("type = 'page_break'").groupBy("doc_id").agg(F.count("*").alias("pages"))
    heads = render.markdown_heads(latest_meta(s, d).drop("title").join(titles, "doc_id").join(n_pages, "doc_id"), "2025-01-01")
    return render.with_heads(render.markdown_parts(els, titles, furniture.folio_map(blocks(s, d))), heads)


def figure_crops(s: SparkSession, d: str) -> DataFrame:
    """As if no figure had been cut out yet."""
    return figures.figure_crops(blocks(s, d).withColumn("image_path", F.lit(None).cast("string")), pages(s, d))


def correction_cache(s: SparkSession, d: str) -> DataFrame:
    """Documents whose stitched elements are as many as the elements they were made of, as if these had been kept."""
    return ingest.reusable_corrections(elements(s, d), stitched(s, d))


def ingest_manifest(s: SparkSession, d: str) -> DataFrame:
    """What a trial run of 20 pages keeps of the scanned documents."""
    p = t(s, d, "source_pages").dropDuplicates(["page_id"]).join(t(s, d, "document_meta").groupBy("doc_id").agg(F.max_by("mode", "ingested_at").alias("mode")), "doc_id")
    totals = p.groupBy("doc_id").agg(F.countDistinct("page_index").alias("total_pages"))
    return ingest.manifest(ingest.limit_pages(p, 20), totals, 20).select("doc_id", "page_index", "total_pages", "max_pages", "image_path", "width", "height")


def input_kinds(s: SparkSession, d: str) -> DataFrame:
    """How the documents' source files would be dispatched."""
    paths = t(s, d, "document_meta").select(F.col("source_file").alias("path")).filter("path IS NOT NULL").distinct()
    return ingest.dispatch(paths.select(F.col("path").alias("document"), F.array("path").alias("files"))).select("document", "kind", "title")


def document_outcomes(s: SparkSession, d: str) -> DataFrame:
    """Which documents come to something, and what is wrong with the others."""
    inputs = pipeline.from_tables(s, d)
    return pipeline.outcomes(inputs, pipeline.assembled(inputs, config.load(environ={})))


def _native_markdown(s: SparkSession, d: str, els: DataFrame) -> DataFrame:
    els = els.persist()
    return render.markdown_parts(els, assembly.infer_title(t(s, d, "document_meta"), els), s.createDataFrame([], "doc_id long, page_index int, folio string"))


def native_markdown(s: SparkSession, d: str) -> DataFrame:
    return _native_markdown(s, d, native_stitched(s, d))


def html_markdown(s: SparkSession, d: str) -> DataFrame:
    """The Markdown of the pages that have HTML."""
    p = native_pages(s, d).filter("native_html <> ''")
    return _native_markdown(s, d, assembly.stitch(assembly.native_elements(p), assembly.page_breaks(p)))


def links_images(s: SparkSession, d: str) -> DataFrame:
    """The images that a page's HTML names, in order."""
    p = native_pages(s, d).filter("native_html <> ''")
    return p.select("page_id", F.posexplode(X.images_of(F.col("native_html"))).alias("image_no", "src"))


def xhtml(s: SparkSession, d: str) -> DataFrame:
    return render.paragraph_classes(stitched(s, d)).withColumn("part", render.xhtml_part()).filter("part <> ''").select("doc_id", "seq", "part")


def _epubs(s: SparkSession, d: str, els: DataFrame) -> DataFrame:
    els = els.persist()
    m = t(s, d, "document_meta").groupBy("doc_id").agg(*(F.min(c).alias(c) for c in ("author", "language", "identifier")))
    meta = assembly.infer_title(t(s, d, "document_meta"), els).join(m, "doc_id", "left")
    packed = render.epubs(els, chunking.split_chapters(els), meta, "2025-01-01T00:00:00Z")
    return packed.select("doc_id", F.octet_length("content").alias("n_bytes"), F.sha2("content", 256).alias("digest"))


def epub_packages(s: SparkSession, d: str) -> DataFrame:
    return _epubs(s, d, stitched(s, d))


def native_epubs(s: SparkSession, d: str) -> DataFrame:
    return _epubs(s, d, native_stitched(s, d))


def probe_routes(s: SparkSession, d: str) -> DataFrame:
    """Coverage stands in: a page without a text layer is all image. Only plain text counts, as in the SQL; native_routes has HTML too."""
    p = t(s, d, "source_pages").dropDuplicates(["page_id"]).groupBy("doc_id", "page_index").agg(F.max("native_text").alias("x"), F.max("dpi").alias("dpi"))
    return quality.probe_route(p.select("doc_id", "page_index", F.when(F.col("x").isNull(), 1.0).otherwise(0.0).alias("coverage"), "dpi", F.round(F.coalesce(X.text_quality(F.col("x")), F.lit(0.0)), 2).alias("quality")))


def native_routes(s: SparkSession, d: str) -> DataFrame:
    """As probe_routes, with a page's HTML as its text where it has any, as assembly reads it."""
    x = F.coalesce(F.when(F.col("native_html") != "", X.tag_strip(F.col("native_html"))), F.col("native_text"))
    p = t(s, d, "source_pages").dropDuplicates(["page_id"]).withColumn("x", x).groupBy("doc_id", "page_index").agg(F.max("x").alias("x"), F.max("dpi").alias("dpi"))
    return quality.probe_route(p.select("doc_id", "page_index", F.when(F.col("x").isNull(), 1.0).otherwise(0.0).alias("coverage"), "dpi", F.round(F.coalesce(X.text_quality(F.col("x")), F.lit(0.0)), 2).alias("quality")))


def text_runs(s: SparkSession, d: str) -> DataFrame:
    return textlayer.text_runs(blocks(s, d), lines(s, d), textlayer.page_geometry(t(s, d, "source_pages")))


def page_geometry(s: SparkSession, d: str) -> DataFrame:
    g = textlayer.page_geometry(t(s, d, "source_pages"))
    return g.select("doc_id", "page_index", F.round("width_pt", 4).alias("width_pt"), F.round("height_pt", 4).alias("height_pt"))


def group_inputs(s: SparkSession, d: str) -> DataFrame:
    paths = t(s, d, "source_pages").select(F.col("image_path").alias("path")).filter("path IS NOT NULL")
    return files.group_inputs(paths, "work").select("document", F.size("files").alias("n_files"), F.element_at("files", 1).alias("first_file"), F.element_at("files", -1).alias("last_file"))


def natural_sort(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "document_meta").select("source_file").distinct().filter("source_file IS NOT NULL").select("source_file", X.natural_key(F.col("source_file")).alias("sort_key"))


def resume_antijoin(s: SparkSession, d: str) -> DataFrame:
    scanned = t(s, d, "source_pages").filter("native_text IS NULL AND native_html IS NULL").select("doc_id", "page_index").distinct()
    return quality.missing_pages(scanned, t(s, d, "ocr_pages").filter("deskew_angle IS NOT NULL"))


def cache_complete(s: SparkSession, d: str) -> DataFrame:
    totals = t(s, d, "source_pages").groupBy("doc_id").agg(F.countDistinct("page_index").alias("total"))
    return quality.cache_complete(t(s, d, "ocr_pages"), totals, 20)


def run_report(s: SparkSession, d: str) -> DataFrame:
    runs = t(s, d, "clean_stats").dropDuplicates(["run_id"]).filter("chunks IS NOT NULL")
    results = runs.select((F.col("errors") == 0).alias("ok"), (F.col("last_page") - F.col("first_page") + 1).cast("long").alias("n_pages"), F.col("chunks").cast("double").alias("seconds"))
    return quality.run_report(results).withColumn("seconds_per_page", F.round("seconds_per_page", 6))


def table_of_contents(s: SparkSession, d: str) -> DataFrame:
    h = stitched(s, d).filter("type = 'heading'")
    return h.select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("seq")).alias("entry"), F.col("level").cast("int").alias("level"), "text")


def word_counts(s: SparkSession, d: str) -> DataFrame:
    return stitched(s, d).groupBy("doc_id").agg(F.sum(X.word_count(F.col("text"))).cast("long").alias("n_words"))


def page_feed(s: SparkSession, d: str) -> DataFrame:
    """The stateless stage of the stream, run once as a batch."""
    from foliospark.streaming import pages as stream

    return stream.line_stream(blocks(s, d)).select("block_id", "text")


def queries() -> dict[str, Query]:
    return {
        "text_quality": lambda s, d: t(s, d, "documents").select("doc_id", F.round(X.text_quality(F.col("text")), 2).alias("quality")),
        "repeat_key_counts": repeat_key_counts,
        "folio_flags": _by_block(X.is_folio, "is_folio"),
        "normalise_text": _by_block(X.normalise, "plain"),
        "dehyphenate": _by_block(X.dehyphenate, "joined"),
        "join_lines": _by_block(X.join_lines, "joined"),
        "list_start_flags": lambda s, d: lines(s, d).filter("text IS NOT NULL").select("block_id", "line_no", X.is_list_start(F.col("text")).alias("is_start")),
        "list_format": lambda s, d: blocks(s, d).filter("type = 'list' AND text IS NOT NULL").select("block_id", X.markdown_list(F.col("text")).alias("items")),
        "token_counts": _by_block(lambda c: F.size(X.tokens(c)), "n_tokens"),
        "plain_glyphs": _by_block(X.plain_glyphs, "plain"),
        "yaml_escape": lambda s, d: t(s, d, "document_meta").select("doc_id", X.yaml_string(F.col("title")).alias("quoted")).distinct(),
        "html_escape": _by_block(X.escape_html, "escaped"),
        "slug_ascii": lambda s, d: t(s, d, "document_meta").select("doc_id", X.slug(F.col("author")).alias("slug")).filter("slug IS NOT NULL").distinct(),
        "tag_strip": lambda s, d: t(s, d, "source_pages").filter("native_html IS NOT NULL").select("page_id", X.tag_strip(F.col("native_html")).alias("plain")).distinct(),
        "heading_promote": heading_promote,
        "furniture_labels": furniture_labels,
        "furniture_stats": furniture_stats,
        "folio_map": lambda s, d: furniture.folio_map(blocks(s, d)),
        "page_plain_text": lambda s, d: furniture.page_text(blocks(s, d)),
        "weak_page_gate": weak_page_gate,
        "take_longer": take_longer,
        "assemble_elements": lambda s, d: elements(s, d).select("doc_id", "seq", "type", "text", F.col("level").cast("int").alias("level")),
        "stitch_paragraphs": stitch_paragraphs,
        "native_assembly": native_assembly,
        "native_documents": native_documents,
        "native_chapters": native_chapters,
        "native_markdown": native_markdown,
        "native_epubs": native_epubs,
        "native_routes": native_routes,
        "infer_titles": infer_titles,
        "word_counts": word_counts,
        "table_of_contents": table_of_contents,
        "chunk_pack": lambda s, d: chunking.pack_chunks(stitched(s, d)),
        "chapter_split": chapters,
        "guard_bound": guard_bound,
        "guard_reasons": guard_reasons,
        "guard_similarity": guard_similarity,
        "correction_pass": correction_pass,
        "reason_histogram": reason_histogram,
        "page_metrics_score": page_metrics_score,
        "upper_median": upper_medians,
        "reading_order": reading_order,
        "method_histogram": method_histogram,
        "noted_methods": noted_methods,
        "column_detect": column_detect,
        "left_edge_columns": lambda s, d: layout.left_edge_columns(blocks(s, d), pages(s, d)),
        "xy_cut_order": xy_cut_order,
        "order_checks": order_checks,
        "axis_split": axis_split,
        "largest_gap": largest_gaps,
        "order_validation": order_validation,
        "group_lines": group_lines,
        "html_elements": html_elements,
        "html_markdown": html_markdown,
        "links_images": links_images,
        "table_markdown": lambda s, d: blocks(s, d).filter("type = 'table' AND html IS NOT NULL").select("block_id", X.table_markdown(F.col("html")).alias("markdown")),
        "markdown": markdown,
        "front_matter": front_matter,
        "figure_crops": figure_crops,
        "correction_cache": correction_cache,
        "ingest_manifest": ingest_manifest,
        "input_kinds": input_kinds,
        "document_outcomes": document_outcomes,
        "xhtml": xhtml,
        "epub_packages": epub_packages,
        "probe_route": probe_routes,
        "text_runs": text_runs,
        "page_geometry": page_geometry,
        "group_inputs": group_inputs,
        "natural_sort": natural_sort,
        "resume_antijoin": resume_antijoin,
        "cache_complete": cache_complete,
        "run_report": run_report,
        "page_feed": page_feed,
    }


def oracle_sql() -> dict[str, str]:
    from foliospark.plans.oracle import SQL

    return SQL
