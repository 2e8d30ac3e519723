"""All documents from ingested tables to written outputs, each document's failures its own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.config import Settings
from foliospark.functions import text as X
from foliospark.operators import assembly, chunking, correction, furniture, quality
from foliospark.plans import render
from foliospark.session import cut
from foliospark.sources import ingest

OK, SOME_FAILED, NO_FILE, NO_ENGINE, NOTHING_TO_DO, INTERRUPTED = 0, 1, 2, 3, 4, 130


@dataclass
class Inputs:
    """What ingest and recognition leave: tables of documents, native pages, recognised pages and their blocks. errors has (doc_id, error)."""

    meta: DataFrame
    native: DataFrame
    pages: DataFrame
    blocks: DataFrame
    errors: DataFrame | None = None


def from_tables(spark: SparkSession, folder: str, max_pages: int | None = None) -> Inputs:
    """From parquet tables; repeated rows count once."""
    read = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
    latest = read("document_meta").groupBy("doc_id").agg(*(F.max_by(c, "ingested_at").alias(c) for c in ("title", "author", "language", "source_file", "identifier", "mode")))
    source = ingest.limit_pages(read("source_pages").dropDuplicates(["page_id"]), max_pages)
    native = source.filter("native_text IS NOT NULL OR native_html IS NOT NULL")
    blocks = ingest.limit_pages(read("blocks").dropDuplicates(["block_id"]), max_pages)
    return Inputs(latest, native, furniture.pages_of(ingest.limit_pages(read("ocr_pages"), max_pages)), blocks)


def assembled(inputs: Inputs, settings: Settings) -> DataFrame:
    """The stitched elements of all documents, recognised and native."""
    strip, headings = settings["assemble.strip_running_heads"], settings["assemble.detect_headings"]
    content = assembly.content(inputs.blocks, inputs.pages, strip, headings).unionByName(assembly.native_elements(inputs.native))
    breaks = assembly.page_breaks(inputs.pages.select("doc_id", "page_index")).unionByName(assembly.page_breaks(inputs.native.select("doc_id", "page_index"))).distinct()
    if settings["assemble.stitch_paragraphs"]:
        return assembly.stitch(content, breaks)
    return content.unionByName(breaks).select(*(c for c in breaks.columns if c != "page_index"), F.array("page_index").alias("pages"), F.lit(1).alias("n_parts"))


def corrected(els: DataFrame, settings: Settings, corrector: Callable[[str], str] | None, store: ingest.Store | None) -> DataFrame:
    """The elements corrected. Kept corrections are used for documents whose elements are as many; without a corrector the elements stay."""
    if corrector is None or not settings["correct.enabled"]:
        return els
    kept = store.load("elements_clean") if store and settings["run.resume"] else None
    todo, done = els, None
    if kept is not None:
        same = ingest.reusable_corrections(kept, els)
        done = kept.join(same, "doc_id", "left_semi").select(*els.columns)
        todo = els.join(same, "doc_id", "left_anti")
    new = correction.correct(todo, corrector, settings["correct.max_chars"])[0].select(*els.columns)
    if store:
        new = cut(new)
        store.save("elements_clean", new)
    return new if done is None else new.unionByName(done)


def outcomes(inputs: Inputs, els: DataFrame) -> DataFrame:
    """(doc_id, ok, n_pages, error): a document fails if ingest or recognition says so, or if nothing but page breaks came of it."""
    kind = F.col("type")
    by = els.groupBy("doc_id").agg(F.count_if(kind == "page_break").alias("n_pages"), F.count_if(kind != "page_break").alias("_n"))
    docs = inputs.meta.select("doc_id").distinct().join(by, "doc_id", "left")
    if inputs.errors is not None:
        docs = docs.join(inputs.errors.groupBy("doc_id").agg(F.min("error").alias("error")), "doc_id", "left")
    else:
        docs = docs.withColumn("error", F.lit(None).cast("string"))
    error = F.coalesce("error", F.when(F.coalesce("_n", F.lit(0)) == 0, "no content"))
    return docs.select("doc_id", error.isNull().alias("ok"), F.coalesce("n_pages", F.lit(0)).alias("n_pages"), error.alias("error"))


def run(inputs: Inputs, settings: Settings, output: str, only: tuple[str, ...] = ("md", "epub"), corrector: Callable[[str], str] | None = None, store: ingest.Store | None = None, date: str = "1970-01-01") -> tuple[DataFrame, int]:
    """Writes Markdown and EPUBs of all documents that are well, and the outcomes; returns these and the exit code."""
    els = cut(assembled(inputs, settings))
    if store:
        store.save("elements_raw", els)
    els = cut(corrected(els, settings, corrector, store))
    status = cut(outcomes(inputs, els))
    good = status.filter("ok").select("doc_id")
    fine = els.join(good, "doc_id", "left_semi")
    titles = assembly.infer_title(inputs.meta, fine.withColumn("page_index", F.get("pages", F.lit(0))))
    words = fine.groupBy("doc_id").agg(F.sum(X.word_count(F.col("text"))).alias("words"), F.count_if(F.col("type") == "page_break").alias("pages"))
    meta = inputs.meta.drop("title").join(titles, "doc_id").join(words, "doc_id")
    if "md" in only:
        parts = render.markdown_parts(fine, titles, furniture.folio_map(inputs.blocks))
        render.write_markdown(parts, render.markdown_heads(meta, date), f"{output}/markdown")
    if "epub" in only:
        render.epubs(fine, chunking.split_chapters(fine, settings["output.max_chapter_elements"]), meta, f"{date}T00:00:00Z").write.mode("overwrite").parquet(f"{output}/epub")
    status.write.mode("overwrite").parquet(f"{output}/outcomes")
    failed = status.filter("NOT ok").limit(1).count()
    return status, SOME_FAILED if failed else OK


def report(status: DataFrame, seconds: float) -> DataFrame:
    """How the run went."""
    n = status.count()
    return quality.run_report(status.select("ok", F.when(F.col("ok"), F.col("n_pages")).otherwise(0).alias("n_pages"), F.lit(seconds / max(1, n)).alias("seconds")))
