"""From groups of input files to pages: dispatch by type, loose images, what is kept between runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions import text as X
from foliospark.sources.files import IMAGES, name_of, suffix_of
from foliospark.sources.images import frame_sizes

IMAGE_DPI = 300.0
#: What a manifest has of each page.
MANIFEST = ("page_index", "image_path", "width", "height", "source_page", "native_text", "dpi")


def dispatch(groups: DataFrame) -> DataFrame:
    """The groups of `files.group_inputs` with kind (pdf, epub, images; null for what isn't supported), title, stem and error.

    The first file decides. A group of several files is named by its folder, else by the file's stem.
    """
    first = F.element_at("files", 1)
    suffix = suffix_of(first)
    kind = F.when(suffix == "pdf", "pdf").when(suffix == "epub", "epub").when(suffix.isin(*IMAGES), "images")
    folder = name_of(F.regexp_replace(first, r"[/\\][^/\\]*$", ""))
    title = F.when(F.size("files") > 1, folder).otherwise(F.regexp_replace(name_of(first), r"\.[^.]*$", ""))
    named = groups.withColumn("kind", kind).withColumn("title", title).withColumn("stem", X.slug(F.col("title")))
    return named.withColumn("error", F.when(F.col("kind").isNull(), F.concat(F.lit("unsupported input: "), first)))


def image_pages(groups: DataFrame, files: DataFrame, max_pages: int | None = None) -> DataFrame:
    """(document, page_index, image_path, frame, width, height, source_page, dpi) of loose images, a page for each frame, numbered through.

    groups are of kind images; files has (path, content). Unreadable files give no page. Only sizes are read from the content.
    """

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "frames": [[{"width": w, "height": h} for w, h in frame_sizes(c)] for c in b["content"]]})

    order = groups.select("document", F.posexplode("files").alias("_file", "path"))
    sized = files.select("path", "content").join(order.select("path").distinct(), "path", "left_semi").mapInPandas(sizes, "path string, frames array<struct<width:int,height:int>>")
    frames = order.join(sized, "path").select("document", "_file", "path", F.posexplode("frames").alias("frame", "_s"))
    index = F.row_number().over(W.partitionBy("document").orderBy("_file", "frame")) - 1
    pages = frames.select("document", index.alias("page_index"), F.col("path").alias("image_path"), "frame", "_s.width", "_s.height", F.lit(IMAGE_DPI).alias("dpi"))
    pages = pages.withColumn("source_page", F.col("page_index"))
    return pages if max_pages is None else limit_pages(pages, max_pages)


def limit_pages(pages: DataFrame, max_pages: int | None) -> DataFrame:
    """The first pages of each document, for trial runs."""
    return pages if not max_pages else pages.filter(F.col("page_index") < max_pages)


def manifest(pages: DataFrame, totals: DataFrame, max_pages: int | None = None) -> DataFrame:
    """(doc_id, total_pages, max_pages, the columns of MANIFEST): what is kept of the documents that were rendered; native ones are read again each time.

    pages has mode; totals (doc_id, total_pages) tell a later run whether what is kept is complete.
    """
    kept = pages.filter(F.coalesce(F.col("mode"), F.lit("ocr")) != "native").join(totals, "doc_id", "left")
    return kept.select("doc_id", F.col("total_pages").cast("long").alias("total_pages"), F.lit(max_pages or 0).alias("max_pages"), *MANIFEST)


class Store:
    """Pages, elements and manifests of documents, kept between runs as tables below a folder that all executors share.

    A table is partitioned by a hash bucket of the document. Writing replaces only the buckets of documents that are written, and in them only these documents' rows;
    Spark's commit makes the replacement whole or not at all.
    """

    BUCKETS = 256

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def load(self, name: str) -> DataFrame | None:
        """The table, or None where nothing was kept or it can't be read."""
        if not self.exists(name):
            return None
        try:
            return self.spark.read.parquet(self.path(name)).drop("bucket")
        except Exception as e:  # a broken table is as good as none
            self.spark._jvm.org.slf4j.LoggerFactory.getLogger("foliospark").warn(f"{self.path(name)} can't be read: {type(e).__name__}")
            return None

    def save(self, name: str, rows: DataFrame) -> None:
        """Replaces the documents that rows has, the others stay."""
        from foliospark.session import cut

        rows = cut(rows)
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(self.BUCKETS)).cast("int")
        written = rows.withColumn("bucket", bucket)
        if self.exists(name):
            docs = rows.select("doc_id").distinct()
            old = self.spark.read.parquet(self.path(name))
            same = old.join(F.broadcast(docs.select(bucket.alias("bucket")).distinct()), "bucket", "left_semi")  # at most BUCKETS rows
            written = written.unionByName(cut(same.join(docs, "doc_id", "left_anti")).select(*written.columns), allowMissingColumns=True)
        written.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path(name))


def reusable_corrections(cached: DataFrame, els: DataFrame) -> DataFrame:
    """(doc_id): documents whose kept corrections belong to the same elements, as their numbers agree; another number is of a run over other pages."""
    have, need = (x.groupBy("doc_id").agg(F.count("*").alias(n)) for x, n in ((cached, "_have"), (els, "_need")))
    return need.join(have, "doc_id").filter("_have = _need").select("doc_id")
