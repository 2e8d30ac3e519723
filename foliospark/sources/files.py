"""Finding input files and grouping them into documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text as X

IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")
SUPPORTED = ("pdf", "epub", *IMAGES)


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1)


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(name_of(path), r"\.([^.]*)$", 1))


def supported(path: Column) -> Column:
    return suffix_of(path).isin(*SUPPORTED) & ~name_of(path).rlike(r"^[~.]")


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length, content) of supported files below a folder; content is read only where it is used. A folder that isn't there gives none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).filter(supported(F.col("path")))


def group_inputs(paths: DataFrame, root: str) -> DataFrame:
    """(document, kind_order, files): every other file by itself, images of a subfolder together in natural order, images in the root each by itself.

    kind_order 0 comes before 1. A folder's images are one document and its list of files one value.
    """
    p = F.col("path")
    parent = F.regexp_replace(p, r"[/\\][^/\\]*$", "")
    image = suffix_of(p).isin(*IMAGES)
    document = F.when(image & (parent != F.lit(root.rstrip("/\\"))), parent).otherwise(p)
    rows = paths.select("path").distinct().filter(supported(p)).select(document.alias("document"), image.cast("int").alias("kind_order"), F.struct(X.natural_key(name_of(p)).alias("k"), p.alias("path")).alias("f"))
    return rows.groupBy("document", "kind_order").agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["path"]).alias("files"))


def fingerprint(files: DataFrame, settings: str = "") -> DataFrame:
    """(path, fingerprint): 16 hex digits over size, time, the first and, of larger files, the last 64 KiB, and the settings."""
    head, tail = F.substring("content", 1, 65536), F.when(F.col("length") > 131072, F.substring("content", -65536, 65536)).otherwise(F.lit(b""))
    at = F.unix_seconds("modificationTime").cast("string")
    parts = F.concat(F.encode(F.col("length").cast("string"), "UTF-8"), F.encode(at, "UTF-8"), head, tail, F.encode(F.lit(settings), "UTF-8"))
    return files.select("path", F.substring(F.sha2(parts, 256), 1, 16).alias("fingerprint"))


def group_fingerprint(prints: DataFrame, groups: DataFrame) -> DataFrame:
    """(document, fingerprint) over all files of a document in order, so a change of any of them shows."""
    each = groups.select("document", F.posexplode("files").alias("i", "path")).join(prints, "path")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "fingerprint"))), lambda x: x["fingerprint"]), "")
    return each.groupBy("document").agg(F.substring(F.sha2(joined, 256), 1, 16).alias("fingerprint"))
