"""EPUB packages: metadata, spine documents in order, their text and images."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions import text as X
from foliospark.sources.files import IMAGES as LOOSE
from foliospark.sources.images import frame_sizes

IMAGES = (*LOOSE, "gif")

SCHEMA = "path string, error string, title string, author string, language string, identifier string, manifest array<struct<id:string,href:string>>, spine array<string>, members array<struct<name:string,size:long,width:int,height:int>>, pages array<struct<href:string,html:string>>"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def read_package(content: bytes) -> dict:
    """What a package holds. Raises where it has no root file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        roots = [e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile"]
        if not roots or not roots[0]:
            raise ValueError("the package names no root file")
        opf = ElementTree.fromstring(z.read(roots[0]))
        base = posixpath.dirname(roots[0])
        out: dict = {"title": None, "creator": None, "language": None, "identifier": None}
        manifest, spine = [], []
        for e in opf.iter():
            name = _local(e.tag)
            if name in out and out[name] is None and (e.text or "").strip():
                out[name] = e.text.strip()
            elif name == "item":
                manifest.append({"id": e.get("id"), "href": posixpath.normpath(posixpath.join(base, unquote(e.get("href") or "")))})
            elif name == "itemref":
                spine.append(e.get("idref"))
        wanted = {m["href"] for m in manifest if m["id"] in set(spine)} & names
        pages = [{"href": h, "html": z.read(h).decode("utf-8", "replace")} for h in sorted(wanted)]
        members = []
        for i in z.infolist():
            size = (frame_sizes(z.read(i)) or [(None, None)])[0] if posixpath.splitext(i.filename)[1].lower().lstrip(".") in IMAGES else (None, None)
            members.append({"name": i.filename, "size": i.file_size, "width": size[0], "height": size[1]})
    return out | {"manifest": manifest, "spine": spine, "pages": pages, "members": members}


def read_epubs(files: DataFrame) -> DataFrame:
    """A row for each package of files (path, content); one that can't be read has an error and nothing else."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    p = read_package(bytes(content))
                    rows.append((path, None, p["title"], p["creator"], p["language"], p["identifier"], p["manifest"], p["spine"], p["members"], p["pages"]))
                except Exception as e:
                    rows.append((path, f"{type(e).__name__}: {e}", None, None, None, None, [], [], [], []))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SCHEMA.split(", ")])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def spine_pages(packages: DataFrame) -> DataFrame:
    """(path, page_index, source_page, href, native_html): spine order joined to the manifest and to what the package holds.

    Unknown references and missing files are left out and pages numbered anew; source_page keeps the place in the spine.
    """
    spine = packages.select("path", F.posexplode("spine").alias("source_page", "id"))
    manifest = packages.select("path", F.explode("manifest").alias("m")).select("path", "m.id", "m.href")
    held = packages.select("path", F.explode("pages").alias("p")).select("path", "p.href", F.col("p.html").alias("native_html"))
    found = spine.join(manifest, ["path", "id"]).join(held, ["path", "href"])
    return found.select("path", (F.row_number().over(W.partitionBy("path").orderBy("source_page")) - 1).alias("page_index"), "source_page", "href", "native_html")


def image_references(pages: DataFrame, packages: DataFrame) -> DataFrame:
    """(path, page_index, name, size, width, height): images a page names that are in the package."""
    members = packages.select("path", F.explode("members").alias("m")).select("path", "m.name", "m.size", "m.width", "m.height")
    folder = F.regexp_replace("href", r"[^/]*$", "")
    raw = pages.select("path", "page_index", folder.alias("_f"), F.explode(F.array_distinct(X.images_of(F.col("native_html")))).alias("_s"))
    joined = F.concat("_f", F.regexp_replace("_s", r"^\./", ""))
    for _ in range(4):
        joined = F.regexp_replace(joined, r"(^|/)[^/.][^/]*/\.\./", "$1")
    return raw.select("path", "page_index", joined.alias("name")).distinct().join(members, ["path", "name"])


def probe(pages: DataFrame, images: DataFrame) -> DataFrame:
    """(path, n_docs, n_chars, n_images, is_scan): a package is a scan if most pages show images and they hold little text."""
    text = pages.withColumn("_n", F.length(X.tag_strip(F.col("native_html")))).groupBy("path").agg(F.count("*").alias("n_docs"), F.sum("_n").alias("n_chars"))
    counted = text.join(images.groupBy("path").agg(F.count("*").alias("n_images")), "path", "left").withColumn("n_images", F.coalesce("n_images", F.lit(0)))
    return counted.withColumn("is_scan", (F.col("n_images") >= F.greatest(F.lit(1.0), 0.8 * F.col("n_docs"))) & (F.col("n_chars") / F.col("n_docs") < 200))


def largest_images(images: DataFrame) -> DataFrame:
    """(path, page_index, source_page, name, width, height, dpi): each page's readable image of the largest area, the first name of equals.

    Pages without one are left out and numbered anew; source_page keeps the place in the spine.
    """
    readable = images.filter("width > 0 AND height > 0").withColumn("_a", F.col("width").cast("long") * F.col("height"))
    best = readable.groupBy("path", "page_index").agg(F.min_by(F.struct("name", "width", "height"), F.struct(-F.col("_a"), "name")).alias("_b"))
    index = F.row_number().over(W.partitionBy("path").orderBy("page_index")) - 1
    return best.select("path", index.alias("page_index"), F.col("page_index").alias("source_page"), "_b.name", "_b.width", "_b.height", F.lit(300.0).alias("dpi"))
