"""Recognition engines as plug-ins, run over pages in batches, a model loaded once a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators.engine_json import box_of_polygon


class Engine(Protocol):
    """What a plug-in has. `read` gives each image's lines: (polygon as a list of (x, y), text, confidence)."""

    def available(self) -> str:
        """Why the engine can't be used; empty if it can."""

    def load(self) -> None: ...

    def read(self, image_path: str) -> list[tuple[list[tuple[float, float]], str, float]]: ...

    def close(self) -> None: ...


ENGINES: dict[str, Callable[[], Engine]] = {}


def engine(name: str) -> Callable[[Callable[[], Engine]], Callable[[], Engine]]:
    """Registers an engine's class under a name."""

    def add(make: Callable[[], Engine]) -> Callable[[], Engine]:
        ENGINES[name] = make
        return make

    return add


def choose(preferred: str, order: list[str]) -> str:
    """The name of the preferred engine if it can be used, else of the first in order that can; raises where none can."""
    why = {}
    for name in dict.fromkeys([preferred, *order] if preferred not in ("", "auto") else order):
        why[name] = ENGINES[name]().available() if name in ENGINES else "unknown"
        if not why[name]:
            return name
    raise LookupError("no engine can be used: " + "; ".join(f"{n}: {w}" for n, w in why.items()))


def recognise(jobs: DataFrame, make: Callable[[], Engine]) -> DataFrame:
    """(doc_id, page_index, lines, error) of jobs (doc_id, page_index, image_path). A page on which the engine fails is empty and has the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = make()
        own.load()
        try:
            for b in batches:
                lines, errors = [], []
                for path in b["image_path"]:
                    try:
                        lines.append([{"points": [list(map(float, p)) for p in polygon], "text": text, "confidence": float(c)} for polygon, text, c in own.read(path)])
                        errors.append(None)
                    except Exception as e:  # any failure of a plug-in is that page's
                        lines.append([])
                        errors.append(f"{type(e).__name__}: {e}")
                yield pd.DataFrame({"doc_id": b["doc_id"], "page_index": b["page_index"], "lines": lines, "error": errors})
        finally:
            own.close()

    schema = "doc_id long, page_index int, lines array<struct<points:array<array<double>>,text:string,confidence:double>>, error string"
    return jobs.select("doc_id", "page_index", "image_path").mapInPandas(run, schema)


def engine_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_index, line_id, text, x0, y0, x1, y1, confidence) of recognised pages: boxes of polygons, trimmed texts, blank lines left out."""
    each = pages.select("doc_id", "page_index", F.posexplode("lines").alias("_i", "_l"))
    text = F.trim(F.col("_l.text"))
    some = each.withColumn("text", text).filter("text <> ''").withColumn("_b", box_of_polygon(F.col("_l.points")))
    return some.select("doc_id", "page_index", F.col("_i").alias("line_id"), "text", "_b.*", F.col("_l.confidence").alias("confidence"))
