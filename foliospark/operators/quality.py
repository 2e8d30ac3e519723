"""Page image metrics to a score and to the restoration steps they call for; cache completeness, resume and run reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import aggregates

METRICS = ("sharpness", "contrast", "skew_deg", "noise", "illumination_range", "border_ratio")


def quality_score(sharpness: Column, contrast: Column, skew: Column, noise: Column, illumination: Column) -> Column:
    """From 0 to 1; unreadable pages, with null metrics, count as neutral."""
    one = F.lit(1.0)
    s = (
        1
        - 0.30 * (1 - F.least(one, F.coalesce(sharpness, F.lit(999.0)) / 120))
        - 0.20 * (1 - F.least(one, F.coalesce(contrast, F.lit(99.0)) / 55))
        - 0.20 * F.least(one, F.abs(F.coalesce(skew, F.lit(0.0))) / 3)
        - 0.15 * F.least(one, F.coalesce(noise, F.lit(0.0)) / 12)
        - 0.15 * F.least(one, F.coalesce(illumination, F.lit(0.0)) / 70)
    )
    return F.greatest(F.lit(0.0), F.least(one, s))


def planned_actions(always: bool = False, binarize: bool = False) -> Column:
    """The names of the steps a page needs, from its metric columns, in the order they are taken."""
    a = F.lit(always)
    when = {
        "crop": a | (F.col("border_ratio") > 0.12),
        "deskew": F.abs("skew_deg") >= (0.12 if always else 0.30),
        "illumination": a | (F.col("illumination_range") > 38),
        "clahe": a | (F.col("contrast") < 48),
        "despeckle": a | (F.col("noise") > 6.5),
        "binarize": F.lit(binarize),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in when.items())))


def rounded_metrics() -> list[Column]:
    """The metrics as they are reported, to three places, halves to even."""
    return [F.bround(c, 3).alias(c) for c in METRICS]


def restore_pages(pages: DataFrame, restorer: Callable[[str, list[str]], str]) -> DataFrame:
    """(doc_id, page_index, image_path, actions, restored_path, changed, error): what the plug-in makes of the pages that need something.

    A page on which it fails keeps its image and has the error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = []
            for path, actions in zip(b["image_path"], b["actions"], strict=True):
                try:
                    new = restorer(path, list(actions)) if len(actions) else path
                    done.append((new, new != path, None))
                except Exception as e:  # whatever a plug-in raises is that page's failure
                    done.append((path, False, f"{type(e).__name__}: {e}"))
            yield b.assign(restored_path=[d[0] for d in done], changed=[d[1] for d in done], error=[d[2] for d in done])

    slim = pages.select("doc_id", "page_index", "image_path", "actions")
    return slim.mapInPandas(run, "doc_id long, page_index int, image_path string, actions array<string>, restored_path string, changed boolean, error string")


def restoration_report(restored: DataFrame, scores: DataFrame) -> DataFrame:
    """(doc_id, n_pages, n_changed, n_failed, score): scores has (doc_id, page_index, score), of which each document's upper median counts."""
    by = restored.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.count_if("changed").alias("n_changed"), F.count_if(F.col("error").isNotNull()).alias("n_failed"))
    return by.join(aggregates.upper_median(scores, ["doc_id"], "score", "score"), "doc_id", "left")


def render_dpi(width_pt: Column, height_pt: Column, native_dpi: Column, target_px: int = 2400, low: int = 150, high: int = 400) -> Column:
    long_side = F.greatest(width_pt, height_pt)
    return F.bround(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.least(target_px / (long_side / 72), native_dpi)))).cast("int")


def probe_route(pages: DataFrame, sample: int = 12, scan_share: float = 0.55, least_quality: float = 0.80, force_ocr: bool = False) -> DataFrame:
    """(doc_id, n_pages, coverage, dpi, quality, is_scan, mode) from up to `sample` evenly spaced pages of each document.

    pages has doc_id, page_index (from 0, once each), coverage, dpi and quality. Values are upper medians, of dpi of those over 0, 300 for
    none. A document is native if it is no scan and its text layer is good enough.
    """
    total = pages.groupBy("doc_id").agg((F.max("page_index") + 1).alias("n_pages"))
    some = pages.join(total, "doc_id").filter(aggregates.evenly_spaced("page_index", "n_pages", sample))

    def middle(c: Column) -> Column:
        """Of at most `sample` values, so that they fit an array."""
        values = F.array_sort(F.collect_list(c))
        return F.get(values, F.floor(F.size(values) / 2).cast("int"))

    medians = some.groupBy("doc_id").agg(middle(F.col("coverage")).alias("coverage"), middle(F.when(F.col("dpi") > 0, F.col("dpi"))).alias("dpi"), middle(F.col("quality")).alias("quality"))
    out = total.join(medians, "doc_id", "left")
    scan = F.coalesce(F.col("coverage") >= scan_share, F.lit(False))
    native = ~scan & F.coalesce(F.col("quality") >= least_quality, F.lit(False)) & F.lit(not force_ocr)
    return out.select("doc_id", "n_pages", "coverage", F.coalesce("dpi", F.lit(300.0)).alias("dpi"), "quality", scan.alias("is_scan"), F.when(native, "native").otherwise("ocr").alias("mode"))


def missing_pages(jobs: DataFrame, cached: DataFrame) -> DataFrame:
    """The pages still to be read."""
    return jobs.join(cached.select("doc_id", "page_index").distinct(), ["doc_id", "page_index"], "left_anti")


def resumed(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """What was read before and what is new, the newer reading where both are there."""
    return cached.join(fresh.select("doc_id", "page_index").distinct(), ["doc_id", "page_index"], "left_anti").unionByName(fresh, allowMissingColumns=True)


def cache_complete(cached: DataFrame, totals: DataFrame, max_pages: int | None = None) -> DataFrame:
    """(doc_id, have, needed, complete) against each document's page total and the limit of a trial run."""
    have = cached.select("doc_id", "page_index").distinct()
    if max_pages is not None:
        have = have.filter(F.col("page_index") < max_pages)
    needed = F.col("total") if max_pages is None else F.least(F.col("total"), F.lit(max_pages))
    joined = totals.join(have.groupBy("doc_id").agg(F.count("*").alias("have")), "doc_id", "left")
    return joined.select("doc_id", F.coalesce("have", F.lit(0)).alias("have"), needed.cast("long").alias("needed"), (F.coalesce("have", F.lit(0)) >= needed).alias("complete"))


def run_report(results: DataFrame) -> DataFrame:
    """One row over documents (ok, n_pages, seconds): how many went well or failed, pages, and seconds a page."""
    return results.agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"), F.sum("n_pages").alias("n_pages"), (F.sum("seconds") / F.nullif(F.sum("n_pages"), F.lit(0))).alias("seconds_per_page"))
