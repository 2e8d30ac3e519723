"""Columns and reading order of pages.

A page is a small group, so the recursive parts run once a page in Arrow batches; what windows can express stays in the JVM.
Boxes with null coordinates take no part in column detection and come last in their page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS, LOW, NARROW, WIDE = 500, 0.15, 0.12, 1.6
FLOWING = ("text", "list", "heading", "footnote")


@dataclass
class Columns:
    spans: list[tuple[float, float]]
    confidence: float

    def of(self, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
        """The column that holds most of a box, -1 for none or several."""
        if len(self.spans) == 1:
            return np.zeros(len(x0), int)
        lo, hi = np.array(self.spans).T
        shared = np.minimum(x1[:, None], hi) - np.maximum(x0[:, None], lo)
        inside = shared > 0.5 * np.minimum((x1 - x0)[:, None], hi - lo)
        return np.where(inside.sum(axis=1) == 1, inside.argmax(axis=1), -1)


def _runs(flag: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(int), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def quantile(sorted_values: np.ndarray, q: float) -> float:
    """The value at the half-even rounded rank."""
    return float(sorted_values[round(q * (len(sorted_values) - 1))]) if len(sorted_values) else 0.0


def kmeans_1d(values: np.ndarray, k: int, rounds: int = 25) -> np.ndarray | None:
    """Centres of k clusters from evenly spaced quantiles on; ties go to the lower cluster, empty clusters keep their centre. None for fewer values."""
    v = np.sort(values)
    if len(v) < k:
        return None
    centres = v[np.minimum(len(v) - 1, ((np.arange(k) + 0.5) * len(v) / k).astype(int))].astype(float)
    for _ in range(rounds):
        near = np.abs(v[:, None] - centres).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        moved = np.where(n > 0, np.bincount(near, v, k) / np.maximum(n, 1), centres)
        if np.abs(moved - centres).max() <= 1e-6:
            break
        centres = moved
    return centres


def by_left_edges(x0: np.ndarray, x1: np.ndarray, width: float, most: int) -> Columns | None:
    """Columns from clusters of left edges: well filled, far apart, not overlapping, and holding most boxes singly."""
    if len(x0) < 8:
        return None
    for k in range(most, 1, -1):
        centres = kmeans_1d(x0, k)
        if centres is None:
            continue
        near = np.abs(x0[:, None] - centres).argmin(axis=1)
        if np.bincount(near, minlength=k).min() < max(3, len(x0) * NARROW):
            continue
        centres = np.sort([x0[near == i].mean() for i in range(k)])
        if np.diff(centres).min() < 0.15 * width:
            continue
        near = np.abs(x0[:, None] - centres).argmin(axis=1)
        spans = np.array([(quantile(np.sort(x0[near == i]), 0.05), quantile(np.sort(x1[near == i]), 0.90)) for i in range(k)])
        for i in range(k - 1):
            if spans[i, 1] > spans[i + 1, 0]:
                spans[i, 1] = spans[i + 1, 0] = (spans[i, 1] + spans[i + 1, 0]) / 2
        found = Columns([tuple(s) for s in spans.tolist()], 0.55)
        if (spans[:, 1] - spans[:, 0]).min() >= NARROW * width and (spans[:-1, 1] <= spans[1:, 0] + 1e-6).all() and (found.of(x0, x1) >= 0).mean() >= 0.7:
            return found
    return None


def detect_columns(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, flowing: np.ndarray, width: float, most: int = 4, gap: float = 0.02) -> Columns:
    """Columns from low runs in the projection of the boxes' heights; left edges decide where that fails or gives slivers."""
    whole = [(0.0, float(width))]
    ok = flowing & (x1 > x0) & (y1 > y0)
    if ok.sum() < 3:
        return Columns(whole, 0.0)
    w = np.sort((x1 - x0)[ok])
    body = ok & (x1 - x0 <= w[len(w) // 2] * WIDE)
    a, b, h = x0[body], x1[body], (y1 - y0)[body]
    scale = BINS / float(width)
    lo, hi = np.maximum(0, (a * scale).astype(int)), np.minimum(BINS - 1, (b * scale).astype(int))
    fits = lo <= hi
    steps = np.zeros(BINS + 1)
    np.add.at(steps, lo[fits], h[fits])
    np.add.at(steps, hi[fits] + 1, -h[fits])
    mass = np.cumsum(steps)[:BINS]
    if mass.max() <= 1e-9:
        return Columns(whole, 0.0)
    filled = np.flatnonzero(mass > mass.max() * LOW + 1e-9)
    first, last = int(filled[0]), int(filled[-1])
    least = max(2, int(gap * BINS))
    gutters = [(s + first, e + first) for s, e in _runs(~(mass[first : last + 1] > mass.max() * LOW + 1e-9)) if e - s >= least]
    gutters = sorted(sorted(gutters, key=lambda g: g[0] - g[1])[: most - 1])
    if not gutters:
        return by_left_edges(a, b, width, most) or Columns(whole, 0.6)
    ends = [first, *(x for g in gutters for x in g), last + 1]
    spans = [(ends[i] / scale, ends[i + 1] / scale) for i in range(0, len(ends), 2)]
    if min(e - s for s, e in spans) < NARROW * width:
        return by_left_edges(a, b, width, most) or Columns(whole, 0.3)
    widest = max(e - s for s, e in gutters) / scale
    return Columns(spans, round(min(1.0, widest / (gap * width * 1.5)), 2))


def _cut(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order along an axis, and the empty space before each box after all before it."""
    order = np.argsort(lo, kind="stable")
    reach = np.maximum.accumulate(hi[order])
    space = np.concatenate([[0.0], lo[order][1:] - reach[:-1]])
    return order, space


def xy_cut(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, width: float, height: float, most: int = 12) -> list[int]:
    """Reading order by recursive cuts at white space, columns before rows where the gutter is wide enough. Kept on a stack, so depth is no limit of Python."""
    gap_x, gap_y, out = width * 0.025, height * 0.012, []
    stack = [(np.arange(len(x0)), 0)]
    while stack:
        at, depth = stack.pop()
        if len(at) <= 1 or depth > most:
            out += at.tolist()
            continue
        (ox, sx), (oy, sy) = _cut(x0[at], x1[at]), _cut(y0[at], y1[at])
        wide = sx.max()
        if (sx > gap_x).any() and wide >= gap_x and wide >= max(0.0, sy.max()) * 0.6:
            order, space, gap = ox, sx, gap_x
        elif (sy > gap_y).any():
            order, space, gap = oy, sy, gap_y
        else:
            row = np.array([round(y / max(1.0, height * 0.01)) for y in y0[at].tolist()])
            out += at[np.lexsort((x0[at], row))].tolist()
            continue
        groups = np.split(at[order], np.flatnonzero(space > gap))
        stack += [(np.sort(g), depth + 1) for g in reversed(groups) if len(g)]
    return out


def order_is_wrong(columns: np.ndarray, n_columns: int) -> bool:
    """Whether the columns of a page's running text, in order, show it was read across."""
    c = columns[columns >= 0]
    if n_columns < 2 or len(columns) < 4 or len(c) < 4:
        return False
    switches = int((c[1:] != c[:-1]).sum())
    return switches > n_columns + 1 and switches > 0.4 * len(c)


Arrays = dict[str, np.ndarray]


def by_page(df: DataFrame, order: list[str], run: Callable[[Arrays], Arrays], schema: str) -> DataFrame:
    """run over the rows of each page, given as arrays in order; its arrays are a page's output rows, doc_id and page_index added.

    Pages are brought together by one exchange and read as a sorted stream, so a task holds a batch and a page, and no frame is made for
    each page. Rows without doc_id or page_index are left out.
    """
    keys = ["doc_id", "page_index"]
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            p = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            doc, page = p["doc_id"].to_numpy(), p["page_index"].to_numpy()
            cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (page[1:] != page[:-1])) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            rest = p.iloc[last:]
            if last:
                yield done(p.iloc[:last], [0, *cuts.tolist()])
        if rest is not None and len(rest):
            yield done(rest, [0, len(rest)])

    def done(p: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        columns = {c: p[c].to_numpy() for c in p.columns}
        parts = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            got = run({c: v[a:b] for c, v in columns.items()})
            n = len(next(iter(got.values())))
            parts.append({"doc_id": np.full(n, columns["doc_id"][a]), "page_index": np.full(n, columns["page_index"][a]), **got})
        return pd.DataFrame({n: np.concatenate([x[n] for x in parts]) for n in names})

    known = df.filter("doc_id IS NOT NULL AND page_index IS NOT NULL")
    return known.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(pages, schema)


def _page(p: Arrays, prefer_engine: bool, validate: bool, most: int, gap: float) -> tuple[Columns, np.ndarray, np.ndarray, str]:
    x0, y0, x1, y1 = (p[c].astype(float) for c in ("x0", "y0", "x1", "y1"))
    known = ~np.isnan(x0 + y0 + x1 + y1)
    width, height = float(p["page_width"][0]), float(p["page_height"][0])
    width, height = width if width > 0 else 1.0, height if height > 0 else 1.0
    flowing = np.isin(p["type"].astype(str), FLOWING) & known
    safe = [np.nan_to_num(v) for v in (x0, y0, x1, y1)]
    found = detect_columns(*safe, flowing, width, most, gap)
    column = np.where(known, found.of(safe[0], safe[2]), -1)
    order_given = np.nan_to_num(p["block_order"].astype(float))
    given = np.lexsort((p["block_id"], order_given))
    method = "engine"
    if prefer_engine and (order_given != 0).any():
        running = given[np.isin(p["type"].astype(str), ("text", "list", "heading"))[given] & (y1 > y0)[given]]
        if validate and order_is_wrong(column[running], len(found.spans)):
            method = "xy_cut(corrected)"
    else:
        method = "xy_cut"
    if method != "engine":
        at = given[known[given]]
        cut = np.array(xy_cut(x0[at], y0[at], x1[at], y1[at], width, height), int)
        given = np.concatenate([at[cut], given[~known[given]]]).astype(int)
    order = np.empty(len(given), int)
    order[given] = np.arange(len(given))
    return found, column, order, method


def reading_order(blocks: DataFrame, pages: DataFrame, prefer_engine: bool = True, validate: bool = True, max_columns: int = 4, gap_ratio: float = 0.02) -> DataFrame:
    """(doc_id, page_index, block_id, new_order, new_column, n_columns, confidence, method). Ties in the given order go by block_id."""
    slim = blocks.select("doc_id", "page_index", "block_id", "block_order", "type", "x0", "y0", "x1", "y1").join(pages.select("doc_id", "page_index", "page_width", "page_height"), ["doc_id", "page_index"])

    def resolve(p: Arrays) -> Arrays:
        found, column, order, method = _page(p, prefer_engine, validate, max_columns, gap_ratio)
        n = len(order)
        return {"block_id": p["block_id"], "new_order": order, "new_column": column, "n_columns": np.full(n, len(found.spans)), "confidence": np.full(n, found.confidence), "method": np.full(n, method, object)}

    return by_page(slim, ["block_id"], resolve, "doc_id long, page_index int, block_id long, new_order int, new_column int, n_columns int, confidence double, method string")


def left_edge_columns(blocks: DataFrame, pages: DataFrame, max_columns: int = 4) -> DataFrame:
    """(doc_id, page_index, column_no, left, right): the columns that clusters of left edges give alone; no rows for pages where they give none."""
    slim = blocks.select("doc_id", "page_index", "block_id", "type", "x0", "y0", "x1", "y1").join(pages.select("doc_id", "page_index", "page_width"), ["doc_id", "page_index"])

    def cluster(p: Arrays) -> Arrays:
        x0, y0, x1, y1 = (p[c].astype(float) for c in ("x0", "y0", "x1", "y1"))
        flowing = np.isin(p["type"].astype(str), FLOWING) & (x1 > x0) & (y1 > y0)
        width = float(p["page_width"][0])
        found = by_left_edges(x0[flowing], x1[flowing], width if width > 0 else 1.0, max_columns)
        spans = np.array(found.spans if found else [], float).reshape(-1, 2)
        return {"column_no": np.arange(len(spans)), "left": spans[:, 0], "right": spans[:, 1]}

    return by_page(slim, ["block_id"], cluster, "doc_id long, page_index int, column_no int, left double, right double")


def split_axis(blocks: DataFrame, lo: str, hi: str, gap: float) -> DataFrame:
    """The boxes with axis_group: a new group begins where more than `gap` lies empty after all boxes before; boxes without extent are left out."""
    w = W.partitionBy("doc_id", "page_index").orderBy(lo, "block_id")
    reach = F.max(hi).over(w.rowsBetween(W.unboundedPreceding, -1))
    cut = F.when(F.col(lo) - reach > gap, 1).otherwise(0)
    return blocks.filter(F.col(lo).isNotNull() & F.col(hi).isNotNull()).withColumn("_cut", cut).withColumn("axis_group", F.sum("_cut").over(w)).drop("_cut")


def largest_gap(blocks: DataFrame, lo: str, hi: str) -> DataFrame:
    """(doc_id, page_index, gap): the widest empty band between boxes, 0 for none."""
    w = W.partitionBy("doc_id", "page_index").orderBy(lo, "block_id")
    reach = F.max(hi).over(w.rowsBetween(W.unboundedPreceding, -1))
    known = blocks.filter(F.col(lo).isNotNull() & F.col(hi).isNotNull())
    return known.withColumn("_g", F.col(lo) - reach).groupBy("doc_id", "page_index").agg(F.greatest(F.lit(0.0), F.max("_g")).alias("gap"))


def column_switches(blocks: DataFrame, column: str = "column_no") -> DataFrame:
    """(doc_id, page_index, switches, singles, wrong): how often a page's running text changes column in its given order."""
    running = blocks.filter(F.col("type").isin("text", "list", "heading") & (F.col("y1") > F.col("y0")) & (F.col(column) >= 0))
    before = F.lag(column).over(W.partitionBy("doc_id", "page_index").orderBy("block_order", "block_id"))
    by_page = running.withColumn("_s", F.when(before != F.col(column), 1).otherwise(0)).groupBy("doc_id", "page_index")
    counted = by_page.agg(F.sum("_s").alias("switches"), F.count("*").alias("singles"), (F.max(column) + 1).alias("_n"))
    wrong = (F.col("_n") >= 2) & (F.col("singles") >= 4) & (F.col("switches") > F.col("_n") + 1) & (F.col("switches") > 0.4 * F.col("singles"))
    return counted.select("doc_id", "page_index", "switches", "singles", wrong.alias("wrong"))


def group_lines(lines: DataFrame, pages: DataFrame, max_columns: int = 4, gap_ratio: float = 0.035) -> DataFrame:
    """Recognised lines (doc_id, page_index, line_id, text, x0..y1, confidence) put together to paragraph blocks, page by page and column by column.

    A block ends at a gap over 0.9 line heights, or at a line set in by more than 1.2 heights from the block's left edge.
    Lines without position are left out.
    """
    slim = lines.select("doc_id", "page_index", "line_id", "text", "x0", "y0", "x1", "y1", "confidence").dropna(subset=["x0", "y0", "x1", "y1"]).join(pages.select("doc_id", "page_index", "page_width"), ["doc_id", "page_index"])

    def group(p: Arrays) -> Arrays:
        x0, y0, x1, y1 = (p[c].astype(float) for c in ("x0", "y0", "x1", "y1"))
        found = detect_columns(x0, y0, x1, y1, np.ones(len(x0), bool), float(p["page_width"][0] or 1), max_columns, gap_ratio)
        column = found.of(x0, x1)
        height = float(np.sort(y1 - y0)[len(x0) // 2]) or 12.0
        order = np.lexsort((p["line_id"], x0, y0, column))
        starts, left, prev = [], 0.0, -1
        for k, i in enumerate(order.tolist()):
            new = prev < 0 or column[i] != column[prev] or y0[i] - y1[prev] > height * 0.9 or x0[i] - left > height * 1.2
            if new:
                starts.append(k)
            left = x0[i] if new else min(left, x0[i])
            prev = i
        text = p["text"][order]
        ends = [*starts[1:], len(order)]
        n = np.diff([*starts, len(order)])
        least, most = ({c: f.reduceat(v[order], starts) for c, v in cs.items()} for f, cs in ((np.minimum, {"x0": x0, "y0": y0}), (np.maximum, {"x1": x1, "y1": y1})))
        joined = np.array(["\n".join(t for t in text[a:b] if t is not None) for a, b in zip(starts, ends, strict=True)], object)
        confidence = p["confidence"].astype(float)[order]
        known = ~np.isnan(confidence)
        mean = np.add.reduceat(np.where(known, confidence, 0), starts) / np.maximum(np.add.reduceat(known.astype(int), starts), 1)
        return {"block_order": np.arange(len(starts)), "text": joined, **least, **most, "confidence": mean, "n_lines": n}

    return by_page(slim, ["line_id"], group, "doc_id long, page_index int, block_order int, text string, x0 double, y0 double, x1 double, y1 double, confidence double, n_lines int")
