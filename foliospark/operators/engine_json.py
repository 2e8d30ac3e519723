"""Layout engines' JSON to blocks: composites flattened, labels mapped, lines joined, scaled to pixels, renumbered."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The block type of each engine label.
LABELS = {
    "title": "heading",
    "text": "text",
    "aside_text": "text",
    "algorithm": "text",
    "code": "text",
    "list": "list",
    "index": "list",
    "image": "figure",
    "image_body": "figure",
    "image_caption": "caption",
    "image_footnote": "caption",
    "table": "table",
    "table_body": "table",
    "table_caption": "caption",
    "table_footnote": "caption",
    "equation": "formula",
    "interline_equation": "formula",
    "header": "header",
    "discarded": "header",
    "footer": "footer",
    "page_number": "page_number",
    "page_footnote": "footnote",
    "footnote": "footnote",
}
KEPT_DISCARDED = ("header", "footer", "page_number", "footnote")
_SPAN = "STRUCT<type:STRING,content:STRING,html:STRING>"
_LINE = f"STRUCT<bbox:ARRAY<DOUBLE>,spans:ARRAY<{_SPAN}>>"
_LEAF = f"type:STRING,index:INT,level:INT,bbox:ARRAY<DOUBLE>,lines:ARRAY<{_LINE}>"
# Children of the third level stay JSON: few results go deeper, and those are taken apart in Python, as far down as they go.
_INNER = f"STRUCT<{_LEAF},blocks:ARRAY<STRUCT<{_LEAF},blocks:STRING>>>"
BLOCK = f"STRUCT<{_LEAF},blocks:ARRAY<{_INNER}>>"
PAGE = f"STRUCT<page_idx:INT,page_size:ARRAY<DOUBLE>,para_blocks:ARRAY<{BLOCK}>,discarded_blocks:ARRAY<{BLOCK}>>"


def block_type(label: Column) -> Column:
    """The block type of an engine's label, text for unknown ones."""
    pairs = [F.lit(x) for pair in LABELS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), F.lit("text"))


def leaves(children: list, order: int, at: tuple[int, ...] = ()) -> Iterator[tuple[list[int], int, str]]:
    """(path, order, JSON) of the blocks without children below; one without an order has its parent's."""
    for i, child in enumerate(x for x in children if isinstance(x, dict)):
        own = child.get("index") or order
        below = child.get("blocks")
        if isinstance(below, list) and below:
            yield from leaves(below, own, (*at, i))
        else:
            yield [*at, i], own, json.dumps({k: v for k, v in child.items() if k != "blocks"})


def _deepest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        kept = b.drop(columns=["below"])
        rows = []
        for i, (below, order) in enumerate(zip(b["below"], b["_order"], strict=True)):
            try:
                rows += [(i, *x) for x in leaves(json.loads(below), int(order))]
            except ValueError:
                continue
        out = kept.iloc[[r[0] for r in rows]].reset_index(drop=True)
        out["_path"] = [[*map(int, p), *r[1]] for p, r in zip(out["_path"], rows, strict=True)]
        out["_order"] = [r[2] for r in rows]
        yield out.assign(leaf=[r[3] for r in rows])


def span_text(span: Column) -> Column:
    content = F.coalesce(span["content"], F.lit(""))
    return F.when(content == "", "").when(span["type"] == "inline_equation", F.concat(F.lit("$"), content, F.lit("$"))).when(span["type"] == "interline_equation", F.concat(F.lit("$$\n"), content, F.lit("\n$$"))).otherwise(content)


def lines_text(lines: Column) -> Column:
    """Spans joined by a space, empty ones and empty lines left out, lines joined by line ends."""
    each = F.transform(F.coalesce(lines, F.array()), lambda ln: F.trim(F.array_join(F.filter(F.transform(F.coalesce(ln["spans"], F.array()), span_text), lambda s: s != ""), " ")))
    return F.array_join(F.filter(each, lambda t: t != ""), "\n")


def first_table(lines: Column) -> Column:
    spans = F.flatten(F.transform(F.coalesce(lines, F.array()), lambda ln: F.coalesce(ln["spans"], F.array())))
    return F.try_element_at(F.filter(spans, lambda s: (s["type"] == "table") & (F.coalesce(s["html"], F.lit("")) != "")), F.lit(1))["html"]


def engine_blocks(results: DataFrame) -> DataFrame:
    """Blocks of results (doc_id, json, width, height), a JSON page to a row, however deep its blocks are nested.

    Children stand for a parent that has some; one without an order gets its parent's. Discarded blocks that are no furniture are
    heads. A stable sort by order, position breaking ties, renumbers from 0. JSON that can't be read gives no blocks.
    """
    page = results.withColumn("_p", F.from_json("json", PAGE)).filter("_p IS NOT NULL")
    scale = [F.col("width") / F.get("_p.page_size", F.lit(0)), F.col("height") / F.get("_p.page_size", F.lit(1))]
    both = F.concat(
        F.transform(F.coalesce("_p.para_blocks", F.array()), lambda b: F.struct(F.lit(False).alias("gone"), b.alias("b"))),
        F.transform(F.coalesce("_p.discarded_blocks", F.array()), lambda b: F.struct(F.lit(True).alias("gone"), b.alias("b"))),
    )
    leaf = ("type", "index", "level", "bbox", "lines")
    one = page.select("doc_id", F.col("_p.page_idx").alias("page_index"), scale[0].alias("_sx"), scale[1].alias("_sy"), F.posexplode(both).alias("_i", "_x")).select("*", "_x.gone", "_x.b")

    def down(df: DataFrame, pos: str) -> DataFrame:
        """Rows whose block has children give these; others themselves."""
        child = F.when(F.size(F.coalesce("b.blocks", F.array())) > 0, F.col("b.blocks"))
        split = df.select("doc_id", "page_index", "_sx", "_sy", "gone", "_path", "_order", "b", F.posexplode_outer(child).alias(pos, "_c"))
        own = F.coalesce(F.nullif(F.col("_c.index"), F.lit(0)), F.col("_order"))
        fields = [F.coalesce(F.col(f"_c.{x}"), F.when(F.col("_c").isNull(), F.col(f"b.{x}"))).alias(x) for x in leaf]
        deeper = [F.col("_c.blocks").alias("blocks")]
        return split.select("doc_id", "page_index", "_sx", "_sy", "gone", F.concat("_path", F.array(F.coalesce(pos, F.lit(0)))).alias("_path"), F.when(F.col("_c").isNull(), F.col("_order")).otherwise(own).alias("_order"), F.struct(*fields, *deeper).alias("b"))

    first = one.withColumn("_path", F.array("_i")).withColumn("_order", F.coalesce("b.index", F.lit(0)))
    third = down(down(first, "_j"), "_k")
    nested = F.coalesce(F.col("b.blocks").rlike(r"^\s*\[\s*\{"), F.lit(False))
    keep = ("doc_id", "page_index", "_sx", "_sy", "gone", "_path", "_order")
    deep = third.filter(nested).select(*keep, F.col("b.blocks").alias("below"))
    schema = "doc_id long, page_index int, _sx double, _sy double, gone boolean, _path array<int>, _order int, leaf string"
    deep = deep.select(F.col("doc_id").cast("long").alias("doc_id"), *keep[1:], "below").mapInPandas(_deepest, schema).select(*keep, F.from_json("leaf", f"STRUCT<{_LEAF}>").alias("b"))
    flat = third.filter(~nested).select(*keep, F.struct(*(F.col(f"b.{x}").alias(x) for x in leaf)).alias("b")).unionByName(deep)
    kind = block_type(F.col("b.type"))
    kind = F.when(F.col("gone") & ~kind.isin(*KEPT_DISCARDED), "header").otherwise(kind)
    box = [(F.coalesce(F.get("b.bbox", F.lit(i)), F.lit(0.0)) * F.col("_sx" if i % 2 == 0 else "_sy")).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    order = F.row_number().over(W.partitionBy("doc_id", "page_index").orderBy("_order", "_path")) - 1
    return flat.select("doc_id", "page_index", order.alias("block_order"), kind.alias("type"), *box, lines_text(F.col("b.lines")).alias("text"), F.when(kind == "heading", F.coalesce("b.level", F.lit(0))).otherwise(0).alias("level"), F.when(kind == "table", first_table(F.col("b.lines"))).alias("html"))


def box_of_polygon(points: Column) -> Column:
    """x0, y0, x1, y1 of an array of points (x, y)."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
