"""Cut texts over a size limit into pieces at natural boundaries, with overlaps, by recursive bisection.

A text longer than its limit is cut at the strongest boundary near its middle (blank line, line end, sentence end, clause
end, space, else between characters, never before a combining mark); halves longer than the limit less the overlap are cut
again. Then each piece but the first gets the end of the text before it as its overlap. So no piece exceeds the limit,
consecutive pieces overlap by exactly the stated number of characters, and the pieces without overlaps join to the text.

Defined results: null texts give no pieces; a text within its limit, an empty one, one whose type has no limit or a limit that is null or
not positive give one piece; an overlap that is null counts as 0, one of half the limit or more is taken as just under
half; repeated limits of a type: the least; repeated rows are cut each by itself; other columns pass through.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.arrow import fresh

BOUNDARIES = (
    regex.compile(r"\n[ \t]*\n\s*"),
    regex.compile(r"\n"),
    regex.compile(r"(?:[.!?…؟۔]+[\"'»”’“)\]]*\s+|[。！？।॥]+[」』”’）]*\s*)"),
    regex.compile(r"(?:[,;:،؛—–]\s+|[、，；：]\s*)"),
    regex.compile(r"\s+"),
)


def cut_points(text: str, core: int) -> list[int]:
    """Where the text is cut so that no part has more than `core` characters."""
    found = [np.array([m.end() for m in b.finditer(text)], np.int64) for b in BOUNDARIES]
    cuts: list[int] = []
    todo = [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= core:
            continue
        mid, reach = (a + b) // 2, max(1, (b - a) // 4)
        at = -1
        for where in found:
            i = int(np.searchsorted(where, mid))
            near = [int(where[j]) for j in (i - 1, i) if 0 <= j < len(where) and abs(where[j] - mid) <= reach and a < where[j] < b]
            if near:
                at = min(near, key=lambda x: (abs(x - mid), x))
                break
        if at < 0:
            at = mid
            while at > a + 1 and unicodedata.combining(text[at]):
                at -= 1
        cuts.append(at)
        todo += ((a, at), (at, b))
    return sorted(cuts)


def split_text(text: str, limit: int, overlap: int = 0) -> list[tuple[int, int, int]]:
    """(start of the piece, start of what is new in it, end), for each piece."""
    if limit <= 0 or len(text) <= limit:
        return [(0, 0, len(text))]
    overlap = max(0, min(overlap, (limit - 1) // 2))
    ends = [*cut_points(text, limit - overlap), len(text)]
    starts = [0, *ends[:-1]]
    return [(max(0, a - overlap), a, b) for a, b in zip(starts, ends, strict=True)]


def split_oversized(items: DataFrame, limits: DataFrame, column: str = "text", kind: str = "type") -> DataFrame:
    """One row per piece: the item's columns with `column` cut, and piece_no, n_pieces, new_from (characters of overlap).

    Items within their limit don't leave the JVM.
    """
    added = ("piece_no", "n_pieces", "new_from")
    items = items.drop(*added)
    own, most, lap = fresh(items, "_kind", "_max", "_over")
    pick = F.min(F.struct("max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("o")))
    least = limits.filter("max_chars > 0").groupBy(F.col(kind).alias(own)).agg(pick.alias(most)).select(own, F.col(f"{most}.o").alias(lap), F.col(f"{most}.max_chars").alias(most))
    # limits has a row per type; the types are a fixed vocabulary, and Catalyst checks the size before it broadcasts
    sized = items.filter(F.col(column).isNotNull()).join(least, F.col(kind) == F.col(own), "left").drop(own)
    over = F.coalesce(F.length(column) > F.col(most), F.lit(False))
    whole = sized.filter(~over).select(*items.columns, F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("new_from"))
    schema = T.StructType([*items.schema.fields, *(T.StructField(x, T.IntegerType()) for x in added)])
    names, kept = schema.names, items.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows, numbers = [], [], ([], [], [])
            for i, (text, limit, overlap) in enumerate(zip(batch.column(column).to_pylist(), batch.column(most).to_pylist(), batch.column(lap).to_pylist(), strict=True)):
                parts = split_text(text, limit, overlap)
                for k, (a, new, b) in enumerate(parts):
                    texts.append(text[a:b])
                    rows.append(i)
                    for to, x in zip(numbers, (k, len(parts), new - a), strict=True):
                        to.append(x)
            taken = pa.array(rows, pa.int64())
            columns = [pa.array(texts, pa.string()) if c == column else batch.column(c).take(taken) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int32()) for x in numbers)], names)

    return whole.unionByName(sized.filter(over).mapInArrow(cut, schema))


def oversized_blocks(blocks: DataFrame, limits: DataFrame) -> DataFrame:
    """(block_id), distinct: the blocks the operator had to cut."""
    return split_oversized(blocks.select("block_id", "type", "text"), limits).filter("n_pieces > 1").select("block_id").distinct()
