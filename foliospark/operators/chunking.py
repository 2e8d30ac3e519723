"""Packing elements into chunks, and splitting documents into chapters.

Both are greedy and so depend on all that came before in a document. A document is cut into segments of SEGMENT rows; each segment is
summarised for every state it can be entered in, the summaries are chained, and the segments are then labelled each by itself, so no
task holds more than a segment and a document's summaries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions import text as X
from foliospark.operators.running import running_sums

CLEANABLE = ("text", "list", "caption", "footnote")
BODY = ("text", "list", "table", "figure")
SEGMENT = 5_000


def _next_starts(n: np.ndarray, most: int) -> np.ndarray:
    """For a chunk that starts at each element, where the next one starts; len(n) for beyond the segment."""
    upto = np.concatenate([[0], np.cumsum(n)])
    return np.maximum(np.searchsorted(upto, upto[:-1] + most, side="right") - 1, np.arange(1, len(n) + 1))


def _summary(n: np.ndarray, most: int) -> tuple[list[int], list[int], list[int]]:
    """For each element that can be the first to start a chunk: the greatest size with which the elements before it fit, the size at the segment's end, and the chunks begun.

    The last entry is for a chunk that goes through: its room, and what the segment adds to it, with no chunk begun.
    """
    k, upto, nxt = len(n), np.concatenate([[0], np.cumsum(n)]), _next_starts(n, most)
    size, begun = np.zeros(k, np.int64), np.zeros(k, np.int64)
    for i in range(k - 1, -1, -1):
        j = nxt[i]
        size[i], begun[i] = (upto[k] - upto[i], 1) if j >= k else (size[j], begun[j] + 1)
    reach = np.flatnonzero(upto[:-1] <= most)
    room = (most - upto[reach]).tolist()
    return [*room, int(most - upto[k])], [*size[reach].tolist(), int(upto[k])], [*begun[reach].tolist(), 0]


def _enter(size: int, room: list[int], exits: list[int], begun: list[int]) -> tuple[int, int]:
    """The size at the end and the chunks begun, for a segment entered with an open chunk of `size`; 0 for none open."""
    if size == 0:
        return exits[0], begun[0]
    # element i starts a chunk if those before it fit and it doesn't
    fits = np.searchsorted(-np.array(room), -size, side="right")
    if fits >= len(room):
        return size + exits[-1], begun[-1]
    first = max(0, int(fits) - 1)
    return exits[first], begun[first]


def pack_chunks(els: DataFrame, max_chars: int = 4000) -> DataFrame:
    """(doc_id, seq, chunk): consecutive cleanable texts, greedily packed up to max_chars; a longer one is its own chunk.

    Others are skipped and don't end a chunk; blank and null texts are skipped.
    """
    some = els.filter(F.col("type").isin(*CLEANABLE) & (X.strip(F.coalesce("text", F.lit(""))) != "")).select("doc_id", "seq", F.length("text").alias("n"))
    numbered = some.withColumn("_seg", F.floor((F.row_number().over(W.partitionBy("doc_id").orderBy("seq")) - 1) / SEGMENT).cast("int")).persist(StorageLevel.DISK_ONLY)  # read twice

    def summarise(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("seq")
        room, exits, begun = _summary(p["n"].to_numpy(np.int64), max_chars)
        return pd.DataFrame({"doc_id": [p["doc_id"].iloc[0]], "_seg": [p["_seg"].iloc[0]], "room": [room], "exits": [exits], "begun": [begun]})

    def chain(p: pd.DataFrame) -> pd.DataFrame:
        p, size, done, out = p.sort_values("_seg"), 0, 0, []
        for r in p.itertuples(index=False):
            out.append((r.doc_id, r[1], size, done))
            size, new = _enter(size, list(r.room), list(r.exits), list(r.begun))
            done += new
        return pd.DataFrame(out, columns=["doc_id", "_seg", "_size", "_done"])

    def label(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("seq")
        size, chunk, out = int(p["_size"].iloc[0]), int(p["_done"].iloc[0]) - 1, []
        for n in p["n"].tolist():
            if size == 0 or size + n > max_chars:
                size, chunk = 0, chunk + 1
            size += n
            out.append(chunk)
        return pd.DataFrame({"doc_id": p["doc_id"], "seq": p["seq"], "chunk": out})

    states = numbered.groupBy("doc_id", "_seg").applyInPandas(summarise, "doc_id long, _seg int, room array<long>, exits array<long>, begun array<long>").groupBy("doc_id").applyInPandas(chain, "doc_id long, _seg int, _size long, _done long")
    return numbered.join(states, ["doc_id", "_seg"]).groupBy("doc_id", "_seg").applyInPandas(label, "doc_id long, seq long, chunk int")


def split_chapters(els: DataFrame, most: int = 400) -> DataFrame:
    """(doc_id, seq, chapter, title): cut at headings of the highest level there is, and at any heading after `most` body elements.

    Chapters of page breaks only are left out after numbering. The title is the heading that began the chapter, else the first one in
    it, else "Part k".
    """
    heading = (F.col("type") == "heading") & (F.coalesce("level", F.lit(0)) > 0)
    # read several times: without texts but headings', on disk
    els = els.select("doc_id", "seq", "type", F.when(F.col("type") == "heading", F.col("text")).alias("text"), "level").persist(StorageLevel.DISK_ONLY)
    tops = els.groupBy("doc_id").agg(F.min(F.when(heading, F.col("level"))).alias("_top"), F.min("seq").alias("_begin"))
    base = els.join(tops, "doc_id").withColumn("_first", F.col("seq") == F.col("_begin")).drop("_begin")
    base = base.withColumn("_cut", F.coalesce((F.col("type") == "heading") & (F.col("level") == F.col("_top")) & ~F.col("_first"), F.lit(False)))
    body = F.coalesce(F.col("type").isin(*BODY), F.lit(False)).cast("int")
    base = running_sums(base, _part=F.col("_cut").cast("int"), _body=body).withColumn("_body", F.col("_body") - body)
    start = base.groupBy("doc_id", "_part").agg(F.min("_body").alias("_from"), F.max("_body").alias("_to")).filter(F.col("_to") - F.col("_from") >= most)
    inner = base.filter("type = 'heading' AND NOT _cut").join(start, ["doc_id", "_part"]).filter(F.col("_body") - F.col("_from") >= most).select("doc_id", "_part", "seq", "_body", "_from")

    def force(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("seq")
        since, out = int(p["_from"].iloc[0]), []
        for seq, body in zip(p["seq"].tolist(), p["_body"].tolist(), strict=True):
            if body - since >= most:
                since = body
                out.append(seq)
        return pd.DataFrame({"doc_id": [p["doc_id"].iloc[0]] * len(out), "seq": out})

    forced = inner.groupBy("doc_id", "_part").applyInPandas(force, "doc_id long, seq long").withColumn("_forced", F.lit(True))
    cut = base.join(forced, ["doc_id", "seq"], "left").withColumn("_cut", F.col("_cut") | F.coalesce("_forced", F.lit(False)))
    numbered = running_sums(cut.drop("_forced"), chapter=F.col("_cut").cast("int")).withColumn("chapter", F.col("chapter").cast("int"))
    first_is_split = F.col("_first") & (F.col("type") == "heading") & (F.col("level") == F.col("_top"))
    named = F.when(F.col("type") == "heading", F.when(X.strip(F.col("text")) != "", X.strip(F.col("text"))))
    titles = numbered.groupBy("doc_id", "chapter").agg(
        F.min_by(F.when(F.col("_cut") | first_is_split, named), F.when(F.col("_cut") | first_is_split, F.col("seq"))).alias("_own"),
        F.min_by(named, F.when(named.isNotNull(), F.col("seq"))).alias("_any"),
        F.max((F.col("type") != "page_break").cast("int")).alias("_real"),
    )
    title = F.coalesce("_own", "_any", F.concat(F.lit("Part "), (F.col("chapter") + 1).cast("string")))
    return numbered.select("doc_id", "seq", "chapter").join(titles.filter("_real = 1").select("doc_id", "chapter", title.alias("title")), ["doc_id", "chapter"]).select("doc_id", "seq", "chapter", "title")
