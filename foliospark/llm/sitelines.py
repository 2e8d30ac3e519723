"""Lines repeated across the documents of one source: find them and take them out.

Each candidate line's documents are kept as compressed bitmaps, per source and per spelling of the line: cut into containers of 32,768
document numbers each, a container is a list of the 2-byte numbers in it up to MOST_LISTED, a bitmap of 4 KB beyond, and isn't there
where it is empty. So few documents, however far apart, cost no more than their number. The containers of all spellings of
one line are united, their exact cardinalities are held against the thresholds, and a line is deleted where its own document is in its
container.

A line that qualifies has at least as many rows in its source as the threshold asks for documents, so a plain count with
map-side combine leaves only few lines for which bitmaps are built; it drops none that qualifies.

Defined results: null, empty and short lines are never reported; documents without a source or without metadata are kept
unchanged; a document recorded under two sources counts in both; repeated rows count once; other columns pass through.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.arrow import fresh

MIN_LETTERS, MIN_DOCS, MIN_SHARE = 16, 3, 0.10
#: Documents of a container that are listed; a list of more would be longer than a bitmap.
MOST_LISTED = 2048
#: So many line hashes, of 8 bytes each, may be sent to every executor.
MOST_SENT = 200_000


def line_key(line: Column) -> Column:
    """Lower case, each run of digits one '#', each run of anything but letters, digits and '#' one space, trimmed."""
    lowered = F.lower(line)
    digits = F.regexp_replace(lowered, r"\p{Nd}+", "#")
    return F.trim(F.regexp_replace(digits, r"[^\p{L}\p{Nd}#]+", " "))


def site_lines(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, line_no, variant, line): hashed lines long enough to count, line being the hash of the key."""
    lines = blocks.select("doc_id", "block_id", F.posexplode(F.split("text", "\n")).alias("line_no", "_raw")).filter(F.length("_raw") >= MIN_LETTERS)
    keyed = lines.select("doc_id", "block_id", "line_no", F.hash("_raw").alias("variant"), line_key(F.col("_raw")).alias("_key"))
    letters = F.length(F.regexp_replace("_key", r"[^\p{L}]+", ""))
    return keyed.filter(letters >= MIN_LETTERS).select("doc_id", "block_id", "line_no", "variant", F.xxhash64("_key", F.length("_key")).alias("line"))


def _shared(lines: DataFrame, min_docs: int, most_sent: int = MOST_SENT) -> DataFrame:
    """The rows of lines that stand in more than one document and on min_docs rows at least, whatever their source.

    Rows of other lines can't qualify. Counting moves a hash and three numbers for each distinct line of a task; where few lines are
    left, which is checked, they go to the executors, else both sides are joined on the hash.
    """
    often = lines.groupBy("line").agg(F.count("*").alias("_n"), F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).filter((F.col("_n") >= min_docs) & (F.col("_a") != F.col("_b"))).select("line").persist()
    few = often.limit(most_sent + 1).count() <= most_sent
    return lines.join(F.broadcast(often) if few else often, "line", "left_semi")


def repeated_lines(blocks: DataFrame, meta: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, shared: DataFrame | None = None, most_listed: int = MOST_LISTED) -> DataFrame:
    """(source, line, container, listed, bits, n_docs): the lines repeated too often, with their documents: numbers in the container, or a bitmap of it."""
    shared = _shared(site_lines(blocks), min_docs) if shared is None else shared
    sources = meta.filter(F.col("source").isNotNull()).select("doc_id", "source").distinct()
    having = blocks.select("doc_id").distinct().join(sources, "doc_id").groupBy("source").agg(F.count("*").alias("_docs"))
    need = F.greatest(F.lit(min_docs), F.ceil(F.col("_docs") * min_share - 1e-9)).cast("long")
    needed = having.select("source", need.alias("_need"))
    of_source = shared.join(sources, "doc_id")
    often = of_source.groupBy("source", "line").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_docs).join(needed, "source").filter("_n >= _need").select("source", "line", "_need")
    # one row for each document of a spelling, by hash aggregation, so that what is listed has no repeats
    container = ["source", "line", "_need", "container"]
    place = F.bitmap_bit_position("doc_id")
    once = of_source.join(often, ["source", "line"]).select(*container[:3], F.bitmap_bucket_number("doc_id").alias("container"), "variant", place.cast("short").alias("place")).distinct().persist(StorageLevel.DISK_ONLY)
    full = once.groupBy(*container).agg(F.count("*").alias("_m")).filter(F.col("_m") > most_listed).select(*container)
    lists = once.join(full, container, "left_anti").groupBy(*container, "variant").agg(F.collect_list("place").alias("_listed"))
    united_lists = lists.groupBy(*container).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_listed")))).alias("listed"))
    maps = once.join(full, container, "left_semi").groupBy(*container, "variant").agg(F.bitmap_construct_agg(F.col("place").cast("long")).alias("_bits"))
    united_maps = maps.groupBy(*container).agg(F.bitmap_or_agg("_bits").alias("bits"))
    united = united_lists.unionByName(united_maps, allowMissingColumns=True)
    size = F.coalesce(F.size("listed"), F.bitmap_count("bits"))
    enough = united.groupBy("source", "line", "_need").agg(F.sum(size).alias("n_docs")).filter("n_docs >= _need")
    return united.join(enough.drop("_need"), ["source", "line"]).drop("_need")


def _holds(listed: Column, bits: Column, place: Column) -> Column:
    """Whether a document's place is in a container; of a bitmap byte `place` div 8 counts from its lowest bit."""
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.when(listed.isNotNull(), F.array_contains(listed, place.cast("short"))).otherwise(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1)


def site_line_hits(blocks: DataFrame, meta: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, most_listed: int = MOST_LISTED, most_sent: int = MOST_SENT) -> DataFrame:
    """(block_id, line_no), distinct: the lines to delete, by bitmap lookup."""
    shared = _shared(site_lines(blocks).persist(StorageLevel.DISK_ONLY), min_docs, most_sent).persist(StorageLevel.DISK_ONLY)
    found = repeated_lines(blocks, meta, min_docs, min_share, shared, most_listed)
    sources = meta.filter(F.col("source").isNotNull()).select("doc_id", "source").distinct()
    here = shared.join(sources, "doc_id").withColumn("container", F.bitmap_bucket_number("doc_id"))
    hit = here.join(found, ["source", "line", "container"]).filter(_holds(F.col("listed"), F.col("bits"), F.bitmap_bit_position("doc_id")))
    return hit.select("block_id", F.col("line_no").cast("int")).distinct()


def remove_site_lines(blocks: DataFrame, meta: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """The blocks, other columns unchanged, their text without the repeated lines; a text of nothing else becomes empty."""
    (gone,) = fresh(blocks, "_gone")
    hits = site_line_hits(blocks, meta, min_docs, min_share).groupBy("block_id").agg(F.collect_set("line_no").alias(gone))
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col(gone), i))
    return blocks.join(hits, "block_id", "left").withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).select(*blocks.columns)
