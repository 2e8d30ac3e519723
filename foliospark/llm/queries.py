"""The registered queries of this subpackage, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.llm import encoding, language, leaks, lookalikes, mixing, scans, sentences, sitelines, splitting
from foliospark.operators import chunking
from foliospark.session import table as t

Query = Callable[[SparkSession, str], DataFrame]


def p1_restored(s: SparkSession, d: str) -> DataFrame:
    """The restored fields, of HTML with its markup; a page's repeated rows count once where they are equal."""
    return encoding.restored_cases(encoding.fields(t(s, d, "source_pages"))).select("page_id", "field", "restored").distinct()


def p2_lines(s: SparkSession, d: str) -> DataFrame:
    """Changed lines in their one form."""
    lines = t(s, d, "block_lines").select("block_id", "line_no", "text")
    return lookalikes.canonical_lines(lines).filter("is_case").select("block_id", "line_no", "text").distinct()


def p2_blocks(s: SparkSession, d: str) -> DataFrame:
    """Changed blocks, each of their lines in its one form."""
    return lookalikes.canonical_lines(t(s, d, "blocks").select("block_id", "text")).filter("is_case").select("block_id", "text").distinct()


def p3_pieces(s: SparkSession, d: str) -> DataFrame:
    """The pieces of cut blocks; n_chars counts the overlap."""
    blocks = t(s, d, "blocks").select("block_id", "type", "text").distinct()
    return splitting.split_oversized(blocks, t(s, d, "chunk_limits")).filter("n_pieces > 1").select("block_id", "piece_no", "n_pieces", "new_from", F.length("text").alias("n_chars"), "text")


def p3_chunks(s: SparkSession, d: str) -> DataFrame:
    """Each correction run's chunks as counted then, and as they are with oversized blocks cut."""
    place = F.row_number().over(W.partitionBy("doc_id", "page_index").orderBy("block_order", "block_id"))
    blocks = t(s, d, "blocks").filter(F.col("type").isin(*chunking.CLEANABLE)).select("block_id", "doc_id", "page_index", "block_order", "type", "text").dropDuplicates(["block_id"]).withColumn("place", place)
    pieces = splitting.split_oversized(blocks, t(s, d, "chunk_limits"))
    runs = t(s, d, "clean_stats").select("run_id", "doc_id", "first_page", "last_page", F.col("chunks").cast("int").alias("stored")).dropDuplicates(["run_id"])
    seq = (F.col("page_index").cast("long") * 100_000 + F.col("place")) * 100_000 + F.col("piece_no")
    els = pieces.join(runs, "doc_id").filter("page_index BETWEEN first_page AND last_page").select(F.col("run_id").alias("doc_id"), seq.alias("seq"), "type", "text")
    now = chunking.pack_chunks(els).groupBy(F.col("doc_id").alias("run_id")).agg((F.max("chunk") + 1).cast("int").alias("chunks"))
    return runs.join(now, "run_id", "left").select("run_id", "stored", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def p4_documents(s: SparkSession, d: str) -> DataFrame:
    return language.languages(t(s, d, "document_meta"), t(s, d, "blocks"), t(s, d, "source_pages"))[0]


def p6_sources(s: SparkSession, d: str) -> DataFrame:
    """How many lines each source repeats, and the most documents one of them is in."""
    found = sitelines.repeated_lines(t(s, d, "blocks"), t(s, d, "document_meta"))
    return found.groupBy("source").agg(F.countDistinct("line").alias("n_lines"), F.max("n_docs").alias("most_docs"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: encoding.garbled_fields(t(s, d, "source_pages")),
        "p1_restored": p1_restored,
        "p2_found": lambda s, d: lookalikes.look_alike_lines(t(s, d, "block_lines")),
        "p2_lines": p2_lines,
        "p2_blocks": p2_blocks,
        "p3_found": lambda s, d: splitting.oversized_blocks(t(s, d, "blocks"), t(s, d, "chunk_limits")),
        "p3_pieces": p3_pieces,
        "p3_chunks": p3_chunks,
        "p4_found": lambda s, d: language.language_faults(t(s, d, "document_meta"), t(s, d, "blocks"), t(s, d, "source_pages")),
        "p4_documents": p4_documents,
        "p5_found": lambda s, d: scans.scan_noise(t(s, d, "blocks"), t(s, d, "document_meta"), t(s, d, "ocr_pages")),
        "p5_repaired": lambda s, d: scans.repaired(t(s, d, "blocks").dropDuplicates(["block_id"]), t(s, d, "document_meta"), t(s, d, "ocr_pages")).select("block_id", "doc_id", "page_index", "block_order", "type", "text"),
        "p5_paragraphs": lambda s, d: scans.paragraphs(t(s, d, "blocks").dropDuplicates(["block_id"]), t(s, d, "document_meta"), t(s, d, "ocr_pages")),
        "p5_lines": lambda s, d: scans.repaired_lines(t(s, d, "block_lines"), t(s, d, "blocks"), t(s, d, "ocr_pages")),
        "p6_found": lambda s, d: sitelines.site_line_hits(t(s, d, "blocks"), t(s, d, "document_meta")),
        "p6_clean": lambda s, d: sitelines.remove_site_lines(t(s, d, "blocks").dropDuplicates(["block_id"]), t(s, d, "document_meta")).select("block_id", "doc_id", "text"),
        "p6_sources": p6_sources,
        "p7_found": lambda s, d: leaks.leaked_items(t(s, d, "documents"), t(s, d, "eval_items")),
        "p8_shares": lambda s, d: mixing.actual_shares(t(s, d, "documents"), t(s, d, "mix_targets")),
        "p8_schedule": lambda s, d: mixing.schedule(t(s, d, "documents"), t(s, d, "mix_targets")),
        "p9_found": lambda s, d: sentences.sentence_ends(t(s, d, "documents")).distinct(),
        "p9_sentences": lambda s, d: sentences.sentences(t(s, d, "documents")),
    }


_SITE = r"""
WITH src AS (SELECT DISTINCT doc_id, source FROM document_meta WHERE source IS NOT NULL),
b AS (SELECT DISTINCT doc_id, block_id, text FROM blocks),
raw AS (SELECT doc_id, block_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM b),
keyed AS (SELECT doc_id, block_id, line_no, trim(regexp_replace(regexp_replace(lower(line), '\p{Nd}+', '#', 'g'), '[^\p{L}\p{Nd}#]+', ' ', 'g')) AS k FROM raw),
longer AS (SELECT * FROM keyed WHERE length(regexp_replace(k, '[^\p{L}]+', '', 'g')) >= 16),
n AS (SELECT source, count(DISTINCT doc_id) AS docs FROM b JOIN src USING (doc_id) GROUP BY source),
often AS (SELECT source, k, count(DISTINCT doc_id) AS n_docs FROM longer JOIN src USING (doc_id) JOIN n USING (source) GROUP BY source, k, docs HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT doc_id) >= 0.1 * docs)
"""


# Words without case, accents and marks; runs of 12 words, or of 24 letters and digits of items in scripts without spaces, compared as strings.
_PLAIN = r"regexp_replace(strip_accents(lower(nfc_normalize(text))), '[\p{Mn}\p{Cf}]', '', 'g')"
_LEAKS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_PLAIN}, '[\p{{L}}\p{{N}}]+') AS w, regexp_matches(text, '[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}]') AS wide FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all({_PLAIN}, '[\p{{L}}\p{{N}}]+') AS w, 2 * length(regexp_replace(text, '[^\p{{Han}}\p{{Hiragana}}\p{{Katakana}}]', '', 'g')) > length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) AS wide FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
iw AS (SELECT item_id, array_to_string(w[k:k + 11], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE NOT wide)),
dc AS (SELECT doc_id, x[k:k + 23] AS run FROM (SELECT doc_id, x, unnest(range(1, length(x) - 22)) AS k FROM (SELECT doc_id, array_to_string(w, '') AS x FROM d WHERE wide))),
ic AS (SELECT item_id, x[k:k + 23] AS run FROM (SELECT item_id, x, unnest(range(1, length(x) - 22)) AS k FROM (SELECT item_id, array_to_string(w, '') AS x FROM i WHERE wide)))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (run) UNION SELECT DISTINCT doc_id, item_id FROM dc JOIN ic USING (run)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p7_found": _LEAKS,
        "p3_found": "SELECT DISTINCT block_id FROM blocks JOIN chunk_limits USING (type) WHERE length(text) > max_chars",
        "p6_found": _SITE + "SELECT DISTINCT block_id, CAST(line_no AS INTEGER) AS line_no FROM longer JOIN src USING (doc_id) JOIN often USING (source, k)",
        "p6_sources": _SITE + "SELECT source, CAST(count(*) AS BIGINT) AS n_lines, CAST(max(n_docs) AS BIGINT) AS most_docs FROM often GROUP BY source",
    }
