"""Applying a corrector to chunks, guarded; the corrector is a plug-in, identity by default."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import similarity
from foliospark.functions import text as X
from foliospark.operators.chunking import pack_chunks
from foliospark.session import cut

Corrector = Callable[[str], str]
RETRIED = ("too_long", "meta_response", "empty")


def chunk_texts(els: DataFrame, max_chars: int = 4000) -> DataFrame:
    """(doc_id, chunk, seqs, original): the chunks' elements and their texts with blank lines between."""
    packed = els.select("doc_id", "seq", "text").join(pack_chunks(els, max_chars), ["doc_id", "seq"])
    rows = F.array_sort(F.collect_list(F.struct("seq", "text")))  # a chunk is at most max_chars long, or one element
    return packed.groupBy("doc_id", "chunk").agg(rows.alias("_r")).select("doc_id", "chunk", F.transform("_r", lambda x: x["seq"]).alias("seqs"), F.array_join(F.transform("_r", lambda x: x["text"]), "\n\n").alias("original"))


def correct(els: DataFrame, corrector: Corrector = lambda t: t, max_chars: int = 4000, tries: int = 3) -> tuple[DataFrame, DataFrame]:
    """Corrected elements, and (doc_id, chunk, outcome, reason, error) for each chunk, error being what the corrector raised last.

    A rejected answer is asked for again if that may help; a corrector that raises counts as a rejection, 'error'. An answer with another
    number of paragraphs than the chunk is rejected unless the chunk is one element. The expensive step is written to the
    checkpoint folder, so it runs once.
    """
    chunks = chunk_texts(els, max_chars)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers, errors = [], []
            for original in b["original"]:
                answer = error = None
                for _ in range(tries):
                    try:
                        answer = corrector(original)
                    except Exception as e:  # whatever a plug-in raises is that chunk's failure
                        error = f"{type(e).__name__}: {e}"
                        continue
                    text = (answer or "").strip()
                    if text and len(text) <= 1.25 * len(original) and not text[:180].lower().startswith(X.META_PREFIXES):
                        break
                answers.append(answer)
                errors.append(error if answer is None else None)
            yield b.assign(answer=answers, error=errors)

    asked = chunks.mapInPandas(ask, "doc_id long, chunk int, seqs array<long>, original string, answer string, error string")
    judged = cut(similarity.guarded(asked.withColumn("candidate", X.unwrap_answer(F.col("answer")))))
    parts = F.transform(F.split("candidate", r"\n\n"), X.strip)
    many = F.size("seqs") > 1
    reason = F.when(F.col("answer").isNull(), "error").when((F.col("reason") == "ok") & many & (F.size(parts) != F.size("seqs")), "paragraph_count").otherwise(F.col("reason"))
    decided = judged.withColumn("reason", reason).withColumn("_parts", F.when(many, parts).otherwise(F.array(X.strip(F.col("candidate")))))
    taken = decided.filter("reason = 'ok'").select("doc_id", F.explode(F.arrays_zip("seqs", "_parts")).alias("_z")).select("doc_id", F.col("_z.seqs").alias("seq"), F.col("_z._parts").alias("_new")).filter("_new <> ''")
    out = els.join(taken, ["doc_id", "seq"], "left").withColumn("text", F.coalesce("_new", "text")).drop("_new")
    changed = F.col("candidate") != X.strip(F.col("original"))
    outcome = F.when(F.col("reason") == "error", "error").when(F.col("reason") != "ok", "rejected").when(changed, "accepted").otherwise("unchanged")
    return out, decided.select("doc_id", "chunk", outcome.alias("outcome"), "reason", "error")


def correction_stats(outcomes: DataFrame) -> DataFrame:
    """A row for each document with its counts and the histogram of reasons of what was not taken."""
    by = outcomes.groupBy("doc_id").agg(F.count("*").alias("chunks"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("accepted", "rejected", "unchanged", "error")))
    reasons = outcomes.filter("reason <> 'ok'").groupBy("doc_id", "reason").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons"))
    return by.join(reasons, "doc_id", "left").withColumn("reasons", F.coalesce("reasons", F.create_map().cast("map<string,bigint>")))
