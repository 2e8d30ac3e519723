"""Mix sources to target shares of the total size in tokens, on a low-discrepancy schedule.

Documents of a source are shuffled by a hash and packed into blocks of about equal token counts. A source's quota is its share
of the total, but no more than max_repeats times what it has; what capped sources leave is spread over the others in
proportion. Slot k of the schedule is sent by the golden-ratio point frac((k + 1/2) * phi) through the cumulative quotas to
a source; the slot's rank among its source's slots names the block and the pass over the source. No source is used more than
max_repeats times over, as a source has no more slots than its blocks times max_repeats; slots beyond that are dropped from
the schedule and show in the actual shares.

Prefix sums and ranks are taken over hash buckets, as many as the documents need, and within them, so a source with any part of the rows, and a
schedule of any length, is spread over many tasks. A slot finds its source by binary search in its profile's cumulative quotas. What is sent
to the executors is one row for each profile and source of the targets, and the tokenizer's file.

Defined results: null and empty texts count 0 tokens and are left out; documents without source, or whose source is not in
the profile, are left out; a target without documents has an actual share of 0; null or negative shares count as 0, null
repeats as 1, repeats below 1 as 0; repeated targets of a profile and source: the largest share; repeated documents count as often as they stand there.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.arrow import by_row, slices

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How that vocabulary cuts text before merging; fixed value of the public tokenizer.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PHI = 0.6180339887498949
#: Documents that share a hash bucket, about: what a task sorts.
BUCKET_ROWS = 20_000
#: Blocks have this many tokens, but fewer where that would make less than LEAST_BLOCKS of all text, and no fewer than a document has on average.
BLOCK_TOKENS, LEAST_BLOCKS = 8_000, 5_000


@lru_cache(2)
def _encoding(path: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Token counts of texts. Cuts between a character and a single space can't be inside a token, so words are counted once each."""

    def __init__(self, path: str) -> None:
        self.encode = _encoding(path).encode_ordinary
        self.known: dict[str, int] = {}

    def of(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            if len(self.known) > 500_000:
                self.known.clear()
            n = self.known[word] = len(self.encode(word))
        return n

    def counts(self, column: pa.Array) -> np.ndarray:
        column = pc.fill_null(column, "")
        odd = pc.match_substring_regex(column, r"\s \s|  |^ | $|\s ").to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(column, " ")
        flat = lists.flatten().dictionary_encode()
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = flat.dictionary.to_pylist()
        inner = np.array([self.of(f" {w}") for w in words], np.int64)
        out = by_row(np.add, inner[codes], offsets.astype(np.int64)) if len(codes) else np.zeros(len(column), np.int64)
        first = codes[offsets[:-1]]
        for i in np.flatnonzero(~odd):
            w = words[first[i]]
            out[i] += self.of(w) - self.of(f" {w}")
        for i in np.flatnonzero(odd):
            out[i] = len(self.encode(column[i].as_py()))
        return out


def _shipped(spark: SparkSession, path: str) -> str:
    """Sends the tokenizer's file with the job; the name under which tasks find it."""
    spark.sparkContext.addFile(path)
    return path.replace("\\", "/").rsplit("/", 1)[-1]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The documents' other columns and n_tokens, without the text."""
    names = [c for c in documents.columns if c not in ("text", "n_tokens")]
    schema = T.StructType([*(documents.schema[n] for n in names), T.StructField("n_tokens", T.LongType())])
    file = _shipped(documents.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(SparkFiles.get(file))
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(counter.counts(batch.column("text")))], [*names, "n_tokens"])

    return documents.select(*names, "text").mapInArrow(run, schema)


def packed(documents: DataFrame, tokenizer: str = TOKENIZER, block_tokens: int | None = None, seed: int = 7) -> DataFrame:
    """(source, doc_id, n_tokens, block): shuffled documents of each source in blocks of about block_tokens, numbered from 0.

    By default a block's size follows from all documents' tokens.
    """
    sized = token_counts(documents.filter("source IS NOT NULL AND text <> ''").select("doc_id", "source", "text"), tokenizer).filter("n_tokens > 0").persist(StorageLevel.DISK_ONLY)
    rows, tokens = sized.agg(F.count("*"), F.sum("n_tokens")).first()
    if block_tokens is None:
        block_tokens = max(1, (tokens or 0) // max(1, rows), min(BLOCK_TOKENS, (tokens or 0) // LEAST_BLOCKS))
    keyed = sized.withColumn("_h", F.xxhash64("doc_id", F.lit(seed))).withColumn("_bucket", F.pmod("_h", F.lit(max(1, -(-rows // BUCKET_ROWS)))))
    sums = keyed.groupBy("source", "_bucket").agg(F.sum("n_tokens").alias("_sum"))
    before = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("source", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    within = W.partitionBy("source", "_bucket").orderBy("_h", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    at = F.coalesce(F.sum("n_tokens").over(within), F.lit(0)) + F.col("_offset")
    return keyed.join(offsets, ["source", "_bucket"]).select("source", "doc_id", "n_tokens", F.floor(at / block_tokens).alias("block"))


def _quotas(targets: list[tuple[str, str, float, int]], have: dict[str, int]) -> dict[tuple[str, str], float]:
    """Tokens for each profile and source: shares of all tokens of the profile's sources, capped, the rest spread."""
    out: dict[tuple[str, str], float] = {}
    for profile in sorted({p for p, *_ in targets}):
        own = {s: (max(0.0, w), have.get(s, 0) * max(0, r)) for p, s, w, r in targets if p == profile}
        total = float(sum(have.get(s, 0) for s in own))
        quota = dict.fromkeys(own, 0.0)
        open_, left = {s for s, (w, cap) in own.items() if w > 0 and cap > 0}, total
        while open_ and left > 1e-6:
            weight = sum(own[s][0] for s in open_)
            full = {s for s in open_ if quota[s] + left * own[s][0] / weight >= own[s][1]}
            if not full:
                for s in open_:
                    quota[s] += left * own[s][0] / weight
                break
            for s in full:
                left -= own[s][1] - quota[s]
                quota[s] = float(own[s][1])
            open_ -= full
        out |= {(profile, s): q for s, q in quota.items()}
    return out


def _plan(documents: DataFrame, targets: DataFrame, tokenizer: str, block_tokens: int | None) -> tuple[DataFrame, list[tuple[str, str, float, int]], dict[str, tuple[int, int]], dict[tuple[str, str], float]]:
    """Packed documents, clean targets, each target source's blocks and tokens, and quotas. A row for each target comes to the driver."""
    pack = packed(documents, tokenizer, block_tokens).persist(StorageLevel.DISK_ONLY)
    clean = targets.filter("profile IS NOT NULL AND source IS NOT NULL").groupBy("profile", "source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("w"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("r"))
    wanted = [(x.profile, x.source, float(x.w), int(x.r)) for x in clean.toLocalIterator()]
    sizes = pack.join(clean.select("source").distinct(), "source", "left_semi").groupBy("source").agg((F.max("block") + 1).alias("b"), F.sum("n_tokens").alias("n"))
    have = {x.source: (int(x.b), int(x.n)) for x in sizes.toLocalIterator()}
    return pack, wanted, have, _quotas(wanted, {s: n for s, (_, n) in have.items()})


def schedule(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, block_tokens: int | None = None) -> DataFrame:
    """(profile, slot, source, pass, doc_id, n_tokens): the mix in order, slot by slot."""
    spark = documents.sparkSession
    pack, wanted, have, quotas = _plan(documents, targets, tokenizer, block_tokens)
    rows, slots = [], []
    for profile in sorted({p for p, *_ in wanted}):
        own = [(s, quotas[profile, s], r) for p, s, _, r in sorted(wanted) if p == profile and quotas[profile, s] > 0]
        total, at = sum(q for _, q, _ in own), 0.0
        for s, q, r in own:
            blocks, tokens = have[s]
            # a slot is one block; blocks of a source hold tokens / blocks tokens each, so its slots are as many as fill its quota
            rows.append((profile, s, blocks, min(blocks * r, round(q * blocks / tokens))))
        n = sum(x[3] for x in rows if x[0] == profile)
        cut = 0.0
        for p, s, b, k in [x for x in rows if x[0] == profile]:
            slots.append((p, s, cut / max(1, n), (cut + k) / max(1, n), b, k, n))
            cut += k
    lengths = {p: n for p, *_, n in slots}
    numbers = None
    for p, n in sorted(lengths.items()):
        one = spark.range(0, n, 1, max(1, min(64, n // 5000))).select(F.lit(p).alias("profile"), F.col("id").alias("slot"))
        numbers = one if numbers is None else numbers.unionByName(one)
    if numbers is None:
        return spark.createDataFrame([], "profile string, slot long, source string, pass int, doc_id long, n_tokens long")
    # each profile's sources by where their part of the cumulative weights ends: a row for each target
    parts = {p: [(high, s, b, k) for q, s, _, high, b, k, _ in slots if q == p and k > 0] for p in lengths}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = {p: np.array([high for high, *_ in own]) for p, own in parts.items()}
        for batch in batches:
            profiles, slot = batch.column("profile").to_pylist(), batch.column("slot").to_numpy()
            x = ((slot + 0.5) * PHI) % 1.0
            got = [None] * len(slot)
            for p in set(profiles):
                at = np.flatnonzero(np.array([q == p for q in profiles]))
                for i, k in zip(at.tolist(), np.minimum(np.searchsorted(ends[p], x[at], side="right"), len(ends[p]) - 1).tolist(), strict=True):
                    got[i] = parts[p][k][1:]
            columns = [pa.array([g[c] for g in got], t) for c, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["profile", "slot", "source", "blocks", "most"])

    sent = numbers.mapInArrow(send, "profile string, slot long, source string, blocks long, most long").withColumn("_part", F.floor(F.col("slot") / 4096))
    counts = sent.groupBy("profile", "source", "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy("profile", "source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("profile", "source", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(W.partitionBy("profile", "source", "_part").orderBy("slot")) - 1
    ranked = sent.withColumn("_r", rank).join(offsets, ["profile", "source", "_part"]).withColumn("rank", F.col("_r") + F.col("_offset")).filter("rank < most")
    ranked = ranked.select("profile", "slot", "source", F.floor(F.col("rank") / F.col("blocks")).cast("int").alias("pass"), (F.col("rank") % F.col("blocks")).alias("block"))
    return ranked.join(pack, ["source", "block"]).select("profile", "slot", "source", "pass", "doc_id", "n_tokens")


def actual_shares(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, block_tokens: int | None = None) -> DataFrame:
    """(profile, source, target_share, actual_share, n_tokens, times_used) for each target."""
    mix = schedule(documents, targets, tokenizer, block_tokens)
    got = mix.groupBy("profile", "source").agg(F.sum("n_tokens").alias("n_tokens"), (F.max("pass") + 1).cast("int").alias("times_used"))
    totals = got.groupBy("profile").agg(F.sum("n_tokens").alias("_all"))
    clean = targets.filter("profile IS NOT NULL AND source IS NOT NULL").groupBy("profile", "source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"))
    return (
        clean.join(got, ["profile", "source"], "left")
        .join(totals, "profile", "left")
        .select("profile", "source", "target_share", F.round(F.coalesce(F.col("n_tokens") / F.col("_all"), F.lit(0.0)), 6).alias("actual_share"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("times_used", F.lit(0)).alias("times_used"))
    )
