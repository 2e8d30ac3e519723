"""Helpers for Arrow-batched Python stages."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 2_000_000


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = MAX_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds about `most` bytes of text, one row at least. No row is cut or left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points in one array, and the offsets at which each text begins, with the end."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def by_row(ufunc: np.ufunc, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """ufunc.reduceat for rows that may be empty; those get 0."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = ufunc.reduceat(values, offsets[full], axis=0)
    return out


def words_of(column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The white-space separated words of a text column: codes into the distinct words, these, and row offsets."""
    lists = pc.utf8_split_whitespace(pc.fill_null(column, ""))
    flat = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary.to_pylist(), offsets.astype(np.int64)


def slot(word: str, bits: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that the frame has."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = f"_{n}"
        have.add(n.lower())
        out.append(n)
    return out


def dense_tables(counts: DataFrame, tables: int, bits: int) -> np.ndarray:
    """Counters (k, slot, n) summed up as a tables x 2**bits array on the driver.

    They come as compressed chunks of 2**14 counters, four bytes each, so the driver gets at most tables * 2**(bits + 2) bytes whatever the
    corpus, and less where few are used.
    """
    low = min(bits, 14)

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(1 << low, np.float32)
        np.add.at(out, p["slot"].to_numpy() & ((1 << low) - 1), p["n"].to_numpy())
        return pd.DataFrame({"k": [p["k"].iloc[0]], "chunk": [p["chunk"].iloc[0]], "data": [zlib.compress(out.tobytes(), 1)]})

    summed = counts.groupBy("k", "slot").agg(F.sum("n").alias("n")).withColumn("chunk", F.shiftright("slot", low))
    out = np.zeros((tables, 1 << bits), np.float32)
    for r in summed.groupBy("k", "chunk").applyInPandas(pack, "k int, chunk int, data binary").toLocalIterator():
        out[r["k"], r["chunk"] << low : (r["chunk"] + 1) << low] = np.frombuffer(zlib.decompress(r["data"]), np.float32)
    return out


class Tally:
    """Counts with a bounded number of keys in memory: beyond it, what is there goes out as partial sums."""

    def __init__(self, most: int = 200_000) -> None:
        self.most, self.n = most, {}

    def add(self, key, n: int = 1) -> None:
        self.n[key] = self.n.get(key, 0) + n

    def full(self) -> bool:
        return len(self.n) >= self.most

    def drain(self, make: Callable[[dict], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield make(self.n)
            self.n = {}
