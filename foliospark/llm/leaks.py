"""Passages of evaluation items inside corpus documents, by a prefix-filtered set join.

A document holds an item's passage when it has `run` consecutive words of it. Such a run holds run-4 consecutive shingles of
five words, all of which both sides must share, so of each item window only its rarest shingle in the corpus (the necessary
prefix of the shingles ordered by rarity) has to be looked for. Where a document has one, the positions are aligned, the
shared words are counted to both sides within the item-sized window, and a count of `run` or more is an exact
verification. Chinese and Japanese items work alike on letters and digits: 24 in a row, shingles of eight.

Items are taken in blocks of bounded text size, each block against all documents; what goes to the executors is one
block's words and shingles, whatever the number of items. Words are compared without case, accents, punctuation and white
space between them.

Defined results: null or too short texts match nothing; repeated items or documents give one row for each pair of ids; a
document that holds several items gives a row for each; other columns are ignored.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.arrow import slices, words_of

RUN_WORDS, RUN_CHARS, SHINGLE_WORDS, SHINGLE_CHARS = 12, 24, 5, 8
BLOCK_BYTES = 8_000_000
SPACELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
TOKEN = regex.compile(r"[^\W_]+")
LETTERS = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ð": "d", "ħ": "h", "ı": "i", "æ": "ae", "œ": "oe", "þ": "th"})
BASE = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> str:
    """Without case and accents."""
    folded = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold())
    return "".join(c for c in folded if unicodedata.category(c) not in ("Mn", "Cf")).translate(LETTERS)


def words(text: str) -> list[str]:
    return TOKEN.findall(plain(text))


def spaceless(text: str) -> bool:
    return 2 * len(SPACELESS.findall(text)) > sum(c.isalnum() for c in text)


def hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` ids; 0 where one of them is unknown (below 0)."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, ok = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(size):
        part = ids[k : k + n]
        ok &= part >= 0
        out = (out ^ (part.astype(np.uint64) + np.uint64(1))) * BASE
        out ^= out >> np.uint64(29)
    out[~ok] = 0
    return out


@dataclass
class Side:
    """The items of one block that are compared in words, or those compared in letters."""

    run: int
    size: int
    vocabulary: dict[str, int] = field(default_factory=dict)
    items: list[int] = field(default_factory=list)
    parts: list[np.ndarray] = field(default_factory=list)
    offsets: list[int] = field(default_factory=lambda: [0])

    def add(self, item: int, tokens: list[str]) -> None:
        if len(tokens) < self.run:
            return
        ids = [self.vocabulary.setdefault(t, len(self.vocabulary)) for t in tokens]
        self.parts.append(np.array([*ids, -1], np.int64))
        self.items.append(item)
        self.offsets.append(self.offsets[-1] + len(ids) + 1)

    @property
    def flat(self) -> np.ndarray:
        """The items' ids one after the other, put together once."""
        if len(self.parts) != 1:
            self.parts = [np.concatenate([np.zeros(0, np.int64), *self.parts])]
        return self.parts[0]

    def shingles(self) -> np.ndarray:
        h = hashes(self.flat, self.size)
        return np.unique(h[h > 0])

    def prefixes(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes, sorted, and item positions of each window's rarest shingle."""
        h = hashes(self.flat, self.size)
        rarity = np.array([counts.get(int(x), 0) for x in h.astype(np.int64)], np.int64)
        per = self.run - self.size + 1
        rank = np.empty(len(h), np.int64)
        rank[np.lexsort((h, rarity))] = np.arange(len(h))
        starts = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b - self.run) for a, b in itertools.pairwise(self.offsets))])
        windows = np.lib.stride_tricks.sliding_window_view(rank, per) if len(rank) >= per else rank[:0]
        chosen = [starts[k : k + 100_000] + windows[starts[k : k + 100_000]].argmin(axis=1) for k in range(0, len(starts), 100_000)]
        # a shingle that is some window's prefix may stand at several places, and each is an alignment to try
        at = np.flatnonzero(np.isin(h, h[np.unique(np.concatenate(chosen))])) if chosen else starts
        order = np.argsort(h[at], kind="stable")
        return h[at][order], at[order]

    def verified(self, ids: np.ndarray, hit: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the aligned pairs of document and item positions, those within a run that is long enough."""
        left = np.zeros(len(hit), np.int64)
        right = np.full(len(hit), self.size, np.int64)
        # unknown words are -1 in documents and -2 stands between items, so neither is equal to anything
        for sign, reach in ((-1, left), (1, right)):
            live = np.arange(len(hit))
            step = 1 if sign < 0 else self.size
            while len(live) and step < self.run:
                d, i = hit[live] + sign * step, at[live] + sign * step
                ok = (d >= 0) & (d < len(ids)) & (i >= 0) & (i < len(self.flat))
                live, d, i = live[ok], d[ok], i[ok]
                same = (ids[d] == self.flat[i]) & (ids[d] >= 0)
                live = live[same]
                reach[live] += 1
                step += 1
        return left + right >= self.run


def _blocks(items: DataFrame) -> Iterator[tuple[Side, Side]]:
    """Items are a stated query set; their rows come one at a time and fill blocks of bounded size."""
    by_words, by_chars, held = Side(RUN_WORDS, SHINGLE_WORDS), Side(RUN_CHARS, SHINGLE_CHARS), 0
    for row in items.filter("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text").distinct().toLocalIterator():
        if held and held + len(row.text) > BLOCK_BYTES:
            yield by_words, by_chars
            by_words, by_chars, held = Side(RUN_WORDS, SHINGLE_WORDS), Side(RUN_CHARS, SHINGLE_CHARS), 0
        if spaceless(row.text):
            by_chars.add(row.item_id, list("".join(words(row.text))))
        else:
            by_words.add(row.item_id, words(row.text))
        held += len(row.text)
    if held:
        yield by_words, by_chars


class Reader:
    """Documents as arrays of a block's word or letter ids."""

    def __init__(self, by_words: Side, by_chars: Side) -> None:
        self.words, self.chars = by_words, by_chars
        self.cache: dict[str, tuple[int, ...]] = {}
        self.letter: dict[str, int] = {}

    def ids_of(self, token: str) -> tuple[int, ...]:
        got = self.cache.get(token)
        if got is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            v = self.words.vocabulary
            got = self.cache[token] = tuple(v.get(w, -1) for w in words(token))
        return got

    def sides(self, batch: pa.RecordBatch) -> Iterator[tuple[Side, np.ndarray, np.ndarray]]:
        """For words and for letters: ids, and the row of each; -1 between rows."""
        column = batch.column("text")
        if self.words.items:
            codes, distinct, offsets = words_of(column)
            each = [self.ids_of(t) for t in distinct]
            sizes = np.array([len(x) for x in each], np.int64)
            first = np.array([x[0] if x else -1 for x in each], np.int64)
            rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            counts = sizes[codes] if len(codes) else np.zeros(0, np.int64)
            ids = np.repeat(first[codes] if len(codes) else codes, counts)
            starts = np.cumsum(counts) - counts
            for j in np.flatnonzero(counts > 1):
                ids[starts[j] : starts[j] + counts[j]] = each[codes[j]]
            yield self.words, *self.apart(ids, np.repeat(rows, counts))
        if self.chars.items:
            has = pc.fill_null(pc.match_substring_regex(column, "[\\p{Han}\\p{Hiragana}\\p{Katakana}]"), False)
            at = np.flatnonzero(has.to_numpy(zero_copy_only=False))
            texts = ["".join(words(t)) for t in column.take(pa.array(at)).to_pylist()]
            v = self.chars.vocabulary
            ids = np.array([v.get(c, -1) for t in texts for c in t], np.int64)
            yield self.chars, *self.apart(ids, np.repeat(at, [len(t) for t in texts]) if len(at) else at)

    @staticmethod
    def apart(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cuts = np.flatnonzero(np.diff(rows)) + 1
        return np.insert(ids, cuts, -1), np.insert(rows, cuts, -1)


def shingle_counts(docs: DataFrame, sides: tuple[Side, Side]) -> dict[int, int]:
    """How often each of the block's shingles occurs in all documents; no more rows than the block has shingles."""
    wanted = [s.shingles() for s in sides]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*sides)
        totals = [np.zeros(len(w), np.int64) for w in wanted]
        for batch in slices(batches, "text"):
            for side, ids, _ in reader.sides(batch):
                k = 0 if side is sides[0] else 1
                h = hashes(ids, side.size)
                h = h[h > 0]
                at = np.searchsorted(wanted[k], h)
                at[at == len(wanted[k])] = 0
                hit = at[wanted[k][at] == h] if len(wanted[k]) else at[:0]
                totals[k] += np.bincount(hit, minlength=len(wanted[k]))
        for w, n in zip(wanted, totals, strict=True):
            full = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(w[full].astype(np.int64)), pa.array(n[full])], ["h", "n"])

    rows = docs.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).toPandas()
    return dict(zip(rows["h"].tolist(), rows["n"].tolist(), strict=True))


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id), distinct: documents with a passage of an item."""
    docs = documents.select("doc_id", "text")
    found = None
    for sides in _blocks(items):
        prefixes = [s.prefixes(counts) if s.items else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for counts in [shingle_counts(docs, sides)] for s in sides]

        def match(batches: Iterator[pa.RecordBatch], sides=sides, prefixes=prefixes) -> Iterator[pa.RecordBatch]:
            reader = Reader(*sides)
            owner = [np.array(s.items, np.int64) for s in sides]
            for batch in slices(batches, "text"):
                for side, ids, rows in reader.sides(batch):
                    k = 0 if side is sides[0] else 1
                    keys, at = prefixes[k]
                    h = hashes(ids, side.size)
                    live = np.flatnonzero(h)
                    low, high = np.searchsorted(keys, h[live], "left"), np.searchsorted(keys, h[live], "right")
                    n = high - low
                    where = np.repeat(live, n)
                    place = at[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] if n.sum() else at[:0]
                    ok = side.verified(ids, where, place)
                    item = owner[k][np.searchsorted(np.array(side.offsets), place[ok], "right") - 1] if len(side.items) else place[ok]
                    doc = batch.column("doc_id").take(pa.array(rows[where[ok]], pa.int64()))
                    yield pa.RecordBatch.from_arrays([doc.cast(pa.int64()), pa.array(item, pa.int64())], ["doc_id", "item_id"])

        one = docs.mapInArrow(match, "doc_id long, item_id long")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return documents.sparkSession.createDataFrame([], "doc_id long, item_id long")
    return found.filter("doc_id IS NOT NULL").distinct()
