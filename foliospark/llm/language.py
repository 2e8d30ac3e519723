"""The language of each document, and of each passage in another one, with a calibrated confidence.

A sparse multinomial logistic regression on TF-IDF character n-grams, trained with follow-the-regularised-leader and elastic
net, its confidences calibrated by a temperature fitted on rows that were held out. The classifier is fitted on a bounded
sample: at most SAMPLE_DOCS labelled documents for each label and SAMPLE_TEXTS texts of SAMPLE_CHARS characters or more of each, and only labels that LEAST_DOCS documents have; as labels may be wrong, documents
which fits to other documents hold for something else are left out of the final fit. The TF-IDF weights are part of the fit. All
texts are then classified whole, the words of a batch once for each distinct word: with L1-normalised term frequencies
the score of a text is the mean of its words' scores.

A document's language is the one of most of its texts, each weighed by the root of its letters. Native pages that are mostly
decoded with a wrong encoding (one character in DAMAGE_SHARE looks like it) are in no language and don't count.

Defined results: null, empty and letterless texts have no language and don't count; a document without any text is not
reported; ties go to the code that comes first; repeated rows count once; other columns are ignored.
"""

from __future__ import annotations

import html
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.llm.arrow import by_row, code_points, slices, words_of

SAMPLE_DOCS, SAMPLE_TEXTS, SAMPLE_CHARS, BITS, LEAST_DOCS = 120, 12, 60, 15, 3
PASSAGE_CHARS = 130
#: What text in a wrong encoding is full of; a page with more than one such character in DAMAGE_SHARE doesn't count.
DAMAGED = regex.compile(r"[\x80-\x9f¢-©¬-¶¸¹¼-¾×÷ƒˆ˘˙˛˜˝ˇ†‡‰€™�∀-⋿─-▟]")
DAMAGE_SHARE = 33
# ISO 639-1 code, ISO 639-2/3 codes, English name.
LANGUAGES = """ar ara Arabic|bg bul Bulgarian|bn ben Bengali|ca cat Catalan|cs ces,cze Czech|da dan Danish|de deu,ger German|el ell,gre Greek|en eng English|es spa Spanish|et est Estonian|eu eus,baq Basque|fa fas,per Persian|fi fin Finnish|fr fra,fre French|ga gle Irish|he heb Hebrew|hi hin Hindi|hr hrv Croatian|hu hun Hungarian|hy hye,arm Armenian|id ind Indonesian|is isl,ice Icelandic|it ita Italian|ja jpn Japanese|ka kat,geo Georgian|ko kor Korean|la lat Latin|lt lit Lithuanian|lv lav Latvian|nl nld,dut Dutch|no nor Norwegian|pl pol Polish|pt por Portuguese|ro ron,rum Romanian|ru rus Russian|sk slk,slo Slovak|sl slv Slovenian|sr srp Serbian|sv swe Swedish|ta tam Tamil|th tha Thai|tr tur Turkish|uk ukr Ukrainian|ur urd Urdu|vi vie Vietnamese|zh zho,chi,cmn Chinese"""


def language_names() -> dict[str, str]:
    out: dict[str, str] = {}
    for row in LANGUAGES.split("|"):
        two, three, name = row.split(" ")
        out |= dict.fromkeys((two, *three.split(","), name.lower()), two)
    return out


def two_letter(label: Column) -> Column:
    """The two-letter code of a label in whatever spelling; null where it names no language."""
    primary = F.lower(F.trim(F.regexp_extract(F.trim(label), r"^([\p{L}]+)", 1)))
    pairs = [F.lit(x) for kv in language_names().items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), primary)


@lru_cache(1)
def folded() -> np.ndarray:
    """For each code point its small letter, or 0 for what is no letter or mark."""
    out = np.zeros(0x110000, np.uint32)
    import unicodedata

    for o in range(sys.maxunicode + 1):
        if unicodedata.category(c := chr(o))[0] in "LM":
            low = c.lower()
            out[o] = ord(low) if len(low) == 1 else o
    return out


def grams(words: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all n-grams (1 to 3 letters, with word edges) of the words, their offsets by word, and letters by word."""
    points, offsets = code_points([f" {w} " for w in words])
    small = folded()[points]
    letters = by_row(np.add, (small > 0).astype(np.int64), offsets)
    edge = small == 0
    slots, owner = [], []
    of = np.repeat(np.arange(len(words)), np.diff(offsets))
    h = np.zeros(len(small), np.uint64)
    for n in range(1, 4):
        h = (h[: len(small) - n + 1] * np.uint64(1_000_003) + small[n - 1 :].astype(np.uint64) + np.uint64(n)) & np.uint64(0xFFFFFFFFFFFF)
        if n == 1:
            keep = ~edge
        elif n == 2:
            keep = ~(edge[:-1] & edge[1:]) & (of[:-1] == of[1:])
        else:
            keep = ~edge[1:-1] & (of[:-2] == of[2:])
        at = np.flatnonzero(keep)
        mixed = h[at] * np.uint64(0x9E3779B97F4A7C15)
        slots.append((mixed >> np.uint64(64 - bits)).astype(np.int64))
        owner.append(of[at])
    slot, own = np.concatenate(slots), np.concatenate(owner)
    order = np.argsort(own, kind="stable")
    bounds = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.bincount(own, minlength=len(words)), out=bounds[1:])
    return slot[order], bounds, letters


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # slots x languages, with the TF-IDF weights in them
    bias: np.ndarray
    temperature: float = 1.0
    #: Of documents that neither the weights nor the temperature were fitted on: how far confidences are off, on average over ten bins, and the share that is right. NaN where there were none.
    calibration_error: float = float("nan")
    accuracy: float = float("nan")

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities for each text, and its number of letters."""
        codes, distinct, offsets = words_of(column)
        slot, bounds, letters = grams(distinct)
        word = by_row(np.add, self.weights[slot], bounds) if len(slot) else np.zeros((len(distinct), len(self.languages)), np.float32)
        total = by_row(np.add, word[codes], offsets) if len(codes) else np.zeros((len(column), len(self.languages)), np.float32)
        n = by_row(np.add, np.diff(bounds)[codes], offsets) if len(codes) else np.zeros(len(column), np.int64)
        many = by_row(np.add, letters[codes], offsets) if len(codes) else np.zeros(len(column), np.int64)
        logits = (total / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=1, keepdims=True), many


def _matrix(texts: list[str], idf: np.ndarray | None) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Each text's slots with L1-normalised term frequencies, times idf; and the document frequencies."""
    rows, df = [], np.zeros(1 << BITS, np.int64)
    for text in texts:
        slot, _, _ = grams(text.split() or [""])
        at, n = np.unique(slot, return_counts=True)
        df[at] += 1
        rows.append((at, (n / max(1, n.sum())).astype(np.float32)))
    return rows, df


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, idf: np.ndarray, epochs: int = 8, each: int = 160, alpha: float = 4.0, beta: float = 0.5, l1: float = 0.001, l2: float = 0.001, batch: int = 104) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader (proximal) with elastic net; the last coordinate is the bias.

    An epoch draws `each` rows of every class, so that rare languages weigh as much as common ones.
    """
    size = len(idf)
    z, n = np.zeros((size + 1, classes), np.float32), np.zeros((size + 1, classes), np.float32)
    order = np.random.default_rng(7)

    def weights() -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)).astype(np.float32)

    w = weights()
    for _ in range(epochs):
        turn = order.permutation(np.concatenate([order.choice(np.flatnonzero(labels == k), each) for k in range(classes) if (labels == k).any()]))
        for a in range(0, len(turn), batch):
            some = turn[a : a + batch]
            x = np.zeros((len(some), size + 1), np.float32)
            for i, r in enumerate(some):
                at, v = rows[r]
                x[i, at] = v * idf[at]
            x[:, -1] = 0.1
            s = x @ w
            s -= s.max(axis=1, keepdims=True)
            p = np.exp(s)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1
            g = x.T @ p
            sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / alpha
            z += g - sigma * w
            n += g * g
            w = weights()
    return w[:-1] * idf[:, None], w[-1] * 0.1


def train(texts: list[str], labels: list[str], docs: list[int], folds: int = 4) -> Model:
    """The calibrated model. A document whose label fits to the other folds don't confirm is left out.

    Of every ten documents one is held out for the temperature, and one to measure the calibration.
    """
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    rows, df = _matrix(texts, None)
    idf = (np.log((1 + len(rows)) / (1 + df)) + 1).astype(np.float32)
    _, doc = np.unique(np.array(docs, np.int64), return_inverse=True)

    def logits(weights: np.ndarray, bias: np.ndarray, some: np.ndarray) -> np.ndarray:
        return np.array([rows[i][1] @ weights[rows[i][0]] + bias for i in some]).reshape(len(some), len(languages))

    votes = np.zeros((doc.max() + 1, len(languages)))
    # documents of each label go round the folds, so that a rare label is in all of them
    first = {d: int(y[i]) for i, d in reversed(list(enumerate(doc)))}
    rank: dict[int, int] = {}
    rank_of: dict[int, int] = {}
    fold = np.zeros(doc.max() + 1, np.int64)
    for d in range(doc.max() + 1):
        rank_of[d] = rank.get(first[d], 0)
        fold[d] = rank_of[d] % folds
        rank[first[d]] = rank.get(first[d], 0) + 1
    for k in range(folds):
        fit, out = np.flatnonzero(fold[doc] != k), np.flatnonzero(fold[doc] == k)
        if len(fit) and len(out):
            s = logits(*ftrl([rows[i] for i in fit], y[fit], len(languages), idf, epochs=3), out)
            np.add.at(votes, (doc[out], s.argmax(axis=1)), 1)
    right = votes.argmax(axis=1)[doc] == y
    turn = np.array([rank_of[d] % 10 for d in range(doc.max() + 1)])[doc]
    fit, check, test = (np.flatnonzero(x & right) for x in (turn < 8, turn == 8, turn == 9))
    if not len(fit):
        fit = np.arange(len(rows))
    weights, bias = ftrl([rows[i] for i in fit], y[fit], len(languages), idf)
    best, temperature = np.inf, 1.0
    if len(check):
        s = logits(weights, bias, check)
        for t in np.geomspace(0.05, 8, 60):
            q = s / t
            q -= q.max(axis=1, keepdims=True)
            loss = float(np.mean(np.log(np.exp(q).sum(axis=1)) - q[np.arange(len(check)), y[check]]))
            if loss < best:
                best, temperature = loss, float(t)
    model = Model(languages, weights.astype(np.float32), bias.astype(np.float32), temperature)
    if len(test):
        q = logits(weights, bias, test) / temperature
        p = np.exp(q - q.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        model.accuracy = float((p.argmax(axis=1) == y[test]).mean())
        model.calibration_error = calibration_error(p.max(axis=1), p.argmax(axis=1) == y[test])
    return model


def calibration_error(confidence: np.ndarray, right: np.ndarray, bins: int = 10) -> float:
    """How far the mean confidence is from the share that is right, on average over bins of confidence, each weighed by its rows."""
    at = np.minimum((confidence * bins).astype(int), bins - 1)
    gaps = [abs(confidence[at == k].mean() - right[at == k].mean()) * (at == k).mean() for k in np.unique(at)]
    return float(sum(gaps))


def texts_of(meta: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, block_id, passage, text): blocks of scanned documents and pages of native ones, block_id -1 for pages."""
    block = blocks.filter(F.length("text") > 0).select("doc_id", "block_id", (F.col("type").isin("text", "footnote") & (F.length("text") >= PASSAGE_CHARS)).alias("passage"), "text")
    shown = F.regexp_replace("native_html", r"(?s)<(head|script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    native = F.explode(F.array("native_text", shown))
    page = pages.select("doc_id", F.lit(-1).cast("long").alias("block_id"), F.lit(False).alias("passage"), native.alias("text")).filter(F.length("text") > 0)
    return block.unionByName(page)


def fit(meta: DataFrame, texts: DataFrame) -> Model:
    labelled = meta.select("doc_id", two_letter(F.col("language")).alias("label")).filter("label IS NOT NULL AND doc_id IS NOT NULL").distinct()
    some = labelled.withColumn("_r", F.row_number().over(W.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))).filter(F.col("_r") <= SAMPLE_DOCS)
    each = texts.filter(F.length("text") >= SAMPLE_CHARS).join(some.select("doc_id", "label"), "doc_id")
    each = each.withColumn("_r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text"), "block_id"))).filter(F.col("_r") <= SAMPLE_TEXTS)
    rows = each.select("doc_id", "label", "text").orderBy(F.xxhash64("doc_id", "text"), "label").toPandas()
    docs = rows.groupby("label")["doc_id"].nunique()
    rows = rows[rows["label"].isin(docs[docs >= LEAST_DOCS].index)]
    if rows.empty:
        return Model(["und"], np.zeros((1 << BITS, 1), np.float32), np.zeros(1, np.float32))
    return train([html.unescape(t) for t in rows["text"]], rows["label"].tolist(), rows["doc_id"].tolist())


def classify(texts: DataFrame, model: Model) -> DataFrame:
    """(doc_id, block_id, passage, lang, confidence, letters) for texts with letters."""
    told = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = told.value
        names = np.array(model.languages, object)
        for batch in slices(batches, "text", 1_000_000):
            column = batch.column("text")
            coded = pc.fill_null(pc.match_substring(column, "&"), False)
            if pc.any(coded).as_py():
                column = pa.array([html.unescape(t) if t and "&" in t else t for t in column.to_pylist()], pa.string())
            p, letters = model.scores(column)
            for i in np.flatnonzero(np.asarray(batch.column("block_id").to_numpy(zero_copy_only=False)) == -1):
                text = column[i].as_py() or ""
                if not text.isascii() and len(DAMAGED.findall(text)) * DAMAGE_SHARE > len(text):
                    letters[i] = 0  # decoded with a wrong encoding, so in no language
            best = p.argmax(axis=1)
            keep = np.flatnonzero(letters > 0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(keep)) for c in ("doc_id", "block_id", "passage")), pa.array(names[best[keep]].tolist(), pa.string()), pa.array(p[keep, best[keep]].astype(np.float64)), pa.array(letters[keep])],
                ["doc_id", "block_id", "passage", "lang", "confidence", "letters"],
            )

    return texts.mapInArrow(run, "doc_id long, block_id long, passage boolean, lang string, confidence double, letters long")


def document_languages(classified: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence): the language of most text; the confidence is its share times its texts' mean confidence.

    A text weighs as the root of its letters: scripts need very different numbers of letters for the same text.
    """
    by = classified.groupBy("doc_id", "lang").agg(F.sum(F.sqrt("letters")).alias("n"), F.sum(F.sqrt("letters") * F.col("confidence")).alias("sure"))
    return by.groupBy("doc_id").agg(F.min_by("lang", F.struct(-F.col("n"), "lang")).alias("lang"), (F.min_by("sure", F.struct(-F.col("n"), "lang")) / F.sum("n")).alias("confidence"))


def languages(meta: DataFrame, blocks: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, lang, confidence) and passages in another language (doc_id, block_id, lang, confidence)."""
    texts = texts_of(meta, blocks, pages)
    seen = classify(texts, fit(meta, texts)).persist(StorageLevel.DISK_ONLY)
    docs = document_languages(seen)
    other = seen.filter("passage").join(docs.select("doc_id", F.col("lang").alias("_main")), "doc_id").filter("lang <> _main")
    return docs, other.select("doc_id", "block_id", "lang", "confidence").distinct()


def language_faults(meta: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, block_id, lang), distinct: documents with a missing or wrong label as block -1, and passages in another language."""
    docs, other = languages(meta, blocks, pages)
    wrong = meta.select("doc_id", two_letter(F.col("language")).alias("label"), "mode").join(docs, "doc_id").filter("label IS NULL OR label <> lang")
    scanned = meta.filter("mode IS NULL OR mode <> 'native'").select("doc_id").distinct()
    passages = other.join(scanned, "doc_id", "left_semi")
    return wrong.select("doc_id", F.lit(-1).cast("long").alias("block_id"), "lang").unionByName(passages.select("doc_id", "block_id", "lang")).distinct()
