"""Noise of scanned pages: find words broken at line ends, misread characters, running heads and page numbers, and repair.

Running heads and feet are found by fuzzy repetition at page edges: single lines in the head or foot band, compared without their page
number and with characters that are misread for each other as one, which stand on MIN_PAGES pages of the document. Page numbers are found
as sequences: the numbers at page edges, arabic or Roman, whose distance from the page's own index recurs in the document; readings
in doubt (misread digits, words that could be Roman numerals) count only in a sequence. Lines are joined by rules over the
corpus' vocabulary: the joined word against the compound against the two parts. A word is misread if undoing a usual confusion gives
a word the corpus has far more often, or if signs and digits stand among its letters.

The vocabulary covers all words of all blocks, whatever their length, in exact counts. Each distinct word, each distinct
broken pair, is judged once, by joins with the vocabulary; blocks then get the judgements on what they hold, bucket by bucket. Letter sequences, which only smooth what the corpus
lacks, are in hashed tables of fixed size (2**20 counters each for letters, pairs and triples).

Defined results: null and empty texts are no case; tables, figures and formulas are neither joined nor corrected; blocks without a
position are taken to stand outside the bands, pages without a known height to be PAGE_HEIGHT high; repeated rows count once, as pages are
counted by number; ties between corrections go to the last in order; other columns pass through. A head is compared with the most frequent
one that shares a third of its letters in one place, not with every other.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.arrow import by_row, dense_tables, fresh, slices, words_of
from foliospark.llm.encoding import BITS, Letters, gram_slots
from foliospark.llm.lookalikes import ALIKE
from foliospark.llm.vocabulary import BUCKET
from foliospark.operators import assembly
from foliospark.operators.furniture import pages_of
from foliospark.session import cut

PAGE_HEIGHT, BAND, MIN_PAGES, MIN_LETTERS, MIN_RUN = 2339, 0.09, 3, 3, 2
GAIN, GAIN_FREQUENT = 6.5, 3.0
#: A word that another is taken for a misreading of must occur so often.
LEAST_SEEN = 6
#: So many judgements, of two words each, may be sent to every executor.
MOST_SENT = 200_000
#: Longer or broken over lines is no head and no page number.
EDGE_LENGTH = 200
PROSE = ("text", "list", "footnote")
STRUCTURED = ("table", "figure", "formula")
#: Under another label a block of so many characters on three lines is a paragraph all the same.
PARAGRAPH = 130
# As read, and as meant.
CONFUSED = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("5", "s"), ("$", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("3", "e"), ("4", "a"), ("7", "t"), ("2", "z"), ("@", "a"), ("€", "e"), ("(", "c"),
    ("c", "e"), ("e", "c"), ("n", "a"), ("a", "n"), ("f", "t"), ("t", "f"), ("b", "h"), ("h", "b"), ("i", "l"), ("l", "i"), ("n", "u"), ("u", "n"), ("o", "c"), ("c", "o"), ("g", "q"), ("q", "g"), ("j", "i"), ("i", "j"), ("v", "y"), ("y", "v"), ("s", "f"), ("ſ", "s"),
    ("m", "rn"), ("rn", "m"), ("m", "in"), ("m", "ni"), ("in", "m"), ("d", "cl"), ("cl", "d"), ("h", "li"), ("li", "h"), ("w", "vv"), ("vv", "w"), ("u", "ii"), ("ii", "u"), ("n", "ri"), ("ri", "n"), ("nn", "m"), ("rri", "m"),
    ("0", "о"), ("3", "з"), ("6", "б"), ("8", "в"), ("4", "ч"), ("п", "л"), ("л", "п"), ("с", "е"), ("е", "с"), ("н", "и"), ("и", "н"), ("п", "н"), ("н", "п"), ("ш", "щ"), ("щ", "ш"), ("о", "с"), ("с", "о"), ("ц", "п"), ("б", "в"), ("т", "г"), ("г", "т"), ("ь", "ъ"),
    ("0", "ο"), ("ν", "υ"), ("υ", "ν"), ("ο", "σ"), ("σ", "ο"), ("ρ", "ο"), ("6", "δ"), ("η", "π"), ("π", "η"), ("λ", "χ"), ("κ", "χ"), ("8", "θ"), ("3", "ε"),
)
YEAR_DIGITS = str.maketrans("lIi!|OoQSsBbZzgqAT", "111110005588229947")
HYPHENS = "-‐‑¬­"
BROKEN = regex.compile(rf"([\p{{L}}\p{{M}}\p{{Nd}}\p{{Cf}}'’!|$]+(?:[{HYPHENS}][\p{{L}}\p{{M}}\p{{Nd}}\p{{Cf}}]+)*)([{HYPHENS}])[ \t]*\n[ \t]*([\p{{L}}\p{{M}}\p{{Nd}}\p{{Cf}}!|$]+)")
BROKEN_LINE = rf"[{HYPHENS}][ \t]*\n"
EDGE = regex.compile(r"^[^\p{L}\p{M}\p{Nd}!|$@€]+|[^\p{L}\p{M}\p{Nd}|$@€]+$")
MIXED_WORD = regex.compile(r"^(?=.*\p{L})(?=.*[\p{Nd}!|$@€(])[\p{L}\p{M}\p{Nd}!|$@€('’-]+$")
PURE_WORD = regex.compile(r"^[\p{L}\p{M}'’]+$")
COUNTED = regex.compile(r"^[\p{L}\p{M}'’]+(?:-[\p{L}\p{M}'’]+)*$")
YEAR = regex.compile(r"^(?=.*[\p{L}!|])[0-9lIi!|OoQSsBbZzgqAT]{4}$")
NUMBER_PART = regex.compile(r"^[\W_]*(?:[0-9lIiOoSsBbZzgqAT!|]{1,5}|[ivxlcdmIVXLCDM]{1,10}|\p{Nd}{1,5})[\W_]*$")
LATIN_ONLY = regex.compile(r"\p{Latin}")
OTHER_ALPHABET = regex.compile(r"[\p{Cyrillic}\p{Greek}]")
#: For str.translate: invisible characters as nothing.
FORMAT = {c: None for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf"}
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
DECORATION = regex.compile(r"^[^\p{L}\p{Nd}!|]+|[^\p{L}\p{Nd}!|]+$")
#: A word for page, short, before a number or, in scripts without spaces, around it.
PAGE_WORD = regex.compile(r"^(?:\p{L}{1,6}\.?\s+|第\s*|(?:หน้า|頁|页)\s*)(?=\S+$|\S+\s*[页頁]$)|\s*(?:[页頁]|ページ)$")
MISREAD_NUMBER = regex.compile(r"^[0-9lIi!|OoQSsBbZzgqAT]{1,5}$")
ROMAN = regex.compile(r"^(?=.)m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
ROMAN_VALUE = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
MOST_ROMAN = 399

_SAME = str.maketrans({c: row[0].lower() for row in ALIKE for c in row[1:]} | {"ς": "σ"})
#: Characters misread for each other as one; what is misread for two letters as these.
_HEAD = str.maketrans(
    dict.fromkeys("il1!|jr", "l") | dict.fromkeys("na", "a") | dict.fromkeys("ec", "c") | dict.fromkeys("o0", "o") | dict.fromkeys("tf7", "t") | dict.fromkeys("s5", "s") | dict.fromkeys("gq9", "g")
    | dict.fromkeys("hb6u8бв", "ll") | {"m": "la", "w": "vv", "d": "cl", "3": "з", "4": "ч"} | dict.fromkeys("плни", "н")
)


def plain_word(token: str) -> str:
    """Without invisible characters, compatibility forms, outer punctuation, in its own case."""
    if not token.isascii():
        token = unicodedata.normalize("NFKC", token).translate(FORMAT)
    return token if token.isalpha() else EDGE.sub("", token)


def mixed_scripts(word: str) -> bool:
    return not word.isascii() and bool(OTHER_ALPHABET.search(word)) and bool(LATIN_ONLY.search(word))


# --- places on the page


def _prose() -> Column:
    """Whether the block is a paragraph by its label or its form."""
    long = (F.length("text") >= PARAGRAPH) & (F.size(F.split("text", "\n")) >= 3) & ~F.col("type").isin(*STRUCTURED)
    return F.coalesce(F.col("type").isin(*PROSE) | long, long, F.lit(False))


def _short() -> Column:
    return (F.length("text") <= EDGE_LENGTH) & ~F.contains(F.trim("text"), F.lit("\n"))


def _in_band(blocks: DataFrame, pages: DataFrame | None) -> DataFrame:
    """Short single lines with band: whether they stand in the head or foot of their page."""
    lines = blocks.filter((F.length("text") > 0) & _short()).select("block_id", "doc_id", "page_index", "type", "y0", "y1", "text")
    height = F.lit(PAGE_HEIGHT)
    if pages is not None:
        lines = lines.join(pages_of(pages).select("doc_id", "page_index", "page_height"), ["doc_id", "page_index"], "left")
        height = F.when(F.col("page_height") > 0, F.col("page_height")).otherwise(PAGE_HEIGHT)
    band = F.coalesce((F.col("y1") <= height * BAND) | (F.col("y0") >= height * (1 - BAND)), F.lit(False))
    return lines.withColumn("band", band)


def roman(value: str) -> int:
    n = [ROMAN_VALUE[c] for c in value]
    return sum(-x if x < y else x for x, y in zip(n, [*n[1:], 0], strict=True))


def page_number_readings(text: str) -> list[tuple[str, int, bool]]:
    """(arabic or Roman, value, whether beyond doubt) of each way to read a line as nothing but a page's number."""
    core = DECORATION.sub("", unicodedata.normalize("NFKC", text))
    bare = PAGE_WORD.sub("", core)
    word = bare != core
    bare = DECORATION.sub("", bare)
    if bare.isdecimal():
        return [("a", int(bare), True)] if len(bare) <= 5 else []
    out: list[tuple[str, int, bool]] = []
    low = bare.lower()
    if MISREAD_NUMBER.match(bare):
        digits = sum(c.isdigit() for c in bare)
        if digits or (len(bare) <= 3 and not word):
            values = {int(bare.translate(YEAR_DIGITS)), int(bare.replace("S", "8").translate(YEAR_DIGITS)), int(bare.replace("B", "3").translate(YEAR_DIGITS))}
            out += [("a", v, digits > 0 and k == 0) for k, v in enumerate(sorted(values, key=lambda v: v != int(bare.translate(YEAR_DIGITS))))]
    if bare in (low, bare.upper()) and 0 < len(low) <= 10:
        if ROMAN.match(low) and roman(low) <= MOST_ROMAN:
            out.append(("r", roman(low), True))
        elif not word:
            for seen, meant in (("j", "i"), ("1", "i"), ("!", "i"), ("|", "i"), ("t", "i"), ("l", "i"), ("y", "v"), ("u", "v"), ("e", "c"), ("o", "c"), ("i", "l")):
                x = low.replace(seen, meant)
                if x != low and ROMAN.match(x):
                    out.append(("r", roman(x), False))
    return out


def head_key(text: str) -> str:
    """A running head without its page number, accents and look-alikes, characters misread for each other as one."""
    parts = [p for p in regex.split(r"\s{2,}|\t", text.strip()) if p]
    if len(parts) > 1:
        parts = [p for p in parts if not NUMBER_PART.match(p)] or parts
    words = " ".join(parts).split()
    while len(words) > 1 and any(c.isdigit() for c in words[0]) and NUMBER_PART.match(words[0]):
        words = words[1:]
    while len(words) > 1 and any(c.isdigit() for c in words[-1]) and NUMBER_PART.match(words[-1]):
        words = words[:-1]
    folded = unicodedata.normalize("NFKD", " ".join(words).lower())
    base = "".join(c for c in folded if unicodedata.category(c) not in ("Mn", "Cf")).translate(_SAME).translate(_HEAD)
    return "".join(c for c in base if c.isalnum())


def _edges(blocks: DataFrame, pages: DataFrame | None) -> DataFrame:
    """(doc_id, page_index, block_id, key, kind, value, sure): single lines in the bands, a row with a head's key or rows with readings as a number."""
    lines = _in_band(blocks, pages).filter("band").select("doc_id", "page_index", "block_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                numbers = page_number_readings(text)
                found = [("", *x) for x in numbers]
                if not any(sure for _, _, sure in numbers) and (key := head_key(text)):
                    found.append((key, "", 0, False))
                at += [i] * len(found)
                rows += found
            types = (pa.string(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns[:3]), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], ["doc_id", "page_index", "block_id", "key", "kind", "value", "sure"])

    return lines.mapInArrow(run, "doc_id long, page_index int, block_id long, key string, kind string, value long, sure boolean").distinct()


def _page_numbers(edges: DataFrame) -> DataFrame:
    """(block_id): readings in a sequence with the page indexes, and those beyond doubt on pages where no other is in a sequence."""
    numbers = edges.filter("kind <> ''").withColumn("far", F.col("value") - F.col("page_index"))
    runs = numbers.groupBy("doc_id", "kind", "far").agg(F.countDistinct("page_index").alias("_pages"), F.max("sure").alias("_any")).filter((F.col("_pages") >= MIN_RUN) & F.col("_any"))
    in_run = numbers.join(runs.select("doc_id", "kind", "far"), ["doc_id", "kind", "far"], "left_semi")
    alone = numbers.filter("sure").join(in_run.select("doc_id", "page_index").distinct(), ["doc_id", "page_index"], "left_anti")
    return in_run.select("block_id").unionByName(alone.select("block_id")).distinct()


def page_numbers(blocks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(block_id), distinct."""
    return _page_numbers(_edges(blocks, pages))


def _running_heads(edges: DataFrame, blocks: DataFrame, meta: DataFrame, site_docs: int = 3, site_share: float = 0.05) -> DataFrame:
    """(block_id): lines at page edges on at least MIN_PAGES pages of their document, those like them but for a few letters included.

    A long line that stands at page edges in several documents of a source is a notice of the source, not a title.
    """
    once = edges.select("doc_id", "key", "page_index").distinct()
    groups = cut(once.groupBy("doc_id", "key").agg(F.count("*").alias("pages")), costly=False)
    # fuzzy: keys of a document that share a third of their letters at one place may be one title; thirds are joined on, never all pairs.
    # Two widths each, so that keys differing in length by two share one
    widths = F.array_distinct(F.array(F.ceil((F.length("key") - 1) / 3).cast("int"), F.ceil((F.length("key") + 1) / 3).cast("int")))
    wide = groups.filter(F.length("key") >= 6).select("doc_id", "key", "pages", F.explode(widths).alias("w"))
    w = F.col("w")
    places = [*(F.substring(F.col("key"), 1 + w * p, w) for p in range(3)), F.substring(F.reverse("key"), F.lit(1), w)]
    parts = F.array(*(F.struct(F.lit(p).alias("at"), x.alias("part")) for p, x in enumerate(places)))
    by_part = wide.select("doc_id", "key", "pages", "w", F.explode(parts).alias("_p")).select("doc_id", "key", "pages", "w", "_p.*")
    # a third's most frequent key stands for all keys of that third, so rows don't multiply within a group
    heads = by_part.groupBy("doc_id", "w", "at", "part").agg(F.min_by("key", F.struct((-F.col("pages")).alias("n"), "key")).alias("head"))
    led = by_part.join(heads, ["doc_id", "w", "at", "part"]).filter("head <> key AND levenshtein(head, key) <= greatest(1, length(head) div 6)")
    best = led.groupBy("doc_id", "key").agg(F.min("head").alias("head"))
    merged = groups.join(best, ["doc_id", "key"], "left").withColumn("head", F.coalesce("head", "key"))
    titled = cut(edges.join(merged.select("doc_id", "key", "head"), ["doc_id", "key"]), costly=False)
    enough = titled.groupBy("doc_id", "head").agg(F.countDistinct("page_index").alias("pages")).filter(F.col("pages") >= MIN_PAGES)
    sources = meta.filter("source IS NOT NULL").select("doc_id", "source").distinct()
    sized = sources.join(blocks.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("docs"))
    notices = groups.filter(F.length("key") >= 12).join(sources, "doc_id").groupBy("source", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= site_docs).join(sized, "source").filter(F.col("n") >= site_share * F.col("docs"))
    found = cut(titled.join(enough.select("doc_id", "head"), ["doc_id", "head"], "left_semi"), costly=False)
    of_site = found.join(sources, "doc_id").join(notices.select("source", "key"), ["source", "key"], "left_semi").select("block_id")
    return found.select("block_id").distinct().join(of_site.distinct(), "block_id", "left_anti")


def furniture(blocks: DataFrame, meta: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(block_id, noise), distinct: running heads and page numbers."""
    edges = cut(_edges(blocks, pages))
    numbers = cut(_page_numbers(edges), costly=False)
    lines = edges.filter("key <> ''").select("doc_id", "page_index", "block_id", "key")
    heads = _running_heads(cut(lines.join(numbers, "block_id", "left_anti"), costly=False), blocks, meta)
    return heads.withColumn("noise", F.lit("running_head")).unionByName(numbers.withColumn("noise", F.lit("page_number")))


# --- words

WORD, TOKEN, PAIR, GRAM = 0, 1, 2, 3
GLUE = "\x1f"


def pair_key(a: str, mark: str, b: str) -> str | None:
    """The parts of a word broken at a line end as one key; None where they can't be one word."""
    x, y = plain_word(a), plain_word(b)
    if not (any(c.isalpha() for c in x) and any(c.isalpha() for c in y)) or (y[0].isupper() and not x.isupper()):
        return None
    return GLUE.join((x.lower(), "­" if mark in "¬­" else "-", y.lower()))


def token_key(token: str) -> str | None:
    """What a token's judgement goes by: a word's small letters, or a token with signs among its letters; None where there is nothing to judge.

    Scripts without spaces have no words between spaces, so such tokens are neither counted nor judged.
    """
    if token and max(token) >= "\u0e00" and UNSPACED.search(token):
        return None
    w = plain_word(token)
    if len(w) >= 3 and PURE_WORD.match(w):
        return None if mixed_scripts(w) else w.lower()
    return w.lower() if MIXED_WORD.match(w) else None


def year_of(token: str) -> str | None:
    if not 4 <= len(token) <= 12 or token.isalpha():
        return None
    w = plain_word(token)
    if YEAR.match(w) and sum(c.isdigit() for c in w) >= 2 and 1000 <= int(year := w.translate(YEAR_DIGITS)) <= 2600:
        return year
    return None


def undo(word: str) -> Iterator[str]:
    """The word with one usual confusion undone, each way."""
    for seen, meant in CONFUSED:
        at = word.find(seen)
        while at >= 0:
            yield word[:at] + meant + word[at + len(seen) :]
            at = word.find(seen, at + 1)


def undo_signs(word: str) -> list[str]:
    """The word with its first sign or digit as the letters it may be."""
    for at, c in enumerate(word):
        if not (c.isalpha() or unicodedata.category(c)[0] == "M" or c in "'’-"):
            latin = bool(LATIN_ONLY.search(word))
            return [word[:at] + m + word[at + 1 :] for s, m in CONFUSED if s == c and bool(LATIN_ONLY.match(m)) == latin]
    return []


def signs_undone(word: str) -> list[str]:
    """All words of letters that up to three signs or digits may stand for; none where too few letters are left."""
    letters = sum(c.isalpha() for c in word)
    if letters < 2 or (letters < MIN_LETTERS and not any(c.isdigit() or c in "!|" for c in word[1:-1])):
        return []
    step = {word}
    for _ in range(3):
        step = {x for y in step for x in undo_signs(y)}
        done = sorted(x for x in step if PURE_WORD.match(x))
        if done:
            return done
    return []


_COUNTED = ["bucket", "k", "word", "slot", "n"]


def _rows(bucket: list, k: list, word: list, slot: list, n: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((bucket, k, word, slot, n), (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64()), strict=True)], _COUNTED)


class Keys:
    """Each token's key, found once."""

    def __init__(self, of: Callable[[str], str | None]) -> None:
        self.of, self.kept = of, {}

    def __call__(self, tokens: list[str]) -> list[str | None]:
        if len(self.kept) > 200_000:
            self.kept.clear()
        kept, of = self.kept, self.of
        for t in tokens:
            if t not in kept:
                kept[t] = of(t)
        return [kept[t] for t in tokens]


def _counted_word(token: str) -> str | None:
    if token and max(token) >= "\u0e00" and UNSPACED.search(token):
        return None
    w = plain_word(token).lower()
    return w if COUNTED.match(w) else None


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (bucket, prose, text): the words of prose, counted, tokens with signs, and broken pairs, by bucket; letter sequences, as slots."""
    grams = np.zeros((3, 1 << BITS))
    counted, keyed = Keys(_counted_word), Keys(token_key)
    for whole in slices(batches, "text"):
        buckets = whole.column("bucket").to_numpy()
        order = np.argsort(buckets, kind="stable")
        whole = whole.take(pa.array(order))
        buckets = buckets[order]
        edges = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1), len(buckets)]
        for a, b in itertools.pairwise(edges):
            batch, bucket = whole.slice(a, b - a), int(buckets[a])
            pairs: dict[str, None] = {}

            def note(m: regex.Match, pairs: dict = pairs) -> str:
                if (key := pair_key(m[1], m[2], m[3])) is not None:
                    pairs[key] = None
                return m[1] + m[3] if key is not None else f"{m[1]}-{m[3]}"

            broken = batch.column("text").filter(pc.match_substring_regex(batch.column("text"), BROKEN_LINE))
            joined = [BROKEN.sub(note, t) for t in broken.to_pylist()]
            prose = batch.column("prose").to_numpy(zero_copy_only=False)
            plain = pc.replace_substring_regex(batch.column("text").take(pa.array(np.flatnonzero(prose))), rf"\S+[{HYPHENS}][ \t]*\n[ \t]*\S+", " ")
            codes, distinct, _ = words_of(plain)
            many = np.bincount(codes, minlength=len(distinct)).tolist()
            words: dict[str, int] = {}
            for w, n in zip(counted(distinct), many, strict=True):
                if w:
                    words[w] = words.get(w, 0) + n
            # words put together from lines are judged too, if not counted
            tokens = {k: None for k in keyed([*distinct, *dict.fromkeys(t for text in joined for t in text.split())]) if k and k not in words}
            for k, found in ((WORD, words), (TOKEN, dict.fromkeys(tokens, 0)), (PAIR, dict.fromkeys(pairs, 0))):
                m = len(found)
                yield _rows([bucket] * m, [k] * m, list(found), [0] * m, list(found.values()))
            if words:
                one, two, three, offsets = gram_slots(list(words))
                each = np.repeat(np.array(list(words.values()), float), np.diff(offsets))
                for k, slots in enumerate((one, two, three)):
                    np.add.at(grams[k], slots, each)
    for k, t in enumerate(grams):
        at = np.flatnonzero(t)
        m = len(at)
        yield _rows([-1] * m, [GRAM + k] * m, [None] * m, at, t[at].astype(np.int64))


def _options(make: Callable[[str], Iterable[str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (word, n) with each option that `make` gives for the word, in batches of bounded size, as a long word has many long options."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, str]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["word", "n", "option"])

        for batch in batches:
            for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                for x in make(w):
                    rows.append((w, n, x))
                    held += len(w) + len(x)
                    if held > 4_000_000:
                        yield flush()
                        rows.clear()
                        held = 0
        yield flush()

    return run


def _pure_options(word: str) -> Iterable[str]:
    return undo(word) if len(word) >= 3 and PURE_WORD.match(word) and not mixed_scripts(word) else []


def _pair_options(key: str) -> list[str]:
    a, _, b = key.split(GLUE)
    last = regex.split(rf"[{HYPHENS}]", a)[-1]
    return [last + b, f"{a}-{b}", last, b]


def _judge(frame: DataFrame, letters: Letters, schema: str, judge: Callable[[Letters, dict[str, list]], list[tuple[str, str]]]) -> DataFrame:
    """(word, meant) by `judge` of each batch's columns."""
    told = frame.sparkSession.sparkContext.broadcast(letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = judge(told.value, batch.to_pydict()) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], ["word", "meant"])

    return frame.mapInArrow(run, schema)


def _spelled(letters: Letters, words: list[str]) -> np.ndarray:
    return by_row(np.add, *letters.spelled(words)) if words else np.zeros(0)


def judgements(counted: DataFrame, asked: DataFrame) -> DataFrame:
    """(word, meant): words and tokens that are misread with what they mean, and pairs that are to be joined.

    `counted` are _gather's rows of the texts whose vocabulary counts, `asked` those of the texts to judge; each distinct word or pair is judged once. To the driver come the letter tables, of fixed size, and two numbers.
    """
    words = cut(counted.filter(F.col("k") == WORD).groupBy("word").agg(F.sum("n").alias("n")), costly=False)
    total, most = words.agg(F.sum("n"), F.max("n")).first()
    total, most = float(total or 1), float(most or 0)
    letters = Letters(dense_tables(counted.filter(F.col("k") >= GRAM).select((F.col("k") - GRAM).alias("k"), "slot", "n"), 3, BITS), {}, total)
    known = words.select(F.col("word").alias("option"), F.col("n").alias("m"))
    best = F.max_by("option", F.struct("m", "option"))
    unseen = asked.filter(F.col("k") <= TOKEN).select("word").distinct().join(words.select("word"), "word", "left_anti").select("word", F.lit(0).cast("long").alias("n"))
    option = "word string, n long, option string"

    def pure(of: Letters, rows: dict[str, list]) -> list[tuple[str, str]]:
        out = []
        for w, own, m, x, s in zip(rows["word"], rows["n"], rows["m"], rows["option"], _spelled(of, rows["word"]), strict=True):
            others = max(0.0, own - 1) if own <= 2 else own / 2
            here = np.logaddexp(s + np.log(0.3), np.log(0.7 * others / total) if others else -np.inf)
            gain = np.log(0.7 * m / total) - here
            if gain > GAIN or (m >= 40 * own and gain > GAIN_FREQUENT):
                out.append((w, x))
        return out

    def mixed(of: Letters, rows: dict[str, list]) -> list[tuple[str, str]]:
        out = []
        for w, options, m, x in zip(rows["word"], rows["options"], rows["m"], rows["option"], strict=True):
            n_letters = sum(c.isalpha() for c in w)
            if m:
                if n_letters >= MIN_LETTERS or m >= 3:
                    out.append((w, x))
            elif n_letters > MIN_LETTERS:
                out.append((w, options[int(_spelled(of, options).argmax())]))
        return out

    def pairs(of: Letters, rows: dict[str, list]) -> list[tuple[str, str]]:
        out = []
        for key, found in zip(rows["word"], rows["found"], strict=True):
            n = {x["option"]: x["m"] for x in found if x["m"]}
            joined, compound, last, b = _pair_options(key)
            if GLUE + "­" in key:
                yes = True
            elif joined in n or compound in n:
                yes = n.get(joined, 0) >= n.get(compound, 0)
            else:
                logs = [np.logaddexp(np.log(0.3) + s, np.log(0.7 * n[x] / total) if n.get(x) else -np.inf) for x, s in zip((joined, last, b), _spelled(of, [joined, last, b]), strict=True)]
                yes = not (n.get(last, 0) >= 3 and n.get(b, 0) >= 3 and logs[1] + logs[2] > logs[0])
            if yes:
                out.append((key, ""))
        return out

    # what a word may be a misreading of is no longer than the longest such word, so longer runs of letters, as texts that lost their spaces, have no option
    longest = words.filter(F.col("n") >= LEAST_SEEN).agg(F.max(F.length("word"))).first()[0] or 0
    rare = words.filter((F.col("n") * 40 <= most) | (F.col("n") <= 2)).unionByName(unseen.filter(~F.col("word").rlike(r"[\p{Nd}!|$@€(]")))
    undone = rare.filter(F.length("word") <= longest + 1).mapInArrow(_options(_pure_options), option).join(known.filter(F.col("m") >= LEAST_SEEN), "option").filter("m >= 40 * n OR n <= 2")
    undone = undone.groupBy("word").agg(F.max("n").alias("n"), best.alias("option"), F.max("m").alias("m"))
    signs = unseen.mapInArrow(_options(signs_undone), option).join(known, "option", "left").groupBy("word").agg(F.array_sort(F.collect_set("option")).alias("options"), F.max("m").alias("m"), best.alias("option"))
    broken = asked.filter(F.col("k") == PAIR).select("word").distinct().withColumn("n", F.lit(0).cast("long"))
    broken = broken.mapInArrow(_options(_pair_options), option).distinct().join(known, "option", "left").groupBy("word").agg(F.collect_list(F.struct("option", "m")).alias("found"))
    schema = "word string, meant string"
    return _judge(undone, letters, schema, pure).unionByName(_judge(signs, letters, schema, mixed)).unionByName(_judge(broken, letters, schema, pairs))


def judged_blocks(blocks: DataFrame, read: Callable[[Iterator[tuple[dict[str, str], pa.RecordBatch]]], Iterator[pa.RecordBatch]], schema: str | T.StructType, vocabulary: DataFrame | None = None, most_sent: int = MOST_SENT) -> DataFrame:
    """What `read` makes of the blocks, (row, place, prose, text), in batches, each with what is judged on its words and pairs: a dictionary of words and their meanings.

    Judgements are few, as only what is misread or broken has one; up to most_sent, which is checked, they are sent to the executors. Beyond, blocks
    go in buckets of about BUCKET bytes, each with the judgements on what it holds, by a join. Both ways give the same rows.
    vocabulary: (prose, text) of the texts whose words count, if others.
    """
    size, many = blocks.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    n = max(1, -(-(size or 0) // BUCKET))
    # blocks with ids near each other go together, as they lie together in files, so that a batch has few buckets
    near = F.coalesce(F.floor(F.col("place") / max(1, many // n)), F.xxhash64("text"))
    rows = blocks.select("row", "prose", "text", F.pmod(F.xxhash64(near), F.lit(n)).cast("int").alias("bucket"))
    gathered = "bucket int, k int, word string, slot int, n long"
    counted = cut(rows.select("bucket", "prose", "text").mapInArrow(_gather, gathered))
    basis = counted if vocabulary is None else cut(vocabulary.select(F.lit(0).alias("bucket"), "prose", "text").mapInArrow(_gather, gathered))
    judged = cut(judgements(basis, counted))
    few = judged.limit(most_sent + 1).toLocalIterator()
    sent: dict[str, str] | None = {}
    for r in few:
        if len(sent) >= most_sent:
            sent = None
            break
        sent[r["word"]] = r["meant"]
    if sent is not None:
        told = blocks.sparkSession.sparkContext.broadcast(sent)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from read((told.value, batch) for batch in slices(batches, "text"))

        return rows.mapInArrow(run, schema)
    asked = counted.filter(F.col("k") <= PAIR).select("bucket", "word").distinct()
    both = rows.withColumn("told", F.lit(False)).unionByName(asked.join(judged, "word").withColumn("told", F.lit(True)), allowMissingColumns=True)
    parts = min(n, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return both.repartition(parts, "bucket").sortWithinPartitions("bucket", F.desc("told")).mapInArrow(lambda batches: read(_rows_with_judgements(batches)), schema)


def _rows_with_judgements(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, str], pa.RecordBatch]]:
    """The rows of buckets without the judgements, with these as a dictionary, bucket by bucket."""
    at, meant = None, {}
    for whole in slices(batches, "text"):
        buckets, told = whole.column("bucket").to_numpy(), whole.column("told").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero((buckets[1:] != buckets[:-1]) | (told[1:] != told[:-1])) + 1), len(buckets)]
        for a, b in itertools.pairwise(edges):
            batch = whole.slice(a, b - a)
            if buckets[a] != at:
                at, meant = buckets[a], {}
            if told[a]:
                meant |= zip(batch.column("word").to_pylist(), batch.column("meant").to_pylist(), strict=True)
            else:
                yield meant, batch


def _joiner(meant: dict[str, str], told: list[bool] | None = None) -> Callable[[regex.Match], str]:
    def join(m: regex.Match) -> str:
        yes = pair_key(m[1], m[2], m[3]) in meant
        if told is not None and yes:
            told[0] = True
        return m[1] + m[3] if yes else f"{m[1]}-{m[3]}"

    return join


def _word_noise(blocks: DataFrame, most_sent: int) -> DataFrame:
    """(block_id, noise) of rows (row: block_id, prose, text): hyphenation in any running text, misread in paragraphs."""

    def read(batches: Iterator[tuple[dict[str, str], pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
        years, keyed = Keys(year_of), Keys(token_key)
        for meant, batch in batches:
            ids = batch.column("row")
            hyphenated: list[int] = []
            column = batch.column("text")
            case = [False]
            join = _joiner(meant, case)
            at = np.flatnonzero(pc.match_substring_regex(column, BROKEN_LINE).to_numpy(zero_copy_only=False) == True)  # noqa: E712
            if len(at):
                texts = column.take(pa.array(at)).to_pylist()
                for k, text in enumerate(texts):
                    case[0] = False
                    texts[k] = BROKEN.sub(join, text)
                    if case[0]:
                        hyphenated.append(int(at[k]))
                mask = np.zeros(len(column), bool)
                mask[at] = True
                column = pc.replace_with_mask(column, pa.array(mask), pa.array(texts, pa.string()))
            prose = np.flatnonzero(batch.column("prose").to_numpy(zero_copy_only=False))
            codes, distinct, offsets = words_of(column.take(pa.array(prose)))
            wrong = np.array([y is not None or k in meant for y, k in zip(years(distinct), keyed(distinct), strict=True)], np.int64)
            misread = prose[by_row(np.add, wrong[codes], offsets) > 0] if len(codes) else prose[:0]
            found = pa.array([*hyphenated, *misread], pa.int64())
            kinds = ["hyphenation"] * len(hyphenated) + ["misread"] * len(misread)
            yield pa.RecordBatch.from_arrays([ids.take(found), pa.array(kinds, pa.string())], ["block_id", "noise"])

    return judged_blocks(blocks, read, "block_id long, noise string", most_sent=most_sent)


def _to_judge(blocks: DataFrame, pages: DataFrame | None, row: Column) -> DataFrame:
    """(row, place, prose, text) of the blocks that hold running text; lines in the bands aren't prose."""
    some = blocks.filter((F.length("text") > 0) & ~F.coalesce(F.col("type").isin(*STRUCTURED), F.lit(False)))
    lines = _in_band(some, pages).select(row.alias("row"), F.col("block_id").alias("place"), (_prose() & ~F.col("band")).alias("prose"), "text")
    return some.filter(~_short()).select(row.alias("row"), F.col("block_id").alias("place"), _prose().alias("prose"), "text").unionByName(lines)


def scan_noise(blocks: DataFrame, meta: DataFrame, pages: DataFrame | None = None, most_sent: int = MOST_SENT) -> DataFrame:
    """(block_id, noise), distinct. pages: (doc_id, page_index, width, height) for the pages' heights."""
    words = _word_noise(_to_judge(blocks, pages, F.col("block_id")), most_sent)
    return words.unionByName(furniture(blocks, meta, pages)).distinct()


# --- repair


def _as_written(token: str, meant: str) -> str:
    """The token with its word as it is meant, in the token's capitals, between what surrounds the word."""
    word = plain_word(token)
    letters = [c for c in word if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        meant = meant.upper()
    elif word[:1].isupper():
        meant = meant[:1].upper() + meant[1:]
    if word in token:
        a, _, b = token.partition(word)
        return a + meant + b
    before, after = EDGE.match(token), EDGE.search(token, 1)
    return (before[0] if before else "") + meant + (after[0] if after and after.end() == len(token) else "")


def corrected(text: str, meant: dict[str, str], keys: Keys, years: Keys) -> str:
    """The text with each misread token corrected, token by token; white space stays."""
    tokens = text.split()
    wrong = {t: y if y is not None else meant[k] for t, k, y in zip(tokens, keys(tokens), years(tokens), strict=True) if y is not None or k in meant}
    return regex.sub(r"\S+", lambda m: _as_written(m[0], wrong[m[0]]) if m[0] in wrong else m[0], text) if wrong else text


def _repaired_texts(rows: DataFrame, join_lines: bool, vocabulary: DataFrame | None = None) -> DataFrame:
    """(row, text): the texts of (row, prose, text) corrected, their broken words joined, and their lines too."""
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])

    def read(batches: Iterator[tuple[dict[str, str], pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
        years, keys = Keys(year_of), Keys(token_key)
        for meant, batch in batches:
            out = []
            for text, prose in zip(batch.column("text").to_pylist(), batch.column("prose").to_pylist(), strict=True):
                if join_lines:
                    text = BROKEN.sub(_joiner(meant), text)
                out.append(corrected(text, meant, keys, years) if prose else text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "text"])

    return judged_blocks(rows, read, schema, vocabulary)


def repaired(blocks: DataFrame, meta: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """The blocks without running heads and page numbers, words broken at line ends joined, misread words corrected.

    Lines of lists stay, others are joined to a paragraph; blocks of tables, figures and formulas, and null and empty texts, are as they were.
    """
    gone = furniture(blocks, meta, pages).select("block_id").distinct()
    kept = blocks.join(gone, "block_id", "left_anti").select(*blocks.columns)
    h, new = fresh(kept, "_h", "_new")
    judged = _to_judge(kept.dropDuplicates(["block_id", "text"]), pages, F.struct("block_id", F.xxhash64("text").alias("h")))
    texts = _repaired_texts(judged, True).select("row.block_id", F.col("row.h").alias(h), F.col("text").alias(new))
    both = kept.withColumn(h, F.xxhash64("text")).join(texts, ["block_id", h], "left")
    flat = F.when(F.coalesce(F.col("type") == "list", F.lit(False)), F.col(new)).otherwise(F.trim(F.regexp_replace(new, r"\s+", " ")))
    return both.withColumn("text", F.when(F.col(new).isNull(), F.col("text")).otherwise(flat)).select(*blocks.columns)


def paragraphs(blocks: DataFrame, meta: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, seq, text, pages): the documents' paragraphs, continuous over columns and pages, of repaired blocks."""
    clean = repaired(blocks, meta, pages)
    els = assembly.content(clean, pages_of(pages), furniture=False)
    return assembly.stitch(els, assembly.page_breaks(pages_of(pages))).filter("type IN ('text', 'list', 'footnote')").select("doc_id", "seq", "type", "text", "pages")


def repaired_lines(lines: DataFrame, blocks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(block_id, line_no, text): the lines of running text with paragraphs' misread words corrected by the blocks' vocabulary; a broken word's parts stay in their lines.

    Null and empty lines, and lines of blocks that aren't there, give none.
    """
    judged = cut(_to_judge(blocks.dropDuplicates(["block_id"]), pages, F.col("block_id")))
    rows = lines.filter(F.length("text") > 0).select("block_id", "line_no", "text").distinct()
    rows = rows.join(judged.select(F.col("row").alias("block_id"), "prose"), "block_id").select(F.struct("block_id", "line_no").alias("row"), F.col("block_id").alias("place"), "prose", "text")
    return _repaired_texts(rows, False, judged).select("row.*", "text")
