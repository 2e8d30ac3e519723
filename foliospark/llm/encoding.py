"""Text decoded with the wrong character encoding: find the affected fields and restore them by noisy-channel decoding.

A channel is a pair of encodings, the one that was used and the right one, up to three times over where text was read as UTF-8 wrongly
again and again. A unit of text (what stands between white space, cut where scripts without spaces begin) is put back into bytes by the
encoding used; characters lost are wildcards of a byte lattice. The lattice is read in the right encoding: by the most frequent word of
the corpus that fits it, and by Viterbi search over all known letters that fit, under the corpus' letter sequences. A second Viterbi
search runs over a field's units with the channels as states: a unit gains what its reading is likelier than its own characters under
the corpus' word frequencies, and entering a channel costs a fixed amount. So one channel is found for a damaged passage from all of
its units, undamaged passages cost nothing, and all units of the passage are read alike.

Words are counted exactly, by pages, and joined to the fields that ask for them; a field's own occurrence doesn't speak for it. Letter
sequences, which only smooth words that the corpus lacks, are in hashed tables of fixed size (2**20 counters each, for letters, pairs and
triples). Units whose shape already shows damage are left out of both.

Defined results: null and empty fields are no case; of HTML the text is judged, entities as their characters, and markup stays as it
is; a unit with replacement or control characters that nothing fits is a case and stays; where fewer than half of a unit's letters are
left, or over eight are lost in a row, no reading is tried; repeated rows give one found row; other columns pass through.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.arrow import by_row, code_points, dense_tables, slices
from foliospark.llm.vocabulary import in_buckets, informed
from foliospark.session import cut

BITS = 20
USED = ("cp1252", "cp1250", "iso8859-2", "cp1254", "mac-roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic", "cp1253", "iso8859-7", "cp874", "cp1256")
WIDE = ("gb18030", "cp932", "euc-jp", "big5", "euc-kr")
RIGHT = (*USED, "iso8859-6", "cp1255")
AGAIN = ("cp1252", "cp1250", "mac-roman", "cp437", "cp850", "cp1251")
#: What entering a channel costs: as UTF-8, between other encodings, and each time over.
ENTER_UTF8, ENTER_OTHER, ENTER_AGAIN, ROUNDS = 1.5, 8.0, 1.0, 3
#: The logarithm of the probability of a character that text can't hold, and of a capital after a small letter within a word.
IMPOSSIBLE, CAPITAL_WITHIN = -40.0, -4.0
#: The least logarithm of a letter's probability after two others that raises no doubt about a word.
DOUBT = -8.5
#: The same for a sign, among all pieces of text, and for letters of scripts without spaces, as a run of them has many.
DOUBT_SIGN = -10.5
MOST_LOST = 8
#: A reading likelier than its unit by so much, by letters alone, leaves no question; channels behind the best by more aren't tried.
EXPLAINED = 10.0
LOST = "�"
UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}ー々〆"
OWN = UNSPACED + r"\p{Devanagari}\p{Arabic}\p{Hangul}、。「」『』，！？：；（）・"
CUT = regex.compile(rf"(?<=[{OWN}])(?=[^{OWN}])|(?<=[^{OWN}])(?=[{OWN}])|(?<=[。！？，、])")
HAS_OWN = regex.compile(rf"[{OWN}]")
PIECE = regex.compile(rf"(?V1)[[\p{{L}}\p{{M}}]--[{UNSPACED}]]+|[{UNSPACED}]+|\p{{Nd}}+|[^ \t\r\n\f\v]")
SPACE = regex.compile(r"[ \t\r\n\f\v]+")
MARKUP = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|</?[a-z][^<>]*>|<[!?][^>]*>"
HTML_GAP = regex.compile(rf"{MARKUP}|[ \t\r\n\f\v]+")
#: What stands within words of undamaged text only by mistake.
SIGNS = r"\p{So}\p{Sm}\p{Sc}\p{No}\p{Cc}¨¯´¸¬†‡‰ˆ˜˘˝˙˛•"
ODD = regex.compile(rf"[\p{{L}}\p{{M}}][{SIGNS}¡¿§¶­]|[{SIGNS}][\p{{L}}\p{{M}}]|[\x80-\x9f]|�")
DAMAGED = regex.compile(rf"[\p{{L}}\p{{M}}][{SIGNS}]|[{SIGNS}]\p{{Ll}}\p{{L}}{{2}}|[\x80-\x9f]|�")
GONE = regex.compile(r"[�\x80-\x84\x86-\x9f]")
ASKED = regex.compile(r"(?<=\p{L})\?+(?=\p{Ll})")
UTF8_BYTES = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
UTF8_ENDS = re.compile(rb"^[\x80-\xbf]{1,3}|(?:[\xc2-\xf4]|[\xe0-\xf4][\x80-\xbf]|[\xf0-\xf4][\x80-\xbf]{2})$")
ONE_LETTER = regex.compile(r"^\P{L}*\p{L}\p{M}*[\p{P}\s]*$")
LETTER = regex.compile(r"\p{L}")
CAMEL = regex.compile(r"\p{Ll}(?=\p{Lu})")
WIDE_LETTER = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
ALPHABETS = tuple(regex.compile(rf"\p{{{s}}}") for s in ("Latin", "Greek", "Cyrillic", "Arabic", "Hebrew", "Thai"))
HALF_WIDTH = regex.compile(r"[｡-ﾟ]")

Channel = tuple[str, ...]


@lru_cache(None)
def narrow(name: str) -> tuple[str, ...]:
    """The character of each byte; an undefined one's is the control character of its number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return tuple(out)


class _ToBytes(dict):
    """For str.translate: characters to those of the same number as their byte; others to U+0100, which has none."""

    def __missing__(self, c: int) -> int:
        return c if c < 0x80 else 0x100


@lru_cache(None)
def _to_bytes(name: str) -> _ToBytes:
    table = _ToBytes({ord(c): b for b, c in reversed(list(enumerate(narrow(name))))})
    if name == "cp1252":  # and Latin 1, which differs in control characters
        table.update({b: b for b in range(0x80, 0xA0) if b not in table})
    return table


@lru_cache(None)
def _to_letters(name: str) -> dict[int, str]:
    return {b: c for b, c in enumerate(narrow(name)) if ord(c) != b}


def _may_be(text: str, used: tuple[str, ...]) -> list[str]:
    """The encodings, of those, that have all characters of the text."""
    beyond = {ord(c) for c in set(text) if c >= "\x80"}
    return [u for u in used if u in WIDE or _to_bytes(u).keys() >= beyond]


def raw_of(text: str, used: str) -> bytes | None:
    """The text's bytes in the encoding that was used; None if it can't be from there."""
    try:
        return text.encode(used) if used in WIDE else text.translate(_to_bytes(used)).encode("latin-1")
    except UnicodeEncodeError:
        return None


def as_read(raw: bytes, right: str) -> str | None:
    if right in RIGHT:
        return raw.decode("latin-1").translate(_to_letters(right))
    try:
        return raw.decode(right)
    except UnicodeDecodeError:
        return None


def utf8_of(unit: str, used: str) -> str | None:
    """The unit with all of it that is UTF-8 read so, what is cut off at its ends left out; None if nothing is."""
    raw = raw_of(unit, used)
    if raw is None or not UTF8_BYTES.search(raw):
        return None
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    raw = UTF8_ENDS.sub(b"", raw) if len(raw) > 8 else raw
    if used in WIDE:
        return as_read(raw, "utf-8")
    table, out, at = narrow(used), [], 0
    for m in UTF8_BYTES.finditer(raw):
        out += (*map(table.__getitem__, raw[at : m.start()]), m[0].decode("utf-8", "replace"))
        at = m.end()
    return "".join((*out, *map(table.__getitem__, raw[at:])))


@lru_cache(1)
def utf8_shaped() -> regex.Pattern:
    """What reads as UTF-8 in one of the usual wrong encodings."""
    parts = []
    for used in ("cp1252", "cp1250", "mac-roman", "cp437", "cp850", "cp1251", "cp1253"):
        at = lambda a, b: "[" + "".join(regex.escape(c, special_only=True) for c in narrow(used)[a:b]) + "]"  # noqa: B023, E731
        rest = at(0x80, 0xC0)
        parts += [at(0xC2, 0xE0) + rest, at(0xE0, 0xF0) + rest + "{2}", at(0xF0, 0xF5) + rest + "{3}"]
    return regex.compile("|".join(parts))


def units(token: str) -> list[str]:
    """The token cut where scripts without spaces begin and end, and after their sentences."""
    return CUT.split(token) if HAS_OWN.search(token) else [token]


@lru_cache(1)
def _unspaced() -> regex.Pattern:
    return regex.compile(rf"[{UNSPACED}]")


# --- what the corpus holds


def _hashes(*points: np.ndarray) -> np.ndarray:
    h = np.full(len(points[0]), len(points), np.uint64)
    for p in points:
        h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def gram_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each letter of the padded words, the slots of it, of it with the one before, and with the two before."""
    points, offsets = code_points([f"\x02{w}\x03" for w in words])
    p = points.astype(np.uint64)
    b, a = np.roll(p, 1), np.roll(p, 2)
    starts = offsets[:-1]
    b[starts] = 2
    a[starts] = 2
    a[starts + 1] = 2
    return _hashes(p), _hashes(b, p), _hashes(a, b, p), offsets


class Letters:
    """A model of letter sequences, and how often each character stands alone or in words, by pages."""

    def __init__(self, grams: np.ndarray, chars: dict[str, int], n_pieces: float) -> None:
        self.grams, self.chars, self.n_pieces = grams, chars, max(1.0, n_pieces)
        self.n_letters = max(1.0, float(grams[0].sum()))
        self._kept: dict[str, float] = {}
        self._first: dict[str, float] = {}

    def known(self, text: str) -> bool:
        return all(c < "\x80" or c in self.chars for c in text.lower())

    def spelled(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The logarithm of each letter's probability after the two before it, and the words' offsets."""
        one, two, three, offsets = gram_slots(words)
        n1, n2, n3 = (self.grams[k][s] for k, s in enumerate((one, two, three)))
        p1 = (n1 + 0.02) / (self.n_letters + 0.02 * 60_000)
        p2 = (n2 + 3 * p1) / (np.append(n1[-1:], n1[:-1]) + 3)
        p3 = (n3 + 2 * p2) / (np.append(n2[-1:], n2[:-1]) + 2)
        p3[offsets[:-1]] = 1.0  # the padding before a word
        second = offsets[:-1] + 1
        p3[second] = p2[second]
        return np.log(np.minimum(1, p3)), offsets

    def learn(self, words: list[str]) -> None:
        """Keeps the words' probabilities by their letters."""
        new = [w for w in dict.fromkeys(words) if w not in self._kept]
        if len(self._kept) > 500_000:
            self._kept.clear()
            new = list(dict.fromkeys(words))
        if new:
            self._kept.update(zip(new, by_row(np.add, *self.spelled(new)).tolist(), strict=True))

    def of_word(self, word: str) -> float:
        got = self._kept.get(word)
        if got is None:
            self.learn([word])
            got = self._kept[word]
        return got

    def of_char(self, c: str, own: int = 0) -> float:
        if GONE.match(c):
            return IMPOSSIBLE
        return float(np.log((max(0, self.chars.get(c, 0) - own) + 0.05) / self.n_pieces))

    def least(self, words: list[str]) -> np.ndarray:
        """The logarithm of each word's least likely letter; the first one's among first letters of its script, as a script may be rare."""
        if not self._first:
            of_script: dict[str, list[str]] = {}
            for c in {*"abcdefghijklmnopqrstuvwxyz", *(c for c in self.chars if c.isalpha())}:
                of_script.setdefault(_script(c), []).append(c)
            for letters in of_script.values():
                n = self.grams[1][_hashes(np.full(len(letters), 2, np.uint64), np.array([ord(c) for c in letters], np.uint64))] + 0.02
                self._first |= dict(zip(letters, np.log(n / n.sum()).tolist(), strict=True))
        p, offsets = self.spelled(words)
        p[offsets[:-1] + 1] = [self._first.get(w[0], IMPOSSIBLE) for w in words]
        return by_row(np.minimum, p, offsets)

    def step(self, before: np.ndarray, last: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The logarithm of each letter's probability after the two before, as code points."""
        before, last, c = (x.astype(np.uint64) for x in (before, last, c))
        p1 = (self.grams[0][_hashes(c)] + 0.02) / (self.n_letters + 0.02 * 60_000)
        p2 = (self.grams[1][_hashes(last, c)] + 3 * p1) / (self.grams[0][_hashes(last)] + 3)
        p3 = (self.grams[2][_hashes(before, last, c)] + 2 * p2) / (self.grams[1][_hashes(before, last)] + 2)
        return np.log(np.minimum(1, np.where(before == 2, np.where(last == 2, p2, p3), p3)))


@lru_cache(20_000)
def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0]


def plain_column(batch: pa.RecordBatch) -> pa.Array:
    """The batch's texts, of HTML without its markup."""
    text = pc.fill_null(batch.column("text"), "")
    return pc.if_else(pc.fill_null(batch.column("is_html"), False), pc.replace_substring_regex(text, MARKUP, " "), text)


def tokens_of(batch: pa.RecordBatch) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Codes into the distinct tokens, these, and row offsets."""
    lists = pc.ascii_split_whitespace(plain_column(batch))
    flat = lists.flatten().dictionary_encode()
    offsets = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).astype(np.int64)
    return flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary.to_pylist(), offsets


def _value(token: str) -> str:
    return html.unescape(token) if "&" in token else token


WORD, CHAR, GRAM = 0, 1, 2


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, word, slot, n): by rows, how many have a word (k 0) or a character (k 1); slots of letter sequences (k 2 to 4)."""
    grams = np.zeros((3, 1 << BITS))
    cut_up: dict[str, tuple[str, ...]] = {}
    for batch in slices(batches, "text"):
        codes, distinct, offsets = tokens_of(batch)
        if len(cut_up) > 300_000:
            cut_up.clear()
        index: dict[str, int] = {}
        flat, starts = [], [0]
        for t in distinct:
            parts = cut_up.get(t)
            if parts is None:
                v = _value(t)
                damaged = not v.isascii() and bool(DAMAGED.search(v) or utf8_shaped().search(v))
                parts = cut_up[t] = () if damaged else tuple(dict.fromkeys(p for p in PIECE.findall(v.lower()) if not (p.isdecimal() and p.isascii())))
            flat += [index.setdefault(p, len(index)) for p in parts]
            starts.append(len(flat))
        if not index:
            continue
        flat_, starts_ = np.array(flat, np.int64), np.array(starts, np.int64)
        row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        pairs = np.unique(row * len(distinct) + codes)
        row, code = pairs // len(distinct), pairs % len(distinct)
        n = starts_[code + 1] - starts_[code]
        at = np.repeat(starts_[code] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        held = np.unique(np.repeat(row, n) * len(index) + flat_[at]) % len(index)
        many = np.bincount(held, minlength=len(index))
        pieces = list(index)
        wordy = [i for i, p in enumerate(pieces) if p[0].isalpha() or len(p) > 1]
        one, two, three, gram_offsets = gram_slots([pieces[i] for i in wordy])
        each = np.repeat(many[wordy].astype(float), np.diff(gram_offsets))
        for k, s in enumerate((one, two, three)):
            grams[k] += np.bincount(s, each, 1 << BITS)
        chars: dict[str, int] = {}
        words: dict[str, int] = {}
        for p, m in zip(pieces, many.tolist(), strict=True):
            if len(p) == 1 and not p.isalpha():
                chars[p] = chars.get(p, 0) + m
                continue
            for c in set(p):
                if c >= "\x80":
                    chars[c] = chars.get(c, 0) + m
            if not _unspaced().match(p):
                words[p] = words.get(p, 0) + m
        for k, found in ((WORD, words), (CHAR, chars)):
            m = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([k] * m, pa.int32()), pa.array(list(found), pa.string()), pa.array([0] * m, pa.int32()), pa.array(list(found.values()), pa.int64())], ["k", "word", "slot", "n"])
    for k, t in enumerate(grams):
        at = np.flatnonzero(t)
        m = len(at)
        yield pa.RecordBatch.from_arrays([pa.array([GRAM + k] * m, pa.int32()), pa.nulls(m, pa.string()), pa.array(at, pa.int32()), pa.array(t[at].astype(np.int64))], ["k", "word", "slot", "n"])


def skeletons(word: str) -> list[str]:
    """How a word looks when the bytes of its letters beyond ASCII are lost, in UTF-8 and in an encoding of one byte each."""
    return list(dict.fromkeys("".join(c if c < "\x80" else LOST * n(c) for c in word) for n in (lambda c: len(c.encode()), lambda c: 1)))


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, n = batch.column("word").to_pylist(), batch.column("n").to_pylist()
        rows = [(s, w, m) for w, m in zip(words, n, strict=True) for s in skeletons(w) if LETTER.search(s)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["word", "meant", "n"])


def statistics(texts: DataFrame) -> tuple[DataFrame, Letters]:
    """The words' exact counts (word, meant, n) and the model of letters. To the driver come the letter tables, of fixed size, and a number for each code point.

    Words that lost letters are rows too: `word` as it looks then, `meant` the most frequent that looks so.
    """
    counted = cut(texts.select("text", "is_html").mapInArrow(_count, "k int, word string, slot int, n long"))
    words = counted.filter(F.col("k") == WORD).groupBy("word").agg(F.sum("n").alias("n"))
    chars = counted.filter(F.col("k") == CHAR).groupBy("word").agg(F.sum("n").alias("n"))
    total = counted.filter(F.col("k") <= CHAR).agg(F.sum("n")).first()[0] or 0
    grams = dense_tables(counted.filter(F.col("k") >= GRAM).select((F.col("k") - GRAM).alias("k"), "slot", "n"), 3, BITS)
    letters = Letters(grams, {r["word"]: r["n"] for r in chars.toLocalIterator()}, float(total))
    lost = words.filter(F.col("word").rlike(r"[^\x00-\x7f]")).mapInArrow(_skeletons, "word string, meant string, n long")
    lost = lost.groupBy("word").agg(F.max_by("meant", F.struct("n", "meant")).alias("meant"), F.max("n").alias("n"))
    return words.select("word", F.lit(None).cast("string").alias("meant"), "n").unionByName(lost), letters


# --- channels


def read(unit: str, channel: Channel) -> str | None:
    """The unit through a channel, the encodings used and the right one last; None if it can't be from there."""
    *used, right = channel
    if right != "utf-8":
        raw = raw_of(unit, used[0])
        return None if raw is None else as_read(raw, right)
    for u in used:
        got = utf8_of(unit, u)
        if got is None:
            return None
        unit = got
    return unit


class Pieces(dict):
    """The pieces of each text in small letters, found once."""

    def __missing__(self, text: str) -> list[str]:
        if len(self) > 200_000:
            self.clear()
        got = self[text] = PIECE.findall(text.lower())
        return got


class Channels:
    """The readings of units in doubt, each found once."""

    def __init__(self, letters: Letters) -> None:
        self.letters = letters
        self._of: dict[str, dict[Channel, str]] = {}
        self._doubt: dict[str, bool] = {}
        self._read: dict[Channel, dict[str, str | None]] = {}

    def judge(self, tokens: list[str]) -> None:
        """Finds which tokens are in doubt, all at once: by their shape, and by their least likely letter."""
        if len(self._doubt) > 400_000:
            self._doubt.clear()
        words, where = [], []
        for t in dict.fromkeys(tokens):
            if t in self._doubt:
                continue
            v = _value(t)
            if v.isascii():
                self._doubt[t] = bool(ASKED.search(v))
                continue
            self._doubt[t] = bool(ODD.search(v) or CAMEL.search(v) or utf8_shaped().search(v))
            for p in () if self._doubt[t] else PIECE.findall(v.lower()):
                if len(p) == 1 and not p.isalpha():
                    if p >= "\x80" and self.letters.of_char(p) < DOUBT_SIGN:
                        self._doubt[t] = True
                elif not p.isascii():
                    words.append(p)
                    where.append(t)
        if words:
            for t, w, x in zip(where, words, self.letters.least(words).tolist(), strict=True):
                if x <= (DOUBT_SIGN if _unspaced().match(w) else DOUBT):
                    self._doubt[t] = True

    def in_doubt(self, token: str) -> bool:
        return self._doubt[token]

    def readings(self, unit: str) -> dict[Channel, str]:
        got = self._of.get(unit)
        if got is None:
            if len(self._of) > 100_000:
                self._of.clear()
            got = {} if LOST in unit or unit.isascii() else self._as_utf8(unit)
            # what is UTF-8 by all of its bytes and known letters is nothing else
            if not any(self.letters.known(x) and as_read(raw_of(unit, c[0]) or b"\xff", "utf-8") is not None for c, x in got.items()):
                got |= {} if LOST in unit or unit.isascii() else self._in_pairs(unit)
            self._of[unit] = got
        return got

    def read(self, unit: str, channel: Channel) -> str | None:
        kept = self._read.setdefault(channel, {})
        if unit not in kept:
            if len(kept) > 50_000:
                kept.clear()
            kept[unit] = read(unit, channel)
        return kept[unit]

    def _as_utf8(self, unit: str) -> dict[Channel, str]:
        out: dict[Channel, str] = {}
        live, had = {(): unit}, {unit}
        for k in range(ROUNDS):
            step: dict[Channel, str] = {}
            for chain, text in live.items():
                for used in _may_be(text, AGAIN if k else (*USED, *WIDE)):
                    got = utf8_of(text, used)
                    if got is None or got == text or (k and got in had):
                        continue
                    # letters the corpus doesn't know speak against a single one being meant
                    if self.letters.known(got) or utf8_shaped().search(got) or len(got.encode()) - len(got) >= 4:
                        step[*chain, used] = got
            had |= {*step.values()}
            out |= {(*c, "utf-8"): x for c, x in step.items()}
            live = {c: x for c, x in step.items() if not x.isascii()}
        return out

    def _in_pairs(self, unit: str) -> dict[Channel, str]:
        out: dict[Channel, str] = {}
        for used in _may_be(unit, USED):
            raw = unit.translate(_to_bytes(used)).encode("latin-1")
            for right in WIDE:
                got = as_read(raw, right)
                if got and len(got) < len(unit) and WIDE_LETTER.search(got) and not HALF_WIDTH.search(got) and self.letters.known(got):
                    out[used, right] = got
            for right in RIGHT:
                if right != used and (got := as_read(raw, right)) != unit and self._plausible(got):
                    out[used, right] = got
        return out

    def _plausible(self, text: str) -> bool:
        return self.letters.known(text) and not ODD.search(text) and sum(bool(a.search(text)) for a in ALPHABETS) <= 1


def best_path(letters: Letters, edges: list[list[tuple[int, np.ndarray]]], after: tuple[int, int] = (2, 2), to_end: bool = True) -> str | None:
    """Viterbi search over a lattice: edges[i] has the steps from place i, (how many places, code points that fit). States are the last two letters; none is left out.

    `after` are the two letters before it, 2 for none; to_end: the lattice goes to the word's end.
    """
    ends: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(len(edges) + 1)]
    ends[0].append((np.array([after[0]]), np.array([after[1]]), np.zeros(1), np.array([-1]), np.array([-1])))
    kept: list[tuple[np.ndarray, ...] | None] = [None] * (len(edges) + 1)
    for i in range(len(edges) + 1):
        if not ends[i]:
            continue
        before, last, score, place, row = (np.concatenate(x) for x in zip(*ends[i], strict=True))
        if i == len(edges) and to_end:
            score = score + letters.step(before, last, np.full(len(last), 3))
        if len(last) > 1:
            order = np.argsort(-score, kind="stable")
            order = order[np.unique(before[order] << 21 | last[order], return_index=True)[1]]
            before, last, score, place, row = before[order], last[order], score[order], place[order], row[order]
        kept[i] = before, last, score, place, row
        for n, points in edges[i] if i < len(edges) else ():
            if len(points) and i + n <= len(edges):
                m = len(points)
                c = np.tile(points, len(last))
                b, at = np.repeat(last, m), np.repeat(np.arange(len(last)), m)
                ends[i + n].append((b, c, np.repeat(score, m) + letters.step(np.repeat(before, m), b, c), np.full(len(c), i), at))
    if kept[-1] is None:
        return None
    i, k, out = len(edges), int(kept[-1][2].argmax()), []
    while i > 0:
        _, last, _, place, row = kept[i]
        out.append(chr(last[k]))
        i, k = int(place[k]), int(row[k])
    return "".join(reversed(out))


class Lattices:
    """Readings of units that lost bytes."""

    def __init__(self, letters: Letters) -> None:
        self.letters = letters
        beyond = sorted(c for c in letters.chars if c >= "\x80")
        self._all = beyond
        self._forms: dict[tuple, np.ndarray] = {}
        self._known: dict[str, list[str]] = {}

    def _fit(self, pattern: tuple[int | None, ...], script: int) -> np.ndarray:
        """The known characters whose bytes in UTF-8 fit; of letters those of the script."""
        key = (pattern, script)
        if key not in self._forms:
            if len(self._forms) > 20_000:
                self._forms.clear()
            fits = [c for c in self._all if len(b := c.encode()) == len(pattern) and all(p is None or p == x for p, x in zip(pattern, b, strict=True))]
            self._forms[key] = np.array([ord(c) for c in fits if ALPHABETS[script].match(c) or (script < 0 if c.isalpha() else unicodedata.category(c)[0] != "M")], np.int64)
        return self._forms[key]

    def readings(self, unit: str) -> list[str]:
        """By Viterbi search, of bytes lost from UTF-8 and from an encoding of one byte a letter; none where too little is left."""
        if unit not in self._known:
            if len(self._known) > 100_000:
                self._known.clear()
            self._known[unit] = list(self._read(unit))
        return self._known[unit]

    def _read(self, unit: str) -> Iterator[str]:
        low = unit.lower()
        left, lost = sum(c.isalpha() for c in low), low.count(LOST)
        if LOST * (MOST_LOST + 1) in low:
            return
        script = next((i for i, a in enumerate(ALPHABETS) if a.search(low)), -1)
        raw = raw_of(low.replace(LOST, "\x00"), "cp1252")
        if raw is not None and lost <= 2 * left:
            cells = [None if c == LOST else b for c, b in zip(low, raw, strict=True)]
            edges = [[(n, self._fit(tuple(cells[i : i + n]), script)) for n in (2, 3)] if b is None or b >= 0x80 else [(1, np.array([b]))] for i, b in enumerate(cells)]
            if got := self._within(low, [i for i, b in enumerate(cells) if b is None or b >= 0x80], edges):
                yield got
        if left and lost <= left and script >= 0:
            some = np.array([ord(c) for c in self._all if ALPHABETS[script].match(c)], np.int64)
            if got := self._within(low, [i for i, c in enumerate(low) if c == LOST], [[(1, some if c == LOST else np.array([ord(c)]))] for c in low]):
                yield got

    def _within(self, low: str, open_: list[int], edges: list[list[tuple[int, np.ndarray]]]) -> str | None:
        """The best path where only the places in open_ are open. Letters further than two from these are as they are and say nothing about them."""
        a, b = open_[0], min(len(low), open_[-1] + 3)
        before = f"\x02\x02{low[:a]}"[-2:]
        got = best_path(self.letters, edges[a:b], (ord(before[0]), ord(before[1])), b == len(low))
        return None if got is None else low[:a] + got + low[b:]


CORE = regex.compile(rf"[\p{{L}}\p{{M}}{LOST}][\p{{L}}\p{{M}}{LOST}'’]*")
LOSSY: Channel = ("lost",)


def like(unit: str, reading: str) -> str:
    """The reading, which is in small letters, in the unit's capitals."""
    letters = [c for c in unit if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return reading.upper()
    for a, b in zip(unit, reading, strict=False):
        if a.isalpha() and b.isalpha():
            return next((reading[:i] + c.upper() + reading[i + 1 :] for i, c in enumerate(reading) if c.isalpha()), reading) if a.isupper() else reading
        if a == LOST:
            break
    return reading


class Decoder:
    """Decodes fields: all units that may be damaged, through the channels that fit the field's units in doubt."""

    def __init__(self, letters: Letters) -> None:
        self.letters, self.channels, self.lattices, self.pieces = letters, Channels(letters), Lattices(letters), Pieces()
        self.counts: dict[str, int] = {}
        self.meant: dict[str, str] = {}
        self._scores: dict[tuple[str, bool], float] = {}

    def told(self, word: str, meant: str | None, n: int) -> None:
        if meant is not None:
            self.meant[word] = meant
        self.counts[meant or word] = n

    def forget(self) -> None:
        self.counts, self.meant, self._scores = {}, {}, {}

    # what both passes need of a field

    def parse(self, text: str, is_html: bool) -> tuple[list[str], list[tuple[int, str]], list[str]]:
        """Gaps and tokens in turn; of the tokens that aren't plain ASCII, or lost a letter, the places and values; the units of all of these."""
        parts, at, some = [], 0, []
        for m in (HTML_GAP if is_html else SPACE).finditer(text):
            parts += (text[at : m.start()], m[0])
            at = m.end()
        parts.append(text[at:])
        for i in range(0, len(parts), 2):
            v = _value(parts[i]) if is_html else parts[i]
            if not v.isascii() or ASKED.search(v):
                some.append((i, v))
        return parts, some, [u for _, v in some for u in units(v)]

    def judge(self, fields: list[list[tuple[int, str]]]) -> None:
        """Judges the tokens of many fields at once, and learns the letter scores of units in doubt and of their first readings."""
        values = list(dict.fromkeys(v for some in fields for _, v in some))
        self.channels.judge(values)
        texts: dict[str, None] = dict.fromkeys(u for v in values if self.channels.in_doubt(v) for u in units(v))
        for some in fields:
            first = next((u for _, v in some if self.channels.in_doubt(v) for u in units(v)), None)
            if first is not None:
                texts |= dict.fromkeys(self.channels.readings(first).values())
        self.letters.learn([p for x in texts for p in self.pieces[x]])

    def search(self, some: list[tuple[int, str]]) -> list[Channel]:
        """The channels that fit units in doubt, by letters alone. A unit that a channel found before explains asks for no other.

        Of the channels that fit, the likeliest over all these units is taken, with those not far behind; then again for the units that it
        doesn't fit.
        """
        doubt = list(dict.fromkeys(u for _, v in some if self.channels.in_doubt(v) for u in units(v) if LOST not in u and not u.isascii()))
        gains: dict[Channel, dict[str, float]] = {}
        totals: dict[Channel, float] = {}
        for u in doubt:
            base = self.score(u, True)
            # channels far behind the best so far are asked again only by units that none of the others explains
            ahead = max(totals.values(), default=0.0) - 3 * EXPLAINED
            explained = False
            for c, own in gains.items():
                if totals[c] >= ahead and (x := self.channels.read(u, c)) is not None and x != u:
                    g = own[u] = self.score(x, False) - base
                    totals[c] += max(0.0, g)
                    explained = explained or g > EXPLAINED
            if not explained:
                options = self.channels.readings(u)
                self.letters.learn([p for x in options.values() for p in self.pieces[x]])
                new = [c for c, x in options.items() if self.score(x, False) > base]
                self.letters.learn([p for v in doubt for c in new if (x := self.channels.read(v, c)) for p in self.pieces[x]])
                for c in new:
                    g = self.score(options[c], False) - base
                    totals[c] = totals.get(c, 0.0) + (g if u not in gains.setdefault(c, {}) else 0.0)
                    gains[c][u] = g
        out: dict[Channel, None] = {}
        left = set(doubt)
        while left:
            total = {c: t for c, own in gains.items() if c not in out and (t := sum(g for u, g in own.items() if g > 0 and u in left)) > 0}
            if not total:
                break
            best = max(total, key=total.get)
            out |= {c: None for c, t in total.items() if t > total[best] - EXPLAINED}
            left -= {u for u, g in gains[best].items() if g > 0}
        return list(out)

    def readings(self, channels: list[Channel], all_units: list[str]) -> dict[Channel, tuple]:
        """The readings of all units by channel; of channels that read alike the first."""
        out: dict[tuple, Channel] = {}
        for c in channels:
            out.setdefault(tuple([None if LOST in u else self.channels.read(u, c) for u in all_units]), c)
        return {c: x for x, c in out.items()}

    def asks(self, channels: list[Channel], all_units: list[str]) -> set[str]:
        """The words whose counts decide."""
        some = [u for u in all_units if LOST in u or (u.isascii() and ASKED.search(u))]
        texts = {u for u in all_units if LOST not in u} if channels or some else set()
        texts.update(x for row in self.readings(channels, all_units).values() for x in row if x)
        out = {p for x in texts for p in self.pieces[x] if p.isalpha()}
        for u in some:
            shown = u if LOST in u else ASKED.sub(lambda m: LOST * len(m[0]), u)
            out.update(m[0].lower() for m in CORE.finditer(shown) if LOST in m[0])
        return out

    # scores

    def score(self, text: str, own: bool) -> float:
        """The logarithm of a text's probability; `own`: as it stands in the field, which doesn't count as evidence."""
        key = (text, own)
        if key in self._scores:
            return self._scores[key]
        s = CAPITAL_WITHIN * len(CAMEL.findall(text))
        for p in self.pieces[text]:
            if p.isdecimal() and p.isascii():
                continue
            if len(p) == 1 and not p.isalpha():
                s += self.letters.of_char(p, own)
            elif _unspaced().match(p):
                s += self.letters.of_word(p)
            else:
                n = max(0, self.counts.get(p, 0) - own)
                s += float(np.logaddexp(-1.2 + self.letters.of_word(p), np.log(0.7 * n / self.letters.n_pieces) if n else -np.inf))
        if len(self._scores) > 300_000:
            self._scores.clear()
        self._scores[key] = s
        return s

    def gain(self, unit: str, reading: str | None, utf8: bool) -> float:
        """What a reading is likelier than the unit; a letter by itself, as of initials, says little about a pair of encodings."""
        if reading is None:
            return -np.inf
        if reading == unit:
            return 0.0
        g = self.score(reading, False) - self.score(unit, True)
        return g if utf8 or g <= 1 or not ONE_LETTER.match(unit) else 1.0

    def lost(self, unit: str) -> str | None:
        """The best reading of a unit that lost bytes: the words that look so, else of what its lattices give the likeliest."""
        shown = unit if LOST in unit else ASKED.sub(lambda m: LOST * len(m[0]), unit)
        by_words = CORE.sub(lambda m: like(m[0], self.meant[m[0].lower()]) if LOST in m[0] and m[0].lower() in self.meant else m[0], shown)
        if LOST not in by_words:
            return by_words
        return max((like(unit, x) for x in self.lattices.readings(unit)), key=lambda x: self.score(x, False), default=None) if LOST in unit else None

    def decode(self, fields: list[tuple[str, bool, list[Channel]]]) -> list[tuple[str, bool]]:
        """The fields, (text, is_html, channels), restored, and whether each is a case."""
        parsed = [self.parse(t, h) for t, h, _ in fields]
        told = [self.readings(c, us) for (_, _, c), (_, _, us) in zip(fields, parsed, strict=True)]
        texts = {x for row in told for xs in row.values() for x in xs if x}.union(u for (_, _, us), row in zip(parsed, told, strict=True) if row for u in us)
        self.letters.learn([p for x in texts for p in self.pieces[x]])
        return [self._decoded(t, h, p, r) for (t, h, _), p, r in zip(fields, parsed, told, strict=True)]

    def _decoded(self, text: str, is_html: bool, parsed: tuple, told: dict[Channel, tuple]) -> tuple[str, bool]:
        parts, some, all_units = parsed
        chosen: list[str] = list(all_units)
        case = any(GONE.search(u) for u in all_units)
        for i, u in enumerate(all_units):
            if LOST in u or (u.isascii() and ASKED.search(u)):
                got = self.lost(u)
                if got is not None and (LOST in u or self.score(got, False) - self.score(u, True) > ENTER_OTHER):
                    chosen[i], case = got, True
        if told:
            names = list(told)
            enter = np.array([(ENTER_UTF8 + ENTER_AGAIN * (len(c) - 2)) if c[-1] == "utf-8" else ENTER_OTHER for c in names])
            gains = np.array([[self.gain(u, x, c[-1] == "utf-8") for x, u in zip(told[c], all_units, strict=True)] for c in names])
            for i, k in enumerate(passages(gains, enter)):
                if k >= 0 and (x := told[names[k]][i]) != all_units[i] and gains[k, i] > 0:
                    chosen[i], case = x, True
        if chosen == all_units:
            return text, case
        parts, at = list(parts), 0
        for i, v in some:
            n = len(units(v))
            if chosen[at : at + n] != all_units[at : at + n]:
                got = "".join(chosen[at : at + n])
                parts[i] = html.escape(got, quote=False) if is_html else got
            at += n
        return "".join(parts), case


def passages(gains: np.ndarray, enter: np.ndarray) -> list[int]:
    """Viterbi search over units: the channel of each, or -1. Leaving a channel is free, entering costs."""
    inside = np.full(len(enter), -np.inf)
    outside, back = 0.0, []
    for g in gains.T:
        k = int(inside.argmax())
        best, came = (inside[k], k) if inside[k] > outside else (outside, -1)
        stays = inside >= best - enter
        back.append((came, stays))
        inside = np.where(stays, inside, best - enter) + g
        outside = best
    k = int(inside.argmax())
    state = k if inside[k] > outside else -1
    out = []
    for came, stays in reversed(back):
        out.append(state)
        if state < 0 or not stays[state]:
            state = came
    return out[::-1]


# --- frames


def fields(pages: DataFrame) -> DataFrame:
    """(page_id, field, text, is_html), the fields of native pages that hold text."""
    both = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("text"), F.lit(c.endswith("html")).alias("is_html")) for c in ("native_text", "native_html")))
    return pages.select("page_id", F.explode(both).alias("_f")).select("page_id", "_f.*").filter(F.length("text") > 0)


def _planned(rows: DataFrame, letters: Letters) -> DataFrame:
    """The rows, (row, text, is_html), with the channels found for them, the words these ask about, and whether anything in them may be a case."""
    told = rows.sparkSession.sparkContext.broadcast(letters)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(told.value)
        for batch in slices(batches, "text"):
            codes, distinct, offsets = tokens_of(batch)
            decoder.channels.judge([_value(t) for t in distinct])
            hit = np.array([decoder.channels.in_doubt(_value(t)) for t in distinct], np.int64)
            doubt = np.flatnonzero(by_row(np.add, hit[codes], offsets)) if len(codes) else []
            found: list[list[str]] = [[] for _ in range(batch.num_rows)]
            asks: list[list[str]] = [[] for _ in range(batch.num_rows)]
            live = np.zeros(batch.num_rows, bool)
            parsed = {i: decoder.parse(batch.column("text")[i].as_py(), bool(batch.column("is_html")[i].as_py())) for i in doubt}
            decoder.judge([some for _, some, _ in parsed.values()])
            for i, (_, some, all_units) in parsed.items():
                channels = decoder.search(some)
                asks[i], found[i] = list(decoder.asks(channels, all_units)), [" ".join(c) for c in channels]
                live[i] = bool(channels or asks[i]) or any(GONE.search(u) for u in all_units)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string())), pa.array(asks, pa.list_(pa.string())), pa.array(live)], [*batch.schema.names, "channels", "asks", "live"])

    more = [T.StructField("channels", T.ArrayType(T.StringType())), T.StructField("asks", T.ArrayType(T.StringType())), T.StructField("live", T.BooleanType())]
    return rows.mapInArrow(plan, T.StructType([*rows.schema.fields, *more]))


def _decoded(planned: DataFrame, counts: DataFrame, letters: Letters) -> DataFrame:
    """The live rows of a plan, (row, text), with restored and is_case."""
    known = planned.sparkSession.sparkContext.broadcast(letters)
    schema = T.StructType([planned.schema["row"], T.StructField("restored", T.StringType()), T.StructField("is_case", T.BooleanType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, at = Decoder(known.value), None
        for batch in slices(batches, "text", 1_000_000):
            rows, done, wait = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("bucket", "told", "word", "meant", "n", "text", "is_html", "channels"))
            for i, (bucket, told, word, meant, n, text, is_html, channels) in enumerate(zip(*columns, strict=True)):
                if bucket != at:
                    done += decoder.decode(wait)
                    at, wait = bucket, []
                    decoder.forget()
                if told:
                    decoder.told(word, meant, n)
                else:
                    rows.append(i)
                    wait.append((text, bool(is_html), [tuple(c.split(" ")) for c in channels]))
            done += decoder.decode(wait)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(rows, pa.int64())), pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.bool_())], schema.names)

    return informed(in_buckets(planned.filter("live").drop("live")), counts).mapInArrow(decode, schema)


def restored_cases(texts: DataFrame) -> DataFrame:
    """The rows of the frame, which has (text, is_html), that are cases, with `restored` after its own columns."""
    own = [c for c in texts.columns if c.lower() not in ("restored", "is_case")]
    rows = texts.select(F.struct(*own).alias("row"), "text", "is_html")
    counts, letters = statistics(texts)
    return _decoded(_planned(rows, letters), counts, letters).filter("is_case").select("row.*", "restored")


def restore(texts: DataFrame) -> DataFrame:
    """The frame, which has (text, is_html), with restored and is_case; markup of HTML stays."""
    own = [c for c in texts.columns if c.lower() not in ("restored", "is_case")]
    rows = texts.select(F.struct(*own).alias("row"), "text", "is_html")
    counts, letters = statistics(texts)
    planned = cut(_planned(rows, letters))
    rest = planned.filter("NOT live").select("row", F.col("text").alias("restored"), F.lit(False).alias("is_case"))
    return _decoded(planned, counts, letters).unionByName(rest).select("row.*", "restored", "is_case")


def garbled_fields(pages: DataFrame) -> DataFrame:
    """(page_id, field), distinct: fields with a passage decoded with a wrong encoding."""
    return restored_cases(fields(pages)).select("page_id", "field").distinct()
