"""Sentences of documents in many languages, by document-centred disambiguation.

Possible ends are terminators of the script (with closing quotes and brackets) and, in Thai, spaces. Whether a full stop ends a sentence
is taken from unambiguous occurrences: a word whose full stop is followed by a small letter or a digit elsewhere in the
document is an abbreviation there; where the document doesn't tell, the corpus does: how often the word's full stop stands
before small letters and digits, and at a paragraph's end, where only a sentence's end can be. An abbreviation before a capital ends a
sentence if the capitalised word is a common one: if the document has it more often in small letters than with a capital within a
sentence, where proper names stand; where the document doesn't tell, by its counts in the corpus. One that can end sentences, as it ends
paragraphs too, ends none before a proper name. Abbreviations that by enough observations hardly ever end a paragraph, as titles before names
do, end no sentence whatever follows, since names are often common words too. A capital after an ellipsis, or a
word of a script without capitals, is judged by how often that word begins paragraphs and how often it stands within
sentences.

The corpus' counts are kept whole. Documents go into buckets of about BUCKET bytes of text, and each bucket gets the counts of the words
it asks about by a join, so a word is judged by its evidence alone, whatever the size of the corpus: from EVIDENCE observations on.

Defined results: null and blank texts have no sentence; a text without terminator is one; a blank line always ends one;
repeated documents give repeated sentences, which p9_found counts once; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.arrow import Tally, slices, words_of
from foliospark.session import cut

BUCKET, EVIDENCE = 1_000_000, 3
CLOSERS = "\"'»”“’›)]」』）］】〉》"
OPENERS = "\"'«“„‘‹([「『（［【〈《¿¡‚"
STOPS = ".!?…。！？｡।॥؟۔;።។။"
CANDIDATE = re.compile(rf"[{re.escape(STOPS)}]+(?:[ ](?=[»›]))?[{re.escape(CLOSERS)}]*")
THAI = re.compile("[฀-๿]")
THAI_SPACE = regex.compile(r"(?<=[฀-๿])[^\S]+|[^\S]+(?=[฀-๿])")
PARAGRAPH = regex.compile(r"\n[^\S\n]*\n\s*")
FULL_STOP_ALWAYS = set("。！？｡।॥؟۔።។။")
WIDE = set("。！？｡")
#: Read backwards: its match ends where the search does.
LAST_WORD = regex.compile(r"(?r)[\p{L}\p{M}]+|\p{Nd}+")
GREEK = regex.compile(r"[Ͱ-Ͽἀ-῿]")
CASELESS = regex.compile(r"[֐-ࣿऀ-෿฀-႟ក-៿぀-ヿ㐀-鿿가-힯]")
SPACELESS = regex.compile(r"[぀-ヿ㐀-鿿]")
NEXT_WORD = regex.compile(r"[\p{L}\p{M}]+")
WITHIN = regex.compile(r"[\p{L}\p{M}\p{Nd},](?:[^\S\n]+|[^\S\n]*\n[^\S\n]*)$")
CHAIN = regex.compile(r"\p{L}\p{M}*\.(?:\s|$)")
LONG_WORD = regex.compile(r"[\p{L}\p{M}]{1,40}(?=\.)")
RUN = re.compile(rf"[{re.escape(STOPS)}]{{2,}}|…|[{re.escape(STOPS)}](?=[^\W\d_])")
KINDS = ("small", "digit", "capital", "other", "end")
WHAT = (*KINDS, "begins", "anywhere")
_COUNTED = ["what", "word", "bucket", "n"]


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Where each paragraph begins and ends, white space around it excluded."""
    at = 0
    for m in PARAGRAPH.finditer(text):
        yield from _trimmed(text, at, m.start())
        at = m.end()
    yield from _trimmed(text, at, len(text))


def _trimmed(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    if a < b:
        yield a, b


def _kind(text: str, at: int, end: int) -> str:
    if at >= end:
        return "end"
    c = text[at]
    return "small" if c.islower() else "digit" if c.isdigit() else "capital" if c.isupper() else "other"


def observations(text: str, a: int, b: int) -> Iterator[tuple[str, str, int]]:
    """(word, kind of what follows, where it begins) for each single full stop after a word."""
    at = text.find(".", a, b)
    while at >= 0:
        nxt = at + 1
        if (nxt == b or text[nxt].isspace()) and text[at - 1 : at] not in ("", ".", " "):
            m = LAST_WORD.match(text, max(a, at - 24), at)
            if m and not (m[0].isdigit()):
                while nxt < b and text[nxt].isspace():
                    nxt += 1
                yield m[0], _kind(text, nxt, b), nxt
        at = text.find(".", at + 1, b)


def _occurrences(text: str, word: str) -> Iterator[int]:
    """Where the word stands as a whole one."""
    at = text.find(word)
    while at >= 0:
        end = at + len(word)
        if not (at and NEXT_WORD.match(text, at - 1, at)) and not NEXT_WORD.match(text, end, end + 1):
            yield at
        at = text.find(word, end)


class Knowledge:
    """What the corpus tells: stops of words, words at paragraph beginnings, and words anywhere."""

    def __init__(self, stops: dict[str, list[int]], begins: dict[str, int], anywhere: dict[str, int], n_begins: int, n_words: int) -> None:
        self.begins, self.anywhere, self.n_begins, self.n_words = begins, anywhere, max(1, n_begins), max(1, n_words)
        self.never, self.final, self.both, self.inner = set(), set(), set(), set()
        for word, counts in stops.items():
            self._judge(word, *counts)

    def learn(self, word: str, stops: list[int], begins: int, anywhere: int) -> None:
        self.begins[word], self.anywhere[word] = begins, anywhere
        self._judge(word, *stops)

    def _judge(self, word: str, small: int, digit: int, capital: int, other: int, end: int) -> None:
        total = small + digit + capital + other + end
        within = small + digit
        if total < EVIDENCE:
            return
        if total >= 25 * EVIDENCE and end * 100 < total:
            self.inner.add(word)
        if end * 25 >= total:
            self.final.add(word)
            if within * 8 >= total:
                self.both.add(word)
        elif within * 8 >= total:
            self.never.add(word)

    def begins_sentence(self, word: str, default: bool) -> bool:
        """Whether the word is more at home at a sentence's beginning than within one."""
        start, all_ = self.begins.get(word, 0), self.anywhere.get(word, 0)
        if start + all_ < 3:
            return default
        return (start + 0.5) / self.n_begins > (max(0, all_ - start) + 0.5) / self.n_words


class Splitter:
    def __init__(self, known: Knowledge) -> None:
        self.known = known

    def ends(self, text: str) -> list[int]:
        out: list[int] = []
        self._told: dict[str, tuple[int, int]] = {}
        local: dict[str, list[int]] = {}
        spans = list(paragraphs(text))
        for a, b in spans:
            for word, kind, _ in observations(text, a, b):
                seen = local.setdefault(word, [0, 0])
                seen[kind == "end"] += kind in ("small", "digit", "end")
        here = {w for w, (within, end) in local.items() if within and not end}
        for a, b in spans:
            self._paragraph(text, a, b, here, out)
            out.append(b)
        return out

    def _paragraph(self, text: str, a: int, b: int, here: set[str], out: list[int]) -> None:
        start = a
        low_quote = text.find("„", a, b)
        marks = [(m.start(), m.end()) for m in CANDIDATE.finditer(text, a, b)]
        thai = [m.start() for m in THAI_SPACE.finditer(text, a, b) if self._thai_end(text, m.start(), m.end(), b)] if THAI.search(text, a, b) else []
        ends = []
        for s, e in marks:
            german = 0 <= low_quote < e
            end = self._end_at(text, a, b, start, s, e, german, here)
            if end and end < b:
                ends.append(end)
                start = end
        out.extend(sorted({*ends, *thai}) if thai else ends)

    @staticmethod
    def _thai_end(text: str, s: int, e: int, b: int) -> bool:
        if e >= b:
            return False
        before, after = text[s - 1], text[e]
        return not (before.isdigit() or after.isdigit() or before == "ๆ" or before in OPENERS or after in CLOSERS and after not in OPENERS)

    def _end_at(self, text: str, a: int, b: int, start: int, s: int, e: int, german: bool, here: set[str]) -> int:
        """The sentence's end at the candidate text[s:e], or 0 if it ends none."""
        stops_end = s
        while stops_end < e and text[stops_end] in STOPS:
            stops_end += 1
        stops, closing = text[s:stops_end], text[stops_end:e]
        if "“" in closing and not german:  # an opening quote that follows at once
            e = stops_end + closing.index("“")
            closing = closing[: closing.index("“")]
        if closing and closing[-1] in "\"'" and text.count(closing[-1], a, e) % 2:
            e -= 1
            closing = closing[:-1]
        if stops == ";" and not (s > a and GREEK.match(text, s - 1)):
            return 0
        if ";" in stops and stops != ";":
            return 0
        if s == start:  # nothing before it
            return 0
        if e >= b:
            return b
        nxt = e
        while nxt < b and text[nxt].isspace():
            nxt += 1
        space, c = nxt > e, text[nxt]
        before = text[s - 1]
        wide = stops[-1] in WIDE or (stops[-1] == "…" and bool(SPACELESS.match(before)))
        if closing:
            if any(x in ")）]］" for x in closing) and not self._bracket_is_whole(text, start, s, closing):
                return 0
            if any(x not in ")）]］" for x in closing):
                if c in OPENERS and c not in "\"'":
                    return e
                if c.islower() or c in ",，、;:":
                    return 0
                if c.isupper():
                    return e
                if c.isdigit():
                    return 0 if not wide and stops[-1] in "!?" else e
                if stops[-1] in "!?！？؟":
                    return 0
                return 0 if text.startswith(("と", "って"), nxt) else e
            return 0 if c.islower() else e
        if wide:
            return e
        if not space:
            if stops[-1] in FULL_STOP_ALWAYS:
                return 0 if c in ",;:" else e
            if c in OPENERS and c not in "\"'" and before not in " " and stops[-1] in "!?":
                return e
            # a missing space: letters, a stop, a capital and more letters
            if c.isupper() and before.isalpha() and before.islower() and s - 2 >= a and text[s - 2].isalpha() and nxt + 1 <= b:
                w = LAST_WORD.match(text, max(a, s - 24), s)
                return 0 if w and (w[0] in here or w[0] in self.known.never) else e
            return 0
        if c in ",;:،؛–—-" or (c in CLOSERS and c not in OPENERS):
            return 0
        if stops[-1] == "…" or len(stops) >= 2 and set(stops) <= {".", "।"}:
            return e if self._after_ellipsis(text, a, b, s, nxt, c) else 0
        if stops[-1] in FULL_STOP_ALWAYS or stops[-1] in "!?" or stops == ";":
            return 0 if c.islower() else e
        return e if self._after_full_stop(text, a, b, start, s, nxt, c, here) else 0

    def _bracket_is_whole(self, text: str, start: int, s: int, closing: str) -> bool:
        """Whether the bracket closed here was opened where the sentence began."""
        last = next(x for x in reversed(closing) if x in ")）]］")
        opening = {")": "(", "）": "（", "]": "[", "］": "［"}[last]
        at = text.rfind(opening, start, s)
        return at >= 0 and not text[start:at].strip()

    def _after_ellipsis(self, text: str, a: int, b: int, s: int, nxt: int, c: str) -> bool:
        if text[s - 1].isspace():  # spaced on both sides: an omission within the sentence
            return False
        if c.islower():
            return False
        if c in OPENERS:
            return True
        m = NEXT_WORD.match(text, nxt, b)
        return self.known.begins_sentence(m[0], not CASELESS.match(c)) if m else not c.isdigit()

    def _after_full_stop(self, text: str, a: int, b: int, start: int, s: int, nxt: int, c: str, here: set[str]) -> bool:
        if c.islower():
            return False
        m = LAST_WORD.match(text, max(a, s - 40), s)
        if not m:
            return not c.isdigit() or not text[s - 1].isalnum()
        word = m[0]
        if word.isdigit():  # a number: an ordinal or a list's number if the sentence has nothing else yet
            return bool(text[start : m.start()].strip(" (\n\t"))
        if CASELESS.match(word[0]) and "ऀ" <= word[0] <= "෿":
            return False  # these scripts end sentences with dandas
        if len(word) == 1 and not c.isdigit() and (word.isupper() or CASELESS.match(word)) and word not in self.known.final:
            return False  # an initial
        if CHAIN.match(text, nxt, b) and word not in self.known.final:
            return False  # an abbreviation of several parts, or initials
        if word in self.known.never or (word in here and word not in self.known.final):
            return c.isupper() and word not in self.known.inner and self._is_name(text, nxt, b) is False
        if word in self.known.both and c.isupper():
            return not self._is_name(text, nxt, b)
        if word in self.known.final or not c.isdigit():
            return True
        return len(word) > 3

    def _is_name(self, text: str, nxt: int, b: int) -> bool | None:
        """Whether the capitalised word at nxt is a proper name rather than a common word that begins a sentence; None if neither the document nor the corpus tells.

        In the document a word in small letters is a common one, and a capital within a sentence a name; the more frequent counts.
        """
        m = NEXT_WORD.match(text, nxt, b)
        if not m:  # a capital that is no letter, as a Roman numeral's sign
            return None
        word = m[0]
        small, within = self._evidence(text, word)
        if small != within:
            return within > small
        small, capital = self.known.anywhere.get(word.lower(), 0), self.known.anywhere.get(word, 0)
        if small + capital < EVIDENCE or small == capital:
            return None
        return capital > small

    def _evidence(self, text: str, word: str) -> tuple[int, int]:
        """How often the document has the word in small letters, and with its capital where no sentence can begin: after a word, a number or a comma."""
        if word not in self._told:
            small, low = 0, word.lower()
            if low != word:
                small = sum(1 for _ in _occurrences(text, low))
            within = sum(1 for at in _occurrences(text, word) if WITHIN.search(text, max(0, at - 8), at))
            self._told[word] = small, within
        return self._told[word]


def _asked(text: str, a: int, b: int) -> Iterator[str]:
    """The words whose counts may decide about text[a:b], besides those of observations."""
    for m in RUN.finditer(text, a, b):
        s, nxt = m.span()
        while nxt < b and text[nxt].isspace():
            nxt += 1
        for back in (24, 40):
            if w := LAST_WORD.match(text, max(a, s - back), s):
                yield w[0]
        if w := NEXT_WORD.match(text, nxt, b):
            yield w[0]
            yield w[0].lower()


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts (what, word) with bucket -1, and the words that each bucket asks about."""
    tally, asks = Tally(), Tally()

    def counted(n: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.int32()), pa.array([k[1] for k in n], pa.string()), pa.array([-1] * len(n), pa.int32()), pa.array(list(n.values()), pa.int64())], _COUNTED)

    def asked(n: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([-1] * len(n), pa.int32()), pa.array([k[1] for k in n], pa.string()), pa.array([k[0] for k in n], pa.int32()), pa.array([0] * len(n), pa.int64())], _COUNTED)

    begins, anywhere = WHAT.index("begins"), WHAT.index("anywhere")
    for batch in slices(batches, "text"):
        for text, bucket in zip(batch.column("text").to_pylist(), batch.column("bucket").to_pylist(), strict=True):
            words = set()
            for a, b in paragraphs(text):
                for word, kind, nxt in observations(text, a, b):
                    tally.add((KINDS.index(kind), word))
                    if kind not in ("small", "end"):
                        words.add(word)
                        if kind == "capital" and (w := NEXT_WORD.match(text, nxt, b)):
                            words.update((w[0], w[0].lower()))
                        if len(word) == 24:  # cut short
                            words.update(w[0] for w in LONG_WORD.finditer(text, a, b))
                words.update(_asked(text, a, b))
                if (m := NEXT_WORD.match(text, a, b)) and text[b - 1] in STOPS:
                    tally.add((begins, m[0]))
            for word in words:
                asks.add((bucket, word))
        codes, distinct, _ = words_of(batch.column("text"))
        for k, n in zip(distinct, pa.array(codes).value_counts().field(1).to_pylist() if len(codes) else [], strict=False):
            if k.isalpha() or NEXT_WORD.fullmatch(k):
                tally.add((anywhere, k), n)
        if tally.full():
            yield from tally.drain(counted)
        if asks.full():
            yield from asks.drain(asked)
    yield from tally.drain(counted)
    yield from asks.drain(asked)


def _with_knowledge(documents: DataFrame) -> tuple[DataFrame, int, int]:
    """Documents (bucket, told false, doc_id, text) and, before each bucket's, the counts of the words it asks about (told true, text the word); the totals of begins and anywhere.

    All counts are kept and joined by word, so nothing of the corpus goes to the driver but the totals, and to a task but its buckets' words.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text <> ''")
    n = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET))
    docs = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    sums = [F.sum(F.when(F.col("what") == i, F.col("n")).otherwise(0)).alias(k) for i, k in enumerate(WHAT)]
    seen = cut(docs.select("text", "bucket").mapInArrow(_gather, "what int, word string, bucket int, n long").groupBy("word", "bucket").agg(*sums))
    counts, asks = seen.filter("bucket < 0").drop("bucket"), seen.filter("bucket >= 0").select("word", "bucket")
    totals = counts.agg(F.sum("begins"), F.sum("anywhere")).first()
    enough = counts.filter(" + ".join(f"`{k}`" for k in KINDS) + f" >= {EVIDENCE} OR begins + anywhere >= {EVIDENCE}")
    told = asks.join(enough, "word").select("bucket", F.lit(True).alias("told"), F.lit(None).cast("long").alias("doc_id"), F.col("word").alias("text"), *WHAT)
    both = told.unionByName(docs.withColumn("told", F.lit(False)), allowMissingColumns=True)
    return both.repartition("bucket").sortWithinPartitions("bucket", F.desc("told")), totals[0] or 0, totals[1] or 0


def _split(documents: DataFrame, make: Callable[[str, list[int]], list], schema: str, types: list[pa.DataType]) -> DataFrame:
    """make's rows for each text and its sentences' ends, after doc_id."""
    rows_of, n_begins, n_words = _with_knowledge(documents)
    names = [c.split()[0] for c in schema.split(", ")]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, None
        for batch in slices(batches, "text"):
            rows, out = [], []
            counts = [batch.column(k).to_pylist() for k in WHAT]
            for i, (bucket, told, text) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("bucket", "told", "text")), strict=True)):
                if bucket != at:
                    at, known = bucket, Knowledge({}, {}, {}, n_begins, n_words)
                if told:
                    *stops, begins, anywhere = (c[i] for c in counts)
                    known.learn(text, stops, begins, anywhere)
                else:
                    found = make(text, Splitter(known).ends(text))
                    out += found
                    rows += [i] * len(found)
            columns = zip(*out, strict=True) if out else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())).cast(pa.int64()), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names)

    return rows_of.mapInArrow(split, schema)


def sentence_ends(documents: DataFrame) -> DataFrame:
    """(doc_id, end_pos), a row for each sentence."""
    return _split(documents, lambda text, ends: [(e,) for e in ends], "doc_id long, end_pos int", [pa.int32()])


def sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, sentence_no, sentence): each document's sentences in order, line wraps as spaces."""

    def make(text: str, ends: list[int]) -> list[tuple[int, str]]:
        return [(k, " ".join(text[a:b].split())) for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False))]

    return _split(documents, make, "doc_id long, sentence_no int, sentence string", [pa.int32(), pa.string()])
