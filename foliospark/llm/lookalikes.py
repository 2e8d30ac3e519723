"""Text that looks the same but differs in its characters: find such lines and bring them to one form.

Union-find joins into one class whatever looks alike: a code point and its compatibility form, a base letter with a
combining accent and the composed letter, letters of Latin, Greek and Cyrillic drawn alike (given as pairs), and spaces; invisible characters
are in the class of the empty string. Classes are transitive. A class is represented, for each script, by the member most
frequent in the corpus, and a multi-pattern automaton rewrites members by representatives, longest first from the left.
Letters are exchanged across scripts only within a word that mixes scripts; the script of its letters without a look-alike
decides, else the more frequent one in the word, else in the line.

Defined results: null stays null, an empty text empty; hyphens at a line end, punctuation (full-width or not), symbols, and
words wholly in one script are left alone; repeated rows give one found line; other columns pass through.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.arrow import by_row, code_points, slices

# Pairs of letters of two scripts that are drawn alike.
ALIKE = (
    "aа", "aα", "eе", "oо", "oο", "pр", "pρ", "cс", "cϲ", "yу", "yγ", "xх", "xχ", "iі", "iι", "jј", "jϳ", "sѕ", "vν", "vѵ", "uυ", "hһ", "dԁ", "qԛ",
    "wԝ", "wω", "kк", "kκ", "nη", "AА", "AΑ", "BВ", "BΒ", "EЕ", "EΕ", "KК", "KΚ", "MМ", "MΜ", "HН", "HΗ", "OО", "OΟ", "PР", "PΡ", "CС", "CϹ", "TТ",
    "TΤ", "XХ", "XΧ", "IІ", "IΙ", "IӀ", "JЈ", "JͿ", "SЅ", "YУ", "YΥ", "YҮ", "ZΖ", "NΝ", "GԌ", "ГΓ", "ПΠ", "ФΦ",
)
# Characters that show nothing and, as ranges, where they lie.
INVISIBLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE01EF))
SPACES = ((0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
FORMS = ("<wide>", "<narrow>", "<font>", "<circle>", "<initial>", "<medial>", "<final>", "<isolated>")
HIDDEN, SPACE, ACCENT, FORM, LATIN, GREEK, CYRILLIC = 1, 2, 4, 8, 16, 32, 64
SCRIPTS = {"LATIN": LATIN, "GREEK": GREEK, "CYRILLIC": CYRILLIC}
WORD = regex.compile(r"[\p{L}\p{M}]+")
LINE_END = regex.compile(r"­+$")


def _script(c: str) -> int:
    return SCRIPTS.get(unicodedata.name(c, "").split(" ")[0], 0) if c.isalpha() else 0


def _is_form(c: str) -> bool:
    """A letter or digit in another width, style, ligature, presentation or radical form."""
    kind, _, rest = unicodedata.decomposition(c).partition(" ")
    o = ord(c)
    if kind in FORMS:
        return unicodedata.normalize("NFKC", c)[0].isalnum() or c in "ｰﾞﾟ" or (unicodedata.category(c)[0] == "L")
    return kind == "<compat>" and (0xFB00 <= o <= 0xFB4F or 0x2E80 <= o <= 0x2FDF or 0x132 <= o <= 0x133 or 0x1C4 <= o <= 0x1CC)


@lru_cache(1)
def flags() -> np.ndarray:
    """For every code point, what is to be seen about it."""
    out = np.zeros(0x110000, np.uint8)
    for ranges, flag in ((INVISIBLE, HIDDEN), (SPACES, SPACE), (((0x300, 0x36F), (0x3099, 0x309A), (0x653, 0x655)), ACCENT)):
        for a, b in ranges:
            out[a : b + 1] = flag
    for o in (*range(0xA0, 0x3400), *range(0xA640, 0xA720), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)):
        if not out[o] and _is_form(chr(o)):
            out[o] |= FORM
    for o in (*range(0x41, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        out[o] |= _script(chr(o))
    return out


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (nxt := self.up.setdefault(root, root)) != root:
            root = nxt
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def union(self, a: str, b: str) -> None:
        self.up[self.find(b)] = self.find(a)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in sorted(self.up):
            out.setdefault(self.find(x), []).append(x)
        return out


def plain_forms(counts: dict[int, int]) -> dict[str, str]:
    """Compatibility forms, decomposed accents, spaces and invisible characters with what they stand for, by classes over strings.

    A class is represented by its most frequent member in the corpus that is no form itself; a string of several code points is as frequent as its rarest one.
    """
    classes = Classes()
    table = flags()
    for o in np.flatnonzero(table & FORM):
        classes.union(unicodedata.normalize("NFKC", chr(o)), chr(o))
    for o in np.flatnonzero(table & SPACE):
        classes.union(" ", chr(o))
    for o in np.flatnonzero(table & HIDDEN):
        classes.union("", chr(o))
    for o in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000), *range(0x3040, 0x3100)):
        parts = unicodedata.normalize("NFD", chr(o))
        if len(parts) > 1 and unicodedata.normalize("NFC", parts) == chr(o):
            classes.union(chr(o), parts)
    best = {}
    for root, members in classes.members().items():
        plain = [x for x in members if not any(table[ord(c)] & (FORM | SPACE | HIDDEN) for c in x)]
        plain = [x for x in plain if not any(table[ord(c)] & ACCENT for c in x)] or plain
        best[root] = max(plain, key=lambda x: (min((counts.get(ord(c), 0) for c in x), default=0), -len(x), x))
    return {x: best[classes.find(x)] for x in classes.up if x and x != best[classes.find(x)]}


def letter_classes(counts: dict[int, int]) -> dict[int, dict[str, str]]:
    """For each script, its representative of each letter of the other scripts: the member of the class most frequent in the corpus."""
    classes = Classes()
    for row in ALIKE:
        for c in row[1:]:
            classes.union(row[0], c)
    out: dict[int, dict[str, str]] = {s: {} for s in SCRIPTS.values()}
    for all_ in classes.members().values():
        for s in out:
            own = [c for c in all_ if _script(c) == s]
            if own:
                best = max(own, key=lambda c: (counts.get(ord(c), 0), c))
                out[s] |= {c: best for c in all_ if _script(c) != s}
    return out


def _automaton(patterns: dict[str, str]) -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for k, v in patterns.items():
        auto.add_word(k, (len(k), v))
    auto.make_automaton()
    return auto


class Rewriter:
    def __init__(self, counts: dict[int, int]) -> None:
        self.plain = _automaton(plain_forms(counts))
        self.letters = letter_classes(counts)
        self.autos = {s: _automaton(m) for s, m in self.letters.items()}
        self.shared = {c for m in self.letters.values() for c in m}

    @staticmethod
    def greedy(auto: ahocorasick.Automaton, text: str) -> str:
        """Longest matches from the left."""
        out, at = [], 0
        for end, (n, to) in auto.iter_long(text):
            out += (text[at : end - n + 1], to)
            at = end + 1
        return "".join((*out, text[at:])) if out else text

    def script(self, word: str, line: str) -> int:
        """The script a word with letters of several belongs to; 0 if it is in one or no letter has a look-alike."""
        of = [(s, c) for c in word if (s := _script(unicodedata.normalize("NFD", c)[0]))]
        if len({s for s, _ in of}) < 2:
            return 0
        known = {s for s, _ in of}
        firm = [s for s, c in of if not any(unicodedata.normalize("NFD", c)[0] in self.letters[x] for x in known - {s})]
        votes = firm or [s for s, _ in of]
        most = max(votes.count(s) for s in set(votes))
        best = [s for s in sorted(set(votes)) if votes.count(s) == most]
        if len(best) > 1:
            around = [_script(c) for c in line]
            best.sort(key=lambda s: -around.count(s))
        return best[0] if any(s != best[0] and unicodedata.normalize("NFD", c)[0] in self.letters[best[0]] for s, c in of) else 0

    def line(self, line: str) -> tuple[str, bool]:
        """The line in its one form, and whether it is a case."""
        tail = m[0] if (m := LINE_END.search(line)) else ""
        body = line[: len(line) - len(tail)] if tail else line
        out = unicodedata.normalize("NFC", self.greedy(self.plain, body)) if any(flags()[ord(c)] & 15 for c in body) else body

        def one_script(m: regex.Match) -> str:
            s = self.script(m[0], out)
            return unicodedata.normalize("NFC", self.greedy(self.autos[s], unicodedata.normalize("NFD", m[0]))) if s else m[0]

        final = WORD.sub(one_script, out)
        return final + tail, final != body

    def text(self, text: str) -> str:
        return "\n".join(self.line(x)[0] for x in text.split("\n"))


def code_point_counts(df: DataFrame, column: str) -> dict[int, int]:
    """How often each code point occurs. At most 1,114,112 rows come to the driver, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in slices(batches, "t"):
            points, _ = code_points([x for x in batch.column("t").to_pylist() if x])
            n = np.bincount(points, minlength=1)
            total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["c", "n"])

    rows = df.select(F.col(column).alias("t")).mapInArrow(count, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).toPandas()
    return dict(zip(rows["c"].tolist(), rows["n"].tolist(), strict=True))


def _suspects(texts: list[str]) -> np.ndarray:
    """Rows with a character or a mixture of scripts worth a look."""
    points, offsets = code_points(texts)
    seen = by_row(np.bitwise_or, flags()[points], offsets)
    scripts = seen & (LATIN | GREEK | CYRILLIC)
    return np.flatnonzero((seen & 15).astype(bool) | (scripts & (scripts - 1)).astype(bool))


def canonical_lines(lines: DataFrame, column: str = "text", counts: dict[int, int] | None = None) -> DataFrame:
    """The lines with `column` in its one form, and is_case: whether it held something to be replaced."""
    known = code_point_counts(lines, column) if counts is None else counts
    wanted = {ord(c) for pair in ALIKE for c in pair} | set(np.flatnonzero(flags() & 15).tolist()) | {ord(c) for o in np.flatnonzero(flags() & FORM) for c in unicodedata.normalize("NFKC", chr(o))} | {0x20}
    known = {o: n for o, n in known.items() if o in wanted}
    schema = T.StructType([f for f in lines.schema.fields if f.name != "is_case"] + [T.StructField("is_case", T.BooleanType())])
    names = [f.name for f in schema.fields[:-1]]

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewriter = Rewriter(known)
        for batch in slices(batches, column):
            texts = batch.column(column).to_pylist()
            case = np.zeros(len(texts), bool)
            for i in _suspects([t or "" for t in texts]):
                parts = [rewriter.line(x) for x in texts[i].split("\n")]
                case[i] = any(x for _, x in parts)
                texts[i] = "\n".join(x for x, _ in parts)
            columns = [pa.array(texts, pa.string()) if n == column else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(case)], [*names, "is_case"])

    return lines.select(*names).mapInArrow(rewrite, schema)


def look_alike_lines(lines: DataFrame) -> DataFrame:
    """(block_id, line_no), distinct: lines that hold other characters than they seem to."""
    found = canonical_lines(lines.select("block_id", "line_no", "text")).filter("is_case")
    return found.select("block_id", F.col("line_no").cast("int").alias("line_no")).distinct()
