import itertools
import os
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import encoding, language, leaks, lookalikes, mixing, queries, scans, sentences, sitelines, splitting

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
PAGE = "page_id long, doc_id long, page_index int, native_text string, native_html string, text string, is_html string"
BLOCK = "block_id long, doc_id long, page_index int, block_order int, type string, x0 double, y0 double, x1 double, y1 double, text string, piece_no string, key string"
META = "doc_id long, language string, source string, mode string"


def block(i, doc=1, page=0, kind="text", y0=300.0, text="x"):
    return (i, doc, page, 0, kind, 100.0, y0, 900.0, None if y0 is None else y0 + 28, text, "extra", "extra")


# --- 1

PROSE = ["Die Mühle über der Brücke gehörte dem Händler.", "Später führte die Straße für größere Körbe zur Mühle.", "Le château près de la rivière était très élevé.", "Река была старая и мост стоял над рекой.", "水车的磨坊在河流旁边，木匠买了木材。", "古い村の水車と新しい橋。"] * 12
DAMAGED = [
    ("古い村", "cp932", "cp1252"), ("Mühle", "utf-8", "latin-1"), ("für größere", "utf-8", "cp1252"), ("château", "utf-8", "mac-roman"), ("Später führte", "utf-8", "cp1250"), ("Straße", "utf-8", "cp437"), ("Река была", "utf-8", "cp1252"), ("磨坊在河流", "gb18030", "latin-1"),
]


def test_encodings_restored(spark):
    def broken(t, right, used):
        return "".join(encoding.narrow(used)[b] for b in t.encode(right))

    rows = [(i, 1, i, t, None, "a", "b") for i, t in enumerate(PROSE)]
    rows += [(1000 + i, 1, i, "Hier " + broken(t, r, u) + " dort", None, None, None) for i, (t, r, u) in enumerate(DAMAGED)]
    rows += [(2000, 1, 0, None, None, None, None), (2001, None, None, "", "", None, None), (2002, 1, 1, None, "<p>Die M&uuml;hle &amp; 5 °C †</p>", None, None), (2003, 1, 1, "Mü" + "�� und K" + "�rbe", None, None, None), (None, 1, 1, "plain", None, None, None)]
    pages = spark.createDataFrame(rows + rows[60:62], PAGE)
    found = encoding.garbled_fields(pages).collect()
    assert {r.page_id for r in found} == {*(1000 + i for i in range(len(DAMAGED))), 2003} and len(found) == len(DAMAGED) + 1
    fixed = {r.page_id: r.restored for r in encoding.restored_cases(encoding.fields(pages)).collect()}
    assert [fixed[1000 + i] for i in range(len(DAMAGED))] == [f"Hier {t} dort" for t, _, _ in DAMAGED]
    assert encoding.garbled_fields(pages.limit(0)).count() == 0


def _letters(words):
    grams = np.zeros((3, 1 << encoding.BITS))
    for k, slots in enumerate(encoding.gram_slots(words)[:3]):
        np.add.at(grams[k], slots, 50)
    return encoding.Letters(grams, {c: 50 for w in words for c in w}, 50.0 * len(words))


def test_lost_bytes():
    lattices = encoding.Lattices(_letters(["mühle", "über", "für", "körbe"]))
    assert "mühle" in lattices.readings("m��hle") and "mühle" in lattices.readings("m�hle")
    assert not lattices.readings("��") and not lattices.readings("m" + "�" * 9 + "hle")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("müh"), min_size=1, max_size=5), st.data())
def test_best_path_is_the_best_of_all(word, data):
    letters = _letters(["mühle", "hüm", "mmh", "üh"])
    edges = [[(1, np.array(sorted({ord(c), *data.draw(st.lists(st.sampled_from([ord(x) for x in "mühle"]), max_size=3))})))] for c in word]

    def total(path):
        p = [2, 2, *path, 3]
        return sum(float(letters.step(*(np.array([x]) for x in p[i : i + 3]))[0]) for i in range(len(p) - 2))

    best = max(total(path) for path in itertools.product(*(e[0][1].tolist() for e in edges)))
    assert total([ord(c) for c in encoding.best_path(letters, edges)]) == pytest.approx(best)


def test_one_channel_for_a_passage():
    enter = np.array([8.0, 2.0])
    gains = np.array([[5, 5, -1, 5, -np.inf, -9], [3, -np.inf, 0, 0, 0, 0]], float)
    assert encoding.passages(gains, enter) == [0, 0, 0, 0, -1, -1]
    assert encoding.passages(gains[:, :1], enter) == [1]


def test_markup_is_kept(spark):
    rows = [(i, 1, i, t, None, "a", "b") for i, t in enumerate(PROSE)]
    rows += [(1000, 1, 0, None, "<p class='Ã¼'>Die <b>M&Atilde;&frac14;hle</b> &amp; die BrÃ¼cke</p>", "a", "b")]
    rows += [(1001, 1, 0, "Die Br�cke f�r die M�hle", None, "a", "b"), (1002, 1, 0, "page?id=1 or what?so", None, None, None)]
    got = {r.page_id: (r.restored, r.is_case) for r in encoding.restore(encoding.fields(spark.createDataFrame(rows, PAGE))).collect()}
    assert got[1000] == ("<p class='Ã¼'>Die <b>Mühle</b> &amp; die Brücke</p>", True)
    assert got[1001] == ("Die Brücke für die Mühle", True) and not got[1002][1]
    assert len(got) == len(rows) and not any(c for i, (_, c) in got.items() if i < 1000)


# --- 2


def test_lookalikes(spark):
    cases = {0: ("harb​our", "harbour"), 1: ("the\xa0mill", "the mill"), 2: ("Brücke", "Brücke"), 3: ("ｍｉｌｌ", "mill"), 4: ("aﬄuent", "affluent"), 5: ("lеdgеr", "ledger"), 6: ("яpмapкa", "ярмарка"), 7: ("⽊匠", "木匠"), 8: ("\U0001d42d\U0001d421\U0001d41e", "the"), 9: ("ｶﾞﾗｽ", "ガラス")}
    clean = ["Brücke", "река", "market, “quoted” – 5 °C", "水车，木匠。", "break\xad", "", None, "a½b m²", "μέλι", "कि ताब"]
    rows = [(i, 0, t, True) for i, (t, _) in cases.items()] + [(100 + i, 0, t, None) for i, t in enumerate(clean)] + [(0, 0, cases[0][0], True), (None, None, "x", None)]
    lines = spark.createDataFrame(rows, "block_id long, line_no int, text string, is_case boolean")
    found = lookalikes.look_alike_lines(lines).collect()
    assert {r.block_id for r in found} == set(cases) and len(found) == len(cases)
    texts = {r.block_id: r.text for r in lookalikes.canonical_lines(lines).collect()}
    assert {i: texts[i] for i in cases} == {i: w for i, (_, w) in cases.items()}
    assert [texts[100 + i] for i in range(len(clean))] == clean
    assert lookalikes.look_alike_lines(lines.limit(0)).count() == 0


def test_classes_are_transitive():
    c = lookalikes.Classes()
    for a, b in (("a", "b"), ("c", "d"), ("b", "c")):
        c.union(a, b)
    assert c.find("a") == c.find("d") and len(c.members()) == 1


# --- 3


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n,́", max_size=400), st.integers(1, 60), st.integers(0, 80))
def test_pieces_cover(text, limit, overlap):
    parts = splitting.split_text(text, limit, overlap)
    lap = min(overlap, (limit - 1) // 2)
    assert "".join(text[n:b] for _, n, b in parts) == text
    assert all(b - a <= limit for a, _, b in parts)
    assert all(n - a == min(lap, n) for a, n, _ in parts[1:])


def test_natural_cuts(spark):
    text = ("A sentence of some words stands here. " * 40).strip() + "\n\n" + ("Another sentence follows after it. " * 40).strip()
    blocks = spark.createDataFrame([(1, "text", text, 7, "k"), (2, "text", "short", 7, "k"), (3, "none", text, 7, "k"), (4, None, None, None, None), (5, "text", "", 7, "k"), (1, "text", text, 7, "k"), (6, "text", "x" * 100_000, 7, "k")], "block_id long, type string, text string, n_pieces int, _kind string")
    limits = spark.createDataFrame([("text", 1000, 50), ("text", 2000, None), ("list", None, 5)], "type string, max_chars int, overlap_chars int")
    assert sorted(r.block_id for r in splitting.oversized_blocks(blocks, limits).collect()) == [1, 6]
    got = splitting.split_oversized(blocks.filter("block_id = 1").limit(1), limits).orderBy("piece_no").collect()
    assert all(len(r.text) <= 1000 for r in got) and all(r.text.rstrip()[-1] in ".!" for r in got)
    assert splitting.split_oversized(blocks.limit(0), limits).count() == 0
    assert splitting.split_oversized(blocks, limits.limit(0)).filter("n_pieces > 1").count() == 0


# --- 4


def _texts(seed):
    words = {"en": "the mill and river stood by old harbour with bridge which was timber", "de": "die mühle und der fluss mit brücke über straße nicht für händler", "ru": "река и старый мост не был над мельница под деревня", "el": "και το ποτάμι με γέφυρα στο χωριό για μύλος"}
    rng = random.Random(seed)
    return [(lang, " ".join(rng.choices(w.split(), k=40))) for lang, w in words.items() for _ in range(20)]


def test_languages(spark):
    texts = _texts(1)
    labels = [lang for lang, _ in texts]
    labels[0], labels[20], labels[40], labels[41], labels[60] = "de", None, "xx", "rus", "Greek"
    meta = spark.createDataFrame([(i, x, "s", "ocr") for i, x in enumerate(labels)] + [(0, "de", "s", "ocr"), (900, "en", "s", "native"), (901, None, None, None)], META)
    rows = [block(i * 10 + k, i, text=t) for i, (_, t) in enumerate(texts) for k in range(3)]
    rows += [block(5005, 5, text=texts[25][1]), block(5006, 5, text=None), block(5007, 5, text="123"), block(5008, 901, text="")]
    blocks = spark.createDataFrame(rows, BLOCK)
    pages = spark.createDataFrame([(1, 900, 0, None, "<p>" + texts[3][1] + "</p>", None, None), (2, 901, 0, None, None, None, None)], PAGE)
    got = {tuple(r) for r in language.language_faults(meta, blocks, pages).collect()}
    assert got == {(0, -1, "en"), (20, -1, "de"), (40, -1, "ru"), (5, 5005, "de")}
    docs, _ = language.languages(meta, blocks, pages)
    assert all(0.5 < r.confidence <= 1 for r in docs.collect())
    assert language.language_faults(meta.limit(0), blocks.limit(0), pages.limit(0)).count() == 0


def test_held_out_accuracy():
    texts = _texts(2)
    model = language.train([t for _, t in texts], [lang for lang, _ in texts], list(range(len(texts))))
    fresh = _texts(3)
    p, _ = model.scores(pa.array([t[:150] for _, t in fresh]))
    assert np.mean([model.languages[i] == lang for i, (lang, _) in zip(p.argmax(axis=1), fresh, strict=True)]) >= 0.98


def test_calibration():
    assert language.calibration_error(np.array([0.9] * 10), np.array([True] * 9 + [False])) == pytest.approx(0)
    assert language.calibration_error(np.array([0.95] * 10), np.array([False] * 10)) == pytest.approx(0.95)
    texts = _texts(5)
    model = language.train([t for _, t in texts], [lang for lang, _ in texts], list(range(len(texts))))
    assert model.accuracy == 1 and model.calibration_error < 0.1


def test_labels(spark):
    rows = [("en-GB", "en"), ("ENG", "en"), ("German", "de"), ("de_AT", "de"), ("und", None), ("", None), (None, None), ("zho", "zh")]
    got = spark.createDataFrame(rows, "l string, w string").select(language.two_letter(lookalikes.F.col("l")).alias("g"), "w").collect()
    assert all(r.g == r.w for r in got)


# --- 5


def test_scans(spark):
    body = "The surveyor carried the ledger to the harbour and the granary beside the orchard was quiet that winter"
    rows = [block(i, 1, i % 40, text=body) for i in range(60)]
    rows += [block(500, text="the sur-\nveyor came"), block(501, text="a half-\ntimbered barn"), block(502, text="half-timbered and half-timbered"), block(503, text="the survcyor in 18S6"), block(504, text="the led9er"), block(505, text=None), block(506, text=""), block(507, kind=None, text="plain words", y0=None), block(508, kind="table", text="survcyor")]
    rows += [block(600 + p, 2, p, "text", 50.0, f"THE OLD MlLL   {p + 9}" if p == 1 else f"THE OLD MILL   {p + 9}") for p in range(4)]
    rows += [block(509, text="thesurveyorcarriedtheledger" * 400), block(510, text="thesurveyorcarr1edtheledger" * 400)]
    rows += [block(700 + p, 2, p, "text", 2270.0, f"– {p + 9} –") for p in range(4)] + [block(800, 2, 0, "text", 50.0, "Stands only once here")]
    blocks = spark.createDataFrame(rows + rows[60:62], BLOCK)
    meta = spark.createDataFrame([(1, "en", "s", "ocr"), (2, "en", None, "ocr"), (None, None, None, None)], META)
    got = sorted(tuple(r) for r in scans.scan_noise(blocks, meta).collect())
    assert got == sorted(tuple(r) for r in scans.scan_noise(blocks, meta, most_sent=1).collect())
    assert got == sorted([(500, "hyphenation"), (503, "misread"), (504, "misread"), *((600 + p, "running_head") for p in range(4)), *((700 + p, "page_number") for p in range(4))])
    fixed = {r.block_id: r.text for r in scans.repaired(blocks, meta).collect()}
    assert (fixed[500], fixed[501], fixed[503], fixed[504]) == ("the surveyor came", "a half-timbered barn", "the surveyor in 1856", "the ledger") and 600 not in fixed and 700 not in fixed and fixed[508] == "survcyor"
    assert scans.scan_noise(blocks.limit(0), meta).count() == 0


def test_repair_goes_by_tokens(spark):
    """A correction doesn't reach into other words, capitals stay, and lines are corrected as blocks are."""
    body = "the man was outbeat by the surveyor and THE SURVEYOR was there when the beat of the drum was heard by the men"
    rows = [block(i, 1, i % 40, text=body) for i in range(60)] + [block(500, text="tbe man was outbeat"), block(501, text="TBE MAN"), block(502, text="Tbe  man\nwell-kept!"), block(503, kind="caption", text="tbe man"), block(504, text="x"), block(504, text="y")]
    meta = spark.createDataFrame([(1, "en", "s", "ocr")], META)
    blocks = spark.createDataFrame(rows, BLOCK)
    fixed = {(r.block_id, r.text) for r in scans.repaired(blocks, meta).filter("block_id >= 500").collect()}
    assert fixed == {(500, "the man was outbeat"), (501, "THE MAN"), (502, "The man well-kept!"), (503, "tbe man"), (504, "x"), (504, "y")}
    lines = spark.createDataFrame([(500, 0, "tbe man"), (501, 0, "TBE MAN"), (503, 0, "tbe man"), (900, 0, "tbe"), (500, 1, None)], "block_id long, line_no int, text string")
    assert {tuple(r) for r in scans.repaired_lines(lines, blocks).collect()} == {(500, 0, "the man"), (501, 0, "THE MAN"), (503, 0, "tbe man")}
    assert scans.repaired(blocks.limit(0), meta).count() == 0


def test_page_numbers_are_sequences(spark):
    heads = ["CIVIL", "mild", "Vivid", "LIVID", "did", "Vol. mild"]
    rows = [block(i, 1, i, y0=2270.0, text=t) for i, t in enumerate(heads)]
    rows += [block(100 + p, 2, p, y0=2270.0, text=t) for p, t in enumerate(["xi", "xii", "xlii", "xiv", "Page l5", "1S", "l7"])]
    rows += [block(200 + p, 3, p, y0=50.0, text=f"{p + 30}   Из вернулся" if p % 2 else f"Из вернулся   {p + 30}") for p in range(4)]
    rows += [block(300, 4, 0, y0=2270.0, text="– 12 –"), block(301, 4, 1, y0=1000.0, text="13"), block(302, 4, 2, y0=None, text="14"), block(303, 4, 3, y0=2270.0, text="第 15 页"), block(304, 4, 4, y0=2270.0, text="xvi")]
    blocks = spark.createDataFrame(rows, BLOCK)
    assert sorted(r.block_id for r in scans.page_numbers(blocks).collect()) == [100, 101, 102, 103, 104, 105, 106, 300, 303, 304]
    got = {tuple(r) for r in scans.furniture(blocks, spark.createDataFrame([(1, "en", "s", "ocr")], META)).collect()}
    assert {(200 + p, "running_head") for p in range(4)} < got and not {i for i, _ in got} & {*range(6)}
    tall = spark.createDataFrame([(4, 1, 800, 1090)], "doc_id long, page_index int, width int, height int")
    assert 301 in {r.block_id for r in scans.page_numbers(blocks, tall).collect()}


def test_paragraphs_across_pages(spark):
    known = "the weaver and the surveyor carried timber over the bridge to the harbour mill"
    rows = [block(i, 9, i, text=known) for i in range(20)]
    rows += [(500, 1, 0, 0, "text", 100.0, 300.0, 900.0, 320.0, "the weaver and the sur-\nveyor carried timber over the brid-", "e", "e"), (501, 1, 1, 0, "text", 100.0, 300.0, 900.0, 320.0, "ge to the\nharbour mill.", "e", "e"), (502, 1, 1, 1, "text", 100.0, 2270.0, 900.0, 2290.0, "2", "e", "e")]
    blocks = spark.createDataFrame(rows, BLOCK).withColumn("level", lookalikes.F.lit(0)).withColumn("html", lookalikes.F.lit(None).cast("string")).withColumn("image_path", lookalikes.F.lit(None).cast("string"))
    pages = spark.createDataFrame([(d, p, 1654, 2339) for d in (1, 9) for p in range(20)], "doc_id long, page_index int, width int, height int")
    meta = spark.createDataFrame([(1, "en", "s", "ocr")], META)
    got = [r.text for r in scans.paragraphs(blocks, meta, pages).filter("doc_id = 1").collect()]
    assert got == [known + "."]


# --- 6


def test_site_lines(spark):
    notice = "Share this page with a fellow reader {}"
    rows = [block(i, i, text=f"own text number {'x' * i} of this page\n{notice.format(i * 7).upper() if i % 2 else notice.format(i)}") for i in range(12)]
    rows += [block(100 + i, i, text="short line") for i in range(12)] + [block(200, 3, text=None), block(201, None, text=notice.format(1)), block(202, 50, text=notice.format(1)), block(203, 4, text="")]
    blocks = spark.createDataFrame(rows + rows[:1], BLOCK)
    meta = spark.createDataFrame([(i, "en", "s", "ocr") for i in range(12)] + [(0, "en", "s", "ocr"), (50, "en", None, "ocr"), (60, None, None, None)], META)
    for ways in ({}, {"most_listed": 2}, {"most_sent": 0}):
        assert sorted(tuple(r) for r in sitelines.site_line_hits(blocks, meta, **ways).collect()) == [(i, 1) for i in range(12)], ways
    far = blocks.filter("block_id < 12").withColumn("doc_id", lookalikes.F.col("doc_id") * 1_000_003)
    of_far = meta.filter("doc_id < 12").withColumn("doc_id", lookalikes.F.col("doc_id") * 1_000_003)
    kept = sitelines.repeated_lines(far, of_far).collect()
    assert len(kept) == 12 and all(len(r.listed) == 1 and r.bits is None and r.n_docs == 12 for r in kept)
    cleaned = {r.block_id: r.text for r in sitelines.remove_site_lines(blocks, meta).collect()}
    assert cleaned[3] == "own text number xxx of this page" and cleaned[202] == notice.format(1) and cleaned[200] is None
    assert sitelines.site_line_hits(blocks.limit(0), meta).count() == 0 and sitelines.site_line_hits(blocks, meta.limit(0)).count() == 0


# --- 7


def _leaks(docs, items):
    """Brute force over all windows."""
    out = set()
    for d, t in docs:
        w, c = leaks.words(t or ""), "".join(leaks.words(t or ""))
        grams = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        for i, s in items:
            v = leaks.words(s or "")
            if leaks.spaceless(s or ""):
                u = "".join(v)
                hit = any(u[k : k + 24] in c for k in range(len(u) - 23))
            else:
                hit = any(tuple(v[k : k + 12]) in grams for k in range(len(v) - 11))
            if hit:
                out.add((d, i))
    return out


def test_leaks_are_brute_force(spark):
    rng = random.Random(4)
    pool = "alpha beta gamma delta épsilon zeta eta theta iota".split()
    items = [(i, " ".join(rng.choices(pool, k=rng.randint(5, 40)))) for i in range(30)] + [(50, "水车磨坊河流木匠材木桥梁市场港口花园石头道路房间书信测量"), (51, None), (52, ""), (0, "x")]
    docs = []
    for d in range(200):
        text = rng.choices(pool, k=rng.randint(0, 60))
        if d % 3 == 0:
            words = items[rng.randrange(30)][1].split()
            a = rng.randrange(max(1, len(words) - 10))
            text += words[a : a + rng.randint(9, 16)]
        docs.append((d, " ".join(text).upper() if d % 2 else ",\n".join(text)))
    docs += [(900, "前面" + items[30][1][:24] + "后面"), (901, items[30][1][:23]), (902, None), (903, ""), (904, "水 车 磨坊河流木匠材木桥梁。市场港口花园石头道路"), (0, docs[0][1])]
    got = leaks.leaked_items(spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", lookalikes.F.lit(1)), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {tuple(r) for r in got} == _leaks(docs, items) and len(got) == len({tuple(r) for r in got})
    empty = spark.createDataFrame([], "item_id long, text string")
    assert leaks.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), empty).count() == 0


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 100)
    text = " ".join(f"word{i}" for i in range(40))
    items = spark.createDataFrame([(i, " ".join(f"word{k}" for k in range(i, i + 14))) for i in range(5)], "item_id long, text string")
    assert leaks.leaked_items(spark.createDataFrame([(1, text)], "doc_id long, text string"), items).count() == 5


# --- 8


@needs_data
def test_token_counts_are_the_tokenizers():
    import pandas as pd

    texts = pd.read_parquet(f"{SMALL}/documents.parquet").text.tolist() + ["", "  two  spaces ", "a b", "a\n b", None, "x" * 5000]
    encode = mixing._encoding(mixing.TOKENIZER).encode_ordinary
    assert mixing.Counter(mixing.TOKENIZER).counts(pa.array(texts)).tolist() == [len(encode(t or "")) for t in texts]


def test_quotas():
    q = mixing._quotas([("p", "a", 0.5, 1), ("p", "b", 0.5, 2), ("p", "c", 0.0, 9), ("p", "d", -1, 9)], {"a": 100, "b": 1000, "c": 5})
    assert q[("p", "a")] == 100 and q[("p", "b")] == pytest.approx(1005) and q[("p", "c")] == q[("p", "d")] == 0


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, "big" if i % 3 else "small", " ".join(rng.choices(["mill", "river", "stone"], k=30)), 5) for i in range(900)] + [(9000, None, "x", 1), (9001, "big", None, 1), (9002, "big", "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, n_tokens int")
    targets = spark.createDataFrame([("p", "big", 0.4, 3), ("p", "small", 0.6, 2), ("p", "none", 0.1, 2), (None, "big", 1.0, 1)], "profile string, source string, target_share double, max_repeats int")
    got = {r.source: r for r in mixing.actual_shares(docs, targets, block_tokens=300).collect()}
    assert got["big"].actual_share == pytest.approx(0.4, abs=0.03) and got["small"].actual_share == pytest.approx(0.6, abs=0.03) and got["none"].actual_share == 0 and got["small"].times_used <= 2
    own = {r.source: r.actual_share for r in mixing.actual_shares(docs, targets).collect()}
    assert own["big"] == pytest.approx(0.4, abs=0.03) and own["small"] == pytest.approx(0.6, abs=0.03)
    mix = mixing.schedule(docs, targets, block_tokens=300).toPandas()
    assert mix.groupby(["source", "doc_id"]).size().max() <= 2 and mix.groupby(["slot"])["source"].nunique().max() == 1
    assert mixing.actual_shares(docs.limit(0), targets).filter("n_tokens > 0").count() == 0 and mixing.schedule(docs, targets.limit(0)).count() == 0


# --- 9


def test_sentences(spark):
    cases = {
        1: ("Dr. Miller came. He saw 3.5 mills! Did he? Yes.", ["Dr. Miller came.", "He saw 3.5 mills!", "Did he?", "Yes."]),
        2: ("“Who is it?” asked the clerk. It was dark (and cold!) that night.", ["“Who is it?” asked the clerk.", "It was dark (and cold!) that night."]),
        3: ("Heading\n\nText with a\nwrap. More", ["Heading", "Text with a wrap.", "More"]),
        4: ("磨坊在河流。“你好！”木匠说。桥梁。", ["磨坊在河流。", "“你好！”木匠说。", "桥梁。"]),
        5: ("「港だ。」と言う。冬。", ["「港だ。」と言う。", "冬。"]),
        6: ("ข้าวในสวน ตลาดมี 25 เรือ ต่างๆ มา", ["ข้าวในสวน", "ตลาดมี 25 เรือ", "ต่างๆ มา"]),
        7: ("नदी पुल। गाय बैल।", ["नदी पुल।", "गाय बैल।"]),
        8: ("Der Fluss, z. B. Mühlen, war da.Und dann.", ["Der Fluss, z. B. Mühlen, war da.", "Und dann."]),
    }
    known = [(100 + i, f"We met Dr. {n} here. See Dr. 5 of the list. They left with him.") for i, n in enumerate(["Adams", "Baker", "Clark"] * 4)]
    docs = spark.createDataFrame([(i, t, "a") for i, (t, _) in cases.items()] + [(i, t, "b") for i, t in known] + [(50, None, None), (51, "", ""), (52, " \n\n ", ""), (None, "No id.", "")], "doc_id long, text string, end_pos string")
    rows = sentences.sentences(docs).collect()
    for i, (_, want) in cases.items():
        assert [r.sentence for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.sentence_no)] == want
    ends = sentences.sentence_ends(docs).filter("doc_id = 3").collect()
    assert sorted(r.end_pos for r in ends) == [7, 26, 31] and not [r for r in rows if r.doc_id in (50, 51, 52)]
    assert sentences.sentence_ends(docs.limit(0)).count() == 0


def test_sentences_judged_alike_in_large_corpora(spark):
    """Words of few occurrences: an abbreviation with no evidence in its document, and one that opens two paragraphs."""
    known = [(i, "They saw qv. the mill. They saw qv. the bridge.\n\nIt was ach so ach and ach.") for i in range(2)] + [(i, "Ach was.") for i in (2, 3)]
    asked = [(10, "See qv. Miller here. So it was."), (11, "Wait… Ach was it.")]
    want = {10: [20, 31], 11: [5, 17]}
    large = [(20, ("mill. " * 25_000 + "\n\n") * 20)]
    for rows in (known + asked, known + asked + large):
        ends = sentences.sentence_ends(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id IN (10, 11)").collect()
        assert {d: sorted(r.end_pos for r in ends if r.doc_id == d) for d in want} == want


def test_sentences_tell_names_from_common_words(spark):
    """After an abbreviation that may end sentences, by the document, else by the corpus; after a title never."""
    # etc. ends 3 in 100 paragraphs, Dr. none of 160, usw. many
    known = ["We saw etc. the mill and the bridge."] * 97 + ["All of it etc."] * 3 + ["See Dr. 5 of the list and Dr. 6 there."] * 80 + ["Dort usw. der Fluss."] * 6 + ["Alles usw."] * 4 + ["There was barley and barley here. Fenwick came."] * 4
    asked = {
        1000: ("Mills etc. The clerk saw the mill.", ["Mills etc.", "The clerk saw the mill."]),
        1001: ("Mills etc. Miller saw it, as Miller said.", ["Mills etc. Miller saw it, as Miller said."]),
        1002: ("Mills etc. Barley grew.", ["Mills etc.", "Barley grew."]),
        1003: ("Mills etc. Fenwick grew.", ["Mills etc. Fenwick grew."]),
        1004: ("So Dr. Barley met barley growers.", ["So Dr. Barley met barley growers."]),
        1005: ("Dort usw. Mainz lag da, wo Mainz war.", ["Dort usw. Mainz lag da, wo Mainz war."]),
        1006: ("Dort usw. Der Fluss und der Berg.", ["Dort usw.", "Der Fluss und der Berg."]),
    }
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(known)] + [(i, x) for i, (x, _) in asked.items()], "doc_id long, text string")
    rows = sentences.sentences(docs).filter("doc_id >= 1000").collect()
    assert {i: [r.sentence for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.sentence_no)] for i in asked} == {i: want for i, (_, want) in asked.items()}


@needs_data
def test_sentences_ask_for_what_they_look_up(spark):
    class Noted(sentences.Knowledge):
        def begins_sentence(self, word, default):
            looked.add(word)
            return super().begins_sentence(word, default)

    class Words(set):
        def __contains__(self, word):
            looked.add(word)
            return found

    class Counts(dict):
        def get(self, word, default=None):
            looked.add(word)
            return default

    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect() if r.text] + ["w?. A etc!Next ab.Cd x…. B " + "l" * 30 + ". C " + "m" * 50 + ".”“ D. Ⅷ e. Ⓐ"]
    for text, found in [(x, y) for x in texts for y in (False, True)]:
        looked = set()
        known = Noted({}, {}, {}, 0, 0)
        known.final = known.both = set()
        known.never = Words()
        known.anywhere = Counts()
        sentences.Splitter(known).ends(text)
        batch = pa.RecordBatch.from_arrays([pa.array([text]), pa.array([0], pa.int32())], ["text", "bucket"])
        asked = {r["word"] for b in sentences._gather(iter([batch])) for r in b.to_pylist() if r["bucket"] == 0}
        assert looked <= asked


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB .!?\n“”»()1。」と…ก", max_size=80))
def test_sentences_cover(text):
    ends = sentences.Splitter(sentences.Knowledge({}, {}, {}, 0, 0)).ends(text)
    assert ends == sorted(set(ends)) and all(not text[e - 1].isspace() for e in ends)
    assert not text[(ends or [0])[-1] :].strip()


# --- all


@needs_data
def test_found_columns_and_sql(spark):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{SMALL}/{f}')")
    want = {
        "p1_found": "page_id bigint, field string", "p2_found": "block_id bigint, line_no int", "p3_found": "block_id bigint", "p4_found": "doc_id bigint, block_id bigint, lang string", "p5_found": "block_id bigint, noise string", "p6_found": "block_id bigint, line_no int", "p7_found": "doc_id bigint, item_id bigint", "p9_found": "doc_id bigint, end_pos int",
    }
    all_, sql = queries.queries(), queries.oracle_sql()
    for name, columns in want.items():
        df = all_[name](spark, SMALL)
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == columns
        got = [tuple(r) for r in df.collect()]
        assert len(got) == len(set(got)), name
        if name in sql:
            assert set(got) == {tuple(r) for r in con.sql(sql[name]).fetchall()}, name


