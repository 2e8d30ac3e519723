import http.server
import importlib
import io
import json
import os
import struct
import threading
import zipfile

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark import config
from foliospark.functions import aggregates, similarity
from foliospark.functions import text as X
from foliospark.operators import assembly, chunking, correction, engine_json, furniture, html, layout, quality
from foliospark.plans import catalogue, render
from foliospark.sources import epub, files

BLOCK = "block_id long, doc_id long, page_index int, block_order int, type string, x0 double, y0 double, x1 double, y1 double, text string, level int, image_path string, html string"
ELEMENT = "doc_id long, seq long, type string, text string, level int, image_path string, html string, page_index int"
SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


def values(spark, f, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("v")).orderBy("i").collect()
    return [r.v for r in rows]


def test_folio(spark):
    assert values(spark, X.is_folio, ["61", "xiv", "[ 7 ]", "Page 12", "ordinary prose", "", None, "1234567890123"]) == [True, True, True, True, False, False, False, False]


def test_dehyphenate_and_join(spark):
    got = values(spark, X.dehyphenate, ["a remark-\nable day", "Anglo-\nAmerican", "clean text", "soft­ wrap", None])
    assert got == ["a remarkable day", "Anglo-\nAmerican", "clean text", "softwrap", None]
    assert values(spark, X.join_lines, [" one \n\n two\r\nthree ", "", None]) == ["one two three", "", None]


def test_normalise_and_keys(spark):
    assert values(spark, X.normalise, ["  ﬁre a​b  c ", None]) == ["fire ab c", None]
    assert values(spark, X.repeat_key, ["CHAPTER 4 | 61", "Chapter 12 | 9!"]) == ["chapter # #", "chapter # #"]


def test_text_quality(spark):
    good = "The printing house stood beside the river for many years and served every village around it."
    assert values(spark, X.text_quality, [good, "short", "1 2 3\n" * 30, None])[:3] == [pytest.approx(0.94, abs=0.07), 0.0, 0.0]


def test_lists_tables_and_strings(spark):
    assert values(spark, X.markdown_list, ["• one", "plain", "1) a\n• b"]) == ["- one", "plain", "1. a\n- b"]
    assert values(spark, X.is_list_start, ["3. x", "- y", "(b) z", "word"]) == [True, True, False, False]
    table = "<table><tr><th>A</th><th>B</th></tr><tr><td>x|y</td></tr></table>"
    assert values(spark, X.table_markdown, [table, "<table><tr><td colspan=2>x</td></tr></table>", "no", None]) == ["| A | B |\n| --- | --- |\n| x\\|y |  |", None, None, None]
    assert values(spark, X.slug, ["Élan  vital: a/b!", "", "..."]) == ["Elan_vital_ab", "document", "document"]
    assert values(spark, X.natural_key, ["p10"]) > values(spark, X.natural_key, ["p9"])
    assert values(spark, lambda c: X.duration(c.cast("double")), ["0.5", "59", "61", "3700"]) == ["500ms", "59.0s", "1m01s", "1h01m40s"]
    assert values(spark, lambda c: X.byte_size(c.cast("double")), ["10", "2048"]) == ["10B", "2.0KB"]
    assert values(spark, X.mime_type, ["a.PNG", "b"]) == ["image/png", "image/jpeg"]
    assert values(spark, X.tag_strip, ["<head>x</head><p>a <b>b</b></p>"]) == ["a b"]


def test_unwrap(spark):
    fenced = "Here is the text:\n```\nbody\n```"
    assert values(spark, X.unwrap_answer, [fenced, "<think>no</think> body", "<text>body</text>", "body", None]) == ["body"] * 4 + [""]


def test_guard(spark):
    original = "The clerk wrote the letters in the year 1834 and carried them to the mill."
    rows = [original, original.replace("letters", "letter"), "A summary.", original[:45], "", "Note: " + original, None]
    df = spark.createDataFrame([(i, original, r) for i, r in enumerate(rows)], "i int, original string, candidate string")
    assert [r.reason for r in similarity.guarded(df).orderBy("i").collect()] == ["ok", "ok", "too_short", "too_short", "empty", "meta_response", "empty"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_bound_holds(a, b):
    n = sum(min(a.count(x), b.count(x)) for x in set(a))
    bound = 1.0 if not a and not b else 0.0 if not a or not b else 2 * n / (len(a) + len(b))
    assert similarity.ratio(" ".join(a), " ".join(b)) <= bound + 1e-9


def _block(i, page, text, y0, y1, kind="text", order=0, x0=60.0, x1=900.0):
    return (i, 1, page, order, kind, x0, y0, x1, y1, text, 0, None, None)


def test_furniture(spark):
    rows = []
    for p in range(8):
        rows += [_block(p * 3, p, "THE BOOK | 1%d" % p, 20.0, 45.0), _block(p * 3 + 1, p, "Body text here.", 200.0, 600.0), _block(p * 3 + 2, p, str(p + 9), 1360.0, 1385.0)]
    blocks = spark.createDataFrame(rows, BLOCK)
    pages = spark.createDataFrame([(1, p, 1000, 1400) for p in range(8)], "doc_id long, page_index int, page_width int, page_height int")
    got = {r.furniture: r.n for r in furniture.mark_furniture(blocks, pages).groupBy("furniture").agg(F.count("*").alias("n")).collect()}
    assert got == {"header": 8, "page_number": 8, None: 8}
    assert furniture.mark_furniture(blocks.limit(0), pages).count() == 0


def test_weak_pages(spark):
    pages = spark.createDataFrame([(1, p, 1000, 1400) for p in range(10)], "doc_id long, page_index int, page_width int, page_height int")
    plain = spark.createDataFrame([(1, p, "x" * (100 if p > 1 else 5)) for p in range(9)], "doc_id long, page_index int, plain string")
    assert sorted(r.page_index for r in furniture.weak_pages(plain, pages).collect()) == [0, 1, 9]


def _fold(els):
    """Stitching as a plain loop."""
    out = []
    for seq, kind, text, page in els:
        if kind == "page_break":
            continue
        if out and kind == "text" and out[-1][1] == "text":
            prev = out[-1][2].rstrip()
            if text.strip() and len(prev) >= 40 and (prev[-1].isalnum() or prev[-1] in "-,;") and not text.startswith(("- ", "1. ")):
                glued = prev[:-1] + text.lstrip() if prev[-1] == "-" and text[:1].islower() else prev + " " + text.lstrip()
                out[-1] = (out[-1][0], "text", glued, sorted({*out[-1][3], page}))
                continue
        out.append((seq, kind, text, [page]))
    return out


@pytest.mark.parametrize("pages", [64, 3 / assembly.PAGE])  # in the second case a segment has three elements
def test_stitching_is_the_fold(spark, monkeypatch, pages):
    monkeypatch.setattr(assembly, "SEGMENT_PAGES", pages)
    rng = np.random.default_rng(3)
    pool = ["short end", "this is a longer paragraph that has no stop at its end", "a complete sentence of more than forty characters, it is.", "- item", "broken at the end of a rather long line of tex-", "tail"]
    rows, want = [], {}
    for doc in range(300):
        els = [(i, str(rng.choice(["text", "text", "text", "heading", "page_break"])), str(rng.choice(pool)), int(i // 3)) for i in range(rng.integers(1, 12))]
        want[doc] = [(s, k, t, p) for s, k, t, p in _fold(els)]
        rows += [(doc, s, k, t if k != "page_break" else "", 0, None, None, p) for s, k, t, p in els]
    got = assembly.stitch(spark.createDataFrame(rows, ELEMENT)).filter("type <> 'page_break'").collect()
    by: dict = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.seq)):
        by.setdefault(r.doc_id, []).append((r.seq, r.type, r.text, list(r.pages)))
    assert by == {d: w for d, w in want.items() if w}


def test_chunks_are_the_fold(spark, monkeypatch):
    monkeypatch.setattr(chunking, "SEGMENT", 7)
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for doc in range(60):
        size = chunk = 0
        for seq in range(int(rng.integers(1, 60))):
            kind, n = str(rng.choice(["text", "list", "table"])), int(rng.integers(0, 60))
            rows.append((doc, seq, kind, "x" * n, 0, None, None, 0))
            if kind == "table" or n == 0:
                continue
            if size and size + n > 100:
                size, chunk = 0, chunk + 1
            size += n
            want[doc, seq] = chunk
    got = {(r.doc_id, r.seq): r.chunk for r in chunking.pack_chunks(spark.createDataFrame(rows, ELEMENT), 100).collect()}
    assert got == want


@pytest.mark.parametrize("pages", [64, 4 / assembly.PAGE])
def test_running(spark, monkeypatch, pages):
    from foliospark.operators import running

    monkeypatch.setattr(assembly, "SEGMENT_PAGES", pages)
    rng = np.random.default_rng(4)
    rows = [(d, i, int(v), None if v == 2 else str(v)) for d in range(8) for i, v in enumerate(rng.integers(0, 3, size=rng.integers(1, 30)))]
    df = spark.createDataFrame(rows, "doc_id long, seq long, v int, t string")
    got = {(r.doc_id, r.seq): (r.s, r.b, r.a) for r in running.neighbours(running.running_sums(df, s=F.col("v")), "t", "b", "a").collect()}
    want = {}
    for d in range(8):
        own = [r for r in rows if r[0] == d]
        for k, r in enumerate(own):
            want[d, r[1]] = (sum(x[2] for x in own[: k + 1]), own[k - 1][3] if k else None, own[k + 1][3] if k + 1 < len(own) else None)
    assert got == want


def test_chapters(spark):
    els = [(1, 0, "page_break", "", 0), (1, 1, "heading", "One", 1), (1, 2, "text", "a", 0), (1, 3, "heading", "Sub", 2), (1, 4, "text", "b", 0), (1, 5, "text", "c", 0), (1, 6, "heading", "Sub two", 2), (1, 7, "heading", "Two", 1), (2, 0, "text", "no heading", 0)]
    df = spark.createDataFrame([(d, s, k, t, lv, None, None, 0) for d, s, k, t, lv in els], ELEMENT)
    got = {(r.doc_id, r.seq): (r.chapter, r.title) for r in chunking.split_chapters(df, most=3).collect()}
    assert got[1, 1] == (1, "One") and got[1, 4] == (1, "One") and got[1, 6] == (2, "Sub two") and got[1, 7] == (3, "Two") and got[2, 0] == (0, "Part 1") and (1, 0) not in got


def _two_columns(left=460.0):
    x0 = np.array([60.0] * 25 + [540.0] * 25)
    y0 = np.array([100.0 + 40 * i for i in range(25)] * 2)
    return x0, y0, np.where(x0 < 100, left, x0 + left - 60), y0 + 28


def test_columns():
    yes = np.ones(50, bool)
    assert len(layout.detect_columns(*_two_columns(), yes, 1000, gap=0.035).spans) == 2
    assert len(layout.detect_columns(*_two_columns(530.0), yes, 1000, gap=0.035).spans) == 2
    x0, y0, x1, y1 = _two_columns()
    assert len(layout.detect_columns(np.full(25, 60.0), y0[:25], np.full(25, 940.0), y1[:25], yes[:25], 1000, gap=0.035).spans) == 1
    hang = np.where(np.arange(24) % 4 == 0, 60.0, 110.0)
    assert len(layout.detect_columns(hang, y0[:24], np.full(24, 900.0), y1[:24], yes[:24], 1000, gap=0.035).spans) == 1
    assert len(layout.detect_columns(*(v[:0] for v in (x0, y0, x1, y1)), yes[:0], 1000).spans) == 1


def test_reading_order(spark):
    x0, y0, x1, y1 = _two_columns()
    assert layout.xy_cut(x0, y0, x1, y1, 1000, 1400) == list(range(50))
    zigzag = np.argsort(np.concatenate([np.arange(25) * 2, np.arange(25) * 2 + 1]))
    rows = []
    for page, order in ((0, np.arange(50)), (1, np.argsort(zigzag))):
        rows += [(page * 100 + i, 1, page, int(order[i]), "text", float(x0[i]), float(y0[i]), float(x1[i]), float(y1[i]), "t", 0, None, None) for i in range(50)]
    pages = spark.createDataFrame([(1, p, 1000, 1400) for p in range(2)], "doc_id long, page_index int, page_width int, page_height int")
    got = layout.reading_order(spark.createDataFrame(rows, BLOCK), pages).collect()
    assert {(r.page_index, r.method) for r in got} == {(0, "engine"), (1, "xy_cut(corrected)")}
    assert all(r.new_order == r.block_id % 100 for r in got)


def test_left_edges(spark):
    x0, y0, x1, y1 = _two_columns(530.0)
    rows = [(i, 1, 0, i, "text", float(x0[i]), float(y0[i]), float(x1[i]), float(y1[i]), "t", 0, None, None) for i in range(50)] + [(99, 1, 1, 0, "text", None, None, None, None, "t", 0, None, None)]
    pages = spark.createDataFrame([(1, p, 1000, 1400) for p in range(2)], "doc_id long, page_index int, page_width int, page_height int")
    got = layout.left_edge_columns(spark.createDataFrame(rows, BLOCK), pages).orderBy("column_no").collect()
    assert [(r.page_index, r.column_no, r.left) for r in got] == [(0, 0, 60.0), (0, 1, 540.0)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 900), st.integers(0, 1300), st.integers(1, 300), st.integers(1, 80)), max_size=30))
def test_xy_cut_is_a_permutation(boxes):
    a = np.array(boxes, float).reshape(-1, 4)
    assert sorted(layout.xy_cut(a[:, 0], a[:, 1], a[:, 0] + a[:, 2], a[:, 1] + a[:, 3], 1000, 1400)) == list(range(len(a)))


def test_html():
    page = "<html><head><title>T</title><meta charset='utf-8'></head><body><h1>One</h1><p>a<br>b</p><p>c</p><ul><li>x</li><li>y</li></ul><img src='i.png' alt='pic'></body></html>"
    got = html.pieces(page)
    assert [k for k, *_ in got] == ["heading", "text", "text", "list", "list", "figure"] and got[1][1] == "a b"
    assert html.pieces(page, void_tags=False) == [] and html.pieces(None) == [] and html.pieces("") == []


def test_native_pages_by_html_or_text(spark, tmp_path):
    pages = "page_id long, doc_id long, page_index int, native_text string, native_html string, dpi double"
    long = "The clerk carried the letters over the river to the old mill and"
    rows = [
        (1, 1, 0, None, f"<h1>One</h1><p>{long}</p>", 300.0),
        (1, 1, 0, None, f"<h1>One</h1><p>{long}</p>", 300.0),
        (2, 1, 1, "WRONG FIELD", "<p>came back.</p><img src='i.png'><p>\u200b</p>", 300.0),
        (3, 1, 2, "Plain one.\n\nPlain two.", None, 300.0),
        (4, 1, 3, "Empty markup.", "", 300.0),
        (5, 2, 0, None, "<p>Only markup here.</p>", None),
        (6, 3, 0, None, None, 300.0),
    ]
    spark.createDataFrame(rows, pages).write.parquet(str(tmp_path / "source_pages.parquet"))
    spark.createDataFrame([(1, "One", "a/one.epub", None, None, None), (2, None, "a/two.epub", None, None, None)], "doc_id long, title string, source_file string, author string, language string, identifier string").write.parquet(str(tmp_path / "document_meta.parquet"))
    run = lambda name: catalogue.queries()[name](spark, str(tmp_path)).collect()
    els = {(r.doc_id, r.seq): (r.type, r.text, r.pages) for r in catalogue.native_stitched(spark, str(tmp_path)).collect() if r.type != "page_break"}
    assert els == {
        (1, 1): ("heading", "One", [0]), (1, 2): ("text", f"{long} came back.", [0, 1]), (1, 100_002): ("figure", "", [1]), (1, 200_001): ("text", "Plain one.", [2]),
        (1, 200_002): ("text", "Plain two.", [2]), (1, 300_001): ("text", "Empty markup.", [3]), (2, 1): ("text", "Only markup here.", [0]),
    }
    assert {r.doc_id: (r.n_pages, r.n_headings, r.n_figures, r.n_paragraphs) for r in run("native_documents")} == {1: (4, 1, 1, 4), 2: (1, 0, 0, 1)}
    assert {r.doc_id for r in run("native_chapters")} == {r.doc_id for r in run("native_epubs")} == {1, 2}
    assert {r.part for r in run("native_markdown")} >= {"## One", "Only markup here.", "Plain two.", "![figure](i.png)"}
    assert {r.doc_id: r.is_scan for r in run("native_routes")} == {1: False, 2: False, 3: True}
    assert {(r.page_id, r.image_no, r.src) for r in run("links_images")} == {(2, 0, "i.png")}
    assert {r.part for r in run("html_markdown") if not r.part.startswith("<!--")} == {"## One", f"{long} came back.", "![figure](i.png)", "Only markup here."}


def test_table_markdown_query(spark, tmp_path):
    rows = [_block(i, i, "", 1.0, 2.0, kind) for i, kind in ((1, "table"), (2, "table"), (3, "text"))]
    tables = {1: "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>", 2: "<table><tr><td colspan=2>a</td></tr></table>"}
    spark.createDataFrame(rows, BLOCK).drop("html").join(spark.createDataFrame(list(tables.items()), "block_id long, html string"), "block_id", "left").write.parquet(str(tmp_path / "blocks.parquet"))
    got = {r.block_id: r.markdown for r in catalogue.queries()["table_markdown"](spark, str(tmp_path)).collect()}
    assert got == {1: "| a | b |\n| --- | --- |\n| c |  |", 2: None}


def test_correction(spark):
    els = spark.createDataFrame([(1, 0, "text", "The clerk carried teh letters to the mill on the river.", 0, None, None, 0), (1, 1, "text", "Another paragraph stands here beside it, and is right.", 0, None, None, 0), (1, 2, "heading", "Head", 1, None, None, 0)], ELEMENT)
    out, outcomes = correction.correct(els, lambda t: t.replace("teh", "the"))
    assert [r.text for r in out.orderBy("seq").collect()][0] == "The clerk carried the letters to the mill on the river."
    assert [r.outcome for r in outcomes.collect()] == ["accepted"]
    _, bad = correction.correct(els, lambda t: 1 / 0)
    assert [r.reason for r in bad.collect()] == ["error"]


def test_engine_json(spark):
    import json

    page = {"page_idx": 3, "page_size": [500, 700], "para_blocks": [{"type": "title", "index": 2, "level": 1, "bbox": [10, 20, 30, 40], "lines": [{"spans": [{"type": "text", "content": "Head"}]}]}, {"type": "table", "index": 1, "blocks": [{"type": "table_body", "bbox": [0, 0, 1, 1], "lines": [{"spans": [{"type": "table", "html": "<table></table>"}]}]}, {"type": "table_caption", "lines": [{"spans": [{"type": "text", "content": "cap"}, {"type": "inline_equation", "content": "x"}]}]}]}], "discarded_blocks": [{"type": "text", "index": 9, "lines": []}]}
    df = spark.createDataFrame([(1, json.dumps(page), 1000, 1400), (2, "no json", 1, 1)], "doc_id long, json string, width int, height int")
    got = engine_json.engine_blocks(df).orderBy("block_order").collect()
    assert [(r.type, r.text, r.html) for r in got] == [("table", "", "<table></table>"), ("caption", "cap $x$", None), ("heading", "Head", None), ("header", "", None)]
    assert (got[2].x0, got[2].y0, got[2].level) == (20.0, 40.0, 1)


def test_epub_round_trip(spark, tmp_path):
    content = render.epub_bytes("A & B", "Me", "en", "id1", "2025-01-01T00:00:00Z", [("One", "<p>first text</p>"), ("Two", "<p>second</p>")])
    (tmp_path / "x.epub").write_bytes(content)
    (tmp_path / "bad.epub").write_bytes(b"nothing")
    (tmp_path / "~tmp.epub").write_bytes(b"")
    found = files.discover(spark, str(tmp_path))
    packages = epub.read_epubs(found).persist()
    assert sorted(r.error is None for r in packages.collect()) == [False, True]
    pages = epub.spine_pages(packages)
    assert [X_ for X_ in (r.native_html for r in pages.orderBy("page_index").collect()) if "first text" in X_ or "second" in X_] and pages.count() == 2
    assert [r.is_scan for r in epub.probe(pages, epub.image_references(pages, packages)).collect()] == [False]
    assert files.discover(spark, str(tmp_path / "missing")).count() == 0
    assert files.fingerprint(found).select("fingerprint").distinct().count() == 2


def test_group_inputs(spark):
    paths = spark.createDataFrame([("in/a.pdf",), ("in/b/p10.png",), ("in/b/p9.png",), ("in/c.jpg",), ("in/~x.pdf",), (None,)], "path string")
    got = {r.document: list(r.files) for r in files.group_inputs(paths, "in").collect()}
    assert got == {"in/a.pdf": ["in/a.pdf"], "in/b": ["in/b/p9.png", "in/b/p10.png"], "in/c.jpg": ["in/c.jpg"]}


def test_upper_median_and_resume(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("b", None)], "k string, v double")
    assert [tuple(r) for r in aggregates.upper_median(df, ["k"], "v").collect()] == [("a", 3.0)]
    rng = np.random.default_rng(2)
    many = [(k, float(v)) for k in ("x", None) for v in np.concatenate([rng.exponential(size=3001 if k else 3000) ** 4, np.zeros(900)])]
    got = {r.k: r.median for r in aggregates.upper_median(spark.createDataFrame(many, "k string, v double"), ["k"], "v").collect()}
    assert got == {k: sorted(v for q, v in many if q == k)[sum(q == k for q, _ in many) // 2] for k in ("x", None)}
    jobs, done = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, page_index int"), spark.createDataFrame([(1, 0), (1, 0)], "doc_id long, page_index int")
    assert [r.page_index for r in quality.missing_pages(jobs, done).collect()] == [1]
    assert quality.cache_complete(done, spark.createDataFrame([(1, 2)], "doc_id long, total long")).first().complete is False


def test_config():
    s = config.load(environ={"FOLIOSPARK_LAYOUT__MAX_COLUMNS": "2", "FOLIOSPARK_RUN__RESUME": "no", "FOLIOSPARK_NO__SUCH": "1", "FOLIOSPARK_RENDER__MIN_DPI": "x"})
    assert (s["layout.max_columns"], s["run.resume"], s["render.min_dpi"], s.get("no.such")) == (2, False, 150, None)
    assert s.fingerprint() != config.load(environ={}).fingerprint()


def test_markdown(spark):
    els = spark.createDataFrame([(1, 0, "page_break", "", 0, None, None, [0]), (1, 1, "heading", "Head", 1, None, None, [0]), (1, 2, "text", "Body", 0, None, None, [0]), (1, 3, "caption", "Cap", 0, None, None, [0])], "doc_id long, seq long, type string, text string, level int, image_path string, html string, pages array<int>")
    meta = spark.createDataFrame([(1, "T")], "doc_id long, title string")
    folios = spark.createDataFrame([(1, 0, "61")], "doc_id long, page_index int, folio string")
    assert [r.part for r in render.markdown_parts(els, meta, folios).orderBy("seq").collect()] == ["<!-- page 61 -->", "## Head", "Body", "*Cap*"]
    book = spark.createDataFrame([(1, "T", None, None, None)], "doc_id long, title string, author string, language string, identifier string")
    pack = render.epubs(els, chunking.split_chapters(els), book, "2025-01-01T00:00:00Z").first()
    assert bytes(pack.content[:2]) == b"PK"


def test_stream(spark, tmp_path):
    from foliospark.streaming import pages as stream

    rows = spark.createDataFrame([_block(1, 0, "one remark-\nable line", 1.0, 2.0), _block(2, 0, "9", 1.0, 2.0, "page_number")], BLOCK)
    rows.write.parquet(str(tmp_path / "in"))
    q = stream.write_pages(stream.line_stream(stream.block_stream(spark, str(tmp_path / "in"), rows.schema)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["one remarkable line"]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_queries_match_sql(spark):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{SMALL}/{f}')")
    queries, sql = catalogue.queries(), catalogue.oracle_sql()
    for name in ("text_quality", "furniture_labels", "stitch_paragraphs", "native_assembly", "take_longer", "guard_reasons", "list_format", "cache_complete"):
        a, b = queries[name](spark, SMALL).toPandas(), con.sql(sql[name]).df()
        c = sorted(a.columns)
        assert c == sorted(b.columns)
        key = lambda d: sorted(map(repr, d[c].astype(object).where(pd.notna(d[c]), None).itertuples(index=False, name=None)))
        assert key(a) == key(b), name


def test_nothing_needs_training_text():
    import ast
    import pathlib

    root = pathlib.Path(importlib.import_module("foliospark").__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(n.startswith("foliospark.llm") for n in names), p


# --- ingest, engines, outputs


def _png(width, height):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", width, height) + b"\x08\x02\0\0\0"


def _jpeg(width, height):
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + b"\0" * 9 + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, height, width) + b"\0" * 12


def _tiff(*sizes):
    out, at = b"II*\0" + struct.pack("<I", 8), 8
    for k, (width, height) in enumerate(sizes):
        at += 2 + 24 + 4
        out += struct.pack("<H", 2) + struct.pack("<HHII", 256, 4, 1, width) + struct.pack("<HHII", 257, 4, 1, height) + struct.pack("<I", at if k + 1 < len(sizes) else 0)
    return out


def test_image_sizes():
    from foliospark.sources.images import frame_sizes

    assert frame_sizes(_png(30, 40)) == [(30, 40)] and frame_sizes(_jpeg(50, 60)) == [(50, 60)] and frame_sizes(_tiff((1, 2), (3, 4))) == [(1, 2), (3, 4)]
    assert frame_sizes(b"GIF89a" + struct.pack("<HH", 7, 8)) == [(7, 8)] and frame_sizes(b"BM" + b"\0" * 16 + struct.pack("<ii", 9, -10)) == [(9, 10)]
    assert frame_sizes(b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (10).to_bytes(3, "little") + (20).to_bytes(3, "little")) == [(11, 21)]
    assert frame_sizes(None) == frame_sizes(b"") == frame_sizes(b"\x89PNG\r\n\x1a\n") == frame_sizes(b"\xff\xd8\xff\xe0") == frame_sizes(b"text") == frame_sizes(_tiff((1, 2))[:20]) == []


def test_ingest(spark):
    from foliospark.sources import files, ingest

    contents = {"/in/a.pdf": b"", "/in/b.epub": b"", "/in/c.png": _png(10, 20), "/in/book/p10.png": _png(3, 3), "/in/book/p2.tif": _tiff((1, 1), (2, 2)), "/in/book/p9.jpg": b"broken"}
    table = spark.createDataFrame(list(contents.items()), "path string, content binary")
    groups = ingest.dispatch(files.group_inputs(table.select("path"), "/in"))
    assert {(r.document, r.kind, r.title) for r in groups.collect()} == {("/in/a.pdf", "pdf", "a"), ("/in/b.epub", "epub", "b"), ("/in/c.png", "images", "c"), ("/in/book", "images", "book")}
    odd = ingest.dispatch(spark.createDataFrame([("x.doc", ["x.doc"])], "document string, files array<string>")).collect()[0]
    assert odd.kind is None and odd.error == "unsupported input: x.doc"
    pages = ingest.image_pages(groups.filter("kind = 'images'"), table).collect()
    assert sorted((r.document, r.page_index, r.image_path, r.frame, r.width) for r in pages) == [("/in/book", 0, "/in/book/p2.tif", 0, 1), ("/in/book", 1, "/in/book/p2.tif", 1, 2), ("/in/book", 2, "/in/book/p10.png", 0, 3), ("/in/c.png", 0, "/in/c.png", 0, 10)]
    assert ingest.image_pages(groups, table, 1).count() == 2


def test_store(spark, tmp_path):
    from foliospark.sources.ingest import Store, reusable_corrections

    store = Store(spark, str(tmp_path / "kept"))
    assert store.load("pages") is None
    rows = lambda *x: spark.createDataFrame(list(x), "doc_id long, text string")
    store.save("pages", rows((1, "a"), (1, "b"), (2, "c"), (300, "d")))
    store.save("pages", rows((1, "new"), (4, "e")))
    assert {tuple(r) for r in store.load("pages").collect()} == {(1, "new"), (2, "c"), (300, "d"), (4, "e")}
    (tmp_path / "kept" / "broken").mkdir()
    (tmp_path / "kept" / "broken" / "x.parquet").write_bytes(b"no table")
    assert store.load("broken") is None
    assert [r.doc_id for r in reusable_corrections(rows((1, "a"), (2, "b"), (2, "c")), rows((1, "x"), (2, "y"), (3, "z"))).collect()] == [1]


def test_figures(spark):
    from foliospark.operators import figures

    rows = [_block(1, 0, "", 100.0, 300.9, "figure"), _block(2, 1, "", 0.0, 5.0, "figure"), _block(3, 1, "", -5.0, 3000.0, "figure", 1), _block(4, 1, "", 0.0, 300.0), _block(5, 2, "", None, 3.0, "figure")]
    blocks = spark.createDataFrame(rows + [(6, 1, 0, 0, "figure", 0.0, 0.0, 500.0, 500.0, "", 0, "have.png", None)], BLOCK)
    pages = spark.createDataFrame([(1, p, 1000, 1400) for p in range(3)], "doc_id long, page_index int, page_width int, page_height int")
    crops = figures.figure_crops(blocks, pages)
    assert [(r.block_id, r.left, r.top, r.right, r.bottom, r.name) for r in crops.orderBy("name").collect()] == [(1, 60, 100, 900, 300, "images/p0000_00.jpg"), (3, 60, 0, 900, 1400, "images/p0001_01.jpg")]
    assert {r.block_id: r.image_path for r in figures.with_figures(blocks, crops).collect() if r.image_path} == {1: "images/p0000_00.jpg", 3: "images/p0001_01.jpg", 6: "have.png"}


def test_engines(spark):
    from foliospark.operators import engines

    class _Echo:
        def available(self):
            return ""

        def load(self):
            pass

        def read(self, path):
            if path == "bad":
                raise OSError("unreadable")
            return [([(5, 1), (9, 2), (8, 7), (4, 6)], f" {path} ", 0.5), ([(0, 0), (1, 1)], "  ", 0.1)]

        def close(self):
            pass

    engines.engine("echo")(_Echo)
    assert engines.choose("auto", ["none", "echo"]) == "echo" and engines.choose("echo", []) == "echo"
    with pytest.raises(LookupError):
        engines.choose("none", [])
    pages = engines.recognise(spark.createDataFrame([(1, 0, "a.png"), (1, 1, "bad")], "doc_id long, page_index int, image_path string"), _Echo)
    got = {r.page_index: (len(r.lines), r.error) for r in pages.collect()}
    assert got == {0: (2, None), 1: (0, "OSError: unreadable")}
    (line,) = engines.engine_lines(pages).collect()
    assert (line.text, line.x0, line.y0, line.x1, line.y1) == ("a.png", 4.0, 1.0, 9.0, 7.0)


def test_restoration(spark):
    def restorer(path, actions):
        if path == "bad":
            raise ValueError("broken")
        return path + "+" + "".join(actions)

    rows = spark.createDataFrame([(1, 0, "a", ["crop"]), (1, 1, "b", []), (1, 2, "bad", ["crop"])], "doc_id long, page_index int, image_path string, actions array<string>")
    done = quality.restore_pages(rows, restorer)
    assert {r.page_index: (r.restored_path, r.changed, r.error) for r in done.collect()} == {0: ("a+crop", True, None), 1: ("b", False, None), 2: ("bad", False, "ValueError: broken")}
    scores = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.7), (1, 2, 0.9), (1, 3, 0.8)], "doc_id long, page_index int, score double")
    assert tuple(quality.restoration_report(done, scores).collect()[0]) == (1, 3, 1, 1, 0.8)


def test_deep_engine_json(spark):
    leaf = lambda text, **more: {"type": "text", "bbox": [0, 0, 10, 10], "lines": [{"spans": [{"type": "text", "content": text}]}], **more}
    nest = lambda *x, **more: {"type": "list", "blocks": list(x), **more}
    page = {"page_idx": 0, "page_size": [100, 100], "para_blocks": [nest(nest(nest(nest(leaf("deep", index=0), leaf("deeper")), leaf("third")), leaf("second")), leaf("first"), index=2), leaf("before", index=1)]}
    rows = spark.createDataFrame([(1, json.dumps(page), 200, 200), (2, "no json", 1, 1)], "doc_id long, json string, width int, height int")
    got = engine_json.engine_blocks(rows).orderBy("block_order").collect()
    assert [r.text for r in got] == ["before", "deep", "deeper", "third", "second", "first"] and got[1].x1 == 20.0


def test_slugs(spark):
    assert values(spark, X.slug, ["Čapek: Růže & Dům", "Ünal Şahin", "Ελένη", "ﬁne  print", "...", None]) == ["Capek_Ruze_Dum", "Unal_Sahin", "Ελενη", "fine_print", "document", None]


def test_text_layer(spark):
    from foliospark.operators import textlayer

    images = spark.createDataFrame([(1, 0, 0, 1000, 500, 0.0, 0.0, 360.0, 360.0, 720.0, 720.0), (1, 0, 1, 2000, 2000, 0.0, 0.0, 360.0, 360.0, 720.0, 720.0), (1, 1, 0, 0, 5, 0.0, 0.0, 1.0, 1.0, 720.0, 720.0)], "doc_id long, page_index int, image_no int, width int, height int, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double")
    assert {r.page_index: (round(r.dpi, 3), r.coverage) for r in textlayer.effective_dpi(images).collect()} == {0: (200.0, 0.25), 1: (300.0, 0.0)}
    rows = spark.createDataFrame([("mmmmmmmm", 40.0, 12.0), ("iiii", 40.0, 12.0), ("a", 0.1, 0.1), ("two words here", 60.0, 30.0)], "t string, w double, h double")
    got = [(r.s, r.e) for r in rows.select(textlayer.fitted_size(F.col("t"), F.col("w"), F.col("h")).alias("s"), textlayer.font_size(F.col("t"), F.col("w"), F.col("h")).alias("e")).collect()]
    assert got[0][0] < got[0][1] and got[1][0] == got[1][1] and got[2][0] == 0.5 and 0.5 < got[3][0] <= got[3][1]


def test_epub_images():
    body = '<p>x</p><figure><img src="images/a&amp;b.png" alt="A"/><figcaption>A</figcaption></figure><figure><img src="gone.png" alt=""/></figure>'
    made = render.epub_bytes("T", "", "en", "id", "2025-01-01T00:00:00Z", [("One", body), ("Two", body)], {"images/a&b.png": b"PNG", "unused.png": b"no"})
    with zipfile.ZipFile(io.BytesIO(made)) as z:
        names = z.namelist()
        chapter = z.read("OEBPS/chapter_0001.xhtml").decode()
        opf = z.read("OEBPS/content.opf").decode()
        assert names[0] == "mimetype" and [n for n in names if "images/" in n] == ["OEBPS/images/0001.png"] and z.read("OEBPS/images/0001.png") == b"PNG" and "OEBPS/style.css" in names
    assert 'src="images/0001.png"' in chapter and "gone.png" not in chapter and 'href="style.css"' in chapter and 'media-type="image/png"' in opf and 'media-type="text/css"' in opf


def test_correction_server(spark):
    from foliospark.operators import correction_server

    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def answer(self, code, body):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            self.answer(200, {"models": [{"name": "small:1b"}]})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append("think" in body)
            self.answer(400, {}) if "think" in body else self.answer(200, {"response": "<text>done</text>"})

    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler) as served:
        threading.Thread(target=served.serve_forever, daemon=True).start()
        url = f"http://127.0.0.1:{served.server_address[1]}"
        server = correction_server.Server(url, "small")
        assert correction_server.corrector_or_none(server) == (server, "")
        assert server("a") == server("b") == "<text>done</text>" and asked == [True, False, False]
        assert "no model" in correction_server.corrector_or_none(correction_server.Server(url, "large"))[1]
        served.shutdown()
    assert correction_server.corrector_or_none(correction_server.Server(url, "small", timeout=1))[0] is None and correction_server.corrector_or_none(None)[0] is None


@needs_data
def test_pipeline_and_command_line(spark, tmp_path, capsys):
    from foliospark import cli
    from foliospark.plans import pipeline

    out = str(tmp_path / "out")
    assert cli.main([SMALL, "--output-dir", out, "--pages", "2", "--work-dir", str(tmp_path / "work"), "--only", "md", "--no-llm"]) in (pipeline.OK, pipeline.SOME_FAILED)
    status = spark.read.parquet(f"{out}/outcomes")
    assert status.filter("ok").count() > 0 and status.agg(F.max("n_pages")).first()[0] <= 2 and status.filter("NOT ok AND error IS NULL").count() == 0
    assert len(os.listdir(f"{out}/markdown")) > 1 and not os.path.exists(f"{out}/epub")
    assert cli.main(["/no/such/folder"]) == pipeline.NO_FILE and cli.main([]) == pipeline.NOTHING_TO_DO and cli.main(["--engine", "none", SMALL]) == pipeline.NO_ENGINE and cli.main(["--list-engines"]) == pipeline.OK


@needs_data
def test_corrections_are_kept(spark, tmp_path):
    from foliospark.plans import pipeline
    from foliospark.sources.ingest import Store

    store = Store(spark, str(tmp_path))
    settings_ = config.load(environ={})
    els = spark.createDataFrame([(d, i, "text", "the clerk wrote a letter to the old mill", 0, None, None, [0], 1) for d in range(3) for i in range(2)], "doc_id long, seq long, type string, text string, level int, image_path string, html string, pages array<int>, n_parts int")
    swap = lambda t: t.replace("clerk", "clark")
    first = pipeline.corrected(els, settings_, swap, store)
    assert first.filter("text LIKE '%clark%'").count() == 6
    more = els.unionByName(els.filter("doc_id = 1 AND seq = 0").withColumn("seq", F.lit(9).cast("long")))
    again = pipeline.corrected(more, settings_, lambda t: t.replace("clerk", "clork"), store)
    assert {(r.doc_id, "clork" in r.text) for r in again.collect()} == {(0, False), (1, True), (2, False)}
    assert pipeline.corrected(els, settings_, None, store).filter("text LIKE '%clerk%'").count() == 6
