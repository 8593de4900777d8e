"""Geometry: lines, blocks, tables, scripts, scanner against a plain loop."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from folio.operators import blocks, layout
from folio.operators.ordered import runs, scan, upper_median
from folio.rules import Rules


def test_scrambled_words_make_lines(spark):
    words = [("world", 50.0, 10.0, 90.0, 20.0), ("line", 55.0, 40.0, 80.0, 50.0), ("Hello", 10.0, 11.0, 45.0, 21.0), ("Second", 10.0, 40.0, 50.0, 50.0)]
    df = spark.createDataFrame([(1, 1, *w) for w in words], "book_id long, page_no long, text string, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r["y0"], r["text"]) for r in layout.cluster_lines(df).collect())
    assert got == [(10.0, "Hello world"), (40.0, "Second line")]


def reference_lines(words):
    found = []
    for w in sorted(words, key=lambda w: (w[2], w[1])):
        c = (w[2] + w[4]) / 2
        for line in found:
            top, bottom = (sum(x[i] for x in line) / len(line) for i in (2, 4))
            if abs(c - (top + bottom) / 2) <= max(4.0, 0.45 * (bottom - top)):
                line.append(w)
                break
        else:
            found.append([w])
    return sorted(" ".join(x[0] for x in sorted(line, key=lambda x: x[1])) for line in found)


def test_bands_do_not_change_clustering(spark):
    rnd = random.Random(5)
    pages = {}
    for page in range(6):
        pages[page] = []
        for i in range(60):
            x, y, h = round(rnd.uniform(0, 500), 1) + i / 1000, round(rnd.uniform(0, 300), 1), rnd.choice([8.0, 10.0, 12.0, 30.0])
            pages[page].append((f"w{page}_{i}", x, y, x + 20, y + h))
    rows = [(1, p, *w) for p, ws in pages.items() for w in ws]
    df = spark.createDataFrame(rows, "book_id long, page_no long, text string, x0 double, y0 double, x1 double, y1 double")
    got = {}
    for r in layout.cluster_lines(df).collect():
        got.setdefault(r["page_no"], []).append(r["text"])
    for page, words in pages.items():
        assert sorted(got[page]) == reference_lines(words)


def test_ruling_lines_and_ocr_boxes(spark):
    df = spark.createDataFrame([(0.0, 0.0, 100.0, 2.0), (0.0, 0.0, 2.0, 50.0), (0.0, 0.0, 10.0, 2.0), (0.0, 0.0, 50.0, 50.0)], "x0 double, y0 double, x1 double, y1 double")
    got = [(r["is_horizontal"], r["is_vertical"]) for r in layout.ruling_lines(df).collect()]
    assert sorted(got) == [(False, True), (True, False)]
    px = spark.createDataFrame([("a", 200.0, 100.0, 400.0, 150.0)], "text string, x0 double, y0 double, x1 double, y1 double")
    r = layout.scale_boxes(px, F.lit(200.0)).first()
    assert (r["x0"], r["y0"], r["x1"], r["y1"]) == (72.0, 36.0, 144.0, 54.0)


def test_scan_equals_a_loop(spark):
    rnd = random.Random(1)
    rows = [(k, i, rnd.choice([None, 1, 2, 3]), rnd.randint(-5, 5)) for k in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i long, f int, v int")
    out = scan(
        df, ["k"], F.floor(F.col("i") / 7), [F.col("i")], sums={"s": F.col("v")}, maxes={"m": F.col("v")}, maxes_before={"b": F.col("v")},
        fills={"ff": F.col("f")}, lags={"p": F.col("v")}, leads={"n": F.col("v")},
    )
    got = {(r["k"], r["i"]): r for r in out.collect()}
    for k in "ab":
        mine = [r for r in rows if r[0] == k]
        total, top, fill = 0, None, None
        for j, (_, i, f, v) in enumerate(mine):
            r = got[(k, i)]
            assert r["b"] == top
            total, top, fill = total + v, v if top is None else max(top, v), f if f is not None else fill
            assert (r["s"], r["m"], r["ff"]) == (total, top, fill)
            assert r["p"] == (mine[j - 1][3] if j else None)
            assert r["n"] == (mine[j + 1][3] if j + 1 < len(mine) else None)
    numbered = runs(df, ["k"], F.floor(F.col("i") / 7), [F.col("i")], ["v"], ["v"], lambda p: F.col("v") < p["v"], "run").collect()
    for k in "ab":
        mine, run, prev = sorted((r["i"], r["v"], r["run"]) for r in numbered if r["k"] == k), 0, None
        for _, v, n in mine:
            run += prev is None or v < prev
            assert n == run
            prev = v


def test_upper_median(spark):
    df = spark.createDataFrame([("a", x) for x in (3.0, 1.0, 2.0, 2.0)] + [("b", 5.0)], "k string, v double")
    assert {r["k"]: r["m"] for r in upper_median(df, ["k"], "v", "m").collect()} == {"a": 2.0, "b": 5.0}


def page(rows):
    """(page, y0, text, ratio, bold, x0) rows of one book."""
    return [(1, p, i + 1, t, x, y, x + 100.0, y + 10.0, r, b) for i, (p, y, t, r, b, x) in enumerate(rows)]


LINE = "book_id long, page_no long, line_no long, text string, x0 double, y0 double, x1 double, y1 double, ratio double, bold boolean"


def test_scanner_precedence_and_whole_text(spark):
    rows = page([
        (1, 10.0, "Chapter One", 1.6, False, 72.0), (1, 30.0, "It was a hyphen-", 1.0, False, 72.0), (1, 42.0, "ated start", 1.0, False, 72.0),
        (1, 54.0, "and the end.", 1.0, False, 72.0), (1, 66.0, "• first", 1.0, False, 72.0), (1, 78.0, "goes on", 1.0, False, 90.0),
        (1, 90.0, "1. second", 1.0, False, 72.0), (1, 120.0, "a  b  c", 1.0, False, 72.0), (1, 132.0, "d  e  f", 1.0, False, 72.0),
        (1, 144.0, "g  h  i", 1.0, False, 72.0), (1, 160.0, "Example 1: find x", 1.0, False, 72.0), (1, 172.0, "Solution: four", 1.0, False, 72.0),
        (2, 10.0, "Example 2: more", 1.0, False, 72.0),
    ])
    df = spark.createDataFrame(rows, LINE)
    got = [(r["block_type"], r["text"]) for r in sorted(blocks.scan_blocks(df).collect(), key=lambda r: (r["first_page"], r["first_line"]))]
    assert got == [
        ("heading", "Chapter One"), ("paragraph", "It was a hyphenated start and the end."), ("list", "• first\ngoes on\n1. second"),
        ("table", "a  b  c\nd  e  f\ng  h  i"), ("example", "Example 1: find x\nSolution: four"), ("example", "Example 2: more"),
    ]


def states(rows, rules):
    """Block of every line by a machine whose state is the kind of the open block."""
    rows = [dict(zip([c.split()[0] for c in LINE.split(", ")], r)) for r in rows]
    cells = [len([c for c in re.split(r"\s{2,}|\t+", r["text"].strip()) if c]) for r in rows]
    section = tuple(m.lower() for m in rules.example + rules.activity + rules.exercise)
    out, state = [], None
    for i, r in enumerate(rows):
        p, text, low = rows[i - 1] if i else None, r["text"], r["text"].lower()
        item, short = bool(re.match(blocks.LIST_ITEM, text)), len(text) < 70
        goes_on = False
        if p:
            gap, same = r["y0"] - p["y1"], r["page_no"] == p["page_no"]
            height = sum(max(1.0, x["y1"] - x["y0"]) for x in (r, p)) / 2
            goes_on = {
                "table": cells[i] >= rules.table_min_cols,
                "list": item or (r["x0"] > p["x0"] + rules.list_indent and gap < rules.list_gap),
                "callout": not (r["ratio"] >= rules.heading_2_ratio and short or low.startswith(section) or same and gap > rules.callout_gap),
                "paragraph": not (
                    r["page_no"] - p["page_no"] > 1 or r["ratio"] >= rules.heading_3_ratio and short and not text.endswith(".") or low.startswith(section)
                    or same and gap > height * rules.max_line_gap_ratio or p["text"][-1:] in tuple(".!?:") and not text[:1].islower()
                ),
            }.get(state, False)
        if goes_on:
            out[-1][3].append(r)
            continue
        run = list(itertools.takewhile(lambda n: n >= rules.table_min_cols, cells[i:]))
        named = [k for k, ms in rules.markers().items() if low.startswith(tuple(m.lower() for m in ms))]
        if any(run.count(n) >= rules.table_min_rows for n in run):
            state, kind = "table", "table"
        elif item:
            state, kind = "list", "list"
        elif not text.endswith(".") and (r["ratio"] >= rules.heading_3_ratio and len(text) < 80 or r["bold"] and short):
            state, kind = "heading", "heading"
        elif named:
            state, kind = "callout", named[0]
        else:
            state, kind = "paragraph", "paragraph"
        out.append((r["page_no"], r["line_no"], kind, [r]))
    return [(p, n, kind, len(lines), {x["page_no"] for x in lines}) for p, n, kind, lines in out]


@pytest.mark.parametrize("chunk", [512, 7, 1])
def test_scanner_equals_state_machine(spark, monkeypatch, chunk):
    monkeypatch.setattr(blocks, "CHUNK", chunk)
    rnd = random.Random(11)
    texts = ["Example a", "Note b", "• item", "(a) item", "x  y", "x  y  z", "x  y", "plain text.", "plain text", "lower", "Activity c", "Big head", "ends-"]
    rows, y, p = [], 10.0, 1
    for _ in range(800):
        y += rnd.choice([11.0, 14.0, 22.0, 40.0, 60.0])
        if y > 700:
            y, p = 10.0, p + rnd.choice([1, 1, 2])
        rows.append((p, y, rnd.choice(texts), rnd.choice([1.0, 1.0, 1.0, 1.1, 1.3, 1.5]), rnd.random() < 0.1, rnd.choice([72.0, 72.0, 90.0])))
    rows = page(rows)
    got = blocks.scan_blocks(spark.createDataFrame(rows, LINE))
    assert sorted(r["block_no"] for r in got.collect()) == list(range(1, got.count() + 1))
    found = sorted((r["first_page"], r["first_line"], r["block_type"], r["n_lines"], set(r["pages"])) for r in got.collect())
    assert found == sorted(states(rows, Rules()))
    assert sum(b[3] for b in found) == len(rows)


def test_scanner_on_a_long_book_without_a_break(spark):
    """One block after another over 200,000 lines, none of which stands under a gap, and a list that spans many chunks."""
    n = F.col("id")
    lines = spark.range(200_000).select(
        F.lit(1).cast("long").alias("book_id"), F.floor(n / 40).alias("page_no"), (n + 1).alias("line_no"),
        F.when(n.between(50_000, 120_000), "• item").when((n % 7 == 0) | (n == 49_999), "ends here.").otherwise("goes on").alias("text"),
        F.lit(72.0).alias("x0"), (n % 40 * 12.0).alias("y0"), F.lit(300.0).alias("x1"), (n % 40 * 12.0 + 10).alias("y1"),
        F.lit(1.0).alias("ratio"), F.lit(False).alias("bold"),
    )
    got = blocks.scan_blocks(lines).groupBy("block_type").agg(F.count("*").alias("n"), F.max("n_lines").alias("longest"), F.sum("n_lines").alias("lines"))
    found = {r["block_type"]: (r["n"], r["longest"], r["lines"]) for r in got.collect()}
    assert found["list"] == (1, 70_001, 70_001) and found["paragraph"][2] == 129_999 and set(found) == {"list", "paragraph"}


def test_script_merge(spark):
    spans = [
        (1, 1, 1, 1, "x", 10.0, 0.0, 5.0, 100.0), (1, 1, 1, 2, "2", 6.0, 5.5, 8.0, 96.0), (1, 1, 1, 3, " + a", 10.0, 8.0, 20.0, 100.0),
        (1, 1, 1, 4, "n", 6.0, 20.5, 23.0, 103.0), (1, 1, 2, 1, "word", 10.0, 0.0, 20.0, 100.0), (1, 1, 2, 2, "far", 6.0, 40.0, 50.0, 96.0),
    ]
    df = spark.createDataFrame(spans, "book_id long, page_no long, line_no long, span_no long, text string, size double, x0 double, x1 double, origin_y double")
    got = sorted((r["line_no"], r["out_no"], r["text"], r["latex"], r["raw_text"]) for r in blocks.merge_scripts(df).collect())
    assert got == [(1, 1, "x^2", "x^{2}", "x2"), (1, 2, " + a_n", " + a_{n}", " + an"), (2, 1, "word", None, "word"), (2, 2, "far", None, "far")]


def test_words_of_long_lines_are_placed(spark):
    """Lines are cut into pieces; words, numbers and lengths before them are those of the whole line, blanks in a row included."""
    from folio.sources.views import line_words

    texts = ["a", "", "ab  c", " " * 7, " ".join("x" * (i % 5) for i in range(20)), "é bb ccc dddd"]
    df = spark.createDataFrame(list(enumerate(texts)), "line_no long, text string")
    want = [(k, i, w, len(" ".join(t.split(" ")[:i]))) for k, t in enumerate(texts) for i, w in enumerate(t.split(" "))]
    for piece in (1, 3, 64):
        assert sorted((r.line_no, r.i, r.word, r.before) for r in line_words(df, piece).collect()) == sorted(want)
