"""Vectors, pages, tool calls and the pipeline against brute force."""

import json
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from folio.llm import html, tool_calls, vectors
from test_llm_text import documents, corpus, reach, smallest  # noqa: F401


def some_vectors(seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(60):
        base = rng.normal(size=16)
        rows.append((3 * i, base.tolist(), i % 3))
        for k in range(rng.integers(0, 4)):
            rows.append((3 * i + 1000 + k * 7, (base + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.3])).tolist(), i % 3))
    hot = rng.normal(size=16).astype(np.float32).tolist()
    rows += [(5000 + i, hot, 1) for i in range(50)] + [(5100, [2 * x for x in hot], 1), (5101, hot, 2)]
    rows += [(6000, None, 1), (6001, [], 1), (6002, [0.0] * 16, 1), (6003, [float("nan")] * 16, 1), (6004, [float("inf")] + [0.0] * 15, 1)]
    rows += [(6005, hot, None), (6006, [None] + hot[1:], 1), (6007, hot[:8], 1), (6008, hot[:8], 1)]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]


@pytest.mark.parametrize("block", [2048, 7])
def test_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = some_vectors()
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, rep_id int, block int")

    def usable(v):
        return bool(v) and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0

    def linked(a, b):
        (_, u, x), (_, v, y) = rows[a], rows[b]
        if x is None or x != y or not usable(u) or not usable(v) or len(u) != len(v):
            return False
        u, v = np.array(u), np.array(v)
        return u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93

    links = Counter()
    for a in range(len(rows)):
        for b in range(a):
            if linked(a, b):
                links[a] += 1
                links[b] += 1
    want = smallest([r[0] for r in rows], reach(len(rows), linked))
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(frame).collect()}
    assert got == {(r[0], links[k], want[k], want[k] == r[0]) for k, r in enumerate(rows)}
    assert vectors.near_vectors(frame.limit(0)).collect() == []


def test_bounds_hold_and_products_are_exact():
    rng = np.random.default_rng(1)
    u = rng.normal(size=(50, 2100))
    u /= np.linalg.norm(u, axis=1)[:, None]
    codes, scale, coded, rest = vectors.quantise(u)
    exact = codes.astype(np.int64) @ codes.astype(np.int64).T
    assert (vectors.code_products(codes, codes) == exact).all()
    bound = coded[:, None] * rest + rest[:, None] * coded + rest[:, None] * rest
    assert (np.abs(u @ u.T - exact * scale[:, None] * scale) <= bound + 1e-12).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x = "</p><p>no";</script></head><body class="has-sidebar">
<header class="site"><a href="/">Site name</a></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div id="wrap"><div class="cookie-notice"><p>We use cookies on this site and everywhere else too.</p></div>
<div class="content-{n}"><header><h1>Head &lt;{n}&gt;</h1><span>by me</span></header><p>First   para &amp; more<br>text that is rather long indeed, {n}.
<div class="ad-slot"><p>Buy now</p></div><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><p>Second <i>para</i>graph.
<form><p>Sign up</p></form><aside>Aside</aside></div><section id="comments"><p>a reader's comment that goes on and on and on and on and on and on</p></section>
<div class="right"><p>short</p></div></div><footer>&copy; foot</footer></body></html>"""


def test_pages(spark):
    text = "First para & more text that is rather long indeed, {n}.\none\ntwo\nc1\nc2\nSecond paragraph."
    rows = [(n, f"https://User@Host.example:80/{n}", PAGE.format(n=n)) for n in range(9)]
    # A page of the same host whose longest text is elsewhere: the host's path wins.
    odd = PAGE.format(n=77).replace('<div class="right"><p>short', '<div class="right"><p>' + "long words " * 80)
    rows += [(77, "https://host.example/odd", odd), (100, "https://host.example/x", None), (101, None, ""), (102, "nonsense", "<p>alone &am"), (None, "https://b.example/", "<article><p>x</p>")]
    rows += [(103, "https://host.example/y", "<body><div class='content-1'><p>" + "w &nbsp;&#233;" * 50_000), rows[0]]
    frame = spark.createDataFrame([(*r, "t", 5, ["p"]) for r in rows], "page_id long, url string, html string, text string, host int, paths array<string>")
    got = html.main_text(frame).collect()
    found = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    for n in [*range(9), 77]:
        assert found[n].text == text.format(n=n)
    assert found[100].text == found[101].text == "" and found[102].text == "alone &am" and found[None].text == "x"
    assert found[103].text == " ".join(["w"] + ["éw"] * 49_999 + ["é"])
    assert all(r.n_chars == len(r.text) for r in got)
    assert html.main_text(frame.limit(0)).collect() == []


def test_boilerplate_with_article_and_broken_markup():
    page = "<body><article><header><h2>Kept</h2><p>byline</p></header><p>A<b>b<p>C</b> d</p></span><!-- <p>no --><textarea><p>x</textarea>E</article><p>out</p>"
    assert html.extract(page, None)[0] == "Kept\nAb\nC d\nE"
    assert html.extract("<div><p>one<div hidden><p>two</div><p role=navigation>three<p>four", None)[0] == "one\nfour"


def test_links_orders_and_validates(spark):
    tool = {"add": {"type": "object", "properties": {"x": {"type": "integer", "minimum": 0}, "y": {"enum": [1, "é"]}, "z": {"type": "array", "items": {"type": "string"}, "maxItems": 1}}, "required": ["x"], "additionalProperties": False}}

    def call(i, name="add", after=(), **arguments):
        return {"id": i, "name": name, "arguments": arguments, "after": list(after)}

    turns = [
        (1, 1, "assistant", {"tool_calls": [call("c", after=["a", "b"], x=1), call("a", x=2, y="é")]}),
        (1, 2, "tool", {"tool_call_id": "a", "content": "A"}),
        (1, 3, "assistant", {"tool_calls": [call("b", x=-1, z=["q", 3]), call("d", name="none")]}),
        (1, 4, "tool", {"tool_call_id": "a", "content": "again"}),
        (1, 5, "tool", {"tool_call_id": "zz", "content": "who"}),
        (2, 1, "assistant", {"tool_calls": [call("p", after=["q"], x=1), call("q", after=["p"], x=1), call("r", after=["gone"], x=1)]}),
        (2, 2, "assistant", "plain text"), (2, 3, "user", None), (None, 0, "assistant", {"tool_calls": [call(None, x=1)]}), (3, None, "tool", {"tool_call_id": None, "content": "x"}),
    ]
    rows = [(c, t, r, json.dumps(m) if isinstance(m, dict) else m, 1) for c, t, r, m in turns]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position int")
    calls, results = tool_calls.from_messages(frame)
    got = {(r.conv_id, r.call_id, r.status): r for r in tool_calls.link(calls, results, tool).collect()}
    order = {k[1]: r.position for k, r in got.items() if k[0] == 1 and r.position}
    assert sorted(order.values()) == [1, 2, 3, 4] and order["c"] > max(order["a"], order["b"])
    a = got[1, "a", "answered"]
    assert a.valid and a.record == '{"arguments":{"x":2,"y":"é"},"id":"a","name":"add","position":%d,"result":"A"}' % a.position
    assert got[1, "b", "unanswered"].errors == "$.x: out of range; $.z[1]: not of type string; $.z: bad length"
    assert got[1, "d", "unanswered"].errors == "unknown tool" and not got[1, "zz", "orphan"].valid
    assert "cycle" in got[2, "p", "unanswered"].errors and "cycle" in got[2, "q", "unanswered"].errors
    assert got[2, "r", "unanswered"].errors == "after: 1 missing" and got[None, None, "unanswered"].valid
    assert (3, None, "orphan") in got
    none = tool_calls.from_messages(frame.limit(0))
    assert tool_calls.link(*none, tool).collect() == []


def test_topological_order_random():
    rnd = random.Random(2)
    for _ in range(50):
        n = rnd.randint(1, 12)
        secret = rnd.sample(range(n), n)
        edges = [(secret[i], secret[j]) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.3]
        order, stuck = tool_calls.kahn(list(range(n)), edges)
        place = {c: i for i, c in enumerate(order)}
        assert not stuck and all(place[a] < place[b] for a, b in edges)
    assert tool_calls.kahn([1, 2, 3], [(1, 2), (2, 1), (2, 3)]) == ([1, 2, 3], {1, 2, 3})


def test_canonical_json():
    assert tool_calls.canonical({"b": [1, 2.5, None, True], "a": "é\n\" "}) == '{"a":"é\\n\\" ","b":[1,2.5,null,true]}'
    assert tool_calls.parsed('{"a": NaN}')[1] is False and tool_calls.parsed(None) == (None, False)
    assert tool_calls.parsed("[" * 100_000)[1] is False


def test_pipeline_stages_and_result(spark, tmp_path):
    from test_llm_text import slow_fingerprint

    rows = [r for r in corpus() if r[0] is not None][:-1]
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.cut(stage(spark, docs, str(tmp_path)), "test")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        kept[name] = [r.doc_id for r in out.collect()]
        docs = out
    text = {i: t for i, t, *_ in rows}
    clean = kept["language_id"]
    assert set(text) - set(clean) == {400, 401, 402, 403}
    first = {}
    for i in sorted(clean):
        first.setdefault(" ".join(text[i].split()), i)
    assert sorted(kept["exact_dedup"]) == sorted(first.values())
    ids = sorted(kept["exact_dedup"])
    prints = [slow_fingerprint(text[i]) for i in ids]
    roots = smallest(ids, reach(len(ids), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4))
    assert sorted(kept["near_dedup"]) == sorted(set(roots))
    assert set(kept["mix_sources"]) <= set(kept["near_dedup"]) and max(Counter(kept["mix_sources"]).values()) <= 2
    assert set(kept["pack_sequences"]) == set(kept["mix_sources"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["pack_sequences"])


def test_every_corpus_query_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{n}" for n in range(1, 11)} and "pipeline" in names


def edited(rnd, words, n):
    """`words` with n of them replaced."""
    places = set(rnd.sample(range(len(words)), n))
    return [f"new{rnd.random()}" if i in places else w for i, w in enumerate(words)]


def test_near_stage_equals_all_pairs(spark):
    from test_llm_text import slow_fingerprint

    rnd = random.Random(8)
    texts = []
    for k in range(40):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([4, 12, 100, 400]))]
        texts += [" ".join(base)] + [" ".join(edited(rnd, base, round(len(base) * rnd.uniform(0.005, 0.035)))) for _ in range(4)]
    line = " ".join(f"line{i}" for i in range(30))
    texts += [f"{line} {' '.join(str(rnd.random()) for _ in range(n))}" for n in (2, 2, 3, 4, 5, 6, 7, 40, 90)]
    hot = [f"h{i}" for i in range(200)]
    texts += [" ".join(edited(rnd, hot, 2)) for _ in range(60)] + ["", None, " ", "Ä b", "ä B"]
    rnd.shuffle(texts)

    def grams(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets = [grams(t) for t in texts]
    prints = [slow_fingerprint(t) for t in texts]

    def bag(text):
        words = (text or "").lower().split()
        return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))

    bags = [bag(t) for t in texts]

    def linked(a, b):
        if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
            return True
        # Near fingerprints link only texts that are alike when repeated shingles count.
        return (prints[a] ^ prints[b]).bit_count() <= 4 and 9 * (bags[a] & bags[b]).total() >= 4 * (bags[a].total() + bags[b].total())

    want = sorted(set(smallest(list(range(len(texts))), reach(len(texts), linked))))
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    kept = corpus_pipeline.near_stage(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == want
    assert corpus_pipeline.near_stage(spark, docs.limit(0), "").collect() == []


def test_stages_keep_rows_without_or_with_repeated_ids(spark):
    from test_llm_text import LANGS

    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(LANGS["en"]) + rnd.choice(["", "a", "ing"]) for _ in range(60)) for _ in range(30)]
    ids = [None] * 10 + [5] * 10 + list(range(100, 110))
    rows = list(zip(ids, texts))
    # Copies without an identifier, with one that others have, and junk under identifiers of good rows.
    rows += [(None, texts[25]), (None, texts[3]), (5, texts[12]), (5, texts[2]), (None, "12 34"), (5, "!!"), (101, None)]
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows])
    clean = corpus_pipeline.language_stage(spark, docs, "")
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(rows[:-3])
    want = Counter((5 if t == texts[2] else i, t) for i, t in rows[:30])
    exact = corpus_pipeline.exact_stage(spark, clean, "")
    assert Counter((r.doc_id, r.text) for r in exact.collect()) == want
    near = corpus_pipeline.cut(corpus_pipeline.near_stage(spark, exact, ""), "test")
    assert Counter((r.doc_id, r.text) for r in near.collect()) == want
    mixed = Counter((r.doc_id, r.text) for r in corpus_pipeline.mix_stage(spark, near, "").collect())
    # One source of 1,800 words, a budget of one and a half times that: every row once, half of them twice.
    assert set(mixed) == set(want) and sorted(mixed.values()) == [1] * 15 + [2] * 15


def test_pipeline_on_the_full_fixture(spark, tmp_path):
    rows = corpus()
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert None in found and 7 in found and not found & {401, 402, 403}


def test_bucket_pass_in_any_batches():
    """Buckets of two or more rows, however the rows are cut into batches."""
    import pyarrow as pa

    from folio.llm import overlap

    rnd = random.Random(3)
    for round_ in range(300):
        rows = sorted((rnd.choice([1, 2, 3, 4, 5, overlap.HOT_BIT | 4]), rnd.randrange(2), node, 0, 0, 0) for node in range(rnd.randint(0, 12)))
        sizes = Counter(r[:2] for r in rows)
        want = [r for r in rows if sizes[r[:2]] > 1 or r[0] & overlap.HOT_BIT]
        cuts = sorted(rnd.randint(0, len(rows)) for _ in range(rnd.randint(0, 6)))
        parts = [rows[i:j] for i, j in zip([0, *cuts], [*cuts, len(rows)])]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in p], pa.int64()) for k in range(6)], list("abcdef")) for p in parts]
        got = [tuple(r.values()) for b in overlap._shared(iter(batches)) for r in b.to_pylist()]
        assert got == want, round_


def test_near_stage_with_hot_shingles(spark, monkeypatch):
    """Boilerplate in most texts, dealt to several tasks; near copies among them and clean texts around."""
    from folio.llm import overlap

    monkeypatch.setattr(overlap, "HOT", 0.0003)
    rnd = random.Random(9)
    common = [f"c{i}" for i in range(60)]
    texts = []
    for k in range(90):
        own = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([0, 1, 2, 4, 8, 40]))]
        texts.append(" ".join(common[: rnd.choice([50, 55, 60])] + own))
    rnd.shuffle(texts)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]

    def linked(a, b):
        return 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))

    want = sorted(set(smallest(list(range(len(texts))), reach(len(texts), linked))))
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    assert sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect()) == want


def test_stages_with_clashing_columns_and_without_labels(spark):
    from pyspark.sql import functions as F

    from test_llm_text import LANGS

    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(LANGS["en"]) + rnd.choice(["", "a", "ing"]) for _ in range(40)), "en", "a") for i in range(20)]
    rows += [(50, rows[3][1] + " more", "en", "a"), (51, rows[4][1], "en", None), (52, None, "en", "a"), (53, "12", None, "b")]
    docs = documents(spark, rows)
    names = "_row row _time _times time times row_no row_id one two node root keeper kept rows n_chars at bucket prefix leader task turn".split()
    wide = docs.select("doc_id", "text", "lang", "source", *[F.concat(F.lit(f"{n}:"), F.col("doc_id")).alias(n) for n in names])
    for stage in (corpus_pipeline.language_stage, corpus_pipeline.exact_stage, corpus_pipeline.near_stage, corpus_pipeline.mix_stage):
        out = corpus_pipeline.cut(stage(spark, wide, ""), "test")
        assert out.columns == wide.columns
        found = out.collect()
        assert found and all(r[n] == f"{n}:{r.doc_id}" for r in found for n in names)
        assert stage(spark, wide.limit(0), "").collect() == []
        wide = out
    assert corpus_pipeline.pack_stage(spark, wide, "").count() >= 20
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r.doc_id for r in corpus_pipeline.language_stage(spark, bare, "").collect()) == [*range(20), 50, 51]


def test_near_stage_joins_a_single_text_to_a_group_in_one_pair(spark, monkeypatch):
    """Each bucket's first set is a fragment unlike all others, so group and late texts meet only pair by pair; the pairs verified stay near the number of texts."""
    from folio.llm import overlap

    tried = []
    whole = overlap.verified

    def counted(pairs, nodes, docs):
        pairs = overlap.cut(pairs, "counted")
        tried.append(pairs.count())
        return whole(pairs, nodes, docs)

    monkeypatch.setattr(overlap, "verified", counted)
    common = [f"c{i}" for i in range(120)]
    texts = [" ".join([*common, *[f"w{k}x{i}" for i in range(8)]]) for k in range(40)]
    texts += [" ".join(common[i : i + 5]) for i in range(len(common) - 4)]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    kept = sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect())
    assert kept == [0, *range(40, len(texts))]
    assert sum(tried) < 4 * 40
