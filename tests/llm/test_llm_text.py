"""Fingerprints, exact groups, languages, scores, packing and mixing against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from folio.llm import components, exact_dedup, language, lm, mixing, packing, reshard, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, run int, size long, row_id long, fp long, _slab int, word string"
LANGS = {
    "en": "the of and to in is that it for on with as this was by from are which where".split(),
    "de": "der die und das ist nicht mit sich auf für eine werden auch über größe straße".split(),
    "el": "και το της είναι στην από που για με δεν αυτό θα να οι τα".split(),
}


def documents(spark, rows):
    """A documents table whose extra columns clash with names used inside."""
    full = [(i, t, lang, s, len(t or ""), "x", 1, 2, 3, 4, 5, "w") for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def corpus(seed=5, n=120):
    """Texts in three languages with exact and near copies, hot groups, nulls, blanks, and a long one."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rnd.choice(list(LANGS))
        text = " ".join(rnd.choice(LANGS[lang]) + rnd.choice(["", "", "a", "ber", "ing"]) for _ in range(rnd.choice([1, 3, 30, 200])))
        rows.append((i, text, lang, rnd.choice(["a", "b", "c", None, "ß"])))
    hot = " ".join(LANGS["en"] * 20)
    rows += [(200 + i, hot, "en", "a") for i in range(60)]
    rows += [(300 + i, hot.replace("which", f"w{i}", 1), "en", "a") for i in range(20)]
    rows += [(400, None, "en", "b"), (401, "", None, None), (402, " \t\n", "de", "c"), (403, "12 34 !!", "de", "c"), (404, hot.replace(" ", "\n\n"), "en", "a")]
    rows += [(405, "the of and " * 20_000, "en", "b"), (None, "no identifier here", "en", "a"), (7, rows[7][1], rows[7][2], rows[7][3])]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return documents(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


def test_exact_groups(docs, rows, empty):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    got = [tuple(r) for r in exact_dedup.exact_groups(docs).collect()]
    assert Counter(got) == Counter(want)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({min((i for i in ids if i is not None), default=None) for ids in groups.values()})
    assert exact_dedup.exact_groups(empty).collect() == [] and exact_dedup.keep_first(empty).collect() == []


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                root[find(a)] = find(b)
    return [find(x) for x in range(n)]


def smallest(ids, roots):
    low = {}
    for i, r in zip(ids, roots):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return [low.get(r) for r in roots]


@pytest.mark.parametrize("tile", [2048, 3])
def test_simhash_components(docs, rows, empty, monkeypatch, tile):
    monkeypatch.setattr(simhash.tiled, "__defaults__", (tile,))
    prints = [slow_fingerprint(t) for _, t, *_ in rows]
    want = smallest([r[0] for r in rows], reach(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4))
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_groups(docs).collect()]
    assert Counter(got) == Counter(zip([r[0] for r in rows], prints, want))
    assert simhash.near_groups(empty).collect() == []


def test_simhash_keeps_one_of_each_group(docs, rows):
    once = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    kept = simhash.keep_representatives(once)
    assert kept.columns == docs.columns
    want = {r.component_id for r in simhash.near_groups(once).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_tree_search_equals_scan():
    rnd = random.Random(1)
    centres = [rnd.getrandbits(64) for _ in range(5)]
    values = list({c ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(5))) % (1 << 64) for c in centres for _ in range(40)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values:
        assert sorted(tree.within(v, 4)) == [i for i, x in enumerate(values) if (x ^ v).bit_count() <= 4]


def test_near_fingerprints_share_a_bucket(spark):
    rnd = random.Random(2)
    pairs = []
    for _ in range(200):
        v = rnd.getrandbits(64)
        w = v
        for b in rnd.sample(range(64), 4):
            w ^= 1 << b
        pairs.append((v, w))
    signed = [x - (1 << 64) if x >> 63 else x for pair in pairs for x in pair]
    found = defaultdict(set)
    for r in simhash.bucket_rows(spark.createDataFrame([(x,) for x in signed], "fp long")).collect():
        found[r.fp].add(r.bucket)
    assert all(found[signed[2 * i]] & found[signed[2 * i + 1]] for i in range(len(pairs)))


def test_components_of_chains_hubs_and_nothing(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000 + i, 1999) for i in range(50)]
    edges = spark.createDataFrame([*chain, *hub, (5, 5), (61, 60), (61, 60)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(62)}, **{1000 + i: 1000 for i in range(50)}, 1999: 1000}
    assert components.components(edges.limit(0)).collect() == []


def test_languages_of_held_out_and_mixed_texts(spark, docs, rows, empty):
    found = language.identify(docs).collect()
    assert len(found) == len(rows)
    by_id = {r[0]: r for r in rows}
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i in by_id if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    judged = [r for r in held if by_id[r.doc_id][2] and r.lang_pred != "und"]
    assert sum(r.lang_pred == by_id[r.doc_id][2] for r in judged) >= 0.95 * len(judged)
    assert {r.doc_id for r in found if r.lang_pred == "und"} == {400, 401, 402, 403}
    assert all(0 <= r.score <= 1 for r in found)
    kept = language.keep_identified(docs.dropDuplicates(["doc_id"]))
    assert kept.columns == docs.columns and {400, 401, 402, 403}.isdisjoint(r.doc_id for r in kept.collect())
    assert language.identify(empty).collect() == []
    unlabelled = documents(spark, [(1, "the of", None, None)])
    assert [(r.lang_pred, r.score) for r in language.identify(unlabelled).collect()] == [("und", 0.0)]


def test_spans_of_a_mixed_text(docs):
    languages, table, allowed = language.fit(docs.filter("lang is not null and text is not null"))
    scorer = language.Scorer(table, allowed)
    text = " ".join([*LANGS["en"], *LANGS["de"], *LANGS["el"]])
    spans = language.spans(text, languages, scorer)
    assert [s[0] for s in spans] == ["en", "de", "el"]
    assert sum(s[2] for s in spans) == len(text.split())
    assert language.spans("12 !", languages, scorer) == []


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(3)
    lengths = np.array([4, 1, 6])
    scores = rng.normal(0, 2, (lengths.sum(), 3)).astype(np.float32)
    path = language.viterbi(scores, lengths, 1.5)
    at = 0
    for n in lengths:
        best = max(
            (sum(scores[at + i, s] for i, s in enumerate(c)) - 1.5 * sum(a != b for a, b in zip(c, c[1:])), c)
            for c in (tuple((k // 3**i) % 3 for i in range(n)) for k in range(3**n))
        )
        assert tuple(path[at : at + n]) == best[1]
        at += n


def test_scores_base_and_normalised(docs, rows, empty):
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows]
    tokens = [[*lm.words_of(t), None] for _, t, *_ in rows]
    counts = Counter(w for ts, h in zip(tokens, held) if not h for w in ts)
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for (i, *_), h, ts in zip(rows, held, tokens):
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ts)
        want[i, h, len(ts), sum(counts[w] > 0 for w in ts), n, round(base, 4)] += 1
    found = lm.score_texts(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found) == want
    held_rows = [r for r in found if r.held_out]
    assert sum(r.score for r in held_rows) > sum(r.base_score for r in held_rows)
    assert lm.score_texts(empty).collect() == []


def test_rare_words_meet_their_counts_by_shuffle(docs, monkeypatch):
    whole = {(r.doc_id, r.n_tokens): (r.n_known, r.base_score) for r in lm.score_texts(docs).collect()}
    monkeypatch.setattr(lm, "HEAD", 5)
    for r in lm.score_texts(docs).collect():
        known, base = whole[r.doc_id, r.n_tokens]
        assert r.n_known == known and abs(r.base_score - base) < 1e-6


def test_head_words_are_the_commonest(spark):
    rows = [(f"w{i}", 1 + i // 3) for i in range(300)]
    counts = spark.createDataFrame(rows, "word string, c long")
    for most in (0, 1, 5, 40, 1000):
        head = lm.head_words(counts, most)
        assert len(head) <= most and list(head.values()) == sorted(head.values(), reverse=True)
        assert min(head.values(), default=10**9) >= max((c for w, c in rows if w.encode() not in head), default=0)
    assert len(lm.head_words(counts, 1000)) == 300


def test_model_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    model = lm.Model(rng.dirichlet(np.ones(lm.SYMBOLS)) + 1e-9)
    trainer = lm.Trainer(model)
    trainer.learn(lm.sequence([rng.integers(0, lm.SYMBOLS, 3000).tolist()]))
    z = model.log_normalisers()
    first, second = (model.inputs @ p for p in model.places)
    for a, b in ((3, 5), (lm.START, lm.START), (0, lm.END)):
        energy = (first[a] + second[b]) @ model.outputs.T + model.bias
        assert abs(np.exp(energy - z[a, b]).sum() - 1) < 1e-3


def test_training_learns_what_follows():
    symbols = [[1, 2, 3] * 400]
    unigram = np.full(lm.SYMBOLS, 1e-4)
    unigram[1:4] = 1
    model = lm.Model(unigram / unigram.sum())
    trainer = lm.Trainer(model)
    for _ in range(30):
        trainer.learn(lm.sequence(symbols))
    first, second = (model.inputs @ p for p in model.places)
    energy = (first[1] + second[3]) @ model.outputs.T + model.bias
    assert energy.argmax() == 2


def test_word_class_is_the_same_in_spark(spark):
    from pyspark.sql import functions as F

    words = ["a", "ab", "straße", "größe", "日本語", "x!"]
    got = spark.createDataFrame([(w,) for w in words], "word string").select("word", lm.class_column(F.col("word")).alias("c")).collect()
    assert {r.word: r.c for r in got} == {w: lm.word_class(w.encode()) for w in words}


TEXTS = [
    "", " ", "a", " a", "a  b", "a \n b", "a\n", "a \n", "x <|endoftext|> y", "<|endoftext|>", "don't  you're", "日本 語 テスト", "é è 12 3,4 !!", "a b ",
    "  a b", "\ta b\t", "a b\tc", "x\x1c y\x1fz", "a \x85b", "it's we'll 'sup", "😀 😀x", "a　b  c", "one two  three four\n\n five \n", "ﬁ ǆ ɏ ɐ",
]


def test_encoder_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = packing.Encoder()
    rnd = random.Random(4)
    mixed = ["".join(rnd.choice(["a", "é", " ", "  ", "\n", "'s", "9", "!", "ß", "<|endoftext|>", "語", "\xa0"]) for _ in range(rnd.randrange(40))) for _ in range(400)]
    for text in [*TEXTS, *TEXTS, *mixed]:
        assert np.frombuffer(fast.encode(text), "<u4").tolist() == slow.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_round_trip(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        at = 0
        for number, length in enumerate([first] + [2048] * ((len(ids) - first) // 2048)):
            want[i, number, at, length, zlib.crc32(ids[at : at + length].tobytes())] += 1
            at += length
    got = packing.packed_documents(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == math.ceil(sum(r.length for r in got) / 2048)
    assert packing.packed_documents(empty).collect() == []


def test_local_search_empties_bins_and_keeps_pieces():
    lengths = [60, 60, 40, 30, 30, 50, 50, 20, 20, 20]
    start = [[0], [1], [2], [3], [4], [5], [6], [7, 8], [9]]
    bins = packing.local_search([list(b) for b in start], lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(10))
    assert all(sum(lengths[i] for i in b) <= 100 for b in bins)
    assert len(bins) == 4
    # One for one: 40 takes the place of 25 beside 60. Two for one: 25 and 15 take the place of 20.
    for lengths, start in (([60, 25, 70, 40, 5], [[0, 1], [2], [3, 4]]), ([60, 20, 80, 25, 15], [[0, 1], [2], [3, 4]])):
        bins = packing.local_search(start, lengths, 100)
        assert sorted(sum(lengths[i] for i in b) for b in bins) == [100, 100]


def test_pools_leave_whole_sequences(spark, monkeypatch):
    monkeypatch.setattr(packing, "POOL", 16)
    rnd = random.Random(6)
    lengths = [(i, rnd.randint(1, 2048)) for i in range(300)] + [(300 + i, 2048) for i in range(3)]
    got = packing.pack(spark.createDataFrame(lengths, "piece_no long, length long")).collect()
    size, fill = dict(lengths), Counter()
    for r in got:
        fill[r.sequence_id] += size[r.piece_no]
    assert sorted(r.piece_no for r in got) == sorted(size) and max(fill.values()) <= 2048
    assert len(fill) <= 1.1 * sum(size.values()) / 2048


def slow_targets(sizes):
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    capped, open_ = {}, set(sizes)
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(capped.values())
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > 2 * sizes[s]}
        if not over:
            return capped | {s: rest * weight[s] / total for s in open_}
        capped |= {s: 2 * sizes[s] for s in over}
        open_ -= over


def test_mixing_meets_targets_and_repeats(docs, rows, empty):
    sizes, largest = Counter(), Counter()
    for _, t, _, s in rows:
        n = len(WORD.findall(t or ""))
        sizes[s] += n
        largest[s] = max(largest[s], n)
    want = slow_targets(sizes)
    queued = mixing.queued(docs)
    entries, keyed = mixing.mix(queued)
    taken = entries.groupBy("row_id").agg({"size": "sum"}).withColumnRenamed("sum(size)", "taken")
    found = keyed.join(taken, "row_id", "left").collect()
    assert len(found) == len(rows)
    got = Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert (r.taken or 0) in (0, r.size, 2 * r.size)
        got[r.source] += r.taken or 0
    for s, target in want.items():
        assert abs(got[s] - target) <= 2 * largest[s]
    assert sum(got.values()) <= 1.5 * sum(sizes.values())
    again, _ = mixing.mix(mixing.queued(docs))
    assert Counter((r.doc_id, r.epoch, r.position) for r in again.collect()) == Counter((r.doc_id, r.epoch, r.position) for r in entries.collect())
    assert mixing.mix(mixing.queued(empty))[0].collect() == []


def test_mixed_documents_repeat_rows(docs):
    once = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    mixed = mixing.mixed_documents(once)
    assert mixed.columns == docs.columns
    entries, _ = mixing.mix(mixing.queued(once))
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(r.doc_id for r in entries.collect())


def test_flow_moves_the_fewest_bytes():
    rnd = random.Random(8)
    for _ in range(30):
        supply = [rnd.randrange(50) for _ in range(rnd.randint(1, 6))]
        capacity = reshard.equal_capacities(sum(supply), rnd.randint(1, 8))
        flow = reshard.min_cost_flow(supply, capacity)
        for i, s in enumerate(supply):
            assert sum(n for (a, _), n in flow.items() if a == i) == s
        for j, c in enumerate(capacity):
            assert sum(n for (_, b), n in flow.items() if b == j) <= c
        moved = sum(n for (a, b), n in flow.items() if a != b)
        assert moved == sum(max(0, s - (capacity[i] if i < len(capacity) else 0)) for i, s in enumerate(supply))
    assert reshard.min_cost_flow([5, 5], [5, 5], [[9, 1], [1, 9]]) == {(0, 1): 5, (1, 0): 5}
    with pytest.raises(ValueError):
        reshard.min_cost_flow([5], [4])


def test_reshard_places_every_row(spark, docs, rows, empty, tmp_path):
    placed = reshard.reshard(docs, 4, 6).collect()
    size = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in placed) == size
    shards = defaultdict(list)
    for r in placed:
        shards[r.shard].append(r)
    for found in shards.values():
        assert sorted(r.slot for r in found) == list(range(len(found)))
    without = docs.filter("doc_id <> 405")
    sizes = Counter()
    for r in reshard.reshard(without, 4, 6).collect():
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) < 0.1 * sum(sizes.values()) / 6
    assert reshard.reshard(empty, 4, 6).collect() == []


def test_only_affected_shards_are_written(spark, docs, tmp_path):
    once = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).cache()
    placed = reshard.reshard(once, 4, 6).cache()
    changed = reshard.rewrite(once, placed, str(tmp_path / "shards"))
    assert changed == reshard.affected(placed)
    back = spark.read.parquet(str(tmp_path / "shards"))
    want = {(r.doc_id, r.shard) for r in placed.collect() if r.shard in changed}
    assert {(r.doc_id, r.shard) for r in back.collect()} == want


def test_stray_quotes_and_deep_pages():
    from folio.llm import html

    said = "<body><article><p class=it's>One thing that is said here.</p><p>We don't know it at all.</p></article></body>"
    assert html.extract(said, None)[0] == "One thing that is said here.\nWe don't know it at all."
    odd = "<body><article><p title='a>b' class=\"x\">One = thing.</p><p class=\"open>Two is left.</p><p a = 'q>r'>Three.</p></article></body>"
    assert html.extract(odd, None)[0] == "One = thing.\nTwo is left.\nThree."
    deep = "<body>" + "<div>" * 50_000 + "<p>Deep text that is here.</p>" + "</div>" * 50_000
    text, path = html.extract(deep, None)
    assert text == "Deep text that is here." and path.count("/div") == 50_000
