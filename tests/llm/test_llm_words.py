"""Tokenizer alignment, binary packing and spelling variants against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from folio.llm import alignment, binary_packing, variants
from test_llm_text import corpus, documents

ODD = [
    "", " ", "  ", "\n", " x", "x ", "a  b", "a \n b\t c ", "  lead and trail \n\n", "don't we'll it's", "<|endoftext|> and <|endoftext|>x", "<s> </s> <0x41> <unk>",
    "a▁b", "▁", "naïve Ünïcode straße ÀÖ", "日本語 テキスト と 漢字", "emoji 👩‍👩‍👧‍👦 👍🏽 done", "हिन्दी में पाठ", "a\0b \x1c c", " nb sp　x", "x" * 5000, "ab " * 3000,
    "numbers 12345 67,890.12 #tag @me http://a.b/c?d=e", "é́ ﬁ ǅ", " line sep ​ zero", "tab\tsep\r\nline", "'s 't 're", "!!!???", "... --- ___",
]


def slow_alignment(texts):
    """The contract on whole texts, with both tokenizers' own encoders."""
    import base64

    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        token = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}

    def piece(i):
        p = two.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()

    links, out = [], []
    for text in texts:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(token[i] for i in a) != whole or b"".join(piece(i) for i in b) != whole:
            links.append([])
            out.append((0, 0, 0, ""))
            continue
        ends_a, ends_b, n = {}, {}, 0
        for k, i in enumerate(a):
            n += len(token[i])
            ends_a[n] = k
        n = 0
        for k, i in enumerate(b):
            n += len(piece(i))
            ends_b[n] = k
        common = sorted(ends_a.keys() & ends_b.keys())
        groups, i, j = [], 0, 0
        for end in common:
            x, y = ends_a[end] + 1, ends_b[end] + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        links.append([(a[ends_a[end]], b[ends_b[end]]) for end in common])
        out.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    counts = Counter(pair for found in links for pair in found)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (n_a, n_b, n_groups, len(found), sum(counts[p] == most[p[1]] for p in found), sum(counts[p] for p in found), digest)
        for (n_a, n_b, n_groups, digest), found in zip(out, links)
    ]


@pytest.mark.parametrize("head", [1 << 17, 60, 0])
def test_alignment_equals_whole_texts(spark, monkeypatch, head):
    monkeypatch.setattr(alignment, "HEAD", head)
    rows = [*corpus(), *[(1000 + i, t, "en", "a") for i, t in enumerate([*ODD, *ODD[:9], None])]]
    got = alignment.aligned_documents(documents(spark, rows)).collect()
    want = [(r[0], *m) for r, m in zip(rows, slow_alignment([r[1] for r in rows]))]
    assert Counter(tuple(r) for r in got) == Counter(want)
    assert sum(r.n_a == 0 for r in got) > 5 and max(r.n_a for r in got) > 10_000
    assert alignment.aligned_documents(documents(spark, [])).collect() == []


def test_aligner_random_texts(monkeypatch):
    monkeypatch.setattr(alignment, "CACHE", 50)
    rnd = random.Random(6)
    letters = ["a", "B", "é", " ", " ", "  ", "\n", "'", "s", "1", ",", "▁", "日", "ß", "👍", " ", ".", "-", "<", "the", "ing"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 30))) for _ in range(3000)]
    texts += ["".join(rnd.choice(letters[:11]) for _ in range(rnd.randint(1, 30))) for _ in range(3000)]
    aligner = alignment.Aligner()
    for text, want in zip(texts, slow_alignment(texts)):
        n_a, n_b, n_groups, digest, links = aligner.text(text)
        assert (n_a, n_b, n_groups, len(links), digest) == (want[0], want[1], want[2], want[3], want[6]), repr(text)


def test_binary_packing_round_trip(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [*corpus(), *[(1000 + i, t, "en", "a") for i, t in enumerate(ODD)]]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = binary_packing.bucketed_documents(documents(spark, rows)).collect()
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        # Largest power of two that still fits, again and again.
        while at < len(ids):
            length = 1024
            while length > len(ids) - at:
                length //= 2
            want[doc_id, at, length, zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes()), len(ids), 0] += 1
            at += length
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset) for r in got) == want
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    slots = defaultdict(list)
    for r in sorted(got, key=lambda r: r.sequence_id):
        slots[r.length].append(r.slot)
    assert list(slots) == sorted(slots, reverse=True) and all(s == list(range(len(s))) for s in slots.values())
    assert binary_packing.bucketed_documents(documents(spark, [])).collect() == []


def test_binary_lengths():
    for n in range(1, 3000):
        lengths = binary_packing.binary_lengths(n)
        assert sum(lengths) == n and lengths == sorted(lengths, reverse=True) and all(x & (x - 1) == 0 and x <= 1024 for x in lengths)
        assert len(set(x for x in lengths if x < 1024)) == sum(x < 1024 for x in lengths)


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def slow_variants(counts):
    near = {w: [v for v in counts if one_edit(v, w)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return out


def slow_counts(rows):
    import re

    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_variants_equal_brute_force(spark):
    rnd = random.Random(11)
    base = ["".join(rnd.choice("abcdeé×") for _ in range(rnd.choice([6, 7, 9, 10, 12, 25]))) for _ in range(12)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "ÀÖÜàöü", "q" * 300, "q" * 299 + "z"]
    pool = list(base)
    for w in base:
        for _ in range(12):
            i = rnd.randrange(len(w))
            pool.append(rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice("abé") + w[i:], w[:i] + rnd.choice("abé") + w[i + 1 :]]))
    weight = [rnd.choice([1, 1, 2, 5, 30, 200]) for _ in pool]
    rows = [(i, " ".join(rnd.choices(pool, weight, k=150)).replace(" ", rnd.choice([" ", "-", "1", "\n"]))) for i in range(300)]
    rows += [(None, rows[0][1].upper()), (3, rows[3][1]), (500, None), (501, ""), (502, "w" * 5 + " short"), (503, "longrun" * 30_000), (504, "ǅabcdef日ghijkl " * 9)]
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows])
    want = slow_variants(slow_counts(rows))
    got = [tuple(r) for r in variants.spelling_variants(docs).collect()]
    assert len(got) == len(want) and set(got) == want
    assert any(r[2] != r[1] and r[1] for r in got) and any(r[1] is None and r[4] for r in got)
    assert variants.spelling_variants(documents(spark, [])).collect() == []


def test_variants_of_dense_words(spark):
    """All words over two letters: many neighbours, ties, runs of equal letters; and a very long word with a variant."""
    rnd = random.Random(2)
    words = {"".join(rnd.choice("ab") for _ in range(n)) for n in (6, 7, 8, 6, 7, 8, 11, 12) for _ in range(60)}
    counts = {w: rnd.choice([5, 5, 25, 125, 700]) for w in words}
    long = "".join(rnd.choice("abc") for _ in range(30_000))
    counts |= {long: 50, long[:20_000] + long[20_001:]: 10, long[:7] + "z" + long[8:]: 7}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {tuple(r) for r in variants.spelling_forms(frame).collect()} == slow_variants(counts)


def test_round_3_queries_are_registered():
    import __spark_entry__ as entry

    assert {n.split("_")[0] for n in entry.queries()} >= {"op11", "op12", "op13"}
