"""Candidates, near duplicates, acceptance, bank and papers."""

import difflib
import random

from pyspark.sql import functions as F

from folio.functions.text import stem_key
from folio.operators import bank, coverage, generation, papers, questions, similar

WORDS = "plant energy light water root leaf stem cell grow sun store sugar gas air green food move small large chain".split()


def stems(seed, n):
    """Stems of which many are edits of each other, some short, some with digits."""
    rnd = random.Random(seed)
    base = [" ".join(rnd.choice(WORDS) for _ in range(rnd.choice([2, 5, 9, 14]))) for _ in range(n // 5)]
    out = []
    for i in range(n):
        s = rnd.choice(base)
        if rnd.random() < 0.6:
            chars = list(s)
            for _ in range(rnd.choice([1, 1, 2, 4])):
                k = rnd.randrange(len(chars))
                chars[k:k + 1] = rnd.choice([[], [rnd.choice("aeiou")], [chars[k], "x"]])
            s = "".join(chars)
        if rnd.random() < 0.4:
            s += f" {rnd.choice([3, 7, 12])}"
        if rnd.random() < 0.1:
            s = rnd.choice(["what is x", "abcdefgh", "abcdefg", "abcdefgi", "ab", "abc def"])
        out.append((i, s))
    return out


def brute_force_pairs(rows: list[tuple[int, str]], with_ratio: bool = True) -> set[tuple[int, int]]:
    """All near pairs of a handful of normalised stems."""
    out = set()
    for i, (later, a) in enumerate(rows):
        for early, b in rows[:i]:
            if a == b:
                out.add((later, early))
                continue
            na, nb = [[t for t in digits(x)] for x in (a, b)]
            if na and nb and na != nb:
                continue
            wa, wb = [{w for w in x.split() if w not in similar.STOP_WORDS and len(w) > 1} for x in (a, b)]
            if wa and wb and len(wa & wb) / len(wa | wb) >= similar.JACCARD:
                out.add((later, early))
            elif with_ratio and difflib.SequenceMatcher(None, a, b).ratio() >= similar.RATIO:
                out.add((later, early))
    return out


def digits(text: str) -> list[str]:
    runs, run = [], ""
    for ch in text + " ":
        if ch.isdigit():
            run += ch
        elif run:
            runs.append(run)
            run = ""
    return runs


def test_pairs_equal_brute_force(spark):
    rows = stems(3, 160)
    df = spark.createDataFrame(rows, "seq long, stem string")
    keyed = [(r["seq"], r["k"]) for r in df.select("seq", stem_key(F.col("stem")).alias("k")).orderBy("seq").collect()]
    for with_ratio in (True, False):
        firsts = {}
        for seq, k in keyed:
            firsts.setdefault(k, seq)
        distinct = sorted((s, k) for k, s in firsts.items())
        want = brute_force_pairs(distinct, with_ratio)
        described = similar.describe(similar.distinct_stems(df, []), [], with_ratio)
        got = {(r["later_seq"], r["early_seq"]) for r in similar.matches(described, described, [], True, with_ratio).collect()}
        assert len(want) > 12
        assert got == want


def greedy(rows):
    kept = []
    for seq, k in rows:
        pairs = brute_force_pairs([*kept, (seq, k)])
        if not any(a == seq for a, _ in pairs):
            kept.append((seq, k))
    return [s for s, _ in kept]


def test_greedy_filter_equals_loop_whatever_the_ranges(spark):
    rows = stems(8, 70)
    df = spark.createDataFrame(rows, "seq long, stem string")
    keyed = [(r["seq"], r["k"]) for r in df.select("seq", stem_key(F.col("stem")).alias("k")).orderBy("seq").collect()]
    want = greedy(keyed)
    for smallest, budget in ((4096, 200), (20, 1)):
        got = similar.greedy_filter(df, smallest=smallest, pairs_per_row=budget)
        assert sorted(r["seq"] for r in got.collect()) == want


def test_first_match_against_seen(spark):
    seen = spark.createDataFrame([(1, "Name the plant that stores energy"), (2, "What is the square of 4?")], "seq long, stem string")
    cand = spark.createDataFrame(
        [(10, "name the PLANT that stores energy!"), (11, "Name the plants that store energy"), (12, "What is the square of 5?"), (13, "What is the square of 4 ?")],
        "seq long, stem string")
    got = {r["seq"]: (r["first_seen"], r["is_exact"]) for r in similar.first_match(cand, seen, []).collect()}
    assert got == {10: (1, True), 11: (1, False), 13: (2, True)}


OPTIONS = [("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")]


def test_rules_first_failure(spark):
    ok = dict(stem="What is the square of 2?", options=[("a", "4"), ("b", "2"), ("c", "3"), ("d", "5")], correct="a", explanation="e", cites=["S1"])
    cases = [
        ({}, None), ({"stem": " "}, "schema_rejected"), ({"stem": "x = 4"}, "other_rejected"), ({"options": OPTIONS[:3]}, "invalid_option_count"),
        ({"options": [("a", "4"), ("a", "2"), ("c", "3"), ("d", "5")]}, "duplicate_option_rejected"),
        ({"options": [("a", "4"), ("b", " "), ("c", "3"), ("d", "5")]}, "other_rejected"),
        ({"options": [("a", "4"), ("b", "X y"), ("c", "x  Y"), ("d", "5")]}, "duplicate_option_rejected"), ({"correct": "z"}, "invalid_correct_option_id"),
        ({"explanation": ""}, "other_rejected"), ({"cites": []}, "invalid_source_chunk_rejected"), ({"cites": ["S9"]}, "invalid_source_chunk_rejected"),
        ({"correct": "b"}, "deterministic_math_rejected"), ({"stem": "Give the square root of 16 now", "correct": "a"}, None),
        ({"stem": "Give the square root of 16 now", "correct": "b"}, "deterministic_math_rejected"),
    ]
    rows = [(i, *[(ok | c)[k] for k in ("stem", "options", "correct", "explanation", "cites")]) for i, (c, _) in enumerate(cases)]
    df = spark.createDataFrame(
        rows, "i int, stem string, options array<struct<id:string,text:string>>, correct_option_id string, explanation string, source_chunk_ids array<string>")
    got = {r["i"]: r["c"] for r in df.select("i", questions.first_failure(F.array(F.lit("S1"))).alias("c")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_accounting_balances_and_shuffle_keeps_the_answer(spark):
    rnd = random.Random(2)
    outcomes = [(i % 7, rnd.choice([*questions.OUTCOMES, None])) for i in range(300)]
    acc = questions.accounting(spark.createDataFrame(outcomes, "job int, outcome string"), ["job"])
    assert all(r["balanced"] for r in acc.collect())
    rows = [(1, i, [(f"o{k}", f"t{i}{k}") for k in range(4)], f"o{i % 4}") for i in range(20)]
    df = spark.createDataFrame(rows, "paper int, question_id int, options array<struct<id:string,text:string>>, correct_option_id string")
    out = questions.shuffle_paper(df, "paper", "s").collect()
    assert sorted(r["question_number"] for r in out) == list(range(1, 21))
    assert [r["question_id"] for r in sorted(out, key=lambda r: r["question_number"])] != list(range(20))
    for r in out:
        shown = dict(x.split(") ") for x in r["option_labels"].split("|"))
        assert shown[r["correct_letter"]] == f"t{r['question_id']}{r['question_id'] % 4}"


def test_allocation_sums_to_the_request(spark):
    rows = [(n, w, r) for n in (1, 3, 7) for w in range(1, n + 1) for r in (1, 5, 10, 11, 20)]
    df = spark.createDataFrame(rows, "windows long, rank long, req long")
    got = df.withColumn("q", coverage.allocate(F.col("rank"), F.col("windows"), F.col("req"))).groupBy("windows", "req").agg(F.sum("q").alias("s"), (F.max("q") - F.min("q")).alias("d"))
    for r in got.collect():
        assert r["s"] == r["req"] and r["d"] <= 1


def test_packing_equals_a_loop(spark):
    rnd = random.Random(4)
    rows = [(d, i, "x" * rnd.choice([50, 400, 900, 2300])) for d in range(60) for i in range(rnd.randint(1, 15))]
    df = spark.createDataFrame(rows, "d int, i long, text string")
    got = {(r["d"], r["i"]) for r in coverage.pack(df, ["d"], [F.col("i")], "text", 2200, bucket=F.floor(F.col("i") / 4)).collect()}
    want = set()
    for d in range(60):
        used, n = 0, 0
        for _, i, t in [r for r in rows if r[0] == d]:
            if used + len(t) > 2200 and n >= 3:
                break
            want.add((d, i))
            used, n = used + len(t), n + 1
    assert got == want


def test_every_paper_error_is_reached(spark):
    questions_ = spark.createDataFrame([(i, "V" if i != 5 else "W", "stem", f"{i}a" if i != 9 else "9z") for i in range(1, 13)], "question_id long, version_id string, stem string, correct_option_id string")
    opts = spark.createDataFrame([(i, k, f"{i}{c}", "t") for i in range(1, 13) for k, c in enumerate("abcd")], "question_id long, canonical_order long, option_id string, option_text string")

    def four(i):
        return [f"{i}{c}" for c in "abcd"]

    items = [(1, 1, 1, four(1)), (1, 2, 1, four(2)), (2, 3, 0, four(3)), (2, 99, 1, four(99)), (2, 5, 2, four(5)), (3, 6, 1, four(6)), (3, 6, 2, four(6)),
             (4, 7, 1, four(7)[:3]), (4, 8, 2, ["8a", "8a", "8b", "8c"]), (4, 10, 3, ["10a", "10b", "10c", "x"]), (4, 9, 4, four(9)), (5, 11, 1, four(11))]
    rows = spark.createDataFrame([(*x,) for x in items], "set_id long, question_id long, question_order long, option_order array<string>")
    sets = spark.createDataFrame([(i, "V") for i in range(1, 7)], "set_id long, version_id string")
    checked = papers.violations(sets, rows, questions_, opts)
    assert {r["violation"] for r in checked.collect()} == {
        None, "DUPLICATE_QUESTION_ORDER", "INVALID_QUESTION_ORDER", "QUESTION_NOT_FOUND", "FOREIGN_SUBJECT_QUESTION", "DUPLICATE_QUESTION_IN_PAPER",
        "INVALID_OPTION_COUNT", "DUPLICATE_OPTION_IDS", "FOREIGN_OPTION_ID", "CORRECT_OPTION_MISSING"}
    verdicts = {r["set_id"]: r["verdict"] for r in papers.paper_verdicts(sets, checked).collect()}
    assert verdicts == {1: "REJECTED", 2: "REJECTED", 3: "REJECTED", 4: "REJECTED", 5: "VALID", 6: "EMPTY_ARRANGEMENTS"}


def test_saving_twice_reuses(spark):
    rows = [(1, "q1", "Which plant is green?", [("a", "x"), ("b", "y"), ("c", "z"), ("d", "w")], "a"), (2, "q2", "which  plant is green?", [("a", "w"), ("b", "x"), ("c", "y"), ("d", "z")], "b")]
    df = spark.createDataFrame(rows, "seq long, question_id string, stem string, options array<struct<id:string,text:string>>, correct_option_id string")
    hashed = bank.with_content_hash(df.withColumn("version_id", F.lit("V")))
    empty = hashed.limit(0).select("version_id", "content_hash", "question_id")
    first = bank.save_generated(hashed, empty).orderBy("seq").collect()
    assert [r["is_created"] for r in first] == [True, False] and len({r["bank_id"] for r in first}) == 1
    stored = hashed.limit(1).select("version_id", "content_hash", F.lit("B1").alias("question_id"))
    assert {(r["bank_id"], r["is_created"]) for r in bank.save_generated(hashed, stored).collect()} == {("B1", False)}


def test_outcomes_equal_loop(spark):
    """Rules, seeds, near duplicates by both tests, quota: against a loop over the candidates."""
    rows, seeds = stems(21, 90), stems(22, 12)
    good = [("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")]
    frame = spark.createDataFrame(
        [("j", 1 + i // 30, i, f"q{i}", s, good[: 3 + (i % 7 > 0)], "a", "why", ["S1"], "w", 9) for i, s in rows],
        "job_id string, round long, seq long, question_id string, stem string, options array<struct<id:string,text:string>>, correct_option_id string, "
        "explanation string, source_chunk_ids array<string>, window_id string, quota long",
    )
    prior = spark.createDataFrame([("j", s) for _, s in seeds], "job_id string, stem string")
    jobs = spark.createDataFrame([("j", 1, 15)], "job_id string, n_windows long, requested long")
    chunks = F.array(F.lit("S1"))
    key = {r["stem"]: r["k"] for r in frame.select("stem").union(prior.select("stem")).distinct().select("stem", stem_key(F.col("stem")).alias("k")).collect()}
    plain = {r["seq"]: r["c"] for r in frame.select("seq", questions.first_failure(chunks).alias("c")).collect()}
    kept, want, taken = [key[s] for _, s in seeds], {}, 0
    for i, s in rows:
        k, verdict = key[s], plain[i]
        early = verdict == "schema_rejected" or (verdict == "other_rejected")
        if not early and k in kept:
            verdict = "exact_question_duplicate_rejected"
        elif not early and any(a == len(kept) for a, _ in brute_force_pairs([*enumerate(kept), (len(kept), k)])):
            verdict = "near_duplicate_rejected"
        if verdict is None:
            kept.append(k)
            taken += 1
            verdict = "final_accepted" if taken <= 15 else "surplus_not_needed"
        want[i] = verdict
    got = {r["seq"]: r["outcome"] for r in generation.generation_outcomes(frame, prior, jobs, chunks).collect()}
    assert got == want and {"near_duplicate_rejected", "invalid_option_count", "final_accepted"} <= set(want.values())


def test_greedy_filter_reads_what_it_kept_as_one_scan(spark):
    """the plan does not grow with the ranges that were taken."""
    rows = [(i, f"Explain how {chr(97 + i % 26)}{chr(97 + i // 26)}word{i} behaves in test number {i}") for i in range(120)]
    got = similar.greedy_filter(spark.createDataFrame(rows, "seq long, stem string"), smallest=4, pairs_per_row=1)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert got.count() == 120


def test_greedy_filter_takes_small_keys_together(spark, monkeypatch):
    """many keys of few stems are one range, not one for every few thousand rows."""
    labels, write = [], similar.cut
    monkeypatch.setattr(similar, "cut", lambda df, label="step": labels.append(label) or write(df, label))
    rows = [(f"job_{i // 6}", i, f"Explain how alpha beta gamma delta epsilon zeta behaves, part {i % 3}") for i in range(60)]
    got = similar.greedy_filter(spark.createDataFrame(rows, "job_id string, seq long, stem string"), ["job_id"], smallest=8)
    assert labels.count("edges") <= 2  # the live pairs, and what one round leaves of them
    assert sorted(r.seq for r in got.collect()) == [i for i in range(60) if i % 6 < 3]


def test_seen_stems_of_one_place_are_told_apart(spark):
    """the digits of one seed must not let a candidate meet the words of another."""
    seen = spark.createDataFrame([(-1, "What is the square of 3 for the hot plate?"), (-1, "What is the square of 7 for the small gear?")], "seq long, stem string")
    cand = spark.createDataFrame([(10, "What is the square of 7 for the hot plate?"), (11, "What is square of 7 for the gear, small?")], "seq long, stem string")
    assert [(r.seq, r.first_seen) for r in similar.first_match(cand, seen, [], with_ratio=False).collect()] == [(11, -1)]
    at = {r.stem_key: r.near_at for r in similar.seen_at(cand, seen, [], with_ratio=False).collect()}
    assert sorted(at.values(), key=str) == [-1, None]


def test_small_keys_are_paired_by_digits_without_elements(spark):
    """Stems of a key of few get no elements, and matches are those that the elements find where one key holds all of them."""
    stems = ["", "5^2 = 25", "What is the square of 7 for the red box?", "What is the square of 7 for the red boxes?", "What is the square of 8 for the red box?",
             "Name the largest red box of all", "Name the largest red box of 7", "Name the largest red boxes of all", "ab", "ac"]
    rows = [(i, "j", s) for i, s in enumerate(stems)]
    df = spark.createDataFrame(rows, "seq bigint, job_id string, stem string")
    described = similar.describe(similar.distinct_stems(df, ["job_id"]), ["job_id"])
    assert described.filter("look is not null").count() == 0
    plain = similar.describe(similar.distinct_stems(df, []), [])
    assert plain.filter("look is null").count() == 0
    for ordered in (True, False):
        got = [(r.later_seq, r.early_seq) for r in similar.matches(described, described, ["job_id"], ordered).collect()]
        want = [(r.later_seq, r.early_seq) for r in similar.matches(plain, plain, [], ordered).collect()]
        assert sorted(got) == sorted(want) and len(want) > 2


def test_small_jobs_are_walked_without_rounds(spark, monkeypatch):
    """jobs of few stems take a fixed handful of written steps, and what the joins and rounds of large jobs find."""
    labels, write = [], similar.cut
    for module in (similar, generation):
        monkeypatch.setattr(module, "cut", lambda df, label="step": labels.append(label) or write(df, label))
    stems = ["What is the square of {n} for the hot plate?", "What is the square of {n} for the hot plates?", "what is the  square of {n} for the hot plate", "Name the plate that is hot and large",
             "Name the plates that are hot and large", "", "Name the colder plate of {n} kinds", "{n}^2 = {n}", "Name a plate that is hot and large"]
    rows = [(f"job_{j}", i, i // 5 + 1, f"q_{j}_{i}", stems[(i * 7 + j) % len(stems)].format(n=(i + j) % 3), [("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "a", "x", [f"SRC-{i % 5}"])
            for j in range(4) for i in range(24)]
    rows += [(None, 99, 1, "q_none", stems[0], [("a", "1")], "a", "x", ["SRC-1"]), ("job_0", 98, 1, "q_null", None, [("a", "1")], "a", "x", ["SRC-1"])]
    frame = spark.createDataFrame(rows, "job_id string, seq long, round int, question_id string, stem string, options array<struct<id:string,text:string>>, "
                                  "correct_option_id string, explanation string, source_chunk_ids array<string>").withColumns({"window_id": F.lit("w"), "quota": F.lit(5)})
    seeds = spark.createDataFrame([("job_1", stems[3]), ("job_2", stems[0].format(n=1)), ("job_2", stems[0].format(n=2)), ("job_3", None), ("job_9", stems[3])], "job_id string, stem string")
    jobs = spark.createDataFrame([(f"job_{j}", 0, 15) for j in range(4)], "job_id string, n_windows int, requested int")
    chunks = F.array(*[F.lit(f"SRC-{i}") for i in range(4)])
    for with_ratio in (True, False):
        found = {}
        for few in (64, 0):
            monkeypatch.setattr(similar, "FEW", few)
            labels.clear()
            out = generation.generation_outcomes(frame, seeds, jobs, chunks, with_ratio)
            assert few == 0 or len(labels) <= 4
            found[few] = {r.question_id: r.outcome for r in out.collect()}
        assert found[64] == found[0] and len(found[0]) == len(rows)
        assert {"near_duplicate_rejected", "exact_question_duplicate_rejected", "final_accepted"} <= set(found[0].values())
