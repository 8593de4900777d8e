"""Vectors for text and heading expressions."""

from pyspark.sql import functions as F

from folio.functions import metadata, numbers, text, titles
from folio.functions.classify import block_type, speakers


def one(spark, values, column, schema="v string"):
    rows = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema)
    return [r[0] for r in rows.coalesce(1).select(column.alias("out")).collect()]


def test_number_tokens(spark):
    tokens = ["12", "3.4.1", "IV", "xiv", "MCMXCIX", "One", "twenty-five", "one hundred and two", "two thousand three hundred forty",
              "Seventh", "hundred", "apple", "", " 7. ", "II:", "vv"]
    want = ["12", "3.4.1", "4", "14", "1999", "1", "25", "102", "2340", "7", "100", None, None, "7", "2", "10"]
    assert one(spark, tokens, numbers.canonical_token(F.col("v"))) == want
    assert one(spark, ["2.1", "IX", "word"], numbers.leading_int(F.col("v"))) == [2, 9, None]


def test_heading_cleanup(spark):
    got = one(spark, ["A B – C", "x — — y", "bad�\u0007 title ", None], text.clean_heading(F.col("v")))
    assert got == ["A B — C", "x — y", "bad title", ""]


def test_running_text_and_page_numbers(spark):
    assert one(spark, ["4 Mathematics", " Mathematics  6", "12"], text.running_text_key(F.col("v"))) == ["mathematics", "mathematics", ""]
    assert one(spark, ["12", "Page 3", "3 - 4", "3/4", "3a"], text.is_page_number(F.col("v"))) == [True, True, True, True, False]


def test_unit_gates(spark):
    pairs = [("1", "Unit"), ("IV", "Unit"), ("a", "Unit"), ("b", "Part"), ("unit", "Unit"), ("and", "Part"), (None, "Unit"), ("1.2", "Unit")]
    rows = spark.createDataFrame(pairs, "n string, l string").coalesce(1)
    got = [r[0] for r in rows.select(titles.is_unit_number(F.col("n"), F.col("l"))).collect()]
    assert got == [True, True, False, True, False, False, True, False]
    assert one(spark, ["Real Numbers", "12", "and then", "x = 2 + y", "ab", "", "w" * 101], titles.is_unit_title(F.col("v"))) == [
        True, False, False, False, False, False, False]
    assert one(spark, ["Sets", "A = x2 + 1", "is it", "3 = 4", "z" * 121], titles.is_lesson_title(F.col("v"))) == [True, False, False, False, False]


def test_exercise_labels(spark):
    rows = [
        ("Exercise 1.1\nmore", None, "1"), ("Exercise 10.3", None, "11"), ("Exercise 501", None, "5"), ("Exercise 1002", None, "10"),
        ("Exercise 3", None, "4"), ("Exercise 3", None, "9"), ("Exercise", None, "2"), ("what is the value of exercise 2", None, "2"),
        ("Body text", "Practice 2.1", "2"), ("Nothing here", None, "1"),
    ]
    df = spark.createDataFrame(rows, "t string, h string, c string").coalesce(1)
    got = [r[0] for r in df.select(titles.exercise_label(F.col("t"), F.col("h"), F.col("c"))).collect()]
    assert got == ["Exercise 1.1", None, "Exercise 5.1", "Exercise 10.2", "Exercise 3", None, "Exercise", None, "Practice 2.1", None]


def test_printed_page(spark):
    rows = [("Mathematics 27", 100), ("28 Proportion, Profit", 100), ("Example 12", 100), ("Mathematics 270", 100), ("plain", 100)]
    df = spark.createDataFrame(rows, "v string, n int").coalesce(1)
    assert [r[0] for r in df.select(titles.printed_page(F.col("v"), F.col("n"))).collect()] == [27, 28, None, None, None]


def test_wait_seconds(spark):
    got = one(spark, ["try again in 16.665s", "Try again in 2m25s", "try again in 1h20m30s", "try again in 34m", "try again in 34 minutes",
                      "try again in 16.5 seconds", "broken"], text.retry_seconds(F.col("v")))
    assert got == [16.665, 145.0, 4830.0, 2040.0, 2040.0, 16.5, 60.0]


def test_token_estimate(spark):
    assert one(spark, ["", "abcd", "$x^2$ = <y>"], text.estimate_tokens(F.col("v"))) == [0, 2, 4 + 3]


def test_math(spark):
    got = one(spark, ["√25 = 5", "5 x 5 = 25", "12 × 3 = 36", "The square root of 25 is 5."], text.math_latex(F.col("v")))
    assert got == [r"\sqrt{25} = 5", "5 x 5 = 25", r"12  \times  3 = 36", None]
    seg = one(spark, ["a $x$ b $$y$$ \\(z\\)"], text.math_segments(F.col("v")))[0]
    assert [(s["kind"], s["content"]) for s in seg] == [
        ("text", "a "), ("math", "x"), ("text", " b "), ("display-math", "y"), ("text", " "), ("math", "z")]


def test_hash_ignores_option_order(spark):
    rows = [("What is 2+2?", ["4", "5", "6", "7"], "4"), (" what  is 2+2? ", ["7", "6", "5", "4"], "4"), ("What is 2+2?", ["4", "5", "6", "7"], "5")]
    df = spark.createDataFrame(rows, "s string, o array<string>, c string").coalesce(1)
    h = [r[0] for r in df.select(text.canonical_question_hash(F.col("s"), F.col("o"), F.col("c"))).collect()]
    assert h[0] == h[1] != h[2]


def test_classifier(spark):
    def kinds(domain, values):
        return one(spark, values, block_type(F.col("v"), F.lit(domain)))

    assert kinds("LANGUAGE", ["Ruma: Hi\nTeacher: Good day", "apple - a fruit\npear - green", "Rule 2: x", "1) Do it", "Look at the map",
                              "Please write a letter", "one\ntwo\nthree", "short"]) == [
        "dialogue", "vocabulary", "grammar_rule", "exercise", "instruction", "writing_task", "reading_passage", "generic_text"]
    assert kinds("STEM", ["Definition: a", "A set is defined as b", "Theorem 1.2", "Proof.", "Example 3: x", "Simplify 3", "a ≤ b", "plain"]) == [
        "definition", "definition", "theorem", "proof", "worked_example", "exercise", "mathematical_explanation", "generic_text"]
    assert one(spark, ["B b: x\nnarration\nAa: y\nB b: z"], speakers(F.col("v"))) == [["B b", "Aa"]]


def test_metadata(spark):
    rows = [("Mathematics Class IX First Edition 2024", "x.pdf"), ("no mark", "book class-5.pdf"), ("Class Notes", "x.pdf"), ("", "plain.pdf")]
    df = spark.createDataFrame(rows, "t string, f string").coalesce(1)
    g = [r[0] for r in df.select(metadata.detect_grade(F.col("t"), F.col("f"))).collect()]
    assert (g[0]["code"], g[0]["level"], g[0]["source"]) == ("class-9", 9, "content")
    assert (g[1]["code"], g[1]["source"]) == ("class-5", "filename")
    assert (g[2]["code"], g[2]["level"]) == ("class-notes", None) and g[3] is None
    e = [r[0] for r in df.select(metadata.detect_edition(F.col("t"), F.col("f"), 2026)).collect()]
    assert (e[0]["label"], e[0]["year"]) == ("First Edition 2024", 2024) and e[3]["year"] is None
    best = metadata.best_profile(metadata.profile_scores(F.lower("t")))
    assert [r[0]["code"] if r[0] else None for r in df.select(best).collect()][0] == "mathematics"


def test_white_space_and_digits_of_all_scripts(spark):
    assert one(spark, ["১২", "page 3 ", "3 - ৪", "x১"], text.is_page_number(F.col("v"))) == [True, True, True, False]
    assert len(set(one(spark, ["a b", "a b", "  a  　b "], text.content_hash(F.col("v"))))) == 1


def test_long_number_words_are_no_failure(spark):
    got = one(spark, ["hundred-" * 5 + "hundred", "hundred-" * 30 + "hundred", "two hundred"], numbers.canonical_token(F.col("v")))
    assert got == ["1000000000000", None, "200"]
