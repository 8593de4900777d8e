"""Question papers: id translation, validation, saving, rebuilding, editing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.numbers import strip_space
from folio.functions.text import option_letter
from folio.operators.ordered import numbered


def source_contract(source: Column, job_id: Column) -> Column:
    """A generated paper names its job, a bank paper does not."""
    return (
        F.when((source == "GENERATED_JOB") & job_id.isNull(), "JOB_ID_REQUIRED")
        .when((source == "QUESTION_BANK") & job_id.isNotNull(), "JOB_ID_FORBIDDEN")
    )


def options_per_question(options: DataFrame) -> DataFrame:
    """Option ids and texts of a question in canonical order; a question has one option per order value."""
    listed = F.array_sort(F.collect_list(F.struct("canonical_order", "option_id", "option_text")))
    return options.groupBy("question_id").agg(listed.alias("o")).select(
        "question_id", F.transform("o", lambda x: x["option_id"]).alias("option_ids"),
        F.map_from_entries(F.transform("o", lambda x: F.struct(x["option_id"], x["option_text"]))).alias("option_texts"),
    )


def translate_ids(items: DataFrame, id_map: DataFrame, options: DataFrame) -> DataFrame:
    """Generated question ids to bank ids, and option ids through the map, 'opt_2', a letter, or as they are.

    `id_map` has generated_id, bank_id and option_map (generated option -> stored
    option); an id without an entry is taken as a bank id.
    """
    full = items.join(id_map, "generated_id", "left").withColumn("question_id", F.coalesce("bank_id", "generated_id"))
    full = full.join(options_per_question(options), "question_id", "left")
    valid = F.coalesce("option_ids", F.array().cast("array<string>"))

    def all_valid(ids: Column) -> Column:
        return F.size(F.array_except(ids, valid)) == 0

    mapped = F.transform("option_order", lambda o: F.coalesce(F.try_element_at("option_map", o), o))
    step = F.when(F.col("option_map").isNotNull() & all_valid(mapped), mapped).otherwise(F.col("option_order"))

    def by_position(o: Column) -> Column:
        digits = strip_space(F.replace(F.replace(o, F.lit("opt_"), F.lit("")), F.lit("opt"), F.lit("")))
        number = F.when(digits.rlike(r"^\d+$"), digits.try_cast("int"))
        letter = F.when(F.upper(o).rlike("^[A-D]$"), F.ascii(F.upper(o)) - 64)
        at = F.coalesce(number, letter)
        return F.when(at.isNotNull(), F.when(at >= 1, F.try_element_at(valid, at))).when(F.array_contains(valid, o), o)

    guessed = F.filter(F.transform(step, by_position), lambda x: x.isNotNull())
    final = F.when((F.size(step) == 4) & ~all_valid(step) & (F.size(guessed) == 4), guessed).otherwise(step)
    return full.withColumn("option_order", final).drop("bank_id", "option_map", "option_texts")


def violations(papers: DataFrame, items: DataFrame, questions: DataFrame, options: DataFrame) -> DataFrame:
    """The first rule each arrangement row breaks, null when none.

    Repeated orders and questions are found by counting per paper, which
    combines before the shuffle, so one huge paper does not gather in a task.
    """
    orders = items.groupBy("set_id", "question_order").agg(F.count("*").alias("n_order"))
    repeats = items.groupBy("set_id", "question_id").agg(F.count("*").alias("n_question"))
    known = questions.select("question_id", F.col("version_id").alias("question_version"), "correct_option_id")
    full = (
        items.join(orders, ["set_id", "question_order"]).join(repeats, ["set_id", "question_id"])
        .join(papers.select("set_id", "version_id"), "set_id")
        .join(known, "question_id", "left")
        .join(options_per_question(options).select("question_id", "option_ids"), "question_id", "left")
    )
    given = F.col("option_order")
    code = (
        F.when(F.col("n_order") > 1, "DUPLICATE_QUESTION_ORDER")
        .when(F.col("question_order") < 1, "INVALID_QUESTION_ORDER")
        .when(F.col("question_version").isNull(), "QUESTION_NOT_FOUND")
        .when(F.col("question_version") != F.col("version_id"), "FOREIGN_SUBJECT_QUESTION")
        .when(F.col("n_question") > 1, "DUPLICATE_QUESTION_IN_PAPER")
        .when(F.size(given) != 4, "INVALID_OPTION_COUNT")
        .when(F.size(F.array_distinct(given)) != 4, "DUPLICATE_OPTION_IDS")
        .when(F.size(F.array_except(given, "option_ids")) > 0, "FOREIGN_OPTION_ID")
        .when(F.col("correct_option_id").isNotNull() & ~F.array_contains(given, F.col("correct_option_id")), "CORRECT_OPTION_MISSING")
    )
    return full.select("set_id", "question_id", "question_order", "option_order", code.alias("violation"))


def paper_verdicts(papers: DataFrame, checked: DataFrame) -> DataFrame:
    """B16 per paper: valid iff it has rows and none breaks a rule."""
    per = checked.groupBy("set_id").agg(F.count("*").alias("n_items"), F.count("violation").alias("n_bad"))
    return papers.join(per, "set_id", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0))).withColumn(
        "verdict", F.when(F.col("n_items") == 0, "EMPTY_ARRANGEMENTS").when(F.col("n_bad") > 0, "REJECTED").otherwise("VALID")
    )


def total_marks(count: Column, per_question: Column, given: Column) -> Column:
    """Marks stated on the paper, else questions times marks each."""
    stated = F.when(given != 0, given)
    return F.coalesce(stated, count.cast("double") * F.coalesce(per_question, F.lit(1.0)))


def save_papers(papers: DataFrame, items: DataFrame, questions: DataFrame, options: DataFrame) -> DataFrame:
    """Headers of the papers that pass every check."""
    verdicts = paper_verdicts(papers, violations(papers, items, questions, options)).filter("verdict = 'VALID'")
    marks = total_marks(F.col("n_items"), F.col("marks_per_question"), F.col("given_marks"))
    return verdicts.select(
        "set_id", "version_id", F.trim("title").alias("title"), F.lit("QUESTION_PAPER").alias("set_type"),
        F.col("n_items").alias("question_count"), marks.alias("total_marks"), F.lit("ACTIVE").alias("status"),
    )


def paper_rows(papers: DataFrame, items: DataFrame, questions: DataFrame, options: DataFrame, homes: DataFrame) -> DataFrame:
    """Child rows of the papers that pass every check: items with their option snapshot, and scopes.

    Returns set_id, kind, place, key, value, marks: 'item' (question id, option ids as arranged) and 'scope'
    (node of a question on the paper, each once). Ids are bank ids already (C13).
    """
    good = paper_verdicts(papers, violations(papers, items, questions, options)).filter("verdict = 'VALID'").select("set_id", "marks_per_question")
    kept = items.join(good, "set_id")
    marks = F.coalesce(F.col("marks_per_question"), F.lit(1)).cast("double")
    rows = kept.select(
        "set_id", F.lit("item").alias("kind"), F.col("question_order").alias("place"), F.col("question_id").cast("string").alias("key"),
        F.array_join("option_order", ",").alias("value"), marks.alias("marks"),
    )
    scopes = kept.select("set_id", "question_id").join(homes, "question_id").select("set_id", "node_id").distinct()
    none = [F.lit(None).cast(t) for t in ("bigint", "string", "double")]
    return rows.union(scopes.select("set_id", F.lit("scope"), none[0], "node_id", none[1], none[2]))


def rebuild(items: DataFrame, questions: DataFrame, options: DataFrame) -> DataFrame:
    """Each paper question with options in snapshot order, labels and key, one row per question.

    Options travel as one map per question, so the order stored on the paper is
    applied without exploding and regrouping.
    """
    full = items.join(questions.select("question_id", "stem", "correct_option_id"), "question_id").join(
        options_per_question(options).select("question_id", "option_texts"), "question_id", "left"
    )
    order = F.col("option_order")
    texts = F.transform(order, lambda o, i: F.struct(option_letter(i).alias("letter"), o.alias("id"), F.try_element_at("option_texts", o).alias("text")))
    shown = F.filter(texts, lambda x: x["text"].isNotNull())
    right = F.try_element_at(F.filter(shown, lambda x: x["id"] == F.col("correct_option_id")), F.lit(-1))
    return full.select(
        "set_id", F.col("question_order").alias("question_number"), "question_id", "stem",
        F.array_join(F.transform(shown, lambda x: F.concat(x["letter"], F.lit(") "), x["text"])), "|").alias("option_labels"),
        F.coalesce(right["letter"], F.lit("A")).alias("correct_letter"), F.coalesce(right["text"], F.lit("")).alias("correct_text"),
    )


def remove_questions(items: DataFrame, removed: DataFrame) -> DataFrame:
    """Drop questions from papers and number the rest 1..N in their old order."""
    left = items.join(removed, ["set_id", "question_id"], "left_anti")
    order = [F.col("question_order"), F.col("question_id"), F.col("l_suppkey")]
    return numbered(left, ["set_id"], F.floor(F.col("question_order") / 1024), order, "question_number")
