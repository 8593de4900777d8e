"""Candidate questions: rules, exact duplicates, accounting, acceptance, labels, shuffling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.numbers import strip_space
from folio.functions.text import collapse_space, is_stem_complete, option_letter, stem_key
from folio.operators.ordered import first_per, numbered

# Outcome categories of a candidate.
REJECTIONS = (
    "schema_rejected", "invalid_option_count", "duplicate_option_rejected", "invalid_correct_option_id",
    "invalid_source_chunk_rejected", "exact_question_duplicate_rejected", "near_duplicate_rejected",
    "deterministic_math_rejected", "llm_verification_rejected", "other_rejected",
)
OUTCOMES = (*REJECTIONS, "surplus_not_needed", "final_accepted", "unaccounted")


def declared_answer(options: Column, correct_id: Column) -> Column:
    """Text of the option named as correct."""
    return F.try_element_at(F.filter(options, lambda o: o["id"] == correct_id), F.lit(1))["text"]


def arithmetic_verdict(stem: Column, answer: Column) -> Column:
    """B15: 'square of n' and 'square root of n' against a declared answer made of digits.

    'right', 'wrong', or 'unchecked' where the stem's number or its square has more
    than 38 digits; null where the stem asks for neither or the answer is no number.
    A root is only checked for perfect squares.
    """
    wide = "decimal(38,0)"
    given = strip_space(answer)
    is_number = given.rlike(r"^\d+$")
    base_text = F.regexp_extract(stem, r"(?i)square\s+of\s+(\d+)", 1)
    base = base_text.try_cast(wide)
    square = F.try_multiply(base, base).try_cast(wide)
    of_square = F.when(base_text != "", F.when(square.isNull(), "unchecked").when(given == square.cast("string"), "right").otherwise("wrong"))
    root_text = F.regexp_extract(stem, r"(?i)square\s+root\s+of\s+(\d+)", 1)
    radicand = root_text.try_cast(wide)
    guess = F.round(F.sqrt(radicand.cast("double"))).try_cast(wide)
    # A double is off by some units for large roots: one Newton step, then the neighbours, in whole numbers.
    miss = F.try_subtract(radicand, F.try_multiply(guess, guess).try_cast(wide)).cast("double")
    near = F.try_add(guess, F.round(F.try_divide(miss, 2 * guess.cast("double"))).try_cast(wide)).try_cast(wide)
    tries = F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: F.try_add(F.coalesce(near, guess), d.cast(wide)).try_cast(wide))
    root = F.try_element_at(F.filter(tries, lambda r: (r >= 0) & (F.try_multiply(r, r).try_cast(wide) == radicand)), F.lit(1))
    of_root = F.when(
        root_text != "",
        F.when(radicand.isNull(), "unchecked").when(root.isNull(), F.lit(None)).when(given == root.cast("string"), "right").otherwise("wrong"),
    )
    both = F.when((of_square == "wrong") | (of_root == "wrong"), "wrong").otherwise(F.coalesce(of_square, of_root))
    return F.when(is_number, both)


def arithmetic_fails(stem: Column, answer: Column) -> Column:
    """Whether the arithmetic is wrong; what cannot be checked is not."""
    return F.coalesce(arithmetic_verdict(stem, answer) == "wrong", F.lit(False))


def first_failure(
    valid_chunks: Column, exact_duplicate: Column | None = None, near_duplicate: Column | None = None
) -> Column:
    """Category of the first rule a candidate breaks, null when it passes all.

    Expects columns stem, options, correct_option_id, explanation and
    source_chunk_ids; duplicate flags come from the joins that find them.
    """
    no = F.lit(False)
    stem = strip_space(F.coalesce("stem", F.lit("")))
    options, correct, cited = F.col("options"), F.col("correct_option_id"), F.col("source_chunk_ids")
    ids = F.filter(F.transform(options, lambda o: o["id"]), lambda i: i.isNotNull() & (i != ""))
    texts = F.transform(options, lambda o: collapse_space(F.lower(F.coalesce(o["text"], F.lit("")))))
    unknown = F.size(F.array_except(cited, valid_chunks)) > 0
    return (
        F.when(stem == "", "schema_rejected")
        .when(~is_stem_complete(stem), "other_rejected")
        .when(exact_duplicate if exact_duplicate is not None else no, "exact_question_duplicate_rejected")
        .when(near_duplicate if near_duplicate is not None else no, "near_duplicate_rejected")
        .when(options.isNull() | (F.size(options) != 4), "invalid_option_count")
        .when((F.size(ids) != 4) | (F.size(F.array_distinct(ids)) != 4), "duplicate_option_rejected")
        .when(F.exists(texts, lambda t: t == ""), "other_rejected")
        .when(F.size(F.array_distinct(texts)) != 4, "duplicate_option_rejected")
        .when(correct.isNull() | ~F.array_contains(ids, correct), "invalid_correct_option_id")
        .when(strip_space(F.coalesce("explanation", F.lit(""))) == "", "other_rejected")
        .when(cited.isNull() | (F.size(cited) == 0) | unknown, "invalid_source_chunk_rejected")
        .when(arithmetic_fails(F.col("stem"), declared_answer(options, correct)), "deterministic_math_rejected")
    )


def ungrounded_citations(candidates: DataFrame, chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cited chunk ids that their window does not hold."""
    cited = candidates.select(*keys, "question_id", F.explode("source_chunk_ids").alias("chunk_id"))
    return cited.join(chunks.select(*keys, "chunk_id").distinct(), [*keys, "chunk_id"], "left_anti")


def exact_first(candidates: DataFrame, keys: Sequence[str], order: str = "seq", cols: Sequence[str] = ()) -> DataFrame:
    """G1: the first candidate of each normalised stem, by a combined minimum rather than a window."""
    keyed = candidates.withColumn("stem_key", stem_key(F.col("stem")))
    return first_per(keyed, [*keys, "stem_key"], [F.col(order)], [order, "question_id", *cols])


def without_prior(candidates: DataFrame, prior: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """C17: candidates whose normalised stem was not in the previous set."""
    seen = prior.select(*keys, stem_key(F.col("stem")).alias("stem_key")).distinct()
    return candidates.withColumn("stem_key", stem_key(F.col("stem"))).join(seen, [*keys, "stem_key"], "left_anti")


def accounting(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per outcome; the parts add up to what was returned, and totals merge by sum."""
    outcome = F.coalesce("outcome", F.lit("unaccounted"))
    counts = [F.count_if(outcome == o).alias(o) for o in OUTCOMES]
    rejected = sum((F.col(r) for r in REJECTIONS[1:]), F.col(REJECTIONS[0]))
    balanced = F.col("candidates_returned") == (
        F.col("final_accepted") + F.col("total_rejected") + F.col("surplus_not_needed") + F.col("unaccounted")
    )
    return (
        outcomes.groupBy(*keys).agg(F.count("*").alias("candidates_returned"), *counts)
        .withColumn("total_rejected", rejected).withColumn("balanced", balanced)
    )


def merge_accounting(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accounts of rounds into accounts of jobs."""
    names = ["candidates_returned", *OUTCOMES, "total_rejected"]
    return parts.groupBy(*keys).agg(*[F.sum(n).cast("bigint").alias(n) for n in names])


def accept_by_quota(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """`accepted` or `surplus` for each verified candidate.

    In the first pass over several windows each window takes at most its quota
    (at least one); later rounds and single-window jobs take what is still
    needed. Overall no job takes more than it asked for.
    """
    full = candidates.join(jobs, "job_id")
    first_pass = (F.col("round") <= F.col("n_windows")) & (F.col("n_windows") > 1)
    bucket = F.floor(F.col("seq") / 4096)
    limited = numbered(full.filter(first_pass), ["job_id", "window_id"], bucket, [F.col("seq")], "place").withColumn(
        "in_quota", F.col("place") <= F.greatest(F.lit(1), F.col("quota"))
    ).drop("place")
    free = full.filter(~first_pass).withColumn("in_quota", F.lit(True))
    both = limited.unionByName(free)
    ranked = numbered(both.filter("in_quota"), ["job_id"], bucket, [F.col("seq")], "place")
    taken = ranked.withColumn("outcome", F.when(F.col("place") <= F.col("requested"), "final_accepted").otherwise("surplus_not_needed"))
    over = both.filter("not in_quota").withColumn("outcome", F.lit("surplus_not_needed"))
    return taken.drop("place").unionByName(over).select("job_id", "window_id", "seq", "question_id", "outcome")


def request_size(needed: Column, deficit: Column, first_pass: Column, ratio: float = 1.25, batch: int = 5) -> tuple[Column, Column]:
    """Questions to aim for, and candidates to ask for, in the next call."""
    target = F.when(first_pass & (deficit > 0), F.least(deficit, needed)).otherwise(F.least(F.lit(batch), needed))
    extra = F.when(first_pass, 1).otherwise(2)
    asked = F.least(F.ceil(target.cast("double") * ratio), needed + extra)
    return target.cast("bigint"), asked.cast("bigint")


def recent_stems(candidates: DataFrame, key: str, keep: int = 20) -> DataFrame:
    """The last `keep` stems in order, as one text; the rank is cut before the shuffle."""
    last = Window.partitionBy(key).orderBy(F.col("seq").desc())
    top = candidates.select(key, "seq", "stem").withColumn("back", F.row_number().over(last)).filter(F.col("back") <= keep)
    listed = F.array_sort(F.collect_list(F.struct("seq", "stem")))
    return top.groupBy(key).agg(listed.alias("s")).select(
        key, F.array_join(F.transform("s", lambda x: F.concat(F.lit("- "), x["stem"])), "\n").alias("exclusion_text")
    )


def labelled(options: Column) -> Column:
    """Options as 'A) text' in their given order."""
    return F.array_join(
        F.transform(options, lambda o, i: F.concat(option_letter(i), F.lit(") "), strip_space(o["text"]))), "|"
    )


def answer_letter(options: Column, correct_id: Column) -> Column:
    """Letter of the correct option; A when none matches."""
    at = F.array_position(F.transform(options, lambda o: o["id"]), correct_id)
    return F.when(at > 0, option_letter(at - 1)).otherwise("A")


def answer_key(candidates: DataFrame, key: str) -> DataFrame:
    """Numbered questions with labelled options and their key."""
    ranked = numbered(candidates, [key], F.floor(F.col("seq") / 4096), [F.col("seq")], "question_number")
    correct = F.col("correct_option_id")
    return ranked.select(
        key, "question_number", "question_id", labelled(F.col("options")).alias("option_labels"),
        answer_letter(F.col("options"), correct).alias("correct_letter"),
        F.coalesce(strip_space(declared_answer(F.col("options"), correct)), F.lit("")).alias("correct_text"),
    )


def shuffle_paper(questions: DataFrame, key: str, seed: str) -> DataFrame:
    """A reproducible shuffle of questions and of each question's options, with the key moved along.

    Questions are ordered by a seeded hash; its leading digits split a large
    paper into even parts.
    """
    salt = F.concat_ws("|", F.lit(seed), F.col(key).cast("string"), F.col("question_id").cast("string"))
    mixed = questions.withColumn("__h", F.sha2(salt, 256)).withColumn(
        "options",
        F.transform(
            F.array_sort(F.transform(
                "options", lambda o: F.struct(F.sha2(F.concat_ws("|", salt, o["id"]), 256).alias("h"), o["id"].alias("id"), o["text"].alias("text"))
            )),
            lambda o: F.struct(o["id"].alias("id"), o["text"].alias("text")),
        ),
    )
    ranked = numbered(mixed, [key], F.substring("__h", 1, 2), [F.col("__h")], "question_number")
    return ranked.select(
        key, "question_number", "question_id", labelled(F.col("options")).alias("option_labels"),
        answer_letter(F.col("options"), F.col("correct_option_id")).alias("correct_letter"),
    )


def stable_identity(candidates: DataFrame, scope: str) -> DataFrame:
    """Ids derived from content, so a retry gives the same ones; the correct id follows its option."""
    def fresh(prefix: str, *parts: Column) -> Column:
        return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32))

    base = [F.col(scope).cast("string"), F.col("question_id")]
    renamed = F.transform(
        "options", lambda o: F.struct(fresh("gen_opt_", *base, o["id"]).alias("id"), o["text"].alias("text"))
    )
    known = F.exists("options", lambda o: o["id"] == F.col("correct_option_id"))
    correct = F.when(known, fresh("gen_opt_", *base, F.col("correct_option_id"))).otherwise(F.col("correct_option_id"))
    named = candidates.select(
        scope, F.col("question_id").alias("old_id"), fresh("gen_q_", *base).alias("new_id"), renamed.alias("new_options"),
        correct.alias("new_correct"),
    )
    return named.select(
        scope, "old_id", F.col("new_id").alias("question_id"), F.col("new_options").alias("options"),
        F.col("new_correct").alias("correct_option_id"),
    )


def progress(events: DataFrame, requested: Column) -> DataFrame:
    """State of every job from its events."""
    counts = events.groupBy("job_id").agg(
        F.count_if(F.col("kind") == "accepted").alias("accepted"), F.count_if(F.col("kind") == "rejected").alias("rejected"),
        F.count_if(F.col("kind") == "surplus").alias("surplus"),
    ).withColumn("requested", requested)
    status = (
        F.when(F.col("accepted") >= F.col("requested"), "completed").when(F.col("accepted") > 0, "incomplete").otherwise("failed")
    )
    return counts.select(
        "job_id", "requested", F.least("accepted", "requested").alias("generated"), "rejected", "surplus",
        F.greatest(F.lit(0).cast("bigint"), F.col("requested") - F.col("accepted")).alias("deficit"), status.alias("status"),
    )
