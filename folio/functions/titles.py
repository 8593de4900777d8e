"""Headings: what may be a unit, a lesson or an exercise label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.numbers import strip_space
from folio.functions.text import WORD_END, WORD_START, clean_heading  # noqa: F401

# Words that are never a unit number.
NOT_A_NUMBER = (
    "is", "the", "and", "of", "to", "in", "for", "on", "with", "by", "from", "digit", "part", "unit", "chapter", "a",
    "an", "as", "at", "be", "this", "that", "which", "are", "was", "were", "or", "not", "equal", "dots", "filled",
)
LABEL_WORDS = ("part", "unit", "chapter", "section")

# Openings of questions that are not exercise headings.
QUESTION_STARTERS = (
    "creative question", "sample question", "short answer", "answer to the", "based on the", "in the figure",
    "find the value", "which is the", "what is the", "reducing a fraction", "secondary data", "if the", "when is it",
    "the lengths of", "simplify (", "evaluate", "condition hypotenuse", "show that", "estimate the value",
    "a stick of", "which one is", "what is the h.c.f", "what is the l.c.m", "the statistics of", "the weights",
    "dybisects", "similar triangles", "prove that", "solve :",
)

# Heading and contents-entry patterns.
UNIT_HEADING = r"(?i)^(UNIT|CHAPTER|MODULE|PART)\s+([A-Za-z0-9.\-]+)\s*[:.\-—]?\s*(.*)$"
LESSON_HEADING = r"(?i)^(LESSON|SECTION|TOPIC)\s+([A-Za-z0-9.\-]+)\s*[:.\-—]?\s*(.*)$"
DOTTED_HEADING = r"^(\d+\.\d+)\s+([A-Z].*)$"
CONTENTS_ENTRY = (
    r"(?i)(\.{3,}|_{3,}|-{3,})\s*(page\s*)?\d+($|[^\p{L}\p{N}_])|(^|[^\p{L}\p{N}_])page\s+\d+$"
)


def is_contents_entry(line: Column) -> Column:
    """Leaders followed by a number, or a trailing 'page N'."""
    return line.rlike(CONTENTS_ENTRY)


def is_contents_marker(line: Column) -> Column:
    """B4 for one line."""
    t = F.lower(strip_space(line))
    return t.isin("contents", "table of contents", "index", "content") | t.startswith("table of contents") | t.startswith(
        "contents"
    )


def is_unit_number(number: Column, label: Column) -> Column:
    """B6."""
    raw = strip_space(number)
    low = F.lower(raw)
    same = low == F.lower(strip_space(F.coalesce(label, F.lit(""))))
    shaped = raw.rlike(r"(?i)^(\d+|[IVXLCDM]+|[A-Za-z])$")
    return (
        F.when(number.isNull() | (number == ""), F.lit(True))
        .when(same | low.isin(*LABEL_WORDS) | low.isin(*NOT_A_NUMBER), F.lit(False))
        .otherwise(shaped)
    )


def is_unit_title(title: Column) -> Column:
    """B7."""
    t = clean_heading(title)
    opener = t.rlike(
        r"(?i)^(and|or|but|which|that|filled in|equal to|moving left|is|are)" + WORD_END
    )
    formula = t.rlike(r"[=+−*/]") & t.rlike(r"(?i)[a-z]\s*=\s*[a-z0-9]")
    return (
        F.when(title.isNull() | (title == ""), F.lit(False))
        .otherwise(~(t.rlike(r"^\d+$") | opener | (F.length(t) > 100) | formula | (F.length(t) <= 2)))
    )


def is_lesson_title(title: Column) -> Column:
    """B8."""
    t = clean_heading(title)
    opener = t.rlike(r"(?i)^(and|or|but|which|that|is|are)" + WORD_END)
    equation = t.rlike(r"^[A-Za-z]\s*=\s*") | (t.rlike("[=−]") & (F.length(t) < 30) & t.rlike(r"\d"))
    return F.when(title.isNull() | (title == ""), F.lit(False)).otherwise(
        ~(opener | equation | (F.length(t) > 120))
    )


def contents_label(number: Column, label: Column, title: Column) -> Column:
    """H18 for units: 'Chapter 3 — Title' unless the title already says so."""
    has = number.isNotNull() & (number != "")
    low = F.lower(title)
    said = low.startswith(F.concat(F.lit("chapter "), F.lower(number))) | low.startswith(
        F.concat(F.lit("unit "), F.lower(number))
    )
    long = F.concat(F.coalesce(label, F.lit("Chapter")), F.lit(" "), number, F.lit(" — "), clean_heading(title))
    return F.when(has & ~said, long).otherwise(clean_heading(title))


def lesson_label(number: Column, title: Column) -> Column:
    """H18 for lessons."""
    has = number.isNotNull() & (number != "")
    return F.when(has & ~title.startswith(number), F.concat(number, F.lit(" "), clean_heading(title))).otherwise(
        clean_heading(title)
    )


def _first_line(c: Column) -> Column:
    return clean_heading(F.split(F.coalesce(c, F.lit("")), r"\n")[0])


# Fixed value: an exercise or practice heading that carries its number.
NUMBERED_EXERCISE = (
    r"(?i)(?:^|[^\p{L}\p{N}_])(Exercise\s+\d{1,2}\.\d{1,2}|Practice\s+\d{1,2}\.\d{1,2}|Exercise\s+[A-Za-z]"
    r"|Practice\s+Problems?\s*\d*)" + "(?:$|[^\\p{L}\\p{N}_])"
)


def exercise_label(text: Column, title: Column, chapter: Column) -> Column:
    """The exercise heading a block states; nothing is inferred.

    Checks, in order: a numbered heading in the first line or the title; a
    number whose dot was misread ('501' -> 5.1); a single number near the
    chapter; a bare 'Exercise' line.
    """
    first, head = _first_line(text), clean_heading(title)
    low = F.lower(first)
    asks = F.lit(False)
    for q in QUESTION_STARTERS:
        asks = asks | low.startswith(q)
    asks = asks & ~first.rlike("(?i)^Exercise" + WORD_END)

    in_line, in_title = F.regexp_extract(first, NUMBERED_EXERCISE, 1), F.regexp_extract(head, NUMBERED_EXERCISE, 1)
    stated = clean_heading(F.when(in_line != "", in_line).otherwise(in_title))
    major = F.regexp_extract(stated, r"(\d+)(?:\.(\d+))?", 1)
    minor = F.regexp_extract(stated, r"(\d+)(?:\.(\d+))?", 2)
    counted = F.coalesce(chapter.rlike(r"^\d+$"), F.lit(False))
    ch = chapter.try_cast("int")
    far = F.abs(major.try_cast("int") - ch) > 1
    conflict = counted & (major != "") & (major != chapter) & ((minor != "") | far)

    sample = F.split(F.coalesce(text, F.lit("")), r"\n")
    dotted = "(?i)(?:^|[^\\p{L}\\p{N}_])Exercise\\s+(\\d{1,2})[0.\\-·•°\ufffd\\s]+(\\d{1,2})(?:$|[^\\p{L}\\p{N}_])"
    single = r"(?i)(?:^|[^\p{L}\p{N}_])Exercise\s+(\d{1,2})(?:$|[^\p{L}\p{N}_])"

    def of_line(raw: Column) -> Column:
        line = strip_space(raw)
        a, b = F.regexp_extract(line, dotted, 1), F.regexp_extract(line, dotted, 2)
        split_ok = (a != "") & (b.try_cast("int") <= 20) & (~counted | (a == chapter))
        n = F.regexp_extract(line, single, 1)
        near = (n != "") & (~counted | (F.abs(n.try_cast("int") - ch) <= 1))
        return F.when(split_ok, F.concat(F.lit("Exercise "), a, F.lit("."), b)).when(
            near, F.concat(F.lit("Exercise "), n)
        )

    from_lines = F.try_element_at(F.filter(F.transform(sample, of_line), lambda x: x.isNotNull()), F.lit(1))
    bare = (first.rlike("(?i)^Exercise\\s*[:.\\-—]?$") | F.lower(head).isin("exercise", "exercises")) & (
        F.length(first) <= 15
    )
    none = F.lit(None).cast("string")
    return (
        F.when(asks, none)
        .when(stated != "", F.when(conflict, none).otherwise(stated))
        .otherwise(F.coalesce(from_lines, F.when(bare, F.lit("Exercise"))))
    )


def node_kind(label: Column, book_title: Column) -> Column:
    """Chapter, part or unit."""
    low = F.lower(strip_space(F.coalesce(label, F.lit(""))))
    is_math = F.lower(F.coalesce(book_title, F.lit(""))).contains("math")
    return F.when(low.contains("chapter") | is_math, "chapter").when(low.contains("part"), "part").otherwise("unit")


# Words that show a number is not a printed page number.
NOT_A_PAGE = "(example|question|exercise|figure|forma|class|part|unit|chapter|activity|step)"


def printed_page(line: Column, total_pages: Column) -> Column:
    """H30 for one header line: 'Title 27' or '28 Title' within the book, else null."""
    blocked = line.rlike("(?i)" + WORD_START + NOT_A_PAGE + WORD_END)
    after = F.regexp_extract(
        line, r"(?i)(?:^|[^\p{L}\p{N}_])(?:[A-Z][a-z]+(?:\s+[A-Za-z]+){0,3})\s+(\d{1,3})(?:$|[^\p{L}\p{N}_])", 1
    ).try_cast("int")
    before = F.regexp_extract(line, r"^(\d{1,3})\s+[A-Z][a-z]+", 1).try_cast("int")
    inside = [F.when(n.between(1, total_pages), n) for n in (after, before)]
    return F.when(blocked, F.lit(None).cast("int")).otherwise(F.coalesce(*inside))


def source_label(kind: Column, number: Column) -> Column:
    """H17: 'Chapter 3', or the bare word without a number."""
    word = F.initcap(kind)
    return F.when(number.isNull() | (number == ""), word).otherwise(F.concat(word, F.lit(" "), number))
