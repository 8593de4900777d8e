"""Column expressions over text: clean-up, tests, hashes, estimates."""

from __future__ import annotations

from string import ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.numbers import DIGIT, SPACE, strip_space

WORD_START = r"(^|[^\p{L}\p{N}_])"
WORD_END = r"($|[^\p{L}\p{N}_])"


def clean_heading(c: Column) -> Column:
    """H1: one kind of space, one kind of dash, no control characters."""
    s = F.regexp_replace(c, "\u00a0", " ")
    s = F.regexp_replace(s, "[\u2013\u2014]", " — ")
    s = F.regexp_replace(s, "[\ufffd\\x00-\\x1f\\x7f-\\x9f]", "")
    s = F.regexp_replace(s, r"\s+", " ")
    s = F.regexp_replace(s, r"—\s*—+", "—")
    return F.trim(F.coalesce(s, F.lit("")))


def running_text_key(c: Column) -> Column:
    """H2: what a running header says once its page number is taken away."""
    t = F.lower(F.trim(F.regexp_replace(c, f"{SPACE}+", " ")))
    t = F.regexp_replace(t, f"^{DIGIT}+ *", "")
    t = F.regexp_replace(t, f" *{DIGIT}+$", "")
    return F.trim(t)


def is_page_number(c: Column) -> Column:
    """H3: a line that is nothing but a page number."""
    t = strip_space(c)
    forms = (f"^{DIGIT}+$", f"(?i)^page{SPACE}+{DIGIT}+$", f"^{DIGIT}+{SPACE}*[-/]{SPACE}*{DIGIT}+$")
    return t.rlike(forms[0]) | t.rlike(forms[1]) | t.rlike(forms[2])


def stem_key(c: Column) -> Column:
    """H5: a stem without case, punctuation or spacing; `$` and backslash stay."""
    t = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s$\\]", " ")
    return F.trim(F.regexp_replace(t, f"{SPACE}+", " "))


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def content_hash(c: Column) -> Column:
    """H6: hash of the text with its white space normalised."""
    return F.sha2(collapse_space(c), 256)


MARKUP = r"[\${}\[\]<>=\\_^*#]"


def markup_count(c: Column) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, MARKUP, ""))


def token_estimate(chars: Column, marks: Column) -> Column:
    """H7 from counts: a token per 3.4 characters plus 0.4 per markup symbol, at least 1; nothing for no text."""
    by_chars = F.ceil(chars.cast("double") / F.lit(3.4).cast("double"))
    by_marks = F.ceil(marks.cast("double") * F.lit(0.4).cast("double"))
    return F.when(chars == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), by_chars + by_marks)).cast("bigint")


def estimate_tokens(c: Column) -> Column:
    """H7 of a text."""
    return token_estimate(F.length(c), markup_count(c))


def prompt_tokens(system: Column, user: Column, schema_tokens: int = 450, envelope: int = 60) -> Column:
    return system + user + F.lit(schema_tokens + envelope)


def is_good_native_text(text: Column, n_words: Column) -> Column:
    """B1: enough characters, enough words, mostly letters."""
    t = strip_space(F.coalesce(text, F.lit("")))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return (F.length(t) >= 40) & (n_words >= 8) & (2 * letters >= F.length(t))


def is_stem_complete(c: Column) -> Column:
    """Long enough and with some prose."""
    t = strip_space(c)
    return (F.length(t) >= 8) & (F.length(F.regexp_replace(t, "[^a-zA-Z]", "")) >= 4)


def snippet(c: Column, size: int = 200) -> Column:
    """The first characters, marked when something was left out."""
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def scrub_message(c: Column) -> Column:
    """Drop links and organisation ids, mask keys."""
    t = F.regexp_replace(c, r"https?://\S+", "")
    t = F.regexp_replace(t, "org_[a-zA-Z0-9]+", "")
    t = F.regexp_replace(t, "gsk_[a-zA-Z0-9]+", "[REDACTED]")
    return collapse_space(t)


def retry_seconds(message: Column, default: float = 60.0) -> Column:
    """H22: 'try again in 1h20m30s', '34 minutes', '16.7 s' -> seconds."""
    low = F.lower(message)
    joined = r"try again in (?:(\d+)h)?(?:(\d+)m)?(?:(\d+\.?\d*)s)?"

    def part(i: int) -> Column:
        return F.coalesce(F.regexp_extract(low, joined, i).try_cast("double"), F.lit(0.0))

    composite = part(1) * 3600.0 + part(2) * 60.0 + part(3)
    minutes = F.regexp_extract(low, r"try again in (\d+\.?\d*)\s*(?:m|min|minutes)", 1).try_cast("double")
    seconds = F.regexp_extract(low, r"try again in (\d+\.?\d*)\s*(?:s|sec|seconds)", 1).try_cast("double")
    return F.when(composite > 0, composite).otherwise(F.coalesce(minutes * 60.0, seconds, F.lit(default)))


def subject_route(title: Column, subject_code: Column) -> Column:
    """The title decides, then the subject, then mathematics."""
    t = F.lower(title)
    return (
        F.when(t.contains("grammar"), F.lit("english_grammar"))
        .when(t.contains("english for today"), F.lit("english_for_today"))
        .when(t.contains("math"), F.lit("mathematics"))
        .otherwise(F.coalesce(F.lower(subject_code), F.lit("mathematics")))
    )


def math_latex(c: Column) -> Column:
    """LaTeX for text that is a formula already, else null; prose is left alone."""
    is_root = c.contains("√")
    rooted = F.regexp_replace(F.replace(c, F.lit("√"), F.lit("\\sqrt{")), r"\\sqrt\{(\d+)", r"\\sqrt{$1}")
    side = r"[a-zA-Z0-9()^\s+\-*/×÷.,]+"
    t = strip_space(c)
    is_equation = c.contains("=") & t.rlike(rf"^[a-zA-Z0-9()^\s+\-*/×÷.,:]+\s*=\s*{side}$")
    equation = F.replace(F.replace(t, F.lit("×"), F.lit(" \\times ")), F.lit("÷"), F.lit(" \\div "))
    return F.when(is_root, rooted).when(is_equation, equation)


def math_segments(c: Column) -> Column:
    """Prose and formula pieces in order, as array<struct<kind, content>>."""
    pattern = r"\$\$[\s\S]*?\$\$|\$[^$]+?\$|\\\([\s\S]*?\\\)"
    found = F.regexp_extract_all(c, F.lit(f"({pattern})"), 1)
    # An unused control character stands where each formula was, so the prose splits there.
    prose = F.split(F.regexp_replace(c, pattern, "\u0001"), "\u0001", -1)

    def formula(m: Column) -> Column:
        display = m.startswith("$$") & m.endswith("$$")
        single = m.startswith("$") & ~display
        inner = F.when(single, F.substring(m, F.lit(2), F.length(m) - 2)).otherwise(
            F.substring(m, F.lit(3), F.length(m) - 4)
        )
        return F.struct(
            F.when(display, F.lit("display-math")).otherwise(F.lit("math")).alias("kind"),
            strip_space(inner).alias("content"),
        )

    def at(i: Column, piece: Column) -> Column:
        text = F.array(F.struct(F.lit("text").alias("kind"), piece.alias("content")))
        math = F.try_element_at(found, i + 1)
        keep = F.filter(text, lambda s: s["content"] != "")
        return F.when(math.isNotNull(), F.concat(keep, F.array(formula(math)))).otherwise(keep)

    return F.flatten(F.transform(prose, lambda p, i: at(i, p)))


def is_bold(flags: Column, font: Column) -> Column:
    """H9."""
    f = F.lower(font)
    return (flags.bitwiseAND(16) > 0) | f.contains("bold") | f.contains("black")


def is_italic(flags: Column, font: Column) -> Column:
    f = F.lower(font)
    return (flags.bitwiseAND(2) > 0) | f.contains("italic") | f.contains("oblique")


def canonical_question_hash(stem: Column, option_texts: Column, correct: Column, kind: str = "MCQ") -> Column:
    """Equal for questions that differ only in case, spacing or option order."""
    def key(c: Column) -> Column:
        return F.lower(collapse_space(F.coalesce(c, F.lit(""))))

    opts = F.array_sort(F.transform(F.filter(option_texts, lambda o: o != ""), key))
    unit = "\u001f"
    return F.sha2(
        F.concat_ws(unit, F.lit(kind.upper()), key(stem), F.array_join(opts, unit), key(correct)), 256
    )


def option_letter(index: Column) -> Column:
    """0, 1, 2 ... -> A, B, C ...; null past Z."""
    return F.try_element_at(F.array(*[F.lit(x) for x in ascii_uppercase]), (index + 1).cast("int"))


# Reason codes and what a reader is told.
READINESS_TEXT = {
    "TEXTBOOK_DELETED": "This textbook has been deleted.",
    "INGESTION_INCOMPLETE": "Textbook ingestion is incomplete.",
    "GRADE_NOT_ASSIGNED": "Assign Class / Grade first.",
    "SUBJECT_NOT_RESOLVED": "Assign a subject first.",
    "SUBJECT_NOT_SUPPORTED": "Assessment generation is not supported for this subject domain.",
    "STRUCTURE_NEEDS_REFRESH": "Textbook structure needs refresh.",
    "PDF_NOT_AVAILABLE": "The textbook PDF file is not available.",
}


# What the capabilities answer says instead, where it differs.
CAPABILITY_TEXT = READINESS_TEXT | {
    "INGESTION_INCOMPLETE": "Textbook ingestion is still processing or incomplete.",
    "GRADE_NOT_ASSIGNED": "Class / Grade has not been assigned to this textbook.",
    "SUBJECT_NOT_RESOLVED": "Academic Subject has not been resolved. Please edit metadata.",
    "SUBJECT_NOT_SUPPORTED": "MCQ assessment generation is not currently supported for this subject.",
    "STRUCTURE_NEEDS_REFRESH": "Curriculum structure needs to be refreshed.",
}


def reason_texts(codes: Column, texts: dict[str, str] | None = None) -> Column:
    """Codes to sentences; an unknown code stands for itself."""
    table = F.create_map(*[F.lit(x) for kv in (texts or READINESS_TEXT).items() for x in kv])
    return F.transform(codes, lambda r: F.coalesce(F.try_element_at(table, r), r))
