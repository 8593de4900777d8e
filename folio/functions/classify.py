"""Content types of text blocks, their titles and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.numbers import strip_space
from folio.functions.text import WORD_END, WORD_START

# What the first line (or a line) of each kind of block looks like.
SPEAKER = r"^[A-Z][a-zA-Z\s]{1,20}\s*:\s+"
TURN = r"^([A-Z][a-zA-Z\s]{1,20})\s*:\s*(.*)$"
TERM = r"(?m)^([A-Za-z\s]+)\s*[-–—:]\s*(.+)$"
GLOSSARY = "(?i)" + WORD_START + r"(vocabulary|key\s+words|glossary)" + WORD_END
GRAMMAR = r"(?i)^(Grammar|Rule\s*\d*|Structure|Note|Remember)\s*[:.\-—]?"
EXERCISE = (
    "(?i)" + WORD_START
    + r"(exercise|questions?|activity|fill\s+in\s+the\s+blanks?|choose\s+the\s+best\s+answer|match\s+the\s+column"
    + r"|answer\s+the\s+following)" + WORD_END
)
NUMBERED = r"^[0-9]+[.)]\s+"
LETTERED = r"^[a-d][.)]\s+"
DIRECTIVE = (
    r"(?i)^(Look\s+at\s+the|Work\s+in\s+pairs|Discuss\s+in|Read\s+and\s+say|Listen\s+and|Now\s+read)" + WORD_END
)
WRITING = "(?i)" + WORD_START + r"(write\s+a\s+paragraph|write\s+a\s+letter|composition|dialogue\s+writing)" + WORD_END
PASSAGE = "(?i)" + WORD_START + r"(read\s+the\s+(following\s+)?passage|read\s+the\s+text|story)" + WORD_END
DEFINITION = r"(?i)^(Definition|Def\.)\s*[:.\-—]?"
DEFINED = "(?i)" + WORD_START + r"is\s+defined\s+as" + WORD_END
THEOREM = r"(?i)^(Theorem|Proposition|Corollary|Lemma|Formula)\s*[\d.]*\s*[:.\-—]?"
PROOF = r"(?i)^(Proof|Demonstration)\s*[:.\-—]?"
WORKED = r"(?i)^((Example|Problem|Worked\s+Example)\s*[\d.]*|Solution)\s*[:.\-—]?"
PRACTICE = (
    "(?i)" + WORD_START
    + r"(exercise|practice\s+problems?|questions?|evaluate|solve\s+the\s+following|simplify|find\s+the\s+value)" + WORD_END
)
SYMBOLS = "[=+\\-×÷√∈⊂∑∫<>≤≥]"


def solid_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n"), strip_space), lambda x: x != "")


def _first(lines: Column) -> Column:
    return F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))


def language_type(text: Column, lines: Column | None = None) -> Column:
    """H27; `lines` are the text's solid lines where they are a column already."""
    lines = solid_lines(text) if lines is None else lines
    first, n = _first(lines), F.size(lines)
    speakers = F.size(F.filter(lines, lambda x: x.rlike(SPEAKER)))
    terms = F.size(F.regexp_extract_all(text, F.lit(TERM), 0))
    return (
        F.when((speakers >= 2) | ((speakers >= 1) & (n <= 4)), "dialogue")
        .when((terms >= 2) | first.rlike(GLOSSARY), "vocabulary")
        .when(first.rlike(GRAMMAR), "grammar_rule")
        .when(first.rlike(EXERCISE) | first.rlike(NUMBERED) | first.rlike(LETTERED), "exercise")
        .when(first.rlike(DIRECTIVE) & (n <= 3), "instruction")
        .when(first.rlike(WRITING), "writing_task")
        .when((n >= 3) | first.rlike(PASSAGE), "reading_passage")
        .otherwise("generic_text")
    )


def stem_type(text: Column, lines: Column | None = None) -> Column:
    """H28; `lines` as in `language_type`."""
    first = _first(solid_lines(text) if lines is None else lines)
    return (
        F.when(first.rlike(DEFINITION) | first.rlike(DEFINED), "definition")
        .when(first.rlike(THEOREM), "theorem")
        .when(first.rlike(PROOF), "proof")
        .when(first.rlike(WORKED), "worked_example")
        .when(first.rlike(PRACTICE) | first.rlike(NUMBERED), "exercise")
        .when(text.rlike(SYMBOLS), "mathematical_explanation")
        .otherwise("generic_text")
    )


def block_type(text: Column, domain: Column) -> Column:
    """H27 for LANGUAGE, H28 for STEM, the first then the second otherwise."""
    t = strip_space(text)
    lang, stem = language_type(t), stem_type(t)
    return (
        F.when(t == "", "generic_text").when(domain == "LANGUAGE", lang).when(domain == "STEM", stem)
        .when(lang != "generic_text", lang).otherwise(stem)
    )


def block_title(kind: Column, text: Column, lines: Column | None = None) -> Column:
    """Title that goes with a type: a fixed word, or the start of the first line; `lines` as in `language_type`."""
    first = _first(solid_lines(strip_space(text)) if lines is None else lines)
    fixed = {
        "dialogue": "Dialogue", "vocabulary": "Vocabulary", "exercise": "Exercise", "instruction": "Instruction",
        "writing_task": "Writing Task", "definition": "Definition", "proof": "Proof",
    }
    out = F.when(kind.isin("grammar_rule", "theorem", "worked_example"), F.substring(first, 1, 60))
    out = out.when(kind == "reading_passage", F.when(F.length(first) <= 60, first).otherwise("Reading Passage"))
    for name, title in fixed.items():
        out = out.when(kind == name, title)
    return out


def typed_blocks(blocks: DataFrame) -> DataFrame:
    """`blocks` (content_text, domain) with `node_type` and `title`, as `block_type` and `block_title` give them.

    The stripped text, its lines and its language type are columns of steps of their own: as parts of one expression each rule
    would split and strip the whole text again.
    """
    t, lines, lang = F.col("__text"), F.col("__lines"), F.col("__lang")
    split = blocks.withColumn("__text", strip_space(F.col("content_text"))).withColumn("__lines", solid_lines(t))
    is_stem = F.coalesce(F.col("domain") == "STEM", F.lit(False))
    read = split.withColumn("__lang", F.when(~is_stem, language_type(t, lines)))
    kind = (
        F.when(t == "", "generic_text").when(F.col("domain") == "LANGUAGE", lang)
        .when(~is_stem & (lang != "generic_text"), lang).otherwise(stem_type(t, lines))
    )
    typed = read.withColumn("node_type", kind)
    return typed.withColumn("title", block_title(F.col("node_type"), t, lines)).drop("__text", "__lines", "__lang")


def dialogue_turns(text: Column) -> Column:
    """Turns of a dialogue; lines without a speaker belong to the narrator."""
    def turn(line: Column) -> Column:
        speaker = strip_space(F.regexp_extract(line, TURN, 1))
        spoken = speaker != ""
        return F.struct(
            F.when(spoken, speaker).otherwise("narrator").alias("speaker"),
            F.when(spoken, strip_space(F.regexp_extract(line, TURN, 2))).otherwise(line).alias("utterance"),
            spoken.alias("spoken"),
        )

    return F.transform(solid_lines(text), turn)


def speakers(text: Column) -> Column:
    """Distinct speakers in the order they first speak."""
    turns = F.filter(dialogue_turns(text), lambda t: t["spoken"])
    return F.array_distinct(F.transform(turns, lambda t: t["speaker"]))


def vocabulary_terms(text: Column) -> Column:
    """Terms with their meanings, in order."""
    terms, meanings = (F.regexp_extract_all(text, F.lit(TERM), g) for g in (1, 2))
    return F.transform(
        F.arrays_zip(terms.alias("t"), meanings.alias("m")),
        lambda x: F.struct(strip_space(x["t"]).alias("term"), strip_space(x["m"]).alias("meaning")),
    )


def block_payload(kind: Column, text: Column) -> Column:
    """What a node of this kind stores beside its text, as JSON: speakers and turns, or terms; null where there is nothing.

    The text is null or any string; a dialogue without a speaker has narrator turns only.
    """
    turns = F.transform(dialogue_turns(text), lambda t: F.struct(t["speaker"].alias("speaker"), t["utterance"].alias("utterance")))
    terms = vocabulary_terms(text)
    return F.when(kind == "dialogue", F.to_json(F.struct(speakers(text).alias("speakers"), turns.alias("turns")))).when(
        (kind == "vocabulary") & (F.size(terms) > 0), F.to_json(F.struct(terms.alias("terms")))
    )
