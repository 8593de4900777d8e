"""Thresholds, markers and subject profiles.

Fixed values: these must equal the reference's for results to agree.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    # layout thresholds
    max_line_gap_ratio: float = 1.45
    heading_1_ratio: float = 1.40
    heading_2_ratio: float = 1.20
    heading_3_ratio: float = 1.08
    script_size_ratio: float = 0.88
    superscript_offset_ratio: float = 0.18
    subscript_offset_ratio: float = 0.15
    char_gap: float = 3.0
    table_min_rows: int = 3
    table_min_cols: int = 2
    header_zone: float = 0.08
    footer_zone: float = 0.08
    running_min_pages: int = 2
    running_sample_pages: int = 12
    callout_gap: float = 35.0
    list_indent: float = 10.0
    list_gap: float = 10.0
    # semantic markers
    example: tuple[str, ...] = ("Example", "Worked Example", "Problem", "Sample Problem")
    activity: tuple[str, ...] = (
        "Activity", "Work in pairs", "Look at the picture", "Pair work", "Group work", "Class work", "Hands-on",
    )
    exercise: tuple[str, ...] = (
        "Exercise", "Exercises", "Practice", "Questions and Exercises", "Review Questions", "Check Yourself",
    )
    definition: tuple[str, ...] = (
        "Definition", "Theorem", "Rule", "Law", "Formula", "Corrolary", "Postulate",
    )
    note: tuple[str, ...] = ("Note", "N.B.", "Observe", "Remember", "Important", "Caution", "Notice")

    def markers(self) -> dict[str, tuple[str, ...]]:
        """Marker lists in the order a line is tested against them."""
        return {
            "example": self.example,
            "activity": self.activity,
            "exercise": self.exercise,
            "definition": self.definition,
            "note": self.note,
        }


@dataclass(frozen=True)
class Profile:
    code: str
    name: str
    domain: str
    aliases: tuple[str, ...] = field(default_factory=tuple)
    title_patterns: tuple[str, ...] = field(default_factory=tuple)
    keywords: tuple[str, ...] = field(default_factory=tuple)
    negative_keywords: tuple[str, ...] = field(default_factory=tuple)


# The three subjects known by default.
PROFILES: tuple[Profile, ...] = (
    Profile(
        "english-for-today", "English for Today", "LANGUAGE",
        ("English for Today", "English-for-Today", "EnglishForToday"),
        ("english for today", "english-for-today", "englishfortoday"),
        ("read the passage", "dialogue", "ask and answer", "lesson", "unit", "vocabulary", "look at the picture"),
    ),
    Profile(
        "english-grammar", "English Grammar and Composition", "LANGUAGE",
        ("English Grammar", "Grammar and Composition", "English Grammar & Composition",
         "English Grammar and Composition"),
        ("english grammar", "grammar and composition", "grammar & composition", "english grammar & composition"),
        ("tense", "preposition", "clause", "verb", "parts of speech", "sentence", "composition", "voice change"),
    ),
    Profile(
        "mathematics", "Mathematics", "STEM",
        ("Mathematics", "General Mathematics", "Math"),
        ("mathematics", "general mathematics", "math"),
        ("theorem", "proof", "solution", "algebra", "geometry", "equation", "formula", "fraction", "exercise",
         "worked example"),
    ),
)

PROFILE_SCHEMA = (
    "code string, name string, domain string, aliases array<string>, title_patterns array<string>, "
    "keywords array<string>, negative_keywords array<string>"
)

RULES_SCHEMA = (
    "layout_thresholds map<string,double>, semantic_markers map<string,array<string>>"
)

_THRESHOLD_FIELDS = {
    "max_line_gap_ratio": "max_line_gap_ratio",
    "heading_level_1_min_ratio": "heading_1_ratio",
    "heading_level_2_min_ratio": "heading_2_ratio",
    "heading_level_3_min_ratio": "heading_3_ratio",
    "superscript_max_font_size_ratio": "script_size_ratio",
    "superscript_min_baseline_offset_ratio": "superscript_offset_ratio",
    "subscript_min_baseline_offset_ratio": "subscript_offset_ratio",
    "horizontal_char_gap_tolerance_pt": "char_gap",
    "table_min_rows": "table_min_rows",
    "table_min_cols": "table_min_cols",
    "header_zone_ratio": "header_zone",
    "footer_zone_ratio": "footer_zone",
    "header_footer_min_page_occurrences": "running_min_pages",
    "header_footer_sample_pages_max": "running_sample_pages",
}


def load_rules(spark: SparkSession, path: str) -> Rules:
    """Rules file to typed values. A configuration file is one small row, so it may come to the driver."""
    raw = spark.read.schema(RULES_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path).head(2)
    if len(raw) != 1 or raw[0]["layout_thresholds"] is None:
        raise ValueError("rules file must hold one object with layout_thresholds")
    values: dict[str, object] = {}
    whole = {"table_min_rows", "table_min_cols", "running_min_pages", "running_sample_pages"}
    for source, target in _THRESHOLD_FIELDS.items():
        if source in raw[0]["layout_thresholds"]:
            number = raw[0]["layout_thresholds"][source]
            values[target] = int(number) if target in whole else number
    for kind, starters in (raw[0]["semantic_markers"] or {}).items():
        target = kind.removesuffix("_starters")
        if target in Rules.__dataclass_fields__:
            values[target] = tuple(starters)
    return Rules(**values)


def load_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Subject profiles file as a table in file order: a JSON list, or an object with a list `profiles`.

    An empty file and an entry without code, name or domain are errors. A configuration file is small,
    so it may come to the driver.
    """
    both = f"{PROFILE_SCHEMA}, profiles array<struct<{', '.join(c.replace(' ', ':', 1) for c in PROFILE_SCHEMA.split(', '))}>>"
    found = spark.read.schema(both).option("multiLine", True).option("mode", "FAILFAST").json(path).collect()
    rows = [p for r in found for p in (r["profiles"] if r["profiles"] is not None else [r])]
    if not rows:
        raise ValueError("profiles file must hold at least one profile")
    if any(r is None or not (r["code"] and r["name"] and r["domain"]) for r in rows):
        raise ValueError("a profile needs code, name and domain")
    return profiles_frame(spark, tuple(
        Profile(r["code"], r["name"], r["domain"], tuple(r["aliases"] or ()), tuple(r["title_patterns"] or ()),
                tuple(r["keywords"] or ()), tuple(r["negative_keywords"] or ()))
        for r in rows
    ))


def profiles_frame(spark: SparkSession, profiles: tuple[Profile, ...] = PROFILES) -> DataFrame:
    """Profiles as a small table with their rank; a later profile with the same code replaces an earlier one."""
    latest: dict[str, Profile] = {}
    for p in profiles:
        latest.pop(p.code, None)
        latest[p.code] = p
    rows = [
        (i, p.code, p.name, p.domain, list(p.aliases), list(p.title_patterns), list(p.keywords),
         list(p.negative_keywords))
        for i, p in enumerate(latest.values())
    ]
    return spark.createDataFrame(rows, f"rank int, {PROFILE_SCHEMA}")


def starts_with_any(text, starters: tuple[str, ...]):
    """Case-blind prefix test against a marker list."""
    low = F.lower(text)
    test = F.lit(False)
    for s in starters:
        test = test | low.startswith(s.lower())
    return test
