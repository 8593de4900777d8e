"""What the front matter of a book says about it: grade, edition, subject, title."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.numbers import canonical_token, leading_int, strip_space
from folio.functions.text import WORD_END
from folio.rules import PROFILES, Profile

# How grades, editions and years are written. Group 1 is the whole phrase, group 2 its value.
GRADES = (
    "(?i)(?:^|[^\\p{L}\\p{N}_])((?:Class|Grade|Classes|Grades)\\s*[-:]?\\s*([A-Za-z0-9]+(?:\\s*-\\s*[A-Za-z0-9]+)?))" + WORD_END,
    "(?i)(?:^|[^\\p{L}\\p{N}_])(For\\s+Classes?\\s+([A-Za-z0-9]+))" + WORD_END,
)
EDITIONS = (
    "(?i)(?:^|[^\\p{L}\\p{N}_])((?:First|Second|Third|Fourth|Fifth|Revised|Special|National)\\s+Edition(?:\\s+\\d{4})?)" + WORD_END,
    "(?i)(?:^|[^\\p{L}\\p{N}_])(Edition\\s*[:\\-—]?\\s*\\d{4})" + WORD_END,
    "(?i)(?:^|[^\\p{L}\\p{N}_])(Academic\\s+Year\\s*[:\\-—]?\\s*\\d{4})" + WORD_END,
    "(?i)(?:^|[^\\p{L}\\p{N}_])(Reprint\\s*[:\\-—]?\\s*\\d{4})" + WORD_END,
)
YEARS = (
    "(?i)(?:^|[^\\p{L}\\p{N}_])(?:academic\\s+year|edition|published\\s+in|revised\\s+edition|prescribed\\s+for|copyright)"
    "\\s*[:\\-—]?\\s*(?:in\\s*)?(\\d{4})" + WORD_END,
    "(?:^|[^\\p{L}\\p{N}_])(19\\d{2}|20\\d{2}|21\\d{2})" + WORD_END,
)
LABEL_YEAR = YEARS[1]


def _grade_from(text: Column, source: str) -> list[Column]:
    found = []
    for pattern in GRADES:
        token = strip_space(F.regexp_extract(text, pattern, 2))
        first = strip_space(F.split(token, "-")[0])
        number = canonical_token(first)
        name = F.coalesce(number, F.when(token.rlike(r"^[\p{L}\p{N}]+$"), token))
        found.append(F.when((token != "") & name.isNotNull(), F.struct(
            F.concat(F.lit("class-"), F.lower(name)).alias("code"), F.concat(F.lit("Class "), name).alias("name"),
            F.when(number.isNotNull(), leading_int(first)).alias("level"), F.lit(source).alias("source"),
            F.regexp_extract(text, pattern, 1).alias("matched_text"),
        )))
    return found


def detect_grade(text: Column, filename: Column) -> Column:
    """struct<code, name, level, source, matched_text>; the text before the file name."""
    return F.coalesce(*_grade_from(text, "content"), *_grade_from(filename, "filename"))


def _first_year(text: Column, pattern: str, this_year: int) -> Column:
    years = F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda y: y.cast("int"))
    return F.try_element_at(F.filter(years, lambda y: (y >= 1971) & (y <= this_year + 2)), F.lit(1))


def detect_edition(text: Column, filename: Column, this_year: int) -> Column:
    """struct<label, year, source>; a year in the label, then in context, then anywhere, then in the file name."""
    labels = [F.when(F.regexp_extract(text, p, 1) != "", strip_space(F.regexp_extract(text, p, 1))) for p in EDITIONS]
    label = F.coalesce(*labels)
    in_label = F.regexp_extract(label, LABEL_YEAR, 1).try_cast("int")
    in_text = F.coalesce(*[_first_year(text, p, this_year) for p in YEARS])
    in_name = F.coalesce(*[_first_year(filename, p, this_year) for p in reversed(YEARS)])
    year = F.coalesce(in_label, in_text, in_name)
    from_name = in_label.isNull() & in_text.isNull() & in_name.isNotNull()
    source = F.when(from_name, "filename").when(label.isNotNull() | in_text.isNotNull(), "content")
    return F.struct(label.alias("label"), year.alias("year"), source.alias("source"))


def _word(phrase: str) -> str:
    return rf"(?<![\p{{L}}\p{{N}}_]){re.escape(phrase.lower())}(?![\p{{L}}\p{{N}}_])"


def profile_scores(combined: Column, profiles: Sequence[Profile] = PROFILES) -> Column:
    """Score of every profile, null where a negative keyword occurs.

    Profiles are configuration, so they become expressions over the text; no
    join is needed and each text is read once.
    """
    out = []
    for p in profiles:
        score = F.lit(0)
        for pattern in (*p.title_patterns, *p.aliases, p.name):
            score = score + F.when(combined.rlike(_word(pattern)), 50).otherwise(0)
        for kw in p.keywords:
            score = score + 5 * F.regexp_count(combined, F.lit(_word(kw)))
        for neg in p.negative_keywords:
            score = F.when(~combined.contains(neg.lower()), score)
        out.append(F.struct(F.lit(p.code).alias("code"), F.lit(p.name).alias("name"), F.lit(p.domain).alias("domain"), score.alias("score")))
    return F.array(*out)


def combined_text(text: Column, filename: Column) -> Column:
    stem = F.regexp_replace(F.regexp_replace(filename, r"\.[^.]*$", ""), r"[_\-]+", " ")
    return F.lower(F.concat_ws(" ", stem, filename, text))


def best_profile(scores: Column, least: int = 30) -> Column:
    """Highest score from `least` on; the first of equals."""
    def better(acc: Column, p: Column) -> Column:
        wins = (p["score"] >= least) & (p["score"] > F.coalesce(acc["score"], F.lit(0)))
        return F.when(wins, p).otherwise(acc)

    none = F.lit(None).cast("struct<code:string,name:string,domain:string,score:int>")
    return F.aggregate(scores, none, better)


def derive_title(docinfo: Column, subject: Column, grade: Column, filename: Column) -> Column:
    """H14."""
    stem = F.regexp_replace(F.regexp_replace(filename, r"\.[^.]*$", ""), r"[_\-]+", " ")
    info = strip_space(docinfo)
    return (
        F.when(F.length(info) > 3, info)
        .when(subject.isNotNull() & grade.isNotNull(), F.concat(subject, F.lit(" ("), grade, F.lit(")")))
        .when(subject.isNotNull(), subject)
        .otherwise(F.when(stem != "", F.initcap(stem)).otherwise("Textbook"))
    )


def diagnostics(grade: Column, edition: Column, profile: Column, pages: Column) -> Column:
    """Evidence for what was detected, as JSON."""
    return F.to_json(F.struct(
        pages.alias("inspected_pages"), profile["code"].alias("detected_profile"), grade.alias("grade"),
        F.when(edition["label"].isNotNull() | edition["year"].isNotNull(), edition).alias("edition"),
        F.when(edition["year"].isNotNull(), F.struct(edition["year"].alias("value"), edition["source"].alias("source"))).alias("publication_year"),
    ))


