"""Number tokens: digits, dotted numbers, roman numerals and English number words (H4)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
WORD_VALUES = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9,
    "tenth": 10,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
SCALES = {"hundred": 100, "thousand": 1000}
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def _lookup(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable((k, int(n)) for k, n in values.items())])


# White space and digits of all scripts, spelled alike for Java and RE2 patterns.
SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
DIGIT = r"\p{Nd}"


def strip_space(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def roman_to_int(token: Column) -> Column:
    """A numeral counts negative when a larger one stands anywhere to its right."""
    letters = F.reverse(F.split(F.upper(strip_space(token)), ""))
    value = _lookup(ROMAN)
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("top"))

    def step(acc: Column, letter: Column) -> Column:
        v = F.try_element_at(value, letter)
        smaller = v < acc["top"]
        return F.struct(
            F.when(smaller, acc["total"] - v).otherwise(acc["total"] + v).alias("total"),
            F.when(smaller, acc["top"]).otherwise(v).alias("top"),
        )

    total = F.aggregate(letters, start, step, lambda acc: acc["total"])
    is_roman = F.upper(strip_space(token)).rlike("^[IVXLCDM]+$")
    return F.when(is_roman & (total > 0), total)


def words_to_int(text: Column) -> Column:
    """English number words with hundreds and thousands; null when any word is not a number, or past 38 digits."""
    cleaned = F.regexp_replace(F.lower(text), r"[^a-zA-Z\s\-]", " ")
    words = F.filter(F.split(cleaned, r"[\s\-]+"), lambda w: (w != "") & (w != "and"))
    value, scale = _lookup(WORD_VALUES), _lookup(SCALES)
    wide = "decimal(38,0)"
    zero, one = F.lit(0).cast(wide), F.lit(1).cast(wide)
    start = F.struct(zero.alias("total"), zero.alias("run"), F.lit(True).alias("ok"))

    def step(acc: Column, w: Column) -> Column:
        plain, by = F.try_element_at(value, w), F.try_element_at(scale, w)
        scaled = F.try_multiply(F.when(acc["run"] == 0, one).otherwise(acc["run"]), by.cast(wide)).try_cast(wide)
        closes = by >= 1000
        run = F.when(plain.isNotNull(), F.try_add(acc["run"], plain.cast(wide)).try_cast(wide)).when(closes, zero).when(
            by.isNotNull(), scaled
        ).otherwise(acc["run"])
        total = F.try_add(acc["total"], F.when(plain.isNull() & closes, scaled).otherwise(zero)).try_cast(wide)
        known = acc["ok"] & (plain.isNotNull() | by.isNotNull())
        return F.struct(total.alias("total"), run.alias("run"), known.alias("ok"))

    folded = F.aggregate(words, start, step)
    return F.when((F.size(words) > 0) & folded["ok"], F.try_add(folded["total"], folded["run"]).try_cast(wide))


def canonical_token(token: Column) -> Column:
    """'12' -> '12', '3.4' -> '3.4', 'iv' -> '4', 'twenty-five' -> '25', else null."""
    bare = F.regexp_replace(strip_space(token), "[.:\\-—]+$", "")
    return (
        F.when(bare == "", F.lit(None).cast("string"))
        .when(bare.rlike(r"^\d+(\.\d+)*$"), bare)
        .otherwise(F.coalesce(roman_to_int(bare), words_to_int(bare)).cast("string"))
    )


def leading_int(token: Column) -> Column:
    """First integer part of the canonical token."""
    return F.split(canonical_token(token), r"\.")[0].try_cast("int")
