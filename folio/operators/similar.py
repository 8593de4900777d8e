"""Near-duplicate stems (C18) and the greedy filter over them.

Two stems are near duplicates when their normalised texts are equal, or when
their digit sequences do not contradict each other and either the Jaccard
overlap of their content words reaches 0.82 or the matcher ratio of the texts
reaches 0.88.

Candidate pairs come from prefix-filter joins that miss nothing:

* Jaccard >= t needs ceil(t*n) common words, so two such sets share a word among
  the n - ceil(t*n) + 1 rarest of each;
* ratio >= r means M matched characters with 2M >= r*T, T the summed length. At
  most (1-r)*T characters are unmatched, so the match falls into at most
  (1-r)*T + 1 runs and keeps at least M - 2*((1-r)*T + 1) common character
  triples. The shorter text is at least r/(2-r) of the longer, which turns this
  into a bound for each text alone, and again the rarest triples must meet.

Every pair is looked at once, at its first common prefix element. Digits are
part of the join key. The matcher itself runs as a pandas UDF on the pairs that
are left.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from string import ascii_lowercase
from string import digits as digits_0_9

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.text import stem_key
from folio.operators.ordered import numbered
from folio.runtime import cut, discard, fan_out, together

# Words that say nothing about what a question asks.
STOP_WORDS = (
    "what", "is", "the", "of", "a", "an", "in", "to", "which", "following", "if", "its", "then", "find", "calculate",
    "how", "many", "does", "by", "for", "from", "with", "according",
)
JACCARD = 0.82
RATIO = 0.88
GRAM = 3


def content_words(key: Column) -> Column:
    return F.array_distinct(
        F.filter(F.split(key, " "), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))
    )


def digits_of(key: Column) -> Column:
    """The digit sequences of a text, in order."""
    return F.array_join(F.regexp_extract_all(key, F.lit(r"(\d+)"), 1), ",")


@dataclass
class Stem:
    """A stem of a job that is walked in one task."""

    stem_key: str
    seq: int | None
    passes: int | None
    seeded: bool
    nums: str
    words: list[str]

    @cached_property
    def word_set(self) -> frozenset[str]:
        return frozenset(self.words)

    @cached_property
    def letters(self) -> Counter[str]:
        return Counter(self.stem_key)


def alike(later: Stem, early: Stem, with_ratio: bool = True) -> bool:
    """C18 for one pair, as `matches` has it; what bounds the ratio is tried before the matcher."""
    if (later.nums and early.nums and later.nums != early.nums) or not (later.stem_key and early.stem_key):
        return False
    common = len(later.word_set & early.word_set)
    either = len(later.word_set) + len(early.word_set) - common
    if either and common / either >= JACCARD:
        return True
    if not with_ratio:
        return False
    a, b = later.stem_key, early.stem_key
    size = len(a) + len(b)
    if 2 * min(len(a), len(b)) / size < RATIO or 2 * sum((later.letters & early.letters).values()) / size < RATIO:
        return False
    return difflib.SequenceMatcher(None, a, b).ratio() >= RATIO


def _grams(key: Column, q: int) -> Column:
    """Character q-grams, each with how often it occurred before, so that repeats count."""
    n = F.length(key)
    places = F.when(n >= q, F.sequence(F.lit(1), n - (q - 1))).otherwise(F.array().cast("array<int>"))
    grams = F.array_sort(F.transform(places, lambda i: F.substring(key, i, F.lit(q))))
    return F.transform(
        grams, lambda g, i: F.concat(F.lit(f"{q}:"), g, (i - F.array_position(grams, g)).cast("string"))
    )


def _gram_prefix(n: Column, q: int) -> Column:
    """How many of the rarest q-grams of a text of length n must be looked at.

    With summed length T the common q-grams number at least
    r/2*T - (q-1)*((1-r)*T + 1), which grows with T, so the smallest T a partner
    allows, n*(1 + r/(2-r)), gives the bound for n alone.
    """
    total = n * (1 + RATIO / (2 - RATIO))
    common = F.ceil((RATIO / 2) * total - (q - 1) * ((1 - RATIO) * total + 1) - 1e-9)
    return F.greatest(F.lit(1), (n - (q - 1)) - F.greatest(common, F.lit(1)) + 1).cast("int")


# Up to this length a text may share no triple with its match and is looked up by single characters as well.
SHORT = 10
# Characters counted one by one for the bound on the ratio.
LETTERS = ascii_lowercase + digits_0_9
# Stems of a key that are few enough to be paired by their digits alone, at most half as many pairs a stem.
FEW = 64
# Elements whose frequency is looked up; beyond them all are rare enough to be ordered by their hash.
FREQUENT = 10_000


def describe(stems: DataFrame, keys: list[str], with_ratio: bool = True) -> DataFrame:
    """Each distinct stem with its words, digits and the rare elements it is looked up by.

    Any total order of elements is exact; a good one puts frequent elements
    last. Only the FREQUENT commonest are ranked, so their table has a fixed
    bound and is broadcast, and a word found in every stem is never a shuffle
    key here. An element list never outgrows its own stem. Stems of a key that has
    FEW at most have no list (null): their pairs are fewer than their elements.
    """
    base = stems.withColumn("nums", digits_of(F.col("stem_key"))).withColumn(
        "words", content_words(F.col("stem_key"))
    )
    n_words = F.size("words")
    word_prefix = (n_words - F.ceil(n_words * JACCARD - 1e-9) + 1).cast("int")
    kinds = [F.struct(F.transform("words", lambda w: F.concat(F.lit("w:"), w)).alias("es"), word_prefix.alias("take"))]
    if with_ratio:
        size = F.length("stem_key")
        short = F.when(size <= SHORT, _grams(F.col("stem_key"), 1)).otherwise(F.array().cast("array<string>"))
        kinds.append(F.struct(_grams(F.col("stem_key"), GRAM).alias("es"), _gram_prefix(size, GRAM).alias("take")))
        kinds.append(F.struct(short.alias("es"), _gram_prefix(size, 1).alias("take")))
    many = stems.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > FEW).select(*keys) if keys else None
    crowded = base if many is None else base.join(many, keys, "left_semi")
    listed = crowded.select(*keys, "seq", F.posexplode(F.array(*kinds)).alias("kind", "k"))
    elements = listed.select(*keys, "seq", "kind", F.col("k.take").alias("take"), F.explode("k.es").alias("e"))
    top = elements.groupBy("e").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "e").limit(FREQUENT)
    ranked = elements.join(F.broadcast(top), "e", "left").select(
        *keys, "seq", "kind", "take", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.xxhash64("e").alias("h")).alias("r")
    )
    rare = ranked.groupBy(*keys, "seq", "kind", "take").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    chosen = rare.select(*keys, "seq", F.transform(F.slice("rs", F.lit(1), F.col("take")), lambda x: x["h"]).alias("look"))
    looks = chosen.groupBy(*keys, "seq").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("look")))).alias("look"))
    none = F.array().cast("array<bigint>")
    found = crowded.join(looks, [*keys, "seq"], "left").withColumn("look", F.coalesce("look", none))
    if many is None:
        return found
    return found.unionByName(base.join(many, keys, "left_anti").withColumn("look", F.lit(None).cast("array<bigint>")))


def _digit_keys(side: str) -> Column:
    """Join keys under which texts meet iff their digits agree or one has none."""
    none = F.col("nums") == ""
    if side == "later":
        return F.when(none, F.array(F.lit("any"))).otherwise(F.array(F.concat(F.lit("="), "nums"), F.lit("none")))
    return F.when(none, F.array(F.lit("none"), F.lit("any"))).otherwise(F.array(F.concat(F.lit("="), "nums"), F.lit("any")))


def _blocks(described: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Look-up rows: identifiers, the list of elements, and one element with one digit key; no texts."""
    rows = described.select(
        *keys, F.col("seq").alias(f"{side}_seq"), F.col("look").alias(f"{side}_look"), F.explode("look").alias("e"), _digit_keys(side).alias("dk"),
    )
    return rows.withColumn("dk", F.explode("dk"))


def _costs(later: DataFrame, early: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, dk, by_element, by_digits): rows that pairing a digit key by elements, or by the digits alone, would make."""
    group = [*keys, "dk"]
    later, early = later.filter("look is not null"), early.filter("look is not null")

    def sizes(df: DataFrame, on: list[str], name: str) -> DataFrame:
        return df.groupBy(*on).agg(F.count("*").alias(name))

    elements = sizes(_blocks(later, keys, "later"), [*group, "e"], "a").join(sizes(_blocks(early, keys, "early"), [*group, "e"], "b"), [*group, "e"])
    by_element = elements.groupBy(*group).agg(F.sum(F.col("a") * F.col("b")).alias("by_element"))
    digits = F.concat(F.lit("="), "nums").alias("dk")
    some = [df.filter("nums <> ''").select(*keys, digits) for df in (later, early)]
    by_digits = sizes(some[0], group, "a").join(sizes(some[1], group, "b"), group).select(*group, (F.col("a") * F.col("b")).alias("by_digits"))
    return by_element.join(by_digits, group, "left")


def pair_budget(described: DataFrame, keys: list[str]) -> DataFrame:
    """Upper bound on the pairs a self-join of the stems would look at."""
    return _costs(described, described, keys).agg(F.sum(F.least("by_element", "by_digits")).alias("pairs"))


@F.pandas_udf(T.BooleanType())
def ratio_reached(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether the standard matcher finds the texts alike; later text first, as its result depends on order."""
    for later, early in parts:
        yield pd.Series([difflib.SequenceMatcher(None, a, b).ratio() >= RATIO for a, b in zip(later, early)], dtype="bool")


def letter_counts(key: Column) -> Column:
    """How often each letter of the Latin alphabet, each digit and all else occur."""
    size = F.length(key)
    single = [size - F.length(F.replace(key, F.lit(c), F.lit(""))) for c in LETTERS]
    return F.array(*single, size - sum(single, F.lit(0)))


def matches(
    later: DataFrame, early: DataFrame, keys: list[str], ordered: bool, with_ratio: bool = True
) -> DataFrame:
    """(later_seq, early_seq) of near duplicates between two sets of described stems.

    Stems with equal digits are paired either by common elements or by their digits alone, whichever makes
    fewer rows for that digit key; both look at every pair that can match. Look-up rows
    hold identifiers only; texts join the pairs that are left, and only those whose lengths and letter
    counts allow the ratio reach the matcher. Keys of FEW stems have no elements and are paired by digits. `ordered` keeps only pairs whose early side comes first (a self-join).
    """
    group = [*keys, "dk"]
    direct = cut(_costs(later, early, keys).filter("by_digits <= by_element").select(*group), "direct")
    in_order = F.col("early_seq") < F.col("later_seq") if ordered else F.lit(True)

    listed = [df.filter("look is not null") for df in (later, early)]
    a = _blocks(listed[0], keys, "later").join(direct, group, "left_anti")
    joined = a.join(_blocks(listed[1], keys, "early"), [*group, "e"]).filter(in_order)
    once = F.array_min(F.array_intersect("later_look", "early_look")) == F.col("e")
    by_element = joined.filter(once).select(*keys, "later_seq", "early_seq")
    digits = F.concat(F.lit("="), "nums").alias("dk")
    x = listed[0].select(*keys, F.col("seq").alias("later_seq"), digits).join(direct, group, "left_semi")
    by_digits = x.join(listed[1].select(*keys, F.col("seq").alias("early_seq"), digits), group).filter(in_order).select(*keys, "later_seq", "early_seq")

    pairs, few = by_element.union(by_digits), []
    for side, df in (("later", later), ("early", early)):
        texts = df.select(
            *keys, F.col("seq").alias(f"{side}_seq"), F.col("stem_key").alias(f"{side}_key"), F.col("words").alias(f"{side}_words"),
            _digit_keys(side).alias("dk"), "look",
        )
        pairs = pairs.join(texts.filter("look is not null").drop("dk", "look"), [*keys, f"{side}_seq"])
        # Stems of small keys bring their texts along; an empty one has no element, so it matches nothing.
        small = texts.filter(F.col("look").isNull() & (F.col(f"{side}_key") != "")).drop("look")
        few.append(small.withColumn("dk", F.explode("dk")))
    pairs = pairs.unionByName(few[0].join(few[1], group).filter(in_order).drop("dk"))
    common = F.size(F.array_intersect("later_words", "early_words"))
    overlap = F.try_divide(common.cast("double"), (F.size("later_words") + F.size("early_words") - common).cast("double"))
    judged = pairs.withColumn("by_words", F.coalesce(overlap >= JACCARD, F.lit(False)))
    ids = [*keys, "later_seq", "early_seq"]
    if not with_ratio:
        return judged.filter("by_words").select(*ids)
    la, lb = F.length("later_key"), F.length("early_key")
    least = F.zip_with(letter_counts(F.col("later_key")), letter_counts(F.col("early_key")), lambda m, n: F.least(m, n))
    shared = F.aggregate(least, F.lit(0), lambda acc, n: acc + n)
    possible = (2 * F.least(la, lb) >= RATIO * (la + lb) - 1e-9) & (2 * shared >= RATIO * (la + lb) - 1e-9)
    near = cut(judged.filter(F.col("by_words") | possible).select(*ids, "by_words", "later_key", "early_key"), "near")
    by_ratio = fan_out(near.filter("not by_words"), "later_seq", "early_seq").filter(ratio_reached("later_key", "early_key"))
    return near.filter("by_words").select(*ids).union(by_ratio.select(*ids))


def distinct_stems(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """First candidate of every normalised stem; later equals are exact duplicates of it."""
    keyed = candidates.select(*keys, "seq", stem_key(F.col("stem")).alias("stem_key"))
    return keyed.groupBy(*keys, "stem_key").agg(F.min("seq").alias("seq"))


def _told_apart() -> Column:
    """What names a stem of two sides: several seen stems may share a place, and the digits of one must not stand for another's."""
    return F.struct("side", "seq", F.xxhash64("stem_key").alias("h"))


def seen_at(candidates: DataFrame, seen: DataFrame, keys: list[str], with_ratio: bool = True) -> DataFrame:
    """(keys, stem_key, exact_at, near_at): the first place among `seen` of an equal and of a near equal stem."""
    cand, old = distinct_stems(candidates, keys), distinct_stems(seen, keys)
    tagged = cand.select("*", F.lit(0).alias("side")).union(old.select("*", F.lit(1).alias("side")))
    both = cut(describe(fan_out(tagged.withColumn("seq", _told_apart()), "seq"), keys, with_ratio), "stems")
    near = matches(both.filter("seq.side = 0"), both.filter("seq.side = 1"), keys, False, with_ratio)
    first = near.groupBy(*keys, F.col("later_seq.seq").alias("seq")).agg(F.min("early_seq.seq").alias("near_at"))
    return cand.join(first, [*keys, "seq"], "left").drop("seq").join(old.withColumnRenamed("seq", "exact_at"), [*keys, "stem_key"], "left")


def first_match(candidates: DataFrame, seen: DataFrame, keys: list[str], with_ratio: bool = True) -> DataFrame:
    """C18 against a set already seen: the first seen stem each candidate repeats or nearly repeats.

    `is_exact` tells which of the two it is, as the rejection category (B14)
    goes by the first seen stem that matches.
    """
    cand, old = distinct_stems(candidates, keys), distinct_stems(seen, keys)
    tagged = cand.select("*", F.lit(0).alias("side")).union(old.select("*", F.lit(1).alias("side")))
    both = cut(describe(fan_out(tagged.withColumn("seq", _told_apart()), "seq"), keys, with_ratio), "stems")
    near = matches(both.filter("seq.side = 0"), both.filter("seq.side = 1"), keys, False, with_ratio)
    exact = cand.join(old.withColumnRenamed("seq", "early"), [*keys, "stem_key"]).select(
        *keys, F.col("seq").alias("later"), "early", F.lit(True).alias("is_exact")
    )
    pairs = near.select(
        *keys, F.col("later_seq.seq").alias("later"), F.col("early_seq.seq").alias("early"), F.lit(False).alias("is_exact")
    ).union(exact)
    first = F.min(F.struct("early", F.expr("not is_exact").alias("is_near")))
    return pairs.groupBy(*keys, F.col("later").alias("seq")).agg(first.alias("f")).select(
        *keys, "seq", F.col("f.early").alias("first_seen"), (~F.col("f.is_near")).alias("is_exact")
    )


def greedy_filter(
    candidates: DataFrame, keys: list[str] | None = None, with_ratio: bool = True, pairs_per_row: int = 200,
    smallest: int = 4096,
) -> DataFrame:
    """In order, keep a candidate unless it repeats one that was kept.

    Exact repeats fall to one aggregate. The rest is taken in ranges of the
    order inside each key, all keys at once, so many small keys are one range: what matches a kept stem is dropped first, so a large group of near
    copies costs one comparison each with its kept member, not all pairs. If
    the survivors of a range could still meet in too many pairs, the range is
    halved, so its first half can thin out the second. Inside a range, rounds
    accept every stem without a live earlier neighbour and drop its later
    neighbours. Each step is a written table, so lost executors cost one step;
    what was kept is read as one scan, so plans do not grow with the ranges.
    """
    keys = list(keys or [])
    firsts = distinct_stems(candidates, keys)
    placed = numbered(firsts, keys, F.floor(F.col("seq") / 65536), [F.col("seq")], "place")
    stems = cut(describe(fan_out(placed, "seq"), keys, with_ratio), "stems")
    total = stems.agg(F.max("place")).first()[0] or 0
    ranges: list[tuple[int, int]] = []
    low, width = 1, max(smallest, 1)
    while low <= total:
        ranges.append((low, min(total, low + width - 1)))
        low, width = low + width, width * 2
    ranges.reverse()
    kept: list[DataFrame] = []
    while ranges:
        low, high = ranges.pop()
        live = stems.filter(F.col("place").between(low, high))
        if kept:
            hit = matches(live, together(kept), keys, False, with_ratio).select(*keys, F.col("later_seq").alias("seq")).distinct()
            live = live.join(hit, [*keys, "seq"], "left_anti")
        live = cut(live, "live")
        size = live.count()
        if size == 0:
            continue
        if high > low and size > smallest and (pair_budget(live, keys).first()[0] or 0) > pairs_per_row * size:
            middle = (low + high) // 2
            ranges += [(middle + 1, high), (low, middle)]
            discard(live)
            continue
        edges = cut(matches(live, live, keys, True, with_ratio), "edges")
        kept.append(cut(_independent(live, edges, keys), "kept"))
        discard(live, edges)
    if not kept:
        return firsts.select(*keys, "seq")
    return together(kept).select(*keys, "seq")


def _independent(live: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Stems kept by the greedy rule among `live`, given all near pairs among them."""
    ids = [*keys, "seq"]
    open_ids = live.select(*ids)
    accepted: list[DataFrame] = []
    while True:
        blocked = edges.select(*keys, F.col("later_seq").alias("seq")).distinct()
        free = cut(open_ids.join(blocked, ids, "left_anti"), "free")
        accepted.append(free)
        free_early = free.withColumnRenamed("seq", "early_seq")
        hit = edges.join(free_early, [*keys, "early_seq"], "left_semi").select(*keys, F.col("later_seq").alias("seq")).distinct()
        dropped = cut(hit, "dropped")
        if dropped.isEmpty():
            break
        open_ids = cut(open_ids.join(free.union(dropped), ids, "left_anti"), "open")
        left = open_ids.select(*ids)
        edges = cut(
            edges.join(left.withColumnRenamed("seq", "later_seq"), [*keys, "later_seq"], "left_semi")
            .join(left.withColumnRenamed("seq", "early_seq"), [*keys, "early_seq"], "left_semi"),
            "edges",
        )
    return live.join(together(accepted), ids, "left_semi")
