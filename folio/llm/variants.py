"""Spelling variants: words one edit apart, found by a dictionary of trie-node pairs.

1. Words are counted in whole texts: a task counts the words of its batches, Spark adds the counts.
2. Words are numbered in code-point order. Each prefix of a word is a node of the forward trie, each suffix a node of the
   reversed trie, and every node has an integer. Nodes of up to SHALLOW characters, which many words
   share, are numbered by their characters read as digits; deeper nodes are numbered in a table.
3. A word that skips position i is the pair (node before i, node after i); a word as it stands is, at each position, the pair
   (node before, node from there on). Equal skip pairs of two words: one character replaced. A skip pair equal to a
   pair of a whole word: one character deleted, or seen from the other word, inserted.

A skip pair belongs to at most as many words as the alphabet has characters, a whole pair to one word, so no join key is
hot and each match is a true pair. Of a run of equal characters only the first may be deleted, so each pair of words meets once.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import running
from folio.runtime import cut, table

#: Words count from so many characters and so many occurrences; a form is at least FACTOR times as frequent as its variant.
MIN_LENGTH, MIN_COUNT, FACTOR = 6, 5, 5
#: Runs whose hash this divides lose a character.
EDIT_EVERY = 199
#: Characters of a node that is numbered by its characters. Digits in base BASE: a-z, then U+00C0 to U+00FF.
SHALLOW, BASE = 9, 91
#: Distinct words after which a task hands on its counts, and rows after which it hands on nodes.
HELD = 200_000


def edited_words(doc_id: int | None, text: str | None, least: int = MIN_LENGTH) -> Counter[bytes]:
    """Words of a text with their numbers: runs of letters in lower case, some without one of their characters.

    A run of which crc32 of `<doc_id>:<run>` is a multiple of EDIT_EVERY loses the character at that hash modulo its
    length. Only results of at least `least` characters are returned.
    """
    # In UTF-8, U+00C0 to U+00FF are C3 80 to C3 BF, and lower-casing bytes changes A-Z only.
    runs = Counter(re.findall(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % least, (text or "").encode().lower()))
    start = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
    edited = [run for run in runs if zlib.crc32(run, start) % EDIT_EVERY == 0]
    results = []
    for run in edited:
        letters = run.decode()
        at = zlib.crc32(run, start) % len(letters)
        results.append((letters[:at] + letters[at + 1 :], runs.pop(run)))
    for word, n in results:
        if len(word) >= least:
            runs[word.encode()] += n
    return runs


def word_counts(docs: DataFrame, least: int = MIN_LENGTH, occurrences: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all words of at least `least` characters and `occurrences` occurrences in all of `docs`."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def taken() -> pa.RecordBatch:
            words = pa.array(list(counts), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                counts.update(edited_words(doc_id, text.as_py(), least))
                if len(counts) > HELD:
                    yield taken()
                    counts.clear()
        yield taken()

    counted = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(batches, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def digit(letter: str) -> int:
    """1 to 26 for a-z, 27 to 90 for U+00C0 to U+00FF."""
    return ord(letter) - 96 if letter <= "z" else ord(letter) - 0xC0 + 27


def node_keys(letters: str) -> list[tuple[int, int, int]]:
    """(code, high, low) of the nodes on the path of `letters`, the root first.

    Nodes of at most SHALLOW characters have their number as code; deeper ones have minus their depth, and the 128 bits of a
    hash that grows along the path tell them apart, so that a node of a long word costs no more than one of a short word.
    """
    import xxhash

    keys, code, path = [(0, 0, 0)], 0, xxhash.xxh3_128()
    for depth, letter in enumerate(letters, 1):
        path.update(letter.encode())
        if depth <= SHALLOW:
            code = code * BASE + digit(letter)
            keys.append((code, 0, 0))
        else:
            h = path.intdigest()
            keys.append((-depth, (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)))
    return keys


_ROWS = {
    "word_no": pa.int64(), "n": pa.int64(), "kind": pa.int8(),
    "p": pa.int64(), "p_high": pa.int64(), "p_low": pa.int64(), "s": pa.int64(), "s_high": pa.int64(), "s_low": pa.int64(),
}
WHOLE, SKIP, FIRST_SKIP = 0, 1, 2


def pair_rows(vocabulary: DataFrame) -> DataFrame:
    """(word_no, n, kind, prefix node, suffix node) of every word at every position; deep nodes still as hashes."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def taken() -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * len(_ROWS)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, _ROWS.values())], list(_ROWS))

        for part in parts:
            for number, word, n in zip(*[c.to_pylist() for c in part.columns]):
                before, after = node_keys(word), node_keys(word[::-1])[::-1]
                for i in range(len(word) + 1):
                    rows.append((number, n, WHOLE, *before[i], *after[i]))
                    if i < len(word):
                        kind = SKIP if i and word[i] == word[i - 1] else FIRST_SKIP
                        rows.append((number, n, kind, *before[i], *after[i + 1]))
                    if len(rows) >= HELD:
                        yield taken()
                        rows.clear()
        yield taken()

    schema = "word_no bigint, n bigint, kind tinyint, p bigint, p_high bigint, p_low bigint, s bigint, s_high bigint, s_low bigint"
    return vocabulary.select("word_no", "word", "n").mapInArrow(batches, schema)


def node_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word_no, n, kind, p, s): the pair dictionary, every node an integer."""
    rows = cut(pair_rows(vocabulary), "node-rows")

    def with_numbers(rows: DataFrame, side: str) -> DataFrame:
        """Deep nodes of one trie get the numbers below zero."""
        key = [side, f"{side}_high", f"{side}_low"]
        rest = [c for c in rows.columns if c not in key]
        deep = rows.filter(F.col(side) < 0)
        numbers = cut(deep.select(*key).distinct().withColumn("number", -1 - F.monotonically_increasing_id()), f"trie-{side}")
        shallow = rows.filter(F.col(side) >= 0).select(*rest, side)
        return shallow.unionByName(deep.join(numbers, key).select(*rest, F.col("number").alias(side)))

    return cut(with_numbers(with_numbers(rows, "p"), "s"), "node-pairs")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word_no, near_no, near_n): both directions of every pair of words exactly one edit apart."""
    pairs = node_pairs(vocabulary)
    skips = pairs.filter(F.col("kind") != WHOLE).select("p", "s", "word_no", "n")
    others = skips.select("p", "s", F.col("word_no").alias("near_no"), F.col("n").alias("near_n"))
    replaced = skips.join(others, ["p", "s"]).filter("word_no <> near_no").select("word_no", "near_no", "near_n")
    longer = pairs.filter(F.col("kind") == FIRST_SKIP).select("p", "s", F.col("word_no").alias("long_no"), F.col("n").alias("long_n"))
    shorter = pairs.filter(F.col("kind") == WHOLE).select("p", "s", F.col("word_no").alias("short_no"), F.col("n").alias("short_n"))
    resized = longer.join(shorter, ["p", "s"])
    both = F.explode(F.array(
        F.struct(F.col("long_no").alias("word_no"), F.col("short_no").alias("near_no"), F.col("short_n").alias("near_n")),
        F.struct(F.col("short_no").alias("word_no"), F.col("long_no").alias("near_no"), F.col("long_n").alias("near_n")),
    ))
    return replaced.unionByName(resized.select(both.alias("pair")).select("pair.*"))


def spelling_forms(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of (word unique, n).

    Words of any length are taken; no words give no rows. Ties for the form go to the smallest word in code-point order.
    """
    vocabulary = cut(running(words.select("word", "n"), [], ["word"], {}, "word_no"), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("minus_n"), "near_no"))
    near = near_pairs(vocabulary).groupBy("word_no").agg(F.count("*").alias("n_near"), best.alias("best"))
    # A frequent word has no more rows than others here: numbers of words are unique.
    chosen = vocabulary.join(near, "word_no", "left").withColumn("is_form", -F.col("best.minus_n") >= factor * F.col("n"))
    linked = cut(chosen.select(
        "word_no", "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(F.col("is_form"), F.col("best.near_no")).alias("form_no"), F.when(F.col("is_form"), -F.col("best.minus_n")).alias("form_n"),
    ), "forms")
    # Counts rise by `factor` at each step, which bounds the chains; every round doubles the part that is followed.
    most = linked.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(most, factor))) + 1
    heads = linked.filter("form_no is not null").select("word_no", F.col("form_no").alias("root_no"))
    for _ in range(math.ceil(math.log2(steps)) + 1):
        further = heads.select(F.col("word_no").alias("root_no"), F.col("root_no").alias("further"))
        heads = cut(heads.join(further, "root_no", "left").select("word_no", F.coalesce("further", "root_no").alias("root_no")), "heads")
    names = vocabulary.select("word_no", "word")
    forms = names.select(F.col("word_no").alias("form_no"), F.col("word").alias("form"))
    roots = heads.join(names.select(F.col("word_no").alias("root_no"), F.col("word").alias("root")), "root_no").select("word_no", "root")
    return linked.join(forms, "form_no", "left").join(roots, "word_no", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Frequent words of `docs`, each with its likelier spelling.

    Returns word, form (null if no near word is FACTOR times as frequent), root (the end of the chain of forms), n, n_near and
    form_n. Null and empty texts have no words; a null doc_id counts as an empty one in the hash; rows that share a doc_id or a
    text all count; whole texts are read, whatever their length; an empty table gives no
    rows, and columns other than doc_id and text are not read.
    """
    return spelling_forms(word_counts(docs))


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Spelling forms of all frequent words in all documents."""
    return spelling_variants(table(spark, sf_dir, "documents"))
