"""Language identification with spans for mixed texts.

Training counts character n-grams of a bounded, hash-chosen sample of labelled documents
(SAMPLE a language) in Spark, into TABLE hashed entries. A word's score for a language is the sum
of its n-grams' log-probabilities. The scripts of its letters narrow a word's candidates: a
language in which a script (nearly) never occurs is out for words in it. Viterbi over the
words of a text, with a penalty for each change of language, labels its spans; the
language of most letters is the text's.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.runtime import table

#: Labelled documents a language that the classifier is fitted on, at most (in expectation).
SAMPLE = 4000
ORDERS = (1, 2, 3, 4)
TABLE = 1 << 16
#: Log-probability a change of language must gain.
SWITCH = 12.0
#: Words whose scores are computed at once, and entries of a worker's word cache.
CHUNK = 1 << 18
CACHE = 300_000
#: A language takes part for a script if at least this share of its letters is in it.
SCRIPT_SHARE = 0.001
#: Languages with the most labelled documents that are told apart; a closed set of this bound keeps the model small.
LANGUAGES = 512
# First code point of each script range that is told apart, and its name.
SCRIPTS = (
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "other"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Burmese"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"),
    (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "other"), (0x20000, "Han"),
)
_STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT = np.array([NAMES.index(n) for _, n in SCRIPTS])


def script_of(codes: np.ndarray) -> np.ndarray:
    """Script number of each code point."""
    return _SCRIPT[np.maximum(np.searchsorted(_STARTS, codes, side="right") - 1, 0)]


def words_of(text: str) -> list[str]:
    """Words of letters in lower case: all other characters separate them."""
    return "".join(c if c.isalpha() else " " for c in text.lower()).split() if not text.isascii() else text.lower().translate(_ASCII).split()


_ASCII = {i: (chr(i) if chr(i).isalpha() else " ") for i in range(128)}


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed n-grams, number of the word each belongs to, code points with a mark before and after each word)."""
    codes = np.frombuffer(("\x02" + "\x02".join(words) + "\x02").encode("utf-32-le"), np.uint32).astype(np.int64)
    edge = codes == 2
    word = np.cumsum(edge) - 1
    found, owners = [], []
    value = np.zeros(len(codes), np.uint64)
    inside = np.ones(len(codes), bool)
    for n in range(1, max(ORDERS) + 1):
        k = n - 1
        value = value[: len(codes) - k] * np.uint64(0x9E3779B97F4A7C15) + codes[k:].astype(np.uint64) + np.uint64(1)
        # A gram may begin with the mark before its word and end with the mark after it, but not hold one inside.
        inside = inside[: len(codes) - k]
        if k > 1:
            inside = inside & ~edge[k - 1 : len(codes) - 1]
        if n in ORDERS:
            keep = inside & ~(edge[: len(codes) - k] & edge[k:]) if n > 1 else ~edge
            hashed = value[keep]
            hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            found.append((hashed >> np.uint64(48)).astype(np.int64) % TABLE)
            owners.append(word[: len(codes) - k][keep])
    return np.concatenate(found), np.concatenate(owners), codes


def training(docs: DataFrame, held_out: Column) -> DataFrame:
    return docs.filter(~held_out & F.col("text").isNotNull() & F.col("lang").isNotNull())


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log-probability table, allowed scripts) from (doc_id, text, lang) of labelled documents.

    At most about `sample` documents a language are used, chosen by a hash of doc_id and text;
    the counts are added up in Spark and the driver receives one table of fixed size a language.
    """
    counted = docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r.lang for r in counted)
    if not languages:
        return [], np.zeros((TABLE, 0), np.float32), np.zeros((len(NAMES), 0), bool)
    shares = {r.lang: min(1.0, sample / r.n) for r in counted}
    share = reduce(lambda out, x: F.when(F.col("lang") == x, F.lit(shares[x])).otherwise(out), languages, F.lit(0.0))
    chance = F.pmod(F.xxhash64(F.lit("language"), "doc_id", "text"), F.lit(1_000_000)) / 1_000_000
    place = {x: i for i, x in enumerate(languages)}

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for part in parts:
            for text, lang in zip(part.column(0), part.column(1).to_pylist()):
                words = words_of(text.as_py())
                if words:
                    own = sums.setdefault(place[lang], np.zeros(TABLE + len(NAMES), np.int64))
                    hashed, _, codes = grams(words)
                    own[:TABLE] += np.bincount(hashed, minlength=TABLE)
                    own[TABLE:] += np.bincount(script_of(codes[codes != 2]), minlength=len(NAMES))
        for lang, own in sums.items():
            seen = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), lang)), pa.array(seen), pa.array(own[seen])], ["lang", "entry", "n"])

    chosen = docs.filter(chance < share).select("text", "lang")
    rows = chosen.mapInArrow(count, "lang bigint, entry bigint, n bigint").groupBy("lang", "entry").agg(F.sum("n").alias("n")).toPandas()
    table_ = np.zeros((TABLE + len(NAMES), len(languages)))
    table_[rows["entry"].to_numpy(int), rows["lang"].to_numpy(int)] = rows["n"].to_numpy()
    counts, scripts = table_[:TABLE] + 0.5, table_[TABLE:]
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    return languages, np.log(counts / counts.sum(axis=0)).astype(np.float32), allowed


class Scorer:
    """Scores of words for each language, cached by word."""

    def __init__(self, table_: np.ndarray, allowed: np.ndarray) -> None:
        self.table, self.allowed = table_, allowed
        self.numbers: dict[str, int] = {}
        self.scores = np.zeros((0, table_.shape[1]), np.float32)

    def number(self, words: list[str]) -> np.ndarray:
        """Row of `scores` of each word."""
        known = list(map(self.numbers.get, words))
        if None in known:
            if len(self.numbers) > CACHE:
                self.numbers, self.scores = {}, self.scores[:0]
                known = [None] * len(words)
            fresh = list({w: None for w, k in zip(words, known) if k is None})
            self.numbers.update(zip(fresh, range(len(self.scores), len(self.scores) + len(fresh))))
            self.scores = np.concatenate([self.scores, self._score(fresh)])
            known = list(map(self.numbers.get, words))
        return np.array(known, np.int64)

    def _score(self, words: list[str]) -> np.ndarray:
        hashed, owners, codes = grams(words)
        order = np.argsort(owners, kind="stable")
        sums = np.add.reduceat(self.table[hashed[order]], np.searchsorted(owners[order], np.arange(len(words))), axis=0)
        edge = codes == 2
        letters, owner = codes[~edge], (np.cumsum(edge) - 1)[~edge]
        # Candidates: languages that use the script of the word's letters; if none does, all of them.
        misfit = np.zeros_like(sums)
        np.add.at(misfit, owner, ~self.allowed[script_of(letters)])
        open_ = misfit == misfit.min(axis=1, keepdims=True)
        return np.where(open_, sums, np.float32(-1e6)).astype(np.float32)


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of every word of several texts laid end to end, `lengths` words each.

    Texts advance side by side, longest first, so a step works on all texts that still have words.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    back = np.zeros(scores.shape, np.int8 if scores.shape[1] < 128 else np.int16)
    best = np.zeros((len(order), scores.shape[1]), np.float64)
    own = np.arange(scores.shape[1])
    alive = len(order)
    for t in range(int(sizes[0]) if len(sizes) else 0):
        while alive and sizes[alive - 1] <= t:
            alive -= 1
        at = starts[:alive] + t
        now = best[:alive]
        if t:
            top = now.argmax(axis=1)
            jump = now[np.arange(alive), top] - switch
            stay = now >= jump[:, None]
            back[at] = np.where(stay, own, top[:, None])
            now = np.where(stay, now, jump[:, None])
        best[:alive] = now + scores[at]
    path = np.zeros(len(scores), np.int64)
    state = best.argmax(axis=1)
    for t in range(int(sizes[0]) - 1 if len(sizes) else -1, -1, -1):
        alive = np.searchsorted(-sizes, -t, side="left")  # texts with more than t words
        at = starts[:alive] + t
        path[at] = state[:alive]
        state[:alive] = back[at, state[:alive]]
    return path


def spans(text: str, languages: list[str], scorer: Scorer, switch: float = SWITCH) -> list[tuple[str, int, int]]:
    """(language, first word, number of words) of each span of one text."""
    words = words_of(text)
    if not words or not languages:
        return []
    rows = scorer.number(words)
    path = viterbi(scorer.scores[rows], np.array([len(words)]), switch)
    ends = np.flatnonzero(np.diff(path)) + 1
    bounds = [0, *ends.tolist(), len(words)]
    return [(languages[path[a]], a, b - a) for a, b in zip(bounds, bounds[1:])]


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], switch: float = SWITCH, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(*keep, lang_pred, score, n_spans) of every row of `docs`, which has text and the columns `keep`.

    The prediction is the language whose spans hold most letters, score their share of all letters.
    """
    languages, table_, allowed = model

    def flush(texts: list[list[str]], scorer: Scorer) -> list[tuple[str, float, int]]:
        lengths = np.array([len(w) for w in texts])
        out = [("und", 0.0, 0)] * len(texts)
        full = np.flatnonzero(lengths)
        if not len(full) or not languages:
            return out
        words = [w for k in full for w in texts[k]]
        rows = scorer.number(words)
        path = viterbi(scorer.scores[rows], lengths[full], switch)
        owner = np.repeat(np.arange(len(full)), lengths[full])
        letters = np.bincount(owner * len(languages) + path, np.fromiter(map(len, words), np.int64, len(words)), len(full) * len(languages))
        letters = letters.reshape(len(full), len(languages))
        change = np.bincount(owner[1:][(path[1:] != path[:-1]) & (owner[1:] == owner[:-1])], minlength=len(full)) + 1
        for k, own, top, n in zip(full, letters, letters.argmax(axis=1), change):
            out[k] = (languages[top], float(own[top] / own.sum()), int(n))
        return out

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(table_, allowed)
        for part in parts:
            done, held, size = [], [], 0
            for text in part.column(part.schema.get_field_index("text")):
                held.append(words_of(text.as_py() or ""))
                size += len(held[-1])
                if size >= CHUNK:
                    done += flush(held, scorer)
                    held, size = [], 0
            done += flush(held, scorer)
            langs, scores, n = zip(*done) if done else ((), (), ())
            found = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(n, pa.int32())]
            yield pa.RecordBatch.from_arrays([*map(part.column, keep), *found], [*keep, "lang_pred", "score", "n_spans"])

    kinds = [f"{k} {docs.schema[k].dataType.simpleString()}" for k in keep]
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(batches, ", ".join([*kinds, "lang_pred string, score double, n_spans int"]))


def is_held_out(modulus: int = 4, remainder: int = 2) -> Column:
    """Rows the classifier never learns from; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % modulus == remainder, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_spans) of every row of `docs`.

    Learns from text and lang of the rows that are not held out; predictions see text
    alone. Null texts and those without a letter are `und` with score 0, as is everything if
    nothing is labelled. Repeated rows are predicted alike; texts of any length are
    read whole; an empty table gives no rows; columns other than doc_id, text and lang are not read.
    """
    model = fit(training(docs.select("doc_id", "text", "lang"), is_held_out()))
    found = predict(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), model)
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "n_spans")


def keep_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """`docs` without the rows that are `und` or have no language for at least `least` of their letters, each row judged on its own.

    Null texts and those without a letter are `und`. If nothing is labelled no language can be missed, and all other texts
    stay. Repeated rows are judged alike; an empty table gives no rows; columns may have any names.
    """
    model = fit(training(docs.select("doc_id", "text", "lang"), is_held_out()))
    if not model[0]:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = predict(docs.select(F.struct(*docs.columns).alias("row"), "text"), model, keep=("row",))
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return identify(table(spark, sf_dir, "documents"))
