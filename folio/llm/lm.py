"""Language-model scores of whole texts from a log-bilinear neural model.

Symbols are the FREQUENT commonest words, the end of a text, and CLASSES classes of all other
words by their last two characters. The model predicts a symbol from the CONTEXT symbols
before it: their vectors, each through the matrix of its place, add up to a predicted vector,
whose products with all symbols' output vectors, plus a bias, are normalised to
probabilities. A word of a class then has its add-one share of its class, unseen words
being one more word of each class. All probabilities sum to one.

Training is noise-contrastive estimation in numpy: each symbol against NOISE samples of the
unigram distribution, Adagrad steps. A first model comes from a bounded sample (SAMPLE
documents). Then every task continues from it over all its training documents, and
the parameters are averaged, weighted by tokens, in Spark. Word counts cover all training documents.

Counts of the HEAD commonest words travel with the tasks (a table of bounded size); occurrences of
rarer words are joined with their counts by a shuffle, where none is frequent
enough to be a hot key.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.runtime import cut, table

FREQUENT = 512
CLASSES = 127
HEAD = 1 << 17
CONTEXT = 2
DIMENSIONS = 16
NOISE = 48
BATCH = 4096
RATE = 0.1
SAMPLE = 2000
SEED = 42
#: Words that are turned into arrays at once.
CHUNK = 1 << 18
#: Entries of a worker's caches and of a partial count; more are handed on or looked up again.
CACHE = 500_000

END = FREQUENT
START = FREQUENT + 1 + CLASSES
SYMBOLS = START


def words_of(text: str | None) -> list[bytes]:
    """Words between white space in UTF-8, A-Z in lower case."""
    return (text or "").encode().lower().split()


def word_class(word: bytes) -> int:
    """Symbol of a word that is not frequent."""
    return FREQUENT + 1 + zlib.crc32(word.decode()[-2:].encode()) % CLASSES


def class_column(word: Column) -> Column:
    """`word_class` in Spark."""
    return F.lit(FREQUENT + 1) + F.crc32(F.encode(F.substring(word, -2, 2), "UTF-8")) % CLASSES


class Symbols(dict):
    """Symbol of each word; frequent words are given, others found by class and cached."""

    def __missing__(self, word: bytes) -> int:
        symbol = word_class(word)
        if len(self) < CACHE:
            self[word] = symbol
        return symbol


class Model:
    """Parameters of the log-bilinear model, in single precision."""

    def __init__(self, unigram: np.ndarray) -> None:
        """`unigram`: probability of each symbol, none zero. Starts as the unigram model."""
        rng = np.random.default_rng(SEED)
        self.unigram = unigram
        self.inputs = rng.normal(0, 0.1, (SYMBOLS + 1, DIMENSIONS)).astype(np.float32)
        self.outputs = rng.normal(0, 0.1, (SYMBOLS, DIMENSIONS)).astype(np.float32)
        self.places = np.stack([np.eye(DIMENSIONS, dtype=np.float32)] * CONTEXT)
        self.bias = np.log(unigram).astype(np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.outputs, self.places, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for p in self.parts():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    def log_normalisers(self) -> np.ndarray:
        """(START + 1, START + 1): log of the sum over all symbols after each pair of symbols, by batched products."""
        first, second = (self.inputs @ m for m in self.places)
        out = np.empty((SYMBOLS + 1, SYMBOLS + 1), np.float32)
        for symbol in range(SYMBOLS + 1):
            energy = (first[symbol] + second) @ self.outputs.T + self.bias
            top = energy.max(axis=1)
            out[symbol] = top + np.log(np.exp(energy - top[:, None]).sum(axis=1))
        return out


def sequence(texts: list[list[int]]) -> np.ndarray:
    """Texts of symbols end to end: CONTEXT start symbols before and the end symbol after each."""
    flat: list[int] = []
    for text in texts:
        flat += [START] * CONTEXT
        flat += text
        flat.append(END)
    return np.array(flat, np.int64)


def _scatter(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sum of the `values` of each row number."""
    return np.stack([np.bincount(rows, values[:, k], size) for k in range(values.shape[1])], axis=1).astype(np.float32)


class Trainer:
    """Noise-contrastive estimation with Adagrad steps."""

    def __init__(self, model: Model) -> None:
        self.model, self.rng = model, np.random.default_rng(SEED)
        self.squares = [np.full_like(p, 1e-2) for p in model.parts()]
        self.log_noise = np.log(NOISE * model.unigram).astype(np.float32)
        self.edges = np.cumsum(model.unigram)
        self.tokens = 0

    def learn(self, symbols: np.ndarray) -> None:
        """One pass over a sequence."""
        at = np.flatnonzero(symbols != START)
        for k in range(0, len(at), BATCH):
            self._step(symbols, at[k : k + BATCH])
        self.tokens += len(at)

    def _step(self, symbols: np.ndarray, at: np.ndarray) -> None:
        m = self.model
        target = symbols[at]
        before = [symbols[at - 1 - i] for i in range(CONTEXT)]
        vectors = [m.inputs[b] for b in before]
        hidden = sum(v @ c for v, c in zip(vectors, m.places))
        noise = np.minimum(np.searchsorted(self.edges, self.rng.random(NOISE)), SYMBOLS - 1)
        good = (hidden * m.outputs[target]).sum(axis=1) + m.bias[target] - self.log_noise[target]
        bad = hidden @ m.outputs[noise].T + (m.bias[noise] - self.log_noise[noise])
        # Gradients of the log-likelihood: towards the symbol read, away from the noise.
        up = 1 / (1 + np.exp(np.clip(good, -30, 30)))
        down = 1 / (1 + np.exp(-np.clip(bad, -30, 30)))
        d_hidden = up[:, None] * m.outputs[target] - down @ m.outputs[noise]
        d_outputs = _scatter(target, up[:, None] * hidden, SYMBOLS)
        np.add.at(d_outputs, noise, -(down.T @ hidden))
        d_bias = np.bincount(target, up, SYMBOLS).astype(np.float32)
        np.add.at(d_bias, noise, -down.sum(axis=0))
        d_places = np.stack([v.T @ d_hidden for v in vectors])
        d_inputs = sum(_scatter(b, d_hidden @ c.T, SYMBOLS + 1) for b, c in zip(before, m.places))
        for p, s, d in zip(m.parts(), self.squares, [d_inputs, d_outputs, d_places, d_bias]):
            d /= len(at) ** 0.5
            s += d * d
            p += RATE * d / np.sqrt(s)


def is_held_out(modulus: int = 7, remainder: int = 2) -> Column:
    """Rows the model never learns from; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % modulus == remainder, F.lit(False))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c): occurrences of every word of (text), counted in the tasks before they are added up."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
            held.clear()
            return rows

        for part in parts:
            for text in part.column(0):
                held.update(words_of(text.as_py()))
                if len(held) > CACHE:
                    yield flush()
        if held:
            yield flush()

    return texts.select("text").mapInArrow(count, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def head_words(counts: DataFrame, most: int) -> dict[bytes, int]:
    """Counts of the commonest words, at most `most` of them, commonest first.

    A histogram of the counts (64 bins for each power of two, so of bounded size) tells from which bin on
    no more than `most` words are left; only those words come to the driver.
    """
    step = F.floor(F.log2("c") * 64).cast("int")
    bins = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()
    total, lowest = 0, None
    for r in sorted(bins, reverse=True):
        total += r.n
        if total > most:
            break
        lowest = r.step
    if lowest is None:
        return {}
    found = counts.filter(step >= lowest).toPandas().sort_values(["c", "word"], ascending=[False, True])
    return {w.encode(): int(c) for w, c in zip(found["word"], found["c"])}


def _trained(texts: DataFrame, start: Model, frequent: dict[bytes, int]) -> DataFrame:
    """(entry, value, tokens): the parameters of each task after one pass over its texts."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((start.unigram, start.flat(), frequent))

    def train(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram, flat, known = shared.value
        trainer = Trainer(Model(unigram).load(flat))
        symbols = Symbols(known)
        for part in parts:
            held: list[list[int]] = []
            size = 0
            for text in part.column(0):
                held.append(list(map(symbols.__getitem__, words_of(text.as_py()))))
                size += len(held[-1])
                if size > CHUNK:
                    trainer.learn(sequence(held))
                    held, size = [], 0
            if held:
                trainer.learn(sequence(held))
        if trainer.tokens:
            values = trainer.model.flat()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(values))), pa.array(values.astype(float)), pa.array(np.full(len(values), trainer.tokens))], ["entry", "value", "tokens"]
            )

    return texts.select("text").mapInArrow(train, "entry bigint, value double, tokens bigint")


def _average(trained: DataFrame, start: Model) -> Model:
    mean = F.sum(F.col("value") * F.col("tokens")) / F.sum("tokens")
    rows = trained.groupBy("entry").agg(mean.alias("value")).toPandas()
    flat = start.flat()
    flat[rows["entry"].to_numpy(int)] = rows["value"].to_numpy(np.float32)
    return Model(start.unigram).load(flat)


def train(texts: DataFrame, n_texts: int, unigram: np.ndarray, frequent: dict[bytes, int], sample: int = SAMPLE) -> Model:
    """The model of (doc_id, text): first from a bounded sample in one task, then from all texts in all tasks."""
    start = Model(unigram)
    if not n_texts:
        return start
    chance = F.pmod(F.xxhash64("doc_id", F.lit("warm")), F.lit(1_000_000)) / 1_000_000
    warm = _average(_trained(texts.filter(chance < min(1.0, sample / n_texts)).coalesce(1), start, frequent), start)
    return _average(_trained(texts, warm, frequent), warm)


def _scored(docs: DataFrame, model: Model, head: dict[bytes, int], frequent: dict[bytes, int], class_logs: np.ndarray, end_log: float) -> DataFrame:
    """Per row: tokens, known ones among the head, sums of log10(c + 1), the model's log10, and rarer words with their numbers."""
    fields = "row_id bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, counts double, score double, words array<string>, times array<bigint>"
    names = [f.split()[0] for f in fields.split(", ")]
    log_z = model.log_normalisers()
    shared = docs.sparkSession.sparkContext.broadcast((model.unigram, model.flat(), log_z, head, frequent, class_logs))

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram, flat, z, counted, known, logs = shared.value
        m = Model(unigram).load(flat)
        first, second = (m.inputs @ p for p in m.places)
        symbols = Symbols(known)
        log_count = {w: float(np.log10(c + 1)) for w, c in counted.items()}

        def model_scores(texts: list[list[int]]) -> np.ndarray:
            """log10 of the symbols' probabilities, less that of a class's size, summed over each text."""
            s = sequence(texts)
            at = np.flatnonzero(s != START)
            total = np.empty(len(at))
            for k in range(0, len(at), 1 << 16):
                a = at[k : k + (1 << 16)]
                t, b1, b2 = s[a], s[a - 1], s[a - 2]
                energy = ((first[b1] + second[b2]) * m.outputs[t]).sum(axis=1) + m.bias[t]
                total[k : k + (1 << 16)] = (energy.astype(float) - z[b1, b2]) / np.log(10) - logs[t]
            sizes = np.array([len(x) + 1 for x in texts])
            return np.add.reduceat(total, np.cumsum(sizes) - sizes)

        for part in parts:
            rows: dict[str, list] = {n: [] for n in names}
            own: list[float] = []
            held: list[list[int]] = []
            size = 0
            for row_id, doc_id, out, text in zip(*(part.column(i).to_pylist() for i in range(3)), part.column(3)):
                words = words_of(text.as_py())
                logs_of = list(map(log_count.get, words))
                rare = Counter(w for w, x in zip(words, logs_of) if x is None) if None in logs_of else {}
                n_rare = sum(rare.values())
                rows["row_id"].append(row_id)
                rows["doc_id"].append(doc_id)
                rows["held_out"].append(out)
                rows["n_tokens"].append(len(words) + 1)
                rows["n_known"].append(len(words) - n_rare + (end_log > 0))
                rows["counts"].append(sum(filter(None, logs_of)) + end_log)
                rows["words"].append([w.decode() for w in rare])
                rows["times"].append(list(rare.values()))
                held.append(list(map(symbols.__getitem__, words)))
                size += len(words)
                # Words of a class also owe the logs of their own counts; those in the head are known here.
                own.append(sum(x for w, x in zip(words, logs_of) if x is not None and w not in known))
                if size > CHUNK:
                    rows["score"] += model_scores(held).tolist()
                    held, size = [], 0
            if held:
                rows["score"] += model_scores(held).tolist()
            rows["score"] = [a + b for a, b in zip(rows["score"], own)]
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(rows[n], k) for n, k in zip(names, kinds)], names)

    return docs.select("row_id", F.col("doc_id").cast("bigint"), "held_out", "text").mapInArrow(score, fields)


def score_texts(docs: DataFrame) -> DataFrame:
    """Scores of every row of `docs`.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one
    unigrams), score (the model). A null or empty text is its end token alone. Repeated rows
    are scored, and learned from, each on their own; texts of any length are read whole; an empty table
    gives no rows; columns other than doc_id and text are not read. Without training texts
    every word is unknown.
    """
    rows = docs.select("doc_id", "text").withColumn("held_out", is_held_out())
    training = rows.filter(~F.col("held_out"))
    counts = cut(word_counts(training), "counts")
    ends = training.count()
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = size.n + ends, size.v + (1 if ends else 0)
    head = head_words(counts, HEAD)
    frequent = {w: i for i, w in enumerate(list(head)[:FREQUENT])}
    symbol_counts = np.ones(SYMBOLS)
    symbol_counts[: len(frequent)] += [head[w] for w in frequent]
    symbol_counts[END] += ends
    names = [w.decode() for w in frequent]
    rare = counts.filter(~F.col("word").isin(names)) if names else counts
    class_logs = np.zeros(SYMBOLS)
    sums = {r.class_: r for r in rare.groupBy(class_column(F.col("word")).alias("class_")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    for symbol in range(FREQUENT + 1, SYMBOLS):
        in_class = sums.get(symbol)
        symbol_counts[symbol] += in_class.n if in_class else 0
        class_logs[symbol] = np.log10((in_class.n + in_class.v if in_class else 0) + 1)
    model = train(training, ends, symbol_counts / symbol_counts.sum(), frequent)
    numbered = rows.withColumn("row_id", F.monotonically_increasing_id())
    scored = cut(_scored(numbered, model, head, frequent, class_logs, float(np.log10(ends + 1))), "scored")
    pairs = scored.filter(F.size("words") > 0).select("row_id", F.explode(F.arrays_zip("words", "times")).alias("p"))
    pairs = pairs.select("row_id", F.col("p.words").alias("word"), F.col("p.times").alias("times"))
    met = pairs.join(counts, "word").groupBy("row_id").agg(
        F.sum("times").alias("seen"), F.sum(F.log10(F.col("c") + 1) * F.col("times")).alias("logs")
    )
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.join(met, "row_id", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("counts") + logs - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )


def op3_lm_score(spark, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents."""
    return score_texts(table(spark, sf_dir, "documents"))
