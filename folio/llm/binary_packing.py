"""Packing without crossing documents: power-of-two decomposition.

Documents become token ids plus an end token. A document of n ids is cut into as many
pieces of the capacity as it fills, and for the rest into one piece for each bit of the rest's binary
number, longest first. Each piece is a sequence of its own: its length is a power of two, so it needs no
padding, and it holds one document only. Sequences of equal length make up a bucket; a batch is taken from one
bucket and is a full rectangle.

Sequences are numbered inside their bucket without a shuffle: a task counts its pieces by length as it
cuts them, and the totals of (task, length), a small table, say how many stand before.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.packing import END_ID, TOKENIZER, Encoder
from folio.runtime import cut, table

CAPACITY = 1024


def binary_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Powers of two that add up to `n`, falling, none above `capacity` (itself a power of two)."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]


_FIELDS = {
    "doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(),
    "task": pa.int32(), "turn": pa.int64(),
}


def binary_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, task, turn) of every piece; turn counts a task's pieces of a length from 0."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        turns: Counter[int] = Counter()
        for part in parts:
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                start, total = 0, len(ids) // 4
                for length in binary_lengths(total, capacity):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    rows.append((doc_id, start, length, crc, total, task, turns[length]))
                    turns[length] += 1
                    start += length
            columns = zip(*rows) if rows else [()] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, _FIELDS.values())], list(_FIELDS))

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task int, turn bigint"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(batches, schema)


def bucketed_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """Sequences of power-of-two lengths that hold every row of `docs`.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (0), slot (number in the bucket of
    equal lengths, gapless from 0). Sequence numbers run through the buckets, longest first. Null and empty texts are
    the end token alone; rows that share a doc_id are cut each on their own; whole texts are read, whatever their length; an
    empty table gives no rows, and columns other than doc_id and text are not read.
    """
    pieces = cut(binary_pieces(docs, tokenizer, capacity), "pieces")
    totals = cut(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "totals")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    lengths = totals.groupBy("length").agg(F.sum("n").alias("n"))  # one row a power of two
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    bases = lengths.select("length", F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("base"))
    carry = totals.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carry")).join(bases, "length")
    slot = F.col("carry") + F.col("turn")
    return pieces.join(carry, ["length", "task"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + slot).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"), slot.alias("slot"),
    )


def op12_binary_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens whose lengths are powers of two."""
    return bucketed_documents(table(spark, sf_dir, "documents"))
