"""Question bank: content hashes, saving, filters, pages, nested reads, state changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import canonical_question_hash, snippet
from folio.operators.ordered import first_per
from folio.operators.questions import declared_answer


def with_content_hash(candidates: DataFrame) -> DataFrame:
    """The canonical hash of every candidate."""
    texts = F.transform("options", lambda o: o["text"])
    correct = F.coalesce(declared_answer(F.col("options"), F.col("correct_option_id")), F.lit(""))
    return candidates.withColumn("content_hash", canonical_question_hash(F.col("stem"), texts, correct))


def save_generated(hashed: DataFrame, stored: DataFrame, keys: Sequence[str] = ("version_id",)) -> DataFrame:
    """Each generated question with the bank question it becomes.

    A stored question with the same hash is reused; otherwise the first of the
    batch creates one with a key derived from its hash, and its repeats reuse
    that.
    """
    ids = [*keys, "content_hash"]
    creators = first_per(hashed, ids, [F.col("seq")], ["question_id"]).withColumnRenamed("question_id", "creator")
    known = stored.select(*ids, F.col("question_id").cast("string").alias("stored_id"))
    new_id = F.concat(F.lit("qbi_"), F.substring(F.sha2(F.concat_ws("|", *ids), 256), 1, 12))
    return (
        hashed.join(creators, ids).join(known, ids, "left")
        .withColumn("bank_id", F.coalesce("stored_id", new_id))
        .withColumn("is_created", F.col("stored_id").isNull() & (F.col("creator") == F.col("question_id")))
        .drop("creator", "stored_id")
    )


def saved_rows(saved: DataFrame, requested: DataFrame, cited: DataFrame) -> DataFrame:
    """Everything one save writes, as (kind, bank_id, key, value).

    'question' (content hash, stem), 'option' (place, text) and 'answer' (place of the right option) rows of
    created questions, 'scope' rows of all of them (requested and cited, each once), and one 'count'
    row a version for what was created and what was reused.
    """
    new = saved.filter("is_created")
    text = F.lit(None).cast("string")
    questions = new.select(F.lit("question").alias("kind"), "bank_id", F.col("content_hash").alias("key"), F.col("stem").alias("value"))
    placed = new.select("bank_id", "correct_option_id", F.posexplode("options").alias("i", "o"))
    place = (F.col("i") + 1).cast("string")
    options = placed.select(F.lit("option"), "bank_id", place, F.col("o.text"))
    answers = placed.filter(F.col("o.id") == F.col("correct_option_id")).select(F.lit("answer"), "bank_id", place, text)
    homes = scope_links(requested, cited).join(saved.select("question_id", "bank_id"), "question_id")
    scopes = homes.select(F.lit("scope"), "bank_id", "node_id", text).distinct()
    sums = saved.groupBy("version_id").agg(F.count_if("is_created").alias("created"), F.count_if(~F.col("is_created")).alias("reused"))
    counts = sums.select(
        F.lit("count"), "version_id",
        F.explode(F.create_map(F.lit("created"), F.col("created").cast("string"), F.lit("reused"), F.col("reused").cast("string"))),
    )
    return questions.union(options).union(answers).union(scopes).union(counts)


def option_map(saved: DataFrame, stored_options: DataFrame) -> DataFrame:
    """The i-th generated option to the i-th stored option; new questions number their own options."""
    pos = saved.select("question_id", "bank_id", F.posexplode("options").alias("i", "o"))
    place = pos.select("question_id", "bank_id", F.col("i").cast("bigint").alias("canonical_order"), F.col("o.id").alias("generated_id"))
    known = stored_options.select(F.col("question_id").cast("string").alias("bank_id"), "canonical_order", F.col("option_id").alias("stored_option"))
    fresh = F.concat(F.col("bank_id"), F.lit("_"), (F.col("canonical_order") + 1).cast("string"))
    return place.join(known, ["bank_id", "canonical_order"], "left").select(
        "question_id", "bank_id", "generated_id", F.coalesce("stored_option", fresh).alias("option_id")
    )


def provenance(candidates: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """One row per cited chunk that exists; a question that cites none gets the plan's first chunk."""
    cited = candidates.select(key, "question_id", F.explode_outer("source_chunk_ids").alias("chunk_id"))
    found = cited.join(chunks, [key, "chunk_id"]).select(key, "question_id", "chunk_id", "page_no", "content_text")
    first = first_per(chunks, [key], [F.col("chunk_no")], ["chunk_id", "page_no", "content_text"])
    bare = candidates.select(key, "question_id").join(found.select(key, "question_id").distinct(), [key, "question_id"], "left_anti")
    fallback = bare.join(first, key).select(key, "question_id", "chunk_id", "page_no", "content_text")
    return found.union(fallback).select(
        key, "question_id", "chunk_id", "page_no", F.sha2("content_text", 256).alias("source_hash"),
        snippet(F.col("content_text")).alias("snippet"),
    )


def scope_links(requested: DataFrame, cited: DataFrame) -> DataFrame:
    """Scopes asked for and scopes of cited chunks, each once."""
    return requested.select("question_id", "node_id").union(cited.select("question_id", "node_id")).distinct()


def bank_filter(
    bank: DataFrame, version: str | None = None, status: str | None = "ACTIVE", origin: str | None = None,
    search: str | None = None, scopes: DataFrame | None = None,
) -> DataFrame:
    """Conditions are plain columns, so they reach the scan; scope is a semi-join and needs no distinct."""
    out = bank
    if version:
        out = out.filter(F.col("version_id") == version)
    if status:
        out = out.filter(F.col("status") == status)
    if origin:
        out = out.filter(F.col("origin_type") == origin)
    if search and search.strip():
        term = f"%{search.strip()}%"
        out = out.filter(F.col("stem").ilike(term) | F.col("explanation").ilike(term))
    if scopes is not None:
        out = out.join(scopes.select("node_id"), "node_id", "left_semi")
    return out


def scope_with_descendants(node: str, pairs: DataFrame) -> DataFrame:
    """The node and everything below it, from the closure."""
    below = pairs.filter(F.col("ancestor_id") == node).select(F.col("descendant_id").alias("node_id"))
    return below.union(pairs.sparkSession.range(1).select(F.lit(node).alias("node_id")))


def page_of(df: DataFrame, order: Sequence[Column], page: int, size: int, largest: int = 100) -> DataFrame:
    """one page; the limit is pushed into the sort, so only page*size rows per task survive.

    Pages count from 1 and hold at most `largest` rows; other arguments are errors.
    """
    if page < 1 or not 1 <= size <= largest:
        raise ValueError(f"page {page} of size {size}: pages start at 1, sizes are 1 to {largest}")
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_totals(df: DataFrame, size: int, keys: Sequence[str] = ()) -> DataFrame:
    """Rows and pages, at least one page."""
    count = F.count("*").alias("total_count")
    totals = df.groupBy(*keys).agg(count) if keys else df.agg(count)
    pages = F.greatest(F.lit(1), F.floor((F.col("total_count") + size - 1) / size)).cast("bigint")
    return totals.withColumn("total_pages", pages)


def question_details(questions: DataFrame, options: DataFrame, scopes: DataFrame, nodes: DataFrame, provenances: DataFrame) -> DataFrame:
    """C11: questions with their options, scopes and first provenance.

    Each child is aggregated per question before the join: four options by the
    schema's unique order, one provenance by a combined minimum. Scope titles
    meet the scope rows before they are gathered.
    """
    opts = options.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("canonical_order", "option_id", "option_text"))).alias("options")
    )
    titled = scopes.join(nodes.select("node_id", "title"), "node_id")
    scoped = titled.groupBy("question_id").agg(F.array_sort(F.collect_set(F.struct("node_id", "title"))).alias("scopes"))
    first = first_per(provenances, ["question_id"], [F.col("prov_seq"), F.col("page_no")], ["page_no", "prov_seq"])
    return (
        questions.join(opts, "question_id", "left").join(scoped, "question_id", "left").join(first, "question_id", "left")
    )


def set_status(rows: DataFrame, chosen: DataFrame, key: str, status: str, at: Column) -> DataFrame:
    """Archive, restore or delete a set of keys; other rows and all children stay as they are."""
    hit = chosen.select(key).distinct().withColumn("__hit", F.lit(True))
    stamped = at if status != "ACTIVE" else F.lit(None).cast("timestamp")
    return (
        rows.join(hit, key, "left")
        .withColumn("status", F.when(F.col("__hit"), F.lit(status)).otherwise(F.col("status")))
        .withColumn("archived_at", F.when(F.col("__hit"), stamped).otherwise(F.col("archived_at")))
        .drop("__hit")
    )
