"""Input tables of the engine, derived from the test tables.

Every view is lazy: filters and column lists given later still reach Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.ordered import numbered
from folio.runtime import fan_out, spread, table
from folio.sources import shared as S


def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Non-empty trimmed lines of every document with their 1-based place in the raw text."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"))
    raw = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n", -1)).alias("p", "l"))
    return raw.select(
        "doc_id", "lang", "source", (F.col("p") + 1).cast("bigint").alias("line_no"), F.trim("l").alias("text")
    ).filter(F.length("text") > 0)


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents laid out on pages of forty lines."""
    return text_lines(spark, sf).selectExpr(
        "doc_id", "lang", "source", "line_no", "text",
        f"{S.LINE_PAGE} AS page_no", f"{S.LINE_SIZE} AS size",
        "72.0D AS x0", f"{S.LINE_Y0} AS y0", "72.0D + 5.5D * length(text) AS x1", f"{S.LINE_Y0} + {S.LINE_SIZE} AS y1",
    )


def book_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Books of 25 pages with headings, examples, lists and tables at known places."""
    placed = text_lines(spark, sf).selectExpr(
        "*", f"{S.BOOK_ID} AS book_id", f"{S.BOOK_PAGE} AS page_no"
    ).withColumnRenamed("text", "raw")
    shaped = placed.selectExpr(
        "book_id", "page_no", "line_no", f"{S.BOOK_TEXT} AS text", f"{S.BOOK_SIZE} AS size",
        f"{S.BOOK_BOLD} AS bold", f"{S.BOOK_X0} AS x0", f"{S.BOOK_Y0} AS y0",
    )
    return shaped.selectExpr(
        "book_id", "page_no", "line_no", "trim(text) AS text", "size", "bold", "x0", "y0",
        "x0 + 5.5D * length(text) AS x1", "y0 + size AS y1",
    )


def book_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Page sizes; images and drawings occur on some pages."""
    return (
        book_lines(spark, sf).groupBy("book_id", "page_no")
        .agg(F.expr(S.BOOK_HEIGHT).alias("height"))
        .selectExpr("book_id", "page_no", "595.0D AS width", "height",
                    "(book_id + page_no) % 3 AS n_images", "(book_id + page_no) % 2 AS n_drawings")
    )


def line_words(rows: DataFrame, piece: int = 64) -> DataFrame:
    """`rows` with a column text as one row a word: i (from 0), word, and before, the length of the words before it with the spaces between them.

    Lines are cut into pieces of `piece` words first, so that no word's row carries, or counts through, a line of any length.
    """
    kept = [c for c in rows.columns if c != "text"]
    cut_up = rows.withColumn("ws", F.split("text", " ", -1)).select(
        *kept, "ws", F.explode(F.expr(f"sequence(0, (size(ws) - 1) div {piece})")).alias("k")
    )
    pieces = cut_up.selectExpr(
        *kept, f"CAST({piece} * k AS INT) AS start", f"array_join(slice(ws, CAST({piece} * k AS INT) + 1, {piece}), ' ') AS piece",
        f"CASE WHEN k > 0 THEN length(array_join(slice(ws, 1, CAST({piece} * k AS INT)), ' ')) + 1 ELSE 0 END AS off",
    )
    words = pieces.select(*kept, "start", "piece", "off", F.posexplode(F.split("piece", " ", -1)).alias("j", "word"))
    return words.selectExpr(
        *kept, "start + j AS i", "word", "off + length(substring_index(piece, ' ', j)) - CASE WHEN j = 0 AND start > 0 THEN 1 ELSE 0 END AS before"
    )


def book_words(spark: SparkSession, sf: str) -> DataFrame:
    """Word boxes: words of a line left to right, with a little vertical jitter."""
    words = line_words(book_lines(spark, sf))
    left = "x0 + 5.5D * before + (CASE WHEN i > 0 THEN 5.5D ELSE 0.0D END)"
    return words.filter(F.length("word") > 0).selectExpr(
        "book_id", "page_no", "line_no", "CAST(i + 1 AS BIGINT) AS word_no", "word AS text",
        f"{left} AS x0", "y0 + 0.5D * (i % 3) AS y0",
        f"{left} + 5.5D * length(word) AS x1", "y0 + 0.5D * (i % 3) + size AS y1",
    )


def book_spans(spark: SparkSession, sf: str, by_line: bool = False) -> DataFrame:
    """Font spans: one per word; some words are set smaller and raised or lowered.

    `by_line` deals out whole lines first, so that what looks at the spans of a line need not shuffle every word.
    """
    lines = book_lines(spark, sf)
    words = line_words(fan_out(lines, "book_id", "page_no", "line_no") if by_line else lines)
    left = "x0 + 5.5D * (before - greatest(i - 1, 0)) + (CASE WHEN i > 0 THEN 2.0D ELSE 0.0D END)"
    return words.filter(F.length("word") > 0).selectExpr(
        "book_id", "page_no", "line_no", "CAST(i + 1 AS BIGINT) AS span_no", "word AS text",
        "CASE WHEN i % 5 IN (3, 4) THEN size * 0.5D ELSE size END AS size",
        "CASE WHEN bold THEN 'Serif-Bold' WHEN i % 7 = 2 THEN 'Serif-Italic' ELSE 'Serif' END AS font",
        "CAST(CASE WHEN i % 11 = 5 THEN 16 WHEN i % 11 = 6 THEN 2 ELSE 0 END AS BIGINT) AS flags",
        f"{left} AS x0", "y0", f"{left} + 5.5D * length(word) AS x1", "y1",
        "CASE WHEN i % 5 = 3 THEN y1 - 0.5D * size WHEN i % 5 = 4 THEN y1 + 0.25D * size ELSE y1 END AS origin_y",
    )


def leaves(spark: SparkSession, sf: str) -> DataFrame:
    """Customers under nations under regions, one page each, numbered through the whole library."""
    joined = (
        table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .selectExpr("c_custkey", "c_name", "n_nationkey", "n_name", "r_regionkey", "r_name")
    )
    bucket = F.struct("r_regionkey", "n_nationkey", F.floor(F.col("c_custkey") / 65536).alias("part"))
    return numbered(joined, [], bucket, [F.col("r_regionkey"), F.col("n_nationkey"), F.col("c_custkey")], "pg")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Curriculum trees: a version per region, three levels, leaf end pages missing for odd keys."""
    leaf = leaves(spark, sf)
    version = "concat('v', r_regionkey) AS version_id"
    tops = leaf.groupBy("r_regionkey", "n_nationkey", "n_name", "r_name").agg(
        F.min("pg").alias("lo"), F.max("pg").alias("hi")
    )
    roots = tops.groupBy("r_regionkey", "r_name").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).selectExpr(
        version, "concat('r', r_regionkey) AS node_id", "CAST(NULL AS STRING) AS parent_id", "0L AS depth",
        "CAST(r_regionkey AS BIGINT) AS ordinal", "'unit' AS node_type", "r_name AS title",
        "lo AS start_page", "hi AS end_page",
    )
    mid = tops.selectExpr(
        version, "concat('n', n_nationkey)", "concat('r', r_regionkey)", "1L", "CAST(n_nationkey AS BIGINT)",
        "'lesson'", "n_name", "lo", "hi",
    )
    low = leaf.selectExpr(
        version, "concat('c', c_custkey)", "concat('n', n_nationkey)", "2L", "c_custkey", "'section'", "c_name",
        "pg", "CASE WHEN c_custkey % 2 = 1 THEN NULL ELSE pg END",
    )
    return roots.union(mid).union(low)


def content(spark: SparkSession, sf: str) -> DataFrame:
    """Content rows on the pages of the trees: one per order, on the page of its customer."""
    leaf = leaves(spark, sf).selectExpr("c_custkey", "r_regionkey", "pg")
    return (
        table(spark, sf, "orders").join(leaf, F.col("o_custkey") == F.col("c_custkey"))
        .selectExpr(
            "o_orderkey AS content_id", "concat('v', r_regionkey) AS version_id", "o_orderkey AS ordinal",
            "pg AS page_no", "CASE WHEN o_orderkey % 9 = 0 THEN 'header' ELSE 'generic_text' END AS node_type",
            "concat(o_orderpriority, ' ', o_orderstatus) AS content_text",
        )
    )


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Question candidates with every kind of defect, in jobs of fifty and rounds of ten."""
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS seq", f"concat('job_', {S.div('p_partkey', 50)}) AS job_id",
        f"{S.div('p_partkey % 50', 10)} + 1 AS round", "concat('q_', p_partkey) AS question_id",
        f"{S.CANDIDATE_STEM} AS stem",
        f"""array(named_struct('id','opt_1','text',CAST(p_size*p_size AS STRING)),
              named_struct('id','opt_2','text',CAST(p_size*p_size+5 AS STRING)),
              named_struct('id','opt_3','text',{S.OPTION_3}),
              named_struct('id','opt_4','text',CAST(p_size*p_size+10 AS STRING))) AS options""",
        f"{S.CORRECT_ID} AS correct_option_id", f"{S.EXPLANATION} AS explanation",
        "CASE WHEN p_partkey % 19 = 0 THEN array() ELSE array(concat('SRC-', p_partkey % 7)) END AS source_chunk_ids",
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Stored questions, one per part; some part numbers are not in the bank."""
    return table(spark, sf, "part").filter("p_partkey % 50 <> 7").selectExpr(
        "p_partkey AS question_id", f"{S.PART_VERSION} AS version_id", f"{S.STEM} AS stem",
        "concat('o_', p_partkey, '_', p_partkey % 4 + 1) AS correct_option_id", "p_size",
        "'n times n' AS explanation",
    )


def options(spark: SparkSession, sf: str) -> DataFrame:
    """Four options per stored question."""
    return questions(spark, sf).select(
        "question_id", "p_size", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("canonical_order")
    ).selectExpr(
        "question_id", "concat('o_', question_id, '_', canonical_order + 1) AS option_id",
        "CAST(canonical_order AS BIGINT) AS canonical_order",
        "CAST(p_size * p_size + canonical_order * 5 AS STRING) AS option_text",
    )


def papers(spark: SparkSession, sf: str) -> DataFrame:
    """Question papers: one per order."""
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS set_id", f"{S.PAPER_VERSION} AS version_id", "concat('Paper ', o_orderpriority) AS title",
        "CASE WHEN o_orderkey % 9 = 0 THEN 'ARCHIVED' ELSE 'ACTIVE' END AS status", "o_orderdate AS created_at",
        "CASE WHEN o_orderkey % 6 = 0 THEN o_totalprice END AS given_marks",
        "CAST(o_orderkey % 3 + 1 AS DOUBLE) AS marks_per_question",
    )


def paper_items(spark: SparkSession, sf: str) -> DataFrame:
    """Arrangement rows of papers: one per line item, with option orders that are sometimes broken."""
    oid = "concat('o_', l_partkey, '_', (l_linenumber + {k}) % 4 + 1)"
    first = f"CASE WHEN l_suppkey % 37 = 0 THEN 'o_x' WHEN l_suppkey % 41 = 0 THEN {oid.format(k=1)} ELSE {oid.format(k=0)} END"
    four = f"array({first}, {oid.format(k=1)}, {oid.format(k=2)}, {oid.format(k=3)})"
    items = spread(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    return items.selectExpr(
        "l_orderkey AS set_id", "l_partkey AS question_id", f"{S.ITEM_ORDER} AS question_order", "l_suppkey",
        f"CASE WHEN l_suppkey % 50 = 0 THEN slice({four}, 1, 3) ELSE {four} END AS option_order",
    )


def versions(spark: SparkSession, sf: str) -> DataFrame:
    """Ingested books: one per document."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return docs.join(labels, "doc_id", "left").selectExpr(
        "doc_id AS version_id", f"{S.VERSION_TITLE} AS title", f"{S.VERSION_FILE} AS source_filename",
        f"{S.GRADE_ID} AS grade_id", f"{S.SUBJECT_ID} AS subject_id", "sha2(text, 256) AS checksum",
        "CAST(length(text) AS BIGINT) AS n_bytes", "doc_id % 30 + 1 AS page_count",
        f"{S.INGESTION} AS ingestion_status", "coalesce(toxic = 1, false) AS is_deleted",
        "CASE quality WHEN 1 THEN 'VALID' WHEN 0 THEN 'NEEDS_REFRESH' ELSE 'UNASSESSED' END AS quality_status",
        "CASE WHEN doc_id % 8 = 0 THEN 'USER_CONFIRMED' ELSE 'NEEDS_REVIEW' END AS metadata_status",
        "doc_id AS created_seq", f"{S.FRONT_TEXT} AS front_text",
    )


def bank(spark: SparkSession, sf: str) -> DataFrame:
    """A bank of free-text questions: benchmark items and user turns."""
    bm = table(spark, sf, "benchmark").selectExpr(
        "concat('bm_', item_id) AS question_id", "item_id AS n", "text AS stem", "'benchmark item' AS explanation",
        "'MANUAL' AS origin_type",
    )
    cv = table(spark, sf, "conversations").filter("role = 'user'").selectExpr(
        "concat('cv_', conv_id, '_', turn)", "conv_id * 100 + turn", "text", "concat('turn ', turn)", "'AI_GENERATED'",
    )
    return bm.union(cv).selectExpr(
        "question_id", "n AS created_seq", "concat('ver_', n % 7) AS version_id", "stem", "explanation", "origin_type",
        "CASE WHEN n % 6 = 0 THEN 'ARCHIVED' ELSE 'ACTIVE' END AS status", "concat('n', n % 25) AS node_id",
    )


def job_events(spark: SparkSession, sf: str) -> DataFrame:
    """Progress events of generation jobs."""
    return table(spark, sf, "events").selectExpr(
        "event_id", "ts", "user_id AS job_id",
        """CASE event_type WHEN 'click' THEN 'candidate' WHEN 'purchase' THEN 'accepted' WHEN 'view' THEN 'surplus'
             WHEN 'error' THEN 'rejected' ELSE 'start' END AS kind""",
        "value",
    )
