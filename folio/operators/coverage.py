"""Coverage plans: content of a scope, windows, budgets, quotas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import estimate_tokens, markup_count, token_estimate
from folio.operators.ordered import numbered, page_cover, scan

SECTION_TYPES = ("section", "lesson", "exercise", "activity", "topic")
NOISE_TYPES = ("header", "footer", "page_number")


def check_selection(selection: DataFrame, nodes: DataFrame, content: DataFrame, open_pages: int = 15) -> DataFrame:
    """Each selected node is owned by its version and has content, or the error says why not."""
    owned = selection.join(
        nodes.select("version_id", "node_id", "start_page", F.lit(True).alias("owned"),
                     F.coalesce("end_page", F.col("start_page") + open_pages).alias("last_page")),
        ["version_id", "node_id"], "left",
    )
    pages = content.select("version_id", "page_no").distinct()
    filled = (
        page_cover(owned.filter("owned"), "start_page", "last_page")
        .join(pages, ["version_id", "page_no"], "left_semi")
        .select("version_id", "node_id", F.lit(True).alias("filled")).distinct()
    )
    status = (
        F.when(F.col("owned").isNull(), "INVALID_CURRICULUM_SCOPE")
        .when(F.col("filled").isNull(), "EMPTY_CURRICULUM_SCOPE")
        .otherwise("OK")
    )
    return owned.join(filled, ["version_id", "node_id"], "left").select("version_id", "node_id", status.alias("status"))


def scope_content(selected: DataFrame, content: DataFrame, open_pages: int = 15) -> DataFrame:
    """Content on the pages of each selected node; neighbours that share a page both get it.

    Node ranges become one row per page, so a large version spreads over the
    cluster by (version, page).
    """
    spans = selected.select(
        "version_id", "node_id", "start_page", F.coalesce("end_page", F.col("start_page") + open_pages).alias("last_page")
    )
    pages = page_cover(spans, "start_page", "last_page").select("version_id", "node_id", "page_no")
    return content.join(pages, ["version_id", "page_no"])


def keyed_content(selected: DataFrame, content: DataFrame) -> DataFrame:
    """C3 by key: content that carries the unit, or the unit and lesson, of each selected scope.

    `selected` has version_id, node_id, unit_no and lesson_no (null: the whole unit); content without a unit is in no scope.
    """
    units = selected.filter("lesson_no is null").select("version_id", "node_id", "unit_no")
    lessons = selected.filter("lesson_no is not null").select("version_id", "node_id", "unit_no", "lesson_no")
    cols = ["node_id", *content.columns]
    return content.join(units, ["version_id", "unit_no"]).select(*cols).union(
        content.join(lessons, ["version_id", "unit_no", "lesson_no"]).select(*cols)
    )


def treeless_content(versions: DataFrame, nodes: DataFrame, content: DataFrame) -> DataFrame:
    """C3 without a tree: a version that has no nodes is one scope, `legacy_all`, of all its content."""
    bare = versions.select("version_id").distinct().join(nodes.select("version_id").distinct(), "version_id", "left_anti")
    return content.join(bare, "version_id").withColumn("node_id", F.lit("legacy_all"))


def split_windows(selected: DataFrame, nodes: DataFrame, content: DataFrame, batch: int = 12, few: int = 10) -> DataFrame:
    """Content rows of each selected node with the window they fall into.

    A node with typed child sections and more than `few` contents is split by
    section; any other node into batches of `batch` in page order.
    """
    inside = scope_content(selected, content)
    totals = inside.groupBy("node_id").agg(F.count("*").alias("n_content"))
    sections = nodes.filter(F.col("node_type").isin(*SECTION_TYPES)).join(
        selected.select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi"
    )
    parents = sections.groupBy(F.col("parent_id").alias("node_id")).agg(F.lit(True).alias("has_sections"))
    plan = totals.join(parents, "node_id", "left").select(
        "node_id", "n_content", (F.coalesce("has_sections", F.lit(False)) & (F.col("n_content") > few)).alias("by_section")
    )
    cols = ["version_id", "node_id", "content_id", "page_no", "ordinal", "node_type", "content_text"]

    section_pages = page_cover(
        sections.select("version_id", F.col("parent_id").alias("node_id"), F.col("ordinal").alias("window_no"),
                        "start_page", F.coalesce("end_page", "start_page").alias("last_page")),
        "start_page", "last_page",
    ).select("version_id", "node_id", "page_no", "window_no")
    sectioned = (
        inside.join(plan.filter("by_section").select("node_id"), "node_id", "left_semi")
        .join(section_pages, ["version_id", "node_id", "page_no"])
        .select(*cols, "window_no", F.lit(None).cast("bigint").alias("part_no"))
    )
    rest = inside.join(plan.filter("not by_section").select("node_id", "n_content"), "node_id")
    counted = numbered(rest, ["node_id"], F.floor(F.col("page_no") / 16), [F.col("page_no"), F.col("ordinal")])
    number = F.floor((F.col("rn") - 1) / batch)
    batched = counted.select(
        *cols, number.alias("window_no"), F.when(F.col("n_content") > batch, number + 1).alias("part_no")
    )
    return sectioned.union(batched)


def usable(content: DataFrame, text: str = "content_text", kind: str = "node_type") -> DataFrame:
    """E9 skips: blank text, and page furniture shorter than ten characters."""
    body = F.regexp_replace(text, r"^\s+|\s+$", "")
    noise = (F.length(body) < 10) & F.col(kind).isin(*NOISE_TYPES)
    return content.withColumn(text, body).filter((F.length(text) > 0) & ~noise)


def pack(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], text: str, limit: int = 2200, at_least: int = 3,
    bucket: Column | None = None,
) -> DataFrame:
    """Keep texts in order until the characters pass `limit`, never fewer than `at_least`.

    Closed form of the loop: a text stays iff it is among the first `at_least`
    or the running total including it is within the limit. Give `bucket` when a
    group has no known bound; without it the group is a batch of fixed size.
    """
    chars = F.length(text).cast("bigint")
    if bucket is None:
        over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        ranked = df.withColumn("chunk_no", F.count("*").over(over)).withColumn("used_chars", F.sum(chars).over(over))
    else:
        one = F.lit(1).cast("bigint")
        ranked = scan(df, keys, bucket, order, sums={"chunk_no": one, "used_chars": chars})
    return ranked.filter((F.col("chunk_no") <= at_least) | (F.col("used_chars") <= limit))


def source_block(chunk_id: Column, page: Column, body: Column, scope: Column | None = None, title: Column | None = None) -> Column:
    """A text wrapped with its id, page, scope and title."""
    scoped = F.concat(F.lit('" scope="'), scope) if scope is not None else F.lit("")
    titled = F.when(title.isNotNull() & (title != ""), F.concat(F.lit(' title="'), title, F.lit('"'))).otherwise("") \
        if title is not None else F.lit("")
    return F.concat(
        F.lit('<SOURCE id="'), chunk_id, F.lit('" page="'), page.cast("string"), scoped, F.lit('"'), titled,
        F.lit(">\n"), body, F.lit("\n</SOURCE>"),
    )


def chunk_id(number: Column) -> Column:
    return F.format_string("SRC-%03d", number)


def trim_to_budget(
    chunks: DataFrame, keys: Sequence[str], order: Sequence[Column], block: str, template: str, system_tokens: int,
    target: int = 2800,
) -> DataFrame:
    """Drop chunks from the end until the estimated prompt fits; the first always stays.

    The estimate grows with every chunk, so the loop is a running total over the
    window's chunks (a window was packed to a fixed size before).
    """
    over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    chars = F.sum(F.length(block)).over(over) + 2 * (F.count("*").over(over) - 1) + len(template)
    fixed_marks = F.lit(template)
    marks = F.sum(markup_count(F.col(block))).over(over) + markup_count(fixed_marks)
    estimate = token_estimate(chars, marks) + system_tokens + 450 + 60
    return (
        chunks.withColumn("k", F.count("*").over(over)).withColumn("prompt_tokens", estimate)
        .filter((F.col("prompt_tokens") <= target) | (F.col("k") == 1))
    )


def within_budget(prompt_tokens: Column, verification: bool = False, generate: int = 2800, verify: int = 4000) -> Column:
    """E11 as a test: whether an estimated prompt fits its target."""
    return prompt_tokens <= (verify if verification else generate)


def allocate(rank: Column, windows: Column, requested: Column) -> Column:
    """Questions for the window of that rank (1-based)."""
    base, rest = F.floor(requested / windows), requested % windows
    few = F.when(rank <= requested, 1).otherwise(0)
    return F.when(requested <= windows, few).otherwise(base + F.when(rank <= rest, 1).otherwise(0)).cast("bigint")


def document_windows(lines: DataFrame, batch: int = 12, limit: int = 2200) -> DataFrame:
    """Chunks of every document's windows: batches of `batch` lines, each packed to `limit` characters."""
    counted = numbered(lines, ["doc_id"], F.floor(F.col("page_no") / 8), [F.col("line_no")])
    windowed = counted.withColumn("window_no", F.floor((F.col("rn") - 1) / batch))
    return pack(windowed, ["doc_id", "window_no"], [F.col("line_no")], "text", limit)


def coverage_plan(lines: DataFrame, requested: Column) -> DataFrame:
    """Flagship: windows of every document with their size, token estimate and question quota.

    Lines are numbered with one shuffle on (document, page range); windows then
    have at most twelve lines each. Every batch keeps its first chunk through
    packing and trimming, so the number of windows of a document follows from
    its number of lines and needs no second run of the plan.
    """
    chunks = document_windows(lines).withColumn(
        "block", source_block(chunk_id(F.col("rn")), F.col("page_no"), F.col("text"))
    )
    fitted = trim_to_budget(chunks, ["doc_id", "window_no"], [F.col("line_no")], "block", "Questions from:\n", 700)
    windows = fitted.groupBy("doc_id", "window_no").agg(
        F.count("*").alias("n_chunks"), F.sum(F.length("text")).cast("bigint").alias("chars"),
        F.max("prompt_tokens").alias("est_tokens"),
    )
    totals = lines.groupBy("doc_id").agg((F.floor((F.count("*") - 1) / 12) + 1).alias("n_windows"))
    rank = F.col("window_no") + 1
    return windows.join(totals, "doc_id").select(
        "doc_id", "window_no", "n_chunks", "chars", "est_tokens",
        allocate(rank, F.col("n_windows"), requested).alias("target_questions"),
    )


def plan_totals(windows: DataFrame, plan_key: str) -> DataFrame:
    """D14."""
    return windows.groupBy(plan_key).agg(
        F.count("*").alias("n_windows"), F.sum("n_chunks").cast("bigint").alias("total_chunks"),
        F.sum("est_tokens").cast("bigint").alias("total_tokens"),
    )


def describe_scopes(selected: DataFrame, plan_key: str, order: Sequence[Column]) -> DataFrame:
    """One to three scopes by name, more by count and the first.

    At most three rows per plan survive the rank filter, which Spark applies
    before the shuffle; the count is a plain aggregate.
    """
    over = Window.partitionBy(plan_key).orderBy(*order)
    top = selected.withColumn("place", F.row_number().over(over)).filter("place <= 3")
    names = top.groupBy(plan_key).agg(F.array_sort(F.collect_list(F.struct("place", "scope_name"))).alias("s"))
    counts = selected.groupBy(plan_key).agg(F.count("*").alias("n"))
    listed = F.array_join(F.transform("s", lambda x: x["scope_name"]), " + ")
    many = F.concat(F.col("n").cast("string"), F.lit(" Selected Curriculum Scopes ("), F.col("s")[0]["scope_name"], F.lit(" and others)"))
    return names.join(counts, plan_key).select(
        plan_key, F.when(F.col("n") <= 3, listed).otherwise(many).alias("description")
    )


def cited_context(chunks: DataFrame, citations: DataFrame, key: str, cited: int = 4, fallback: int = 3) -> DataFrame:
    """C20: the first cited chunks of a batch; when it cites none of them, its first chunks.

    Both limits are ranks below ten, cut before the shuffle.
    """
    over = Window.partitionBy(key).orderBy("chunk_no")
    hits = chunks.join(citations.select(key, "chunk_id").distinct(), [key, "chunk_id"], "left_semi")
    first_hits = hits.withColumn("place", F.row_number().over(over)).filter(F.col("place") <= cited)
    without = chunks.join(hits.select(key).distinct(), key, "left_anti")
    first_any = without.withColumn("place", F.row_number().over(over)).filter(F.col("place") <= fallback)
    return first_hits.unionByName(first_any).drop("place")


__all__ = [
    "allocate", "check_selection", "chunk_id", "cited_context", "coverage_plan", "describe_scopes", "document_windows",
    "estimate_tokens", "pack", "plan_totals", "scope_content", "source_block", "split_windows", "trim_to_budget", "usable",
]
