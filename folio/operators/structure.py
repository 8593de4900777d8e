"""Units, lessons and content nodes found in the lines of books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import titles
from folio.functions.classify import block_payload, typed_blocks
from folio.functions.numbers import SPACE, canonical_token, strip_space
from folio.functions.text import content_hash
from folio.operators.layout import PAGE, joined_text, union_box
from folio.operators.ordered import numbered, runs, scan
from folio.operators.tree import closing_end
from folio.runtime import cut

LINE_ORDER = ["y0", "x0", "line_no"]


def _page_bucket() -> Column:
    return F.floor(F.col("page_no") / 16)


def mark_headings(lines: DataFrame) -> DataFrame:
    """Unit and lesson headings with number and title, and the lines they take their title from.

    A heading without a title takes the next line unless that is a heading of
    the same two forms. Such a line never takes a further one, so whether a line
    is taken depends on the line before it only.
    """
    text = F.col("text")
    form = F.when(text.rlike(titles.UNIT_HEADING), "unit").when(text.rlike(titles.LESSON_HEADING), "lesson").when(
        text.rlike(titles.DOTTED_HEADING), "dotted"
    )

    def part(i: int) -> Column:
        return F.when(F.col("form") == "unit", F.regexp_extract(text, titles.UNIT_HEADING, i)).when(
            F.col("form") == "lesson", F.regexp_extract(text, titles.LESSON_HEADING, i)
        )

    # Each line is matched once, in columns of its own; what a neighbour needs of it moves as a flag. All that a heading says is
    # read before the scan, so lines move without their texts where the caller drops them.
    shaped = lines.withColumn("form", form)
    flagged = shaped.withColumn("heading", F.col("form").isNotNull() & ~titles.is_contents_entry(text)).withColumn(
        "named", F.coalesce(F.col("form").isin("unit", "lesson"), F.lit(False))
    )
    flagged = flagged.withColumn("own", F.when(
        F.col("heading"), strip_space(F.coalesce(part(3), F.regexp_extract(text, titles.DOTTED_HEADING, 2)))
    )).withColumn("raw", F.when(F.col("heading"), part(2))).withColumn("first_word", F.when(F.col("heading"), part(1))).withColumn(
        "dotted", F.when(F.col("heading") & ~F.col("named"), F.regexp_extract(text, titles.DOTTED_HEADING, 1))
    )
    near = scan(
        flagged, PAGE, F.floor(F.col("y0") / 2048), [F.col(c) for c in LINE_ORDER],
        lags={"after_untitled": F.coalesce(F.col("named") & (F.col("own") == ""), F.lit(False))},
        leads={"next_text": text, "next_named": F.col("named")},
    )
    taken = F.coalesce(F.col("after_untitled") & ~F.col("named"), F.lit(False))
    kind = F.when(F.col("taken") | ~F.col("heading"), F.lit(None).cast("string")).when(F.col("form") == "unit", "unit").otherwise("lesson")
    marked = near.withColumn("taken", taken).withColumn("kind", kind).withColumn(
        "label", F.when(F.col("kind").isNotNull(), F.initcap("first_word"))
    )
    number = F.when(F.col("named"), F.coalesce(canonical_token(F.col("raw")), F.col("raw"))).otherwise(F.col("dotted"))
    marked = marked.withColumn("number", F.when(F.col("kind").isNotNull(), number))
    takes = (F.col("own") == "") & F.coalesce((F.col("next_text") != "") & ~F.col("next_named"), F.lit(False))
    title = F.when(F.col("own") != "", F.col("own")).when(takes, strip_space(F.col("next_text"))).otherwise(
        F.concat("label", F.lit(" "), "number")
    )
    return marked.select(
        *lines.columns, "taken", "kind", F.when(F.col("kind") == "unit", F.col("label")).alias("label"), "number",
        F.when(F.col("kind").isNotNull(), title).alias("title"),
    )


def mark_places(lines: DataFrame) -> DataFrame:
    """E4 without texts: marked lines with two flags in place of a line's text, for steps that ask only where things stand.

    `solid` says that the text is not blank, `says_contents` that it may name a contents page.
    """
    text = F.col("text")
    flags = lines.select(
        *PAGE, "line_no", "text", "x0", "y0", "x1", "y1", (~text.rlike(f"^{SPACE}*$")).alias("solid"),
        F.when(F.col("line_no") <= 5, titles.is_contents_marker(text)).alias("says_contents"),
    )
    return mark_headings(flags).drop("text")


def contents_pages(lines: DataFrame) -> DataFrame:
    """Whether one of the first five lines of a page says it is the contents."""
    says = F.col("says_contents") if "says_contents" in lines.columns else titles.is_contents_marker(F.col("text"))
    return lines.filter("line_no <= 5").groupBy(*PAGE).agg(F.max(says).alias("is_contents"))


def without_contents(marked: DataFrame) -> DataFrame:
    """Lines of a book without the contents pages that come before its first heading."""
    flags = contents_pages(marked).filter("is_contents")
    first = (
        marked.filter("kind is not null").select(*PAGE).distinct().join(flags, PAGE, "left_anti")
        .groupBy("book_id").agg(F.min("page_no").alias("first_page"))
    )
    early = F.col("first_page").isNull() | (F.col("page_no") <= F.col("first_page"))
    skipped = cut(flags.join(first, "book_id", "left").filter(early).select(*PAGE), "contents")
    return marked.join(skipped, PAGE, "left_anti")


def assign_headings(marked: DataFrame) -> DataFrame:
    """E5: the unit and lesson every line belongs to (null before the first).

    Units are counted along the book; lessons restart with each unit, so a
    lesson's number is its running count less the count at its unit's heading.
    A lesson before any unit opens unit 1.
    """
    order = [F.col("page_no"), *[F.col(c) for c in LINE_ORDER]]
    lines = without_contents(marked)
    # Only headings count, so only they are numbered; every other line takes the numbers of the heading before it.
    heads = lines.filter("kind is not null")
    first_kind = heads.groupBy("book_id").agg(F.min_by("kind", F.struct("page_no", *LINE_ORDER)).alias("first_kind"))
    counted = scan(
        heads, ["book_id"], _page_bucket(), order,
        sums={"u": (F.col("kind") == "unit").cast("bigint"), "l": (F.col("kind") == "lesson").cast("bigint")},
    )
    at_unit = scan(
        counted, ["book_id"], _page_bucket(), order, fills={"l_before": F.when(F.col("kind") == "unit", F.col("l"))}
    ).join(first_kind, "book_id", "left")
    implicit = F.when(F.col("first_kind") == "lesson", 1).otherwise(0)
    lesson_no = F.col("l") - F.coalesce("l_before", F.lit(0))
    at = F.struct((F.col("u") + implicit).cast("bigint").alias("unit_no"), F.when(lesson_no > 0, lesson_no).alias("lesson_no"))
    numbers = cut(at_unit.select(*marked.columns, at.alias("at")), "heads")
    plain = lines.filter("kind is null").withColumn("at", F.lit(None).cast("struct<unit_no:bigint,lesson_no:bigint>"))
    filled = scan(plain.unionByName(numbers), ["book_id"], _page_bucket(), order, fills={"last": F.col("at")})
    return filled.select(*marked.columns, "last.unit_no", "last.lesson_no")


def unit_rows(assigned: DataFrame, last_pages: DataFrame) -> DataFrame:
    """Units with the pages they span; the unit opened by a lone lesson included."""
    stated = assigned.filter("kind = 'unit'").select(
        "book_id", "unit_no", "number", "label", "title", F.col("page_no").alias("start_page"), "line_no"
    )
    opened = (
        assigned.filter("kind = 'lesson' and unit_no = 1 and lesson_no = 1")
        .join(stated.filter("unit_no = 1").select("book_id"), "book_id", "left_anti")
        .select("book_id", "unit_no", F.lit("1").alias("number"), F.lit("Unit").alias("label"), F.lit("Unit 1").alias("title"),
                F.col("page_no").alias("start_page"), "line_no")
    )
    both = stated.union(opened)
    near = scan(both, ["book_id"], F.floor(F.col("unit_no") / 1024), [F.col("unit_no")], leads={"following": F.col("start_page")})
    return near.join(last_pages, "book_id").select(
        "book_id", "unit_no", "number", "label", "title", "start_page",
        closing_end(F.col("start_page"), F.col("following"), F.col("last_page")).alias("end_page"),
    )


def lesson_rows(assigned: DataFrame, last_pages: DataFrame) -> DataFrame:
    """Lessons, closed by the next heading of any kind."""
    heads = assigned.filter("kind is not null")
    order = [F.col("page_no"), *[F.col(c) for c in LINE_ORDER]]
    near = scan(heads, ["book_id"], _page_bucket(), order, leads={"following": F.col("page_no")})
    return near.filter("kind = 'lesson'").join(last_pages, "book_id").select(
        "book_id", "unit_no", "lesson_no", "number", "title", F.col("page_no").alias("start_page"),
        closing_end(F.col("page_no"), F.col("following"), F.col("last_page")).alias("end_page"),
    )


def content_lines(assigned: DataFrame) -> DataFrame:
    """Lines of content with the number of their block on the page: blocks lie between headings, page ends and wide gaps."""
    rows = assigned.withColumn("plain", F.col("kind").isNull() & ~F.col("taken"))
    height = F.greatest(F.lit(0.0), F.col("y1") - F.col("y0"))

    def splits(p: Column) -> Column:
        wide = F.col("y0") - p["y1"] > F.greatest(F.lit(14.0), 1.6 * ((p["y1"] - p["y0"]) + height) / 2)
        return ~(p["plain"] & F.col("plain")) | wide

    order = [F.col(c) for c in LINE_ORDER]
    marked = runs(
        rows, PAGE, F.floor(F.col("y0") / 2048), order, ["y0", "y1", "plain"], ["y0", "y1", "plain"], splits, "node_no"
    )
    return marked.filter("plain and unit_no is not null")


def content_places(assigned: DataFrame) -> DataFrame:
    """Where the blocks of `content_nodes` stand, of lines marked without texts (`mark_places`): page, number, unit, lesson and box."""
    grouped = content_lines(assigned).groupBy(*PAGE, "node_no").agg(
        F.first("unit_no").alias("unit_no"), F.first("lesson_no").alias("lesson_no"), F.max("solid").alias("solid"), *union_box()
    )
    return grouped.filter("solid").drop("solid")


def content_nodes(assigned: DataFrame, domains: DataFrame) -> DataFrame:
    """Content blocks between headings, page ends and wide gaps, typed, with payload (H27 / H28), and hashed (H6)."""
    grouped = content_lines(assigned).groupBy(*PAGE, "node_no").agg(
        F.first("unit_no").alias("unit_no"), F.first("lesson_no").alias("lesson_no"),
        strip_space(joined_text("\n", *LINE_ORDER)).alias("content_text"), *union_box(),
    ).filter(F.col("content_text") != "")
    typed = typed_blocks(grouped.join(domains, "book_id").drop("title"))
    return typed.withColumn(
        "content_hash", content_hash(F.col("content_text"))
    ).withColumn("payload", block_payload(F.col("node_type"), F.col("content_text")))


def content_ordinals(nodes: DataFrame) -> DataFrame:
    """Running number of content in its book."""
    return numbered(nodes, ["book_id"], _page_bucket(), [F.col("page_no"), F.col("node_no")], "ordinal")


def front_matter(marked: DataFrame, assigned: DataFrame) -> DataFrame:
    """E5: pages that carry text before the first unit, contents pages included."""
    skipped = marked.select(*PAGE).distinct().join(assigned.select(*PAGE).distinct(), PAGE, "left_anti")
    before = assigned.filter("unit_no is null and kind is null and not taken").select(*PAGE).distinct()
    return skipped.union(before)


def hierarchy(lines: DataFrame, domains: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Marked lines, units, lessons and content nodes of books."""
    marked = mark_headings(lines)
    assigned = assign_headings(marked)
    last = lines.groupBy("book_id").agg(F.max("page_no").alias("last_page"))
    return marked, unit_rows(assigned, last), lesson_rows(assigned, last), content_nodes(assigned, domains)


def curriculum_nodes(units: DataFrame, lessons: DataFrame, books: DataFrame) -> DataFrame:
    """Units and lessons that pass the title gates as tree nodes with repaired numbers and labels."""
    u = units.join(books.select("book_id", F.col("title").alias("book_title")), "book_id").withColumn(
        "node_title", titles.clean_heading(F.coalesce("title", F.lit("")))
    ).filter(titles.is_unit_title(F.col("node_title")))
    roots = numbered(u, ["book_id"], F.floor(F.col("unit_no") / 1024), [F.col("unit_no")], "ordinal")
    raw = strip_space(F.coalesce("number", F.lit("")))
    kind = titles.node_kind(F.col("label"), F.col("book_title"))
    roots = roots.withColumn(
        "node_number", F.when(titles.is_unit_number(raw, F.col("label")), raw).otherwise(F.col("ordinal").cast("string"))
    ).withColumn("node_type", kind)
    root_rows = roots.select(
        "book_id", F.concat_ws("-", "book_id", "unit_no").alias("node_id"), F.lit(None).cast("string").alias("parent_id"),
        "node_type", titles.source_label(F.col("node_type"), F.col("node_number")).alias("source_label"), F.col("node_title").alias("title"),
        F.col("node_number").alias("number"), "ordinal", F.lit(0).cast("bigint").alias("depth"), "start_page", "end_page",
    )
    child = lessons.join(roots.select("book_id", "unit_no"), ["book_id", "unit_no"], "left_semi").withColumn(
        "node_title", titles.clean_heading(F.coalesce("title", F.lit("")))
    ).filter(titles.is_lesson_title(F.col("node_title")))
    child = numbered(child, ["book_id", "unit_no"], F.floor(F.col("lesson_no") / 1024), [F.col("lesson_no")], "ordinal")
    num = strip_space(F.coalesce("number", F.lit("")))
    in_title = F.lower("node_title").contains("exercise")
    is_exercise = in_title | F.lower(num).contains("exercise")
    label = (
        F.when(is_exercise, F.when(in_title, F.col("node_title")).otherwise(F.concat(F.lit("Exercise "), num)))
        .when(num != "", num).otherwise(F.concat(F.lit("Section "), F.col("ordinal").cast("string")))
    )
    child_rows = child.select(
        "book_id", F.concat_ws("-", "book_id", "unit_no", "lesson_no").alias("node_id"),
        F.concat_ws("-", "book_id", "unit_no").alias("parent_id"),
        F.when(is_exercise, "exercise").otherwise("lesson").alias("node_type"), label.alias("source_label"),
        F.col("node_title").alias("title"), num.alias("number"), "ordinal", F.lit(1).cast("bigint").alias("depth"),
        "start_page", "end_page",
    )
    return root_rows.union(child_rows)
