"""Tables of contents: outlines, printed page labels, assembly, candidate trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import titles
from folio.functions.classify import solid_lines
from folio.functions.text import WORD_END, WORD_START, clean_heading
from folio.operators.ordered import first_per, numbered, page_cover, scan
from folio.operators.tree import quality_gate, remap_scopes
from folio.runtime import cut

# Outline titles that name print sheets, and titles that are exercises.
PRINT_SHEET = "(?i)" + WORD_START + "(forma|cover|inner|plate|blank)" + WORD_END
PRACTICE = "(?i)" + WORD_START + "(exercise|practice)" + WORD_END


def outline_items(outline: DataFrame, page_counts: DataFrame) -> DataFrame:
    """A5: outline entries with a title and a page inside the book, typed."""
    title = clean_heading(F.col("title"))
    kind = F.when(title.rlike(PRACTICE), "exercise").when(F.col("level") == 1, "unit").otherwise("lesson")
    inside = F.col("target_page").between(1, F.col("page_count"))
    return outline.join(page_counts, "book_id").withColumn("label", title).withColumn("kind", kind).filter(
        inside & (F.col("label") != "")
    ).select("book_id", "seq", "level", "label", "kind", "target_page")


def usable_outlines(outline: DataFrame, items: DataFrame) -> DataFrame:
    """Books whose outline has two entries, few print sheets, and a top-level item that survives."""
    sheets = F.avg(F.col("title").rlike(PRINT_SHEET).cast("double"))
    shape = outline.groupBy("book_id").agg(F.count("*").alias("n"), sheets.alias("share"))
    tops = items.filter("level = 1").select("book_id").distinct()
    return shape.filter("n >= 2 and share <= 0.4").join(tops, "book_id", "left_semi").select("book_id")


def outline_tree(items: DataFrame) -> DataFrame:
    """Parent of every outline entry; entries without a parent one level up are dropped.

    A new top-level entry also ends the reach of the second-level entry before
    it, so both fill forward from one pass.
    """
    placed = items.filter("level <= 3")
    second = F.when(F.col("level") == 1, F.struct(F.lit(None).cast("bigint").alias("s"))).when(
        F.col("level") == 2, F.struct(F.col("seq").alias("s"))
    )
    filled = scan(
        placed, ["book_id"], F.floor(F.col("seq") / 1600000), [F.col("seq")],
        fills={"top": F.when(F.col("level") == 1, F.col("seq")), "mid": second},
    )
    parent = F.when(F.col("level") == 2, F.col("top")).when((F.col("level") == 3) & F.col("top").isNotNull(), F.col("mid.s"))
    return filled.withColumn("parent_seq", parent).filter((F.col("level") == 1) | F.col("parent_seq").isNotNull()).drop("top", "mid")


def printed_candidates(nodes: DataFrame, page_counts: DataFrame) -> DataFrame:
    """The page number printed in the first three lines of the first two blocks of a page."""
    over = Window.partitionBy("book_id", "page_no").orderBy("node_no")
    head = nodes.withColumn("__n", F.row_number().over(over)).filter("__n <= 2").join(page_counts, "book_id")
    top = F.slice(solid_lines(F.col("content_text")), 1, 3)
    found = F.filter(F.transform(top, lambda x: titles.printed_page(x, F.col("page_count"))), lambda v: v.isNotNull())
    seen = head.select("book_id", "page_no", "__n", F.try_element_at(found, F.lit(1)).alias("value")).filter("value is not null")
    return seen.groupBy("book_id", "page_no").agg(F.min_by("value", "__n").cast("bigint").alias("value"))


def confirmed_labels(candidates: DataFrame) -> DataFrame:
    """Candidates that a page up to three away agrees with.

    Each candidate asks for the six (page, value) pairs that would support it,
    an equi-join that spreads a long book evenly.
    """
    steps = F.array(*[F.lit(d).cast("bigint") for d in (-3, -2, -1, 1, 2, 3)])
    asks = candidates.select("book_id", "page_no", "value", F.explode(steps).alias("d")).select(
        "book_id", F.col("page_no").alias("p"), F.col("value").alias("v"),
        (F.col("page_no") + F.col("d")).alias("page_no"), (F.col("value") + F.col("d")).alias("value"),
    )
    held = asks.join(candidates, ["book_id", "page_no", "value"], "left_semi")
    return held.select("book_id", F.col("p").alias("page_no"), F.col("v").alias("value")).distinct()


def fill_labels(confirmed: DataFrame, page_counts: DataFrame, passes: int = 4) -> DataFrame:
    """Labels of pages between numbered ones, in closed form.

    The distance label - page of a known page is its offset. Two neighbouring pages
    with equal offset make a pair.

    Forward: after a pair, the gap takes its offset up to the next known page (that
    page's own neighbour is left to it if it begins a pair), to the last page, and while labels do not
    exceed the page count. A known page that stands alone with the offset carries it on into the next gap.
    Backward: before a pair, the `passes` nearest unknown pages take its offset, down to label 1; lone
    pages of equal offset are stepped over. Forward labels come first.

    Known pages are rows of ordered scans, so a long book is spread like any other rows.
    """
    near = scan(
        confirmed.select("book_id", "page_no", "value", (F.col("value") - F.col("page_no")).alias("offset")),
        ["book_id"], F.floor(F.col("page_no") / 1024), [F.col("page_no")],
        lags={"before": F.struct("page_no", "offset")}, leads={"after": F.struct("page_no", "offset")},
    )
    page, offset = F.col("page_no"), F.col("offset")
    touches_before = F.coalesce(F.col("before.page_no") == page - 1, F.lit(False))
    touches_after = F.coalesce(F.col("after.page_no") == page + 1, F.lit(False))
    alone = ~touches_before & ~touches_after
    like_before = F.coalesce(F.col("before.offset") == offset, F.lit(False))
    like_after = F.coalesce(F.col("after.offset") == offset, F.lit(False))
    marked = near.withColumn("ends_pair", touches_before & like_before).withColumn("begins_pair", touches_after & like_after)
    forward = scan(
        marked.withColumn("alone", alone).withColumn("like_after", like_after),
        ["book_id"], F.floor(page / 1024), [page],
        fills={"carries": F.when(~(alone & like_before), F.col("ends_pair"))}, sums={"place": F.lit(1).cast("bigint")},
        leads={"next_begins": F.col("begins_pair")},
    )
    anchor = F.when(~(F.col("alone") & F.col("like_after")), F.struct("page_no", "place", "begins_pair"))
    known = scan(forward, ["book_id"], -F.floor(page / 1024), [-page], fills={"anchor": anchor}).join(page_counts, "book_id")
    # Unknown pages between this one and the pair on its right that reaches it.
    spent = (F.col("anchor.page_no") - page) - (F.col("anchor.place") - F.col("place"))
    steps = F.when(F.col("anchor.begins_pair"), F.greatest(passes - spent, F.lit(0))).otherwise(F.lit(0))
    last_gap = F.coalesce(F.col("after.page_no") - 1 - F.coalesce("next_begins", F.lit(False)).cast("bigint"), F.col("page_count"))
    ahead = known.filter("carries").select(
        "book_id", "offset", (page + 1).alias("lo"), F.least(last_gap, F.col("page_count"), F.col("page_count") - offset).alias("hi")
    )
    # What a forward run leaves of a gap is open to the page on its right.
    with_left = scan(
        known.select("book_id", "page_no", "offset", "carries", "before", "page_count", "begins_pair", steps.alias("steps")),
        ["book_id"], F.floor(page / 1024), [page], lags={"left_carries": F.col("carries")},
    )
    run_end = F.when(F.col("left_carries"), F.least(page - 1 - F.col("begins_pair").cast("bigint"), F.col("page_count") - F.col("before.offset")))
    floor = F.greatest(F.coalesce(F.col("before.page_no"), F.lit(0)), F.coalesce(run_end, F.lit(0)))
    behind = with_left.filter("steps > 0").select(
        "book_id", "offset", F.greatest(floor + 1, page - F.col("steps"), 1 - offset).alias("lo"), (page - 1).alias("hi")
    )
    filled = page_cover(ahead.unionByName(behind), "lo", "hi").select("book_id", "page_no", (page + offset).alias("value"))
    return confirmed.join(page_counts.select("book_id"), "book_id").select("book_id", "page_no", "value").unionByName(filled).select(
        "book_id", "page_no", F.col("value").cast("string").alias("label")
    )


def adopted_lessons(units: DataFrame, lessons: DataFrame) -> DataFrame:
    """Lessons of rejected units that belong to unit n because their number starts with 'n.'."""
    valid = units.select("book_id", "unit_no")
    orphans = lessons.join(valid, ["book_id", "unit_no"], "left_anti").withColumn("stem", F.split_part("number", F.lit("."), F.lit(1)))
    dotted = orphans.filter(F.col("number").contains("."))
    homes = units.filter("number is not null and number <> ''").select("book_id", F.col("unit_no").alias("home_unit"), F.col("number").alias("stem"))
    return dotted.join(homes, ["book_id", "stem"]).drop("stem")


def valid_units(units: DataFrame) -> DataFrame:
    return units.filter(titles.is_unit_number(F.col("number"), F.col("label")) & titles.is_unit_title(F.col("title")))


def contents_lessons(units: DataFrame, lessons: DataFrame) -> DataFrame:
    """Own and adopted lessons with valid titles, under the unit (`home_unit`) that lists them."""
    own = lessons.join(units.select("book_id", "unit_no"), ["book_id", "unit_no"], "left_semi").withColumn("home_unit", F.col("unit_no"))
    both = own.unionByName(adopted_lessons(units, lessons))
    return both.filter(titles.is_lesson_title(F.col("title")))


def exercises(nodes: DataFrame, units: DataFrame, listed: DataFrame) -> DataFrame:
    """Exercise headings under lessons and directly under units, each label once per page and parent."""
    numbers = units.select("book_id", F.col("unit_no").alias("home_unit"), F.col("number").alias("chapter"))
    parents = listed.select("book_id", "home_unit", "unit_no", "lesson_no").join(numbers, ["book_id", "home_unit"])
    inside = nodes.filter("lesson_no is not null").join(parents, ["book_id", "unit_no", "lesson_no"])
    direct = nodes.filter("lesson_no is null").withColumn("home_unit", F.col("unit_no")).join(numbers, ["book_id", "home_unit"])
    both = inside.select("book_id", "home_unit", "unit_no", "lesson_no", "page_no", "node_no", "content_text", "title", "chapter").union(
        direct.select("book_id", "home_unit", "unit_no", "lesson_no", "page_no", "node_no", "content_text", "title", "chapter")
    )
    named = both.withColumn("label", titles.exercise_label(F.col("content_text"), F.col("title"), F.col("chapter"))).filter("label is not null")
    return first_labels(named.withColumn("parent", F.concat_ws("-", "home_unit", "unit_no", F.coalesce(F.col("lesson_no").cast("string"), F.lit("unit")))))


def first_labels(named: DataFrame) -> DataFrame:
    """The first of equal labels on a page within a parent, by a combined minimum."""
    keyed = named.withColumn("label_key", F.lower("label"))
    return first_per(
        keyed, ["book_id", "parent", "page_no", "label_key"], [F.col("node_no")],
        ["label", "node_no", "home_unit", "unit_no", "lesson_no"],
    ).drop("label_key")


def listed_contents(units: DataFrame, lessons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units and lessons that the contents list, each written once: what reads them scans them more than once."""
    good = cut(valid_units(units), "listed-units")
    return good, cut(contents_lessons(good, lessons), "listed-lessons")


def unit_and_lesson_rows(good: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows of units and lessons with labels (H18), flat."""
    none = F.lit(None).cast("bigint")
    return (
        good.select("book_id", F.col("unit_no").alias("home_unit"), none.alias("unit_no"), none.alias("lesson_no"), F.lit("unit").alias("kind"),
                    titles.contents_label(F.col("number"), F.col("label"), F.col("title")).alias("label"),
                    F.col("start_page").alias("page_no"), none.alias("node_no"))
        .union(listed.select("book_id", "home_unit", "unit_no", "lesson_no", F.lit("lesson"),
                             titles.lesson_label(F.col("number"), F.col("title")), "start_page", none))
    )


def parsed_contents(units: DataFrame, lessons: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """I7 without an outline: units, lessons and exercises with labels (H18) and printed pages (C5), flat."""
    good, listed = listed_contents(units, lessons)
    found = exercises(nodes, good, listed)
    rows = unit_and_lesson_rows(good, listed).union(
        found.select("book_id", "home_unit", "unit_no", "lesson_no", F.lit("exercise"), "label", "page_no", "node_no")
    )
    printed = labels.select("book_id", "page_no", F.col("label").alias("printed_page"))
    return cut(rows.join(printed, ["book_id", "page_no"], "left"), "parsed")


def contents_order(toc: DataFrame) -> DataFrame:
    """place of every child under its parent and of every unit in its book: by page, then as listed."""
    parent = F.when(F.col("kind") == "unit", F.lit("root")).when(
        (F.col("kind") == "exercise") & F.col("lesson_no").isNotNull(), F.concat_ws("-", "home_unit", "unit_no", "lesson_no")
    ).otherwise(F.concat_ws("-", "home_unit"))
    last = F.lit(1 << 60)
    order = [
        F.col("page_no"), (F.col("kind") == "exercise").cast("int"),
        F.when(F.col("kind") == "unit", F.col("home_unit")).otherwise(F.coalesce("lesson_no", last)), F.coalesce("unit_no", last),
        F.coalesce("node_no", last),
    ]
    return numbered(toc.withColumn("parent", parent), ["book_id", "parent"], F.floor(F.col("page_no") / 256), order, "position")


def contents(parsed: DataFrame, outline: DataFrame, usable: DataFrame, labels: DataFrame) -> DataFrame:
    """The outline where it is usable, else the parsed contents."""
    tree = outline.join(usable, "book_id", "left_semi").join(
        labels.select("book_id", F.col("page_no").alias("target_page"), F.col("label").alias("printed_page")), ["book_id", "target_page"], "left"
    )
    cols = ["book_id", "source", "kind", "label", "page_no", "printed_page"]
    a = tree.select("book_id", F.lit("EMBEDDED_PDF").alias("source"), "kind", "label", F.col("target_page").alias("page_no"), "printed_page")
    b = parsed.join(usable, "book_id", "left_anti").withColumn("source", F.lit("PARSED_CURRICULUM")).select(*cols)
    return a.union(b)


def candidate_tree(units: DataFrame, lessons: DataFrame) -> DataFrame:
    """I8: units and lessons of the contents as tree nodes, each on the page its entry names; content nodes play no part.

    `ordinal` counts the children of a parent (the units of a version) as listed, `place` all nodes of a version, each before its children.
    """
    listed = cut(contents_order(cut(unit_and_lesson_rows(*listed_contents(units, lessons)), "parsed")), "ordered")
    roots = listed.filter("kind = 'unit'").select("book_id", "home_unit", F.col("position").alias("root"))
    is_unit = F.col("kind") == "unit"
    placed = numbered(
        listed.join(roots, ["book_id", "home_unit"], "left").withColumn("depth", F.when(is_unit, F.lit(0)).otherwise(F.lit(1)).cast("bigint")),
        ["book_id"], F.floor(F.coalesce("root", F.lit(0)) / 64), [F.coalesce("root", F.lit(0)), F.col("depth"), F.col("position")], "place",
    )
    unit_id = F.concat_ws("-", "book_id", "home_unit")
    return placed.select(
        F.col("book_id").alias("version_id"),
        F.when(is_unit, unit_id).otherwise(F.concat_ws("-", "book_id", "home_unit", "unit_no", "lesson_no")).alias("node_id"),
        F.when(~is_unit, unit_id).alias("parent_id"),
        F.when(is_unit, "unit").when(F.lower("label").contains("exercise"), "exercise").otherwise("lesson").alias("node_type"),
        F.col("label").alias("title"), F.col("position").alias("ordinal"), F.col("page_no").alias("start_page"), F.col("page_no").alias("end_page"),
        "depth", "place",
    )


def refresh_structure(old: DataFrame, candidates: DataFrame, page_counts: DataFrame) -> DataFrame:
    """A version's tree is replaced only when its candidate passes the gate."""
    passed = quality_gate(candidates, page_counts).filter("status = 'VALID'").select("version_id")
    kept = old.join(passed, "version_id", "left_anti").withColumn("origin", F.lit("kept"))
    fresh = candidates.join(passed, "version_id", "left_semi").withColumn("origin", F.lit("refreshed"))
    cols = ["version_id", "node_id", "parent_id", "title", "start_page", "depth", "origin"]
    return kept.select(*cols).union(fresh.select(*cols))


def remap_references(references: DataFrame, old: DataFrame, candidates: DataFrame, page_counts: DataFrame) -> DataFrame:
    """J4 with C14: rows that name a node of a replaced tree name a node of the new one.

    `references` have version_id, node_id and any other columns. Where the candidate passes the gate, a known old node becomes the first
    new node with its title, else on its start page, else the first of the version; all other rows stay as they are. `moved` says
    which. Nodes are mapped once each, then looked up, so a node that many rows name is one row of the map.
    """
    passed = quality_gate(candidates, page_counts).filter("status = 'VALID'").select("version_id")
    fresh = candidates.select("version_id", "node_id", "title", "start_page", F.col("place").alias("ordinal"))
    plan = remap_scopes(old.join(passed, "version_id", "left_semi"), fresh)
    met = references.join(plan, ["version_id", "node_id"], "left")
    moved = F.col("new_node_id").isNotNull()
    rest = [c for c in references.columns if c not in ("version_id", "node_id")]
    return met.select("version_id", F.coalesce("new_node_id", "node_id").alias("node_id"), *rest, moved.alias("moved"))
