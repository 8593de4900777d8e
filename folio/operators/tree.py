"""Curriculum trees kept as adjacency lists: closure, pruning, coverage, quality, placement of content."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators.ordered import first_per, numbered, page_cover, scan
from folio.runtime import cut


def closure(nodes: DataFrame, levels: int | None = None) -> DataFrame:
    """All (ancestor, descendant, distance) pairs, each with its shortest distance.

    One join per level against the edges of inner nodes only: a node without children is never
    anybody's ancestor, so the build side stays a small share of the tree. Without `levels`, steps
    go on until one adds no new pair, whatever depth is stored; each is a written
    table, and pairs met before are dropped, so a cycle ends as well.
    """
    edges = nodes.filter(F.col("parent_id").isNotNull()).select("node_id", "parent_id")
    inner = edges.join(edges.select(F.col("parent_id").alias("node_id")).distinct(), "node_id", "left_semi")
    step = edges.select(
        F.col("node_id").alias("descendant_id"), F.col("parent_id").alias("ancestor_id"),
        F.lit(1).cast("bigint").alias("distance"),
    )

    def up(reached: DataFrame) -> DataFrame:
        return reached.join(inner, F.col("ancestor_id") == F.col("node_id")).select(
            "descendant_id", F.col("parent_id").alias("ancestor_id"), (F.col("distance") + 1).alias("distance")
        )

    pairs = step
    if levels is not None:
        for _ in range(levels - 1):
            step = up(step)
            pairs = pairs.union(step)
        return pairs
    while True:
        fresh = up(step).filter("ancestor_id <> descendant_id").join(pairs, ["descendant_id", "ancestor_id"], "left_anti")
        step = cut(fresh, "closure")
        if step.isEmpty():
            return pairs
        pairs = pairs.union(step.select(*pairs.columns))


def scope_paths(nodes: DataFrame, levels: int | None = None) -> DataFrame:
    """The path of every node from its root; a node whose parent is unknown is a root."""
    known = nodes.select(F.col("node_id").alias("parent_id"), F.lit(True).alias("known"))
    placed = nodes.join(known, "parent_id", "left").select("node_id", "parent_id", "known")
    step = placed.filter("known is null").select("node_id", F.col("node_id").alias("path"), F.lit(0).cast("bigint").alias("level"))
    edges = placed.filter("known").select(F.col("node_id").alias("child"), "parent_id")
    out, depth = step, 0
    while levels is None or depth < levels:
        step = edges.join(step, F.col("parent_id") == F.col("node_id")).select(
            F.col("child").alias("node_id"), F.concat("path", F.lit("/"), "child").alias("path"),
            (F.col("level") + 1).alias("level"),
        )
        if levels is None:
            # Without a stated depth, steps go on until no child is left.
            step = cut(step, "paths")
            if step.isEmpty():
                break
        out, depth = out.union(step), depth + 1
    children = placed.filter("known").groupBy("parent_id").agg(F.count("*").alias("n_children"))
    return out.join(children.withColumnRenamed("parent_id", "node_id"), "node_id", "left").select(
        "node_id", "path", "level", F.coalesce("n_children", F.lit(0)).alias("n_children")
    )


def ordered_paths(nodes: DataFrame) -> DataFrame:
    """Each node's path from its root, as an array of (depth, ordinal, node_id) that sorts in tree order, a node before its children.

    By doubling: after k rounds a node holds the last 2^k places of its path and its ancestor just above them, so a tree is as
    many rounds as its depth has binary digits. A node whose parent is unknown is a root; `node_id` is unique; a cycle of parents is
    an error. Paths are as long as the tree is deep.
    """
    known = nodes.select(F.col("node_id").alias("parent_id"), F.lit(True).alias("known"))
    place = F.array(F.struct("depth", "ordinal", "node_id"))
    state = cut(nodes.join(known, "parent_id", "left").select(
        "node_id", F.when(F.col("known"), F.col("parent_id")).alias("jump"), place.alias("path")
    ), "paths")
    rounds, most = 0, None
    while not state.filter("jump is not null").isEmpty():
        most = state.count().bit_length() if most is None else most
        if rounds > most:
            raise ValueError(f"the parents of {state.filter('jump is not null').first().node_id} form a cycle")
        above = state.select(F.col("node_id").alias("jump"), F.col("jump").alias("next"), F.col("path").alias("start"))
        longer = F.when(F.col("start").isNull(), F.col("path")).otherwise(F.concat("start", "path"))
        state, rounds = cut(state.join(above, "jump", "left").select("node_id", F.col("next").alias("jump"), longer.alias("path")), "paths"), rounds + 1
    return state.select("node_id", "path")


def nested_trees(nodes: DataFrame, fields: list[str]) -> DataFrame:
    """Each root with all that is below it as nested JSON, children in order of (depth, ordinal, node_id).

    A row a root: version_id, root_no (1, 2, ... in the version), n_nodes, tree. In tree order every node writes its fields and
    opens its list of children, and closes as many nodes as the next one does not lie in; so a tree is one sorted aggregate of any
    depth, not a join a level. A version is its rows in order of root_no, so a row holds one root's tree and no whole version.
    """
    head = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    # The object stays open: its last field is the list of children.
    opened = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"children":['))
    pieces = nodes.withColumn("opened", opened).join(ordered_paths(nodes), "node_id").select("version_id", "path", "opened")
    grouped = pieces.groupBy(F.col("path")[0].alias("root")).agg(
        F.first("version_id").alias("version_id"), F.count("*").alias("n_nodes"), F.array_sort(F.collect_list(F.struct("path", "opened"))).alias("p")
    )
    levels = grouped.select("root", "version_id", "n_nodes", "p", F.transform("p", lambda x: F.size(x["path"])).alias("level"))

    def written(piece: Column, i: Column) -> Column:
        level, following = F.get("level", i), F.coalesce(F.get("level", i + 1), F.lit(0))
        closed = F.repeat(F.lit("]}"), F.greatest(F.lit(0), level - F.greatest(following, F.lit(1)) + 1))
        return F.concat(piece["opened"], closed, F.when((following > 0) & (following <= level), F.lit(",")).otherwise(F.lit("")))

    trees = levels.withColumn("tree", F.array_join(F.transform("p", written), ""))
    order = [F.col("root.depth"), F.col("root.ordinal"), F.col("root.node_id")]
    return numbered(trees.select("version_id", "root", "n_nodes", "tree"), ["version_id"], F.col("root.depth"), order, "root_no").select(
        "version_id", "root_no", F.col("root.node_id").alias("node_id"), "n_nodes", "tree"
    )


def along_tree(nodes: DataFrame, below: Mapping[str, Column], above: Mapping[str, Column]) -> DataFrame:
    """`nodes` with sums over the descendants of each node (`below`) and maxima over its ancestors (`above`), itself excluded.

    By doubling: after k rounds each node knows its ancestor 2^k levels up, the maxima of the ancestors so far, and the sums of
    the descendants so far; the next round takes all three from the nodes one such step away. A tree is as many rounds as its
    depth has binary digits, each over one row a node, and no pair of nodes is stored. Sums are combined
    before they move, so a parent of any number of children is no burden. A node whose parent is unknown is a root; `node_id` is
    unique. Sums are zero and maxima null where there is nothing. A cycle of parents is an error.
    """
    sums, tops = list(below), list(above)
    own = nodes.select("node_id", "parent_id", *[v.alias(f"own_{n}") for n, v in below.items()], *[v.alias(f"own_{n}") for n, v in above.items()])

    def step(rows: DataFrame, jump: str, down: list[Column], up: list[Column]) -> DataFrame:
        """Rows beside what the nodes one step below add and what the node one step above is."""
        over = rows.select(F.col("node_id").alias(jump), F.lit(True).alias("known"), *up)
        placed = rows.join(over, jump, "left")
        if not down:
            return placed
        met = rows.filter(F.col(jump).isNotNull()).groupBy(F.col(jump).alias("node_id")).agg(*down)
        return placed.join(met, "node_id", "left")

    start = step(
        own, "parent_id", [F.sum(f"own_{n}").alias(n) for n in sums],
        [F.col("parent_id").alias("next"), *[F.col(f"own_{n}").alias(n) for n in tops]],
    )
    jump = F.when(F.col("known"), F.col("parent_id")).alias("jump")
    state = cut(start.select("node_id", jump, *[F.coalesce(n, F.lit(0)).alias(n) for n in sums], *tops), "along")
    reach, size = 1, None
    while not state.filter("jump is not null").isEmpty():
        size = state.count() if size is None else size
        if reach >= size:
            raise ValueError(f"the parents of {state.filter('jump is not null').first().node_id} form a cycle")
        moved = step(
            state, "jump", [F.sum(n).alias(f"more_{n}") for n in sums],
            [F.col("jump").alias("next"), *[F.col(n).alias(f"more_{n}") for n in tops]],
        )
        added = [(F.col(n) + F.coalesce(f"more_{n}", F.lit(0))).alias(n) for n in sums]
        highest = [F.greatest(n, f"more_{n}").alias(n) for n in tops]
        state, reach = cut(moved.select("node_id", F.col("next").alias("jump"), *added, *highest), "along"), reach * 2
    return nodes.join(state.select("node_id", *sums, *tops), "node_id")


def _marked(nodes: DataFrame, selected: DataFrame) -> DataFrame:
    """`nodes` with a column `hit`: 1 where the node is selected, 0 elsewhere."""
    chosen = selected.select("node_id", F.lit(1).cast("bigint").alias("hit")).distinct()
    return nodes.select("node_id", "parent_id").join(chosen, "node_id", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def prune_selection(selected: DataFrame, nodes: DataFrame) -> DataFrame:
    """Drop selected nodes that have a selected ancestor at any distance; identifiers that are no node stay."""
    placed = along_tree(_marked(nodes, selected), {}, {"over": F.col("hit")})
    return selected.join(placed.filter("over = 1").select("node_id"), "node_id", "left_anti")


def selection_state(nodes: DataFrame, selected: DataFrame) -> DataFrame:
    """I4: checked, indeterminate or unchecked, from the selected descendants of each node."""
    one = F.lit(1).cast("bigint")
    full = along_tree(_marked(nodes, selected), {"n_below": one, "n_hit": F.col("hit")}, {})
    state = (
        F.when((F.col("n_below") > 0) & (F.col("n_hit") == F.col("n_below")), "checked")
        .when(F.col("n_hit") > 0, "indeterminate")
        .when(F.col("hit") == 1, "checked")
        .otherwise("unchecked")
    )
    return full.select("node_id", "n_below", "n_hit", state.alias("state"))


def tree_order(nodes: DataFrame) -> DataFrame:
    """nodes of a version by depth, then ordinal."""
    bucket = F.struct("depth", F.floor(F.col("ordinal") / 4096).alias("part"))
    return numbered(nodes, ["version_id"], bucket, [F.col("depth"), F.col("ordinal")], "position")


def place_content(content: DataFrame, nodes: DataFrame, child_pages: int = 10, root_pages: int = 20) -> DataFrame:
    """The node a content row belongs to: first child section on its page, else first root.

    The first node of every covered page is settled before content is read, so
    the join is one row per page against content, not a range join.
    """
    open_end = F.when(F.col("depth") == 1, F.col("start_page") + child_pages).otherwise(
        F.col("start_page") + root_pages
    )
    spans = nodes.filter("depth <= 1").select(
        "version_id", "node_id", "depth", "ordinal", "start_page", F.coalesce("end_page", open_end).alias("last_page")
    )
    pages = page_cover(spans, "start_page", "last_page")
    owner = first_per(pages, ["version_id", "page_no"], [-F.col("depth"), F.col("ordinal"), F.col("node_id")], ["node_id"])
    return content.join(owner, ["version_id", "page_no"], "left")


def quality_gate(nodes: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Metrics, reasons and verdict per version; `nodes` may lack a version, which is then empty."""
    title = F.trim(F.coalesce("title", F.lit("")))
    root = F.col("parent_id").isNull()
    has_title = F.col("title").isNotNull() & (F.col("title") != "")
    root_title = F.when(root & has_title, F.regexp_replace(F.lower(title), r"\s+", " "))
    suffix = title.rlike(r"(^|[^\p{L}\p{N}_])[A-Za-z\s]+\s+\d{1,4}$")
    stats = nodes.groupBy("version_id").agg(
        F.count("*").alias("n_nodes"),
        F.count_if(root).alias("n_roots"),
        F.count(root_title).alias("n_root_titles"),
        F.count_distinct(root_title).alias("n_distinct"),
        F.count_if(suffix).alias("n_suffix"),
        F.count_if(F.col("start_page") > F.col("end_page")).alias("n_bad_ranges"),
        F.count_if(title == "").alias("n_empty_titles"),
    )
    n = F.col("n_nodes")
    pages = F.greatest("page_count", F.lit(1)).cast("double")
    dup = F.when(F.col("n_root_titles") > 0, 1.0 - F.col("n_distinct").cast("double") / F.col("n_root_titles")).otherwise(0.0)
    density = F.col("n_roots").cast("double") / pages
    share = F.col("n_suffix").cast("double") / n
    reasons = F.array_compact(F.array(
        F.when(n.isNull(), "EMPTY_CURRICULUM_TREE"),
        F.when(dup > 0.25, "EXCESSIVE_DUPLICATE_TITLES"),
        F.when((density > 0.40) & (F.col("n_roots") > 15), "ABNORMAL_ROOT_DENSITY"),
        F.when(share > 0.30, "PAGE_NUMBER_TITLE_FRAGMENTS"),
        F.when(F.col("n_bad_ranges") > 0, "INVALID_PAGE_RANGES"),
        F.when(F.col("n_empty_titles") > 0, "EMPTY_NODE_TITLES"),
    ))
    return (
        page_counts.join(stats, "version_id", "left")
        .withColumn("reasons", reasons)
        .select(
            "version_id", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"),
            F.round(dup.cast("decimal(18,9)"), 3).cast("double").alias("duplicate_title_ratio"),
            F.round(density.cast("decimal(18,9)"), 3).cast("double").alias("root_density"),
            F.round(share.cast("decimal(18,9)"), 3).cast("double").alias("page_suffix_ratio"),
            "reasons", F.when(F.size("reasons") == 0, "VALID").otherwise("NEEDS_REFRESH").alias("status"),
        )
    )


def remap_scopes(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """C14: for each old node the first new node with the same title, else the same start page, else the first.

    Each lookup is reduced to one row per key before it is joined.
    """
    key = F.lower(F.trim("title"))
    new = fresh.select("version_id", F.col("node_id").alias("new_id"), key.alias("title_key"), "start_page", "ordinal")
    order = [F.col("ordinal"), F.col("new_id")]
    by_title = first_per(new, ["version_id", "title_key"], order, ["new_id"]).withColumnRenamed("new_id", "t_id")
    by_page = first_per(new, ["version_id", "start_page"], order, ["new_id"]).withColumnRenamed("new_id", "p_id")
    any_node = first_per(new, ["version_id"], order, ["new_id"]).withColumnRenamed("new_id", "a_id")
    return (
        old.withColumn("title_key", key)
        .join(by_title, ["version_id", "title_key"], "left")
        .join(by_page, ["version_id", "start_page"], "left")
        .join(any_node, "version_id", "left")
        .select("version_id", "node_id", F.coalesce("t_id", "p_id", "a_id").alias("new_node_id"))
    )


def next_start(df: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Start page of the next sibling by (start, ordinal)."""
    order = order or [F.col("start_page"), F.col("ordinal")]
    return scan(
        df, keys, F.floor(F.col("start_page") / 1024), order, leads={"next_start": F.col("start_page")}
    )


def closing_end(start: Column, following: Column, last_page: Column) -> Column:
    """The page a section ends on when the next heading closes it; an open section runs to the last page."""
    closed = F.greatest(start, F.when(following > start, following - 1).otherwise(following))
    return F.when(following.isNotNull(), closed).otherwise(last_page)


def _before(start: Column, following: Column) -> Column:
    """Page before the next start, not before the own start; null when nothing follows."""
    return F.when(following.isNotNull(), F.greatest(start, following - 1))


def resolve_ends(units: DataFrame, lessons: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Page range of every unit and lesson when stored end pages may be missing.

    Own end if sane; for lessons the next lesson's start - 1, then the unit's
    end; then the next unit's start - 1; then the page count; clamped to it.
    """
    u = next_start(units, ["version_id"]).join(page_counts, "version_id")
    own = F.when(F.col("end_page") >= F.col("start_page"), F.col("end_page"))
    after = _before(F.col("start_page"), F.col("next_start"))
    u = u.withColumn("own_end", own).withColumn("raw_end", F.coalesce(own, after, F.col("page_count")))

    def clamp(df: DataFrame) -> DataFrame:
        start = F.greatest(F.lit(1).cast("bigint"), F.least("start_page", "page_count"))
        return df.withColumn("first_page", start).withColumn(
            "last_page", F.greatest("first_page", F.least("raw_end", "page_count"))
        )

    unit_rows = clamp(u).select("version_id", F.lit("unit").alias("kind"), F.col("unit_id").alias("scope_id"), "first_page", "last_page")
    parents = u.select(
        "unit_id", F.col("end_page").alias("unit_end"), F.col("next_start").alias("unit_next"), "page_count"
    )
    les = next_start(lessons, ["unit_id"]).join(parents, "unit_id")
    unit_after = _before(F.col("start_page"), F.col("unit_next"))
    unit_end = F.when(F.col("unit_end") >= F.col("start_page"), F.col("unit_end"))
    les = les.withColumn("raw_end", F.coalesce(own, after, unit_end, unit_after, F.col("page_count")))
    lesson_rows = clamp(les).select(
        "version_id", F.lit("lesson").alias("kind"), F.col("lesson_id").alias("scope_id"), "first_page", "last_page"
    )
    return unit_rows.union(lesson_rows)
