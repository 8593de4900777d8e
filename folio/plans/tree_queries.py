"""Queries over trees and coverage: I1-I4, C2, C3, C14, C20, D4, D14, E6, E9-E12, B19, F5, H19, H26."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import coverage, tree
from folio.operators.ordered import numbered
from folio.plans import duck
from folio.plans.registry import query
from folio.plans.text_queries import MARKS, TOKENS_OF
from folio.runtime import cut, table
from folio.sources import views


@query("I3_closure", f"WITH {duck.CLOSURE} SELECT ancestor_id, descendant_id, distance FROM closure")
def i3(spark, sf):
    return tree.closure(cut(views.nodes(spark, sf), "nodes")).select("ancestor_id", "descendant_id", "distance")


@query("I1_scope_paths", f"""WITH RECURSIVE {duck.NODES},
nodes1 AS (SELECT node_id, CASE WHEN node_id LIKE 'n%' AND ordinal % 7 = 0 THEN 'missing' ELSE parent_id END AS parent_id FROM v_nodes),
p AS (SELECT node_id, node_id AS path, 0::BIGINT AS level FROM nodes1 a WHERE parent_id IS NULL OR NOT EXISTS (SELECT 1 FROM nodes1 b WHERE b.node_id = a.parent_id)
  UNION ALL SELECT n.node_id, concat(p.path, '/', n.node_id), p.level + 1 FROM p JOIN nodes1 n ON n.parent_id = p.node_id)
SELECT node_id, path, level, (SELECT count(*) FROM nodes1 c WHERE c.parent_id = p.node_id) AS n_children FROM p""")
def i1(spark, sf):
    broken = views.nodes(spark, sf).withColumn(
        "parent_id", F.expr("CASE WHEN node_id LIKE 'n%' AND ordinal % 7 = 0 THEN 'missing' ELSE parent_id END")
    )
    return tree.scope_paths(cut(broken, "nodes"))


NODE_JSON = "'id', node_id, 'node_type', node_type, 'title', title, 'depth', depth, 'start_page', start_page, 'end_page', end_page"


@query("I1_nested_tree", f"""WITH {duck.NODES},
nodes1 AS (SELECT * REPLACE (CASE WHEN node_id LIKE 'n%' AND ordinal % 7 = 0 THEN 'missing' ELSE parent_id END AS parent_id) FROM v_nodes),
j2 AS (SELECT parent_id, depth, ordinal, node_id, json_object({NODE_JSON}, 'children', '[]'::JSON) AS j FROM nodes1 WHERE depth = 2),
c2 AS (SELECT parent_id AS node_id, to_json(list(j ORDER BY ordinal)) AS children, count(*) AS n FROM j2 GROUP BY 1),
j1 AS (SELECT a.version_id, a.parent_id, a.depth, a.ordinal, a.node_id, coalesce(n, 0) + 1 AS n, json_object({NODE_JSON.replace(', node_id', ', a.node_id')}, 'children', coalesce(children, '[]'::JSON)) AS j FROM nodes1 a LEFT JOIN c2 ON c2.node_id = a.node_id WHERE depth = 1),
c1 AS (SELECT parent_id AS node_id, to_json(list(j ORDER BY ordinal)) AS children, sum(n) AS n FROM j1 GROUP BY 1),
j0 AS (SELECT a.version_id, a.depth, a.ordinal, a.node_id, coalesce(n, 0) + 1 AS n, json_object({NODE_JSON.replace(', node_id', ', a.node_id')}, 'children', coalesce(children, '[]'::JSON)) AS j FROM nodes1 a LEFT JOIN c1 ON c1.node_id = a.node_id WHERE depth = 0),
rt AS (SELECT version_id, depth, ordinal, node_id, n, j FROM j0 UNION ALL SELECT version_id, depth, ordinal, node_id, n, j FROM j1 WHERE parent_id = 'missing')
SELECT version_id, row_number() OVER (PARTITION BY version_id ORDER BY depth, ordinal, node_id) AS root_no, node_id, CAST(n AS BIGINT) AS n_nodes, CAST(j AS VARCHAR) AS tree FROM rt""")
def i1_nested(spark, sf):
    broken = views.nodes(spark, sf).withColumn(
        "parent_id", F.expr("CASE WHEN node_id LIKE 'n%' AND ordinal % 7 = 0 THEN 'missing' ELSE parent_id END")
    )
    named = cut(broken.withColumn("id", F.col("node_id")), "nodes")
    return tree.nested_trees(named, ["id", "node_type", "title", "depth", "start_page", "end_page"])


SELECTED = "(depth = 0 AND ordinal % 4 = 1) OR (depth = 1 AND ordinal % 3 = 0) OR (depth = 2 AND ordinal % 5 <> 0)"


@query("I2_prune_selection", f"""WITH {duck.CLOSURE}, sel AS (SELECT node_id FROM v_nodes WHERE {SELECTED})
SELECT node_id FROM sel s WHERE NOT EXISTS (SELECT 1 FROM closure c JOIN sel a ON a.node_id = c.ancestor_id WHERE c.descendant_id = s.node_id)""")
def i2(spark, sf):
    nodes = cut(views.nodes(spark, sf), "nodes")
    return tree.prune_selection(nodes.filter(SELECTED).select("node_id"), nodes)


SELECTED_4 = "(depth = 2 AND (ordinal % 3 = 0 OR version_id = 'v2')) OR (depth = 1 AND ordinal % 6 = 0)"


@query("I4_selection_state", f"""WITH {duck.CLOSURE}, sel AS (SELECT node_id FROM v_nodes WHERE {SELECTED_4}),
b AS (SELECT ancestor_id, count(*) AS n_below, count(s.node_id) AS n_hit FROM closure c LEFT JOIN sel s ON s.node_id = c.descendant_id GROUP BY 1)
SELECT n.node_id, coalesce(n_below, 0) AS n_below, coalesce(n_hit, 0) AS n_hit, CASE
  WHEN n_below IS NULL THEN CASE WHEN s.node_id IS NOT NULL THEN 'checked' ELSE 'unchecked' END
  WHEN n_hit = n_below THEN 'checked' WHEN n_hit > 0 THEN 'indeterminate' WHEN s.node_id IS NOT NULL THEN 'checked' ELSE 'unchecked' END AS state
FROM v_nodes n LEFT JOIN b ON b.ancestor_id = n.node_id LEFT JOIN sel s ON s.node_id = n.node_id""")
def i4(spark, sf):
    nodes = cut(views.nodes(spark, sf), "nodes")
    return tree.selection_state(nodes, nodes.filter(SELECTED_4).select("node_id"))


@query("F5_tree_order", f"""WITH {duck.NODES} SELECT version_id, node_id,
  row_number() OVER (PARTITION BY version_id ORDER BY depth, ordinal) AS position FROM v_nodes""")
def f5(spark, sf):
    return tree.tree_order(views.nodes(spark, sf)).select("version_id", "node_id", "position")


@query("C2_content_node", f"""WITH {duck.TREE}, m AS (SELECT content_id, node_id, row_number() OVER (PARTITION BY content_id ORDER BY n.depth DESC, n.ordinal) AS rn
  FROM v_content c JOIN v_nodes n ON n.version_id = c.version_id AND n.depth <= 1
   AND c.page_no BETWEEN n.start_page AND coalesce(n.end_page, n.start_page + CASE WHEN n.depth = 1 THEN 10 ELSE 20 END))
SELECT c.content_id, m.node_id FROM v_content c LEFT JOIN m ON m.content_id = c.content_id AND m.rn = 1""")
def c2(spark, sf):
    return tree.place_content(views.content(spark, sf), views.nodes(spark, sf)).select("content_id", "node_id")


PICKED = "(depth = 1 AND ordinal % 2 = 0) OR (depth = 2 AND ordinal % 10 < 2)"


@query("C3_scope_content", f"""WITH {duck.TREE} SELECT node_id, content_id FROM v_nodes n JOIN v_content c ON n.version_id = c.version_id
  AND c.page_no BETWEEN n.start_page AND coalesce(n.end_page, n.start_page + 15) WHERE {PICKED.replace('ordinal', 'n.ordinal')}""")
def c3(spark, sf):
    picked = views.nodes(spark, sf).filter(PICKED)
    return coverage.scope_content(picked, views.content(spark, sf)).select("node_id", "content_id")


@query("B19_scope_ownership", f"""WITH {duck.TREE}, sel AS (SELECT concat('v', c_custkey % 5) AS version_id, concat('c', c_custkey) AS node_id FROM customer
  UNION ALL SELECT concat('v', n_regionkey), concat('n', n_nationkey) FROM nation),
o AS (SELECT s.version_id, s.node_id, n.start_page, n.node_id AS own, coalesce(n.end_page, n.start_page + 15) AS last_page FROM sel s LEFT JOIN v_nodes n
   ON n.version_id = s.version_id AND n.node_id = s.node_id)
SELECT version_id, node_id, CASE WHEN own IS NULL THEN 'INVALID_CURRICULUM_SCOPE' WHEN NOT EXISTS (SELECT 1 FROM v_content c
  WHERE c.version_id = o.version_id AND c.page_no BETWEEN o.start_page AND o.last_page) THEN 'EMPTY_CURRICULUM_SCOPE' ELSE 'OK' END AS status FROM o""")
def b19(spark, sf):
    claims = table(spark, sf, "customer").selectExpr("concat('v', c_custkey % 5) AS version_id", "concat('c', c_custkey) AS node_id").union(
        table(spark, sf, "nation").selectExpr("concat('v', n_regionkey)", "concat('n', n_nationkey)")
    )
    return coverage.check_selection(claims, views.nodes(spark, sf), views.content(spark, sf))


GATE_NODES = """SELECT concat('n', n_nationkey) AS version_id, concat('c', c_custkey) AS node_id,
  CASE WHEN c_custkey % 3 = 0 THEN 'x' END AS parent_id,
  CASE WHEN n_nationkey % 4 = 0 AND c_custkey % 4 = 0 THEN 'Chapter One' WHEN c_custkey % 401 = 1 THEN ' '
       WHEN n_nationkey % 5 = 2 THEN concat('Page ', c_custkey) ELSE c_name END AS title,
  pg AS start_page, CASE WHEN c_custkey % 997 = 0 THEN pg - 1 ELSE pg END AS end_page FROM leaf"""
GATE_PAGES = """SELECT concat('n', n_nationkey) AS version_id, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 10 ELSE 100000 END AS BIGINT) AS page_count FROM nation
  UNION ALL SELECT 'empty', 5"""


@query("D4_quality_gate", f"""WITH {duck.LEAVES}, n AS ({GATE_NODES}), p AS ({GATE_PAGES}),
s AS (SELECT version_id, count(*) AS n_nodes, count_if(parent_id IS NULL) AS roots,
  count(CASE WHEN parent_id IS NULL AND title <> '' THEN 1 END) AS rt,
  count(DISTINCT CASE WHEN parent_id IS NULL AND title <> '' THEN regexp_replace(lower(trim(title)), '\\s+', ' ', 'g') END) AS rd,
  count_if(regexp_matches(trim(title), '(^|[^\\p{{L}}\\p{{N}}_])[A-Za-z\\s]+\\s+\\d{{1,4}}$')) AS sfx,
  count_if(start_page > end_page) AS bad, count_if(trim(title) = '') AS empty FROM n GROUP BY 1),
m AS (SELECT p.version_id, n_nodes, roots, bad, empty, CASE WHEN rt > 0 THEN 1 - rd::DOUBLE / rt ELSE 0 END AS dup, roots::DOUBLE / greatest(page_count, 1) AS dens,
  sfx::DOUBLE / n_nodes AS sh FROM p LEFT JOIN s ON s.version_id = p.version_id)
SELECT version_id, coalesce(n_nodes, 0) AS n_nodes, CAST(round(CAST(coalesce(dup, 0) AS DECIMAL(18,9)), 3) AS DOUBLE) AS duplicate_title_ratio,
 CAST(round(CAST(dens AS DECIMAL(18,9)), 3) AS DOUBLE) AS root_density, CAST(round(CAST(sh AS DECIMAL(18,9)), 3) AS DOUBLE) AS page_suffix_ratio,
 concat_ws(',', CASE WHEN n_nodes IS NULL THEN 'EMPTY_CURRICULUM_TREE' END, CASE WHEN dup > 0.25 THEN 'EXCESSIVE_DUPLICATE_TITLES' END,
  CASE WHEN dens > 0.4 AND roots > 15 THEN 'ABNORMAL_ROOT_DENSITY' END, CASE WHEN sh > 0.3 THEN 'PAGE_NUMBER_TITLE_FRAGMENTS' END,
  CASE WHEN bad > 0 THEN 'INVALID_PAGE_RANGES' END, CASE WHEN empty > 0 THEN 'EMPTY_NODE_TITLES' END) AS reasons,
 CASE WHEN n_nodes IS NULL OR dup > 0.25 OR (dens > 0.4 AND roots > 15) OR sh > 0.3 OR bad > 0 OR empty > 0 THEN 'NEEDS_REFRESH' ELSE 'VALID' END AS status FROM m""")
def d4(spark, sf):
    leaf = views.leaves(spark, sf)
    gate_nodes = leaf.selectExpr(
        "concat('n', n_nationkey) AS version_id", "concat('c', c_custkey) AS node_id",
        "CASE WHEN c_custkey % 3 = 0 THEN 'x' END AS parent_id",
        """CASE WHEN n_nationkey % 4 = 0 AND c_custkey % 4 = 0 THEN 'Chapter One' WHEN c_custkey % 401 = 1 THEN ' '
           WHEN n_nationkey % 5 = 2 THEN concat('Page ', c_custkey) ELSE c_name END AS title""",
        "pg AS start_page", "CASE WHEN c_custkey % 997 = 0 THEN pg - 1 ELSE pg END AS end_page",
    )
    counts = table(spark, sf, "nation").selectExpr(
        "concat('n', n_nationkey) AS version_id",
        "CAST(CASE WHEN n_nationkey % 2 = 0 THEN 10 ELSE 100000 END AS BIGINT) AS page_count",
    ).union(spark.range(1).selectExpr("'empty'", "5L"))
    return tree.quality_gate(gate_nodes, counts).withColumn("reasons", F.array_join("reasons", ","))


FRESH = """concat('k', c_custkey) AS node_id, CASE WHEN c_custkey % 2 = 0 THEN concat(' ', upper(c_name)) ELSE 'new' END AS title,
  CASE WHEN c_custkey % 3 = 0 THEN pg ELSE pg + 1000000000 END AS start_page, c_custkey AS ordinal"""


@query("C14_scope_remap", f"""WITH {duck.NODES}, f AS (SELECT concat('v', r_regionkey) AS version_id, {FRESH} FROM leaf),
m AS (SELECT o.version_id, o.node_id, f.node_id AS new_id, row_number() OVER (PARTITION BY o.node_id ORDER BY
   CASE WHEN lower(trim(f.title)) = lower(trim(o.title)) THEN 0 ELSE 1 END, f.ordinal) AS rn
   FROM v_nodes o JOIN f ON f.version_id = o.version_id AND (lower(trim(f.title)) = lower(trim(o.title)) OR f.start_page = o.start_page)),
a AS (SELECT version_id, arg_min(node_id, ordinal) AS first_id FROM f GROUP BY 1)
SELECT o.version_id, o.node_id, coalesce(m.new_id, a.first_id) AS new_node_id FROM v_nodes o LEFT JOIN m ON m.node_id = o.node_id AND m.rn = 1
LEFT JOIN a ON a.version_id = o.version_id""")
def c14(spark, sf):
    fresh = views.leaves(spark, sf).selectExpr("concat('v', r_regionkey) AS version_id", *[
        "concat('k', c_custkey) AS node_id",
        "CASE WHEN c_custkey % 2 = 0 THEN concat(' ', upper(c_name)) ELSE 'new' END AS title",
        "CASE WHEN c_custkey % 3 = 0 THEN pg ELSE pg + 1000000000 END AS start_page", "c_custkey AS ordinal",
    ])
    return tree.remap_scopes(views.nodes(spark, sf), fresh)


@query("E6_end_pages", f"""WITH {duck.LEAVES}, u AS (SELECT concat('v', r_regionkey) AS version_id, n_nationkey::BIGINT AS unit_id, n_nationkey AS ordinal, min(pg) AS s,
   CASE WHEN n_nationkey % 2 = 1 THEN NULL WHEN n_nationkey % 4 = 2 THEN 0 ELSE max(pg) END AS e FROM leaf GROUP BY n_nationkey, r_regionkey),
l AS (SELECT concat('v', r_regionkey) AS version_id, n_nationkey::BIGINT AS unit_id, c_custkey AS lesson_id, c_custkey AS ordinal, pg AS s,
   CASE WHEN c_custkey % 2 = 0 THEN pg + 1 END AS e FROM leaf WHERE c_custkey % 3 <> 0),
pc AS (SELECT concat('v', r_regionkey) AS version_id, max(pg) - 2 AS page_count FROM leaf GROUP BY 1),
u1 AS (SELECT *, CASE WHEN e >= s THEN e END AS own, lead(s) OVER (PARTITION BY version_id ORDER BY s, ordinal) AS nx FROM u JOIN pc USING (version_id)),
l1 AS (SELECT l.version_id, l.lesson_id, l.s, l.e, lead(l.s) OVER (PARTITION BY l.unit_id ORDER BY l.s, l.ordinal) AS lnx, CASE WHEN u1.e >= l.s THEN u1.e END AS own, u1.nx, u1.page_count FROM l JOIN u1 ON u1.unit_id = l.unit_id),
r AS (SELECT version_id, 'unit' AS kind, unit_id AS scope_id, s, coalesce(own, greatest(s, nx - 1), page_count) AS e, page_count FROM u1
  UNION ALL SELECT version_id, 'lesson', lesson_id, s, coalesce(CASE WHEN e >= s THEN e END, CASE WHEN lnx IS NOT NULL THEN greatest(s, lnx - 1) END, own,
   CASE WHEN nx IS NOT NULL THEN greatest(s, nx - 1) END, page_count), page_count FROM l1)
SELECT version_id, kind, scope_id, greatest(1, least(s, page_count)) AS first_page, greatest(greatest(1, least(s, page_count)), least(e, page_count)) AS last_page FROM
 (SELECT version_id, kind, scope_id, s, page_count, CASE WHEN kind = 'unit' THEN (SELECT coalesce(u1.own, CASE WHEN u1.nx IS NOT NULL THEN greatest(u1.s, u1.nx - 1) END, u1.page_count) FROM u1 WHERE u1.unit_id = r.scope_id) ELSE e END AS e FROM r)""")
def e6(spark, sf):
    leaf = views.leaves(spark, sf)
    units = leaf.groupBy("n_nationkey", "r_regionkey").agg(F.min("pg").alias("s"), F.max("pg").alias("e")).selectExpr(
        "concat('v', r_regionkey) AS version_id", "CAST(n_nationkey AS BIGINT) AS unit_id", "n_nationkey AS ordinal",
        "s AS start_page", "CASE WHEN n_nationkey % 2 = 1 THEN NULL WHEN n_nationkey % 4 = 2 THEN 0 ELSE e END AS end_page",
    )
    lessons = leaf.filter("c_custkey % 3 <> 0").selectExpr(
        "concat('v', r_regionkey) AS version_id", "CAST(n_nationkey AS BIGINT) AS unit_id", "c_custkey AS lesson_id",
        "c_custkey AS ordinal", "pg AS start_page", "CASE WHEN c_custkey % 2 = 0 THEN pg + 1 END AS end_page",
    )
    counts = leaf.groupBy(F.expr("concat('v', r_regionkey) AS version_id")).agg((F.max("pg") - 2).alias("page_count"))
    return tree.resolve_ends(units, lessons, counts)


PACKED = f"""{duck.LINES}, ranked AS (SELECT *, row_number() OVER w AS chunk_no, CAST(sum(length(text)) OVER w AS BIGINT) AS used_chars FROM v_lines
  WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
kept AS (SELECT * FROM ranked WHERE chunk_no <= 3 OR used_chars <= 2200)"""


@query("E9_char_budget_pack", f"WITH {PACKED} SELECT doc_id, line_no, chunk_no, used_chars FROM kept")
def e9(spark, sf):
    lines = views.lines(spark, sf)
    packed = coverage.pack(lines, ["doc_id"], [F.col("line_no")], "text", 2200, bucket=F.floor(F.col("page_no") / 8))
    return packed.select("doc_id", "line_no", "chunk_no", "used_chars")


@query("E10_window_split", f"""WITH {duck.TREE}, sel AS (SELECT * FROM v_nodes WHERE {PICKED}),
ins AS (SELECT s.node_id, c.content_id, c.page_no, c.ordinal, count(*) OVER (PARTITION BY s.node_id) AS n,
  row_number() OVER (PARTITION BY s.node_id ORDER BY c.page_no, c.ordinal) AS rn FROM sel s JOIN v_content c ON c.version_id = s.version_id
  AND c.page_no BETWEEN s.start_page AND coalesce(s.end_page, s.start_page + 15)),
sec AS (SELECT parent_id AS node_id, ordinal AS window_no, start_page, coalesce(end_page, start_page) AS last_page FROM v_nodes WHERE node_type IN ('section', 'lesson')),
w AS (SELECT i.node_id, sec.window_no, NULL::BIGINT AS part_no, content_id FROM ins i JOIN sec ON sec.node_id = i.node_id AND i.page_no BETWEEN sec.start_page AND sec.last_page WHERE n > 10
  UNION ALL SELECT node_id, (rn - 1) // 12, CASE WHEN n > 12 THEN (rn - 1) // 12 + 1 END, content_id FROM ins i
   WHERE NOT (n > 10 AND EXISTS (SELECT 1 FROM sec WHERE sec.node_id = i.node_id)))
SELECT node_id, window_no, part_no, count(*) AS n_content, min(content_id) AS first_id, max(content_id) AS last_id FROM w GROUP BY ALL""")
def e10(spark, sf):
    nodes = cut(views.nodes(spark, sf), "nodes")
    windows = coverage.split_windows(nodes.filter(PICKED), nodes, views.content(spark, sf))
    return windows.groupBy("node_id", "window_no", "part_no").agg(
        F.count("*").alias("n_content"), F.min("content_id").alias("first_id"), F.max("content_id").alias("last_id")
    )


WINDOWED = f"""{duck.LINES}, counted AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rn FROM v_lines),
ranked AS (SELECT *, (rn - 1) // 12 AS window_no, count(*) OVER w AS chunk_no, sum(length(text)) OVER w AS used FROM counted
  WINDOW w AS (PARTITION BY doc_id, (rn - 1) // 12 ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
kept AS (SELECT * FROM ranked WHERE chunk_no <= 3 OR used <= 2200),
blocks AS (SELECT *, concat('<SOURCE id="', printf('SRC-%03d', rn), '" page="', page_no, '">', chr(10), text, chr(10), '</SOURCE>') AS block FROM kept)"""
ESTIMATED = f"""{WINDOWED},
run AS (SELECT *, sum(length(block)) OVER w + 2 * (count(*) OVER w - 1) + 16 AS c, sum({MARKS.format('block')}) OVER w AS m, count(*) OVER w AS k FROM blocks
  WINDOW w AS (PARTITION BY doc_id, window_no ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
est AS (SELECT *, {TOKENS_OF.format(c='c', m='m')} + 700 + 510 AS prompt_tokens FROM run),
fit AS (SELECT * FROM est WHERE prompt_tokens <= {{target}} OR k = 1)"""


@query("E11_token_budget_trim", f"WITH {ESTIMATED.replace("{target}", "1500")} SELECT doc_id, window_no, line_no, prompt_tokens FROM fit")
def e11(spark, sf):
    chunks = coverage.document_windows(views.lines(spark, sf)).withColumn(
        "block", coverage.source_block(coverage.chunk_id(F.col("rn")), F.col("page_no"), F.col("text"))
    )
    fitted = coverage.trim_to_budget(
        chunks, ["doc_id", "window_no"], [F.col("line_no")], "block", "Questions from:\n", 700, 1500
    )
    return fitted.select("doc_id", "window_no", "line_no", "prompt_tokens")


@query("E12_coverage_plan", f"""WITH {ESTIMATED.replace("{target}", "2800")}, win AS (SELECT doc_id, window_no, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS chars, max(prompt_tokens) AS est_tokens
  FROM fit GROUP BY ALL), t AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS nw, doc_id % 12 + 1 AS req FROM win)
SELECT doc_id, window_no, n_chunks, chars, est_tokens, CAST(CASE WHEN req <= nw THEN CASE WHEN window_no + 1 <= req THEN 1 ELSE 0 END
  ELSE req // nw + CASE WHEN window_no + 1 <= req % nw THEN 1 ELSE 0 END END AS BIGINT) AS target_questions FROM t""")
def e12(spark, sf):
    return coverage.coverage_plan(views.lines(spark, sf), F.col("doc_id") % 12 + 1)


@query("D14_plan_totals", f"""WITH {ESTIMATED.replace("{target}", "2800")}, win AS (SELECT doc_id, window_no, count(*) AS n_chunks, max(prompt_tokens) AS est_tokens FROM fit GROUP BY ALL)
SELECT doc_id, count(*) AS n_windows, CAST(sum(n_chunks) AS BIGINT) AS total_chunks, CAST(sum(est_tokens) AS BIGINT) AS total_tokens FROM win GROUP BY 1""")
def d14(spark, sf):
    return coverage.plan_totals(coverage.coverage_plan(views.lines(spark, sf), F.lit(5)), "doc_id")


@query("H19_source_block", f"""WITH {WINDOWED}, b AS (SELECT doc_id, window_no, rn, concat('<SOURCE id="', printf('SRC-%03d', rn), '" page="', page_no, '" scope="', lang, ' ', window_no,
  '"', CASE WHEN line_no % 3 = 0 THEN concat(' title="', source, '"') ELSE '' END, '>', chr(10), text, chr(10), '</SOURCE>') AS block FROM kept)
SELECT doc_id, concat('win_', printf('SRC-%03d', min(rn)), '_', printf('SRC-%03d', max(rn))) AS window_id, string_agg(block, chr(10) || chr(10) ORDER BY rn) AS formatted FROM b GROUP BY doc_id, window_no""")
def h19(spark, sf):
    chunks = coverage.document_windows(views.lines(spark, sf))
    block = coverage.source_block(
        coverage.chunk_id(F.col("rn")), F.col("page_no"), F.col("text"),
        F.concat("lang", F.lit(" "), F.col("window_no").cast("string")), F.when(F.col("line_no") % 3 == 0, F.col("source")),
    )
    wins = chunks.groupBy("doc_id", "window_no").agg(
        F.array_sort(F.collect_list(F.struct("rn", block.alias("block")))).alias("b"), F.min("rn").alias("lo"), F.max("rn").alias("hi")
    )
    return wins.select(
        "doc_id", F.concat(F.lit("win_"), coverage.chunk_id(F.col("lo")), F.lit("_"), coverage.chunk_id(F.col("hi"))).alias("window_id"),
        F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("formatted"),
    )


@query("H26_scope_description", f"""WITH {duck.LEAVES}, s AS (SELECT n_nationkey * 1000 + c_custkey % 40 AS plan_id, concat('Section: ', c_name) AS name, pg,
  row_number() OVER (PARTITION BY n_nationkey * 1000 + c_custkey % 40 ORDER BY pg) AS rn, count(*) OVER (PARTITION BY n_nationkey * 1000 + c_custkey % 40) AS n FROM leaf)
SELECT plan_id, CASE WHEN max(n) <= 3 THEN string_agg(name, ' + ' ORDER BY pg) ELSE concat(max(n), ' Selected Curriculum Scopes (', arg_min(name, pg), ' and others)') END AS description FROM s GROUP BY 1""")
def h26(spark, sf):
    chosen = views.leaves(spark, sf).selectExpr(
        "n_nationkey * 1000 + c_custkey % 40 AS plan_id", "concat('Section: ', c_name) AS scope_name", "pg"
    )
    return coverage.describe_scopes(chosen, "plan_id", [F.col("pg")])


@query("C20_cited_context", f"""WITH {duck.LINES}, ch AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS chunk_no FROM v_lines),
c2 AS (SELECT doc_id, chunk_no, printf('SRC-%03d', chunk_no) AS chunk_id FROM ch),
cit AS (SELECT DISTINCT doc_id, printf('SRC-%03d', line_no) AS chunk_id FROM v_lines WHERE line_no % 3 = 0 AND doc_id % 4 <> 0),
h AS (SELECT c2.*, row_number() OVER (PARTITION BY c2.doc_id ORDER BY chunk_no) AS place FROM c2 SEMI JOIN cit ON cit.doc_id = c2.doc_id AND cit.chunk_id = c2.chunk_id)
SELECT doc_id, chunk_no, chunk_id FROM h WHERE place <= 4 UNION ALL
SELECT doc_id, chunk_no, chunk_id FROM c2 WHERE chunk_no <= 3 AND doc_id NOT IN (SELECT doc_id FROM h)""")
def c20(spark, sf):
    lines = views.lines(spark, sf)
    chunks = numbered(lines, ["doc_id"], F.floor(F.col("page_no") / 8), [F.col("line_no")], "chunk_no").select(
        "doc_id", "chunk_no", coverage.chunk_id(F.col("chunk_no")).alias("chunk_id")
    )
    citations = lines.filter("line_no % 3 = 0 AND doc_id % 4 <> 0").select(
        "doc_id", coverage.chunk_id(F.col("line_no")).alias("chunk_id")
    )
    return coverage.cited_context(chunks, citations, "doc_id")
