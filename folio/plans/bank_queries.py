"""Queries over the bank and papers: B12, B16, B18, C7, C8, C10-C13, D9, D13, E24, F2, G3, G5, J1, J5, J6."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import bank as B
from folio.operators import coverage, papers, tree
from folio.operators.ordered import numbered
from folio.plans import duck
from folio.plans.question_queries import ANSWER
from folio.plans.registry import query
from folio.runtime import table
from folio.sources import views

HASH = f"""sha256(concat_ws(chr(31), 'MCQ', lower(trim(regexp_replace(stem, '\\s+', ' ', 'g'))), array_to_string(list_sort([lower(o.text) FOR o IN options]), chr(31)),
  lower(coalesce({ANSWER}, ''))))"""


@query("G3_canonical_hash", f"""WITH {duck.CANDIDATES}, h AS (SELECT question_id, {HASH} AS content_hash FROM v_candidates)
SELECT content_hash, count(*) AS n, min(question_id) AS first_id FROM h GROUP BY 1""")
def g3(spark, sf):
    shuffled = views.candidates(spark, sf).withColumn("options", F.reverse("options")).withColumn("stem", F.upper("stem"))
    return B.with_content_hash(shuffled).groupBy("content_hash").agg(F.count("*").alias("n"), F.min("question_id").alias("first_id"))


SAVED = f"""{duck.CANDIDATES}, h AS (SELECT *, 'V' AS version_id, {HASH} AS content_hash FROM v_candidates),
st AS (SELECT content_hash, CAST(min(seq) AS VARCHAR) AS stored_id FROM h WHERE seq % 3 = 0 GROUP BY 1),
sv AS (SELECT h.*, coalesce(stored_id, concat('qbi_', substr(sha256(concat_ws('|', version_id, h.content_hash)), 1, 12))) AS bank_id,
  stored_id IS NULL AND seq = min(seq) OVER (PARTITION BY h.content_hash) AS is_created FROM h LEFT JOIN st ON st.content_hash = h.content_hash)"""


def _saved(spark, sf):
    hashed = B.with_content_hash(views.candidates(spark, sf).withColumn("version_id", F.lit("V")))
    stored = hashed.filter("seq % 3 = 0").groupBy("version_id", "content_hash").agg(F.min("seq").alias("question_id"))
    return B.save_generated(hashed, stored), stored


@query("J5_save_to_bank", f"WITH {SAVED} SELECT question_id, bank_id, is_created FROM sv")
def j5(spark, sf):
    return _saved(spark, sf)[0].select("question_id", "bank_id", "is_created")


@query("J5_saved_rows", f"""WITH {SAVED}, n AS (SELECT * FROM sv WHERE is_created)
SELECT 'question' AS kind, bank_id, content_hash AS key, stem AS value FROM n
UNION ALL SELECT 'option', bank_id, CAST(i AS VARCHAR), options[i].text FROM n, (SELECT unnest([1, 2, 3, 4]) AS i)
UNION ALL SELECT 'answer', bank_id, CAST(i AS VARCHAR), NULL FROM n, (SELECT unnest([1, 2, 3, 4]) AS i) WHERE options[i].id = correct_option_id
UNION ALL SELECT DISTINCT 'scope', bank_id, node_id, NULL FROM (SELECT bank_id, concat('n', seq % 25) AS node_id FROM sv UNION ALL SELECT bank_id, concat('n', seq % 7) FROM sv WHERE seq % 3 = 1)
UNION ALL SELECT 'count', version_id, 'created', CAST(count_if(is_created) AS VARCHAR) FROM sv GROUP BY version_id
UNION ALL SELECT 'count', version_id, 'reused', CAST(count_if(NOT is_created) AS VARCHAR) FROM sv GROUP BY version_id""")
def j5_rows(spark, sf):
    saved = _saved(spark, sf)[0]
    cands = views.candidates(spark, sf)
    asked = cands.selectExpr("question_id", "concat('n', seq % 25) AS node_id")
    cited = cands.filter("seq % 3 = 1").selectExpr("question_id", "concat('n', seq % 7) AS node_id")
    return B.saved_rows(saved, asked, cited)


@query("C7_bank_existence", f"WITH {SAVED} SELECT version_id, count_if(is_created)::BIGINT AS new_saved, count_if(NOT is_created)::BIGINT AS reused FROM sv GROUP BY 1")
def c7(spark, sf):
    saved = _saved(spark, sf)[0]
    return saved.groupBy("version_id").agg(
        F.count_if("is_created").alias("new_saved"), F.count_if(~F.col("is_created")).alias("reused")
    )


@query("C8_option_map", f"""WITH {SAVED}, x AS (SELECT question_id, bank_id, is_created, stored.k, options[stored.k + 1].id AS generated_id FROM sv, (SELECT unnest([0,1,2,3])::BIGINT AS k) stored)
SELECT question_id, bank_id, generated_id, CASE WHEN bank_id LIKE 'qbi_%' THEN concat(bank_id, '_', k + 1) ELSE concat('s_', bank_id, '_', 3 - k) END AS option_id FROM x""")
def c8(spark, sf):
    saved, stored = _saved(spark, sf)
    stored_options = stored.select("question_id", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(4)])).alias("canonical_order")).selectExpr(
        "question_id", "canonical_order", "concat('s_', question_id, '_', 3 - canonical_order) AS option_id"
    )
    return B.option_map(saved, stored_options)


PLAN = "concat('plan_', doc_id % 20)"


@query("C10_provenance", f"""WITH {duck.LINES}, {duck.CANDIDATES}, ch0 AS (SELECT {PLAN} AS plan_id, doc_id * 100000 + line_no AS o, page_no, text FROM v_lines),
ch AS (SELECT plan_id, page_no, text, row_number() OVER (PARTITION BY plan_id ORDER BY o) AS chunk_no FROM ch0), c AS (SELECT plan_id, printf('SRC-%03d', chunk_no) AS chunk_id, chunk_no, page_no, text FROM ch),
q AS (SELECT concat('plan_', seq % 20) AS plan_id, question_id, CASE WHEN seq % 19 = 0 THEN [] WHEN seq % 4 = 0 THEN [printf('SRC-%03d', seq % 50 + 1), 'SRC-none'] ELSE [printf('SRC-%03d', seq % 9 + 1), printf('SRC-%03d', seq % 5 + 10)] END AS cites FROM v_candidates),
f AS (SELECT q.plan_id, q.question_id, c.chunk_id, page_no, text FROM (SELECT plan_id, question_id, unnest(cites) AS chunk_id FROM q) q JOIN c USING (plan_id, chunk_id)),
b AS (SELECT q.plan_id, q.question_id, c.chunk_id, c.page_no, c.text FROM q JOIN c ON c.plan_id = q.plan_id AND c.chunk_no = 1 WHERE q.question_id NOT IN (SELECT question_id FROM f))
SELECT plan_id, question_id, chunk_id, page_no, sha256(text) AS source_hash, CASE WHEN length(text) > 200 THEN concat(substr(text, 1, 200), '...') ELSE text END AS snippet FROM (SELECT * FROM f UNION ALL SELECT * FROM b)""")
def c10(spark, sf):
    raw = views.lines(spark, sf).selectExpr(f"{PLAN} AS plan_id", "doc_id", "line_no", "page_no", "text AS content_text")
    chunks = numbered(raw, ["plan_id"], F.floor(F.col("doc_id") / 64), [F.col("doc_id"), F.col("line_no")], "chunk_no").withColumn(
        "chunk_id", coverage.chunk_id(F.col("chunk_no"))
    )
    code = "format_string('SRC-%03d', {})"
    cands = views.candidates(spark, sf).selectExpr(
        "concat('plan_', seq % 20) AS plan_id", "question_id",
        f"""CASE WHEN seq % 19 = 0 THEN array() WHEN seq % 4 = 0 THEN array({code.format('seq % 50 + 1')}, 'SRC-none')
            ELSE array({code.format('seq % 9 + 1')}, {code.format('seq % 5 + 10')}) END AS source_chunk_ids""",
    )
    return B.provenance(cands, chunks, "plan_id")


@query("G5_scope_union", """SELECT p_partkey AS question_id, concat('n', p_partkey % 25) AS node_id FROM part
UNION SELECT l_partkey, concat('n', l_suppkey % 25) FROM lineitem""")
def g5(spark, sf):
    asked = table(spark, sf, "part").selectExpr("p_partkey AS question_id", "concat('n', p_partkey % 25) AS node_id")
    cited = table(spark, sf, "lineitem").selectExpr("l_partkey AS question_id", "concat('n', l_suppkey % 25) AS node_id")
    return B.scope_links(asked, cited)


@query("B12_bank_filter", f"""WITH {duck.CLOSURE}, {duck.BANK}, sc AS (SELECT descendant_id AS node_id FROM closure WHERE ancestor_id = 'r1' UNION ALL SELECT 'r1')
SELECT question_id FROM v_bank WHERE status = 'ACTIVE' AND origin_type = 'AI_GENERATED' AND (stem ILIKE '%en%' OR explanation ILIKE '%en%') AND node_id IN (SELECT node_id FROM sc)""")
def b12(spark, sf):
    pairs = tree.closure(views.nodes(spark, sf), levels=2)
    scopes = B.scope_with_descendants("r1", pairs)
    return B.bank_filter(views.bank(spark, sf), origin="AI_GENERATED", search=" en ", scopes=scopes).select("question_id")


@query("D9_page_totals", f"""WITH {duck.BANK} SELECT version_id, count(*) AS total_count, greatest(1, (count(*) + 19) // 20) AS total_pages FROM v_bank GROUP BY 1""")
def d9(spark, sf):
    return B.page_totals(views.bank(spark, sf), 20, ["version_id"])


@query("F2_offset_page", f"""WITH {duck.PAPERS} SELECT set_id, title, created_at FROM v_papers WHERE status = 'ACTIVE' AND version_id = 'F'
 ORDER BY created_at DESC, set_id DESC LIMIT 20 OFFSET 40""")
def f2(spark, sf):
    active = views.papers(spark, sf).filter("status = 'ACTIVE' AND version_id = 'F'")
    return B.page_of(active, [F.col("created_at").desc(), F.col("set_id").desc()], 3, 20).select("set_id", "title", "created_at")


@query("C11_question_detail", f"""WITH {duck.NODES}, {duck.QUESTIONS}, sc AS (SELECT question_id, concat('n', question_id % 25) AS node_id FROM v_questions
  UNION SELECT question_id, concat('n', (question_id + 7) % 25) FROM v_questions WHERE question_id % 2 = 0),
o AS (SELECT question_id, string_agg(concat(option_id, '=', option_text), '|' ORDER BY canonical_order) AS options FROM v_options GROUP BY 1),
s AS (SELECT question_id, string_agg(concat(node_id, ':', title), '|' ORDER BY node_id, title) AS scopes FROM sc JOIN v_nodes USING (node_id) GROUP BY 1),
p AS (SELECT l_partkey AS question_id, arg_min(l_linenumber, (l_orderkey, l_linenumber)) AS page_no, min(l_orderkey) AS prov_seq FROM lineitem GROUP BY 1)
SELECT q.question_id, q.stem, o.options, s.scopes, p.page_no, p.prov_seq FROM v_questions q LEFT JOIN o USING (question_id) LEFT JOIN s USING (question_id) LEFT JOIN p USING (question_id)""")
def c11(spark, sf):
    qs = views.questions(spark, sf)
    scopes = qs.selectExpr("question_id", "concat('n', question_id % 25) AS node_id").union(
        qs.filter("question_id % 2 = 0").selectExpr("question_id", "concat('n', (question_id + 7) % 25)")
    )
    prov = table(spark, sf, "lineitem").selectExpr("l_partkey AS question_id", "l_linenumber AS page_no", "l_orderkey AS prov_seq")
    out = B.question_details(qs, views.options(spark, sf), scopes, views.nodes(spark, sf), prov)
    return out.select(
        "question_id", "stem", F.array_join(F.transform("options", lambda o: F.concat(o["option_id"], F.lit("="), o["option_text"])), "|").alias("options"),
        F.array_join(F.transform("scopes", lambda s: F.concat(s["node_id"], F.lit(":"), s["title"])), "|").alias("scopes"),
        "page_no", "prov_seq",
    )


@query("J1_archive", f"""WITH {duck.PAPERS} SELECT set_id, CASE WHEN set_id % 5 = 0 THEN 'ARCHIVED' ELSE status END AS status,
  CASE WHEN set_id % 5 = 0 THEN TIMESTAMP '2024-06-01 00:00:00' WHEN status = 'ARCHIVED' THEN created_at END AS archived_at FROM v_papers""")
def j1(spark, sf):
    rows = views.papers(spark, sf).select("set_id", "status", F.when(F.col("status") == "ARCHIVED", F.col("created_at")).alias("archived_at"))
    chosen = rows.filter("set_id % 5 = 0").select("set_id")
    return B.set_status(rows, chosen, "set_id", "ARCHIVED", F.lit("2024-06-01 00:00:00").cast(rows.schema["archived_at"].dataType))


@query("B18_source_contract", """SELECT o_orderkey AS set_id, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN 'JOB_ID_REQUIRED' WHEN o_orderstatus <> 'F' AND o_orderkey % 4 <> 0 THEN 'JOB_ID_FORBIDDEN' END AS error FROM orders""")
def b18(spark, sf):
    src = F.expr("CASE WHEN o_orderstatus = 'F' THEN 'GENERATED_JOB' ELSE 'QUESTION_BANK' END")
    job = F.expr("CASE WHEN o_orderkey % 4 <> 0 THEN concat('job_', o_orderkey) END")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("set_id"), papers.source_contract(src, job).alias("error"))


CHECKED = f"""{duck.QUESTIONS}, {duck.PAPERS}, op AS (SELECT question_id, list(option_id) AS option_ids FROM v_options GROUP BY 1),
j AS (SELECT i.*, p.version_id, q.version_id AS qv, q.correct_option_id, op.option_ids, count(*) OVER (PARTITION BY i.set_id, i.question_order) AS n_order,
  count(*) OVER (PARTITION BY i.set_id, i.question_id) AS n_q FROM v_paper_items i JOIN v_papers p ON p.set_id = i.set_id
  LEFT JOIN v_questions q ON q.question_id = i.question_id LEFT JOIN op ON op.question_id = i.question_id),
ck AS (SELECT set_id, question_id, question_order, CASE WHEN n_order > 1 THEN 'DUPLICATE_QUESTION_ORDER' WHEN question_order < 1 THEN 'INVALID_QUESTION_ORDER'
  WHEN qv IS NULL THEN 'QUESTION_NOT_FOUND' WHEN qv <> version_id THEN 'FOREIGN_SUBJECT_QUESTION' WHEN n_q > 1 THEN 'DUPLICATE_QUESTION_IN_PAPER'
  WHEN len(option_order) <> 4 THEN 'INVALID_OPTION_COUNT' WHEN len(list_distinct(option_order)) <> 4 THEN 'DUPLICATE_OPTION_IDS'
  WHEN len(list_filter(option_order, lambda x: NOT list_contains(option_ids, x))) > 0 THEN 'FOREIGN_OPTION_ID'
  WHEN NOT list_contains(option_order, correct_option_id) THEN 'CORRECT_OPTION_MISSING' END AS violation FROM j),
vd AS (SELECT p.*, coalesce(n, 0) AS n_items, CASE WHEN n IS NULL THEN 'EMPTY_ARRANGEMENTS' WHEN bad > 0 THEN 'REJECTED' ELSE 'VALID' END AS verdict
  FROM v_papers p LEFT JOIN (SELECT set_id, count(*) AS n, count(violation) AS bad FROM ck GROUP BY 1) c USING (set_id))"""


def _paper_inputs(spark, sf):
    return views.papers(spark, sf), views.paper_items(spark, sf), views.questions(spark, sf), views.options(spark, sf)


@query("B16_arrangement_rules", f"WITH {CHECKED} SELECT set_id, question_id, question_order, violation FROM ck")
def b16(spark, sf):
    return papers.violations(*_paper_inputs(spark, sf)).select("set_id", "question_id", "question_order", "violation")


@query("B16_paper_verdict", f"WITH {CHECKED} SELECT set_id, n_items, verdict FROM vd")
def b16_verdict(spark, sf):
    inputs = _paper_inputs(spark, sf)
    return papers.paper_verdicts(inputs[0], papers.violations(*inputs)).select("set_id", "n_items", "verdict")


@query("J6_save_paper", f"""WITH {CHECKED} SELECT set_id, version_id, title, 'QUESTION_PAPER' AS set_type, n_items AS question_count,
  coalesce(given_marks, n_items * marks_per_question) AS total_marks, 'ACTIVE' AS status FROM vd WHERE verdict = 'VALID'""")
def j6(spark, sf):
    return papers.save_papers(*_paper_inputs(spark, sf))


@query("J6_paper_rows", f"""WITH {CHECKED}, ok AS (SELECT set_id, marks_per_question FROM vd WHERE verdict = 'VALID'), it AS (SELECT i.*, marks_per_question FROM v_paper_items i JOIN ok USING (set_id))
SELECT set_id, 'item' AS kind, question_order AS place, CAST(question_id AS VARCHAR) AS key, array_to_string(option_order, ',') AS value, coalesce(marks_per_question, 1)::DOUBLE AS marks FROM it
UNION ALL SELECT DISTINCT set_id, 'scope', NULL::BIGINT, concat('n', question_id % 25), NULL, NULL::DOUBLE FROM it""")
def j6_rows(spark, sf):
    homes = views.questions(spark, sf).selectExpr("question_id", "concat('n', question_id % 25) AS node_id")
    return papers.paper_rows(*_paper_inputs(spark, sf), homes)


@query("D13_total_marks", f"""WITH {duck.PAPERS}, n AS (SELECT set_id, count(*) AS n FROM v_paper_items GROUP BY 1)
SELECT set_id, coalesce(given_marks, n * marks_per_question) AS total_marks FROM v_papers JOIN n USING (set_id)""")
def d13(spark, sf):
    counts = views.paper_items(spark, sf).groupBy("set_id").agg(F.count("*").alias("n"))
    return views.papers(spark, sf).join(counts, "set_id").select(
        "set_id", papers.total_marks(F.col("n"), F.col("marks_per_question"), F.col("given_marks")).alias("total_marks")
    )


@query("C12_paper_rebuild", f"""WITH {duck.QUESTIONS}, {duck.PAPERS}, op AS (SELECT question_id, MAP_FROM_ENTRIES(list((option_id, option_text))) AS m FROM v_options GROUP BY 1),
x AS (SELECT i.*, q.stem, q.correct_option_id, [{{'l': ['A','B','C','D'][k], 'i': option_order[k], 't': m[option_order[k]]}} FOR k IN range(1, len(option_order) + 1)] AS o
  FROM v_paper_items i JOIN v_questions q USING (question_id) LEFT JOIN op USING (question_id)),
y AS (SELECT *, list_filter(o, lambda z: z.t IS NOT NULL) AS s FROM x), w AS (SELECT *, list_filter(s, lambda z: z.i = correct_option_id)[-1] AS r FROM y)
SELECT set_id, question_order AS question_number, question_id, stem, array_to_string([concat(z.l, ') ', z.t) FOR z IN s], '|') AS option_labels, coalesce(r.l, 'A') AS correct_letter, coalesce(r.t, '') AS correct_text FROM w""")
def c12(spark, sf):
    _, items, qs, opts = _paper_inputs(spark, sf)
    return papers.rebuild(items, qs, opts)


@query("C13_id_translation", f"""WITH {duck.QUESTIONS}, op AS (SELECT question_id, list(option_id ORDER BY canonical_order) AS v FROM v_options GROUP BY 1),
i AS (SELECT l_orderkey AS set_id, l_linenumber::BIGINT AS n, CASE l_suppkey % 5 WHEN 0 THEN concat('gen_', l_partkey) ELSE CAST(l_partkey AS VARCHAR) END AS generated_id, l_partkey AS qid,
  CASE l_suppkey % 5 WHEN 0 THEN ['opt_3', 'opt_1', 'opt_4', 'opt_2'] WHEN 1 THEN ['B', 'a', 'D', 'c'] WHEN 2 THEN ['opt_2', 'opt3', ' 4', 'A']
   WHEN 3 THEN [concat('o_', l_partkey, '_2'), concat('o_', l_partkey, '_1'), 'C', 'opt_4'] ELSE ['opt_9', 'x', 'A', 'B'] END AS oo FROM lineitem),
j AS (SELECT i.*, v, [CASE WHEN generated_id LIKE 'gen_%' AND qid % 50 <> 7 THEN concat('o_', qid, '_', 5 - CAST(substr(z, 5) AS INTEGER)) END FOR z IN oo] AS mp FROM (SELECT * FROM i WHERE generated_id LIKE 'gen_%') i LEFT JOIN op ON op.question_id = i.qid
   UNION ALL SELECT i.*, v, NULL FROM (SELECT * FROM i WHERE generated_id NOT LIKE 'gen_%') i LEFT JOIN op ON op.question_id = i.qid),
k AS (SELECT *, CASE WHEN v IS NOT NULL AND mp IS NOT NULL AND mp[1] IS NOT NULL THEN mp ELSE oo END AS st FROM j),
d AS (SELECT *, list_filter([CASE WHEN regexp_matches(trim(replace(replace(z, 'opt_', ''), 'opt', '')), '^\\d+$') THEN v[CAST(trim(replace(replace(z, 'opt_', ''), 'opt', '')) AS INTEGER)]
   WHEN regexp_matches(z, '^[A-Da-d]$') THEN v[ascii(upper(z)) - 64] WHEN list_contains(v, z) THEN z END FOR z IN st], lambda q: q IS NOT NULL) AS g FROM k)
SELECT set_id, n, generated_id, CASE WHEN generated_id LIKE 'gen_%' AND qid % 50 <> 7 THEN CAST(qid AS VARCHAR) ELSE generated_id END AS question_id,
  array_to_string(CASE WHEN len(list_filter(st, lambda q: NOT coalesce(list_contains(v, q), false))) > 0 AND len(g) = 4 THEN g ELSE st END, ',') AS option_order FROM d""")
def c13(spark, sf):
    items = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS set_id", "CAST(l_linenumber AS BIGINT) AS n",
        "CASE l_suppkey % 5 WHEN 0 THEN concat('gen_', l_partkey) ELSE CAST(l_partkey AS STRING) END AS generated_id",
        """CASE l_suppkey % 5 WHEN 0 THEN array('opt_3', 'opt_1', 'opt_4', 'opt_2') WHEN 1 THEN array('B', 'a', 'D', 'c') WHEN 2 THEN array('opt_2', 'opt3', ' 4', 'A')
           WHEN 3 THEN array(concat('o_', l_partkey, '_2'), concat('o_', l_partkey, '_1'), 'C', 'opt_4') ELSE array('opt_9', 'x', 'A', 'B') END AS option_order""",
    )
    qs = views.questions(spark, sf)
    id_map = qs.selectExpr(
        "concat('gen_', question_id) AS generated_id", "CAST(question_id AS STRING) AS bank_id",
        "map_from_arrays(array('opt_1','opt_2','opt_3','opt_4'), transform(sequence(1, 4), k -> concat('o_', question_id, '_', 5 - k))) AS option_map",
    )
    opts = views.options(spark, sf).withColumn("question_id", F.col("question_id").cast("string"))
    out = papers.translate_ids(items, id_map, opts)
    return out.select("set_id", "n", "generated_id", "question_id", F.array_join("option_order", ",").alias("option_order"))


@query("E24_remove_renumber", f"""WITH {duck.PAPERS}, l AS (SELECT * FROM v_paper_items WHERE question_id % 7 <> 0), c AS (SELECT set_id, count(*) AS n FROM l GROUP BY 1)
SELECT l.set_id, question_id, l_suppkey, row_number() OVER (PARTITION BY l.set_id ORDER BY question_order, question_id, l_suppkey) AS question_number, n * marks_per_question AS total_marks FROM l JOIN c USING (set_id) JOIN v_papers p ON p.set_id = l.set_id""")
def e24(spark, sf):
    items = views.paper_items(spark, sf)
    left = papers.remove_questions(items, items.filter("question_id % 7 = 0").select("set_id", "question_id"))
    counts = left.groupBy("set_id").agg(F.count("*").alias("n"))
    marks = papers.total_marks(F.col("n"), F.col("marks_per_question"), F.lit(None).cast("double"))
    return left.join(counts, "set_id").join(views.papers(spark, sf).select("set_id", "marks_per_question"), "set_id").select(
        "set_id", "question_id", "l_suppkey", "question_number", marks.alias("total_marks")
    )
