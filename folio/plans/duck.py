"""DuckDB common table expressions for the same input tables (checking SQL only)."""

from __future__ import annotations

from folio.sources import shared as S

TEXT_LINES = """text_lines AS (
  SELECT doc_id, lang, source, CAST(p AS BIGINT) AS line_no, trim(l) AS text
  FROM (SELECT doc_id, lang, source, generate_subscripts(string_split(text, chr(10)), 1) AS p,
               unnest(string_split(text, chr(10))) AS l FROM documents)
  WHERE length(trim(l)) > 0)"""

LINES = f"""{TEXT_LINES},
v_lines AS (SELECT doc_id, lang, source, line_no, text, {S.LINE_PAGE} AS page_no, {S.LINE_SIZE} AS size,
  72.0::DOUBLE AS x0, {S.LINE_Y0} AS y0, 72.0::DOUBLE + 5.5::DOUBLE * length(text) AS x1,
  {S.LINE_Y0} + {S.LINE_SIZE} AS y1 FROM text_lines)"""

BOOK = f"""{TEXT_LINES},
placed AS (SELECT line_no, text AS raw, {S.BOOK_ID} AS book_id, {S.BOOK_PAGE} AS page_no FROM text_lines),
shaped AS (SELECT book_id, page_no, line_no, {S.BOOK_TEXT} AS text, {S.BOOK_SIZE} AS size, {S.BOOK_BOLD} AS bold,
  {S.BOOK_X0} AS x0, {S.BOOK_Y0} AS y0 FROM placed),
v_book AS MATERIALIZED (SELECT book_id, page_no, line_no, trim(text) AS text, size, bold, x0, y0,
  x0 + 5.5::DOUBLE * length(text) AS x1, y0 + size AS y1 FROM shaped),
v_pages AS (SELECT book_id, page_no, 595.0::DOUBLE AS width, {S.BOOK_HEIGHT} AS height,
  (book_id + page_no) % 3 AS n_images, (book_id + page_no) % 2 AS n_drawings FROM v_book GROUP BY book_id, page_no)"""

WORDS = f"""{BOOK},
w0 AS (SELECT *, string_split(text, ' ') AS ws FROM v_book),
w1 AS (SELECT * EXCLUDE (ws, text), ws, CAST(generate_subscripts(ws, 1) - 1 AS BIGINT) AS i, unnest(ws) AS word FROM w0),
v_words AS (SELECT book_id, page_no, line_no, i + 1 AS word_no, word AS text,
  x0 + 5.5::DOUBLE * length(array_to_string(ws[1:i], ' ')) + (CASE WHEN i > 0 THEN 5.5::DOUBLE ELSE 0.0::DOUBLE END) AS x0,
  y0 + 0.5::DOUBLE * (i % 3) AS y0,
  x0 + 5.5::DOUBLE * length(array_to_string(ws[1:i], ' ')) + (CASE WHEN i > 0 THEN 5.5::DOUBLE ELSE 0.0::DOUBLE END)
    + 5.5::DOUBLE * length(word) AS x1,
  y0 + 0.5::DOUBLE * (i % 3) + size AS y1 FROM w1 WHERE length(word) > 0),
v_spans AS (SELECT book_id, page_no, line_no, i + 1 AS span_no, word AS text,
  CASE WHEN i % 5 IN (3, 4) THEN size * 0.5::DOUBLE ELSE size END AS size,
  CASE WHEN bold THEN 'Serif-Bold' WHEN i % 7 = 2 THEN 'Serif-Italic' ELSE 'Serif' END AS font,
  CAST(CASE WHEN i % 11 = 5 THEN 16 WHEN i % 11 = 6 THEN 2 ELSE 0 END AS BIGINT) AS flags,
  x0 + 5.5::DOUBLE * length(array_to_string(ws[1:i], '')) + (CASE WHEN i > 0 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END) AS x0,
  y0,
  x0 + 5.5::DOUBLE * length(array_to_string(ws[1:i], '')) + (CASE WHEN i > 0 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END)
    + 5.5::DOUBLE * length(word) AS x1, y1,
  CASE WHEN i % 5 = 3 THEN y1 - 0.5::DOUBLE * size WHEN i % 5 = 4 THEN y1 + 0.25::DOUBLE * size ELSE y1 END AS origin_y
  FROM w1 WHERE length(word) > 0)"""

LEAVES = """leaf AS (SELECT c_custkey, c_name, n_nationkey, n_name, r_regionkey, r_name,
  row_number() OVER (ORDER BY r_regionkey, n_nationkey, c_custkey) AS pg
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

NODES = f"""{LEAVES},
v_nodes AS (
  SELECT concat('v', r_regionkey) AS version_id, concat('r', r_regionkey) AS node_id, CAST(NULL AS VARCHAR) AS parent_id,
    0::BIGINT AS depth, CAST(r_regionkey AS BIGINT) AS ordinal, 'unit' AS node_type, r_name AS title,
    min(pg) AS start_page, max(pg) AS end_page FROM leaf GROUP BY r_regionkey, r_name
  UNION ALL SELECT concat('v', r_regionkey), concat('n', n_nationkey), concat('r', r_regionkey), 1, n_nationkey, 'lesson',
    n_name, min(pg), max(pg) FROM leaf GROUP BY n_nationkey, r_regionkey, n_name
  UNION ALL SELECT concat('v', r_regionkey), concat('c', c_custkey), concat('n', n_nationkey), 2, c_custkey, 'section',
    c_name, pg, CASE WHEN c_custkey % 2 = 1 THEN NULL ELSE pg END FROM leaf)"""

CONTENT = """v_content AS (SELECT o_orderkey AS content_id, concat('v', r_regionkey) AS version_id, o_orderkey AS ordinal,
  pg AS page_no, CASE WHEN o_orderkey % 9 = 0 THEN 'header' ELSE 'generic_text' END AS node_type,
  concat(o_orderpriority, ' ', o_orderstatus) AS content_text FROM orders JOIN leaf ON o_custkey = c_custkey)"""

TREE = f"{NODES},\n{CONTENT}"

CLOSURE = f"""RECURSIVE {NODES},
closure AS (SELECT node_id AS descendant_id, parent_id AS ancestor_id, 1::BIGINT AS distance FROM v_nodes
    WHERE parent_id IS NOT NULL
  UNION ALL SELECT c.descendant_id, n.parent_id, c.distance + 1 FROM closure c JOIN v_nodes n ON n.node_id = c.ancestor_id
    WHERE n.parent_id IS NOT NULL)"""

CANDIDATES = f"""v_candidates AS (SELECT p_partkey AS seq, concat('job_', {S.div('p_partkey', 50)}) AS job_id,
  {S.div('p_partkey % 50', 10)} + 1 AS round, concat('q_', p_partkey) AS question_id, {S.CANDIDATE_STEM} AS stem,
  [{{'id': 'opt_1', 'text': CAST(p_size*p_size AS VARCHAR)}}, {{'id': 'opt_2', 'text': CAST(p_size*p_size+5 AS VARCHAR)}},
   {{'id': 'opt_3', 'text': {S.OPTION_3}}}, {{'id': 'opt_4', 'text': CAST(p_size*p_size+10 AS VARCHAR)}}] AS options,
  {S.CORRECT_ID} AS correct_option_id, {S.EXPLANATION} AS explanation,
  CASE WHEN p_partkey % 19 = 0 THEN [] ELSE [concat('SRC-', p_partkey % 7)] END AS source_chunk_ids FROM part)"""

QUESTIONS = f"""v_questions AS (SELECT p_partkey AS question_id, {S.PART_VERSION} AS version_id, {S.STEM} AS stem,
  concat('o_', p_partkey, '_', p_partkey % 4 + 1) AS correct_option_id, p_size, 'n times n' AS explanation
  FROM part WHERE p_partkey % 50 <> 7),
v_options AS (SELECT question_id, concat('o_', question_id, '_', k + 1) AS option_id, k AS canonical_order,
  CAST(p_size * p_size + k * 5 AS VARCHAR) AS option_text
  FROM v_questions, (SELECT unnest([0, 1, 2, 3])::BIGINT AS k))"""

PAPERS = f"""v_papers AS (SELECT o_orderkey AS set_id, {S.PAPER_VERSION} AS version_id,
  concat('Paper ', o_orderpriority) AS title,
  CASE WHEN o_orderkey % 9 = 0 THEN 'ARCHIVED' ELSE 'ACTIVE' END AS status, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 6 = 0 THEN o_totalprice END AS given_marks,
  CAST(o_orderkey % 3 + 1 AS DOUBLE) AS marks_per_question FROM orders),
pi0 AS (SELECT l_orderkey AS set_id, l_partkey AS question_id, {S.ITEM_ORDER} AS question_order, l_suppkey, l_linenumber,
  [CASE WHEN l_suppkey % 37 = 0 THEN 'o_x' WHEN l_suppkey % 41 = 0 THEN concat('o_', l_partkey, '_', (l_linenumber + 1) % 4 + 1)
        ELSE concat('o_', l_partkey, '_', l_linenumber % 4 + 1) END,
   concat('o_', l_partkey, '_', (l_linenumber + 1) % 4 + 1), concat('o_', l_partkey, '_', (l_linenumber + 2) % 4 + 1),
   concat('o_', l_partkey, '_', (l_linenumber + 3) % 4 + 1)] AS four FROM lineitem),
v_paper_items AS (SELECT set_id, question_id, question_order, l_suppkey,
  CASE WHEN l_suppkey % 50 = 0 THEN four[1:3] ELSE four END AS option_order FROM pi0)"""

VERSIONS = f"""v_versions AS (SELECT d.doc_id AS version_id, {S.VERSION_TITLE.replace('doc_id', 'd.doc_id')} AS title,
  {S.VERSION_FILE.replace('doc_id', 'd.doc_id')} AS source_filename, {S.GRADE_ID} AS grade_id, {S.SUBJECT_ID} AS subject_id,
  sha256(text) AS checksum, CAST(length(text) AS BIGINT) AS n_bytes, d.doc_id % 30 + 1 AS page_count,
  {S.INGESTION.replace('doc_id', 'd.doc_id')} AS ingestion_status, coalesce(toxic = 1, false) AS is_deleted,
  CASE quality WHEN 1 THEN 'VALID' WHEN 0 THEN 'NEEDS_REFRESH' ELSE 'UNASSESSED' END AS quality_status,
  CASE WHEN d.doc_id % 8 = 0 THEN 'USER_CONFIRMED' ELSE 'NEEDS_REVIEW' END AS metadata_status,
  d.doc_id AS created_seq, {S.FRONT_TEXT.replace('doc_id', 'd.doc_id')} AS front_text
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

BANK = """v_bank AS (SELECT question_id, n AS created_seq, concat('ver_', n % 7) AS version_id, stem, explanation, origin_type,
  CASE WHEN n % 6 = 0 THEN 'ARCHIVED' ELSE 'ACTIVE' END AS status, concat('n', n % 25) AS node_id FROM (
  SELECT concat('bm_', item_id) AS question_id, item_id AS n, text AS stem, 'benchmark item' AS explanation, 'MANUAL' AS origin_type
    FROM benchmark
  UNION ALL SELECT concat('cv_', conv_id, '_', turn), conv_id * 100 + turn, text, concat('turn ', turn), 'AI_GENERATED'
    FROM conversations WHERE role = 'user'))"""

JOBS = """v_jobs AS (SELECT event_id, ts, user_id AS job_id, CASE event_type WHEN 'click' THEN 'candidate'
  WHEN 'purchase' THEN 'accepted' WHEN 'view' THEN 'surplus' WHEN 'error' THEN 'rejected' ELSE 'start' END AS kind, value
  FROM events)"""
