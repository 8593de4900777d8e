"""Queries over the catalogue: B10, B11, B17, C1, C6, C16, C21, D5-D7, D11, F3, G6, G7, H12-H15, H29, J2, J3, J7."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import metadata as M
from folio.functions.text import reason_texts
from folio.operators import catalog as C
from folio.operators import structure as S
from folio.plans import duck
from folio.plans.registry import query
from folio.plans.structure_queries import NODES_SQL, _assigned, _last, domains
from folio.rules import PROFILES
from folio.runtime import table
from folio.sources import views

GRADE_ROWS = """CAST(n_nationkey AS BIGINT) AS grade_id, CASE WHEN n_nationkey = 13 THEN 'college' ELSE concat('class-', n_nationkey) END AS code,
  CASE WHEN n_nationkey = 13 THEN 'College' ELSE concat('Class ', n_nationkey) END AS name, CASE WHEN n_nationkey < 13 THEN n_nationkey END AS level_number"""
SUBJECT_ROWS = """CAST(r_regionkey AS BIGINT) AS subject_id, CASE r_regionkey WHEN 1 THEN 'english-for-today' WHEN 2 THEN 'physics' WHEN 3 THEN 'art' ELSE concat('art-', r_regionkey) END AS subject_code,
  CASE r_regionkey WHEN 1 THEN 'LANGUAGE' WHEN 2 THEN 'STEM' ELSE 'ART' END AS domain"""


def _cols(text: str) -> list[str]:
    depth, part, out = 0, "", []
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    return [*out, part.strip()]


DIMS = f"""grades AS (SELECT {GRADE_ROWS} FROM nation), subjects AS (SELECT {SUBJECT_ROWS} FROM region)"""
READY = f"""{duck.VERSIONS}, {DIMS}, en AS (SELECT v.*, g.code, g.name, s.subject_code, s.domain, v.version_id % 9 <> 0 AS has_asset FROM v_versions v LEFT JOIN grades g ON g.grade_id = v.grade_id LEFT JOIN subjects s ON s.subject_id = v.subject_id),
ready AS (SELECT *, concat_ws(',', CASE WHEN is_deleted THEN 'TEXTBOOK_DELETED' END, CASE WHEN ingestion_status NOT IN ('COMPLETED', 'PARTIAL') THEN 'INGESTION_INCOMPLETE' END,
  CASE WHEN grade_id IS NULL THEN 'GRADE_NOT_ASSIGNED' END, CASE WHEN subject_id IS NULL THEN 'SUBJECT_NOT_RESOLVED' WHEN domain NOT IN ('STEM', 'LANGUAGE') THEN 'SUBJECT_NOT_SUPPORTED' END,
  CASE WHEN quality_status IN ('NEEDS_REFRESH', 'FAILED', 'BUILDING') THEN 'STRUCTURE_NEEDS_REFRESH' END, CASE WHEN NOT has_asset THEN 'PDF_NOT_AVAILABLE' END) AS reasons FROM en)"""


def _grades(spark, sf):
    return table(spark, sf, "nation").selectExpr(*_cols(GRADE_ROWS))


def _subjects(spark, sf):
    return table(spark, sf, "region").selectExpr(*_cols(SUBJECT_ROWS))


def _ready(spark, sf):
    v = views.versions(spark, sf).drop("front_text")
    assets = v.filter("version_id % 9 <> 0").select("version_id")
    return C.with_readiness(v, _grades(spark, sf), _subjects(spark, sf), assets)


@query("C1_catalogue_enrichment", f"WITH {READY} SELECT version_id, title, code, name, subject_code, domain FROM en")
def c1(spark, sf):
    out = C.enrich(views.versions(spark, sf).drop("front_text"), _grades(spark, sf), _subjects(spark, sf))
    return out.select("version_id", "title", "code", "name", "subject_code", "domain")


@query("B10_readiness", f"WITH {READY} SELECT version_id, reasons FROM ready")
def b10(spark, sf):
    return _ready(spark, sf).select("version_id", F.array_join("reasons", ",").alias("reasons"))


@query("H29_reason_text", f"""WITH {READY}, x AS (SELECT version_id, string_split(reasons, ',') AS r FROM ready WHERE reasons <> '')
SELECT version_id, array_to_string([MAP {{'TEXTBOOK_DELETED': 'This textbook has been deleted.', 'INGESTION_INCOMPLETE': 'Textbook ingestion is incomplete.', 'GRADE_NOT_ASSIGNED': 'Assign Class / Grade first.',
 'SUBJECT_NOT_RESOLVED': 'Assign a subject first.', 'SUBJECT_NOT_SUPPORTED': 'Assessment generation is not supported for this subject domain.', 'STRUCTURE_NEEDS_REFRESH': 'Textbook structure needs refresh.',
 'PDF_NOT_AVAILABLE': 'The textbook PDF file is not available.'}}[z] FOR z IN r], '; ') AS message FROM x""")
def h29(spark, sf):
    blocked = _ready(spark, sf).filter("size(reasons) > 0")
    return blocked.select("version_id", F.array_join(reason_texts(F.col("reasons")), "; ").alias("message"))


@query("B11_version_listing", f"WITH {READY} SELECT version_id, title FROM ready WHERE NOT is_deleted AND grade_id = 6 AND reasons = ''")
def b11(spark, sf):
    return C.list_versions(_ready(spark, sf), grade_id=6, eligible_only=True).select("version_id", "title")


@query("B17_grade_mismatch", f"WITH {duck.VERSIONS} SELECT version_id, coalesce(version_id % 13 <> grade_id, false) AS mismatch FROM v_versions")
def b17(spark, sf):
    return views.versions(spark, sf).select(
        "version_id", C.grade_mismatch(F.col("version_id") % 13, F.col("grade_id")).alias("mismatch")
    )


@query("F3_catalogue_order", f"WITH {duck.VERSIONS} SELECT version_id, row_number() OVER (ORDER BY created_seq DESC, version_id) AS position FROM v_versions")
def f3(spark, sf):
    return C.newest_first(views.versions(spark, sf).select("version_id", "created_seq")).select("version_id", "position")


@query("F3_grade_order", f"WITH {DIMS} SELECT grade_id, row_number() OVER (ORDER BY level_number NULLS LAST, grade_id) AS position FROM grades")
def f3_grades(spark, sf):
    return C.grade_order(_grades(spark, sf)).select("grade_id", "position")


@query("D6_grade_counts", f"""WITH {READY} SELECT g.grade_id, g.code, count(r.version_id) AS textbook_count FROM grades g LEFT JOIN ready r ON r.grade_id = g.grade_id AND r.reasons = '' GROUP BY ALL""")
def d6(spark, sf):
    ready = _ready(spark, sf).select("version_id", "grade_id", "reasons")
    return C.grade_counts(_grades(spark, sf), ready).select("grade_id", "code", "textbook_count")


@query("C6_upload_decision", f"""WITH {duck.VERSIONS}, v AS (SELECT * FROM v_versions WHERE quality_status <> 'UNASSESSED'), up AS (SELECT version_id AS upload_id, checksum, row_number() OVER (PARTITION BY checksum ORDER BY version_id) > 1 AS rep FROM v_versions),
p AS (SELECT checksum, bool_or(NOT is_deleted AND ingestion_status IN ('COMPLETED', 'PARTIAL', 'PROCESSING')) AS a, bool_or(NOT is_deleted AND ingestion_status = 'FAILED') AS f, arg_max(CASE WHEN is_deleted THEN version_id END, CASE WHEN is_deleted THEN created_seq END) AS d FROM v GROUP BY 1)
SELECT upload_id, CASE WHEN a OR rep THEN 'DUPLICATE' WHEN f THEN 'REPLACE_FAILED' WHEN d IS NOT NULL THEN 'REUSE_DELETED' ELSE 'NEW' END AS decision, CASE WHEN NOT coalesce(a, false) AND NOT rep THEN d END AS reused_version FROM up LEFT JOIN p USING (checksum)""")
def c6(spark, sf):
    v = views.versions(spark, sf).select("version_id", "checksum", "is_deleted", "ingestion_status", "created_seq", "quality_status")
    uploads = v.select(F.col("version_id").alias("upload_id"), "checksum")
    # Assessed versions are the stored ones, so that new texts occur as well.
    return C.upload_decisions(uploads, v.filter("quality_status <> 'UNASSESSED'")).drop("checksum")


@query("C16_grade_backfill", f"""WITH {duck.VERSIONS}, {DIMS}, o AS (SELECT version_id, lower(concat_ws(' ', title, source_filename)) AS t, CASE WHEN version_id % 11 = 0 THEN concat('CLASS-', version_id % 14) END AS dc,
  CASE WHEN version_id % 10 = 0 THEN CAST(version_id % 15 AS INTEGER) END AS dl FROM v_versions WHERE grade_id IS NULL),
h AS (SELECT DISTINCT o.version_id, g.grade_id FROM o, grades g WHERE regexp_matches(t, concat('(^|[^\\p{{L}}\\p{{N}}_])(', lower(name), '|', lower(code), CASE WHEN level_number IS NOT NULL THEN concat('|class\\s*[-:]?\\s*', level_number, '|grade\\s*[-:]?\\s*', level_number) ELSE '' END, ')($|[^\\p{{L}}\\p{{N}}_])'))),
u AS (SELECT version_id, max(grade_id) AS g FROM h GROUP BY 1 HAVING count(*) = 1)
SELECT o.version_id, coalesce(a.grade_id, b.grade_id, u.g) AS grade_id FROM o LEFT JOIN grades a ON lower(a.code) = lower(dc) LEFT JOIN grades b ON b.level_number = dl LEFT JOIN u ON u.version_id = o.version_id""")
def c16(spark, sf):
    v = views.versions(spark, sf).selectExpr(
        "version_id", "title", "source_filename", "grade_id", "CASE WHEN version_id % 11 = 0 THEN concat('CLASS-', version_id % 14) END AS detected_code",
        "CASE WHEN version_id % 10 = 0 THEN CAST(version_id % 15 AS INT) END AS detected_level",
    )
    return C.backfill_grades(v, _grades(spark, sf))


@query("C21_dimension_upsert", f"""WITH {duck.VERSIONS}, {DIMS}, i AS (SELECT concat('class-', version_id % 20) AS code, concat('Class ', version_id % 20) AS name FROM v_versions)
SELECT code, name FROM grades UNION ALL SELECT code, min(name) FROM i WHERE code NOT IN (SELECT code FROM grades) GROUP BY 1""")
def c21(spark, sf):
    incoming = views.versions(spark, sf).selectExpr("concat('class-', version_id % 20) AS code", "concat('Class ', version_id % 20) AS name")
    return C.upsert_dimension(_grades(spark, sf), incoming, "code", ["code", "name"])


@query("D5_dependency_counts", f"""WITH {duck.TREE}, {duck.BANK}, vs AS (SELECT concat('v', r_regionkey) AS version_id FROM region UNION ALL SELECT 'v9')
SELECT version_id, (SELECT count(*) FROM v_nodes n WHERE n.version_id = vs.version_id) AS n_nodes, (SELECT count(*) FROM v_content n WHERE n.version_id = vs.version_id) AS n_content,
 (SELECT count(*) FROM v_bank b WHERE concat('v', b.created_seq % 7) = vs.version_id) AS n_questions, (SELECT count(*) FROM orders WHERE concat('v', o_orderkey % 6) = vs.version_id) AS n_papers FROM vs""")
def d5(spark, sf):
    vs = table(spark, sf, "region").selectExpr("concat('v', r_regionkey) AS version_id").union(spark.range(1).selectExpr("'v9'"))
    return C.dependency_counts(
        vs, n_nodes=views.nodes(spark, sf), n_content=views.content(spark, sf),
        n_questions=views.bank(spark, sf).selectExpr("concat('v', created_seq % 7) AS version_id"),
        n_papers=table(spark, sf, "orders").selectExpr("concat('v', o_orderkey % 6) AS version_id"),
    )


@query("D7_ingestion_rollup", f"""WITH {NODES_SQL}, rt AS (SELECT book_id, CASE WHEN n_images > 0 AND page_no % 4 = 1 THEN 'ocr' WHEN n_images > 1 AND book_id % 2 = 0 THEN 'best_effort' ELSE 'native' END AS route FROM v_pages),
r AS (SELECT book_id, count_if(route = 'ocr')::BIGINT AS o, count_if(route = 'best_effort')::BIGINT AS w FROM rt GROUP BY 1), b AS (SELECT DISTINCT book_id FROM v_book)
SELECT book_id, coalesce((SELECT count(*) FROM units u WHERE u.book_id = b.book_id), 0) AS n_units, coalesce((SELECT count(*) FROM lessons u WHERE u.book_id = b.book_id), 0) AS n_lessons, coalesce((SELECT count(*) FROM nodes u WHERE u.book_id = b.book_id), 0) AS n_content,
  coalesce(o, 0) AS ocr_pages, coalesce(w, 0) AS n_warnings, CASE WHEN coalesce(w, 0) > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS ingestion_status FROM b LEFT JOIN r USING (book_id)""")
def d7(spark, sf):
    assigned, last = _assigned(spark, sf), _last(spark, sf)
    routes = views.book_pages(spark, sf).selectExpr(
        "book_id", "CASE WHEN n_images > 0 AND page_no % 4 = 1 THEN 'ocr' WHEN n_images > 1 AND book_id % 2 = 0 THEN 'best_effort' ELSE 'native' END AS route"
    ).withColumn("warning", F.when(F.col("route") == "best_effort", "OCR_REQUIRED_BUT_UNAVAILABLE"))
    return C.ingestion_rollup(
        last.select("book_id"), S.unit_rows(assigned, last), S.lesson_rows(assigned, last), S.content_nodes(assigned, domains(spark, sf)), routes
    )


@query("G6_repeated_content", "SELECT sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS content_hash, count(*) AS n_copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def g6(spark, sf):
    return C.repeated_content(table(spark, sf, "documents").select("text"), "text")


@query("G7_checksum_uniqueness", f"WITH {duck.VERSIONS} SELECT checksum, count(*) AS n_active FROM v_versions WHERE NOT is_deleted GROUP BY 1 HAVING count(*) > 1")
def g7(spark, sf):
    return C.checksum_violations(views.versions(spark, sf).select("checksum", "is_deleted"))


GR = "(?i)(?:^|[^\\p{L}\\p{N}_])((?:Class|Grade|Classes|Grades)\\s*[-:]?\\s*([A-Za-z0-9]+(?:\\s*-\\s*[A-Za-z0-9]+)?))($|[^\\p{L}\\p{N}_])"
GR2 = "(?i)(?:^|[^\\p{L}\\p{N}_])(For\\s+Classes?\\s+([A-Za-z0-9]+))($|[^\\p{L}\\p{N}_])"


def grade_sql(t, src):
    parts = []
    for p in (GR, GR2):
        tok = f"trim(regexp_extract({t}, '{p}', 2))"
        first = f"trim(string_split({tok}, '-')[1])"
        num = f"CASE WHEN regexp_matches({first}, '^\\d+$') THEN {first} WHEN {first} = 'IX' THEN '9' WHEN lower({first}) = 'seven' THEN '7' END"
        parts.append(f"CASE WHEN {tok} <> '' AND ({num} IS NOT NULL OR regexp_matches({tok}, '^[\\p{{L}}\\p{{N}}]+$')) THEN {{'n': coalesce({num}, {tok}), 'l': TRY_CAST({num} AS INTEGER), 's': '{src}', 'm': regexp_extract({t}, '{p}', 1)}} END")
    return ", ".join(parts)


@query("H12_grade_detection", f"""WITH {duck.VERSIONS}, d AS (SELECT version_id, coalesce({grade_sql('front_text', 'content')}, {grade_sql('source_filename', 'filename')}) AS g FROM v_versions)
SELECT version_id, concat('class-', lower(g.n)) AS grade_code, 'Class ' || g.n AS grade_name, g.l AS grade_level, g.s AS source, g.m AS matched_text FROM d WHERE g IS NOT NULL""")
def h12(spark, sf):
    g = views.versions(spark, sf).select("version_id", M.detect_grade(F.col("front_text"), F.col("source_filename")).alias("g")).filter("g is not null")
    return g.select("version_id", F.col("g.code").alias("grade_code"), F.col("g.name").alias("grade_name"), F.col("g.level").alias("grade_level"),
                    F.col("g.source").alias("source"), F.col("g.matched_text").alias("matched_text"))


ED_SQL = "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(front_text, '{p}', 1)), '')" for p in M.EDITIONS) + ")"


def year_sql(t, p):
    return f"list_filter([TRY_CAST(z AS INTEGER) FOR z IN regexp_extract_all({t}, '{p}', 1)], lambda z: z BETWEEN 1971 AND 2028)[1]"


@query("H13_edition_year", f"""WITH {duck.VERSIONS}, e AS (SELECT version_id, source_filename, front_text, {ED_SQL} AS label FROM v_versions),
y AS (SELECT version_id, label, TRY_CAST(regexp_extract(label, '{M.LABEL_YEAR}', 1) AS INTEGER) AS a, coalesce({year_sql('front_text', M.YEARS[0])}, {year_sql('front_text', M.YEARS[1])}) AS b, coalesce({year_sql('source_filename', M.YEARS[1])}, {year_sql('source_filename', M.YEARS[0])}) AS c FROM e)
SELECT version_id, label, coalesce(a, b, c) AS year, CASE WHEN a IS NULL AND b IS NULL AND c IS NOT NULL THEN 'filename' WHEN label IS NOT NULL OR b IS NOT NULL THEN 'content' END AS source FROM y""")
def h13(spark, sf):
    e = M.detect_edition(F.col("front_text"), F.col("source_filename"), 2026)
    return views.versions(spark, sf).select("version_id", e.alias("e")).select("version_id", "e.*")


PROFILED = """concat(title, ' ', CASE version_id % 5 WHEN 0 THEN 'theorem proof proof solution exercise unit' WHEN 1 THEN 'tense verb clause sentence verb parts of speech' ELSE '' END)"""


def score_sql(p):
    b = "[^\\p{L}\\p{N}_]"
    s = "0"
    for w in (*p.title_patterns, *p.aliases, p.name):
        s += f" + CASE WHEN regexp_matches(t, '(^|{b}){w.lower()}($|{b})') THEN 50 ELSE 0 END"
    for w in p.keywords:
        s += f" + 5 * len(regexp_extract_all(replace(t, ' ', '  '), '(^|{b}){w.lower().replace(' ', '  ')}($|{b})'))"
    return s


@query("D11_profile_score", f"""WITH {duck.VERSIONS}, x AS (SELECT version_id, lower(concat_ws(' ', regexp_replace(regexp_replace(source_filename, '\\.[^.]*$', ''), '[_\\-]+', ' ', 'g'), source_filename, {PROFILED})) AS t FROM v_versions),
s AS (SELECT version_id, {", ".join(f"CAST({score_sql(p)} AS INTEGER) AS s{i}" for i, p in enumerate(PROFILES))} FROM x)
SELECT version_id, s0, s1, s2, CASE WHEN greatest(s0, s1, s2) < 30 THEN NULL WHEN s0 >= s1 AND s0 >= s2 THEN 'english-for-today' WHEN s1 >= s2 THEN 'english-grammar' ELSE 'mathematics' END AS code FROM s""")
def d11(spark, sf):
    text = M.combined_text(F.expr(PROFILED), F.col("source_filename"))
    scored = views.versions(spark, sf).select("version_id", M.profile_scores(text).alias("p"))
    return scored.select(
        "version_id", *[F.col("p")[i]["score"].alias(f"s{i}") for i in range(3)], M.best_profile(F.col("p"))["code"].alias("code")
    )


@query("H14_title", f"""WITH {duck.VERSIONS}, x AS (SELECT version_id, CASE WHEN version_id % 4 = 0 THEN concat(' Info ', version_id) WHEN version_id % 4 = 1 THEN 'abc' END AS i, CASE WHEN version_id % 3 > 0 THEN 'Mathematics' END AS s,
  CASE WHEN version_id % 3 = 2 THEN 'Class 9' END AS g, regexp_replace(regexp_replace(source_filename, '\\.[^.]*$', ''), '[_\\-]+', ' ', 'g') AS f FROM v_versions)
SELECT version_id, CASE WHEN length(trim(i)) > 3 THEN trim(i) WHEN s IS NOT NULL AND g IS NOT NULL THEN concat(s, ' (', g, ')') WHEN s IS NOT NULL THEN s ELSE array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(f, ' ')], ' ') END AS title FROM x""")
def h14(spark, sf):
    title = M.derive_title(
        F.expr("CASE WHEN version_id % 4 = 0 THEN concat(' Info ', version_id) WHEN version_id % 4 = 1 THEN 'abc' END"),
        F.expr("CASE WHEN version_id % 3 > 0 THEN 'Mathematics' END"), F.expr("CASE WHEN version_id % 3 = 2 THEN 'Class 9' END"), F.col("source_filename"),
    )
    return views.versions(spark, sf).select("version_id", title.alias("title"))


@query("H15_diagnostics")
def h15(spark, sf):
    v = views.versions(spark, sf).select(
        "version_id", "page_count", M.detect_grade(F.col("front_text"), F.col("source_filename")).alias("g"),
        M.detect_edition(F.col("front_text"), F.col("source_filename"), 2026).alias("e"),
        M.best_profile(M.profile_scores(M.combined_text(F.expr(PROFILED), F.col("source_filename")))).alias("p"),
    )
    pages = F.least(F.lit(8).cast("bigint"), F.col("page_count"))
    return v.select("version_id", M.diagnostics(F.col("g"), F.col("e"), F.col("p"), pages).alias("detected_metadata"))


PATCH = "CASE WHEN version_id % 6 = 0 THEN version_id % 15 + 1 END AS p_grade, CASE WHEN version_id % 4 = 0 THEN version_id % 5 + 1 END AS p_subject, CASE WHEN version_id % 9 = 0 THEN concat('New ', version_id) END AS p_title"


@query("J2_metadata_patch", f"""WITH {duck.VERSIONS}, {DIMS}, p AS (SELECT version_id, {PATCH} FROM v_versions WHERE version_id % 3 = 0),
c AS (SELECT p.*, CASE WHEN p_grade IS NOT NULL AND p_grade NOT IN (SELECT grade_id FROM grades) THEN 'GRADE_NOT_FOUND' WHEN p_subject IS NOT NULL AND p_subject NOT IN (SELECT subject_id FROM subjects) THEN 'SUBJECT_NOT_FOUND' END AS error FROM p)
SELECT v.version_id, CASE WHEN c.version_id IS NOT NULL AND error IS NULL THEN coalesce(p_title, title) ELSE title END AS title, CASE WHEN c.version_id IS NOT NULL AND error IS NULL THEN coalesce(p_grade, grade_id) ELSE grade_id END AS grade_id,
  CASE WHEN c.version_id IS NOT NULL AND error IS NULL THEN coalesce(p_subject, subject_id) ELSE subject_id END AS subject_id, CASE WHEN c.version_id IS NOT NULL AND error IS NULL THEN 'USER_CONFIRMED' ELSE metadata_status END AS metadata_status, error
FROM v_versions v LEFT JOIN c ON c.version_id = v.version_id""")
def j2(spark, sf):
    v = views.versions(spark, sf).drop("front_text")
    patches = v.filter("version_id % 3 = 0").selectExpr("version_id", *_cols(PATCH))
    return C.patch_metadata(v, patches, _grades(spark, sf), _subjects(spark, sf))


@query("J3_metadata_refresh", f"""WITH {duck.VERSIONS}, {DIMS}, d AS (SELECT version_id, concat('class-', version_id % 15) AS fg, CASE WHEN version_id % 2 = 0 THEN 'physics' END AS fs, CASE WHEN version_id % 3 <> 0 THEN 2000 + version_id % 20 END AS fy, CASE WHEN version_id % 7 = 0 THEN 'Second' END AS fe FROM v_versions WHERE NOT is_deleted),
x AS (SELECT v.version_id, CASE WHEN version_id % 4 = 0 THEN 1990 + version_id % 9 END AS sy, CASE WHEN version_id % 6 = 0 THEN 'First' END AS se, fe, v.metadata_status AS ms, CASE WHEN metadata_status <> 'USER_CONFIRMED' THEN coalesce(v.grade_id, g.grade_id) ELSE v.grade_id END AS grade_id, CASE WHEN metadata_status <> 'USER_CONFIRMED' THEN coalesce(v.subject_id, s.subject_id) ELSE v.subject_id END AS subject_id, fy
  FROM v_versions v LEFT JOIN d USING (version_id) LEFT JOIN grades g ON g.code = fg LEFT JOIN subjects s ON s.subject_code = fs)
SELECT version_id, grade_id, subject_id, CASE WHEN ms = 'USER_CONFIRMED' OR fy IS NULL THEN sy ELSE fy END AS publication_year, CASE WHEN ms = 'USER_CONFIRMED' OR fe IS NULL THEN se ELSE fe END AS edition, CASE WHEN ms = 'USER_CONFIRMED' THEN ms WHEN grade_id IS NOT NULL AND subject_id IS NOT NULL THEN 'VALID' ELSE 'NEEDS_REVIEW' END AS metadata_status FROM x""")
def j3(spark, sf):
    v = views.versions(spark, sf).drop("front_text").selectExpr(
        "*", "CASE WHEN version_id % 4 = 0 THEN 1990 + version_id % 9 END AS publication_year", "CASE WHEN version_id % 6 = 0 THEN 'First' END AS edition"
    )
    # Nothing is detected in deleted versions, so the outer join is exercised.
    detected = v.filter("not is_deleted").selectExpr(
        "version_id", "concat('class-', version_id % 15) AS found_grade", "CASE WHEN version_id % 2 = 0 THEN 'physics' END AS found_subject",
        "CASE WHEN version_id % 3 <> 0 THEN 2000 + version_id % 20 END AS found_year", "CASE WHEN version_id % 7 = 0 THEN 'Second' END AS found_edition",
    )
    return C.refresh_metadata(v, detected, _grades(spark, sf), _subjects(spark, sf))


@query("J7_lifecycle", f"""WITH {duck.VERSIONS}, x AS (SELECT *, CASE WHEN version_id % 7 = 0 THEN 'boom' END AS err, CASE WHEN NOT is_deleted THEN version_id % 3 END AS nw, CASE WHEN version_id % 2 = 0 THEN 'VALID' ELSE 'NEEDS_REFRESH' END AS gs FROM v_versions),
y AS (SELECT *, CASE WHEN NOT is_deleted AND err IS NOT NULL THEN 'FAILED' WHEN nw IS NULL THEN 'PROCESSING' WHEN nw > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS st FROM x)
SELECT version_id, st AS ingestion_status, CASE WHEN st NOT IN ('COMPLETED', 'PARTIAL') THEN 'BUILDING' WHEN gs = 'VALID' THEN 'VALID' ELSE 'NEEDS_REFRESH' END AS quality_status,
 CASE WHEN metadata_status = 'USER_CONFIRMED' THEN metadata_status WHEN grade_id IS NOT NULL AND subject_id IS NOT NULL THEN 'VALID' ELSE 'NEEDS_REVIEW' END AS metadata_status FROM y""")
def j7(spark, sf):
    v = views.versions(spark, sf).drop("front_text")
    stages = v.filter("not is_deleted").selectExpr("version_id", "CASE WHEN version_id % 7 = 0 THEN 'boom' END AS error", "version_id % 3 AS n_warnings")
    gates = v.selectExpr("version_id", "CASE WHEN version_id % 2 = 0 THEN 'VALID' ELSE 'NEEDS_REFRESH' END AS gate_status")
    return C.lifecycle(v, stages, gates)


