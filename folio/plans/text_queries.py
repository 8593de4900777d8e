"""Queries over text expressions: B1, B4-B8, B13, H1-H11, H16-H18, H20-H23."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import numbers, text, titles
from folio.plans import duck
from folio.plans.registry import query
from folio.runtime import table
from folio.sources import views

KEY = ["book_id", "page_no", "line_no"]
KEYS = ", ".join(KEY)

MESSY = "concat(chr(160), text, ' – — x', chr(7), chr(65533), '  y', chr(8212))"


@query("H1_heading_cleanup", f"""WITH {duck.BOOK}, m AS (SELECT {KEYS}, concat(chr(160), text, ' – — x', chr(7), chr(65533), '  y', chr(8212)) AS t FROM v_book)
SELECT {KEYS}, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(t, chr(160), ' '), '[–—]', ' — ', 'g'),
  '[\\x{{fffd}}\\x{{00}}-\\x{{1f}}\\x{{7f}}-\\x{{9f}}]', '', 'g'), '\\s+', ' ', 'g'), '—\\s*—+', '—', 'g')) AS cleaned FROM m""")
def h1(spark, sf):
    raw = views.book_lines(spark, sf).select(
        *KEY, F.concat(F.lit(" "), "text", F.lit(" – — x\u0007�  y—")).alias("t")
    )
    return raw.select(*KEY, text.clean_heading(F.col("t")).alias("cleaned"))


SP = numbers.SPACE.replace("{", "{{").replace("}", "}}")
ND = numbers.DIGIT.replace("{", "{{").replace("}", "}}")
RUNNING = f"""trim(regexp_replace(regexp_replace(lower(trim(regexp_replace({{0}}, '{SP}+', ' ', 'g'))), '^{ND}+ *', ''), ' *{ND}+$', ''))"""
PAGE_NO = f"""(regexp_matches({{0}}, '^{ND}+$') OR regexp_matches({{0}}, '(?i)^page{SP}+{ND}+$') OR regexp_matches({{0}}, '^{ND}+{SP}*[-/]{SP}*{ND}+$'))"""


# Lines with no-break spaces and numbers in digits of another script.
HEADED = "CASE line_no % 3 WHEN 0 THEN concat('১২', chr(160), text) WHEN 1 THEN concat(text, chr(160), ' ', page_no) ELSE text END"


@query("H2_running_text_key", f"WITH {duck.BOOK} SELECT {KEYS}, {RUNNING.format(HEADED)} AS running_key FROM v_book")
def h2(spark, sf):
    return views.book_lines(spark, sf).select(*KEY, text.running_text_key(F.expr(HEADED)).alias("running_key"))


PAGE_FORMS = """CASE line_no % 7 WHEN 5 THEN '১২' WHEN 6 THEN concat('page', chr(160), line_no, chr(160)) WHEN 0 THEN CAST(line_no AS STRING) WHEN 1 THEN concat('Page ', line_no)
  WHEN 2 THEN concat(line_no, ' - ', page_no) WHEN 3 THEN concat(line_no, '/', page_no) ELSE text END"""


@query("H3_page_number", f"""WITH {duck.BOOK}, m AS (SELECT {KEYS}, {PAGE_FORMS} AS raw FROM v_book), t AS (SELECT *, regexp_replace(raw, '^{numbers.SPACE}+|{numbers.SPACE}+$', '', 'g') AS t FROM m)
SELECT {KEYS}, {PAGE_NO.format('t')} AS is_number FROM t""")
def h3(spark, sf):
    forms = views.book_lines(spark, sf).selectExpr(*KEY, f"{PAGE_FORMS} AS t")
    return forms.select(*KEY, text.is_page_number(F.col("t")).alias("is_number"))


TOKENS = """CASE p_partkey % 9 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN concat(p_size, '.', p_partkey % 7, ' ')
  WHEN 2 THEN CASE p_size % 6 WHEN 0 THEN 'XIV' WHEN 1 THEN 'xlii' WHEN 2 THEN 'MCMXCIX' WHEN 3 THEN 'IX:' WHEN 4 THEN 'vv' ELSE 'D' END
  WHEN 3 THEN CASE p_size % 5 WHEN 0 THEN 'twenty-five' WHEN 1 THEN 'one hundred and two' WHEN 2 THEN 'Nineteen.'
     WHEN 3 THEN 'two thousand three hundred forty' ELSE 'hundred' END
  WHEN 4 THEN p_name WHEN 5 THEN ' seventh ' WHEN 6 THEN '—' WHEN 7 THEN concat(p_size, '.') WHEN 8 THEN CASE p_size % 2 WHEN 0 THEN 'hundred-hundred-hundred-hundred-hundred' ELSE '{LONG}' END ELSE 'and' END"""
TOKENS = TOKENS.replace('{LONG}', '-'.join(['thousand'] * 3 + ['hundred'] * 25))

H4_SQL = f"""WITH t AS (SELECT p_partkey, regexp_replace(regexp_replace({TOKENS}, '^\\s+|\\s+$', '', 'g'), '[.:\\-—]+$', '') AS b FROM part),
r AS (SELECT p_partkey, b, upper(b) AS u, [CASE x WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100
   WHEN 'D' THEN 500 ELSE 1000 END FOR x IN string_split(upper(b), '')] AS v,
  list_filter(string_split_regex(regexp_replace(lower(b), '[^a-z\\s\\-]', ' ', 'g'), '[\\s\\-]+'), lambda x: x <> '' AND x <> 'and') AS ws FROM t),
m AS (SELECT MAP {{'zero': 0, 'one': 1, 'two': 2, 'three': 3, 'four': 4, 'five': 5, 'six': 6, 'seven': 7, 'eight': 8, 'nine': 9, 'ten': 10,
  'nineteen': 19, 'seventh': 7, 'twenty': 20, 'forty': 40, 'hundred': 100, 'thousand': 1000}} AS d),
n AS (SELECT p_partkey, b, u, v, ws, [{{'t': 0::DOUBLE, 'c': 0::DOUBLE, 'k': d[w]::DOUBLE}} FOR w IN ws] AS ks FROM r, m),
f AS (SELECT p_partkey, b, u,
  list_sum([v[i] * CASE WHEN coalesce(list_max(v[i+1:]), 0) > v[i] THEN -1 ELSE 1 END FOR i IN range(1, len(v) + 1)]) AS roman,
  CASE WHEN len(ks) > 0 AND len(list_filter(ks, lambda x: x.k IS NULL)) = 0 THEN
    list_reduce(ks, lambda a, x: {{'t': CASE WHEN x.k = 1000 THEN a.t + (CASE WHEN a.c = 0 THEN 1 ELSE a.c END) * 1000 ELSE a.t END,
      'c': CASE WHEN x.k = 1000 THEN 0 WHEN x.k = 100 THEN (CASE WHEN a.c = 0 THEN 1 ELSE a.c END) * 100 ELSE a.c + x.k END, 'k': 0::DOUBLE}},
      {{'t': 0::DOUBLE, 'c': 0::DOUBLE, 'k': 0::DOUBLE}}) END AS words FROM n)
SELECT p_partkey, c AS canonical, TRY_CAST(string_split(c, '.')[1] AS INTEGER) AS leading_number FROM (
 SELECT p_partkey, CASE WHEN b = '' THEN NULL WHEN regexp_matches(b, '^\\d+(\\.\\d+)*$') THEN b
  WHEN regexp_matches(u, '^[IVXLCDM]+$') THEN CAST(roman AS VARCHAR) WHEN words.t + words.c < 1e38 THEN CAST(CAST(words.t + words.c AS HUGEINT) AS VARCHAR) END AS c FROM f)"""


@query("H4_number_token", H4_SQL)
def h4(spark, sf):
    tokens = table(spark, sf, "part").selectExpr("p_partkey", f"{TOKENS} AS token")
    return tokens.select(
        "p_partkey",
        numbers.canonical_token(F.col("token")).alias("canonical"),
        numbers.leading_int(F.col("token")).alias("leading_number"),
    )


STEM_KEY = """trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s$\\\\]', ' ', 'g'), '\\s+', ' ', 'g'))"""


@query("H5_stem_key", f"WITH {duck.BANK} SELECT question_id, {STEM_KEY.format('stem')} AS stem_key FROM v_bank")
def h5(spark, sf):
    return views.bank(spark, sf).select("question_id", text.stem_key(F.col("stem")).alias("stem_key"))


SPACED = "CASE WHEN doc_id % 2 = 0 THEN concat(chr(160), ' ', text, chr(160), ' end', chr(160)) ELSE text END"


@query("H6_content_hash", f"SELECT doc_id, sha256(trim(regexp_replace({SPACED}, '{numbers.SPACE}+', ' ', 'g'))) AS content_hash FROM documents")
def h6(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.content_hash(F.expr(SPACED)).alias("content_hash"))


MARKS = "(length({0}) - length(regexp_replace({0}, '[\\${{}}\\[\\]<>=\\\\_^*#]', '', 'g')))"
TOKENS_OF = """CAST(CASE WHEN {c} = 0 THEN 0 ELSE greatest(1, ceil({c}::DOUBLE / 3.4::DOUBLE) + ceil({m}::DOUBLE * 0.4::DOUBLE)) END AS BIGINT)"""


@query("H7_token_estimate", f"""SELECT page_id, {TOKENS_OF.format(c='length(html)', m=MARKS.format('html'))} AS est_tokens,
  {TOKENS_OF.format(c='length(html)', m=MARKS.format('html'))} + 510 + 120 AS prompt_tokens FROM pages""")
def h7(spark, sf):
    est = text.estimate_tokens(F.col("html"))
    return table(spark, sf, "pages").select(
        "page_id", est.alias("est_tokens"),
        text.prompt_tokens(F.lit(120).cast("bigint"), est).alias("prompt_tokens"),
    )


@query("H9_bold_italic", f"""WITH {duck.WORDS} SELECT {KEYS}, span_no,
  ((flags & 16) > 0 OR contains(lower(font), 'bold') OR contains(lower(font), 'black')) AS is_bold,
  ((flags & 2) > 0 OR contains(lower(font), 'italic') OR contains(lower(font), 'oblique')) AS is_italic FROM v_spans""")
def h9(spark, sf):
    return views.book_spans(spark, sf).select(
        *KEY, "span_no", text.is_bold(F.col("flags"), F.col("font")).alias("is_bold"),
        text.is_italic(F.col("flags"), F.col("font")).alias("is_italic"),
    )


FORMULA = """CASE line_no % 6 WHEN 0 THEN concat('√', line_no, ' = 5') WHEN 1 THEN concat(' 5 x ', line_no, ' = 25')
  WHEN 2 THEN concat(line_no, ' × 3 ÷ 2 = 36') WHEN 3 THEN concat('The square root of ', line_no, ' is 5.')
  WHEN 4 THEN 'a + b' ELSE text END"""


@query("H10_inline_math", f"""WITH {duck.BOOK}, m AS (SELECT {KEYS}, {FORMULA} AS t FROM v_book)
SELECT {KEYS}, t, CASE WHEN contains(t, '√') THEN regexp_replace(replace(t, '√', '\\sqrt{{'), '\\\\sqrt\\{{(\\d+)', '\\\\sqrt{{\\1}}', 'g')
  WHEN regexp_matches(trim(t), '^[a-zA-Z0-9()^\\s+\\-*/×÷.,:]+\\s*=\\s*[a-zA-Z0-9()^\\s+\\-*/×÷.,]+$')
  THEN replace(replace(trim(t), '×', ' \\times '), '÷', ' \\div ') END AS latex FROM m""")
def h10(spark, sf):
    m = views.book_lines(spark, sf).selectExpr(*KEY, f"{FORMULA} AS t")
    return m.select(*KEY, "t", text.math_latex(F.col("t")).alias("latex"))


MIXED_DUCK = """CASE line_no % 3 WHEN 0 THEN concat(left(text, 10), ' $x + ', line_no, '$ and $$ y^2 $$', right(text, 5))
  WHEN 1 THEN concat('$a$', '\\(z_1\\)', left(text, 8)) ELSE text END"""


@query("H11_math_segments", f"""WITH {duck.BOOK}, m AS (SELECT {KEYS}, {MIXED_DUCK} AS t FROM v_book),
p AS (SELECT {KEYS}, string_split_regex(t, '\\$\\$[\\s\\S]*?\\$\\$|\\$[^$]+?\\$|\\\\\\([\\s\\S]*?\\\\\\)') AS prose,
  regexp_extract_all(t, '\\$\\$[\\s\\S]*?\\$\\$|\\$[^$]+?\\$|\\\\\\([\\s\\S]*?\\\\\\)') AS found FROM m),
s AS (SELECT {KEYS}, prose, [CASE WHEN starts_with(x, '$$') THEN concat('display-math:', trim(x[3:length(x)-2]))
  WHEN starts_with(x, '$') THEN concat('math:', trim(x[2:length(x)-1])) ELSE concat('math:', trim(x[3:length(x)-2])) END FOR x IN found] AS f FROM p)
SELECT {KEYS}, array_to_string(list_filter(flatten([[CASE WHEN prose[i] <> '' THEN concat('text:', prose[i]) END, f[i]] FOR i IN range(1, len(prose) + 1)]),
  lambda z: z IS NOT NULL), '|') AS segments, CAST(len(list_filter(prose, lambda z: z <> '')) + len(f) AS INTEGER) AS n_segments FROM s""")
def h11(spark, sf):
    mixed = F.expr("""CASE line_no % 3 WHEN 0 THEN concat(left(text, 10), ' $x + ', line_no, '$ and $$ y^2 $$', right(text, 5))
      WHEN 1 THEN concat('$a$', '\\\\(z_1\\\\)', left(text, 8)) ELSE text END""")
    parts = views.book_lines(spark, sf).select(*KEY, text.math_segments(mixed).alias("s"))
    return parts.select(
        *KEY, F.array_join(F.transform("s", lambda x: F.concat(x["kind"], F.lit(":"), x["content"])), "|").alias("segments"),
        F.size("s").alias("n_segments"),
    )


@query("H20_snippet", """SELECT doc_id, CASE WHEN length(text) > 200 THEN concat(substr(text, 1, 200), '...') ELSE text END AS snippet,
  sha256(text) AS source_hash FROM documents""")
def h20(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.snippet(F.col("text")).alias("snippet"), F.sha2("text", 256).alias("source_hash")
    )


@query("H21_log_scrub", """SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  concat('fail ', url, ' org_', page_id, 'Ab  gsk_k', page_id, ' ', html), 'https?://\\S+', '', 'g'), 'org_[a-zA-Z0-9]+', '', 'g'),
  'gsk_[a-zA-Z0-9]+', '[REDACTED]', 'g'), '\\s+', ' ', 'g')) AS message FROM pages""")
def h21(spark, sf):
    raw = F.expr("concat('fail ', url, ' org_', page_id, 'Ab  gsk_k', page_id, ' ', html)")
    return table(spark, sf, "pages").select("page_id", text.scrub_message(raw).alias("message"))


WAITS = """CASE event_id % 7 WHEN 0 THEN concat('Rate limit: try again in ', event_id % 60, 'm', user_id % 60, '.5s')
  WHEN 1 THEN concat('Try again in 1h', event_id % 60, 'm3s') WHEN 2 THEN concat('try again in ', event_id % 90, ' minutes')
  WHEN 3 THEN concat('try again in ', event_id % 90, '.25 seconds') WHEN 4 THEN 'try again in 34m'
  WHEN 5 THEN 'try again in 0s' ELSE 'broken pipe' END"""


@query("H22_wait_seconds", f"""WITH m AS (SELECT event_id, lower({WAITS}) AS t FROM events),
x AS (SELECT event_id, t, regexp_extract(t, 'try again in (?:(\\d+)h)?(?:(\\d+)m)?(?:(\\d+\\.?\\d*)s)?', ['h','m','s']) AS g FROM m),
y AS (SELECT event_id, t, coalesce(TRY_CAST(g.h AS DOUBLE), 0) * 3600 + coalesce(TRY_CAST(g.m AS DOUBLE), 0) * 60
  + coalesce(TRY_CAST(g.s AS DOUBLE), 0) AS total FROM x)
SELECT event_id, CASE WHEN total > 0 THEN total ELSE coalesce(TRY_CAST(regexp_extract(t, 'try again in (\\d+\\.?\\d*)\\s*(?:m|min|minutes)', 1) AS DOUBLE) * 60,
  TRY_CAST(regexp_extract(t, 'try again in (\\d+\\.?\\d*)\\s*(?:s|sec|seconds)', 1) AS DOUBLE), 60) END AS wait_seconds FROM y""")
def h22(spark, sf):
    return table(spark, sf, "events").select("event_id", text.retry_seconds(F.expr(WAITS)).alias("wait_seconds"))


@query("H23_subject_route", f"""WITH {duck.VERSIONS} SELECT version_id, CASE WHEN contains(lower(title), 'grammar') THEN 'english_grammar'
  WHEN contains(lower(title), 'english for today') THEN 'english_for_today' WHEN contains(lower(title), 'math') THEN 'mathematics'
  ELSE coalesce(CASE subject_id WHEN 1 THEN 'english-for-today' WHEN 2 THEN 'physics' END, 'mathematics') END AS route FROM v_versions""")
def h23(spark, sf):
    code = F.expr("CASE subject_id WHEN 1 THEN 'English-for-Today' WHEN 2 THEN 'Physics' END")
    return views.versions(spark, sf).select("version_id", text.subject_route(F.col("title"), code).alias("route"))


# -- predicates -------------------------------------------------------------------------------------------------

@query("B1_native_quality", """WITH t AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, (length(t) >= 40 AND len(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')) >= 8 AND
  length(regexp_replace(t, '[^\\p{L}]', '', 'g'))::DOUBLE / length(t) >= 0.5) AS is_good FROM t""")
def b1(spark, sf):
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return table(spark, sf, "documents").select("doc_id", text.is_good_native_text(F.col("text"), n).alias("is_good"))


@query("B4_contents_page", f"""WITH {duck.BOOK} SELECT book_id, page_no, bool_or(regexp_matches(lower(text), '^(contents|table of contents|index|content)$')
  OR starts_with(lower(text), 'table of contents') OR starts_with(lower(text), 'contents')) AS is_contents
FROM v_book WHERE line_no <= 5 GROUP BY book_id, page_no""")
def b4(spark, sf):
    head = views.book_lines(spark, sf).filter("line_no <= 5")
    return head.groupBy("book_id", "page_no").agg(
        F.max(titles.is_contents_marker(F.col("text"))).alias("is_contents")
    )


@query("B5_contents_entry", f"""WITH {duck.BOOK} SELECT {KEYS}, regexp_matches(text,
  '(?i)(\\.{{3,}}|_{{3,}}|-{{3,}})\\s*(page\\s*)?\\d+($|[^\\p{{L}}\\p{{N}}_])|(^|[^\\p{{L}}\\p{{N}}_])page\\s+\\d+$') AS is_entry FROM v_book""")
def b5(spark, sf):
    return views.book_lines(spark, sf).select(*KEY, titles.is_contents_entry(F.col("text")).alias("is_entry"))


NUMBER = "CASE page_no % 3 WHEN 0 THEN CAST(line_no AS STRING) WHEN 1 THEN split_part(text, ' ', 1) ELSE split_part(text, ' ', 2) END"
STOP = ", ".join(f"'{w}'" for w in titles.NOT_A_NUMBER + titles.LABEL_WORDS)


@query("B6_unit_number", f"""WITH {duck.BOOK}, m AS (SELECT {KEYS}, trim({NUMBER}) AS n FROM v_book)
SELECT {KEYS}, CASE WHEN n IS NULL OR n = '' THEN true WHEN lower(n) = 'unit' OR lower(n) IN ({STOP}) THEN false
  ELSE regexp_matches(n, '(?i)^(\\d+|[IVXLCDM]+|[A-Za-z])$') END AS is_valid FROM m""")
def b6(spark, sf):
    m = views.book_lines(spark, sf).selectExpr(*KEY, f"{NUMBER} AS n")
    return m.select(*KEY, titles.is_unit_number(F.col("n"), F.lit("Unit")).alias("is_valid"))


TITLE = """CASE (page_no + line_no) % 6 WHEN 0 THEN concat('and ', text) WHEN 1 THEN concat('x = ', line_no) WHEN 2 THEN left(text, 2)
  WHEN 3 THEN left(text, 30) WHEN 4 THEN concat('A = x', line_no, ' + ', left(text, 10)) ELSE text END"""
CLEAN = """trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({0}, chr(160), ' '), '[–—]', ' — ', 'g'),
  '[\\x{{fffd}}\\x{{00}}-\\x{{1f}}\\x{{7f}}-\\x{{9f}}]', '', 'g'), '\\s+', ' ', 'g'), '—\\s*—+', '—', 'g'))"""
UNIT_TITLE = """({0} <> '' AND NOT (regexp_matches({0}, '^\\d+$') OR regexp_matches({0},
  '(?i)^(and|or|but|which|that|filled in|equal to|moving left|is|are)($|[^\\p{{L}}\\p{{N}}_])') OR length({0}) > 100
  OR (regexp_matches({0}, '[=+−*/]') AND regexp_matches({0}, '(?i)[a-z]\\s*=\\s*[a-z0-9]')) OR length({0}) <= 2))"""
LESSON_TITLE = """({0} <> '' AND NOT (regexp_matches({0}, '(?i)^(and|or|but|which|that|is|are)($|[^\\p{{L}}\\p{{N}}_])')
  OR regexp_matches({0}, '^[A-Za-z]\\s*=\\s*') OR (regexp_matches({0}, '[=−]') AND length({0}) < 30 AND regexp_matches({0}, '\\d'))
  OR length({0}) > 120))"""


@query("B7_unit_title", f"""WITH {duck.BOOK}, m AS (SELECT {KEYS}, {CLEAN.format(TITLE)} AS t FROM v_book)
SELECT {KEYS}, {UNIT_TITLE.format('t')} AS is_valid FROM m""")
def b7(spark, sf):
    m = views.book_lines(spark, sf).selectExpr(*KEY, f"{TITLE} AS t")
    return m.select(*KEY, titles.is_unit_title(F.col("t")).alias("is_valid"))


@query("B8_lesson_title", f"""WITH {duck.BOOK}, m AS (SELECT {KEYS}, {CLEAN.format(TITLE)} AS t FROM v_book)
SELECT {KEYS}, {LESSON_TITLE.format('t')} AS is_valid FROM m""")
def b8(spark, sf):
    m = views.book_lines(spark, sf).selectExpr(*KEY, f"{TITLE} AS t")
    return m.select(*KEY, titles.is_lesson_title(F.col("t")).alias("is_valid"))


@query("B13_stem_complete", f"""WITH {duck.CANDIDATES} SELECT question_id, (length(trim(stem)) >= 8
  AND length(regexp_replace(stem, '[^a-zA-Z]', '', 'g')) >= 4) AS is_complete FROM v_candidates""")
def b13(spark, sf):
    return views.candidates(spark, sf).select("question_id", text.is_stem_complete(F.col("stem")).alias("is_complete"))


EXERCISE_SQL = """CASE WHEN regexp_matches(low, '^({starters})') AND NOT regexp_matches(fl, '(?i)^Exercise($|[^\\p{{L}}\\p{{N}}_])') THEN NULL
  WHEN stated <> '' THEN CASE WHEN (maj <> '' AND maj <> ch AND (mnr <> '' OR abs(TRY_CAST(maj AS INTEGER) - TRY_CAST(ch AS INTEGER)) > 1)) THEN NULL ELSE stated END
  ELSE coalesce(CASE WHEN oa <> '' AND TRY_CAST(ob AS INTEGER) <= 20 AND oa = ch THEN concat('Exercise ', oa, '.', ob)
     WHEN sn <> '' AND abs(TRY_CAST(sn AS INTEGER) - TRY_CAST(ch AS INTEGER)) <= 1 THEN concat('Exercise ', sn) END,
     CASE WHEN regexp_matches(fl, '(?i)^Exercise\\s*[:.\\-—]?$') AND length(fl) <= 15 THEN 'Exercise' END) END"""


def exercise_ctes(source: str, keys: str, txt: str, chapter: str) -> str:
    """Checking SQL of H16 for one-line texts: CTEs ending in `ex` with column exercise_label."""
    starters = "|".join(s.replace("(", "\\(").replace(".", "\\.") for s in titles.QUESTION_STARTERS)
    return f"""e0 AS (SELECT {keys}, {CLEAN.format(txt)} AS fl, lower({CLEAN.format(txt)}) AS low, {txt} AS raw, {chapter} AS ch FROM {source}),
e1 AS (SELECT *, {CLEAN.format("regexp_extract(fl, '(?i)(?:^|[^\\p{L}\\p{N}_])(Exercise\\s+\\d{1,2}\\.\\d{1,2}|Practice\\s+\\d{1,2}\\.\\d{1,2}|Exercise\\s+[A-Za-z]|Practice\\s+Problems?\\s*\\d*)(?:$|[^\\p{L}\\p{N}_])', 1)")} AS stated,
  regexp_extract(raw, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])Exercise\\s+(\\d{{1,2}})[0.\\-·•°\\x{{fffd}}\\s]+(\\d{{1,2}})(?:$|[^\\p{{L}}\\p{{N}}_])', 1) AS oa,
  regexp_extract(raw, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])Exercise\\s+(\\d{{1,2}})[0.\\-·•°\\x{{fffd}}\\s]+(\\d{{1,2}})(?:$|[^\\p{{L}}\\p{{N}}_])', 2) AS ob,
  regexp_extract(raw, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])Exercise\\s+(\\d{{1,2}})(?:$|[^\\p{{L}}\\p{{N}}_])', 1) AS sn FROM e0),
e2 AS (SELECT *, regexp_extract(stated, '(\\d+)(?:\\.(\\d+))?', 1) AS maj, regexp_extract(stated, '(\\d+)(?:\\.(\\d+))?', 2) AS mnr FROM e1),
ex AS (SELECT {keys}, {EXERCISE_SQL.format(starters=starters)} AS exercise_label FROM e2)"""


@query("H16_exercise_label", f"""WITH {duck.BOOK}, {exercise_ctes('v_book', KEYS, 'text', 'CAST(page_no AS VARCHAR)')} SELECT * FROM ex""")
def h16(spark, sf):
    label = titles.exercise_label(F.col("text"), F.lit(None).cast("string"), F.col("page_no").cast("string"))
    return views.book_lines(spark, sf).select(*KEY, label.alias("exercise_label"))


@query("H17_node_kind", f"""WITH {duck.VERSIONS} SELECT version_id, CASE WHEN lab = 'Chapter' OR contains(lower(title), 'math') THEN 'chapter'
  WHEN lab = 'Part' THEN 'part' ELSE 'unit' END AS node_type, concat(CASE WHEN lab = 'Chapter' OR contains(lower(title), 'math') THEN 'Chapter'
  WHEN lab = 'Part' THEN 'Part' ELSE 'Unit' END, CASE WHEN version_id % 5 = 0 THEN '' ELSE concat(' ', version_id % 5) END) AS source_label FROM
  (SELECT *, CASE version_id % 3 WHEN 0 THEN 'Unit' WHEN 1 THEN 'Part' ELSE 'Chapter' END AS lab FROM v_versions)""")
def h17(spark, sf):
    v = views.versions(spark, sf).withColumn(
        "lab", F.expr("CASE version_id % 3 WHEN 0 THEN 'Unit' WHEN 1 THEN 'Part' ELSE 'Chapter' END")
    ).withColumn("num", F.expr("CASE WHEN version_id % 5 = 0 THEN '' ELSE CAST(version_id % 5 AS STRING) END"))
    kind = titles.node_kind(F.col("lab"), F.col("title"))
    return v.select("version_id", kind.alias("node_type"), titles.source_label(kind, F.col("num")).alias("source_label"))


@query("H18_contents_label", f"""WITH {duck.BOOK}, m AS (SELECT {KEYS}, CAST(page_no AS VARCHAR) AS n, text AS t FROM v_book)
SELECT {KEYS}, CASE WHEN starts_with(lower(t), concat('chapter ', n)) OR starts_with(lower(t), concat('unit ', n)) THEN {CLEAN.format('t')}
   ELSE concat('Unit ', n, ' — ', {CLEAN.format('t')}) END AS unit_label,
  CASE WHEN starts_with(t, n) THEN {CLEAN.format('t')} ELSE concat(n, ' ', {CLEAN.format('t')}) END AS lesson_label FROM m""")
def h18(spark, sf):
    n, t = F.col("page_no").cast("string"), F.col("text")
    return views.book_lines(spark, sf).select(
        *KEY, titles.contents_label(n, F.lit("Unit"), t).alias("unit_label"), titles.lesson_label(n, t).alias("lesson_label")
    )
