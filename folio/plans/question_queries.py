"""Queries over candidates: B14, B15, C9, C17, C18, D8, D15, E18-E21, G1, G2, H31."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import generation
from folio.operators import questions as Q
from folio.operators import similar
from folio.plans import duck
from folio.plans.registry import query
from folio.plans.text_queries import STEM_KEY
from folio.sources import views

CHUNKS = "['SRC-0', 'SRC-1', 'SRC-2', 'SRC-3', 'SRC-4', 'SRC-5']"
ARITH = """(coalesce(regexp_matches(ans, '^\\d+$') AND TRY_CAST(regexp_extract(stem, '(?i)square\\s+of\\s+(\\d+)', 1) AS BIGINT) IS NOT NULL
  AND ans <> CAST(TRY_CAST(regexp_extract(stem, '(?i)square\\s+of\\s+(\\d+)', 1) AS BIGINT) * TRY_CAST(regexp_extract(stem, '(?i)square\\s+of\\s+(\\d+)', 1) AS BIGINT) AS VARCHAR), false)
 OR coalesce(regexp_matches(ans, '^\\d+$') AND TRY_CAST(regexp_extract(stem, '(?i)square\\s+root\\s+of\\s+(\\d+)', 1) AS BIGINT) IS NOT NULL
  AND CAST(round(sqrt(TRY_CAST(regexp_extract(stem, '(?i)square\\s+root\\s+of\\s+(\\d+)', 1) AS DOUBLE))) AS BIGINT) ** 2 = TRY_CAST(regexp_extract(stem, '(?i)square\\s+root\\s+of\\s+(\\d+)', 1) AS BIGINT)
  AND ans <> CAST(CAST(round(sqrt(TRY_CAST(regexp_extract(stem, '(?i)square\\s+root\\s+of\\s+(\\d+)', 1) AS DOUBLE))) AS BIGINT) AS VARCHAR), false))"""
RULES = f"""CASE WHEN trim(stem) = '' THEN 'schema_rejected'
  WHEN NOT (length(trim(stem)) >= 8 AND length(regexp_replace(stem, '[^a-zA-Z]', '', 'g')) >= 4) THEN 'other_rejected'
  WHEN {{dup}} THEN 'exact_question_duplicate_rejected'
  WHEN len(options) <> 4 THEN 'invalid_option_count'
  WHEN len(list_distinct([o.id FOR o IN options])) <> 4 THEN 'duplicate_option_rejected'
  WHEN len(list_distinct([o.text FOR o IN options])) <> 4 THEN 'duplicate_option_rejected'
  WHEN NOT list_contains([o.id FOR o IN options], correct_option_id) THEN 'invalid_correct_option_id'
  WHEN trim(explanation) = '' THEN 'other_rejected'
  WHEN len(source_chunk_ids) = 0 OR len(list_filter(source_chunk_ids, lambda x: NOT list_contains({CHUNKS}, x))) > 0 THEN 'invalid_source_chunk_rejected'
  WHEN {ARITH} THEN 'deterministic_math_rejected' END"""
ANSWER = "list_filter(options, lambda o: o.id = correct_option_id)[1].text"


def _valid_chunks():
    return F.array(*[F.lit(f"SRC-{i}") for i in range(6)])


@query("B14_candidate_rules", f"""WITH {duck.CANDIDATES}, a AS (SELECT *, {ANSWER} AS ans FROM v_candidates)
SELECT question_id, {RULES.replace('{dup}', 'false')} AS category FROM a""")
def b14(spark, sf):
    return views.candidates(spark, sf).select("question_id", Q.first_failure(_valid_chunks()).alias("category"))


ROOTED = "CASE WHEN seq % 2 = 0 THEN concat('What is the Square  root of ', seq, '?') ELSE stem END"


@query("B15_arithmetic_check", f"""WITH {duck.CANDIDATES}, a AS (SELECT question_id, {ROOTED} AS stem, CASE WHEN seq % 4 = 0 THEN CAST(seq % 12 AS VARCHAR) ELSE {ANSWER} END AS ans FROM v_candidates)
SELECT question_id, {ARITH} AS fails FROM a""")
def b15(spark, sf):
    answer = F.when(F.col("seq") % 4 == 0, (F.col("seq") % 12).cast("string")).otherwise(
        Q.declared_answer(F.col("options"), F.col("correct_option_id"))
    )
    return views.candidates(spark, sf).select("question_id", Q.arithmetic_fails(F.expr(ROOTED), answer).alias("fails"))


@query("C9_citation_grounding", f"""WITH {duck.CANDIDATES}, ch AS (SELECT DISTINCT job_id, concat('SRC-', seq % 5) AS chunk_id FROM v_candidates WHERE seq % 11 < 4),
x AS (SELECT job_id, question_id, unnest(source_chunk_ids) AS chunk_id FROM v_candidates) SELECT * FROM x ANTI JOIN ch USING (job_id, chunk_id)""")
def c9(spark, sf):
    cands = views.candidates(spark, sf)
    chunks = cands.filter("seq % 11 < 4").selectExpr("job_id", "concat('SRC-', seq % 5) AS chunk_id")
    return Q.ungrounded_citations(cands, chunks, ["job_id"]).select("job_id", "question_id", "chunk_id")


@query("G1_exact_dedup", f"""WITH {duck.CANDIDATES}, k AS (SELECT job_id, seq, question_id, {STEM_KEY.format('stem')} AS stem_key FROM v_candidates)
SELECT job_id, stem_key, min(seq) AS seq, arg_min(question_id, seq) AS question_id FROM k GROUP BY ALL""")
def g1(spark, sf):
    return Q.exact_first(views.candidates(spark, sf), ["job_id"])


@query("C17_prior_exclusion", f"""WITH {duck.CANDIDATES}, k AS (SELECT seq, question_id, {STEM_KEY.format('stem')} AS stem_key FROM v_candidates)
SELECT question_id, stem_key FROM k WHERE seq % 2 = 0 AND stem_key NOT IN (SELECT stem_key FROM k WHERE seq % 2 = 1)""")
def c17(spark, sf):
    cands = views.candidates(spark, sf)
    return Q.without_prior(cands.filter("seq % 2 = 0"), cands.filter("seq % 2 = 1")).select("question_id", "stem_key")


WORDED = """concat('Explain how this ', p_name, ' differs from ', p_type, ' products made under Brand ', p_size % 5,
  ' while keeping retail price near agreed level and shipping every single order before monthly closing date across ',
  'selected sales regions under normal market conditions')"""
NEAR = f"""WITH w AS (SELECT p_partkey AS seq, concat('job_', CAST(floor(p_partkey / 50) AS BIGINT)) AS job_id, {WORDED} AS stem FROM part),
k AS (SELECT job_id, {STEM_KEY.format('stem')} AS stem_key, min(seq) AS seq FROM w GROUP BY ALL),
d AS (SELECT job_id, seq, stem_key, regexp_extract_all(stem_key, '\\d+') AS nums, list_distinct(list_filter(string_split(stem_key, ' '), lambda x: length(x) > 1
   AND x NOT IN ({", ".join(f"'{w}'" for w in similar.STOP_WORDS)}))) AS words FROM k)"""


@query("C18_near_duplicate_words", f"""{NEAR}
SELECT a.job_id, a.seq, min(b.seq) AS first_seen FROM d a JOIN d b ON a.job_id = b.job_id AND a.seq % 3 <> 0 AND b.seq % 3 = 0
  AND (a.nums = b.nums OR len(a.nums) = 0 OR len(b.nums) = 0)
  AND len(list_intersect(a.words, b.words)) >= 0.82::DOUBLE * (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))) GROUP BY ALL""")
def c18_words(spark, sf):
    worded = _worded(spark, sf)
    firsts = similar.distinct_stems(worded, ["job_id"]).withColumnRenamed("stem_key", "stem")
    return similar.first_match(firsts.filter("seq % 3 <> 0"), firsts.filter("seq % 3 = 0"), ["job_id"], with_ratio=False).drop("is_exact")


def _worded(spark, sf):
    from folio.runtime import table

    return table(spark, sf, "part").selectExpr(
        "p_partkey AS seq", "concat('job_', CAST(floor(p_partkey / 50) AS BIGINT)) AS job_id", f"{WORDED} AS stem"
    )


@query("C18_near_duplicate")
def c18(spark, sf):
    cands = views.candidates(spark, sf)
    return similar.first_match(cands.filter("round > 2"), cands.filter("round <= 2"), ["job_id"])


@query("G2_greedy_filter_words", f"""WITH RECURSIVE {NEAR.removeprefix('WITH ')},
o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS rn FROM d),
g AS (SELECT job_id, seq, rn, true AS kept, [{{'w': words, 'n': nums}}] AS acc FROM o WHERE rn = 1
  UNION ALL SELECT o.job_id, o.seq, o.rn, k.ok, CASE WHEN k.ok THEN list_append(g.acc, {{'w': o.words, 'n': o.nums}}) ELSE g.acc END
  FROM g JOIN o ON o.job_id = g.job_id AND o.rn = g.rn + 1, LATERAL (SELECT len(list_filter(g.acc, lambda x: (x.n = o.nums OR len(x.n) = 0 OR len(o.nums) = 0)
    AND len(list_intersect(x.w, o.words)) >= 0.82::DOUBLE * (len(x.w) + len(o.words) - len(list_intersect(x.w, o.words))))) = 0 AS ok) k)
SELECT job_id, seq FROM g WHERE kept""")
def g2_words(spark, sf):
    return similar.greedy_filter(_worded(spark, sf), ["job_id"], with_ratio=False)


@query("G2_greedy_filter")
def g2(spark, sf):
    return similar.greedy_filter(views.candidates(spark, sf))


OUTCOME = """CASE WHEN category IS NOT NULL THEN category WHEN seq % 31 = 0 THEN NULL WHEN seq % 3 = 0 THEN 'llm_verification_rejected'
  WHEN seq % 5 = 0 THEN 'surplus_not_needed' ELSE 'final_accepted' END"""
CATEGORIES = ", ".join(f"count_if(coalesce(outcome, 'unaccounted') = '{c}')::BIGINT AS {c}" for c in Q.OUTCOMES)


EARLY = "(trim(stem) = '' OR NOT (length(trim(stem)) >= 8 AND length(regexp_replace(stem, '[^a-zA-Z]', '', 'g')) >= 4))"
ALIKE = """(x.n = o.nums OR len(x.n) = 0 OR len(o.nums) = 0) AND len(list_intersect(x.w, o.words)) > 0
    AND len(list_intersect(x.w, o.words)) >= 0.82::DOUBLE * (len(x.w) + len(o.words) - len(list_intersect(x.w, o.words)))"""
GENERATED = f"""WITH RECURSIVE {duck.CANDIDATES}, k AS (SELECT *, {ANSWER} AS ans, {STEM_KEY.format('stem')} AS stem_key, {EARLY} AS early FROM v_candidates),
dd AS (SELECT *, {RULES.replace('{dup}', 'false')} AS scat, regexp_extract_all(stem_key, '\\d+') AS nums, list_distinct(list_filter(string_split(stem_key, ' '), lambda x: length(x) > 1
   AND x NOT IN ({", ".join(f"'{w}'" for w in similar.STOP_WORDS)}))) AS words FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS rn FROM dd),
sd AS (SELECT job_id, coalesce(list({{'k': stem_key, 'w': words, 'n': nums}}) FILTER (seq % 17 = 5), []) AS acc FROM dd GROUP BY 1),
g AS (SELECT job_id, 0::BIGINT AS rn, NULL::BIGINT AS seq, NULL::VARCHAR AS category, acc FROM sd
  UNION ALL SELECT o.job_id, o.rn, o.seq, c.cat, CASE WHEN c.cat IS NULL THEN list_append(g.acc, {{'k': o.stem_key, 'w': o.words, 'n': o.nums}}) ELSE g.acc END
  FROM g JOIN o ON o.job_id = g.job_id AND o.rn = g.rn + 1, LATERAL (SELECT CASE WHEN o.early THEN o.scat WHEN len(list_filter(g.acc, lambda x: x.k = o.stem_key)) > 0 THEN 'exact_question_duplicate_rejected'
    WHEN len(list_filter(g.acc, lambda x: {ALIKE})) > 0 THEN 'near_duplicate_rejected' ELSE o.scat END AS cat) c),
jd AS (SELECT o.*, g.category, CAST(substr(o.job_id, 5) AS BIGINT) AS j FROM g JOIN o ON o.job_id = g.job_id AND o.seq = g.seq),
f AS (SELECT *, concat('w', (round - 1) % 3) AS window_id, (j % 4)::BIGINT AS n_windows, ((round - 1) % 3 + j % 3)::BIGINT AS quota, 12 + j % 30 AS requested FROM jd),
q AS (SELECT *, CASE WHEN round <= n_windows AND n_windows > 1 THEN row_number() OVER (PARTITION BY job_id, window_id, category, round <= n_windows AND n_windows > 1 ORDER BY seq) <= greatest(1, quota) ELSE true END AS ok FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id, category, ok ORDER BY seq) AS place FROM q),
oc AS (SELECT job_id, round, seq, question_id, CASE WHEN category IS NOT NULL THEN category WHEN ok AND place <= requested THEN 'final_accepted' ELSE 'surplus_not_needed' END AS outcome FROM r)"""


def _generated(spark, sf, with_ratio=False):
    cands = views.candidates(spark, sf).selectExpr(
        "*", "concat('w', (round - 1) % 3) AS window_id", "(round - 1) % 3 + CAST(substr(job_id, 5) AS BIGINT) % 3 AS quota"
    )
    jobs = cands.select("job_id").distinct().selectExpr(
        "job_id", "CAST(substr(job_id, 5) AS BIGINT) % 4 AS n_windows", "12 + CAST(substr(job_id, 5) AS BIGINT) % 30 AS requested"
    )
    # Seeds are some of the job's own stems, so that a candidate can meet them exactly and nearly.
    seeds = cands.filter("seq % 17 = 5").select("job_id", "stem")
    return generation.generation_outcomes(cands, seeds, jobs, _valid_chunks(), with_ratio=with_ratio)


@query("generation_outcomes", f"{GENERATED} SELECT * FROM oc")
def generated(spark, sf):
    return _generated(spark, sf)


@query("generation_outcomes_ratio")
def generated_ratio(spark, sf):
    """The whole rule with the matcher's ratio, which SQL has not; a plain loop holds it in the tests."""
    return _generated(spark, sf, with_ratio=True)


@query("D8_rejection_accounting", f"""{GENERATED}, s AS (SELECT job_id, round, count(*) AS candidates_returned, {CATEGORIES} FROM oc GROUP BY ALL)
SELECT *, {' + '.join(Q.REJECTIONS)} AS total_rejected, candidates_returned = final_accepted + surplus_not_needed + unaccounted + {' + '.join(Q.REJECTIONS)} AS balanced FROM s""")
def d8(spark, sf):
    return Q.accounting(_generated(spark, sf), ["job_id", "round"])


@query("D8_accounting_merge", f"""WITH {duck.CANDIDATES}, c AS (SELECT job_id, seq, CASE WHEN trim(stem) = '' THEN 'schema_rejected' END AS category FROM v_candidates),
o AS (SELECT job_id, {OUTCOME} AS outcome FROM c), s AS (SELECT job_id, count(*) AS candidates_returned, {CATEGORIES} FROM o GROUP BY ALL)
SELECT *, CAST({' + '.join(Q.REJECTIONS)} AS BIGINT) AS total_rejected FROM s""")
def d8_merge(spark, sf):
    judged = views.candidates(spark, sf).withColumn("category", F.when(F.trim("stem") == "", "schema_rejected"))
    parts = Q.accounting(judged.withColumn("outcome", F.expr(OUTCOME)), ["job_id", "round"])
    return Q.merge_accounting(parts, ["job_id"])


QUOTA = f"""v AS (SELECT *, CAST(substr(job_id, 5) AS BIGINT) AS j FROM v_candidates),
f AS (SELECT *, concat('w', (round - 1) % 3) AS window_id, (j % 4)::BIGINT AS n_windows, ((round - 1) % 3 + j % 3)::BIGINT AS quota, 12 + j % 30 AS requested FROM v),
q AS (SELECT *, CASE WHEN round <= n_windows AND n_windows > 1 THEN row_number() OVER (PARTITION BY job_id, window_id, round <= n_windows AND n_windows > 1 ORDER BY seq) <= greatest(1, quota) ELSE true END AS ok FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id, ok ORDER BY seq) AS place FROM q)"""


@query("E20_quota_acceptance", f"""WITH {duck.CANDIDATES}, {QUOTA} SELECT job_id, window_id, seq, question_id,
  CASE WHEN ok AND place <= requested THEN 'final_accepted' ELSE 'surplus_not_needed' END AS outcome FROM r""")
def e20(spark, sf):
    verified = views.candidates(spark, sf).selectExpr(
        "job_id", "round", "seq", "question_id", "concat('w', (round - 1) % 3) AS window_id",
        "(round - 1) % 3 + CAST(substr(job_id, 5) AS BIGINT) % 3 AS quota",
    )
    jobs = verified.select("job_id").distinct().selectExpr(
        "job_id", "CAST(substr(job_id, 5) AS BIGINT) % 4 AS n_windows", "12 + CAST(substr(job_id, 5) AS BIGINT) % 30 AS requested"
    )
    return Q.accept_by_quota(verified, jobs)


@query("E20_request_size", """SELECT event_id, t AS batch_target, CAST(least(ceil(t * 1.25::DOUBLE), need + CASE WHEN pass1 THEN 1 ELSE 2 END) AS BIGINT) AS candidates FROM
 (SELECT event_id, need, pass1, CASE WHEN pass1 AND deficit > 0 THEN least(deficit, need) ELSE least(5, need) END AS t FROM
  (SELECT event_id, event_id % 23 + 1 AS need, event_id % 7 AS deficit, event_id % 2 = 0 AS pass1 FROM events))""")
def e20_size(spark, sf):
    from folio.runtime import table

    need, deficit, first_pass = F.col("event_id") % 23 + 1, F.col("event_id") % 7, F.col("event_id") % 2 == 0
    target, asked = Q.request_size(need, deficit, first_pass)
    return table(spark, sf, "events").select("event_id", target.alias("batch_target"), asked.alias("candidates"))


@query("E21_recent_stems", f"""WITH {duck.CANDIDATES}, r AS (SELECT job_id, seq, stem, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS back FROM v_candidates)
SELECT job_id, string_agg(concat('- ', stem), chr(10) ORDER BY seq) AS exclusion_text FROM r WHERE back <= 20 GROUP BY 1""")
def e21(spark, sf):
    return Q.recent_stems(views.candidates(spark, sf), "job_id")


LABELS = "concat('A) ', {o}[1].text, '|B) ', {o}[2].text, '|C) ', {o}[3].text, '|D) ', {o}[4].text)"
LETTER = "coalesce(['A', 'B', 'C', 'D'][list_position([x.id FOR x IN {o}], correct_option_id)], 'A')"


@query("E18_answer_key", f"""WITH {duck.CANDIDATES} SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS question_number, question_id,
  {LABELS.format(o='options')} AS option_labels, {LETTER.format(o='options')} AS correct_letter, coalesce({ANSWER}, '') AS correct_text FROM v_candidates""")
def e18(spark, sf):
    return Q.answer_key(views.candidates(spark, sf), "job_id")


@query("E19_shuffle_paper", f"""WITH {duck.CANDIDATES}, s AS (SELECT job_id, question_id, correct_option_id, concat_ws('|', 'seed-7', job_id, question_id) AS salt,
  options FROM v_candidates), m AS (SELECT *, sha256(salt) AS h, list_sort([{{'h': sha256(concat_ws('|', salt, x.id)), 'id': x.id, 'text': x.text}} FOR x IN options]) AS o FROM s)
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY h) AS question_number, question_id, {LABELS.format(o='o')} AS option_labels, {LETTER.format(o='o')} AS correct_letter FROM m""")
def e19(spark, sf):
    return Q.shuffle_paper(views.candidates(spark, sf), "job_id", "seed-7")


@query("H31_stable_identity", f"""WITH {duck.CANDIDATES} SELECT job_id, question_id AS old_id, concat('gen_q_', substr(sha256(concat_ws('|', job_id, question_id)), 1, 32)) AS question_id,
  array_to_string([concat('gen_opt_', substr(sha256(concat_ws('|', job_id, question_id, x.id)), 1, 32)) FOR x IN options], ',') AS option_ids,
  CASE WHEN list_contains([x.id FOR x IN options], correct_option_id) THEN concat('gen_opt_', substr(sha256(concat_ws('|', job_id, question_id, correct_option_id)), 1, 32))
   ELSE correct_option_id END AS correct_option_id FROM v_candidates""")
def h31(spark, sf):
    out = Q.stable_identity(views.candidates(spark, sf), "job_id")
    return out.select(
        "job_id", "old_id", "question_id", F.array_join(F.transform("options", lambda o: o["id"]), ",").alias("option_ids"),
        "correct_option_id",
    )


@query("D15_progress", f"""WITH {duck.JOBS}, c AS (SELECT job_id, count_if(kind = 'accepted')::BIGINT AS a, count_if(kind = 'rejected')::BIGINT AS rejected, count_if(kind = 'surplus')::BIGINT AS surplus,
  8 + job_id % 9 AS requested FROM v_jobs GROUP BY job_id)
SELECT job_id, requested, least(a, requested) AS generated, rejected, surplus, greatest(0, requested - a) AS deficit,
  CASE WHEN a >= requested THEN 'completed' WHEN a > 0 THEN 'incomplete' ELSE 'failed' END AS status FROM c""")
def d15(spark, sf):
    return Q.progress(views.job_events(spark, sf), F.col("job_id") % 9 + 8)
