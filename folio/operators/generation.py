"""The life of a candidate: rules, duplicates of what was kept, quota, outcome."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.text import stem_key
from folio.operators.questions import accept_by_quota, first_failure
from folio.operators import similar
from folio.operators.similar import Stem, alike, content_words, digits_of, distinct_stems, first_match, greedy_filter, seen_at
from folio.runtime import cut, fan_out


def kept_stems(passing: DataFrame, seeds: DataFrame, keys: Sequence[str], with_ratio: bool = True) -> DataFrame:
    """(keys, seq, stem_key): stems that neither repeat a seed nor an earlier kept stem, exactly or nearly."""
    keys = list(keys)
    firsts = cut(distinct_stems(passing, keys), "firsts")
    as_stems = firsts.withColumnRenamed("stem_key", "stem")
    known = first_match(as_stems, seeds, keys, with_ratio).select(*keys, "seq")
    new = as_stems.join(known, [*keys, "seq"], "left_anti")
    return firsts.join(greedy_filter(new, keys, with_ratio), [*keys, "seq"], "left_semi")


def met_in_small_jobs(stems: DataFrame, keys: Sequence[str], with_ratio: bool = True) -> DataFrame:
    """(keys, stem_key, exact_at, near_at) as `seen_at` has them, of jobs whose stems fit into one row.

    `stems` has each stem of a job once: the first place that holds it (`seq`), the first where it passes all rules (`passes`), and
    whether it is a seed. Each job is walked once in order, as the greedy rule reads, so it takes no rounds of written tables.
    """
    keys = list(keys)
    one = F.struct("stem_key", "seq", "passes", "seeded", digits_of(F.col("stem_key")).alias("nums"), content_words(F.col("stem_key")).alias("words"))
    jobs = fan_out(stems, *keys).groupBy(*keys).agg(F.collect_list(one).alias("stems"))
    names = ("stem_key", "exact_at", "near_at")
    found = T.StructType([T.StructField("stem_key", T.StringType()), T.StructField("exact_at", T.LongType()), T.StructField("near_at", T.LongType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_job, rows = [], []
            for job, listed in enumerate(batch.column("stems")):
                met = _met([Stem(**s) for s in listed.as_py()], with_ratio)
                of_job += [job] * len(met)
                rows += met
            place = pa.array(of_job, pa.int32())
            kept = [batch.column(k).take(place) for k in keys]
            columns = [pa.array([r[i] for r in rows], pa.string() if i == 0 else pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*keys, *names])

    return jobs.mapInArrow(walk, T.StructType([*jobs.select(*keys).schema.fields, *found.fields]))


def _met(stems: list[Stem], with_ratio: bool) -> list[tuple[str, int | None, int | None]]:
    """(stem_key, exact_at, near_at) of the stems of one job that meet a seed or a kept stem."""
    seen = [(-1, s) for s in stems if s.seeded]
    for s in sorted((s for s in stems if s.passes is not None and not s.seeded), key=lambda s: s.passes):
        if not any((at < s.passes or e.seeded) and alike(s, e, with_ratio) for at, e in seen):
            seen.append((s.passes, s))
    seen.sort(key=lambda x: x[0])
    exact_at = {e.stem_key: at for at, e in seen}
    met = []
    for s in stems:
        if s.seq is not None:
            near_at = next((at for at, e in seen if alike(s, e, with_ratio)), None)
            if near_at is not None or s.stem_key in exact_at:
                met.append((s.stem_key, exact_at.get(s.stem_key), near_at))
    return met


def met_stems(
    candidates: DataFrame, seeds: DataFrame, passing: Column, keys: Sequence[str], with_ratio: bool = True
) -> DataFrame:
    """(keys, stem_key, exact_at, near_at): where each stem of the candidates first meets a seed (at -1) or a kept stem, exactly and nearly.

    Jobs of FEW stems at most are walked one by one; the others go through the joins and rounds of `similar`.
    """
    keys = list(keys)
    old = seeds.select(*keys, F.lit(-1).cast("bigint").alias("seq"), "stem")
    no = F.lit(None).cast("bigint")
    both = candidates.select(*keys, stem_key(F.col("stem")).alias("stem_key"), "seq", F.when(passing, F.col("seq")).alias("passes"), F.lit(False).alias("seeded"))
    both = both.unionByName(old.select(*keys, stem_key(F.col("stem")).alias("stem_key"), no.alias("seq"), no.alias("passes"), F.lit(True).alias("seeded")))
    # A row without a key or stem meets nothing.
    whole = both.dropna(subset=[*keys, "stem_key"])
    stems = cut(whole.groupBy(*keys, "stem_key").agg(F.min("seq").alias("seq"), F.min("passes").alias("passes"), F.max("seeded").alias("seeded")), "job-stems")
    large = cut(stems.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > similar.FEW).select(*keys), "large-jobs")
    if large.isEmpty():
        return met_in_small_jobs(stems, keys, with_ratio)
    met = met_in_small_jobs(stems.join(large, keys, "left_anti"), keys, with_ratio)
    cands, old = candidates.join(large, keys, "left_semi"), old.join(large, keys, "left_semi")
    kept = kept_stems(cands.filter(passing).select(*keys, "seq", "stem"), old, keys, with_ratio).select(*keys, "seq", F.col("stem_key").alias("stem"))
    return met.unionByName(seen_at(cands.select(*keys, "seq", "stem"), old.unionByName(kept), keys, with_ratio))


def generation_outcomes(
    candidates: DataFrame, seeds: DataFrame, jobs: DataFrame, valid_chunks: Column, with_ratio: bool = True
) -> DataFrame:
    """(job_id, round, seq, question_id, outcome) of every candidate.

    Only candidates that pass all rules are remembered, so a rejected one blocks nobody; each
    candidate, passing or not, is then judged against the seeds and what was kept before it (B14, C17, C18, G1, G2).
    What is left goes through the quota (E20). Outcomes are the categories of D8.
    """
    keys = ["job_id"]
    met = cut(met_stems(candidates, seeds, first_failure(valid_chunks).isNull(), keys, with_ratio), "met")
    marked = candidates.withColumn("stem_key", stem_key(F.col("stem"))).join(met, [*keys, "stem_key"], "left")
    exact, near = (F.coalesce(F.col(c) < F.col("seq"), F.lit(False)) for c in ("exact_at", "near_at"))
    judged = cut(
        marked.withColumn("category", first_failure(valid_chunks, exact, near)).drop("stem_key", "exact_at", "near_at"), "judged"
    )
    rejected = judged.filter("category is not null").select(*keys, "seq", F.col("category").alias("outcome"))
    taken = accept_by_quota(judged.filter("category is null").drop("category"), jobs).select(*keys, "seq", "outcome")
    return judged.select(*keys, "round", "seq", "question_id").join(rejected.unionByName(taken), [*keys, "seq"], "left")
