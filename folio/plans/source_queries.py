"""Queries over sources and sinks: A1, A7, A8."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folio.operators import structure as S
from folio.plans.registry import query
from folio.plans.structure_queries import NODES_SQL, _assigned, _last, domains
from folio.runtime import shared_dir
from folio.sources import scans


# No SQL: the checking engine sees views, not the files behind them. tests/test_jobs.py checks every outcome.
@query("A1_asset_manifest")
def a1(spark, sf):
    found = scans.asset_manifest(spark, sf)
    return found.withColumn("path", F.regexp_extract("path", "[^/]+/?[^/]+$", 0))


@query("A7_entity_scan", "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang <> 'en' AND n_chars > 1000")
def a7(spark, sf):
    return scans.entity_scan(spark, f"{sf}/documents.parquet", ["doc_id", "lang", "source", "n_chars"], "lang <> 'en' AND n_chars > 1000")


@query("A8_hierarchy_sink", f"""WITH {NODES_SQL} SELECT book_id, sha256(concat_ws('|', book_id, page_no, node_no)) AS content_key, sha256(concat_ws('|', book_id, unit_no)) AS unit_key,
  CASE WHEN lesson_no IS NOT NULL THEN sha256(concat_ws('|', book_id, unit_no, lesson_no)) END AS lesson_key FROM nodes""")
def a8(spark, sf):
    assigned, last = _assigned(spark, sf), _last(spark, sf)
    path = f"{shared_dir(spark)}/folio-hierarchy-{uuid.uuid4().hex}"
    scans.write_hierarchy(
        S.unit_rows(assigned, last), S.lesson_rows(assigned, last), S.content_nodes(assigned, domains(spark, sf)), path
    )
    return spark.read.parquet(f"{path}/content").select("book_id", "content_key", "unit_key", "lesson_key")
