"""Streaming queries (K1-K5), run over everything the event table holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.plans import duck
from folio.plans.registry import query
from folio.runtime import shared_dir, table
from folio.sources import views
from folio.streaming import jobs as J


def event_stream(spark, sf):
    """The event table as a stream, be it one file or a folder; timestamps get a zone because watermarks need one."""
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


KIND = """CASE event_type WHEN 'click' THEN 'candidate' WHEN 'purchase' THEN 'accepted' WHEN 'view' THEN 'surplus'
  WHEN 'error' THEN 'rejected' ELSE 'start' END AS kind"""


@query("K1_exclusion_ledger")
def k1(spark, sf):
    stems = event_stream(spark, sf).selectExpr(
        "event_id", "ts", "user_id % 10 AS request_id", "concat('Stem ', event_type, ' ', CAST(value AS INT) % 5, '?') AS stem"
    )
    return J.run_to_table(J.exclusion_ledger(stems), "ledger").select("request_id", "stem_key", "event_id")


def _progress(spark, sf):
    events = event_stream(spark, sf).selectExpr("ts", "user_id AS job_id", KIND)
    return J.latest(J.run_to_table(J.job_progress(events, F.col("job_id") % 9 + 8), "progress", "update"), ["job_id"])


PROGRESS = f"""{duck.JOBS}, c AS (SELECT job_id, count_if(kind = 'accepted')::BIGINT AS accepted, count_if(kind = 'rejected')::BIGINT AS rejected, 8 + job_id % 9 AS requested FROM v_jobs GROUP BY job_id),
p AS (SELECT *, CASE WHEN accepted >= requested THEN 'completed' WHEN accepted > 0 THEN 'incomplete' ELSE 'failed' END AS status FROM c)"""


@query("K2_job_progress", f"WITH {PROGRESS} SELECT job_id, accepted, rejected, requested, status FROM p")
def k2(spark, sf):
    return _progress(spark, sf).select("job_id", "accepted", "rejected", "requested", "status")


@query("K2_job_expiry")
def k2_expiry(spark, sf):
    J.use_rocksdb(spark)
    events = event_stream(spark, sf).selectExpr("ts", "user_id * 10 + event_id % 10 AS job_id", KIND)
    return J.run_to_table(J.expired_jobs(events), "expiry").select("job_id", "accepted", "last_ts", "status")


@query("K3_provider_health")
def k3(spark, sf):
    J.use_rocksdb(spark)
    calls = event_stream(spark, sf).selectExpr(
        "ts", "concat('provider_', user_id) AS provider", "CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome",
        "concat('rate limit, try again in ', event_id % 50, 'm', event_id % 60, 's') AS message",
    )
    return J.run_to_table(J.provider_health(calls), "health").drop("batch")


@query("K4_continuous_ingest", f"""WITH {duck.VERSIONS}, v AS (SELECT * FROM v_versions WHERE quality_status <> 'UNASSESSED'), up AS (SELECT doc_id AS upload_id, sha256(text) AS checksum, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS rep FROM documents),
p AS (SELECT checksum, bool_or(NOT is_deleted AND ingestion_status IN ('COMPLETED', 'PARTIAL', 'PROCESSING')) AS a, bool_or(NOT is_deleted AND ingestion_status = 'FAILED') AS f, arg_max(CASE WHEN is_deleted THEN version_id END, CASE WHEN is_deleted THEN created_seq END) AS d FROM v GROUP BY 1)
SELECT upload_id, CASE WHEN a OR rep THEN 'DUPLICATE' WHEN f THEN 'REPLACE_FAILED' WHEN d IS NOT NULL THEN 'REUSE_DELETED' ELSE 'NEW' END AS decision FROM up LEFT JOIN p USING (checksum)""")
def k4(spark, sf):
    import uuid

    base = f"{shared_dir(spark)}/folio-ingest-{uuid.uuid4().hex}"
    stored = views.versions(spark, sf).filter("quality_status <> 'UNASSESSED'").select("version_id", "checksum", "is_deleted", "ingestion_status", "created_seq")
    stored.write.parquet(f"{base}/catalogue")
    docs = spark.readStream.schema(table(spark, sf, "documents").schema).parquet(f"{sf}/document[s].parquet")
    uploads = docs.select(F.col("doc_id").alias("upload_id"), F.sha2("text", 256).alias("checksum"))
    J.continuous_ingest(uploads, f"{base}/catalogue", f"{base}/decisions", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema("upload_id bigint, decision string, reused_version bigint").parquet(f"{base}/decisions").select("upload_id", "decision")


@query("K5_remaining_work", f"WITH {PROGRESS} SELECT job_id, requested, accepted, requested - accepted AS remaining FROM p WHERE status = 'incomplete'")
def k5(spark, sf):
    return J.remaining_work(_progress(spark, sf))


