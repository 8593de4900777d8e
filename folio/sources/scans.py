"""Reading files and tables, and writing the hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 100 * 1024 * 1024
MAGIC = b"%PDF-"


def asset_manifest(spark: SparkSession, path: str, uploads: DataFrame | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """A1: checksum, size, header check and error code of every file under `path`.

    Sizes come from the listing alone; only files of an admissible size are
    opened, since a file is one row and has to fit in a task. Spark's file scan
    passes over empty files, so they are known from `uploads` (their paths): an
    upload the scan does not return holds nothing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    listed = files.select("path", F.col("length").alias("n_bytes"))
    opened = files.filter(F.col("length").between(1, max_bytes)).select(
        "path", F.sha2("content", 256).alias("checksum"), (F.substring("content", 1, len(MAGIC)) == F.lit(MAGIC)).alias("header_ok")
    )
    if uploads is not None:
        listed = uploads.select("path").distinct().join(listed, "path", "full").withColumn("n_bytes", F.coalesce("n_bytes", F.lit(0)))
    error = (
        F.when(F.col("n_bytes") == 0, "INVALID_PDF").when(F.col("n_bytes") > max_bytes, "FILE_TOO_LARGE")
        .when(~F.col("header_ok"), "INVALID_PDF")
    )
    return listed.join(opened, "path", "left").select(
        "path", "checksum", "n_bytes", F.coalesce("header_ok", F.lit(False)).alias("header_ok"), error.alias("error_code")
    )


def entity_scan(spark: SparkSession, path: str, columns: list[str], condition: str | None = None) -> DataFrame:
    """Some columns of a stored table; the condition is pushed to the Parquet scan."""
    rows = spark.read.parquet(path)
    return (rows.filter(condition) if condition else rows).select(*columns)


def _key(*parts: str):
    """Keys from content: a rerun, or a task run twice, writes the same ones."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def hierarchy_rows(units: DataFrame, lessons: DataFrame, content: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Units, lessons and content with their own and their parents' keys."""
    u = units.withColumn("unit_key", _key("book_id", "unit_no"))
    l = lessons.withColumn("unit_key", _key("book_id", "unit_no")).withColumn("lesson_key", _key("book_id", "unit_no", "lesson_no"))  # noqa: E741
    c = (
        content.withColumn("unit_key", _key("book_id", "unit_no"))
        .withColumn("lesson_key", F.when(F.col("lesson_no").isNotNull(), _key("book_id", "unit_no", "lesson_no")))
        .withColumn("content_key", _key("book_id", "page_no", "node_no"))
    )
    return u, l, c


def write_hierarchy(units: DataFrame, lessons: DataFrame, content: DataFrame, path: str, buckets: int = 64) -> None:
    """Write the three tables, folders by a hash of the book.

    A folder per book would be a folder per row group at library scale. Within
    a folder the page range is part of the shuffle key, so a very large book is
    written by many tasks, and files are sorted for range reads.
    """
    for name, df, place in zip(
        ("units", "lessons", "content"), hierarchy_rows(units, lessons, content),
        ("start_page", "start_page", "page_no"),
    ):
        spread = df.withColumn("book_bucket", F.pmod(F.xxhash64("book_id"), F.lit(buckets)).cast("int"))
        (
            spread.repartition("book_bucket", F.floor(F.col(place) / 256)).sortWithinPartitions("book_bucket", "book_id", place)
            .write.mode("overwrite").partitionBy("book_bucket").parquet(f"{path}/{name}")
        )
