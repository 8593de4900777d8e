"""The library catalogue: readiness, listings, duplicates, dimensions, lifecycle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import content_hash
from folio.operators.ordered import numbered

SUPPORTED_DOMAINS = ("STEM", "LANGUAGE")


def enrich(versions: DataFrame, grades: DataFrame, subjects: DataFrame) -> DataFrame:
    """Versions with their grade and subject; Spark broadcasts the dimensions when they measure small."""
    return versions.join(grades, "grade_id", "left").join(subjects, "subject_id", "left")


def readiness_reasons(profile_domains: dict[str, str] | None = None) -> Column:
    """Ordered reason codes of an enriched version with its asset flag; ready iff empty."""
    domain_ok = F.col("domain").isin(*SUPPORTED_DOMAINS)
    for code, domain in (profile_domains or {}).items():
        if domain in SUPPORTED_DOMAINS:
            domain_ok = domain_ok | (F.col("subject_code") == code)
    return F.array_compact(F.array(
        F.when(F.col("is_deleted"), "TEXTBOOK_DELETED"),
        F.when(~F.col("ingestion_status").isin("COMPLETED", "PARTIAL"), "INGESTION_INCOMPLETE"),
        F.when(F.col("grade_id").isNull(), "GRADE_NOT_ASSIGNED"),
        F.when(F.col("subject_id").isNull(), "SUBJECT_NOT_RESOLVED").when(~domain_ok, "SUBJECT_NOT_SUPPORTED"),
        F.when(F.col("quality_status").isin("NEEDS_REFRESH", "FAILED", "BUILDING"), "STRUCTURE_NEEDS_REFRESH"),
        F.when(~F.coalesce("has_asset", F.lit(False)), "PDF_NOT_AVAILABLE"),
    ))


def with_readiness(versions: DataFrame, grades: DataFrame, subjects: DataFrame, assets: DataFrame) -> DataFrame:
    """B10 over the catalogue; an asset counts when its manifest row (A1) is there and sound."""
    present = assets.select("version_id", F.lit(True).alias("has_asset")).distinct()
    full = enrich(versions, grades, subjects).join(present, "version_id", "left")
    return full.withColumn("reasons", readiness_reasons())


def list_versions(ready: DataFrame, grade_id: int | None = None, eligible_only: bool = False, include_deleted: bool = False) -> DataFrame:
    """B11."""
    out = ready if include_deleted else ready.filter(~F.col("is_deleted"))
    if grade_id is not None:
        out = out.filter(F.col("grade_id") == grade_id)
    return out.filter(F.size("reasons") == 0) if eligible_only else out


def newest_first(versions: DataFrame) -> DataFrame:
    """place of every version, newest first, without gathering them in one task."""
    bucket = -F.floor(F.col("created_seq") / 4096)
    return numbered(versions, [], bucket, [-F.col("created_seq"), F.col("version_id")], "position")


def grade_mismatch(requested: Column, actual: Column) -> Column:
    """B17."""
    return requested.isNotNull() & actual.isNotNull() & (requested != actual)


def upload_decisions(uploads: DataFrame, versions: DataFrame) -> DataFrame:
    """Duplicate, replacement of a failed copy, reuse of the latest deleted copy, or new.

    Versions are reduced to one row per checksum first, so a text stored many
    times costs one join row. Of equal uploads the one with the smallest id gets the
    stored text's decision; it is in work from then on, so the others are duplicates.
    """
    first = uploads.groupBy("checksum").agg(F.min("upload_id").alias("first_id"))
    live = ~F.col("is_deleted")
    per = versions.groupBy("checksum").agg(
        F.max(live & F.col("ingestion_status").isin("COMPLETED", "PARTIAL", "PROCESSING")).alias("active"),
        F.max(live & (F.col("ingestion_status") == "FAILED")).alias("failed"),
        F.max_by("version_id", F.when(F.col("is_deleted"), F.col("created_seq"))).alias("deleted_id"),
    )
    repeat = F.col("upload_id") > F.col("first_id")
    decision = (
        F.when(F.col("active") | repeat, "DUPLICATE").when(F.col("failed"), "REPLACE_FAILED")
        .when(F.col("deleted_id").isNotNull(), "REUSE_DELETED").otherwise("NEW")
    )
    return uploads.join(first, "checksum").join(per, "checksum", "left").select(
        "upload_id", decision.alias("decision"),
        F.when(~F.coalesce("active", F.lit(False)) & ~repeat, F.col("deleted_id")).alias("reused_version"), "checksum",
    )


def backfill_grades(versions: DataFrame, grades: DataFrame) -> DataFrame:
    """Grade of unassigned versions from detected code, then level, then a unique mention in title or file name.

    Mentions are found by equality of a name's first word with a word of the text, then confirmed on the
    text itself, so names of any length are found.
    """
    open_ = versions.filter("grade_id is null")
    codes = grades.select(F.lower("code").alias("found_code"), F.col("grade_id").alias("by_code"))
    levels = grades.filter("level_number is not null").select(F.col("level_number").alias("found_level"), F.col("grade_id").alias("by_level"))
    low = F.lower(F.concat_ws(" ", "title", "source_filename"))
    words = F.filter(F.split(low, r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    said = open_.select("version_id", low.alias("t"), F.explode(F.array_distinct(words)).alias("first_word"))
    level = F.col("level_number").cast("string")
    quoted = [F.concat(F.lit(r"\Q"), F.lower(c), F.lit(r"\E")) for c in ("name", "code")]
    edge = (r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])")
    forms = F.array(
        F.struct(F.lower("name").alias("p"), F.concat(F.lit(edge[0]), quoted[0], F.lit(edge[1])).alias("r")),
        F.struct(F.lower("code").alias("p"), F.concat(F.lit(edge[0]), quoted[1], F.lit(edge[1])).alias("r")),
        *[
            F.struct(F.concat(F.lit(w + gap), level).alias("p"),
                     F.concat(F.lit(edge[0] + w + r"\s*[-:]?\s*"), level, F.lit(edge[1])).alias("r"))
            for w in ("class", "grade") for gap in (" ", "")
        ],
    )
    named = grades.select("grade_id", F.explode(F.filter(forms, lambda f: f["p"].isNotNull())).alias("f")).select(
        "grade_id", F.regexp_extract("f.p", r"[\p{L}\p{N}_]+", 0).alias("first_word"), F.col("f.r").alias("confirm")
    ).distinct()
    hits = said.join(named, "first_word").filter(F.expr("rlike(t, confirm)")).select("version_id", "grade_id").distinct()
    unique = hits.groupBy("version_id").agg(F.count("*").alias("n"), F.max("grade_id").alias("by_text")).filter("n = 1")
    full = (
        open_.withColumn("found_code", F.lower("detected_code")).withColumn("found_level", F.col("detected_level"))
        .join(codes, "found_code", "left").join(levels, "found_level", "left").join(unique, "version_id", "left")
    )
    return full.select("version_id", F.coalesce("by_code", "by_level", "by_text").alias("grade_id"))


def upsert_dimension(existing: DataFrame, incoming: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Rows of a dimension plus the incoming rows whose code is new, each once."""
    new = incoming.groupBy(key).agg(*[F.min(c).alias(c) for c in cols if c != key]).join(existing.select(key), key, "left_anti")
    return existing.select(*cols).unionByName(new.select(*cols))


def dependency_counts(versions: DataFrame, **children: DataFrame) -> DataFrame:
    """Rows of each child table per version, zero when none; each child is counted before it is joined."""
    out = versions.select("version_id")
    for name, child in children.items():
        out = out.join(child.groupBy("version_id").agg(F.count("*").alias(name)), "version_id", "left")
    return out.select("version_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in children])


def grade_counts(grades: DataFrame, ready: DataFrame, only_with_textbooks: bool = False) -> DataFrame:
    """Ready books per grade; grades without books stay unless asked otherwise."""
    counts = ready.filter((F.size("reasons") == 0) & F.col("grade_id").isNotNull()).groupBy("grade_id").agg(F.count("*").alias("n"))
    out = grades.join(counts, "grade_id", "left").withColumn("textbook_count", F.coalesce("n", F.lit(0))).drop("n")
    return out.filter("textbook_count > 0") if only_with_textbooks else out


def grade_order(grades: DataFrame) -> DataFrame:
    """grades by level, those without one last, then by id."""
    last = F.coalesce("level_number", F.lit(1 << 30))
    return numbered(grades, [], F.floor(last / 4096), [last, F.col("grade_id")], "position")


def ingestion_rollup(books: DataFrame, units: DataFrame, lessons: DataFrame, content: DataFrame, routes: DataFrame) -> DataFrame:
    """Counts per book and the state it ends in."""
    def per(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("book_id").agg(F.count("*").alias(name))

    pages = routes.groupBy("book_id").agg(
        F.count_if(F.col("route") == "ocr").alias("ocr_pages"), F.count("warning").alias("n_warnings")
    )
    out = books.join(per(units, "n_units"), "book_id", "left").join(per(lessons, "n_lessons"), "book_id", "left")
    out = out.join(per(content, "n_content"), "book_id", "left").join(pages, "book_id", "left")
    zero = F.lit(0).cast("bigint")
    counts = [F.coalesce(c, zero).alias(c) for c in ("n_units", "n_lessons", "n_content", "ocr_pages", "n_warnings")]
    status = F.when(F.coalesce("n_warnings", zero) > 0, "PARTIAL").otherwise("COMPLETED")
    return out.select("book_id", *counts, status.alias("ingestion_status"))


def lifecycle(versions: DataFrame, stages: DataFrame, gates: DataFrame) -> DataFrame:
    """Ingestion, quality and metadata status of every version from what its stages reported."""
    full = versions.join(stages, "version_id", "left").join(gates, "version_id", "left")
    ingestion = (
        F.when(F.col("error").isNotNull(), "FAILED").when(F.col("n_warnings").isNull(), "PROCESSING")
        .when(F.col("n_warnings") > 0, "PARTIAL").otherwise("COMPLETED")
    )
    done = ingestion.isin("COMPLETED", "PARTIAL")
    quality = F.when(~done, "BUILDING").when(F.col("gate_status") == "VALID", "VALID").otherwise("NEEDS_REFRESH")
    confirmed = F.col("metadata_status") == "USER_CONFIRMED"
    meta = F.when(confirmed, "USER_CONFIRMED").when(F.col("grade_id").isNotNull() & F.col("subject_id").isNotNull(), "VALID").otherwise("NEEDS_REVIEW")
    return full.select("version_id", ingestion.alias("ingestion_status"), quality.alias("quality_status"), meta.alias("metadata_status"))


def repeated_content(rows: DataFrame, text: str) -> DataFrame:
    """Content that occurs more than once, by the hash of its normalised text."""
    return rows.groupBy(content_hash(F.col(text)).alias("content_hash")).agg(F.count("*").alias("n_copies")).filter("n_copies > 1")


def checksum_violations(versions: DataFrame) -> DataFrame:
    """Checksums held by more than one active version."""
    return versions.filter(~F.col("is_deleted")).groupBy("checksum").agg(F.count("*").alias("n_active")).filter("n_active > 1")


def patch_metadata(versions: DataFrame, patches: DataFrame, grades: DataFrame, subjects: DataFrame) -> DataFrame:
    """Given fields overwrite; a patch that names an unknown grade or subject changes nothing and says so."""
    checked = (
        patches.join(grades.select(F.col("grade_id").alias("p_grade"), F.lit(True).alias("g_ok")), "p_grade", "left")
        .join(subjects.select(F.col("subject_id").alias("p_subject"), F.lit(True).alias("s_ok")), "p_subject", "left")
        .withColumn("error", F.when(F.col("p_grade").isNotNull() & F.col("g_ok").isNull(), "GRADE_NOT_FOUND").when(
            F.col("p_subject").isNotNull() & F.col("s_ok").isNull(), "SUBJECT_NOT_FOUND"))
        .select("version_id", "p_grade", "p_subject", "p_title", "error", F.lit(True).alias("patched"))
    )
    full = versions.join(checked, "version_id", "left")
    ok = F.col("patched") & F.col("error").isNull()
    return full.select(
        "version_id", F.when(ok, F.coalesce("p_title", "title")).otherwise(F.col("title")).alias("title"),
        F.when(ok, F.coalesce("p_grade", "grade_id")).otherwise(F.col("grade_id")).alias("grade_id"),
        F.when(ok, F.coalesce("p_subject", "subject_id")).otherwise(F.col("subject_id")).alias("subject_id"),
        F.when(ok, "USER_CONFIRMED").otherwise(F.col("metadata_status")).alias("metadata_status"), "error",
    )


def refresh_metadata(versions: DataFrame, detected: DataFrame, grades: DataFrame, subjects: DataFrame) -> DataFrame:
    """Newly detected values fill empty fields of versions nobody has confirmed; a new year or edition replaces the old one."""
    full = (
        versions.join(detected, "version_id", "left")
        .join(grades.select(F.col("code").alias("found_grade"), F.col("grade_id").alias("g_id")), "found_grade", "left")
        .join(subjects.select(F.col("subject_code").alias("found_subject"), F.col("subject_id").alias("s_id")), "found_subject", "left")
    )
    free = F.col("metadata_status") != "USER_CONFIRMED"
    grade = F.when(free, F.coalesce("grade_id", "g_id")).otherwise(F.col("grade_id"))
    subject = F.when(free, F.coalesce("subject_id", "s_id")).otherwise(F.col("subject_id"))
    status = F.when(~free, "USER_CONFIRMED").when(grade.isNotNull() & subject.isNotNull(), "VALID").otherwise("NEEDS_REVIEW")
    named = full.withColumn("new_grade", grade).withColumn("new_subject", subject).withColumn("new_status", status)
    return named.select(
        "version_id", F.col("new_grade").alias("grade_id"), F.col("new_subject").alias("subject_id"),
        F.coalesce(F.when(free, F.col("found_year")), F.col("publication_year")).alias("publication_year"),
        F.coalesce(F.when(free, F.col("found_edition")), F.col("edition")).alias("edition"), F.col("new_status").alias("metadata_status"),
    )
