"""Sources, rules, streams: what the SQL check cannot see."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folio.operators import toc
from folio.rules import PROFILES, Rules, load_profiles, load_rules, profiles_frame
from folio.sources.scans import asset_manifest
from folio.streaming import jobs


def test_asset_manifest(spark, tmp_path):
    (tmp_path / "good.pdf").write_bytes(b"%PDF-1.7 body")
    (tmp_path / "empty.pdf").write_bytes(b"")
    (tmp_path / "bad.pdf").write_bytes(b"hello world")
    (tmp_path / "big.pdf").write_bytes(b"%PDF-" + b"x" * 200)
    uploads = spark.createDataFrame([(f"file:{f}",) for f in tmp_path.iterdir()], "path string")
    got = {r["path"].rsplit("/", 1)[1]: r for r in asset_manifest(spark, str(tmp_path), uploads, max_bytes=100).collect()}
    assert {k: r["error_code"] for k, r in got.items()} == {"good.pdf": None, "empty.pdf": "INVALID_PDF", "bad.pdf": "INVALID_PDF", "big.pdf": "FILE_TOO_LARGE"}
    assert got["good.pdf"]["header_ok"] and len(got["good.pdf"]["checksum"]) == 64 and got["big.pdf"]["checksum"] is None


def test_rules_and_profiles_files(spark, tmp_path):
    (tmp_path / "rules.json").write_text('{"layout_thresholds": {"table_min_rows": 4, "max_line_gap_ratio": 2.0}, "semantic_markers": {"note_starters": ["NB"]}}')
    rules = load_rules(spark, str(tmp_path / "rules.json"))
    assert (rules.table_min_rows, rules.max_line_gap_ratio, rules.note, rules.example) == (4, 2.0, ("NB",), Rules().example)
    (tmp_path / "broken.json").write_text('{"layout_thresholds": {"table_min_rows": "four"}}')
    with pytest.raises(Exception):
        load_rules(spark, str(tmp_path / "broken.json"))
    (tmp_path / "none.json").write_text("[]")
    with pytest.raises(ValueError):
        load_profiles(spark, str(tmp_path / "none.json"))
    (tmp_path / "p.json").write_text('[{"code": "bio", "name": "Biology", "domain": "STEM", "keywords": ["cell"]}]')
    assert [r["code"] for r in load_profiles(spark, str(tmp_path / "p.json")).collect()] == ["bio"]
    (tmp_path / "o.json").write_text('{"profiles": [{"code": "bio", "name": "Biology", "domain": "STEM"}, {"code": "geo", "name": "Geography", "domain": "ARTS"}]}')
    assert [r["code"] for r in load_profiles(spark, str(tmp_path / "o.json")).collect()] == ["bio", "geo"]
    (tmp_path / "m.json").write_text('[{"code": "bio", "name": "Biology", "domain": "STEM"}, {"name": "No code", "domain": "STEM"}]')
    with pytest.raises(ValueError):
        load_profiles(spark, str(tmp_path / "m.json"))
    assert profiles_frame(spark, (*PROFILES, PROFILES[0])).count() == len(PROFILES)


def test_label_fill_passes(spark):
    counts = spark.createDataFrame([(1, 10), (2, 10)], "book_id long, page_count long")
    confirmed = spark.createDataFrame([(1, 5, 3), (1, 6, 4), (2, 8, 1), (2, 9, 2)], "book_id long, page_no long, value long")
    got = {}
    for r in toc.fill_labels(confirmed, counts).collect():
        got.setdefault(r["book_id"], {})[r["page_no"]] = r["label"]
    # Backward filling gains a page per pass and stops at 1; forward filling runs on to the end.
    assert got[1] == {3: "1", 4: "2", 5: "3", 6: "4", 7: "5", 8: "6", 9: "7", 10: "8"}
    assert got[2] == {8: "1", 9: "2", 10: "3"}


def walked(known, total, passes=4):
    """Labels after so many walks over the pages, each seeing what it has filled."""
    known = dict(known)

    def offsets(*pages):
        found = {known[p] - p if p in known else None for p in pages}
        return found.pop() if len(found) == 1 else None

    for _ in range(passes):
        for p in (p for p in range(1, total + 1) if p not in known):
            right, left = offsets(p + 1, p + 2), offsets(p - 1, p - 2)
            if right is not None:
                if p + right >= 1:
                    known[p] = p + right
            elif left is not None and p + left <= total:
                known[p] = p + left
    return known


def test_label_fill_equals_walks(spark):
    rnd = random.Random(7)
    rows, counts, want = [], [], {}
    for book in range(300):
        total, share = rnd.randint(1, 30), rnd.choice([0.2, 0.4, 0.6])
        offsets = [rnd.randint(-4, 6) for _ in range(rnd.choice([1, 2, 3]))]
        known = {p: p + rnd.choice(offsets) for p in range(1, total + 1) if rnd.random() < share}
        known = {p: v for p, v in known.items() if 1 <= v <= total}
        counts.append((book, total))
        rows += [(book, p, v) for p, v in known.items()]
        want |= {(book, p): str(v) for p, v in walked(known, total).items()}
    got = toc.fill_labels(
        spark.createDataFrame(rows, "book_id long, page_no long, value long"), spark.createDataFrame(counts, "book_id long, page_count long")
    ).collect()
    assert len(got) == len(want) and {(r.book_id, r.page_no): r.label for r in got} == want


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def stream_of(spark, tmp_path, batches, schema):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"b={i}"))
        for f in (folder / f"b={i}").glob("*.parquet"):
            f.rename(folder / f"{i}.parquet")
        for f in sorted((folder / f"b={i}").iterdir()):
            f.unlink()
        (folder / f"b={i}").rmdir()
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_ledger_never_repeats_within_the_delay(spark, tmp_path):
    batches = [[(at(0), 1, "What is x?"), (at(1), 1, "what is X"), (at(2), 2, "What is x?")], [(at(10), 1, "What is x?"), (at(11), 1, "Other one")]]
    stream = stream_of(spark, tmp_path, batches, "ts timestamp, request_id long, stem string")
    got = sorted((r["request_id"], r["stem_key"]) for r in jobs.run_to_table(jobs.exclusion_ledger(stream), "t").collect())
    assert got == [(1, "other one"), (1, "what is x"), (2, "what is x")]


def test_progress_stream_equals_batch(spark, tmp_path):
    rows = [(at(i), i % 4, "accepted" if i % 3 else "rejected") for i in range(60)]
    stream = stream_of(spark, tmp_path, [rows[:20], rows[20:45], rows[45:]], "ts timestamp, job_id long, kind string")
    need = F.lit(11).cast("bigint")
    updates = jobs.run_to_table(jobs.job_progress(stream, need), "t", "update")
    got = {tuple(r) for r in jobs.latest(updates, ["job_id"]).select("job_id", "accepted", "rejected", "status").collect()}
    batch = jobs.job_progress(spark.createDataFrame(rows, "ts timestamp, job_id long, kind string"), need)
    assert got == {tuple(r) for r in batch.select("job_id", "accepted", "rejected", "status").collect()}
    assert updates.select("batch").distinct().count() == 3


def test_provider_health_intervals(spark, tmp_path):
    jobs.use_rocksdb(spark)
    calls = [
        [(at(0), "p", "failure", "try again in 2m"), (at(1), "p", "success", "")],
        [(at(10), "p", "failure", "try again in 1m"), (at(11), "q", "success", "")],
        [(at(60), "q", "success", "")],
        [(at(120), "q", "success", "")],
    ]
    stream = stream_of(spark, tmp_path, calls, "ts timestamp, provider string, outcome string, message string")
    got = sorted(tuple(r)[:5] for r in jobs.run_to_table(jobs.provider_health(stream), "t").collect())
    assert got == [
        ("p", at(0), at(1), 1, "success"), ("p", at(10), at(10) + dt.timedelta(seconds=75), 1, "recovered"),
    ]


def test_idle_jobs_expire(spark, tmp_path):
    jobs.use_rocksdb(spark)
    batches = [[(at(0), 1, "accepted"), (at(5), 1, "accepted"), (at(6), 2, "start")], [(at(100), 2, "accepted")], [(at(200), 3, "start")], [(at(201), 3, "start")]]
    stream = stream_of(spark, tmp_path, batches, "ts timestamp, job_id long, kind string")
    got = sorted((r["job_id"], r["accepted"], r["last_ts"], r["status"]) for r in jobs.run_to_table(jobs.expired_jobs(stream), "t").collect())
    assert got == [(1, 2, at(5), "expired")]


def test_continuous_ingest_remembers_what_it_accepted(spark, tmp_path):
    stored = [(1, "a", False, "COMPLETED", 1), (2, "b", False, "FAILED", 2), (3, "c", True, "COMPLETED", 3)]
    spark.createDataFrame(stored, "version_id long, checksum string, is_deleted boolean, ingestion_status string, created_seq long").write.parquet(str(tmp_path / "cat"))
    batches = [[(10, "a"), (11, "b"), (12, "b"), (13, "n")], [(14, "n"), (15, "c"), (16, "b"), (17, "c")], [(18, "c"), (19, "m")]]
    uploads = stream_of(spark, tmp_path, batches, "upload_id long, checksum string")
    jobs.continuous_ingest(uploads, str(tmp_path / "cat"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {r["upload_id"]: (r["decision"], r["reused_version"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    new, again = ("NEW", None), ("DUPLICATE", None)
    assert got == {10: again, 11: ("REPLACE_FAILED", None), 12: again, 13: new, 14: again, 15: ("REUSE_DELETED", 3), 16: again, 17: again, 18: again, 19: new}
