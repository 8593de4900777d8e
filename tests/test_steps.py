"""Steps that many queries share read each line or text once, whatever follows it."""

from pyspark.sql import Row

from folio.functions import titles
from folio.operators import structure as S
from folio.operators import toc
from folio.plans import readable_queries as Q
from folio.runtime import cut
from folio.streaming import jobs


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def book(spark):
    texts = [(1, "Unit 1: Numbers"), (1, "Some plain words"), (1, "Lesson 2"), (1, "Sums"), (2, "3.4 Products"), (2, "more words"), (3, "Unit II"), (3, "Roots and so on")]
    rows = [(0, p, i, t, 11.0, False, 72.0, 40.0 * i, 72.0 + len(t), 40.0 * i + 11.0) for i, (p, t) in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "book_id bigint, page_no bigint, line_no bigint, text string, size double, bold boolean, x0 double, y0 double, x1 double, y1 double")


def test_a_line_is_matched_once_in_each_pass(spark):
    """The two passes of the scan (summary and rows) match a line against the contents pattern once each."""
    plan = plan_of(S.mark_headings(book(spark)))
    assert 1 <= plan.count("RLIKE " + titles.CONTENTS_ENTRY) <= 2 or 1 <= plan.count(titles.CONTENTS_ENTRY) <= 2


def test_headings_number_every_line(spark):
    rows = S.assign_headings(S.mark_headings(book(spark))).orderBy("line_no").collect()
    assert [(r.unit_no, r.lesson_no) for r in rows] == [(1, None), (1, None), (1, 1), (1, 1), (1, 2), (1, 2), (2, None), (2, None)]
    assert [r.title for r in rows if r.kind] == ["Numbers", "Sums", "Products", "Roots and so on"]
    assert [r.line_no for r in rows if r.taken] == [4, 8]


def test_a_block_is_split_once_for_its_type_and_title(spark):
    blocks = spark.createDataFrame([(0, 1, 1, 1, 1, "Rule 1\nwords", 0.0, 0.0, 1.0, 1.0, False, None, 1)], "book_id bigint, page_no bigint, line_no bigint, unit_no bigint, "
                                   "lesson_no bigint, text string, x0 double, y0 double, x1 double, y1 double, taken boolean, kind string, n int")
    domains = spark.createDataFrame([(0, "GENERAL", "Book")], "book_id bigint, domain string, title string")
    nodes = S.content_nodes(blocks, domains)
    assert nodes.select("node_type", "title").first() == ("grammar_rule", "Rule 1")
    assert plan_of(nodes.select("node_type", "title")).count("transform(split(") == 1


def test_a_tree_of_contents_reads_each_listing_once(spark):
    """Nested numbering repeats what is below it, so what is below it is a written table."""
    units = spark.createDataFrame([(0, 1, "1", "Unit", "Numbers", 1, 2), (0, 2, "2", "Unit", "Roots", 3, 3)],
                                  "book_id bigint, unit_no bigint, number string, label string, title string, start_page bigint, end_page bigint")
    lessons = spark.createDataFrame([(0, 1, 1, "2", "Sums", 1, 1), (0, 1, 2, "3.4", "Products", 2, 2)],
                                    "book_id bigint, unit_no bigint, lesson_no bigint, number string, title string, start_page bigint, end_page bigint")
    tree = toc.candidate_tree(units, lessons)
    assert [(r.node_id, r.parent_id, r.ordinal) for r in tree.orderBy("place").collect()] == [
        ("0-1", None, 1), ("0-1-1-1", "0-1", 1), ("0-1-1-2", "0-1", 2), ("0-2", None, 2)
    ]
    assert "RLIKE" not in plan_of(tree)


class Held:
    """A processor's handle that counts the calls made on it; each is a round trip in a real stream."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), []

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def registerTimer(self, at):  # noqa: N802
        self.calls.append("register")
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls.append("delete")
        self.timers.remove(at)


def test_a_job_costs_few_calls_and_keeps_one_timer():
    held, job = Held(), jobs.JobExpiry()
    job.init(held)
    life = jobs.JOB_LIFETIME_S * 1000
    list(job.handleInputRows((7,), iter([Row(is_accepted=1, ms=5000), Row(is_accepted=0, ms=9000)]), None))
    assert held.calls == ["get", "update", "register"] and held.timers == {9000 + life}
    list(job.handleInputRows((7,), iter([Row(is_accepted=1, ms=4000)]), None))
    assert held.calls[3:] == ["get", "update"] and held.timers == {9000 + life}
    list(job.handleInputRows((7,), iter([Row(is_accepted=0, ms=12000)]), None))
    assert held.timers == {12000 + life} and held.value == (2, 12000)


def test_content_is_built_before_it_is_numbered(spark, monkeypatch):
    plans = {}

    def noted(df, label="step"):
        plans[label] = plan_of(df)
        return cut(df, label)

    monkeypatch.setattr(Q, "cut", noted)
    lines = spark.createDataFrame([(0, 1, 1, 1, 1, "Rule 1", 0.0, 0.0, 1.0, 1.0, False, None)], "book_id bigint, page_no bigint, line_no bigint, unit_no bigint, "
                                  "lesson_no bigint, text string, x0 double, y0 double, x1 double, y1 double, taken boolean, kind string")
    nodes = Q._nodes(lines, spark.createDataFrame([(0, "GENERAL", "Book")], "book_id bigint, domain string, title string"))
    assert [(r.node_no, r.title) for r in nodes.collect()] == [(1, "grammar_rule")]
    assert "transform(split(" not in plans["nodes"]


def test_a_written_step_leaves_no_shuffle_files(spark):
    """The files of a step's shuffles go with its write, not with the driver's next garbage collection; the session's setting stays."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held, setting = disk.getAllFiles().size(), spark.conf.get(key, None)
    rows = spark.range(0, 10000, 1, 8).selectExpr("id % 97 AS k").groupBy("k").count()
    for _ in range(3):
        assert cut(rows).count() == 97
        rows = cut(rows).groupBy("k").count()
    assert disk.getAllFiles().size() - held < 8 * 3
    assert spark.conf.get(key, None) == setting


def test_places_of_content_need_no_texts(spark):
    """Lines marked without texts give the blocks of `content_nodes`, blank ones left out, and the scans below them carry no text."""
    lines = book(spark).union(spark.createDataFrame([(0, 4, 1, " \t", 11.0, False, 72.0, 40.0, 74.0, 51.0), (0, 4, 2, "Table of Contents", 11.0, False, 72.0, 99.0, 74.0, 110.0)], book(spark).schema))
    domains = lines.selectExpr("book_id", "'GENERAL' AS domain", "'Book' AS title").distinct()
    cols = ["book_id", "page_no", "node_no", "unit_no", "lesson_no", "x0", "y0", "x1", "y1"]
    marked = S.mark_places(lines)
    windows = [line for line in plan_of(marked.drop("title")).split("\n") if "Window" in line or "Aggregate" in line]
    assert windows and not any("text#" in line for line in windows)
    places = S.content_places(S.assign_headings(cut(marked))).select(*cols).orderBy(*cols[:3]).collect()
    assert places == S.content_nodes(S.assign_headings(cut(S.mark_headings(lines))), domains).select(*cols).orderBy(*cols[:3]).collect()
    assert len(places) >= 2
