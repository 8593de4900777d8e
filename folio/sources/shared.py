"""Expressions that shape the test tables into the engine's input tables.

Plain SQL that Spark and DuckDB read alike, so a view and its checking SQL are
built from the same text.
"""


def div(a: str, b: int) -> str:
    """Integer division of a non-negative column, spelled for both engines."""
    return f"CAST((({a}) - ({a}) % {b}) / {b} AS BIGINT)"


LINE_SIZE = (
    "CAST(CASE WHEN length(text) <= 12 THEN 16.0 WHEN length(text) <= 24 THEN 13.5 ELSE 11.0 END AS DOUBLE)"
)
LINE_PAGE = f"{div('line_no - 1', 40)} + 1"
LINE_Y0 = (
    f"CAST(40.0 + 17.0 * ((line_no - 1) % 40) + 18.0 * {div('(line_no - 1) % 40', 8)} AS DOUBLE)"
)

# Books: 25 documents make a book, one document a page; the text of some lines
# is turned into headings, examples, lists and table rows by its position.
BOOK_ID = div("doc_id", 25)
BOOK_PAGE = "CAST(doc_id % 25 + 1 AS BIGINT)"
BOOK_MARK = "((page_no * 7 + line_no) % 23)"
BOOK_TEXT = f"""CASE
  WHEN page_no = 1 AND line_no = 1 THEN 'Table of Contents'
  WHEN page_no = 1 THEN concat('Unit ', line_no, ': ', left(raw, 20), ' ..... ', line_no)
  WHEN line_no = 1 AND page_no % 2 = 0 THEN concat(page_no + 2, ' Algebra Book')
  WHEN line_no = 1 THEN concat('Algebra Book ', page_no + 2)
  WHEN {BOOK_MARK} = 0 THEN concat('Unit ', CASE page_no % 5 WHEN 0 THEN 'V' WHEN 1 THEN 'ix' WHEN 2 THEN 'II'
       WHEN 3 THEN 'three' ELSE 'IV' END)
  WHEN {BOOK_MARK} = 2 AND page_no % 9 = 0 THEN concat('PART and: ', left(raw, 30))
  WHEN {BOOK_MARK} = 2 THEN concat('CHAPTER ', page_no, ': ', left(raw, 40))
  WHEN {BOOK_MARK} = 4 THEN concat('Lesson ', line_no % 7 + 1, ' - ', left(raw, 30))
  WHEN {BOOK_MARK} = 5 THEN concat(page_no, '.', line_no % 7 + 1, ' ', 'Set', left(raw, 25))
  WHEN {BOOK_MARK} = 6 THEN CASE page_no % 4 WHEN 0 THEN 'Exercise' WHEN 1 THEN concat('Exercise ', page_no)
       WHEN 2 THEN concat('Exercise ', page_no, '01') ELSE concat('Exercise ', page_no, '.', line_no % 9 + 1) END
  WHEN {BOOK_MARK} = 7 THEN concat('Example ', line_no, ': ', raw)
  WHEN {BOOK_MARK} = 8 THEN concat('Solution: ', raw)
  WHEN {BOOK_MARK} = 9 THEN concat('Activity: ', raw)
  WHEN {BOOK_MARK} = 10 THEN concat('Definition: ', raw)
  WHEN {BOOK_MARK} = 11 THEN concat('• ', raw)
  WHEN {BOOK_MARK} = 12 THEN concat('1. ', raw)
  WHEN {BOOK_MARK} = 13 THEN concat('(a) ', raw)
  WHEN {BOOK_MARK} = 15 THEN concat('Ruma: ', raw)
  WHEN {BOOK_MARK} = 16 THEN concat('Teacher: ', raw)
  WHEN {BOOK_MARK} IN (17, 18, 19) THEN concat(left(raw, 4), 'x  ', line_no, '  ', page_no,
       CASE WHEN {BOOK_MARK} = 19 AND page_no % 3 = 0 THEN '  extra' ELSE '' END)
  WHEN {BOOK_MARK} = 20 THEN concat(raw, '-')
  ELSE raw END"""
BOOK_SIZE = f"""CAST(CASE WHEN line_no = 1 THEN 9.0 WHEN page_no = 1 THEN 11.0
  WHEN {BOOK_MARK} = 0 OR ({BOOK_MARK} = 2) THEN 18.0 WHEN {BOOK_MARK} = 4 THEN 14.0
  WHEN {BOOK_MARK} = 5 THEN 12.0 ELSE 11.0 END AS DOUBLE)"""
BOOK_BOLD = f"({BOOK_MARK} = 6 AND page_no > 1)"
BOOK_X0 = f"CAST(CASE WHEN {BOOK_MARK} = 14 THEN 90.0 ELSE 72.0 END AS DOUBLE)"
BOOK_Y0 = (
    f"CAST(40.0 + 19.0 * (line_no - 1) + 18.0 * {div('line_no - 1', 8)} + CASE WHEN line_no > 1 THEN 16.0 ELSE 0.0 END AS DOUBLE)"
)
BOOK_HEIGHT = "CAST(greatest(842.0, 400.0 + 22.0 * max(line_no)) AS DOUBLE)"

STEM = "concat('What is the square of ', p_size, ' for the ', p_name, '?')"
OPTION_3 = (
    "CAST(CASE WHEN p_partkey % 10 = 0 THEN p_size*p_size+5 WHEN p_size*p_size > 3 THEN p_size*p_size-3 "
    "ELSE p_size*p_size+8 END AS STRING)"
)
CORRECT_ID = "CASE WHEN p_partkey % 11 = 0 THEN 'opt_9' WHEN p_partkey % 13 = 0 THEN 'opt_2' ELSE 'opt_1' END"
EXPLANATION = "CASE WHEN p_partkey % 17 = 0 THEN '' ELSE 'n times n' END"
CANDIDATE_STEM = f"CASE WHEN p_partkey % 23 = 0 THEN '' WHEN p_partkey % 29 = 0 THEN '5^2 = 25' ELSE {STEM} END"

PAPER_VERSION = "CASE WHEN o_orderkey % 100 = 0 THEN 'P' ELSE 'F' END"
PART_VERSION = "CASE WHEN p_partkey % 20 = 0 THEN 'P' ELSE 'F' END"
ITEM_ORDER = "CAST(CASE WHEN l_suppkey % 29 = 0 THEN l_linenumber - 1 ELSE l_linenumber END AS BIGINT)"

VERSION_TITLE = """concat(CASE doc_id % 4 WHEN 0 THEN 'Mathematics ' WHEN 1 THEN 'English Grammar '
  WHEN 2 THEN 'English for Today ' ELSE 'Science ' END, 'Class ', doc_id % 13)"""
VERSION_FILE = """concat('book-', doc_id, CASE doc_id % 5 WHEN 0 THEN ' class-5 2022' WHEN 1 THEN '_Grade 3' ELSE '' END, '.pdf')"""
FRONT_TEXT = """concat(CASE doc_id % 6 WHEN 0 THEN 'Class IX-X ' WHEN 1 THEN 'Grade: seven ' WHEN 2 THEN 'For Class 8 '
  WHEN 3 THEN 'Class Notes ' ELSE '' END, CASE doc_id % 7 WHEN 0 THEN 'Revised Edition 2023 '
  WHEN 1 THEN 'Academic Year: 2024 ' WHEN 2 THEN 'Reprint 1950 ' WHEN 3 THEN 'published in 2019 '
  WHEN 4 THEN 'copyright 2035 ' ELSE '' END, text)"""
INGESTION = """CASE doc_id % 10 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PROCESSING' WHEN 2 THEN 'PARTIAL' ELSE 'COMPLETED' END"""
GRADE_ID = "CASE WHEN CAST(substr(source, 4) AS BIGINT) BETWEEN 1 AND 12 THEN CAST(substr(source, 4) AS BIGINT) END"
SUBJECT_ID = "CAST(CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 END AS BIGINT)"
