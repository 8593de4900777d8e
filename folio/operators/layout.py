"""Page geometry: words to lines to blocks, page routing, running headers."""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import is_page_number, running_text_key
from folio.operators.ordered import runs, scan, upper_median
from folio.rules import Rules

PAGE = ["book_id", "page_no"]


def round2(c: Column) -> Column:
    """Two places, halves away from zero, through decimal so that binary noise does not decide."""
    return F.round(c.cast("decimal(18,6)"), 2).cast("double")


def clean_words(words: DataFrame) -> DataFrame:
    """A2: non-blank words with coordinates on a hundredth of a point."""
    return words.withColumn("text", F.trim("text")).filter(F.length("text") > 0).withColumns(
        {c: round2(F.col(c)) for c in ("x0", "y0", "x1", "y1")}
    )


def union_box(prefix: str = "") -> list[Column]:
    """D3: smallest box around all rows of a group."""
    return [
        F.min("x0").alias(f"{prefix}x0"), F.min("y0").alias(f"{prefix}y0"),
        F.max("x1").alias(f"{prefix}x1"), F.max("y1").alias(f"{prefix}y1"),
    ]


def span_lines(spans: DataFrame) -> DataFrame:
    """A3: spans of a line put together: text, box, mean baseline, upper median size."""
    solid = spans.filter(F.length("text") > 0)
    key = [*PAGE, "line_no"]
    sizes = F.array_sort(F.collect_list("size"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda s: s["text"]), "")
    out = solid.groupBy(*key).agg(
        F.trim(joined).alias("text"), *union_box(), F.avg("origin_y").alias("baseline_y"),
        F.element_at(sizes, (F.floor(F.count("*") / 2) + 1).cast("int")).alias("size"), F.count("*").alias("n_spans"),
    )
    return out.filter(F.length("text") > 0).withColumns({c: round2(F.col(c)) for c in ("x0", "y0", "x1", "y1", "baseline_y")})


def ruling_lines(drawings: DataFrame, thin: float = 3.0, long: float = 20.0) -> DataFrame:
    """A4: drawings that are horizontal or vertical rules."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return drawings.withColumn("is_horizontal", (h <= thin) & (w >= long)).withColumn(
        "is_vertical", (w <= thin) & (h >= long)
    ).filter("is_horizontal or is_vertical")


def scale_boxes(words: DataFrame, dpi: Column) -> DataFrame:
    """Recognised boxes from pixels to points."""
    return words.withColumns({c: round2(F.col(c) * 72.0 / dpi) for c in ("x0", "y0", "x1", "y1")})


def route_pages(pages: DataFrame, words: DataFrame, ocr_words: DataFrame) -> DataFrame:
    """B2: where the words of each page come from, and the warning when they are missing."""
    native = words.groupBy(*PAGE).agg(
        F.count("*").alias("n_words"),
        F.sum(F.length("text") + 1).alias("n_chars"),
        F.sum(F.length(F.regexp_replace("text", r"[^\p{L}]", ""))).alias("n_letters"),
    )
    ocr = ocr_words.groupBy(*PAGE).agg(F.count("*").alias("n_ocr"))
    full = pages.join(native, PAGE, "left").join(ocr, PAGE, "left")
    chars = F.coalesce(F.col("n_chars") - 1, F.lit(0))
    n_words = F.coalesce("n_words", F.lit(0))
    good = (chars >= 40) & (n_words >= 8) & (2 * F.col("n_letters") >= chars)
    plain = (F.col("n_images") == 0) & (F.col("n_drawings") == 0) & (n_words > 0)
    route = (
        F.when(good, "native").when(plain, "native_short").when(F.col("n_ocr") > 0, "ocr").otherwise("best_effort")
    )
    return full.withColumn("route", route).select(
        *PAGE, n_words.alias("n_words"), "route",
        F.when(F.col("route") == "best_effort", "OCR_REQUIRED_BUT_UNAVAILABLE").alias("warning"),
    )


def cluster_lines(words: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Words to lines.

    A word joins the first line whose running mean centre is near enough, so
    the result depends on order. No tolerance on a page exceeds the one its
    tallest word allows; where the centres leave a wider gap, nothing above can
    meet anything below, and the page is cut into bands that are clustered on
    their own. Gaps are found on the occupied two-point cells of the page, a
    small aggregate of the words. Bands are spread by hash and stream through
    each task in order, so a task holds one band at a time.
    """
    keys = keys or PAGE
    cell = 2.0
    placed = words.withColumn("cell", F.floor((F.col("y0") + F.col("y1")) / 2 / cell))
    cells = placed.groupBy(*keys, "cell").agg(F.max(F.col("y1") - F.col("y0")).alias("tall"))
    reach = cells.groupBy(*keys).agg(F.greatest(F.lit(4.0), 0.45 * F.max("tall")).alias("reach"))
    bands = runs(
        cells.select(*keys, "cell").join(reach, keys), keys, F.floor(F.col("cell") / 1024), [F.col("cell")], ["cell", "reach"],
        ["cell"], lambda p: (F.col("cell") - p["cell"] - 1) * cell >= F.col("reach"), "__band",
    )
    banded = placed.join(bands.select(*keys, "cell", "__band"), [*keys, "cell"])
    rows = banded.select(*keys, F.col("__band").alias("band"), "text", "x0", "y0", "x1", "y1")
    spread = rows.repartition(*keys, "band").sortWithinPartitions(*keys, "band", "y0", "x0", "text")
    ids = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in keys)
    schema = f"{ids}, text string, x0 double, y0 double, x1 double, y1 double, n_words bigint"
    n_keys = len(keys)

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [*keys, "text", "x0", "y0", "x1", "y1", "n_words"]
        band, found, out, types = None, [], [], []

        def close() -> None:
            for line in found:
                texts, lefts, tops, rights, bottoms = zip(*sorted(line[2], key=itemgetter(1)))
                out.append((*band[:n_keys], " ".join(texts), min(lefts), min(tops), max(rights), max(bottoms), len(texts)))

        def rows_out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=columns)

        for batch in batches:
            values = [c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns]
            types = [*[c.type for c in batch.columns[:n_keys]], *[c.type for c in batch.columns[n_keys + 1:]], pa.int64()]
            for own, w in zip(zip(*values[: n_keys + 1]), zip(*values[n_keys + 1:])):
                if own != band:
                    close()
                    band, found = own, []
                middle = (w[2] + w[4]) / 2
                for line in found:
                    n = len(line[2])
                    top, bottom = line[0] / n, line[1] / n
                    if abs(middle - (top + bottom) / 2) <= max(4.0, 0.45 * (bottom - top)):
                        break
                else:
                    line = [0.0, 0.0, []]
                    found.append(line)
                line[0] += w[2]
                line[1] += w[4]
                line[2].append(w)
            if out:
                yield rows_out()
                out = []
        close()
        if out:
            yield rows_out()

    lines = spread.mapInArrow(cluster, schema)
    return lines.withColumns({c: round2(F.col(c)) for c in ("x0", "y0", "x1", "y1")})


def reading_order(lines: DataFrame) -> DataFrame:
    """place of every line on its page, top to bottom, left to right."""
    one = F.lit(1).cast("bigint")
    return scan(lines, PAGE, F.floor(F.col("y0") / 2048), [F.col("y0"), F.col("x0"), F.col("line_no")], sums={"position": one})


def block_numbers(lines: DataFrame, floor: float = 12.0, ratio: float = 1.5) -> DataFrame:
    """A new block starts at a gap above max(floor, ratio x mean height of the two lines)."""
    height = F.col("y1") - F.col("y0")
    order = [F.col("y0"), F.col("x0"), F.col("line_no")]

    def wide(p: Column) -> Column:
        return F.col("y0") - p["y1"] > F.greatest(F.lit(floor), ratio * ((p["y1"] - p["y0"]) + height) / 2)

    return runs(lines, PAGE, F.floor(F.col("y0") / 2048), order, ["y0", "y1"], ["y0", "y1"], wide, "block_no")


def joined_text(sep: str, *order: str) -> Column:
    """Texts of a group in order; for groups that are a block, a line or another bounded piece of a page."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda s: s["text"]), sep)


def text_blocks(lines: DataFrame) -> DataFrame:
    """E2 blocks with text and box (D3)."""
    return block_numbers(lines).groupBy(*PAGE, "block_no").agg(
        F.trim(joined_text("\n", "y0", "x0", "line_no")).alias("text"), *union_box(), F.count("*").alias("n_lines")
    )


def _zone(height: Column, rules: Rules) -> Column:
    return F.when(F.col("y1") <= height * rules.header_zone, "header").when(
        F.col("y0") >= height * (1.0 - rules.footer_zone), "footer"
    )


def running_patterns(blocks: DataFrame, pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Texts repeated in the header or footer zone of evenly sampled pages.

    A boilerplate text repeated on every page is counted map-side, first once
    per page, then per book.
    """
    book = pages.groupBy("book_id").agg(F.max("page_no").alias("n_pages"))
    samples = F.least(F.lit(rules.running_sample_pages), F.col("n_pages"))
    sampled = (
        pages.select(*PAGE, "height").join(book, "book_id")
        .withColumn("samples", samples).withColumn("step", F.greatest(F.lit(1), F.floor(F.col("n_pages") / samples)))
        .filter(((F.col("page_no") - 1) % F.col("step") == 0) & (F.floor((F.col("page_no") - 1) / F.col("step")) < F.col("samples")))
    )
    zoned = blocks.join(sampled, PAGE).select(
        *PAGE, "block_no", running_text_key(F.col("text")).alias("pattern"), _zone(F.col("height"), rules).alias("zone")
    ).filter(F.col("zone").isNotNull() & (F.col("pattern") != ""))
    once = zoned.groupBy(*PAGE, "pattern").agg(F.min_by("zone", "block_no").alias("zone"))
    return once.groupBy("book_id", "zone", "pattern").agg(F.count("*").alias("n_pages")).filter(
        (F.col("n_pages") >= rules.running_min_pages) & (F.length("pattern") >= 3)
    )


def drop_running_text(lines: DataFrame, pages: DataFrame, patterns: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Lines without page numbers and running texts in the header and footer zones."""
    placed = lines.join(pages.select(*PAGE, "height"), PAGE).withColumn("__zone", _zone(F.col("height"), rules))
    marked = placed.withColumn("pattern", F.when(F.col("__zone").isNotNull(), running_text_key(F.col("text"))))
    kept = marked.filter(~(F.col("__zone").isNotNull() & is_page_number(F.col("text"))))
    mined = patterns.select("book_id", "pattern").distinct()
    return kept.join(mined, ["book_id", "pattern"], "left_anti").drop("pattern", "height", "__zone")


def body_size(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The usual font size of a scope."""
    return upper_median(lines, keys, "size", "body_size")


__all__ = [
    "block_numbers", "body_size", "clean_words", "cluster_lines", "drop_running_text",
    "joined_text", "reading_order", "route_pages", "ruling_lines", "running_patterns", "scale_boxes", "span_lines",
    "text_blocks", "union_box",
]
