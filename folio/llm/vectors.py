"""Embedding near-duplicates from int8 tile products with error bounds.

Equal vectors of a label are one class with a number of copies. The classes of a label are
dealt into blocks of about BLOCK, and each pair of blocks is one tile, a task of its
own. In a tile each unit vector u is written as s*q + e with int8 codes q, and
    |u.v - s_u s_v q_u.q_v| <= |s_u q_u| |e_v| + |e_u| |s_v q_v| + |e_u| |e_v|,
with the norms of both parts computed for every vector. The product of codes (exact:
sums of int8 products stay below 2**24 in single precision) decides the pairs whose bound lies on one side of
the threshold; only the others are computed again in double precision. A tile returns a
count per class and a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.components import components
from folio.runtime import cut, table

THRESHOLD = 0.93
BLOCK = 2048
#: Longest run of dimensions whose int8 products are exact in single precision: 1040 * 127**2 < 2**24.
EXACT_DIMS = 1040
#: Rounding of the double-precision arithmetic that the bounds themselves are computed in.
SLACK = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale, norm of the coded part and norm of the remainder of each row."""
    scale = np.abs(unit).max(axis=1, initial=0.0) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(coded, axis=1), np.linalg.norm(unit - coded, axis=1)


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 codes, as double."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT_DIMS):
        out += a[:, at : at + EXACT_DIMS].astype(np.float32) @ b[:, at : at + EXACT_DIMS].astype(np.float32).T
    return out


def tile_links(left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Boolean matrix of the pairs with cosine >= threshold. Rows are finite and not zero."""
    u = left / np.linalg.norm(left, axis=1)[:, None]
    v = right / np.linalg.norm(right, axis=1)[:, None]
    qu, su, cu, eu = quantise(u)
    qv, sv, cv, ev = quantise(v)
    near = code_products(qu, qv) * su[:, None] * sv
    slack = cu[:, None] * ev + eu[:, None] * cv + eu[:, None] * ev + SLACK
    linked = near - slack >= threshold
    i, j = np.nonzero((near + slack >= threshold) & ~linked)
    for at in range(0, len(i), 1 << 16):  # memory stays bounded however many pairs are in doubt
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        linked[a, b] = np.einsum("ij,ij->i", u[a], v[b]) >= threshold
    return linked


def spanning(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (left id, right id) that join the rows of a link matrix into the same components."""
    owner = np.full(linked.shape[0], -1)
    edges: list[tuple[int, int]] = []
    for start in np.flatnonzero(linked.any(axis=1)):
        if owner[start] >= 0:
            continue
        owner[start], fresh = start, np.array([start])
        done = np.zeros(linked.shape[1], bool)
        while len(fresh):
            columns = np.flatnonzero(linked[fresh].any(axis=0) & ~done)
            done[columns] = True
            edges += [(left[fresh[linked[fresh, c].argmax()]], right[c]) for c in columns]
            reached = np.flatnonzero(linked[:, columns].any(axis=1) & (owner < 0)) if len(columns) else np.array([], int)
            edges += [(left[r], right[columns[linked[r, columns].argmax()]]) for r in reached]
            owner[reached], fresh = start, reached
    return edges


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    lo, hi = rows["lo"].iloc[0], rows["hi"].iloc[0]
    rows = rows.sort_values("rep_id")
    a = rows[rows["block"] == lo]
    b = a if lo == hi else rows[rows["block"] == hi]
    out = {"rep_id": [], "n": [], "other": []}
    if len(a) and len(b):
        u, v = (np.stack(x["embedding"].to_numpy()).astype(np.float64) for x in (a, b))
        linked = tile_links(u, v)
        if lo == hi:
            np.fill_diagonal(linked, False)
        ids, jds = a["rep_id"].to_numpy(), b["rep_id"].to_numpy()
        counts = [(ids, linked @ b["copies"].to_numpy())]
        if lo != hi:
            counts.append((jds, linked.T @ a["copies"].to_numpy()))
        for names, n in counts:
            out["rep_id"] += names[n > 0].tolist()
            out["n"] += n[n > 0].tolist()
            out["other"] += [None] * int((n > 0).sum())
        for x, y in spanning(linked, ids, jds):
            out["rep_id"].append(int(x))
            out["n"].append(0)
            out["other"].append(int(y))
    frame = pd.DataFrame(out)
    return frame.astype({"rep_id": "int64", "n": "int64", "other": "Int64"})


def near_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label).

    Vectors are compared within their label only. A vector that is null, empty or
    zero or holds a null or non-finite component, and a vector without label, links with
    nothing: it has no links and is its own component.
    Equal vectors link with each other; repeated rows count as copies. Vectors of
    different length never link. vec_id must not be null; an empty table gives no rows;
    other columns are not read.
    """
    slim = rows.select(F.col("vec_id").cast("bigint"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    marked = slim.withColumn("usable", F.coalesce(usable, F.lit(False)))
    exact = marked.filter("usable").withColumn("dims", F.size("embedding"))
    key = ["label", "dims", "embedding"]
    classes = cut(
        exact.groupBy(*key).agg(F.min("vec_id").alias("rep_id"), F.count("*").alias("copies")), "classes"
    )
    sizes = classes.groupBy("label", "dims").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = classes.join(sizes, ["label", "dims"]).withColumn("block", F.pmod(F.xxhash64("rep_id"), F.col("blocks")).cast("int"))
    spread = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = spread.select(
        "label", "dims", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "rep_id", "copies", "embedding"
    )
    found = cut(tiles.groupBy("label", "dims", "lo", "hi").applyInPandas(_tile, "rep_id bigint, n bigint, other bigint"), "tiles")
    links = found.filter("other is null").groupBy("rep_id").agg(F.sum("n").alias("n"))
    roots = components(found.filter("other is not null").select(F.col("rep_id").alias("a"), F.col("other").alias("b")))
    named = classes.join(links, "rep_id", "left").join(roots.withColumnRenamed("node", "rep_id"), "rep_id", "left").select(
        *key, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep_id").alias("component_id")
    )
    linked = exact.join(named, key).select("vec_id", "n_links", "component_id")
    alone = marked.filter("not usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op7_near_vectors(spark, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.root),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT r.vec_id, coalesce(any_value(n), 0) AS n_links, min(root) AS component_id, r.vec_id = min(root) AS kept FROM r LEFT JOIN n ON n.a = r.vec_id GROUP BY r.vec_id
"""
