"""Values folded along trees, against plain loops over parents."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folio.operators import tree

SCHEMA = "node_id string, parent_id string"


def chains(parents):
    """Proper ancestors of each node, nearest first, among known nodes."""
    out = {}
    for node in parents:
        line, at = [], parents[node]
        while at in parents:
            line.append(at)
            at = parents[at]
        out[node] = line
    return out


def test_selection_against_loops(spark):
    rng = random.Random(4)
    parents = {f"n{i}": None if rng.random() < 0.02 else "gone" if rng.random() < 0.02 else f"n{max(0, i - rng.randint(1, 12))}" for i in range(1, 900)}
    parents["n0"] = None
    chosen = {n for n in parents if rng.random() < 0.2} | {n for n in parents if n.endswith("7")}
    over = chains(parents)
    below = {n: [] for n in parents}
    for node, line in over.items():
        for top in line:
            below[top].append(node)
    nodes = spark.createDataFrame(list(parents.items()), SCHEMA)
    selected = spark.createDataFrame([(n,) for n in sorted(chosen)] * 2 + [("nowhere",)], "node_id string")

    got = {r.node_id: tuple(r)[1:] for r in tree.selection_state(nodes, selected).collect()}
    for node, under in below.items():
        hit = len(chosen.intersection(under))
        state = "checked" if under and hit == len(under) else "indeterminate" if hit else "checked" if node in chosen else "unchecked"
        assert got[node] == (len(under), hit, state)
    assert len(got) == len(parents)

    kept = {r.node_id for r in tree.prune_selection(selected, nodes).collect()}
    assert kept == {n for n in chosen if not chosen.intersection(over[n])} | {"nowhere"}


def test_a_long_path_ends_in_few_rounds(spark, monkeypatch):
    rounds = []
    plain = tree.cut

    def counted(df, label):
        rounds.append(label)
        return plain(df, label)

    monkeypatch.setattr(tree, "cut", counted)
    n = 100_000
    path = spark.range(n).select(
        F.format_string("p%d", "id").alias("node_id"), F.when(F.col("id") > 0, F.format_string("p%d", F.col("id") - 1)).alias("parent_id")
    )
    last = spark.createDataFrame([(f"p{n - 1}",)], "node_id string")
    state = tree.selection_state(path, last)
    sums = state.agg(F.sum("n_below"), F.sum("n_hit"), F.count_if(F.col("state") == "indeterminate")).first()
    assert tuple(sums) == (n * (n - 1) // 2, n - 1, n - 2)  # the node before the last is checked: all below it is selected
    assert len(rounds) <= 18


def test_empty_trees_and_cycles(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert tree.selection_state(none, none.select("node_id")).count() == 0
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], SCHEMA)
    with pytest.raises(ValueError, match="cycle"):
        tree.selection_state(ring, ring.select("node_id"))


def test_nested_trees_parse_back(spark):
    """Random forests and a deep chain: the JSON of a root, walked in order, is its tree."""
    import json

    rnd = random.Random(11)
    rows = []
    for i in range(400):
        known = [r for r in rows if r[3] < 6]
        parent = rnd.choice(known) if known and rnd.random() < 0.9 else None
        title = rnd.choice(['a "quoted" name', "plain", None, "new\nline", "[]}{,"])
        rows.append((f"v{i % 1}", f"n{i}", parent[1] if parent else rnd.choice([None, "gone"]), parent[3] + 1 if parent else 0, rnd.randint(0, 9), title))
    rows += [("w", f"d{i}", f"d{i - 1}" if i else None, i, 0, "deep") for i in range(70)]
    df = spark.createDataFrame(rows, "version_id string, node_id string, parent_id string, depth long, ordinal long, title string")
    ids = {r[1] for r in rows}
    below = {}
    for r in sorted(rows, key=lambda r: (r[3], r[4], r[1])):
        below.setdefault(r[2] if r[2] in ids else (r[0],), []).append(r)

    def nest(r):
        return {"node_id": r[1], "title": r[5], "children": [nest(c) for c in below.get(r[1], [])]}

    want = {(v, i + 1): nest(r) for v in ("v0", "w") for i, r in enumerate(below[(v,)])}
    made = tree.nested_trees(df, ["node_id", "title"]).collect()
    assert {(r["version_id"], r["root_no"]): json.loads(r["tree"]) for r in made} == want
    assert sum(r["n_nodes"] for r in made) == len(rows)
    loop = spark.createDataFrame([("v", "a", "b", 0, 0, "t"), ("v", "b", "a", 1, 0, "t")], df.schema)
    with pytest.raises(ValueError, match="cycle"):
        tree.nested_trees(loop, ["node_id"])
