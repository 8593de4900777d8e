"""Linking tool calls with their results in chats.

Calls and results are hash-joined by (conversation, identifier). Calls stand in the
order of their turns, changed only where a call names a later one as its precondition: such
references span segments of the conversation, and a topological sort runs inside each
segment. Arguments are validated against the tool's schema, and every
record is serialised as canonical JSON: sorted keys, no spaces, no escapes beyond JSON's own.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, Mapping
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import running
from folio.operators.ordered import scan
from folio.runtime import cut, table

#: Tools of plain chats: a user's turn asks for a reply, a system's turn instructs.
CHAT_TOOLS: dict[str, dict[str, Any]] = {
    name: {
        "type": "object",
        "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
        "required": ["text", "turn"],
        "additionalProperties": False,
    }
    for name in ("reply", "instruct")
}

_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
}


def violations(value: Any, schema: Mapping[str, Any], path: str = "$") -> list[str]:
    """What in `value` breaks the schema: type, enum, required, properties, items, and bounds of lengths and numbers."""
    kinds = schema.get("type")
    if kinds is not None and not any(_TYPES[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{path}: not of type {kinds}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{path}.{k}: not allowed")
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            out += violations(item, schema["items"], f"{path}[{i}]")
    size = len(value) if isinstance(value, str | list) else None
    for low, high in (("minLength", "maxLength"), ("minItems", "maxItems")):
        if size is not None and (size < schema.get(low, 0) or size > schema.get(high, size)):
            out.append(f"{path}: bad length")
    if _TYPES["number"](value) and (value < schema.get("minimum", value) or value > schema.get("maximum", value)):
        out.append(f"{path}: out of range")
    return out


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _no_constant(name: str) -> None:
    raise ValueError(name)


def parsed(text: str | None) -> tuple[Any, bool]:
    """(value, True) of a JSON text, or (the text itself, False)."""
    try:
        value = json.loads(text or "", parse_constant=_no_constant)
        canonical(value)  # numbers too large for a double cannot be written again
        return value, True
    except (ValueError, RecursionError):
        return text, False


def kahn(calls: list[int], before: list[tuple[int, int]]) -> tuple[list[int], set[int]]:
    """(calls in topological order, smallest first among the free ones; those on or behind a cycle, put last in their order).

    `before` holds (earlier, later) pairs.
    """
    waits = dict.fromkeys(calls, 0)
    then: dict[int, list[int]] = {}
    for a, b in before:
        if a in waits and b in waits:
            waits[b] += 1
            then.setdefault(a, []).append(b)
    free = [c for c in calls if not waits[c]]
    heapq.heapify(free)
    out = []
    while free:
        call = heapq.heappop(free)
        out.append(call)
        for b in then.get(call, ()):
            waits[b] -= 1
            if not waits[b]:
                heapq.heappush(free, b)
    stuck = {c for c in calls if waits[c]}
    return out + sorted(stuck), stuck


def _sorted_segment(rows: pd.DataFrame) -> pd.DataFrame:
    """New places of the calls of one segment; rows are (conversation, segment, place, needs: place it must follow, or null)."""
    places = sorted(rows["place"].unique().tolist())
    pairs = rows.dropna(subset=["needs"])
    order, stuck = kahn(places, list(zip(pairs["needs"].astype(int).tolist(), pairs["place"].tolist())))
    return pd.DataFrame({"no_conv": rows["no_conv"].iloc[0], "conv": rows["conv"].iloc[0], "place": order, "moved_to": places, "cyclic": [p in stuck for p in order]})


def ordered(calls: DataFrame) -> DataFrame:
    """(row_id, position, cyclic, n_missing) of (row_id, no_conv, conv, turn, call_id, after).

    position counts from 1 in each conversation and puts every call behind those it names in
    `after`; among the free ones the earlier turn comes first. Names that no call of the conversation
    bears are counted as missing. Calls on a cycle, or behind one, stand last in their segment.
    """
    key = ["no_conv", "conv"]
    placed = cut(running(calls.select("row_id", *key, "turn", "call_id"), key, ["turn", "call_id", "row_id"], {}, "place"), "places")
    named = placed.filter("call_id is not null").groupBy(*key, "call_id").agg(F.min("place").alias("needs"))
    wants = calls.select("row_id", *key, F.explode(F.array_distinct("after")).alias("call_id"))
    edges = cut(
        wants.join(named, [*key, "call_id"], "left").join(placed.select("row_id", "place"), "row_id").select("row_id", *key, "place", "needs"),
        "edges",
    )
    missing = edges.filter("needs is null").groupBy("row_id").agg(F.count("*").alias("n_missing"))
    forward = edges.filter("needs >= place")
    base = placed.select("row_id", *key, "place")
    if forward.isEmpty():
        moved = base.select("row_id", F.col("place").alias("position"), F.lit(False).alias("cyclic"))
    else:
        reach = forward.groupBy(*key, "place").agg(F.max("needs").alias("reach"))
        touched = base.join(forward.select(*key).distinct(), key).join(reach, [*key, "place"], "left")
        # A segment starts where no reference from further up reaches.
        block = F.floor(F.col("place") / 1000)
        seen = scan(touched, key, block, [F.col("place")], maxes_before={"until": F.col("reach")})
        opened = seen.withColumn("opens", (F.coalesce("until", F.lit(0)) < F.col("place")).cast("bigint"))
        parts = cut(scan(opened, key, block, [F.col("place")], sums={"segment": F.col("opens")}), "segments")
        busy = parts.filter("reach is not null").select(*key, "segment").distinct()
        inside = parts.select(*key, "segment", "place").join(busy, [*key, "segment"])
        needs = edges.filter("needs is not null").select(*key, "place", "needs")
        again = inside.join(needs, [*key, "place"], "left").groupBy(*key, "segment").applyInPandas(
            _sorted_segment, "no_conv boolean, conv string, place bigint, moved_to bigint, cyclic boolean"
        )
        moved = base.join(again, [*key, "place"], "left").select(
            "row_id", F.coalesce("moved_to", "place").alias("position"), F.coalesce("cyclic", F.lit(False)).alias("cyclic")
        )
    return moved.join(missing, "row_id", "left").withColumn("n_missing", F.coalesce("n_missing", F.lit(0)))


def link(calls: DataFrame, results: DataFrame, tools: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """One row for each call and each result without a call.

    calls: conv_id, turn, call_id, name, arguments (JSON text), after (identifiers it needs).
    results: conv_id, turn, call_id, content.
    Returns conv_id, turn, call_id, status (answered, unanswered, orphan), position (null for
    orphans), valid, errors (joined by '; ', empty if none), record (canonical JSON).
    A call takes the result with its identifier from the earliest turn; repeated results and repeated
    calls of an identifier share it. Null identifiers link with nothing. Arguments that are
    not JSON and unknown tools are errors. A null conversation is one conversation; empty
    tables give no rows.
    """
    rows = cut(
        calls.select("conv_id", "turn", "call_id", "name", "arguments", "after").withColumn("row_id", F.monotonically_increasing_id()), "calls"
    )
    keyed = rows.withColumn("no_conv", F.col("conv_id").isNull()).withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    order = ordered(keyed)
    first = results.filter("call_id is not null").groupBy(
        F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call")
    ).agg(F.min_by(F.struct("content"), F.struct("turn", "content")).alias("result"))
    same = rows["conv_id"].eqNullSafe(F.col("r_conv")) & (rows["call_id"] == F.col("r_call"))
    answered = rows.join(first, same, "left").join(order, "row_id").select(
        "conv_id", "turn", "call_id", F.when(F.col("result").isNull(), "unanswered").otherwise("answered").alias("status"),
        "position", "name", "arguments", F.col("result.content").alias("content"), "cyclic", "n_missing",
    )
    ids = rows.filter("call_id is not null").select(F.col("conv_id").alias("c_conv"), F.col("call_id").alias("c_call")).distinct()
    known = results["conv_id"].eqNullSafe(F.col("c_conv")) & (results["call_id"] == F.col("c_call"))
    orphans = results.join(ids, known, "left_anti").select(
        "conv_id", "turn", "call_id", F.lit("orphan").alias("status"), F.lit(None).cast("bigint").alias("position"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("arguments"), "content", F.lit(False).alias("cyclic"), F.lit(0).cast("bigint").alias("n_missing"),
    )
    schemas = dict(tools)

    def records(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            valid, errors, texts = [], [], []
            for r in part.to_pylist():
                found: list[str] = []
                record: dict[str, Any] = {"id": r["call_id"], "result": r["content"]}
                if r["status"] != "orphan":
                    value, is_json = parsed(r["arguments"])
                    if r["name"] not in schemas:
                        found.append("unknown tool")
                    elif is_json:
                        found += violations(value, schemas[r["name"]])
                    if not is_json:
                        found.append("arguments: not JSON")
                    if r["cyclic"]:
                        found.append("after: cycle")
                    if r["n_missing"]:
                        found.append(f"after: {r['n_missing']} missing")
                    record |= {"arguments": value, "name": r["name"], "position": r["position"]}
                else:
                    found.append("no call")
                valid.append(not found)
                errors.append("; ".join(found))
                texts.append(canonical(record))
            kept = [part.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(valid, pa.bool_()), pa.array(errors, pa.string()), pa.array(texts, pa.string())],
                ["conv_id", "turn", "call_id", "status", "position", "valid", "errors", "record"],
            )

    return answered.unionByName(orphans).mapInArrow(
        records, "conv_id bigint, turn bigint, call_id string, status string, position bigint, valid boolean, errors string, record string"
    )


def from_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) from chat messages that carry tool calls as JSON.

    An assistant's text {"tool_calls": [{"id", "name", "arguments", "after"}]} makes calls, a tool's text
    {"tool_call_id", "content"} a result; other messages make neither.
    """
    call = "tool_calls array<struct<id:string,name:string,arguments:string,after:array<string>>>"
    made = messages.filter("role = 'assistant'").select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.explode(F.from_json("text", call)["tool_calls"]).alias("c")
    )
    none = F.array().cast("array<string>")
    calls = made.select("conv_id", "turn", F.col("c.id").alias("call_id"), "c.name", "c.arguments", F.coalesce("c.after", none).alias("after"))
    got = messages.filter("role = 'tool'").withColumn("r", F.from_json("text", "tool_call_id string, content string"))
    results = got.filter("r.tool_call_id is not null or r.content is not null").select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content")
    )
    return calls, results


def from_turns(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) from plain chats: a user's or system's turn is a call, named by its turn, that needs the call
    two turns before; an assistant's turn is the result of the turn before it."""
    conv, turn = F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint")

    def name(back: int):
        return F.concat(F.coalesce(conv.cast("string"), F.lit("")), F.lit(":"), (turn - back).cast("string"))

    calls = messages.filter("role in ('user', 'system')").select(
        conv.alias("conv_id"), turn.alias("turn"), name(0).alias("call_id"), F.when(F.col("role") == "user", "reply").otherwise("instruct").alias("name"),
        F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"), turn.alias("turn"))).alias("arguments"),
        F.when((F.col("role") == "user") & (turn >= 2), F.array(name(2))).otherwise(F.array().cast("array<string>")).alias("after"),
    )
    results = messages.filter("role = 'assistant'").select(conv.alias("conv_id"), turn.alias("turn"), name(1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op6_tool_calls(spark, sf_dir: str) -> DataFrame:
    """Calls and results of all conversations, each user's turn being a call that the next turn answers."""
    calls, results = from_turns(table(spark, sf_dir, "conversations"))
    return link(calls, results, CHAT_TOOLS)


OP6_SQL = """
WITH c AS (SELECT *, CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS call_id FROM conversations),
r AS (SELECT *, CAST(conv_id AS VARCHAR) || ':' || CAST(turn - 1 AS VARCHAR) AS call_id FROM conversations WHERE role = 'assistant'),
calls AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM c WHERE role IN ('user', 'system')),
linked AS (
  SELECT calls.conv_id, calls.turn, calls.call_id, r.conv_id IS NOT NULL AS found, position, calls.text, calls.role, r.text AS content,
    calls.role = 'user' AND calls.turn >= 2 AND NOT EXISTS (SELECT 1 FROM calls AS p WHERE p.conv_id = calls.conv_id AND p.turn = calls.turn - 2) AS missing
  FROM calls LEFT JOIN r ON r.conv_id = calls.conv_id AND r.call_id = calls.call_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, call_id, CASE WHEN found THEN 'answered' ELSE 'unanswered' END AS status, position,
  text <> '' AND NOT missing AS valid,
  concat_ws('; ', CASE WHEN text = '' THEN '$.text: bad length' END, CASE WHEN missing THEN 'after: 1 missing' END) AS errors,
  CAST(json_object('arguments', json_object('text', text, 'turn', turn), 'id', call_id,
    'name', CASE WHEN role = 'user' THEN 'reply' ELSE 'instruct' END, 'position', position, 'result', content) AS VARCHAR) AS record
FROM linked
UNION ALL
SELECT CAST(conv_id AS BIGINT), CAST(turn AS BIGINT), call_id, 'orphan', NULL, false, 'no call',
  CAST(json_object('id', call_id, 'result', text) AS VARCHAR)
FROM r WHERE NOT EXISTS (SELECT 1 FROM calls WHERE calls.conv_id = r.conv_id AND calls.call_id = r.call_id)
"""
