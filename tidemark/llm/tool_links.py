"""Chat formatting: links tool calls to their results and writes canonical JSON lines.

Calls and results meet by an equi join on (conv_id, call_id), after each side is reduced to
one row per identifier by hash aggregation (so a conversation with a third of all rows is
spread over the cluster; AQE splits what is left).  Topological order: a call's level is
one more than the highest level of the calls it depends on, found in rounds that each
settle the calls whose dependencies are settled, as many rounds as the longest chain; calls on a
cycle, or behind one, get no level.  Within a conversation, lines follow (level, turn,
call_id).  Arguments are checked against a JSON schema by tool name (type, required,
properties, additionalProperties, items, enum, minimum, maximum).

Canonical JSON: keys sorted, no spaces, characters not escaped where JSON allows (half a
surrogate pair is).

Status: ok, invalid (arguments break their schema, aren't a JSON object, hold NaN or a number
out of range, or are nested too deep; they are then written as text), no_schema
(unknown tool), no_result, no_call (a result without a call), cycle.  The first that
applies of no_call, cycle, invalid, no_schema, no_result counts.

Defined cases: of several calls (results) with one identifier the least (turn, name,
arguments) counts and ``copies`` says how many there were; rows without conv_id or call_id
are left out; dependencies on unknown calls, on the call itself, and null ones are
ignored; null arguments are an empty object; null content is JSON null; empty tables give
empty results.
"""

import json
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

_TYPES = {
    "object": dict,
    "array": list,
    "string": str,
    "boolean": bool,
    "null": type(None),
    "number": (int, float),
    "integer": int,
}


_LONE = re.compile("[\ud800-\udfff]")  # half a character: JSON may hold it, UTF-8 can't


def canonical(value) -> str:
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return _LONE.sub(lambda half: f"\\u{ord(half[0]):04x}", text)


def _finite(number: str) -> float:
    if not math.isfinite(value := float(number)):
        raise ValueError(f"{number} is out of range")
    return value


def _no_number(name: str):
    raise ValueError(f"{name} is no JSON")


def parsed(arguments: str | None) -> dict | None:
    """Arguments as an object; None if they are none: no JSON, numbers out of range, nested too deep to be written again."""
    if arguments is None:
        return {}
    try:
        value = json.loads(arguments, parse_float=_finite, parse_constant=_no_number)
        canonical(value)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _is(value, kind: str) -> bool:
    return isinstance(value, _TYPES[kind]) and not (kind in ("integer", "number") and isinstance(value, bool))


def checked(schema) -> None:
    """Raises for a schema with types that are none, before any row is read."""
    if not isinstance(schema, dict):
        if not isinstance(schema, bool):
            raise ValueError(f"no schema: {schema!r}")
        return
    kinds = schema.get("type", [])
    for kind in [kinds] if isinstance(kinds, str) else kinds:
        if kind not in _TYPES:
            raise ValueError(f"unknown type {kind!r}")
    for below in [*schema.get("properties", {}).values(), schema.get("items", True)]:
        checked(below)


def conforms(value, schema: dict | bool) -> bool:
    if isinstance(schema, bool):
        return schema
    kinds = schema.get("type", [])
    if kinds and not any(_is(value, kind) for kind in ([kinds] if isinstance(kinds, str) else kinds)):
        return False
    if "enum" in schema and value not in schema["enum"]:
        return False
    if _is(value, "number"):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            return False
    if isinstance(value, list):
        return all(conforms(x, schema.get("items", True)) for x in value)
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if any(k not in value for k in schema.get("required", ())):
            return False
        if schema.get("additionalProperties") is False and any(k not in known for k in value):
            return False
        return all(conforms(value[k], known[k]) for k in value if k in known)
    return True


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of calls (conv_id, call_id, depends_on); no row for calls on or behind a cycle."""
    edges = (
        calls.select("conv_id", "call_id", F.explode(F.array_distinct("depends_on")).alias("before"))
        .where("before <> call_id")
        .join(calls.select("conv_id", F.col("call_id").alias("before")), ["conv_id", "before"])
    )
    edges = stored(edges.select("conv_id", "before", "call_id"), "dependencies")
    waiting = edges.select("conv_id", "call_id").distinct()
    settled = calls.select("conv_id", "call_id").join(waiting, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0))
    settled = stored(settled, "levels")
    done = settled
    while True:
        # One round: edges whose start is settled; a call is settled when all its edges are.
        after = done.select("conv_id", F.col("call_id").alias("before"), F.col("level").alias("at"))
        ready = (
            edges.join(after, ["conv_id", "before"], "left")
            .groupBy("conv_id", "call_id")
            .agg(F.max("at").alias("at"), F.count("*").alias("n"), F.count("at").alias("ready"))
            .where("n = ready")
            .join(done, ["conv_id", "call_id"], "left_anti")
        )
        new = stored(ready.select("conv_id", "call_id", (F.col("at") + 1).alias("level")), "levels")
        if new.isEmpty():
            return done
        done = done.union(new)


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conv_id, call_id, turn, level, copies, status, line: one row per identifier.

    calls: conv_id, call_id, turn, name, arguments (JSON), depends_on (array of call_id).
    results: conv_id, call_id, turn, content.  schemas: JSON schema by tool name.
    """
    for schema in schemas.values():
        checked(schema)
    there = "conv_id is not null and call_id is not null"
    called = stored(
        calls.where(there)
        .groupBy("conv_id", "call_id")
        .agg(
            F.min(F.struct("turn", "name", "arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))).alias("c"),
            F.count("*").alias("copies"),
        )
        .select("conv_id", "call_id", "copies", "c.*"),
        "calls",
    )
    answered = results.where(there).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n"))
    joined = called.join(levels(called), ["conv_id", "call_id"], "left").join(answered, ["conv_id", "call_id"], "full_outer")

    @F.pandas_udf("struct<fits: string, line: string>")
    def written(call_id: pd.Series, name: pd.Series, arguments: pd.Series, content: pd.Series) -> pd.DataFrame:
        fits, lines = [], []
        for i, n, a, c in zip(call_id, name, arguments, content):
            value, known = parsed(a), n in schemas
            fits.append("invalid" if value is None or (known and not conforms(value, schemas[n])) else "ok" if known else "no_schema")
            lines.append(canonical({"id": i, "name": n, "arguments": a if value is None else value, "result": c}))
        return pd.DataFrame({"fits": fits, "line": lines})

    out = joined.select("*", written("call_id", "name", "arguments", F.col("r.content")).alias("w"))
    status = (
        F.when(F.col("copies").isNull(), "no_call")
        .when(F.col("level").isNull(), "cycle")
        .when(F.col("w.fits") != "ok", F.col("w.fits"))
        .when(F.col("n").isNull(), "no_result")
        .otherwise("ok")
    )
    return out.select(
        "conv_id",
        "call_id",
        F.coalesce("turn", "r.turn").alias("turn"),
        "level",
        F.coalesce("copies", "n").alias("copies"),
        status.alias("status"),
        F.col("w.line").alias("line"),
    )
