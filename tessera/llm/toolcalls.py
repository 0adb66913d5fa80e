"""Tool-call linking: calls joined to results, ordered, validated and serialised.

Input is a table of calls (conv_id, turn, call_id, name, arguments as JSON text) and one
of results (conv_id, turn, call_id, content).  Results are hash-joined to calls by
conversation and identifier.  A call depends on every call whose identifier occurs in
its arguments as ``{"$ref": "<call_id>"}``; ``depth`` is its place in a topological
order (0: depends on none, else one more than the deepest it needs).  Arguments are
validated against the schema of their tool, and call and result are serialised as
canonical JSON: keys in code point order, no white space, no escapes but the needed.

Defined results of odd input: a call without result has null result columns; of several
results the one of the earliest turn, then smallest content, counts and ``n_results``
tells how many there are; a repeated identifier keeps all its calls, each linked.  Calls
in a cycle, or behind one or behind an unknown identifier, have null depth.  Null or
malformed arguments are invalid and serialised as null.  A null identifier or conversation
links to nothing and has null depth.  Empty tables give empty tables; columns other than the
named ones are left out, whatever their names.  Texts of any length are kept whole.  A schema with an unknown type is refused before anything runs.
Rows are per call, so a conversation of any length is never gathered in one task.

Calls that need one other call form chains; a chain of n calls is ordered in log2(n) rounds of
pointer jumping.  Only calls that need several take a round for each level of such calls.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch, stored

_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value) -> str:
    """Canonical JSON text of a value; infinities and NaN are refused."""
    return whole(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def whole(text: str) -> str:
    """Lone surrogates, which UTF-8 can't hold, written as JSON's escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def problem(value, schema: dict, at: str = "$") -> str | None:
    """The first way in which a value breaks a schema (type, enum, minimum, maximum, maxLength,
    required, properties, additionalProperties, items), or None."""
    if "$ref" in value if isinstance(value, dict) and set(value) == {"$ref"} else False:
        return None  # stands for a result that isn't known yet
    kind = schema.get("type")
    if kind:
        kinds = kind if isinstance(kind, list) else [kind]
        if not any(isinstance(value, _TYPES[k]) and not (isinstance(value, bool) and k in ("integer", "number")) for k in kinds):
            return f"{at}: not {'/'.join(kinds)}"
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        return f"{at}: not in enum"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            return f"{at}: below minimum"
        if value > schema.get("maximum", value):
            return f"{at}: above maximum"
    if isinstance(value, str) and len(value) > schema.get("maxLength", len(value)):
        return f"{at}: too long"
    if isinstance(value, dict):
        properties = schema.get("properties", {})
        for key in schema.get("required", ()):
            if key not in value:
                return f"{at}: lacks {key}"
        for key in sorted(value):
            if key in properties:
                if found := problem(value[key], properties[key], f"{at}.{key}"):
                    return found
            elif schema.get("additionalProperties") is False:
                return f"{at}: unknown {key}"
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            if found := problem(item, schema["items"], f"{at}[{i}]"):
                return found
    return None


def _check_schema(schema: dict) -> None:
    kind = schema.get("type", [])
    unknown = set(kind if isinstance(kind, list) else [kind]) - set(_TYPES)
    if unknown:
        raise ValueError(f"unknown type {', '.join(map(str, unknown))} in a schema")
    for inner in [*schema.get("properties", {}).values(), *([schema["items"]] if "items" in schema else [])]:
        _check_schema(inner)


def references(value) -> set[str]:
    """Identifiers that a value refers to."""
    if isinstance(value, dict):
        if set(value) == {"$ref"} and isinstance(value["$ref"], str):
            return {value["$ref"]}
        return set().union(*map(references, value.values())) if value else set()
    return set().union(*map(references, value)) if isinstance(value, list) and value else set()


def _parse(text: str | None):
    def refuse(x):
        raise ValueError(x)

    return json.loads(text, parse_constant=refuse)


def check_calls(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``calls`` with valid, problem, needs (identifiers) and arguments made canonical (null if malformed)."""
    for known in schemas.values():
        _check_schema(known)
    keep = ["conv_id", "turn", "call_id", "name"]
    frame = calls.select(*keep, F.col("arguments").cast("string").alias("arguments"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in frame.schema] + ["valid boolean", "problem string", "needs array<string>"])

    def judge(name: str | None, text: str | None) -> tuple:
        try:
            value = _parse(text)
            found = problem(value, schemas[name]) if name in schemas else f"unknown tool {name}"
            return canonical(value), found is None, found and whole(found), sorted(map(whole, references(value)))
        except (TypeError, ValueError, RecursionError):
            return None, False, "not JSON", []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [judge(n, a) for n, a in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string()))
            made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *made], names=[*keep, "arguments", "valid", "problem", "needs"])

    return frame.mapInArrow(run, schema)


def _jumped(single: DataFrame) -> DataFrame:
    """(conv_id, call_id, to, dist) of calls with one need each, (conv_id, call_id, to): the first
    call on the way back that is not one of them, and how far it is; calls of cycles are left out."""
    far = single.select("conv_id", F.col("call_id").alias("to"), F.lit(True).alias("open"))
    pointers = stored(single.join(far, ["conv_id", "to"], "left").select("conv_id", "call_id", "to", F.lit(1).alias("dist"), F.coalesce("open", F.lit(False)).alias("open")), "pointers")
    left = pointers.filter("open").count()
    while left:
        ahead = pointers.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("dist").alias("more"), F.col("open").alias("still"))
        moved = pointers.filter("open").join(ahead, ["conv_id", "to"]).select("conv_id", "call_id", F.col("next").alias("to"), (F.col("dist") + F.col("more")).alias("dist"), F.col("still").alias("open"))
        pointers = stored(pointers.filter("not open").unionByName(moved), "pointers")
        now = pointers.filter("open").count()
        if now == left:  # a call nearest to its chain's end always gets there, so these go round
            break
        left = now
    return pointers.filter("not open").drop("open")


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth) of the calls of (conv_id, call_id, needs) that can be ordered."""
    spark, key = calls.sparkSession, ["conv_id", "call_id"]
    known = calls.filter(F.col("call_id").isNotNull() & F.col("conv_id").isNotNull())
    edges = stored(known.select(*key, F.explode("needs").alias("need")).distinct(), "needs")
    n_needs = stored(edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("need").alias("to")), "n-needs")
    base = scratch(spark, "depths")
    known.select(*key).distinct().join(n_needs, key, "left_anti").select(*key, F.lit(0).alias("depth")).write.parquet(f"{base}/round=0")
    schema = f"conv_id {known.schema['conv_id'].dataType.simpleString()}, call_id string, depth int"
    fresh = spark.read.schema(schema).parquet(f"{base}/round=0")
    pointers = _jumped(n_needs.filter("n = 1").select(*key, "to"))
    several = edges.join(n_needs.filter("n > 1").select(*key), key, "left_semi")
    via = pointers.select("conv_id", F.col("call_id").alias("need"), "to", "dist")
    state = stored(several.join(via, ["conv_id", "need"], "left").select(*key, F.coalesce("to", "need").alias("anchor"), F.coalesce("dist", F.lit(0)).alias("add"), F.lit(None).cast("int").alias("depth")), "several")
    n = 0
    while not state.isEmpty():
        met = fresh.select("conv_id", F.col("call_id").alias("anchor"), F.col("depth").alias("found"))
        state = stored(state.join(met, ["conv_id", "anchor"], "left").select(*key, "anchor", "add", F.coalesce("depth", F.col("found") + F.col("add")).alias("depth")), "several")
        ready = state.groupBy(*key).agg(F.count_if(F.col("depth").isNull()).alias("open"), F.max("depth").alias("deepest")).filter("open = 0")
        n += 1
        ready.select(*key, (F.col("deepest") + 1).alias("depth")).write.parquet(f"{base}/round={n}")
        fresh = spark.read.schema(schema).parquet(f"{base}/round={n}")
        if fresh.isEmpty():
            break
        state = state.join(fresh.select(*key), key, "left_anti")
    done = spark.read.schema(schema).parquet(*[f"{base}/round={i}" for i in range(n + 1)])
    ends = done.select("conv_id", F.col("call_id").alias("to"), "depth")
    return done.unionByName(pointers.join(ends, ["conv_id", "to"]).select(*key, (F.col("depth") + F.col("dist")).alias("depth")))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call: conv_id, turn, call_id, name, valid, problem, depth, n_results,
    result_turn, canonical (JSON of arguments, id, name and result)."""
    checked = stored(check_calls(calls, schemas), "checked")
    first = results.filter(F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.count("*").alias("n_results"), F.min(F.struct("turn", "content")).alias("first"))
    order = depths(checked.select("conv_id", "call_id", "needs"))
    linked = checked.join(order, ["conv_id", "call_id"], "left").join(first, ["conv_id", "call_id"], "left")
    return linked.select(
        "conv_id", "turn", "call_id", "name", "valid", "problem", "depth",
        F.coalesce("n_results", F.lit(0)).alias("n_results"), F.col("first.turn").alias("result_turn"),
        _call_json(F.col("arguments"), F.col("call_id"), F.col("name"), F.col("first.content")).alias("canonical"),
    )


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """The results that answer no call."""
    return results.join(calls.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")


def _text_json(c):
    """A string column as JSON text; null as null."""
    inner = F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    return F.when(c.isNull(), "null").otherwise(inner)


def _call_json(arguments, call_id, name, content):
    """Keys stand in code point order; ``arguments`` is canonical already."""
    return F.concat(F.lit('{"arguments":'), F.coalesce(arguments, F.lit("null")), F.lit(',"id":'), _text_json(call_id), F.lit(',"name":'), _text_json(name), F.lit(',"result":'), _text_json(content), F.lit("}"))
