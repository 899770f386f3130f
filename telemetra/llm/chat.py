"""Chat records with linked tool calls.

An assistant turn whose text is a JSON object with `tool_calls` makes calls (id, depends_on, and name and arguments,
alone or within `function`); a turn of role tool whose text has a `tool_call_id` is a result. Calls and results meet in a hash join on conversation and
identifier; a call's level is the length of the longest chain of calls that it depends on, found by joins, level
by level; all is written as canonical JSON (sorted keys, no spaces, no escapes beyond JSON's own). A turn of role
system or developer whose text is a JSON object with `tools` defines tools: name and `parameters` (or `input_schema`),
alone or within `function`. Calls meet the definitions of their conversation in a join on conversation and name, and
arguments are checked against the definition in force at the call, the last one not after its turn.

Defined results: a turn that isn't JSON is a plain message; null roles and texts stay null in the JSON; calls
without a result, results without a call and dependencies that don't exist or go round (level null) are reported, never
dropped; the k-th call with an identifier meets the k-th result with it, by turn, so a repeated one makes no more rows
than turns; arguments that aren't JSON, or are nested too deep to be read, have false `valid`; tools without a schema, and schemas that are broken or use keywords in `_UNAPPLIED`, have null `valid`; texts of any length are read whole; other columns are ignored, whatever their names; an empty table is empty; one row
per turn without calls and one per call, so no conversation is ever gathered in one place. What a turn says beside its
calls makes one more row, a message with place -1: its `content`, other fields that it has (`fields`) and text after
the JSON object (`after`).
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,depends_on:array<string>,function:struct<name:string,arguments:string>>>>"
RESULT = "struct<tool_call_id:string,content:string>"
TOOLS = "struct<tools:array<struct<name:string,parameters:string,input_schema:string,function:struct<name:string,parameters:string>>>>"
_KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


#: Halves of surrogate pairs, which UTF-8 can't hold; they stay escaped.
_LONE = re.compile("[\ud800-\udfff]")


def _parsed(text: str):
    """The value of a JSON text. Raises ValueError for anything that isn't JSON, NaN and infinities too."""

    def refuse(name: str):
        raise ValueError(name)

    try:
        return json.loads(text, parse_constant=refuse)
    except RecursionError:
        raise ValueError("nested too deep") from None


def canonical(value) -> str:
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return _LONE.sub(lambda x: f"\\u{ord(x[0]):04x}", text)


#: Keywords that restrict values and are not checked here; a schema with one of them decides nothing.
_UNAPPLIED = {"if", "contains", "propertyNames", "dependencies", "dependentRequired", "dependentSchemas", "unevaluatedItems", "unevaluatedProperties", "$dynamicRef", "$recursiveRef"}
_LEAST = {"minimum": lambda v, k: v >= k, "maximum": lambda v, k: v <= k, "exclusiveMinimum": lambda v, k: v > k, "exclusiveMaximum": lambda v, k: v < k, "multipleOf": lambda v, k: v % k == 0}
_SIZES = {str: ("minLength", "maxLength"), list: ("minItems", "maxItems"), dict: ("minProperties", "maxProperties")}


def _is(value, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    return isinstance(value, _KINDS[kind]) or (kind == "integer" and isinstance(value, float) and value.is_integer())


def _same(a, b) -> bool:
    """Equality of JSON values, where 1 is 1.0 and not true."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return a == b


def _pointed(ref: str, root):
    """What a reference within the same schema (#/...) points to."""
    if not ref.startswith("#"):
        raise KeyError(ref)
    for part in ref[1:].split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        root = root[int(part) if isinstance(root, list) else part]
    return root


def problems(value, schema: dict | bool, at: str = "$", root=None) -> list[str]:
    """What in `value` breaks the JSON schema. Raises an error for a schema that is broken or has a keyword in _UNAPPLIED."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    if _UNAPPLIED & schema.keys():
        raise KeyError(*_UNAPPLIED & schema.keys())
    root = schema if root is None else root
    kind = schema.get("type")
    if kind and not any(_is(value, k) for k in ([kind] if isinstance(kind, str) else kind)):
        return [f"{at}: not {kind}"]
    found = problems(value, _pointed(schema["$ref"], root), at, root) if "$ref" in schema else []
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        found.append(f"{at}: not in enum")
    if "const" in schema and not _same(value, schema["const"]):
        found.append(f"{at}: not const")
    for x in schema.get("allOf", []):
        found += problems(value, x, at, root)
    if "anyOf" in schema and all([problems(value, x, at, root) for x in schema["anyOf"]]):
        found.append(f"{at}: none of anyOf")
    if "oneOf" in schema and sum(not problems(value, x, at, root) for x in schema["oneOf"]) != 1:
        found.append(f"{at}: not one of oneOf")
    if "not" in schema and not problems(value, schema["not"], at, root):
        found.append(f"{at}: not allowed")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        found += [f"{at}: {k}" for k, holds in _LEAST.items() if k in schema and not holds(value, schema[k])]
    for k, (least, most) in _SIZES.items():
        if isinstance(value, k):
            found += [f"{at}: {least}"] if len(value) < schema.get(least, 0) else []
            found += [f"{at}: {most}"] if len(value) > schema.get(most, len(value)) else []
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        found.append(f"{at}: pattern")
    if isinstance(value, dict):
        known, shapes, others = schema.get("properties", {}), schema.get("patternProperties", {}), schema.get("additionalProperties", True)
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            rules = [known[k]] if k in known else []
            rules += [x for shape, x in shapes.items() if re.search(shape, k)]
            for x in rules:
                found += problems(v, x, f"{at}.{k}", root)
            if not rules:
                found += [f"{at}.{k}: unknown"] if others is False else problems(v, others, f"{at}.{k}", root)
    if isinstance(value, list):
        first, rest = schema.get("prefixItems", []), schema.get("items", True)
        if isinstance(rest, list):  # older drafts
            first, rest = rest, schema.get("additionalItems", True)
        for k, v in enumerate(value):
            found += problems(v, first[k] if k < len(first) else rest, f"{at}[{k}]", root)
        if schema.get("uniqueItems") and any(_same(a, b) for k, a in enumerate(value) for b in value[:k]):
            found.append(f"{at}: uniqueItems")
    return found


def _judged(value, schema: str | dict | None) -> bool | None:
    """Whether the arguments keep to the schema (JSON text or parsed); null without a schema or where it can't be applied."""
    if schema is None:
        return None
    try:
        return not problems(value, json.loads(schema) if isinstance(schema, str) else schema)
    except Exception:  # whatever is wrong with a schema must not end the query
        return None


def defined(turns: DataFrame) -> DataFrame:
    """(conv_id, name, schema, since, until) from turns (conv_id, turn, role, text): a definition holds until its name is defined again."""
    found = turns.where(F.col("role").isin("system", "developer") & _is_object("text"))
    found = found.select("conv_id", _since().alias("since"), F.posexplode(F.from_json("text", TOOLS)["tools"]).alias("place", "t"))
    name, schema = F.coalesce("t.name", "t.function.name"), F.coalesce("t.parameters", "t.input_schema", "t.function.parameters")
    found = found.select("conv_id", name.alias("name"), schema.alias("schema"), "since", "place").where("name is not null")
    until = F.lead("since").over(Window.partitionBy("conv_id", "name").orderBy("since", "place", "schema"))
    return found.withColumn("until", until).where("until is null or since < until").drop("place")


def _is_object(text: str):
    """Whether a text begins as a JSON object, after white space or not."""
    return F.ltrim(F.col(text), F.lit(" \t\n\r")).startswith("{")


def _since():
    """The turn; a null one is before all others."""
    return F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63)))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, id, level) of calls (conv_id, id, depends_on): 0 without dependencies, else one more than the highest of them.

    Calls with the same identifier count as one with the dependencies of all.
    """
    nodes = written(calls.select("conv_id", "id", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on")), "calls")
    needs = written(nodes.select("conv_id", "id", F.explode("depends_on").alias("need")).distinct(), "needs")
    free = nodes.groupBy("conv_id", "id").agg(F.max(F.size("depends_on")).alias("most")).where("most = 0")
    done = written(free.select("conv_id", "id", F.lit(0).alias("level")), "done")
    left = needs
    while not left.isEmpty():
        met = left.join(done.select("conv_id", F.col("id").alias("need"), "level"), ["conv_id", "need"], "left")
        ready = met.groupBy("conv_id", "id").agg(F.count("*").alias("n"), F.count("level").alias("k"), F.max("level").alias("m")).where("n = k")
        ready = written(ready.select("conv_id", "id", (F.col("m") + 1).alias("level")), "ready")
        if ready.isEmpty():
            break
        done = written(done.unionByName(ready), "done")
        left = written(left.join(ready, ["conv_id", "id"], "left_anti"), "left")
    return done.groupBy("conv_id", "id").agg(F.max("level").alias("level"))


def _beside(role: str | None, text: str) -> list[str]:
    """The canonical JSON of what a turn says beside its calls, if anything."""
    try:
        said, end = json.JSONDecoder().raw_decode(text.lstrip(" \t\n\r"))
    except (ValueError, RecursionError):
        return [canonical({"role": role, "content": text})]
    fields = {k: v for k, v in said.items() if v is not None and k not in ("tool_calls", "content") and (k, v) != ("role", role)}
    out = {k: v for k, v in (("fields", fields), ("after", text.lstrip(" \t\n\r")[end:].strip())) if v}
    content = said.get("content")
    return [canonical({"role": role, "content": content, **out})] if out or content is not None else []


def linked(turns: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """(conv_id, turn, place, role, kind, call_id, level, valid, json) from turns (conv_id, turn, role, text).

    `schemas` holds for names that have no schema in their conversation.
    """
    schemas = schemas or {}
    rows = turns.select("conv_id", "turn", "role", "text")
    rows = rows.withColumn("calls", F.when((F.col("role") == "assistant") & _is_object("text"), F.from_json("text", CALLS)["tool_calls"]))
    rows = rows.withColumn("answer", F.when((F.col("role") == "tool") & _is_object("text"), F.from_json("text", RESULT)))

    @F.pandas_udf("array<string>")
    def beside(role: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([_beside(r, t) for r, t in zip(role, text)], dtype=object)

    said = rows.where("size(calls) > 0").select("conv_id", "turn", "role", F.explode(beside("role", "text")).alias("json"))
    calling = rows.where("size(calls) > 0").select("conv_id", "turn", "role", F.posexplode("calls").alias("place", "c"))
    calling = calling.select("conv_id", "turn", "role", "place", "c.id", F.coalesce("c.name", "c.function.name").alias("name"), F.coalesce("c.arguments", "c.function.arguments").alias("arguments"), "c.depends_on")
    turn_of = Window.partitionBy("conv_id", "id")
    named = calling.where("id is not null").withColumn("nth", F.row_number().over(turn_of.orderBy("turn", "place")))
    calling = named.unionByName(calling.where("id is null").withColumn("nth", F.lit(None).cast("int")))
    answers = rows.where("answer.tool_call_id is not null").select("conv_id", F.col("answer.tool_call_id").alias("id"), F.col("turn").alias("result_turn"), F.col("answer.content").alias("result"))
    answers = answers.withColumn("nth", F.row_number().over(turn_of.orderBy("result_turn", "result")))

    @F.pandas_udf("valid boolean, json string")
    def told(name: pd.Series, schema: pd.Series, arguments: pd.Series, call_id: pd.Series, result: pd.Series, role: pd.Series, text: pd.Series) -> pd.DataFrame:
        valid, said = [], []
        for n, d, a, i, r, who, t in zip(name, schema, arguments, call_id, result, role, text):
            if i is None and n is None:
                valid.append(None)
                said.append(canonical({"role": who, "content": t}))
                continue
            made = lambda value: canonical({"role": who, "tool_call": {"id": i, "name": n, "arguments": value}, "result": r})  # noqa: E731, B023
            try:
                value = _parsed(a) if a is not None else {}
                said.append(made(value))
                valid.append(_judged(value, schemas.get(n) if d is None else d))
            except (ValueError, RecursionError):
                said.append(made(a))
                valid.append(False)
        return pd.DataFrame({"valid": pd.Series(valid, dtype="boolean"), "json": said})

    none = F.lit(None).cast("string")
    calls = calling.join(answers, ["conv_id", "id", "nth"], "left").join(levels(calling), ["conv_id", "id"], "left")
    tools = defined(turns).withColumnsRenamed({"conv_id": "its_conv", "name": "its_name"})
    in_force = (F.col("conv_id") == F.col("its_conv")) & (F.col("name") == F.col("its_name")) & (F.col("since") <= _since()) & (F.col("until").isNull() | (_since() < F.col("until")))
    calls = calls.join(tools, in_force, "left")
    calls = calls.select("conv_id", "turn", "place", "role", F.lit("call").alias("kind"), F.coalesce("id", F.lit("")).alias("call_id"), "level", "name", "schema", "arguments", "result", none.alias("text"))
    known = calling.select("conv_id", "id").distinct().withColumn("known", F.lit(True))
    rest = rows.where("calls is null or size(calls) = 0").withColumn("id", F.col("answer.tool_call_id"))
    results = rest.where("id is not null").join(known, ["conv_id", "id"], "left")
    results = results.select("conv_id", "turn", "role", F.when(F.col("known"), "result").otherwise("stray result").alias("kind"), "id", "text")
    plain = rest.where("id is null").select("conv_id", "turn", "role", F.lit("message").alias("kind"), none.alias("id"), "text")
    others = results.unionByName(plain).select("conv_id", "turn", F.lit(0).alias("place"), "role", "kind", F.col("id").alias("call_id"), F.lit(None).cast("int").alias("level"), none.alias("name"), none.alias("schema"), none.alias("arguments"), none.alias("result"), "text")
    both = calls.unionByName(others)
    made = told("name", "schema", "arguments", F.when(F.col("kind") == "call", F.col("call_id")), "result", "role", "text")
    both = both.withColumn("made", made).select("conv_id", "turn", "place", "role", "kind", "call_id", "level", "made.valid", "made.json")
    unset = [none.alias("call_id"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("boolean").alias("valid")]
    return both.unionByName(said.select("conv_id", "turn", F.lit(-1).alias("place"), "role", F.lit("message").alias("kind"), *unset, "json"))


def digest(turns: DataFrame) -> DataFrame:
    """The query's columns: those of `linked`, with the schemas that the conversations define."""
    return linked(turns)
