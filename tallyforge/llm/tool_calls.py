"""Chat formatting: tool calls are linked with their results and written as canonical JSON.

Calls and results meet in a join on the hash of their identifier; calls are put in topological order by rounds of joins
along their dependencies; arguments are validated against the schema of their tool; the other turns of a conversation
become plain messages.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool}

#: Ways around a cycle double for ever; they stop here.
_FAR = 1 << 40


def canonical(value) -> str:
    """JSON with sorted keys, no blanks and no needless escapes."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What a value has against a JSON schema: type, enum, required, properties, additionalProperties, items,
    minimum, maximum, minLength and maxLength are read."""
    kind = schema.get("type")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    fits = {"integer": number and float(value).is_integer(), "number": number, "null": value is None}.get(kind, kind is None or isinstance(value, _TYPES.get(kind, object)))
    if not fits:
        return [f"{at}: not {kind}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if number and value < schema.get("minimum", value):
        out.append(f"{at}: below minimum")
    if number and value > schema.get("maximum", value):
        out.append(f"{at}: above maximum")
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        out.append(f"{at}: wrong length")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}: not allowed" for k in sorted(value) if k not in own]
        for k in sorted(own):
            if k in value:
                out += problems(value[k], own[k], f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += problems(x, schema["items"], f"{at}[{i}]")
    return out


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level): 0 for a call without dependencies among the calls, else one more than its deepest one.

    steps has, for each call, the calls it still waits for and the longest way to each; a null stands for the bottom.
    Each round puts in place of every awaited call that itself awaits at most one what that call awaits, so the reach
    along a chain doubles and the rounds grow with the logarithm of its length; where each call awaits several that
    never come together, a round settles one more of the chain. steps doesn't grow. Each round settles a call unless
    all that are left are on a cycle, or depend on one: these get null.
    """
    ids = calls.where("call_id is not null").select("call_id").distinct()
    edges = calls.where("call_id is not null").select("call_id", F.explode("depends_on").alias("dep")).distinct().join(ids.withColumnRenamed("call_id", "dep").hint("merge"), "dep", "left_semi")
    steps = stored(ids.join(edges.select("call_id", "dep").hint("merge"), "call_id", "left").withColumn("way", F.when(F.col("dep").isNull(), 0).otherwise(1).cast("long")), "levels")
    waiting = lambda: steps.where("dep is not null").select("call_id").distinct().count()
    before, left = None, waiting()
    while left and left != before:
        bottom, onward = F.max(F.when(F.col("dep").isNull(), F.col("way"))), F.max(F.when(F.col("dep").isNotNull(), F.col("way")))
        simple = steps.groupBy(F.col("call_id").alias("via")).agg(F.count("dep").alias("n"), F.max("dep").alias("next"), bottom.alias("bottom"), onward.alias("onward")).where("n <= 1").drop("n")
        add = lambda c: F.least(F.col("way") + F.col(c), F.lit(_FAR))
        none = F.lit(None).cast("string")
        ways = F.when(F.col("via").isNull(), F.array(F.struct("dep", "way"))).otherwise(F.array(F.struct(none.alias("dep"), F.when(F.col("bottom").isNotNull(), add("bottom")).alias("way")), F.struct(F.col("next").alias("dep"), F.when(F.col("next").isNotNull(), add("onward")).alias("way"))))
        met = steps.where("dep is not null").join(simple.hint("merge"), F.col("dep") == F.col("via"), "left").select("call_id", F.inline(ways)).union(steps.where("dep is null"))
        after = stored(met.where("way is not null").groupBy("call_id", "dep").agg(F.max("way").alias("way")), "levels")
        dropped(steps)
        steps = after
        before, left = left, waiting()
    return steps.groupBy("call_id").agg(F.when(F.count("dep") == 0, F.max("way")).cast("int").alias("level"))


def _either(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Full outer join on the identifier; rows without one go around the join, so they don't meet in one task."""
    joined = calls.where("call_id is not null").join(results.where("result_id is not null").hint("merge"), F.col("call_id") == F.col("result_id"), "full_outer")
    return joined.unionByName(calls.where("call_id is null"), True).unionByName(results.where("result_id is null").withColumn("content", F.coalesce("content", F.lit("null"))), True)


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], messages: DataFrame | None = None) -> DataFrame:
    """One row for each call and each result of it, for a call or a result without a partner, and for each message.

    calls: conv_id, call_id, name, arguments (JSON text), depends_on (array of call_ids); results: call_id, content
    (JSON text); messages: conv_id, call_id, role, text, turns that neither call a tool nor give its result. status is
    linked, no_result, orphan_result or message; errors has what is wrong with the arguments (not JSON, no such tool,
    or against the schema), joined by "; ", and valid says there is none. message is canonical JSON. Texts of any
    length stay whole. Repeated calls and results give repeated rows, each call with each result of its identifier;
    a null call_id has no partner and level 0 for a call; orphan results and messages have null in what belongs to a
    call; other columns are dropped; empty tables give no rows.
    """
    known = calls.select("conv_id", "call_id", "name", "arguments", "depends_on", F.lit(True).alias("is_call"))
    both = _either(known, results.select(F.col("call_id").alias("result_id"), "content", F.lit(True).alias("is_result")))
    placed = both.join(levels(calls).hint("merge"), "call_id", "left").withColumn("level", F.when(F.col("is_call") & F.col("call_id").isNull(), 0).otherwise(F.col("level")))
    status = F.when(F.col("is_call").isNull(), "orphan_result").when(F.col("is_result").isNull(), "no_result").otherwise("linked")
    linked = placed.select("conv_id", F.coalesce("call_id", "result_id").alias("call_id"), "name", F.col("level").cast("int"), status.alias("status"), _checked(schemas)("name", "arguments", "depends_on", F.coalesce("call_id", "result_id"), "content", F.col("is_call").isNotNull()).alias("out")).select("conv_id", "call_id", "name", "level", "status", "out.valid", "out.errors", "out.message")
    if messages is None:
        return linked
    plain = messages.select("conv_id", "call_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("level"), F.lit("message").alias("status"), F.lit(None).cast("boolean").alias("valid"), F.lit(None).cast("string").alias("errors"), _said()("call_id", "role", "text").alias("message"))
    return linked.unionByName(plain)


def _said():
    @F.pandas_udf("string")
    def said(call_id: pd.Series, role: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([canonical({"id": i, "role": r, "content": t}) for i, r, t in zip(call_id, role, text)], dtype=object)

    return said


def _loads(text):
    try:
        return json.loads(text), None
    except (TypeError, ValueError):
        return text, "not JSON"


def _checked(schemas: dict[str, dict]):
    @F.pandas_udf("valid boolean, errors string, message string")
    def checked(name: pd.Series, arguments: pd.Series, depends_on: pd.Series, call_id: pd.Series, content: pd.Series, is_call: pd.Series) -> pd.DataFrame:
        rows = []
        for tool, args, deps, call, result, called in zip(name, arguments, depends_on, call_id, content, is_call):
            message = {"id": call}
            errors = None
            if called:
                value, bad = _loads(args)
                errors = [f"arguments: {bad}"] if bad else [f"no tool {tool}"] if tool not in schemas else problems(value, schemas[tool])
                message |= {"name": tool, "arguments": value, "depends_on": sorted(d for d in ([] if deps is None else deps) if d is not None)}
            if isinstance(result, str):
                message["result"] = _loads(result)[0]
            rows.append((None if errors is None else not errors, None if errors is None else "; ".join(errors), canonical(message)))
        return pd.DataFrame(rows, columns=["valid", "errors", "message"])

    return checked


#: Tools of the derived calls.
SCHEMAS = {
    "search": {"type": "object", "required": ["query", "limit"], "additionalProperties": False, "properties": {"query": {"type": "string", "minLength": 60}, "limit": {"type": "integer", "minimum": 0, "maximum": 40}}},
    "measure": {"type": "object", "required": ["size"], "properties": {"size": {"type": "integer", "minimum": 60}, "text": {"type": "string"}}},
    "quote": {"type": "object", "required": ["start"], "properties": {"start": {"type": "string", "maxLength": 200}}},
}


def derived_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and messages that the turns of plain conversations stand for.

    An assistant's turn calls a tool by its number, with its whole text in the arguments, and depends on the call two
    turns before; the user's next turn, its whole text, is its result; all other turns are messages. Null texts are
    null in the JSON; a turn without a number has no identifier.
    """
    c = conversations.withColumns({"blanks": F.length("text") - F.length(F.replace("text", F.lit(" "))), "size": F.length("text")})
    key = lambda back: F.concat(F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - back).cast("string"))
    kind = F.pmod(F.floor(F.col("turn") / 2), F.lit(3))
    name = F.when(kind == 0, "search").when(kind == 1, "measure").otherwise("quote")
    json_of = lambda *cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    arguments: Column = F.when(kind == 0, json_of(F.col("text").alias("query"), F.pmod("blanks", F.lit(45)).alias("limit"))).when(kind == 1, json_of("size", "text")).otherwise(json_of(F.col("text").alias("start")))
    calls = c.where("role = 'assistant'").select("conv_id", key(0).alias("call_id"), name.alias("name"), arguments.alias("arguments"), F.array(key(2)).alias("depends_on"))
    results = c.where("role = 'user' and turn > 0").select(key(1).alias("call_id"), json_of("size", "text").alias("content"))
    messages = c.where("not coalesce(role = 'assistant' or (role = 'user' and turn > 0), false)").select("conv_id", key(0).alias("call_id"), "role", "text")
    return calls, results, messages


ORACLE = """
WITH RECURSIVE c AS (
  SELECT conv_id, turn, role, text, length(text) - length(replace(text, ' ', '')) AS blanks, length(text) AS size, (turn // 2) % 3 AS kind
  FROM conversations
), calls AS (
  SELECT *, conv_id || '-' || turn AS call_id, conv_id || '-' || (turn - 2) AS dep FROM c WHERE role = 'assistant'
), results AS (
  SELECT conv_id || '-' || (turn - 1) AS result_id, '{"size":' || size || ',"text":' || CAST(to_json(text) AS VARCHAR) || '}' AS content FROM c WHERE role = 'user' AND turn > 0
), depth AS (
  SELECT DISTINCT call_id, 0 AS level FROM calls WHERE dep NOT IN (SELECT call_id FROM calls)
  UNION SELECT k.call_id, d.level + 1 FROM calls k JOIN depth d ON k.dep = d.call_id
), told AS (
  SELECT k.conv_id, coalesce(k.call_id, r.result_id) AS call_id, d.level,
         CASE k.kind WHEN 0 THEN 'search' WHEN 1 THEN 'measure' WHEN 2 THEN 'quote' END AS name,
         CASE WHEN k.call_id IS NULL THEN 'orphan_result' WHEN r.result_id IS NULL THEN 'no_result' ELSE 'linked' END AS status,
         CASE k.kind WHEN 0 THEN '{"limit":' || (k.blanks % 45) || ',"query":' || CAST(to_json(k.text) AS VARCHAR) || '}'
                     WHEN 1 THEN '{"size":' || k.size || ',"text":' || CAST(to_json(k.text) AS VARCHAR) || '}' WHEN 2 THEN '{"start":' || CAST(to_json(k.text) AS VARCHAR) || '}' END AS args,
         CASE WHEN k.call_id IS NULL THEN NULL
              ELSE concat_ws('; ', CASE WHEN k.kind = 0 AND k.blanks % 45 > 40 THEN '$.limit: above maximum' END,
                                   CASE WHEN k.kind = 0 AND k.size < 60 THEN '$.query: wrong length' END,
                                   CASE WHEN k.kind = 1 AND k.size < 60 THEN '$.size: below minimum' END,
                                   CASE WHEN k.kind = 2 AND k.size > 200 THEN '$.start: wrong length' END) END AS errors,
         k.dep, r.content
  FROM calls k FULL JOIN results r ON k.call_id = r.result_id LEFT JOIN depth d ON d.call_id = k.call_id
)
SELECT conv_id, call_id, name, level, status, errors = '' AS valid, errors,
       '{' || coalesce('"arguments":' || args || ',"depends_on":["' || dep || '"],', '') || '"id":"' || call_id || '"'
       || coalesce(',"name":"' || name || '"', '') || coalesce(',"result":' || content, '') || '}' AS message
FROM told
UNION ALL
SELECT conv_id, conv_id || '-' || turn, NULL, NULL, 'message', NULL, NULL,
       '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"id":"' || conv_id || '-' || turn || '","role":"' || role || '"}'
FROM c WHERE NOT (role = 'assistant' OR (role = 'user' AND turn > 0))
"""
