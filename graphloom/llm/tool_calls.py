"""Tool-call linking: calls meet their results by identifier, in topological order, with checked canonical arguments.

Everything here is DataFrame and SQL functions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: For each tool a JSON schema of its arguments: type, properties, required, additionalProperties (false unless given),
#: items and enum, nested to any depth.
Schemas = dict[str, dict]

CALLS = "array<struct<id:string,name:string,arguments:string>>"
#: How an argument refers to the result of another call of the conversation.
REFERENCE = r'"\$call:([^"\\]+)"'


def json_type(value: Column) -> Column:
    """string, number, boolean, null, array or object; null where there is no value."""
    kind = F.schema_of_variant(value)
    return F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind.isNotNull(), "number")


def _texts(*parts) -> Column:
    return F.array(*parts).cast("array<string>")


def faults(value: Column, schema: dict, where: Column) -> Column:
    """What is wrong with a variant by a schema: a mistyped value, or one not allowed, else missing, unexpected and wrong parts."""
    kind, want, none = json_type(value), schema.get("type"), _texts()
    place = F.when(where == "", "value").otherwise(where)
    own = [none]
    if "enum" in schema:
        allowed = [json.dumps(x, separators=(",", ":"), ensure_ascii=False) for x in schema["enum"]]
        own.append(F.when(F.to_json(value).isin(allowed), none).otherwise(_texts(F.concat(place, F.lit(" is not allowed")))))
    if "properties" in schema or want == "object":
        known = schema.get("properties", {})
        for p, part in sorted(known.items()):
            child = F.try_variant_get(value, '$["%s"]' % p.replace('"', '\\"'), "variant")
            path = F.concat(where, F.when(where == "", "").otherwise("."), F.lit(p))
            missing = _texts(F.concat(F.lit("missing "), path)) if p in schema.get("required", ()) else none
            own.append(F.when(child.isNull(), missing).otherwise(faults(child, part, path)))
        if not schema.get("additionalProperties", False):
            names = F.coalesce(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")), none)
            extra = F.array_except(names, F.array(*[F.lit(p) for p in known]).cast("array<string>"))
            own.append(F.transform(extra, lambda k: F.concat(F.lit("unexpected "), where, F.when(where == "", "").otherwise("."), k)))
    if "items" in schema:
        values = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
        own.append(F.flatten(F.transform(values, lambda x, k: faults(x, schema["items"], F.concat(place, F.lit("["), k, F.lit("]"))))))
    inner = F.concat(*own)
    if want is None:
        return inner
    number = F.try_variant_get(value, "$", "double")
    right = (kind == "number") & (number == F.rint(number)) if want == "integer" else kind == want
    return F.when(F.coalesce(right, F.lit(False)), inner).otherwise(_texts(F.concat(place, F.lit(f" is not {want}"))))


def argument_errors(name: Column, arguments: Column, parsed: Column, schemas: Schemas) -> Column:
    """Sorted list of what is wrong: no JSON object, a repeated key, an unknown tool, or what ``faults`` finds."""
    wrong = _texts()
    for tool, schema in sorted(schemas.items()):
        wrong = F.when(name == tool, F.array_sort(faults(parsed, {"type": "object", **schema}, F.lit("")))).otherwise(wrong)
    known = F.coalesce(name.isin(*schemas), F.lit(False)) if schemas else F.lit(False)
    return (
        F.when(parsed.isNull() & F.get_json_object(arguments, "$").startswith("{"), _texts(F.lit("arguments repeat a key")))
        .when(parsed.isNull() | F.coalesce(json_type(parsed) != "object", F.lit(False)), _texts(F.lit("arguments are not a JSON object")))
        .when(~known, _texts(F.lit("unknown tool")))
        .otherwise(wrong)
    )


#: Tokens of JSON text; the string's parts are possessive, so that a long one is read without recursion.
TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*+|true|false|null|[\[\]{},:]'


def canonical_number(text: Column) -> Column:
    """The exact decimal value of a JSON number, in the shortest form.

    Digits without needless zeros: plain where the point lies within 21 digits or up to 5 zeros behind it, else with an
    exponent.  So 1, 1.0 and 1e0 are 1, and a long integer keeps all its digits.  Null if the exponent is no int.
    """
    part = lambda k: F.regexp_extract(text, r"^-?([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?$", k)
    whole, exponent = part(1), F.when(part(3) == "", F.lit(0)).otherwise(F.regexp_replace(part(3), r"^\+", "").try_cast("int"))
    digits = F.concat(whole, part(2))
    tail = F.regexp_replace(digits, "^0+", "")
    point = F.length(whole).cast("long") - (F.length(digits) - F.length(tail)) + exponent
    shown = F.regexp_replace(tail, "0+$", "")
    n = F.length(shown)
    zeros = lambda k: F.repeat(F.lit("0"), F.least(F.greatest(k, F.lit(0)), F.lit(21)).cast("int"))
    short = point.cast("int")
    plain = F.when(n <= point, F.concat(shown, zeros(point - n))).otherwise(F.concat(F.substring(shown, F.lit(1), short), F.lit("."), F.substring(shown, short + 1, n)))
    far = F.concat(F.substring(shown, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(shown, F.lit(2), n))).otherwise(""), F.lit("e"), F.when(point > 0, "+").otherwise(""), (point - 1).cast("string"))
    form = F.when((point > 0) & (point <= 21), plain).when((point <= 0) & (point > -6), F.concat(F.lit("0."), zeros(-point), shown)).otherwise(far)
    return F.when(tail == "", "0").otherwise(F.concat(F.when(text.startswith("-"), "-").otherwise(""), form))


def canonical_json(text: Column) -> Column:
    """JSON without spaces, keys sorted, strings with the fewest escapes, numbers by ``canonical_number``; null unless valid.

    The numbers pass through the parser as marked strings, so that none is rounded.
    """
    read = lambda x, f: F.array_join(F.transform(F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0)), f), "")
    mark = lambda t: F.when(t.startswith('"'), F.concat(F.lit('"s'), F.substring(t, F.lit(2), F.length(t)))).when(t.rlike("^[-0-9]"), F.concat(F.lit('"n'), canonical_number(t), F.lit('"'))).otherwise(t)
    back = lambda t: F.when(t.startswith('"s'), F.concat(F.lit('"'), F.substring(t, F.lit(3), F.length(t)))).when(t.startswith('"n'), F.substring(t, F.lit(3), F.length(t) - 3)).otherwise(t)
    marked = F.when(F.try_parse_json(text).isNotNull(), F.try_parse_json(read(text, mark)))
    return read(F.to_json(marked), back)


def levels(calls: DataFrame) -> DataFrame:
    """``(conv_id, call_id, level)``: 0 for calls that wait for none, else one more than the latest they wait for.

    ``calls`` has ``conv_id, call_id, waits_for array<string>``, a row per call.  Calls that wait for just one other form
    chains, which are walked by doubling: a chain of n calls takes log2(n) joins.  What is left are calls that wait for
    several, whose chains' ends are settled in layers; there are as many rounds as such calls lie on one path.
    Calls that wait for each other in a circle, or for such calls, get no level.  Checkpoints cut the lineage.
    """
    node = ["conv_id", "call_id"]
    nodes = common.checkpoint(calls.select(*node, "waits_for"))
    links = nodes.select(*node, F.explode("waits_for").alias("on"))
    links = common.checkpoint(links.join(nodes.select("conv_id", F.col("call_id").alias("on")), ["conv_id", "on"]).distinct())
    waits = links.groupBy(*node).agg(F.count("*").alias("n"), F.min("on").alias("on"))
    one = F.coalesce(F.col("n") == 1, F.lit(False))
    start = nodes.join(waits, node, "left").select(*node, F.when(one, F.col("on")).otherwise(F.col("call_id")).alias("up"), one.cast("long").alias("far"), (~one & F.col("n").isNotNull()).alias("several"), (~one).alias("ends"))
    start = common.checkpoint(start)
    settled, walking = start.where("ends"), start.where("NOT ends")
    longest = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(longest.bit_length()):
        if walking.isEmpty():
            break
        ahead = settled.unionByName(walking).select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("far").alias("more"), F.col("ends").alias("done"))
        walked = walking.join(ahead, ["conv_id", "up"]).select(*node, F.col("next").alias("up"), (F.col("far") + F.col("more")).alias("far"), F.lit(False).alias("several"), F.col("done").alias("ends"))
        walked = common.checkpoint(walked)
        settled, walking = settled.unionByName(walked.where("ends")), walked.where("NOT ends")
    settled = common.checkpoint(settled)
    known = start.where("ends AND NOT several").select(*node, F.lit(0).cast("long").alias("level"))
    heads = start.where("several").select(*node)
    if not heads.isEmpty():
        place = settled.select("conv_id", F.col("call_id").alias("on"), "up", "far")
        inner = links.join(heads, node).join(place, ["conv_id", "on"], "left").select(*node, "up", F.col("far") + 1)
        inner, known = common.checkpoint(inner.toDF(*node, "up", "far")), common.checkpoint(known)
        left, new = inner, known
        while True:
            left = common.checkpoint(left.join(new.select("conv_id", F.col("call_id").alias("up")), ["conv_id", "up"], "left_anti"))
            ready = heads.join(known.select(*node), node, "left_anti").join(left.select(*node).distinct(), node, "left_anti")
            base = known.select("conv_id", F.col("call_id").alias("up"), "level")
            new = common.checkpoint(inner.join(ready, node, "left_semi").join(base, ["conv_id", "up"]).groupBy(*node).agg(F.max(F.col("far") + F.col("level")).alias("level")))
            if new.isEmpty():
                break
            known = common.checkpoint(known.unionByName(new))
    base = known.select("conv_id", F.col("call_id").alias("up"), "level")
    return settled.join(base, ["conv_id", "up"]).select(*node, (F.col("far") + F.col("level")).cast("int").alias("level"))


def link(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """A row per tool call of ``messages(conv_id, turn, role, text, tool_calls, tool_call_id)``.

    tool_calls: calls that an assistant's message makes (``CALLS``); tool_call_id: the call whose result a tool's
    message is, in ``text``.  Returns ``conv_id, turn, k`` (place in its message), ``call_id, name, waits_for`` (ids, of
    calls of the conversation or not, that arguments refer to as ``"$call:<id>"``), ``level`` (topological: calls in order of level,
    turn and k never come before one they wait for; null within a circle), ``n_results, result`` (first text by turn),
    ``errors`` (array of strings, what ``argument_errors`` finds before the others) and ``canonical``: JSON of arguments, id,
    name and result as ``canonical_json`` writes it.

    Of calls with the same id in a conversation the first by turn and k counts; the others are returned with the error
    ``duplicate id`` and no results.  Results of unknown calls and calls with null id are not linked: the latter have
    the error ``no id``.  Null or malformed arguments, and objects that repeat a key, are an error, and null in the
    canonical form.  Null texts count as
    results without text.  Messages without calls and empty tables give no rows.  Rows with a null conv_id form a
    conversation of their own.  Other columns are ignored.
    A conversation of any length is joined by (conversation, id) and never sorted or gathered in one task: windows are
    over equal ids alone, results are reduced map-side.
    """
    made = messages.where("role = 'assistant'").select(F.coalesce(F.col("conv_id").cast("string"), F.lit("\0null")).alias("conv_id"), "turn", F.posexplode(F.col("tool_calls").cast(CALLS)).alias("k", "c"))
    made = made.select("conv_id", "turn", "k", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))
    made = made.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "call_id").orderBy("turn", "k", "name", "arguments")))
    made = made.withColumn("first", F.col("call_id").isNotNull() & (F.col("nth") == 1)).drop("nth")
    refs = F.array_sort(F.array_distinct(F.coalesce(F.regexp_extract_all("arguments", F.lit(REFERENCE), F.lit(1)), F.array().cast("array<string>"))))
    made = common.checkpoint(made.withColumn("waits_for", refs))
    order = levels(made.where("first").select("conv_id", "call_id", "waits_for"))
    results = messages.where("role = 'tool' AND tool_call_id IS NOT NULL").select(F.coalesce(F.col("conv_id").cast("string"), F.lit("\0null")).alias("conv_id"), F.col("tool_call_id").alias("call_id"), "turn", "text")
    results = results.groupBy("conv_id", "call_id").agg(F.count("*").alias("n_results"), F.min(F.struct("turn", "text")).alias("r")).select("conv_id", "call_id", "n_results", F.col("r.text").alias("result"))
    known = results.join(order, ["conv_id", "call_id"], "full_outer").withColumn("first", F.lit(True))
    met = made.join(known, ["conv_id", "call_id", "first"], "left")
    parsed = met.withColumn("v", F.try_parse_json("arguments"))
    errors = argument_errors(F.col("name"), F.col("arguments"), F.col("v"), schemas)
    extra = F.array_compact(F.array(F.when(F.col("call_id").isNull(), "no id").when(~F.col("first"), "duplicate id"), F.when(F.col("first") & F.col("level").isNull(), "waits in a circle")))
    rest = F.to_json(F.struct(F.col("call_id").alias("id"), "name", "result"), {"ignoreNullFields": "false"})
    shown = F.concat(F.lit('{"arguments":'), F.coalesce(canonical_json(F.col("arguments")), F.lit("null")), F.lit(","), F.substring(rest, F.lit(2), F.length(rest)))
    return parsed.select(
        F.when(F.col("conv_id") != "\0null", F.col("conv_id")).alias("conv_id"), "turn", "k", "call_id", "name", "waits_for", "level",
        F.coalesce("n_results", F.lit(0)).alias("n_results"), "result", F.concat(errors, extra).alias("errors"), shown.alias("canonical"),
    )


#: Tools that turns of plain conversations stand for.
SCHEMAS: Schemas = {
    "answer": {
        "properties": {
            "question": {"type": "string"}, "length": {"type": "integer"}, "after": {"type": "string"},
            "meta": {"type": "object", "properties": {"role": {"enum": ["user"]}, "tags": {"type": "array", "items": {"type": "integer"}}}, "required": ["tags"]},
        },
        "required": ["question", "length", "meta"],
    },
    "instruct": {"properties": {"rules": {"type": "string"}, "strict": {"type": "boolean"}}, "required": ["rules"]},
}


def as_calls(conversations: DataFrame) -> DataFrame:
    """Plain conversations as messages with tool calls and results, some of them faulty.

    A user's turn asks the tool ``answer`` (its argument ``after`` refers to the turn two before, where there is one),
    a system's turn calls ``instruct``; identifiers are ``t<turn>``.  An assistant's turn is the result of the turn
    before it.  By the remainders of conv_id * 31 + turn a user's call has the id of the one before (11), refers to the
    next (5), has a length in another spelling (3) or as text (7), a key too many (13), a wrong list (19), or is cut (17).
    """
    turn, x = F.col("turn").cast("long"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)) * 31 + F.col("turn").cast("long")
    quoted = lambda c: F.coalesce(F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)"), F.lit("null"))
    on = F.when(x % 5 == 1, turn + 2).when(turn >= 2, turn - 2)
    length = F.coalesce(F.length("text"), F.lit(0)).cast("string")
    length = F.when(x % 7 == 2, F.concat(F.lit('"'), length, F.lit('"'))).when(x % 3 == 0, length).when(x % 3 == 1, F.concat(length, F.lit(".0"))).otherwise(F.concat(length, F.lit("0E-1")))
    tags = F.concat(F.lit("["), turn, F.lit(", "), F.when(x % 19 == 6, '"x"').otherwise((turn + 1).cast("string")), F.lit("]"))
    ask = F.concat(
        F.lit('{"question": '), quoted("text"), F.lit(', "length": '), length, F.lit(', "meta": {"tags": '), tags, F.lit(', "role": "user"}'),
        F.coalesce(F.concat(F.lit(', "after": "$call:t'), on, F.lit('"')), F.lit("")), F.when(x % 13 == 4, ', "mood": null').otherwise(""), F.lit("}"),
    )
    ask = F.when(x % 17 == 5, '{"question": ').otherwise(ask)
    rule = F.concat(F.lit('{"strict":true, "rules":'), quoted("text"), F.lit("}"))
    own = F.concat(F.lit("t"), F.when((x % 11 == 3) & (turn >= 2), turn - 2).otherwise(turn))
    call = F.when(F.col("role") == "user", F.array(F.struct(own.alias("id"), F.lit("answer").alias("name"), ask.alias("arguments"))))
    call = call.when(F.col("role") == "system", F.array(F.struct(F.concat(F.lit("t"), turn).alias("id"), F.lit("instruct").alias("name"), rule.alias("arguments"))))
    asked = F.col("role").isin("user", "system")
    return conversations.select("conv_id", turn.alias("turn"), F.when(asked, "assistant").otherwise("tool").alias("role"), F.when(~asked, F.col("text")).alias("text"), call.alias("tool_calls"), F.when(~asked, F.concat(F.lit("t"), turn - 1)).alias("tool_call_id"))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link(as_calls(common.table(spark, sf_dir, "conversations")), SCHEMAS)
    return found.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "call_id", "name", F.concat_ws(",", "waits_for").alias("waits_for"), "level", "n_results", F.concat_ws(";", "errors").alias("errors"), F.sha2("canonical", 256).alias("canonical_sha256"))


OP4_SQL = """
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, role, text, conv_id * 31 + turn AS x FROM conversations WHERE role IN ('user', 'system')),
called AS (
  SELECT *, CASE WHEN role = 'user' AND x % 11 = 3 AND turn >= 2 THEN 't' || (turn - 2) ELSE 't' || turn END AS call_id,
         CASE role WHEN 'user' THEN 'answer' ELSE 'instruct' END AS name, role = 'user' AND x % 17 = 5 AS cut,
         CASE WHEN role <> 'user' OR x % 17 = 5 THEN '' WHEN x % 5 = 1 THEN 't' || (turn + 2) WHEN turn >= 2 THEN 't' || (turn - 2) ELSE '' END AS waits_for
  FROM raw),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn) = 1 AS first FROM called),
lev AS (
  SELECT c.conv_id, c.call_id, 0 AS level FROM c
  WHERE first AND NOT EXISTS (SELECT 1 FROM c b WHERE b.conv_id = c.conv_id AND b.call_id = c.waits_for)
  UNION ALL
  SELECT c.conv_id, c.call_id, lev.level + 1 FROM c JOIN lev ON lev.conv_id = c.conv_id AND lev.call_id = c.waits_for WHERE c.first),
res AS (
  SELECT conv_id, 't' || (turn - 1) AS call_id, count(*) AS n, min(text) AS result
  FROM conversations WHERE role NOT IN ('user', 'system') GROUP BY ALL),
j AS (
  SELECT c.*, lev.level, coalesce(CASE WHEN first THEN res.n END, 0) AS n_results, CASE WHEN first THEN res.result END AS result,
    CASE WHEN cut THEN 'null'
         WHEN c.name = 'instruct' THEN '{"rules":' || coalesce(to_json(c.text), 'null') || ',"strict":true}'
         ELSE '{' || CASE WHEN waits_for <> '' THEN '"after":"$call:' || waits_for || '",' ELSE '' END
              || '"length":' || CASE WHEN x % 7 = 2 THEN '"' || coalesce(length(c.text), 0) || '"' ELSE '' || coalesce(length(c.text), 0) END
              || ',"meta":{"role":"user","tags":[' || turn || ',' || CASE WHEN x % 19 = 6 THEN '"x"' ELSE '' || (turn + 1) END || ']}'
              || CASE WHEN x % 13 = 4 THEN ',"mood":null' ELSE '' END || ',"question":' || coalesce(to_json(c.text), 'null') || '}' END AS arguments,
    CASE WHEN cut THEN ['arguments are not a JSON object']
         WHEN c.name = 'instruct' THEN CASE WHEN c.text IS NULL THEN ['rules is not string'] ELSE [] END
         ELSE list_filter([CASE WHEN x % 7 = 2 THEN 'length is not integer' END, CASE WHEN x % 19 = 6 THEN 'meta.tags[1] is not integer' END,
                           CASE WHEN c.text IS NULL THEN 'question is not string' END, CASE WHEN x % 13 = 4 THEN 'unexpected mood' END], lambda e: e IS NOT NULL) END
    || CASE WHEN NOT first THEN ['duplicate id'] WHEN lev.level IS NULL THEN ['waits in a circle'] ELSE [] END AS errors
  FROM c LEFT JOIN lev ON lev.conv_id = c.conv_id AND lev.call_id = c.call_id AND c.first LEFT JOIN res ON res.conv_id = c.conv_id AND res.call_id = c.call_id)
SELECT conv_id, turn, call_id, name, waits_for, level, n_results, array_to_string(errors, ';') AS errors,
       sha256('{"arguments":' || arguments || ',"id":"' || call_id || '","name":"' || name || '","result":'
              || coalesce(to_json(result), 'null') || '}') AS canonical_sha256
FROM j
"""
