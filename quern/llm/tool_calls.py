"""Chat formatting: tool calls linked with their results, ordered, validated and serialised.

Calls and results are reduced to one row per conversation and identifier (so repeated turns can't multiply),
then hash-joined on both. A call's arguments are checked against the schema of its tool, and each exchange
becomes one line of canonical JSON: keys sorted, no spaces, characters beyond ASCII as they are, halves of
surrogate pairs escaped. Arguments may name another call of the conversation (``{"$ref": id}``); an exchange's
``level`` is the length of the longest chain of such references below it, so ordering by (conv_id, level, turn,
call_id) is topological. No conversation is gathered: chains of calls with one reference each are followed by
pointer doubling, in rounds that grow with the logarithm of their length, and the calls with several references
by a round of joins for each level among themselves.

Defined results: ``linked``; ``missing_result`` and ``orphan_result`` where one side is absent;
``invalid_arguments``; ``cycle`` where references don't end (level null), which a reference to an absent
call doesn't cause. Null text is an empty text; null conversation or turn numbers form identifiers of their
own (joined null-safe). Of repeated calls or results the whole row of the earliest turn stands (a null turn is the
earliest; of one turn, the smallest text), n_calls and n_results count them, and ``clash`` says whether texts
differ: ``calls``, ``results``, ``both``, or null. A text that isn't JSON by the standard (NaN, numbers beyond
double precision, nesting that the parser refuses) is no JSON call and is taken as plain text. Values may be nested
as deep as the parser takes them. An empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, ship, write_table

#: The schema that a turn which is no JSON call is checked against, under the tool name "reply".
SCHEMAS = {"reply": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "minLength": 1}}, "additionalProperties": False}}
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


_HALF = re.compile("[\ud800-\udfff]")


def safe(text: str) -> str:
    """Halves of surrogate pairs, which no UTF-8 text can hold, as escapes."""
    return _HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def strict(text: str) -> object:
    """The value of a JSON text; ValueError if it isn't JSON, or holds a number that a double can't."""

    def number(x: str) -> float:
        if math.isinf(value := float(x)):
            raise ValueError(x)
        return value

    def refuse(x: str) -> float:
        raise ValueError(x)

    return json.loads(text, parse_float=number, parse_constant=refuse)


class _Mark(str):
    """A piece of JSON that is written as it is."""


def canonical(value: object) -> str:
    """Without recursion, as values may be nested deep."""
    text = lambda x: safe(json.dumps(x, ensure_ascii=False))
    out: list[str] = []
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, _Mark):
            out.append(x)
        elif isinstance(x, dict) and x:
            todo.append(_Mark("}"))
            for i, k in enumerate(sorted(x, reverse=True)):
                todo += [x[k], _Mark(("{" if i == len(x) - 1 else ",") + text(k) + ":")]
        elif isinstance(x, list) and x:
            todo.append(_Mark("]"))
            for i in range(len(x) - 1, -1, -1):
                todo += [x[i], _Mark("," if i else "[")]
        else:
            out.append(text(x))
    return "".join(out)


def _fits(value: object, schema: dict) -> bool:
    """The value itself; what it holds is looked at by conforms()."""
    kind = schema.get("type")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "integer" and not (number and (isinstance(value, int) or value.is_integer())) or kind == "number" and not number or kind in _TYPES and not isinstance(value, _TYPES[kind]):
        return False
    if "enum" in schema and not any(type(x) is type(value) and x == value for x in schema["enum"]):
        return False
    if number and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        return False
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        return False
    if isinstance(value, dict):
        own = schema.get("properties", {})
        return all(k in value for k in schema.get("required", [])) and not (schema.get("additionalProperties") is False and any(k not in own for k in value))
    return True


def conforms(value: object, schema: dict) -> bool:
    """type, required, properties, additionalProperties, items, enum, minLength, minimum and maximum of JSON Schema. References pass."""
    todo = [(value, schema)]
    while todo:
        x, s = todo.pop()
        if isinstance(x, dict) and set(x) == {"$ref"}:
            continue
        if not _fits(x, s):
            return False
        if isinstance(x, dict):
            todo += [(y, s.get("properties", {}).get(k, {})) for k, y in x.items()]
        elif isinstance(x, list):
            todo += [(y, s.get("items", {})) for y in x]
    return True


def references(value: object) -> list[str]:
    out, todo = [], [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict) and set(x) == {"$ref"}:
            out.append(safe(x["$ref"]) if isinstance(x["$ref"], str) else canonical(x["$ref"]))
        elif isinstance(x, (dict, list)):
            todo += x.values() if isinstance(x, dict) else x
    return out


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table conv_id, turn, role, text: a user turn calls, the assistant's next turn answers it.

    A user turn that is a JSON object with name and arguments is that call, and its "id" its identifier.
    """
    t = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    given = F.when(F.ltrim("text").startswith("{"), F.get_json_object("text", "$.id"))
    calls = t.where("role = 'user'").select("conv_id", "turn", F.coalesce(given, F.concat(F.lit("turn-"), F.coalesce(F.col("turn").cast("string"), F.lit("null")))).alias("call_id"), F.col("text").alias("call"))
    answered = F.when(F.ltrim("text").startswith("{"), F.get_json_object("text", "$.tool_call_id"))
    results = t.where("role IN ('assistant', 'tool')").select("conv_id", "turn", F.coalesce(answered, F.concat(F.lit("turn-"), F.coalesce((F.col("turn") - 1).cast("string"), F.lit("null")))).alias("call_id"), F.col("text").alias("result"))
    return calls, results


def link(spark: SparkSession, calls: DataFrame, results: DataFrame, schemas: dict[str, dict] = SCHEMAS) -> DataFrame:
    """conv_id, call_id, turn, name, level, n_calls, n_results, clash, status, json of every identifier."""
    ship(spark)
    first = lambda x: F.min(F.struct("turn", x)).alias("first")
    differ = lambda x: (F.min(x) != F.max(x)).alias("differ")
    c = calls.groupBy("conv_id", "call_id").agg(first("call"), differ("call"), F.count(F.lit(1)).alias("n_calls"))
    c = c.select("conv_id", "call_id", "first.turn", "first.call", F.col("differ").alias("c_differ"), "n_calls")
    r = results.groupBy(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call")).agg(first("result"), differ("result"), F.count(F.lit(1)).alias("n_results"))
    r = r.select("r_conv", "r_call", F.col("first.turn").alias("r_turn"), "first.result", F.col("differ").alias("r_differ"), "n_results")
    both = c.join(r, F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("call_id") == F.col("r_call")), "full_outer")
    both = both.select(
        F.coalesce("conv_id", "r_conv").alias("conv_id"),
        F.coalesce("call_id", "r_call").alias("call_id"),
        F.coalesce("turn", "r_turn").alias("turn"),
        "call",
        "result",
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        F.when(F.col("c_differ") & F.col("r_differ"), "both").when(F.col("c_differ"), "calls").when(F.col("r_differ"), "results").alias("clash"),
    )

    def parse(text: str) -> tuple[str, object]:
        if text.lstrip()[:1] == "{":
            try:
                value = strict(text)
                if isinstance(value, dict) and isinstance(value.get("name"), str) and "arguments" in value:
                    args = value["arguments"]
                    return safe(value["name"]), strict(args) if isinstance(args, str) else args
            except (ValueError, RecursionError):
                pass
        return "reply", {"text": text}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, status, lines, refs = [], [], [], []
            for call_id, call, result in zip(*(b.column(k).to_pylist() for k in ("call_id", "call", "result")), strict=True):
                name, args = parse(call) if call is not None else (None, None)
                line = {"id": call_id}
                if call is not None:
                    line |= {"arguments": args, "name": name}
                if result is not None:
                    line["result"] = result
                good = call is None or name in schemas and conforms(args, schemas[name])
                names.append(name)
                status.append("orphan_result" if call is None else "invalid_arguments" if not good else "missing_result" if result is None else "linked")
                lines.append(canonical(line))
                refs.append(sorted(set(references(args))))
            keep = ["conv_id", "call_id", "turn", "n_calls", "n_results", "clash"]
            made = [pa.array(names, pa.string()), pa.array(status, pa.string()), pa.array(lines, pa.string()), pa.array(refs, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*map(b.column, keep), *made], names=[*keep, "name", "status", "json", "refs"])

    kind = lambda k: both.schema[k].dataType.simpleString()
    made = both.mapInArrow(run, f"conv_id {kind('conv_id')}, call_id string, turn {kind('turn')}, n_calls long, n_results long, clash string, name string, status string, json string, refs array<string>")
    done, _ = write_table(spark, made, "tool-calls")
    levels = _levels(spark, done)
    if levels is None:
        out = done.withColumn("level", F.lit(0))
    else:
        mine = levels.select(F.col("conv_id").alias("l_conv"), F.col("call_id").alias("l_call"), F.col("level").alias("l_level"))
        out = done.join(mine, F.col("conv_id").eqNullSafe(F.col("l_conv")) & (F.col("call_id") == F.col("l_call")), "left")
        out = out.withColumn("level", F.when(F.col("l_call").isNull(), 0).otherwise(F.col("l_level")))
    status = F.when(F.col("level").isNull(), "cycle").otherwise(F.col("status"))
    return out.select("conv_id", "call_id", "turn", "name", "level", "n_calls", "n_results", "clash", status.alias("status"), "json")


def _levels(spark: SparkSession, done: DataFrame) -> DataFrame | None:
    """conv_id, call_id and level of the calls that refer to others; null in or above a cycle. None if no call does."""
    named = done.select("conv_id", "call_id", F.explode("refs").alias("ref"))
    there = done.select(F.col("conv_id").alias("t_conv"), F.col("call_id").alias("ref_id"))
    named = named.join(there, F.col("conv_id").eqNullSafe(F.col("t_conv")) & (F.col("ref") == F.col("ref_id")))
    node = lambda conv, call: F.struct(F.col(conv).isNull().alias("none"), F.coalesce(F.col(conv).cast("string"), F.lit("")).alias("conv"), F.col(call).alias("call"))
    edges, edges_at = write_table(spark, named.select("conv_id", "call_id", node("conv_id", "call_id").alias("u"), node("conv_id", "ref").alias("v")), "tool-refs")
    if edges.isEmpty():
        drop_table(spark, edges_at)
        return None
    degree = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
    jumps, jumps_at = write_table(spark, degree.where("n = 1").select("u", "v", F.lit(1).cast("long").alias("w")), "tool-jumps")
    # u is w references above v. After a doubling for each binary digit of their number, a jump that still can go on is in a cycle.
    for _ in range(max(1, jumps.count()).bit_length() + 1):
        on = jumps.select(F.col("u").alias("v"), F.col("v").alias("to"), F.col("w").alias("more"))
        longer = jumps.join(on, "v", "left").select("u", F.coalesce("to", "v").alias("v"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"))
        went = jumps.join(on, "v", "left_semi").isEmpty()
        if went:
            break
        last = jumps_at
        jumps, jumps_at = write_table(spark, longer, "tool-jumps")
        drop_table(spark, last)
    # A jump ends at a call that refers to none (level 0), at one that refers to several, or in a cycle.
    several = degree.where("n > 1").select("u")
    ends = jumps.select(F.col("u").alias("v"), F.col("v").alias("end"), "w")
    loops = jumps.select(F.col("u").alias("end"), F.lit(True).alias("loops"))
    ahead = edges.join(several, "u", "left_semi").select("u", "v").join(ends, "v", "left")
    ahead = ahead.select("u", F.coalesce("end", "v").alias("end"), (1 + F.coalesce("w", F.lit(0))).alias("w")).join(loops, "end", "left")
    ahead, ahead_at = write_table(spark, ahead.join(several.select(F.col("u").alias("end"), F.lit(True).alias("waits")), "end", "left"), "tool-ahead")
    level, level_at = write_table(spark, several.withColumn("level", F.lit(None).cast("long")), "tool-levels")
    while True:
        below = level.select(F.col("u").alias("end"), F.col("level").alias("b_level"))
        own = F.when(F.col("loops").isNotNull(), None).when(F.col("waits").isNull(), F.lit(0)).otherwise(F.col("b_level"))
        now = ahead.join(below, "end", "left").groupBy("u").agg(F.when(F.count(F.lit(1)) == F.count(own), F.max(own + F.col("w"))).alias("level"))
        now, now_at = write_table(spark, now, "tool-levels")
        grown = now.where("level IS NOT NULL").count() > level.where("level IS NOT NULL").count()
        drop_table(spark, level_at)
        level, level_at = now, now_at
        if not grown:
            break
    end = jumps.select("u", F.col("v").alias("end"), "w").join(loops, "end", "left").join(level.select(F.col("u").alias("end"), "level", F.lit(True).alias("waits")), "end", "left")
    single = end.select("u", F.when(F.col("loops").isNotNull(), None).when(F.col("waits").isNull(), F.col("w")).otherwise(F.col("w") + F.col("level")).alias("level"))
    levels = single.unionByName(level).select(F.col("u").alias("k"), F.col("level").cast("int").alias("level"))
    return edges.select("conv_id", "call_id", F.col("u").alias("k")).distinct().join(levels, "k").drop("k")
