"""Chat formatting with linked tool calls (operator 2), in DataFrame operations only.

Turns are (conversation, turn, role, text). An assistant's text that is a JSON object with `tool_calls` holds
calls {id, name, arguments, depends_on}; a text of role `tool` that is a JSON object with `tool_call_id` is a
result. Calls and results are linked by a hash join on conversation and identifier. Calls are put in
topological order: a call's level is one more than the highest level it depends on, found in rounds of joins,
a round for each level (a row of a cycle gets no level). Arguments are checked against schemas
(name, parameter, type, required), one row for each parameter, by a join on the tool's name. Schemas are those
that a conversation declares, and those the caller passes. Every message comes out as one line of canonical JSON:
keys sorted at every depth, also in arguments and contents that are objects, no spaces, numbers as parsed.

The result is a row for each message and each call, sorted by (conversation, anchor turn, level, part): in a turn,
calls stand behind those they depend on and results right behind their calls. A call that depends on one of a later
turn keeps its turn; levels tell. It is sorted by ranges, not gathered by conversation, so a conversation of any
length is spread.

A conversation declares its tools in texts of role `system` that are JSON objects with `tools`: {name, parameters}, or
{function: {name, parameters}}, where `parameters` is a JSON schema. Read from it are `properties` with their `type` (or
types), `required`, and `additionalProperties` where it is false; nested schemas and other keywords are not checked. The
text itself stays a plain message.

Defined results: null roles are `user`, null texts empty; texts that aren't such JSON are plain; a result
without a call, a second result for a call, a call without a result or identifier, or a second call of one
identifier is kept and marked in `errors`; of ties the least (turn, part) counts; null conversations and calls
without an identifier link with nothing, and such a call's level is that of what it depends on; an empty table gives
an empty result. Levels may be any number deep, and only calls within or behind a cycle have none. A tool declared
twice counts as first declared, before or after its calls; it hides the caller's of that name. Tools without a name
declare nothing. Where neither the conversation nor the caller has schemas, arguments only have to be a JSON object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read_table, settle

_CALLS = "content string, tool_calls array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>"
_RESULT = "tool_call_id string, content string"
_TOOL = "name string, parameters string, function struct<name:string,parameters:string>"
_PARAMETERS = "properties map<string,string>, required array<string>, additionalProperties string"
ROUNDS_APART = 32  # rounds of levels that a plan reads one by one
#: Spark's names of a variant's types, by the names schemas use.
TYPES = {"string": "STRING", "integer": r"BIGINT|DECIMAL\(\d+,0\)", "number": "BIGINT|DOUBLE|DECIMAL.*|FLOAT", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID"}


def canonical(text: Column) -> Column:
    """A JSON text with sorted keys and no spaces; null if it doesn't parse. Read twice, for 1e2 is written 100.0 first."""
    return F.to_json(F.try_parse_json(F.to_json(F.try_parse_json(text))))


def _at(value: Column, path: str, type_: str = "variant") -> Column:
    return F.try_variant_get(value, F.lit(path), type_)


def _nested(value: Column, plain: Column) -> Column:
    """plain, or canonical JSON of a value that is an object or array: from_json keeps its order and rounds its numbers."""
    return F.when(F.rlike(F.schema_of_variant(value), F.lit("^(OBJECT|ARRAY)")), canonical(F.to_json(value))).otherwise(plain)


def parse_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, calls, result): calls and result are null on plain messages."""
    role = F.coalesce(F.lower("role"), F.lit("user"))
    text = F.coalesce("text", F.lit(""))
    opens = F.ltrim(text).startswith("{")
    calls = F.when((role == "assistant") & opens, F.from_json(text, _CALLS))
    result = F.when((role == "tool") & opens, F.from_json(text, _RESULT))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.size(calls.tool_calls) > 0, calls).alias("calls"), F.when(result.tool_call_id.isNotNull(), result).alias("result"))


def find_calls(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, part, call_id, link, name, arguments, depends_on) of every call. link is what calls are joined by:
    the identifier, or the call's own place if it has none."""
    values = F.coalesce(_at(F.try_parse_json("text"), "$.tool_calls", "array<variant>"), F.array().cast("array<variant>"))
    both = F.arrays_zip(F.col("calls.tool_calls").alias("call"), values.alias("value"))
    each = parsed.where("calls IS NOT NULL").select("conv_id", "turn", F.posexplode(both).alias("part", "both"))
    each = each.select("conv_id", "turn", "part", "both.call", "both.value")
    arguments = _nested(_at(F.col("value"), "$.arguments"), F.col("call.arguments"))
    own = F.concat(F.lit("!"), F.coalesce(F.col("turn").cast("string"), F.lit("")), F.lit(":"), F.col("part").cast("string"))
    link = F.coalesce(F.concat(F.lit("="), "call.id"), own)
    return each.select("conv_id", "turn", (F.col("part") + 1).alias("part"), F.col("call.id").alias("call_id"), link.alias("link"), F.coalesce("call.name", F.lit("")).alias("name"), F.coalesce(arguments, F.lit("{}")).alias("arguments"), "call.depends_on")


def declared_schemas(parsed: DataFrame) -> DataFrame:
    """(conv_id, name, parameter, type, required, open): a row for each parameter of the tools that conversations declare,
    and one without parameter for a tool that has none. type may name several, as a|b; open takes other parameters too."""
    said = parsed.where((F.col("role") == "system") & F.ltrim("text").startswith("{") & F.col("conv_id").isNotNull())
    each = said.select("conv_id", "turn", F.posexplode(F.from_json("text", "tools array<string>").tools).alias("part", "tool"))
    each = each.withColumn("tool", F.from_json("tool", _TOOL))
    each = each.select("conv_id", F.coalesce("tool.function.name", "tool.name").alias("name"), F.struct("turn", "part", F.coalesce("tool.function.parameters", "tool.parameters").alias("parameters")).alias("at")).where("name IS NOT NULL")
    first = each.groupBy("conv_id", "name").agg(F.min("at").alias("at")).withColumn("schema", F.from_json("at.parameters", _PARAMETERS))
    none = F.array().cast("array<string>")
    required = F.coalesce("schema.required", none)
    names = F.array_union(F.coalesce(F.map_keys("schema.properties"), none), required)
    each = first.select("conv_id", "name", F.explode_outer(names).alias("parameter"), F.col("schema.properties").alias("properties"), required.alias("needed"), F.coalesce(F.col("schema.additionalProperties") != "false", F.lit(True)).alias("open"))
    kind = F.from_json(F.element_at("properties", F.col("parameter")), "type string").type
    kinds = F.coalesce(F.from_json(kind, "array<string>"), F.array(kind))
    return each.select("conv_id", "name", "parameter", F.when(kind.isNotNull(), F.array_join(kinds, "|")).alias("type"), F.coalesce(F.array_contains("needed", F.col("parameter")), F.lit(False)).alias("required"), "open")


def call_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, link, level): 0 for calls that depend on none known; null within or behind a cycle.

    A round takes the calls placed last out of what is still needed; a call of which nothing is needed any more is
    placed on the next level. So a round reads only what is left, and rounds end when one places none."""
    on = ["conv_id", "link"]
    known = settle(calls.select(*on).distinct(), "calls")
    needs = calls.select(*on, F.explode("depends_on").alias("id")).select(*on, F.concat(F.lit("="), "id").alias("need")).distinct()
    needs = settle(needs.join(known.withColumnRenamed("link", "need"), ["conv_id", "need"]).select(*on, "need"), "needs")
    now = settle(known.join(needs, on, "left_anti").withColumn("level", F.lit(0)), "levels")
    placed, level = [now], 0
    while not needs.isEmpty():
        left = settle(needs.join(now.select("conv_id", F.col("link").alias("need")), ["conv_id", "need"], "left_anti"), "needs")
        level += 1
        now = settle(needs.join(left.select(*on), on, "left_anti").select(*on).distinct().withColumn("level", F.lit(level)), "levels")
        discard(needs)
        needs = left
        if now.isEmpty():
            break
        placed.append(now)
        if len(placed) > ROUNDS_APART:
            placed = [settle(_united(placed), "levels")]
    return known.join(_united(placed), on, "left").select(*on, F.when(F.col("conv_id").isNull(), 0).otherwise(F.col("level")).alias("level"))


def _united(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def argument_errors(calls: DataFrame, schemas: DataFrame | None, declared: DataFrame) -> DataFrame:
    """(conv_id, turn, part, wrong array<string>) of calls whose arguments don't fit. Rules have the conversation that
    declares them as their scope, the caller's none."""
    at = ["conv_id", "turn", "part"]
    tool = ["name", "scoped", "scope"]  # a scope is never null, so that joins on it hash
    parsed = calls.select(*at, "name", F.try_parse_json("arguments").alias("value"))
    is_object = F.coalesce(F.schema_of_variant("value").startswith("OBJECT"), F.lit(False))
    broken = parsed.where(~is_object).select(*at, F.lit("arguments are no object").alias("wrong"))
    own = declared.select("name", F.lit(True).alias("scoped"), F.col("conv_id").alias("scope"), F.col("parameter").alias("rule"), F.lower("type").alias("type"), "required", "open")
    rules = own
    if schemas is not None:
        rules = own.unionByName(schemas.select("name", F.lit(False).alias("scoped"), F.lit(0).cast(declared.schema["conv_id"].dataType).alias("scope"), F.col("parameter").alias("rule"), F.lower("type").alias("type"), F.coalesce("required", F.lit(False)).alias("required"), F.lit(False).alias("open")))
    tools = declared.select("conv_id", "name", F.lit(True).alias("scoped")).distinct()
    good = parsed.where(is_object).join(tools, ["conv_id", "name"], "left")
    scope = F.when(F.col("scoped"), F.col("conv_id")).otherwise(F.lit(0).cast(declared.schema["conv_id"].dataType))
    good = good.select(*at, "name", F.coalesce("scoped", F.lit(False)).alias("scoped"), scope.alias("scope"), "value")
    keys = F.map_keys(F.from_json(F.to_json("value"), "map<string,string>"))
    raw = F.from_json(F.to_json("value"), "map<string,variant>")
    bound = good if schemas is not None else good.join(declared.select("conv_id").distinct(), "conv_id", "left_semi")
    unknown = bound.join(rules.select(*tool).distinct(), tool, "left_anti").select(*at, F.concat(F.lit("unknown tool "), "name").alias("wrong"))
    checked = good.withColumn("raw", raw).join(rules, tool)
    value = F.get("raw_value", F.lit(0))
    kind = F.schema_of_variant(value)
    checked = checked.withColumn("raw_value", F.array(F.element_at("raw", F.col("rule"))))
    types = F.split("type", r"\|")
    patterns = F.transform(types, lambda t: F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))[t])
    missing = checked.where(F.col("required") & ~F.array_contains(keys, F.col("rule"))).select(*at, F.concat(F.lit("missing "), "rule").alias("wrong"))
    present = checked.where(F.array_contains(keys, F.col("rule")) & ~F.exists(patterns, lambda p: p.isNull()))
    number = _at(value, "$", "double")
    whole = F.array_contains(types, "integer") & (kind == "DOUBLE") & (F.rint(number) == number)
    fits = F.rlike(kind, F.concat(F.lit("^("), F.array_join(patterns, "|"), F.lit(")$"))) | whole
    mistyped = present.where(~F.coalesce(fits, F.lit(False))).select(*at, F.concat(F.lit("no "), "type", F.lit(": "), "rule").alias("wrong"))
    named = rules.where("NOT open").groupBy(*tool).agg(F.collect_set("rule").alias("rules"))  # parameters of one tool
    extra = good.select(*at, *tool, F.explode(keys).alias("key")).join(named, tool).where(~F.array_contains("rules", F.col("key"))).select(*at, F.concat(F.lit("unexpected "), "key").alias("wrong"))
    every = broken.unionByName(unknown).unionByName(missing).unionByName(mistyped).unionByName(extra)
    return every.groupBy(*at).agg(F.array_sort(F.collect_set("wrong")).alias("wrong"))


def format_chat(turns: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """(conv_id, turn, part, anchor, level, kind, role, call_id, errors, message): one row per message or call.
    kind is text, call or result; anchor is the turn a row stands by: a result's is its call's."""
    parsed = parse_turns(turns)
    calls = settle(find_calls(parsed), "calls")
    on = ["conv_id", "link"]
    first_call = calls.where("call_id IS NOT NULL").groupBy(*on).agg(F.min(F.struct("turn", "part")).alias("call_at"))
    content = _nested(_at(F.try_parse_json("text"), "$.content"), F.col("result.content"))
    results = parsed.where("result IS NOT NULL").select("conv_id", "turn", F.col("result.tool_call_id").alias("call_id"), F.concat(F.lit("="), "result.tool_call_id").alias("link"), F.coalesce(content, F.lit("")).alias("content"))
    first_result = results.groupBy(*on).agg(F.min("turn").alias("result_at"))
    error = lambda test, what: F.when(test, F.array(F.lit(what))).otherwise(F.array().cast("array<string>"))

    levels = settle(call_levels(calls), "levels")
    declared = settle(declared_schemas(parsed), "schemas")
    wrong = argument_errors(calls, schemas, declared).select(F.struct("conv_id", "turn", "part").alias("place"), "wrong")
    linked = calls.join(first_result.hint("shuffle_hash"), on, "left").join(first_call.hint("shuffle_hash"), on, "left").join(levels, on, "left")
    linked = linked.join(wrong, F.struct("conv_id", "turn", "part").eqNullSafe(F.col("place")), "left")
    level = F.when(F.col("conv_id").isNull(), 0).otherwise(F.col("level"))
    call_errors = F.concat(error(F.col("call_id").isNull(), "no identifier"), error(F.col("result_at").isNull(), "no result"), error(F.col("result_at") < F.col("turn"), "result before call"), error((F.col("call_at.turn") != F.col("turn")) | (F.col("call_at.part") != F.col("part")), "second call of this id"), error(level.isNull(), "cycle"), F.coalesce("wrong", F.array().cast("array<string>")))
    call_id = F.coalesce("call_id", F.lit(""))
    call_json = F.concat(F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), _quoted(F.col("arguments"))), F.lit(',"id":'), _quoted(call_id), F.lit(',"name":'), _quoted(F.col("name")), F.lit(',"role":"assistant"}'))
    call_rows = linked.select("conv_id", "turn", "part", F.col("turn").alias("anchor"), level.alias("level"), F.lit("call").alias("kind"), F.lit("assistant").alias("role"), call_id.alias("call_id"), F.array_join(call_errors, "; ").alias("errors"), call_json.alias("message"))

    placed = results.join(first_call.hint("shuffle_hash"), on, "left").join(first_result.hint("shuffle_hash"), on, "left").join(levels, on, "left")
    result_errors = F.concat(error(F.col("call_at").isNull(), "no call"), error(F.col("result_at") < F.col("turn"), "second result of this call"))
    result_json = F.concat(F.lit('{"content":'), _quoted(F.col("content")), F.lit(',"role":"tool","tool_call_id":'), _quoted(F.col("call_id")), F.lit("}"))
    result_rows = placed.select("conv_id", "turn", F.coalesce("call_at.part", F.lit(0)).alias("part"), F.coalesce("call_at.turn", "turn").alias("anchor"), "level", F.lit("result").alias("kind"), F.lit("tool").alias("role"), "call_id", F.array_join(result_errors, "; ").alias("errors"), result_json.alias("message"))

    said = F.when(F.col("calls").isNotNull(), F.coalesce(_nested(_at(F.try_parse_json("text"), "$.content"), F.col("calls.content")), F.lit(""))).otherwise(F.col("text"))
    text_json = F.concat(F.lit('{"content":'), _quoted(said), F.lit(',"role":'), _quoted(F.col("role")), F.lit("}"))
    texts = parsed.where("result IS NULL AND (calls IS NULL OR calls.content IS NOT NULL)")
    text_rows = texts.select("conv_id", "turn", F.lit(0).alias("part"), F.col("turn").alias("anchor"), F.lit(0).alias("level"), F.lit("text").alias("kind"), "role", F.lit("").alias("call_id"), F.lit("").alias("errors"), text_json.alias("message"))
    return text_rows.unionByName(call_rows).unionByName(result_rows).orderBy("conv_id", "anchor", F.asc_nulls_last("level"), "part", "kind", "turn")


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    inside = F.to_json(F.struct(text.alias("x")))
    return F.substring(inside, F.lit(6), F.length(inside) - 6)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(read_table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.col("part").cast("long"), "anchor", F.col("level").cast("long"), "kind", "role", "call_id", "errors", "message")


#: The tables hold no tool calls, so that the SQL needs the plain messages only.
SQL = """
SELECT conv_id, turn, 0::BIGINT AS part, turn AS anchor, 0::BIGINT AS level, 'text' AS kind,
       coalesce(lower(role), 'user') AS role, '' AS call_id, '' AS errors,
       '{"content":' || to_json(coalesce(text, ''))::VARCHAR || ',"role":' || to_json(coalesce(lower(role), 'user'))::VARCHAR || '}' AS message
FROM conversations
"""
