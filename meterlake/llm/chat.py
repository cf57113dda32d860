"""Chat formatting: link tool calls with their results, order them, validate arguments, write canonical JSON.

Only DataFrame functions.  Calls and results meet in hash joins by (conversation, call id).  A call may wait
for an earlier call's result; its effective turn is the latest of its own and what it waits for, one turn
after the result.  Along chains of any length this is found by pointer doubling: each round doubles how
far back a call has looked, so the number of rounds is the logarithm of the longest chain.  Events are numbered
by (effective turn, message before call before result, turn, id) with counts per block of turns, so
that a huge conversation is never sorted in one task.

Arguments are checked against a table of tool parameters: unknown tool, missing or unknown argument, wrong
type, out of range.  JSON is canonical: keys in order, no blanks, no null fields, and so is the text of a call's
arguments, which is parsed and written again.  An argument that is null is of a wrong type and left out of the text.  A number
with a decimal point is taken by its value, so 3.0 is the whole number 3 in check and text, and a whole number beyond a long is out of
range, not of a wrong type; one with an exponent is a floating-point number and written as one.  Inside an argument that is itself an
object or a list, keys are ordered, but nulls and the forms of numbers stay.

A missing key never meets others: rows without one take a join key of their own, so no task gets them all.

Defined results: rows without conversation or turn keep their JSON but have no position and link to
nothing; a result whose call does not exist is not linked; the earliest of several results answers a call, the
others are marked ``repeated``; calls with one id are merged into the earliest and marked ``repeated``; a
chain that loops is marked ``cycle`` and ordered by turn; an unreadable argument text, one that is no object and one
with a repeated name are marked ``json`` and kept as they are; a call without conversation, turn or id stays, unlinked
and marked ``key``; ties keep every row; empty tables give empty results; extra columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

BLOCK = 256
MAX_ROUNDS = 48


def canonical(**fields: Column) -> Column:
    """A JSON object with its keys in order; null fields are left out."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


def parsed(arguments: Column) -> Column:
    """The arguments as a variant; null where the text is no JSON object."""
    v = F.try_parse_json(arguments)
    return F.when(F.schema_of_variant(v).startswith("OBJECT<"), v)


def type_name(value: Column) -> Column:
    """The type of a variant without its parameters: OBJECT, ARRAY, DECIMAL, BIGINT, ..."""
    return F.coalesce(F.regexp_replace(F.schema_of_variant(value), r"[<(].*$", ""), F.lit("VOID"))


def decimal_text(value: Column) -> Column:
    """The digits of a decimal variant, without zeros at the end of its fraction; null for anything else."""
    text = F.when(type_name(value) == "DECIMAL", F.try_variant_get(value, "$", "string"))
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def whole_number(value: Column) -> Column:
    """Whether a variant is a number without a fraction, however large; one with an exponent is a floating-point number."""
    return (type_name(value) == "BIGINT") | F.coalesce(decimal_text(value).rlike("^-?[0-9]+$"), F.lit(False))


def one_form(value: Column) -> Column:
    """A decimal variant without needless zeros; anything else as it is."""
    return F.coalesce(F.try_parse_json(decimal_text(value)), value)


def same_key(conv: Column | str, own: Column | str, other_conv: str, other: str, spread: str) -> Column:
    """Equality of (conversation, id) as join keys.  Where either is missing, a hash of ``spread`` takes their place as a
    third key, which nothing on the other side equals."""
    conv, own = (F.col(c) if isinstance(c, str) else c for c in (conv, own))
    apart = F.when(conv.isNull() | own.isNull(), F.pmod(F.xxhash64(spread), F.lit(65_536)) + 1).otherwise(0)
    return (conv == F.col(other_conv)) & (own == F.col(other)) & (apart == F.when(F.col(other).isNotNull(), 0))


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with ``problems``: what is wrong with each one's arguments, in the schema's order."""
    params = schemas.groupBy("tool").agg(F.array_sort(F.collect_list(F.struct("param", "type", "required", "low", "high"))).alias("params"))
    # names and values come apart, so whatever stands in a name does no harm
    told = F.from_json("arguments", "map<string,variant>")
    have = F.when(F.col("object").isNotNull(), F.transform_values(told, lambda k, v: one_form(v)))
    # in order of names, which a map alone does not promise
    some = F.map_filter("have", lambda k, v: type_name(v) != "VOID")
    ordered = F.map_from_entries(F.array_sort(F.map_entries(some), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))

    def judge(p: Column) -> Column:
        there, value = F.map_contains_key("have", p["param"]), F.try_element_at("have", p["param"])
        number = F.try_variant_get(value, "$", "double")
        outside = (number < p["low"]) | (number > p["high"])
        return (
            F.when(~there & p["required"], F.concat(F.lit("missing:"), p["param"]))
            .when(there & (F.when(whole_number(value), "BIGINT").otherwise(type_name(value)) != p["type"]), F.concat(F.lit("type:"), p["param"]))
            .when(there & F.coalesce(outside, F.lit(False)), F.concat(F.lit("range:"), p["param"]))
        )

    names = F.transform("params", lambda p: p["param"])
    unknown = F.transform(F.array_sort(F.array_except(F.map_keys("have"), names)), lambda k: F.concat(F.lit("unknown:"), k))
    problems = (
        F.when(F.col("params").isNull(), F.array(F.concat(F.lit("tool:"), F.coalesce("name", F.lit("")))))
        .when(F.col("have").isNull(), F.array(F.lit("json")))
        .otherwise(F.concat(F.filter(F.transform("params", judge), lambda x: x.isNotNull()), unknown))
    )
    # a call without a tool's name joins with nothing, wherever it lies
    joined = calls.join(params, F.coalesce("name", F.concat(F.lit("\0"), F.xxhash64("call_id"))) == params["tool"], "left").drop("tool")
    read = joined.withColumn("object", parsed(F.col("arguments"))).withColumn("have", have).withColumn("problems", problems)
    return read.withColumn("arguments", F.coalesce(F.to_json(ordered), "arguments")).drop("params", "object", "have")


def effective_turns(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, turn, after, ready) to (conv_id, call_id, eff, cycle) by pointer doubling.

    A call's row covers its ancestors up to ``anc``, ``dist`` steps up; ``best`` is the latest turn they allow.
    """
    state = calls.select("conv_id", "call_id", "turn", "ready", F.col("after").alias("anc"))
    parent = calls.select(F.col("conv_id").alias("p_conv"), F.col("call_id").alias("p_id"), "ready")
    joined = state.drop("ready").join(parent, same_key("conv_id", "anc", "p_conv", "p_id", "call_id"), "left")
    state = materialize(joined.select("conv_id", "call_id", "turn", F.col("p_id").alias("anc"), (F.col("ready") + 1).alias("best"),
            F.when(F.col("p_id").isNotNull(), 1).otherwise(0).cast("long").alias("dist")), "chains")
    for _ in range(MAX_ROUNDS):
        if state.filter("anc is not null").isEmpty():
            break
        far = state.select(F.col("conv_id").alias("p_conv"), F.col("call_id").alias("p_id"), F.col("anc").alias("p_anc"),
            F.col("best").alias("p_best"), F.col("dist").alias("p_dist"))
        # a chain that is longer than there are calls loops; it stays marked by its ancestor
        joined = state.join(far, same_key("conv_id", "anc", "p_conv", "p_id", "call_id"), "left")
        state = materialize(
            joined.select("conv_id", "call_id", "turn", F.col("p_anc").alias("anc"),
                F.greatest("best", F.col("p_best") + F.col("dist")).alias("best"), (F.col("dist") + F.coalesce("p_dist", F.lit(0))).alias("dist")),
            "chains"
        )
        if state.agg(F.max("dist") > F.count(F.lit(1))).first()[0]:
            break
    loops = F.col("anc").isNotNull()
    return state.select("conv_id", "call_id", F.when(loops, F.col("turn")).otherwise(F.greatest("turn", "best")).alias("eff"), loops.alias("cycle"))


def numbered(events: DataFrame) -> DataFrame:
    """``events`` with ``position`` from 1 in its conversation."""
    placed = F.col("conv_id").isNotNull() & F.col("eff").isNotNull()
    events = events.withColumn("_block", F.when(placed, F.floor(F.col("eff") / BLOCK)).otherwise(F.pmod(F.xxhash64("json"), F.lit(4096))))
    counts = events.groupBy("conv_id", "_block", placed.alias("_placed")).agg(F.count(F.lit(1)).alias("_n")).filter("_placed").drop("_placed")
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("conv_id").alias("_c"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("conv_id", "_block").orderBy("eff", "kind_no", "turn", "call_id", "json"))
    return (
        events.withColumn("_rank", rank)
        .join(counts, (F.col("conv_id") == F.col("_c")) & (F.col("_block") == F.col("_b")) & placed, "left")
        .withColumn("position", F.col("_first") + F.col("_rank")).drop("_block", "_rank", "_c", "_b", "_first")
    )


def format_chats(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per message, call and result: conv_id, position, kind, turn, call_id, linked, problems, json.

    messages: conv_id, turn, role, text; calls: conv_id, turn, call_id, name, arguments (JSON text), after (a
    call id or null); results: conv_id, turn, call_id, content; schemas: tool, param, type, required, low, high.
    """
    key = ["conv_id", "call_id"]
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("call_id").isNotNull()
    first = (
        calls.filter(whole).groupBy(*key)
        .agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("c"), (F.count(F.lit(1)) > 1).alias("repeated"))
        .select(*key, "c.*", "repeated")
    )
    answered = results.filter(whole).groupBy(*key).agg(F.min("turn").alias("answer"), F.count(F.lit(1)).alias("answers"))
    linked = materialize(first.join(answered, key, "left").withColumn("ready", F.greatest("turn", "answer")), "calls")
    order = materialize(effective_turns(linked), "order")
    known = linked.select(F.col("conv_id").alias("a_conv"), F.col("call_id").alias("a_id"))
    full = (
        validated(linked, schemas).join(order, key)
        .join(known, same_key("conv_id", "after", "a_conv", "a_id", "call_id"), "left")
        .withColumn("problems", F.concat(
            "problems",
            F.when(F.col("after").isNotNull() & F.col("a_id").isNull(), F.array(F.lit("after"))).otherwise(F.array().cast("array<string>")),
            F.when(F.col("repeated"), F.array(F.lit("repeated"))).otherwise(F.array().cast("array<string>")),
            F.when(F.col("cycle"), F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>")),
        ))
    )
    lost = (
        validated(calls.filter(~whole), schemas)
        .withColumn("problems", F.concat("problems", F.array(F.lit("key"))))
        .withColumns({"answer": F.lit(None).cast("long"), "eff": F.col("turn")})
    )
    shown = ["conv_id", "turn", "eff", "call_id", "answer", "problems", "after", "arguments", "name"]
    call_rows = full.select(*shown).unionByName(lost.select(*shown)).select(
        "conv_id", "turn", "eff", F.lit(1).alias("kind_no"), F.lit("call").alias("kind"), "call_id",
        F.col("answer").isNotNull().alias("linked"), F.array_join("problems", ",").alias("problems"),
        canonical(after=F.col("after"), arguments=F.col("arguments"), id=F.col("call_id"), name=F.col("name"), type=F.lit("call")).alias("json"),
    )
    facts = linked.select(*key, "answer").join(order.select(*key, "eff"), key).select(F.col("conv_id").alias("k_conv"),
        F.col("call_id").alias("k_id"), "answer", F.col("eff").alias("call_eff"))
    result_rows = results.join(facts, same_key("conv_id", "call_id", "k_conv", "k_id", "content"), "left").select(
        "conv_id", "turn", F.greatest("turn", "call_eff").alias("eff"), F.lit(2).alias("kind_no"), F.lit("result").alias("kind"), "call_id",
        F.col("k_id").isNotNull().alias("linked"),
        F.when(F.col("turn") > F.col("answer"), "repeated").otherwise("").alias("problems"),
        canonical(call=F.col("call_id"), content=F.col("content"), type=F.lit("result")).alias("json"),
    )
    message_rows = messages.select(
        "conv_id", "turn", F.col("turn").alias("eff"), F.lit(0).alias("kind_no"), F.lit("message").alias("kind"),
        F.lit(None).cast("string").alias("call_id"), F.lit(False).alias("linked"), F.lit("").alias("problems"),
        canonical(content=F.col("text"), role=F.col("role"), type=F.lit("message")).alias("json"),
    )
    events = message_rows.unionByName(call_rows).unionByName(result_rows)
    return numbered(events).select("conv_id", "position", "kind", "turn", "call_id", "linked", "problems", "json")


#: The tools' parameters, as (tool, param, type, required, low, high).
TOOLS = [
    ("lookup", "limit", "BIGINT", False, 0.0, 100.0),
    ("lookup", "query", "STRING", True, None, None),
    ("search", "limit", "BIGINT", True, 0.0, 50.0),
    ("search", "query", "STRING", True, None, None),
    ("sum", "limit", "BIGINT", True, 0.0, 30.0),
    ("sum", "unit", "STRING", False, None, None),
]
TOOL_SCHEMA = "tool string, param string, type string, required boolean, low double, high double"


def tools(spark: SparkSession) -> DataFrame:
    """The tools' parameters as literals of the plan."""
    say = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower()
    values = ", ".join(f"({', '.join(map(say, row))})" for row in TOOLS)
    cast = ", ".join("CAST({0} AS {1}) AS {0}".format(*c.split()) for c in TOOL_SCHEMA.split(", "))
    return spark.sql(f"SELECT {cast} FROM VALUES {values} AS t({', '.join(c.split()[0] for c in TOOL_SCHEMA.split(', '))})")


def text_number() -> Column:
    """A number from a text's first 24 hash bits."""
    return F.conv(F.left(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")), F.lit(6)), 16, 10).cast("long")


def derived_calls(conversations: DataFrame) -> DataFrame:
    """A tool call for each assistant turn, made from its text: the table has prose only."""
    h = text_number()
    conv, turn = F.col("conv_id").cast("string"), F.col("turn")
    query = F.regexp_replace(F.substring("text", 1, 20), r"[^A-Za-z ]", "")
    arguments = F.to_json(F.struct((h % 60).alias("limit"), F.when(h % 7 != 0, query).alias("query"), F.when(h % 11 == 0, F.lit("k")).alias("unit")))
    return conversations.filter("role = 'assistant'").select(
        "conv_id", "turn", F.concat(F.lit("c"), conv, F.lit("-"), turn.cast("string")).alias("call_id"),
        F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("sum"), F.lit("fly")), (h % 4 + 1).cast("int")).alias("name"),
        arguments.alias("arguments"),
        F.when((h % 3 == 0) & (turn >= 2), F.concat(F.lit("c"), conv, F.lit("-"), (turn - 2).cast("string"))).alias("after"),
    )


def derived_results(conversations: DataFrame) -> DataFrame:
    """A result for each later user turn, of the call one turn before or, for every fifth text, three before."""
    h = text_number()
    back = F.when(h % 5 == 0, 3).otherwise(1)
    return conversations.filter("role = 'user' and turn >= 1").select(
        "conv_id", "turn", F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - back).cast("string")).alias("call_id"),
        F.col("text").alias("content")
    )


#: The registered query in DuckDB SQL.
ORACLE = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, role, text, CAST('0x' || substr(md5(coalesce(text, '')), 1, 6) AS BIGINT) AS h FROM conversations),
a AS (
  SELECT conv_id, turn, 'c' || conv_id || '-' || turn AS call_id, ['search', 'lookup', 'sum', 'fly'][h % 4 + 1] AS name, h % 60 AS lim,
    CASE WHEN h % 7 <> 0 THEN regexp_replace(substr(text, 1, 20), '[^A-Za-z ]', '', 'g') END AS q, h % 11 = 0 AS unit,
    CASE WHEN h % 3 = 0 AND turn >= 2 THEN 'c' || conv_id || '-' || (turn - 2) END AS after
  FROM c WHERE role = 'assistant'),
r AS (SELECT conv_id, turn, 'c' || conv_id || '-' || (turn - CASE WHEN h % 5 = 0 THEN 3 ELSE 1 END) AS call_id, text AS content FROM c WHERE role = 'user' AND turn >= 1),
ans AS (SELECT call_id, min(turn) AS answer FROM r GROUP BY call_id),
l AS (SELECT a.*, ans.answer, greatest(a.turn, coalesce(ans.answer, a.turn)) AS ready FROM a LEFT JOIN ans USING (call_id)),
up AS (SELECT l.call_id, p.call_id AS anc, p.after AS nxt, p.ready + 1 AS best, 1 AS dist FROM l JOIN l p ON p.call_id = l.after
  UNION ALL SELECT up.call_id, p.call_id, p.after, p.ready + up.dist + 1, up.dist + 1 FROM up JOIN l p ON p.call_id = up.nxt),
eff AS (SELECT l.call_id, greatest(l.turn, coalesce(max(up.best), l.turn)) AS eff FROM l LEFT JOIN up USING (call_id) GROUP BY l.call_id, l.turn),
ev AS (
  SELECT conv_id, turn, turn AS eff, 0 AS kind_no, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, false AS linked, '' AS problems,
    '{' || CASE WHEN text IS NOT NULL THEN '"content":' || to_json(text)::VARCHAR || ',' ELSE '' END || '"role":' || to_json(role)::VARCHAR || ',"type":"message"}' AS json FROM c
  UNION ALL
  SELECT l.conv_id, l.turn, eff.eff, 1, 'call', l.call_id, answer IS NOT NULL, concat_ws(',',
      CASE WHEN name = 'fly' THEN 'tool:fly' WHEN name = 'search' AND lim > 50 OR name = 'sum' AND lim > 30 THEN 'range:limit' END,
      CASE WHEN name IN ('search', 'lookup') AND q IS NULL THEN 'missing:query' END, CASE WHEN name = 'sum' AND q IS NOT NULL THEN 'unknown:query' END,
      CASE WHEN name IN ('search', 'lookup') AND unit THEN 'unknown:unit' END, CASE WHEN after IS NOT NULL AND after NOT IN (SELECT call_id FROM a) THEN 'after' END),
    '{' || CASE WHEN after IS NOT NULL THEN '"after":"' || after || '",' ELSE '' END || '"arguments":' ||
      to_json('{"limit":' || lim || CASE WHEN q IS NOT NULL THEN ',"query":' || to_json(q)::VARCHAR ELSE '' END || CASE WHEN unit THEN ',"unit":"k"' ELSE '' END || '}')::VARCHAR ||
      ',"id":"' || l.call_id || '","name":"' || name || '","type":"call"}' FROM l JOIN eff USING (call_id)
  UNION ALL
  SELECT r.conv_id, r.turn, greatest(r.turn, coalesce(eff.eff, r.turn)), 2, 'result', r.call_id, eff.call_id IS NOT NULL, CASE WHEN eff.call_id IS NOT NULL AND r.turn > answer THEN 'repeated' ELSE '' END,
    '{"call":"' || r.call_id || '",' || CASE WHEN content IS NOT NULL THEN '"content":' || to_json(content)::VARCHAR || ',' ELSE '' END || '"type":"result"}' FROM r LEFT JOIN eff USING (call_id) LEFT JOIN ans USING (call_id))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY eff, kind_no, turn, call_id, json) AS position, kind, turn, call_id, linked, problems, json FROM ev
"""
