"""Chat formatting: tool calls linked to their results.

Calls and results meet in a hash join on (conversation, identifier). Calls are ordered topologically by
what they need: level 0 needs nothing, level n needs a call of level n - 1 and none above. Levels come
from joins that double how far each call sees along its needs, so a conversation of any length is
never gathered in one task. Arguments are validated against the tool's schema and everything is
serialised as canonical JSON: keys in order, no spaces.

All is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, stored

#: The tools of the query: parameter -> (type, whether it is required). Types are string, integer, number, boolean, array, object.
SCHEMAS = {
    "lookup": {"query": ("string", True), "limit": ("integer", False)},
    "summarise": {"text": ("string", True), "sentences": ("integer", True), "strict": ("boolean", False)},
}
_KINDS = {"string": "^STRING$", "integer": "^BIGINT$", "number": r"^(BIGINT|DOUBLE|DECIMAL.*|FLOAT)$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT"}


def json_text(c: Column) -> Column:
    """A string as a JSON string, null as null."""
    one = F.to_json(F.array(c))
    return F.coalesce(F.substring(one, F.lit(2), F.length(one) - 2), F.lit("null"))


def canonical(json: Column) -> Column:
    """The JSON value with keys in order and no spaces; null if it is no JSON."""
    return F.to_json(F.try_parse_json(json))


def argument_errors(name: Column, arguments: Column, schemas: dict) -> Column:
    """What is wrong with the arguments, as a sorted array; empty if nothing is."""
    value = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    told: Column = F.array(F.lit("unknown tool"))
    for tool, parameters in schemas.items():
        found = []
        for p, (kind, required) in parameters.items():
            got = F.schema_of_variant(F.try_variant_get(value, f"$.{p}", "variant"))
            absent = F.lit(f"missing {p}") if required else F.lit(None).cast("string")
            found.append(F.when(got.isNull() | (got == "VOID"), absent).when(~got.rlike(_KINDS[kind]), F.lit(f"{p} is no {kind}")))
        keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
        extra = F.transform(F.array_except(keys, F.array(*map(F.lit, parameters)).cast("array<string>")), lambda k: F.concat(F.lit("unexpected "), k))
        errors = F.array_sort(F.concat(F.array_compact(F.array(*found)), extra))
        told = F.when(name == tool, F.when(is_object, errors).otherwise(F.array(F.lit("arguments are no object")))).otherwise(told)
    return told


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) for distinct calls with `needs`; level is null for calls on or behind a circle of needs.

    Needs that name no call of the conversation are met from outside and don't count. Each call knows
    ends of its chains of needs and how far they are; a round replaces every end that has needs itself by that
    call's own ends, so the reach doubles and a chain of n calls takes log2(n) rounds. An end that is
    still open when the reach exceeds the longest conversation is a circle.
    """
    calls = stored(calls.select("conv_id", "call_id", "needs"), "calls")
    needs = calls.select("conv_id", "call_id", F.explode(F.array_distinct("needs")).alias("need"))
    known = calls.select(F.col("conv_id").alias("c"), F.col("call_id").alias("n"))
    edges = stored(needs.join(known, (F.col("conv_id") == F.col("c")) & (F.col("need") == F.col("n")), "left_semi"), "needs")
    bound = edges.select(F.col("conv_id").alias("c"), F.col("call_id").alias("n")).distinct().withColumn("more", F.lit(True))
    at = (F.col("conv_id") == F.col("c")) & (F.col("end") == F.col("n"))
    now = stored(edges.withColumnRenamed("need", "end").join(bound, at, "left").select("conv_id", "call_id", "end", F.lit(1).cast("long").alias("far"), F.coalesce("more", F.lit(False)).alias("more")), "ends")
    longest = calls.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    reach = 1
    while reach <= longest and not now.where("more").isEmpty():
        ends = now.select(F.col("conv_id").alias("c"), F.col("call_id").alias("n"), F.col("end").alias("next"), F.col("far").alias("on"), F.col("more").alias("again"))
        further = now.where("more").join(ends, at).select("conv_id", "call_id", F.col("next").alias("end"), (F.col("far") + F.col("on")).alias("far"), F.col("again").alias("more"))
        then = stored(now.where("not more").unionByName(further).groupBy("conv_id", "call_id", "end", "more").agg(F.max("far").alias("far")), "ends")
        forget(now)
        now, reach = then, reach * 2
    found = now.groupBy("conv_id", "call_id").agg(F.when(~F.bool_or("more"), F.max("far")).cast("int").alias("level"))
    first = calls.join(edges, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.lit(0).alias("level"))
    return first.unionByName(found)


def linked(calls: DataFrame, results: DataFrame, schemas: dict | None = None) -> DataFrame:
    """One row for each call, and one for each result without a call.

    calls: conv_id, call_id, position, name, arguments (JSON text), needs (array of call ids).
    results: conv_id, call_id, position, content.
    Returns conv_id, call_id, position, level, name, errors, n_errors, answered, record (canonical JSON), kind (`call` or `result`).

    Rows without conv_id or call_id link with nothing and are left out of both tables. Of several calls with one
    identifier the first by position (then name and arguments) counts, with the error `repeated call`;
    of several results the first by position (then content), with `repeated result`. A result without
    a call has position null, level null and the error `no call`; a call without a result has `no result`;
    a call on a circle of needs has level null and `circular needs`. Empty tables give an empty result. What the calls and
    results that do not count hold is in the rows of `repeats`.
    """
    schemas = SCHEMAS if schemas is None else schemas
    c = calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(
        F.min(F.struct(F.coalesce("position", F.lit(2**62)).alias("p"), "position", "name", "arguments", "needs")).alias("x"), F.count(F.lit(1)).alias("times")
    ).select("conv_id", "call_id", "x.position", "x.name", "x.arguments", F.coalesce("x.needs", F.array().cast("array<string>")).alias("needs"), "times")
    c = stored(c, "calls")
    r = results.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(
        F.min(F.struct(F.coalesce("position", F.lit(2**62)).alias("p"), "content")).alias("y"), F.count(F.lit(1)).alias("answers")
    ).select("conv_id", "call_id", F.col("y.content").alias("content"), "answers")
    placed = c.join(levels(c), ["conv_id", "call_id"], "left")
    both = placed.hint("shuffle_hash").join(r, ["conv_id", "call_id"], "full_outer")
    is_call, is_answered = F.col("times").isNotNull(), F.col("answers").isNotNull()
    wrong = F.array_compact(F.array(
        F.when(~is_call, "no call"), F.when(is_call & ~is_answered, "no result"), F.when(F.col("times") > 1, "repeated call"),
        F.when(F.col("answers") > 1, "repeated result"), F.when(is_call & F.col("level").isNull(), "circular needs"),
    ))
    errors = F.when(is_call, F.array_sort(F.concat(wrong, argument_errors(F.coalesce("name", F.lit("")), F.coalesce("arguments", F.lit("")), schemas)))).otherwise(wrong)
    told = both.withColumn("errors", errors).withColumn("_arguments", F.when(is_call, F.coalesce(canonical(F.col("arguments")), json_text(F.col("arguments")))).otherwise("null"))
    record = F.concat(
        F.lit('{"arguments":'), "_arguments", F.lit(',"call_id":'), json_text(F.col("call_id")), F.lit(',"errors":'), F.to_json("errors"),
        F.lit(',"level":'), F.coalesce(F.col("level").cast("string"), F.lit("null")), F.lit(',"name":'), json_text(F.col("name")),
        F.lit(',"needs":'), F.coalesce(F.to_json(F.array_sort("needs")), F.lit("[]")), F.lit(',"result":'), json_text(F.col("content")), F.lit("}"),
    )
    return told.select("conv_id", "call_id", "position", "level", "name", "errors", F.size("errors").cast("long").alias("n_errors"), is_answered.alias("answered"), record.alias("record"), F.when(is_call, "call").otherwise("result").alias("kind"))


def plain(rows: DataFrame, call_id: Column, position: Column, name: Column, record: Column, kind: Column) -> DataFrame:
    """Rows in the columns of `linked` that are neither a linked call nor a result without one."""
    none = F.array().cast("array<string>")
    return rows.select("conv_id", call_id.alias("call_id"), position.alias("position"), F.lit(None).cast("int").alias("level"), name.alias("name"), none.alias("errors"), F.lit(0).cast("long").alias("n_errors"), F.lit(False).alias("answered"), record.alias("record"), kind.alias("kind"))


def repeats(calls: DataFrame, results: DataFrame) -> DataFrame:
    """A row, in the columns of `linked`, for each different call and result that does not count as another one has its identifier.

    kind is `repeated call` or `repeated result`, the record holds the content. Exact copies of what counts hold nothing
    else and give no row. Rows without conv_id or call_id give none.
    """
    out = None
    for rows, kind, columns in ((calls, "repeated call", ["name", "arguments", "needs"]), (results, "repeated result", ["content"])):
        own = rows.where("conv_id is not null and call_id is not null")
        # only identifiers are shuffled to find the repeated ones, which are a table of their own whose size Spark knows
        often = own.groupBy(F.col("conv_id").alias("often_conv"), F.col("call_id").alias("often_id")).agg(F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
        own = own.join(stored(often, "repeated"), (F.col("conv_id") == F.col("often_conv")) & (F.col("call_id") == F.col("often_id")), "left_semi")
        own = own.groupBy("conv_id", "call_id", F.struct(F.coalesce("position", F.lit(2**62)).alias("p"), "position", *columns).alias("x")).agg(F.count(F.lit(1)).alias("times"))
        first = own.groupBy(F.col("conv_id").alias("c"), F.col("call_id").alias("k")).agg(F.min("x").alias("first"))
        own = own.join(first, (F.col("conv_id") == F.col("c")) & (F.col("call_id") == F.col("k"))).where(~F.col("x").eqNullSafe(F.col("first")))
        head = F.concat(F.lit('{"arguments":'), F.coalesce(canonical(F.col("x.arguments")), json_text(F.col("x.arguments")))) if "arguments" in columns else F.concat(F.lit('{"content":'), json_text(F.col("x.content")))
        record = F.concat(head, F.lit(',"call_id":'), json_text(F.col("call_id")), F.lit("}"))
        name = F.col("x.name") if "name" in columns else F.lit(None).cast("string")
        told = plain(own, F.col("call_id"), F.col("x.position"), name, record, F.lit(kind))
        out = told if out is None else out.unionByName(told)
    return out


def spoken(conversations: DataFrame) -> Column:
    """Whether a turn is one of a user or an assistant at a known place, and so a call or a result."""
    return F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()


def formatted(conversations: DataFrame) -> DataFrame:
    """Every turn of the conversations: as a call, as its result, or as a row of kind `turn` with role and content.

    The last are the turns of the system and of other or no roles, and those without conv_id or turn. An empty table gives an
    empty result; further columns are not read.
    """
    calls, results = calls_of(conversations.where(spoken(conversations))), results_of(conversations.where(spoken(conversations)))
    record = F.concat(F.lit('{"content":'), json_text(F.col("text")), F.lit(',"role":'), json_text(F.col("role")), F.lit("}"))
    none = F.lit(None).cast("string")
    others = plain(conversations.where(~spoken(conversations)), none, F.col("turn"), none, record, F.lit("turn"))
    return linked(calls, results).unionByName(repeats(calls, results)).unionByName(others)


def calls_of(conversations: DataFrame) -> DataFrame:
    """Each user turn as a call; short ones look something up, long ones ask for a summary, and each needs the turn before the last."""
    text = F.coalesce("text", F.lit(""))
    long = F.length(text) >= 400
    many = F.length(text).cast("int")
    look = F.to_json(F.struct(text.alias("query"), F.pmod(many, F.lit(7)).alias("limit")))
    summary = F.to_json(F.struct(text.alias("text"), F.when(F.pmod(many, F.lit(5)) > 0, F.pmod(many, F.lit(5))).alias("sentences")))
    return conversations.where("role = 'user'").select(
        "conv_id", F.concat_ws("-", "conv_id", "turn").alias("call_id"), F.col("turn").alias("position"),
        F.when(long, "summarise").otherwise("lookup").alias("name"), F.when(long, summary).otherwise(look).alias("arguments"),
        F.array(F.concat_ws("-", F.col("conv_id"), F.col("turn") - 2)).alias("needs"),
    )


def results_of(conversations: DataFrame) -> DataFrame:
    """Each assistant turn as the result of the call in the turn before it."""
    return conversations.where("role = 'assistant'").select("conv_id", F.concat_ws("-", F.col("conv_id"), F.col("turn") - 1).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content"))


ORACLE = r"""
WITH RECURSIVE c AS (
    SELECT conv_id, conv_id || '-' || turn AS call_id, turn AS position, text, length(text) AS n,
        CASE WHEN length(text) >= 400 THEN 'summarise' ELSE 'lookup' END AS name, conv_id || '-' || (turn - 2) AS need
    FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM conversations WHERE role = 'user')),
r AS (SELECT conv_id, conv_id || '-' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'assistant'),
l AS (
    SELECT call_id, 0 AS level FROM c WHERE need NOT IN (SELECT call_id FROM c)
    UNION ALL SELECT c.call_id, l.level + 1 FROM c JOIN l ON c.need = l.call_id),
b AS (
    SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.position, l.level, c.name, c.need, c.text, c.n, r.content,
        c.call_id IS NOT NULL AS is_call, r.call_id IS NOT NULL AS answered
    FROM c FULL JOIN r ON c.call_id = r.call_id LEFT JOIN l ON l.call_id = c.call_id),
e AS (
    SELECT *, CASE WHEN NOT is_call THEN ['no call']
        ELSE list_concat(CASE WHEN name = 'summarise' AND n % 5 = 0 THEN ['missing sentences'] ELSE CAST([] AS VARCHAR[]) END,
            CASE WHEN NOT answered THEN ['no result'] ELSE CAST([] AS VARCHAR[]) END) END AS errors,
        CASE WHEN NOT is_call THEN 'null'
            WHEN name = 'lookup' THEN '{"limit":' || (n % 7) || ',"query":' || CAST(to_json(text) AS VARCHAR) || '}'
            WHEN n % 5 > 0 THEN '{"sentences":' || (n % 5) || ',"text":' || CAST(to_json(text) AS VARCHAR) || '}'
            ELSE '{"text":' || CAST(to_json(text) AS VARCHAR) || '}' END AS arguments
    FROM b)
SELECT conv_id, call_id, position, CAST(level AS INTEGER) AS level, name, errors, CAST(len(errors) AS BIGINT) AS n_errors, answered,
    '{"arguments":' || arguments || ',"call_id":' || CAST(to_json(call_id) AS VARCHAR) || ',"errors":' || CAST(to_json(errors) AS VARCHAR) || ',"level":' || coalesce(CAST(level AS VARCHAR), 'null')
    || ',"name":' || coalesce(CAST(to_json(name) AS VARCHAR), 'null') || ',"needs":' || CASE WHEN is_call THEN CAST(to_json([need]) AS VARCHAR) ELSE '[]' END
    || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS record, CASE WHEN is_call THEN 'call' ELSE 'result' END AS kind
FROM e
UNION ALL SELECT conv_id, NULL, turn, NULL, NULL, CAST([] AS VARCHAR[]), 0, false,
    '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}', 'turn'
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""
