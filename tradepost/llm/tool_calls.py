"""Tool calls of chats: linked to their results, ordered, validated and written as canonical JSON.

Calls carry an identifier, results name the identifier they answer, and a call may list calls it depends on. Calls
and results meet in a hash join. The order is topological: a call's ``level`` is the length of the longest path
of dependencies below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, column

#: (tool, field, type, required, least, most): types are string, integer, number, boolean, object and array; least
#: and most bound a number's value, or the length of a string.
SCHEMA = "tool string, field string, type string, required boolean, least double, most double"


#: The columns that ``tool_calls`` adds.
NEW = ("result", "n_results", "linked", "level", "problems", "valid", "json")
_CALL = "_tp_call"


def _identity(df: DataFrame, scope: str | None) -> Column:
    """What calls and results are matched by: the identifier within its scope, null without an identifier. Rows without a scope
    are a scope of their own."""
    within = column(df, scope).cast("string") if scope else F.lit(None).cast("string")
    return F.when(df["call_id"].isNotNull(), F.struct(within.alias("scope"), df["call_id"].cast("string").alias("id")))


def link(calls: DataFrame, results: DataFrame, scope: str | None = None) -> DataFrame:
    """``calls`` (call_id, ...) plus ``result``, ``n_results`` and ``linked``: ok, missing or repeated. Columns of ``calls`` that have
    these names are replaced.

    ``scope`` names a column of both tables, such as the conversation, within which identifiers count. Of several results for one
    identifier the smallest text counts, so that the choice does not depend on order. Results are reduced to one row per
    identifier first, so an identifier that is answered very often is combined before the shuffle. A null identifier is never
    linked.
    """
    named = results.select(_identity(results, scope).alias(_CALL), "content").filter(F.col(_CALL).isNotNull())
    answers = named.groupBy(_CALL).agg(F.min("content").alias("result"), F.count(F.lit(1)).alias("n_results"))
    n = F.coalesce("n_results", F.lit(0)).cast("bigint")
    state = F.when(n == 0, "missing").when(n == 1, "ok").otherwise("repeated")
    own = calls.withColumn(_CALL, _identity(calls, scope)).drop("result", "n_results", "linked")
    return own.join(answers, _CALL, "left").drop(_CALL).withColumn("n_results", n).withColumn("linked", state)


def orphans(results: DataFrame, calls: DataFrame, scope: str | None = None) -> DataFrame:
    """Results whose identifier no call of their scope has."""
    known = calls.select(_identity(calls, scope).alias(_CALL)).distinct()
    return results.withColumn(_CALL, _identity(results, scope)).join(known, _CALL, "left_anti").drop(_CALL)


#: Rounds in which levels may settle before shortcuts are made anew.
ROUNDS = 8


def levels(edges: DataFrame, limit: int, temp: Scratch) -> DataFrame:
    """(call, level) for every call that occurs in edges (call, needs); levels of ``limit``, the number of calls, or more can't be. A
    call on a circle, or behind one, gets null.

    Every call points to the dependency that has the highest level so far, and shortcuts of 2, 4, 8, ... steps along these pointers
    are paths too, so the longest-path rule may use them; a chain of n calls then settles in about log n rounds. What has not settled
    after some rounds gets shortcuts by the levels found until then: on a circle levels outgrow all others, the pointers go around
    it, and the shortcuts reach ``limit`` at once.
    """
    edges = temp.cut(edges.distinct())
    nodes = edges.select("call").union(edges.select(F.col("needs").alias("call"))).distinct()
    now, rounds = temp.cut(nodes.withColumn("level", F.lit(0).cast("bigint"))), 0
    while True:
        below = now.select(F.col("call").alias("needs"), F.col("level").alias("low"))
        if rounds % ROUNDS == 0:
            steps = temp.cut(edges.withColumn("w", F.lit(1).cast("bigint")).unionByName(_shortcuts(edges, below, limit, temp)))
        found = steps.join(below, "needs").groupBy("call").agg(F.max(F.col("low") + F.col("w")).alias("new"))
        raised = F.least(F.greatest("level", F.coalesce("new", F.lit(0))), F.lit(limit))
        step = temp.cut(now.join(found, "call", "left").select("call", raised.alias("to"), "level"))
        if step.filter("to > level").isEmpty():
            return now.select("call", F.when(F.col("level") < limit, F.col("level")).alias("level"))
        now, rounds = step.select("call", F.col("to").alias("level")), rounds + 1


def _shortcuts(edges: DataFrame, below: DataFrame, limit: int, temp: Scratch) -> DataFrame:
    """(call, needs, w): where 2, 4, 8, ... steps lead, each to the dependency of the highest level."""
    highest = F.max(F.struct("low", "needs")).alias("top")
    jump = temp.cut(edges.join(below, "needs").groupBy("call").agg(highest).select("call", "top.needs"))
    steps, length = jump.limit(0).withColumn("w", F.lit(1).cast("bigint")), 1
    while length < limit:
        onward = jump.select(F.col("call").alias("needs"), F.col("needs").alias("far"))
        jump = temp.cut(jump.join(onward, "needs").select("call", F.col("far").alias("needs")))
        if jump.isEmpty():
            break
        length *= 2
        steps = steps.unionByName(jump.withColumn("w", F.lit(length).cast("bigint")))
    return steps


def canonical(json: Column) -> Column:
    """JSON with sorted keys and no blanks; null if the text is not JSON or repeats a key."""
    return F.to_json(F.try_parse_json(json))


def problems(arguments: Column, fields: Column) -> Column:
    """What is wrong with JSON ``arguments`` by ``fields``, an array of (field, type, required, least, most) or null for a
    tool without a schema: sorted texts, empty when all is right. Fields the schema does not name are wrong too."""
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    given = F.when(is_object, parsed).cast("map<string,variant>")

    def judged(f):
        value = F.element_at(given, f["field"])
        kind = F.schema_of_variant(value)
        whole = kind.isin("TINYINT", "SMALLINT", "INT", "BIGINT")
        a_number = whole | kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
        typed = (
            F.when(f["type"] == "string", kind == "STRING")
            .when(f["type"] == "integer", whole)
            .when(f["type"] == "number", a_number)
            .when(f["type"] == "boolean", kind == "BOOLEAN")
            .when(f["type"] == "object", kind.startswith("OBJECT"))
            .when(f["type"] == "array", kind.startswith("ARRAY"))
            .otherwise(False)
        )
        length = F.length(value.cast("string")).cast("double")
        extent = F.when(kind == "STRING", length).when(a_number, value.cast("double"))
        outside = F.coalesce(extent < f["least"], F.lit(False)) | F.coalesce(extent > f["most"], F.lit(False))
        return (
            F.when(value.isNull() | (kind == "VOID"), F.when(f["required"], F.concat(f["field"], F.lit(": missing"))))
            .when(~typed, F.concat(f["field"], F.lit(": not "), f["type"]))
            .when(outside, F.concat(f["field"], F.lit(": out of range")))
        )

    names = F.transform(fields, lambda f: f["field"])
    extra = F.transform(F.array_except(F.map_keys(given), names), lambda k: F.concat(k, F.lit(": unknown")))
    all_of = F.array_sort(F.filter(F.concat(F.transform(fields, judged), extra), lambda t: t.isNotNull()))
    return (
        F.when(fields.isNull(), F.array(F.lit("no such tool")))
        .when(~is_object, F.array(F.lit("arguments are no object")))
        .otherwise(all_of)
    )


def tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame, scope: str | None = None) -> DataFrame:
    """One row per row of ``calls`` (call_id, tool, arguments, needs): its columns and result, n_results, linked, level,
    problems, valid, and json, the record of the call in canonical form (null if the arguments are no JSON).

    ``scope`` names a column of calls and results, such as the conversation: identifiers are matched, and dependencies looked for,
    within it, so chats may use the same identifiers. Without it identifiers count in the whole table.

    ``needs`` is an array of identifiers; unknown ones are ignored. ``level`` is null on or behind a circle of
    dependencies, a call that needs itself included. Calls with a null identifier have level 0 and no result. Repeated
    rows are kept and have one level. Of equal results the text is the same, so ties do not matter. Texts of any length are kept
    whole. Other columns are kept; one that has the name of a new column (``NEW``) is replaced. Empty tables give no rows, no
    results, or no schemas.
    """
    spark = calls.sparkSession
    keep = Scratch(spark, "tool-calls")
    calls = calls.drop(*NEW)
    calls = keep.cut(calls.withColumn(_CALL, _identity(calls, scope)))
    with Scratch(spark, "call-levels") as temp:
        known = temp.cut(calls.select(F.col(_CALL).alias("needs")).filter("needs is not null").distinct())
        wanted = calls.select(F.col(_CALL).alias("call"), F.explode("needs").alias("id")).filter("call is not null and id is not null")
        wanted = wanted.select("call", F.struct(F.col("call.scope").alias("scope"), F.col("id").cast("string").alias("id")).alias("needs")).distinct()
        found = levels(wanted.join(known, "needs", "left_semi").select("call", "needs"), known.count() + 1, temp)
        level = keep.cut(found.select(F.col("call").alias(_CALL), F.col("level").alias("_tp_level"), F.lit(True).alias("_tp_known")))
    fields = schemas.groupBy("tool").agg(
        F.array_sort(F.collect_list(F.struct("field", "type", "required", "least", "most"))).alias("_tp_fields")
    )
    at = F.when(F.col("_tp_known"), F.col("_tp_level")).otherwise(F.lit(0).cast("bigint"))
    ordered = calls.join(level, _CALL, "left").withColumn("level", at).drop(_CALL, "_tp_level", "_tp_known")
    checked = link(ordered, results, scope).join(fields, "tool", "left")
    wrong = problems(F.col("arguments"), F.col("_tp_fields"))
    parsed = F.try_parse_json(F.col("arguments"))
    # Fields by name; to_json sorts the keys inside the arguments.
    record = F.struct(
        parsed.alias("arguments"), F.col("call_id").alias("id"), F.col("level"), F.col("tool").alias("name"), F.col("result")
    )
    return (
        checked.withColumn("problems", wrong)
        .withColumn("valid", F.size("problems") == 0)
        .withColumn("json", F.when(parsed.isNotNull(), F.to_json(record, {"ignoreNullFields": "false"})))
        .drop("_tp_fields")
    )
