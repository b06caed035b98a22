"""Tool calls of conversations: linked to results, ordered, validated, serialised.

Calls and results meet by identifier in a hash join. A call may name the call
whose result it builds on; its depth in that chain, found by pointer doubling,
is a topological order. Arguments are held against the tool's fields, and every
call becomes one canonical JSON object: keys sorted, no spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imagora.llm.common import small, stage

ROUNDS = 40

# fixed values: field types and the variant types they admit
TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"],
         "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"], "null": ["VOID"]}


def canonical(json: Column) -> Column:
    """The JSON text with sorted keys and no spaces; null if it is not JSON."""
    return F.to_json(F.try_parse_json(json))


def argument_types(arguments: Column) -> Column:
    """map of field name to variant type; null if the arguments are not an object."""
    is_object = F.schema_of_variant(F.try_parse_json(arguments)).startswith("OBJECT")
    parsed = F.from_json(F.when(is_object, arguments), "map<string, variant>")
    return F.transform_values(parsed, lambda _, v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0))


def violations(types: Column, fields: Column) -> Column:
    """Texts of what is wrong, sorted; empty if nothing is.

    ``fields``: array of (field, type, required), null for an unknown tool.
    """
    allowed = F.create_map(*[x for k, v in TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    missing = F.transform(
        F.filter(fields, lambda f: f["required"] & ~F.map_contains_key(types, f["field"])),
        lambda f: F.concat(F.lit("missing "), f["field"]))
    wrong = F.transform(
        F.filter(fields, lambda f: F.map_contains_key(types, f["field"]) & ~F.coalesce(
            F.array_contains(F.element_at(allowed, f["type"]), F.element_at(types, f["field"])), F.lit(False))),
        lambda f: F.concat(F.lit("not "), f["type"], F.lit(": "), f["field"]))
    extra = F.transform(
        F.filter(F.map_keys(types), lambda k: ~F.exists(fields, lambda f: f["field"] == k)),
        lambda k: F.concat(F.lit("unknown "), k))
    return F.when(fields.isNull(), F.array(F.lit("no such tool"))) \
        .when(types.isNull(), F.array(F.lit("arguments are not an object"))) \
        .otherwise(F.array_sort(F.concat(missing, wrong, extra)))


def depths(calls: DataFrame) -> DataFrame:
    """(call_id, level): 0 without a known parent, else one more than the parent's; null in a cycle.

    ``calls``: distinct (call_id, parent_id). Every round doubles the distance that
    each call looks up, so a chain of n calls takes log n rounds, each a written
    table.
    """
    known = calls.select(F.col("call_id").alias("parent_id"))
    linked = calls.join(known, "parent_id", "left_semi").select("call_id", "parent_id")
    state = stage(calls.select("call_id").join(linked, "call_id", "left").select(
        "call_id", F.col("parent_id").alias("up"),
        F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("bigint").alias("level")), "call-depths")
    for _ in range(ROUNDS):
        if state.filter("up IS NOT NULL").limit(1).count() == 0:
            break
        above = state.select(F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        state = stage(state.join(above, "up", "left").select(
            "call_id", F.col("next").alias("up"),
            (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "call-depths")
    return state.select("call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """(call_id, tool, level, n_results, valid, errors, json) for every call.

    ``calls``: call_id, parent_id, tool, arguments (JSON text); ``results``: call_id,
    content; ``schemas``: tool, field, type, required. Calls without id, and results
    without a call, are left out. Of several calls with one id the first by (tool,
    arguments, parent) stands. Of several results the smallest content is the result
    and ``n_results`` counts them; the JSON says null for none. A parent that is
    unknown, null or the call itself is none; calls in a cycle have no level and
    the error "cycle". Arguments that are not JSON are kept as a text. Extra columns
    are not read. Empty tables give an empty result.
    """
    first = F.min(F.struct("tool", "arguments", "parent_id")).alias("c")
    one = calls.filter("call_id IS NOT NULL").groupBy("call_id").agg(first).select("call_id", "c.*")
    one = stage(one, "calls")
    levels = depths(one.select("call_id", F.when(F.col("parent_id") != F.col("call_id"), F.col("parent_id"))
                               .alias("parent_id")))
    said = results.filter("call_id IS NOT NULL").groupBy("call_id").agg(
        F.count(F.lit(1)).alias("n_results"), F.min("content").alias("content"))
    fields = schemas.groupBy("tool").agg(F.sort_array(F.collect_set(
        F.struct("field", "type", "required"))).alias("fields"))
    rows = one.join(levels, "call_id").join(said, "call_id", "left").join(small(fields), "tool", "left")
    wrong = violations(argument_types(F.col("arguments")), F.col("fields"))
    rows = rows.withColumn("errors", F.concat(F.when(F.col("level").isNull(), F.array(F.lit("cycle"))).otherwise(
        F.array().cast("array<string>")), wrong))
    arguments = F.coalesce(F.try_parse_json("arguments"), F.col("arguments").cast("variant"))
    record = F.to_json(F.struct(
        arguments.alias("arguments"), F.col("call_id").alias("id"), F.col("level").alias("level"),
        F.col("tool").alias("name"), F.col("content").alias("result")), {"ignoreNullFields": "false"})
    return rows.select(
        "call_id", "tool", "level", F.coalesce("n_results", F.lit(0)).cast("bigint").alias("n_results"),
        (F.size("errors") == 0).alias("valid"), "errors", record.alias("json"))


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas out of plain conversations.

    Every user turn calls the tool ``ask`` with its text, and every turn with a
    system role calls ``instruct``; the turn after it is the result. A call builds
    on the user turn two turns before it. Rows without conversation or turn number
    have no id and are left out.
    """
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    known = turns.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    at = lambda n: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - n).cast("string"))
    calls = known.filter("role IN ('user', 'system')").select(
        key.alias("call_id"), at(2).alias("parent_id"),
        F.when(F.col("role") == "user", "ask").otherwise("instruct").alias("tool"),
        F.to_json(F.struct(F.col("turn"), F.col("text"), F.coalesce(F.char_length("text"), F.lit(0)).alias("n_chars"))
                  ).alias("arguments"))
    results = known.filter("role = 'assistant'").select(at(1).alias("call_id"), F.col("text").alias("content"))
    spark = turns.sparkSession
    schemas = spark.createDataFrame(
        [("ask", "text", "string", True), ("ask", "turn", "integer", True), ("ask", "n_chars", "integer", False),
         ("instruct", "text", "string", True), ("instruct", "turn", "integer", True)],
        "tool string, field string, type string, required boolean")
    return calls, results, schemas
