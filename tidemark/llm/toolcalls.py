"""Tool calls: link calls with results, order them, validate arguments, serialise canonical JSON.

DataFrame and SQL functions only. Inputs:

  calls    conv_id, call_id, turn, name, arguments (JSON text), depends_on (array of call_ids)
  results  conv_id, call_id, turn, content
  schemas  name, field, kind (integer, number, string, boolean, array, object), required, minimum, maximum,
           choices (array of strings): a row for each argument of each tool

Identifiers are linked within a conversation by a hash join. Repeated rows of an identifier are reduced to
the first by turn (then by content) before the join and counted, so no identifier is hot there.

The order key of a call is (order_turn, order_hops). Without a reference to a later call it is (turn, 0).
A call that refers to a later one, and those that refer to it, get the later turn and one hop more, so
that sorting by the key and call_id is a topological order. Only calls that move take part in further
rounds, each a hash join on identifiers; the number of rounds is that of the longest chain of moved calls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

_KINDS = {
    "integer": "(t = 'BIGINT')",
    "number": "(t = 'BIGINT' OR t = 'DOUBLE' OR t = 'FLOAT' OR startswith(t, 'DECIMAL'))",
    "string": "(t = 'STRING')",
    "boolean": "(t = 'BOOLEAN')",
    "array": "startswith(t, 'ARRAY')",
    "object": "startswith(t, 'OBJECT')",
}


def first_by_id(rows: DataFrame, first: str, *rest: str) -> DataFrame:
    """One row of each (conv_id, call_id), the least by (first, rest), n_rows, and whether rows differ in rest. Null identifiers go."""
    least, said = F.min(F.struct(first, *rest)).alias("least"), F.struct(*rest)
    return (
        rows.where("conv_id IS NOT NULL AND call_id IS NOT NULL")
        .groupBy("conv_id", "call_id")
        .agg(least, F.count("*").alias("n_rows"), (F.min(said) != F.max(said)).alias("differ"))
        .select("conv_id", "call_id", *[F.col(f"least.{c}").alias(c) for c in (first, *rest)], "n_rows", "differ")
    )


def argument_errors(fields: str = "fields", arguments: str = "arguments") -> Column:
    """Sorted messages on a JSON text against an array of field rules; a null rule array is an unknown tool."""
    right = reduce(lambda a, b: f"{a} WHEN f.kind = '{b[0]}' THEN {b[1]}", _KINDS.items(), "CASE") + " ELSE true END"
    typed = right.replace("t = ", "schema_of_variant(args[f.field]) = ").replace("startswith(t,", "startswith(schema_of_variant(args[f.field]),")
    number = "try_variant_get(args[f.field], '$', 'double')"
    text = "try_variant_get(args[f.field], '$', 'string')"
    rule = f"""
      CASE WHEN NOT map_contains_key(args, f.field) THEN CASE WHEN f.required THEN concat(f.field, ': missing') END
           WHEN NOT ({typed}) THEN concat(f.field, ': expected ', f.kind)
           WHEN f.kind IN ('integer', 'number') AND ({number} < f.minimum OR {number} > f.maximum) THEN concat(f.field, ': out of range')
           WHEN f.kind = 'string' AND (char_length({text}) < f.minimum OR char_length({text}) > f.maximum) THEN concat(f.field, ': bad length')
           WHEN f.choices IS NOT NULL AND NOT array_contains(f.choices, {text}) THEN concat(f.field, ': not a choice')
      END"""
    return F.expr(f"""
      CASE WHEN {fields} IS NULL THEN array('unknown tool')
           WHEN NOT coalesce(startswith(schema_of_variant(try_parse_json({arguments})), 'OBJECT'), false) THEN array('arguments: not an object')
           ELSE aggregate(array(try_cast(try_parse_json({arguments}) AS map<string, variant>)), cast(array() AS array<string>),
             (unused, args) -> array_sort(array_union(
               filter(transform({fields}, f -> {rule}), e -> e IS NOT NULL),
               transform(array_except(map_keys(args), transform({fields}, f -> f.field)), k -> concat(k, ': unknown')))))
      END""")


def order_keys(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, order_turn, order_hops, cyclic) of the calls that move; all others keep (turn, 0).

    calls: conv_id, call_id, turn; edges: conv_id, call_id, depends (an existing call). A call whose hops
    reach the number n of its conversation's calls is in a cycle or behind one, and flagged. Rounds go on to 2 n
    hops, by when all members of a cycle have n.
    """
    value = calls.select("conv_id", "call_id", F.struct(F.col("turn").alias("order_turn"), F.lit(0).cast("long").alias("order_hops")).alias("v"))
    value = value.withColumn("cyclic", F.lit(False))
    frontier, moved = value, []
    size = calls.groupBy("conv_id").agg(F.count("*").alias("n_calls"))
    while True:
        raised = F.when(F.col("d.order_turn").isNotNull(), F.struct(F.col("d.order_turn").alias("order_turn"), (F.col("d.order_hops") + 1).alias("order_hops")))
        offered = (
            edges.join(frontier.select("conv_id", F.col("call_id").alias("depends"), F.col("v").alias("d")), ["conv_id", "depends"])
            .groupBy("conv_id", "call_id")
            .agg(F.max(raised).alias("offer"))
        )
        known = reduce(DataFrame.unionByName, [value, *moved]).groupBy("conv_id", "call_id").agg(F.max("v").alias("v"))
        now = staged(
            offered.join(known, ["conv_id", "call_id"])
            .where(F.col("v").isNull() | (F.col("offer") > F.col("v")))
            .join(size, "conv_id")
            .select("conv_id", "call_id", F.col("offer").alias("v"), (F.col("offer.order_hops") >= F.col("n_calls")).alias("cyclic"), (F.col("offer.order_hops") >= 2 * F.col("n_calls")).alias("over")),
            "moved",
        )
        if now.isEmpty():
            break
        moved.append(now.select("conv_id", "call_id", "v", "cyclic"))
        moved = moved if len(moved) < 8 else [staged(_latest(reduce(DataFrame.unionByName, moved)), "moved-all")]
        frontier = now.where("NOT over").select("conv_id", "call_id", "v")
    if not moved:
        return value.where("false").select("conv_id", "call_id", "v.*", "cyclic")
    return _latest(reduce(DataFrame.unionByName, moved)).select("conv_id", "call_id", "v.*", "cyclic")


def _latest(moved: DataFrame) -> DataFrame:
    return moved.groupBy("conv_id", "call_id").agg(F.max("v").alias("v"), F.max("cyclic").alias("cyclic"))


def linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per identifier of calls and results:

    conv_id, call_id, turn, order_turn, order_hops, name, status, errors array<string>, n_calls, n_results, json.

    status: ok, invalid (errors are not empty), no_result, or orphan_result (no call; order_turn is the
    result's turn). errors are sorted: argument errors, dependencies that do not exist, `result before call`,
    `cycle` (on every member of a cycle, and calls of earlier turns that depend on one), `several calls of one id` and `several results
    of one id` (rows of an identifier that differ in more than their turn; the first is shown). json is canonical: keys sorted, no spaces, arguments as parsed (or the raw text if they are no
    JSON). Null identifiers go; null arguments are no object; null turns sort first. Repeated rows and extra
    columns do no harm. Empty tables give no rows.
    """
    first = staged(
        first_by_id(
            calls.select("conv_id", "call_id", F.col("turn").cast("long").alias("turn"), "name", "arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on")),
            "turn", "name", "arguments", "depends_on",
        ).withColumnsRenamed({"n_rows": "n_calls", "differ": "calls_differ"}),
        "calls",
    )
    answers = first_by_id(results.select("conv_id", "call_id", F.col("turn").cast("long").alias("turn"), "content"), "turn", "content").select(
        "conv_id", "call_id", F.col("turn").alias("result_turn"), F.col("content").alias("result"), F.col("n_rows").alias("n_results"), F.col("differ").alias("results_differ")
    )
    wanted = first.select("conv_id", "call_id", "turn", F.explode(F.array_distinct("depends_on")).alias("depends"))
    there = first.select("conv_id", F.col("call_id").alias("depends"), F.col("turn").alias("depends_turn"), F.lit(True).alias("there"))
    edges = staged(wanted.join(there.hint("shuffle_hash"), ["conv_id", "depends"], "left"), "edges")
    lost = edges.where("there IS NULL").groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set(F.concat("depends", F.lit(": no such call")))).alias("lost"))
    known = edges.where("there").select("conv_id", "call_id", "depends")
    if edges.where("there AND NOT coalesce(depends_turn < turn, false)").isEmpty():
        keys = first.where("false").select("conv_id", "call_id", F.lit(None).cast("long").alias("order_turn"), F.lit(None).cast("long").alias("order_hops"), F.lit(None).cast("boolean").alias("cyclic"))
    else:
        keys = order_keys(first.select("conv_id", "call_id", "turn"), known)
    rules = (
        schemas.where("name IS NOT NULL AND field IS NOT NULL")
        .groupBy("name")
        .agg(F.array_sort(F.collect_set(F.struct("field", "kind", F.coalesce("required", F.lit(False)).alias("required"), F.col("minimum").cast("double").alias("minimum"), F.col("maximum").cast("double").alias("maximum"), "choices"))).alias("fields"))
    )
    joined = (
        first.join(answers.hint("shuffle_hash"), ["conv_id", "call_id"], "full")
        .join(keys, ["conv_id", "call_id"], "left")
        .join(lost, ["conv_id", "call_id"], "left")
        .join(rules, "name", "left")
    )
    none = F.array().cast("array<string>")
    is_call = F.col("n_calls").isNotNull()
    errors = F.array_sort(
        F.array_union(
            F.array_union(argument_errors(), F.coalesce("lost", none)),
            F.array_compact(F.array(F.when(F.col("result_turn") < F.col("turn"), F.lit("result before call")), F.when(F.col("cyclic"), F.lit("cycle")), F.when(F.col("calls_differ"), F.lit("several calls of one id")), F.when(F.col("results_differ"), F.lit("several results of one id")))),
        )
    )
    rows = joined.withColumn("errors", F.when(is_call, errors).otherwise(none)).withColumn(
        "status",
        F.when(~is_call, F.lit("orphan_result")).when(F.size("errors") > 0, F.lit("invalid")).when(F.col("n_results").isNull(), F.lit("no_result")).otherwise(F.lit("ok")),
    )
    fields = "call_id, conv_id, array_sort(array_distinct(depends_on)) AS depends_on, errors, name, result, status"
    keep_nulls = "map('ignoreNullFields', 'false')"
    json = F.expr(
        f"CASE WHEN try_parse_json(arguments) IS NOT NULL THEN to_json(struct(try_parse_json(arguments) AS arguments, {fields}), {keep_nulls}) ELSE to_json(struct(arguments, {fields}), {keep_nulls}) END"
    )
    return rows.select(
        "conv_id",
        "call_id",
        F.coalesce("turn", F.when(~is_call, F.col("result_turn"))).alias("turn"),
        F.coalesce("order_turn", "turn", F.when(~is_call, F.col("result_turn"))).alias("order_turn"),
        F.coalesce("order_hops", F.lit(0).cast("long")).alias("order_hops"),
        "name",
        "status",
        "errors",
        F.coalesce("n_calls", F.lit(0).cast("long")).alias("n_calls"),
        F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"),
        json.alias("json"),
    )


def exchanges(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """conversations (conv_id, turn, role, text) as calls, results and schemas.

    A user's turn t is the call `c<t>` of the tool `reply`, which depends on the user's turn two before; the
    assistant's turn t + 1 is its result. A system turn t is a call of `instruct`, which refers forward to the call
    of turn t + 1; any other role is a call of the tool named like the role, which no schema knows. Null turns have
    no identifier.
    """
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    turn = F.col("turn").cast("long")
    rows = conversations.select("conv_id", turn.alias("turn"), role.alias("role"), F.col("text").cast("string").alias("text"))
    own = F.concat(F.lit("c"), F.col("turn").cast("string"))
    calls = rows.where("role <> 'assistant'").select(
        "conv_id",
        own.alias("call_id"),
        "turn",
        F.when(F.col("role") == "user", F.lit("reply")).when(F.col("role") == "system", F.lit("instruct")).otherwise(F.col("role")).alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"), "turn")).alias("arguments"),
        F.when((F.col("role") == "user") & (F.col("turn") >= 2), F.array(F.concat(F.lit("c"), (F.col("turn") - 2).cast("string"))))
        .when(F.col("role") == "system", F.array(F.concat(F.lit("c"), (F.col("turn") + 1).cast("string"))))
        .otherwise(F.array().cast("array<string>"))
        .alias("depends_on"),
    )
    results = rows.where("role = 'assistant'").select("conv_id", F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("call_id"), "turn", F.col("text").alias("content"))
    schemas = conversations.sparkSession.createDataFrame(
        [(n, f, k, True, low, None, None) for n in ("reply", "instruct") for f, k, low in (("prompt", "string", 1.0), ("turn", "integer", 0.0))],
        "name string, field string, kind string, required boolean, minimum double, maximum double, choices array<string>",
    )
    return calls, results, schemas
