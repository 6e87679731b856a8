"""Tool calls of conversations: linked with results, ordered, checked and written as canonical JSON.

Calls and results meet in a hash join on the call's identifier. A call may wait
for another (``after``); its depth in that forest, found by pointer doubling in
a logarithmic number of rounds, is its topological position. The arguments are
compared field by field with the tool's schema.

Defined cases: of calls that repeat an identifier the least in (conversation,
name, arguments, after) counts, ``n_calls`` tells how many there were; of several
results the least text is kept and ``n_results`` counts them; calls without
identifier are left out; a missing or unknown ``after`` makes a root; calls on
or behind a cycle have a null depth; arguments that are null, no JSON or no
object are invalid; a tool without schema is ``unknown tool``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.session import settle


def depths(calls: DataFrame) -> DataFrame:
    """(call_id, depth): number of calls a call waits for, directly or not; null on and behind cycles."""
    parents = calls.select(F.col("call_id").alias("up"))
    state = settle(
        calls.select("call_id", F.col("after").alias("up"))
        .join(parents.withColumn("known", F.lit(1)), "up", "left")
        .select("call_id", F.when(F.col("known") == 1, F.col("up")).alias("up"))
        .withColumn("depth", F.col("up").isNotNull().cast("long"))
    )
    rounds = max(1, state.count()).bit_length()  # more doublings than the longest chain needs
    for _ in range(rounds):
        if state.filter("up is not null").isEmpty():
            break
        above = state.select(F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        state = settle(
            state.join(above, "up", "left").select(
                "call_id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
            )
        )
    return state.select("call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def broken_rules(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(call_id, errors): what the arguments break. schemas: name, field, type, required, low, high."""
    spark = calls.sparkSession
    given = spark.sql(
        "select call_id, name, t.key as field, schema_of_variant(t.value) as kind, "
        "try_variant_get(t.value, '$', 'double') as number "
        "from {calls}, lateral variant_explode(try_parse_json(arguments)) as t where t.key is not null",
        calls=calls,
    )
    rules = schemas.select("name", "field", "type", "required", "low", "high")
    wanted = calls.select("call_id", "name").join(rules, "name")
    both = wanted.join(given.select("call_id", "field", "kind", "number"), ["call_id", "field"], "full")
    fits = (
        F.when(F.col("type") == "integer", F.col("kind") == "BIGINT")
        .when(F.col("type") == "number", F.col("kind").rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"))
        .when(F.col("type") == "string", F.col("kind") == "STRING")
        .when(F.col("type") == "boolean", F.col("kind") == "BOOLEAN")
        .otherwise(F.lit(True))
    )
    fault = (
        F.when(F.col("type").isNull(), F.lit("unknown field"))
        .when(F.col("kind").isNull() | (F.col("kind") == "VOID"), F.when(F.col("required"), F.lit("missing")))
        .when(~fits, F.lit("wrong type"))
        .when((F.col("number") < F.col("low")) | (F.col("number") > F.col("high")), F.lit("out of range"))
    )
    named = both.select("call_id", F.concat("field", F.lit(": "), fault).alias("fault"))
    return named.groupBy("call_id").agg(F.sort_array(F.collect_list("fault")).alias("errors"))


def linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call. calls: conv_id, call_id, name, arguments, after; results: call_id, content."""
    one = settle(
        calls.filter("call_id is not null")
        .groupBy("call_id")
        .agg(F.min(F.struct("conv_id", "name", "arguments", "after")).alias("c"), F.count(F.lit(1)).alias("n_calls"))
        .select("call_id", "c.*", "n_calls")
    )
    answers = results.groupBy("call_id").agg(F.min("content").alias("content"), F.count(F.lit(1)).alias("n_results"))
    tools = schemas.select("name").distinct().withColumn("tool", F.lit(True))
    rows = (
        one.join(answers, "call_id", "left")
        .join(depths(one), "call_id", "left")
        .join(broken_rules(one, schemas), "call_id", "left")
        .join(tools, "name", "left")
    )
    v = F.try_parse_json("arguments")
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    errors = F.when(~is_object, F.array(F.lit("no object"))).when(
        F.col("tool").isNull(), F.array(F.lit("unknown tool"))
    ).otherwise(F.coalesce("errors", F.array().cast("array<string>")))
    rows = rows.withColumn("errors", errors).withColumn("args", F.when(is_object, v))
    # variants keep the fields of objects sorted, structs keep them as written here
    canonical = F.to_json(
        F.struct(F.col("args").alias("arguments"), F.col("call_id").alias("id"), "name", F.col("content").alias("result"))
    )
    return rows.select(
        "conv_id", "call_id", "name", "depth", F.coalesce("n_results", F.lit(0)).alias("n_results"), "n_calls",
        (F.size("errors") == 0).alias("valid"), F.array_join("errors", "; ").alias("errors"),
        canonical.alias("canonical"),
    )
