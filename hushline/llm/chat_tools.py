"""Tool-call linking for chat data, in DataFrame functions only.

A message is (conv_id, turn, role, text).  An assistant's text may be ``{"tool_call": {"id", "name", "arguments", "after"}}``
and a tool's text ``{"tool_result": {"id", "content"}}``; everything else is a plain message.

Linking joins calls and results by conversation and identifier.  Of several calls (or results) with one identifier the
first (smallest turn, then smallest text) counts, later ones are duplicates.  A result comes after its call, and a call
after the result (or else the call) that its ``after`` names.  Every message has one predecessor at most, so the
order is found by pointer doubling: in each round a message adds the depth of the message it points to, takes over the
larger turn and points to where that one points.  Messages are ordered by (largest turn among themselves and all they come
after, depth, turn): nothing moves unless it must.  Whatever still points somewhere after log2(n) + 1 rounds hangs on a cycle
and keeps its own turn.

Arguments are checked against a table of schemas (name, arg, type, required); types are string, integer, number,
boolean, array and object.  The output is canonical JSON: sorted keys, no spaces.

Hot conversations and identifiers are not gathered: the joins are on (conversation, identifier), which adaptive execution
splits, the first of equals is an aggregate, and positions are numbered by ranges of the whole order, which may cut a
conversation anywhere, also among messages without a turn.

Defined cases: rows equal in conv_id, turn, role and text are one message; null roles are plain messages with no role; null
turns come first; null conv_ids are a conversation of their own; texts that are no JSON objects are plain; a call without a
known schema has the error ``unknown tool``; empty tables give empty results; other columns are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushline.llm.sharding import RANGE_ROWS, laid_out, numbered
from hushline.session import stored


def parsed(messages: DataFrame) -> DataFrame:
    """Distinct messages with kind, identifier, tool name, arguments, predecessor and content."""
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").distinct()
    rows = rows.withColumn("_conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("\0")))
    json = F.when(F.ltrim("text").startswith("{"), F.try_parse_json("text"))
    rows = rows.withColumn("_json", json)
    pick = lambda path, kind="string": F.try_variant_get("_json", path, kind)
    call = (F.col("role") == "assistant") & pick("$.tool_call.id").isNotNull() & pick("$.tool_call.name").isNotNull()
    result = (F.col("role") == "tool") & pick("$.tool_result.id").isNotNull()
    kind = F.when(call, "call").when(result, "result").otherwise("message")
    out = rows.select(
        "conv_id", "_conv", "turn", "role", "text", kind.alias("kind"),
        F.when(call, pick("$.tool_call.id")).when(result, pick("$.tool_result.id")).alias("id"),
        F.when(call, pick("$.tool_call.name")).alias("name"),
        F.when(call, pick("$.tool_call.after")).alias("after"),
        F.when(call, pick("$.tool_call.arguments", "variant")).alias("arguments"),
        F.when(result, pick("$.tool_result.content", "variant")).alias("content"),
        F.xxhash64("text", "role").alias("_hash"),
    )
    return stored(out, "messages")


def nodes(rows: DataFrame) -> DataFrame:
    """One row per linked call and result: ``_conv``, ``node``, turn, text hash, and its predecessor ``up`` (null: none)."""
    linked = rows.where(F.col("id").isNotNull())
    first = linked.groupBy("_conv", "kind", "id").agg(
        F.min(F.struct("turn", "text", "_hash")).alias("_f"), F.min_by("after", F.struct("turn", "text", "_hash")).alias("after")
    )
    name = lambda kind, of: F.concat(F.lit(f"{kind}:"), F.col(of))
    base = stored(
        first.select(
            "_conv", F.concat_ws(":", "kind", "id").alias("node"), F.col("_f.turn").alias("turn"), F.col("_f._hash").alias("_hash"),
            F.when(F.col("kind") == "result", name("call", "id")).otherwise(name("result", "after")).alias("_want"),
            F.when(F.col("kind") == "call", name("call", "after")).alias("_else"),
        ),
        "nodes",
    )
    known = lambda c: base.select(F.col("_conv").alias(f"_c{c}"), F.col("node").alias(f"_n{c}"))
    found = base.join(known(1), (F.col("_conv") == F.col("_c1")) & (F.col("_want") == F.col("_n1")), "left")
    found = found.join(known(2), (F.col("_conv") == F.col("_c2")) & (F.col("_else") == F.col("_n2")), "left")
    return found.select("_conv", "node", "turn", "_hash", F.coalesce("_n1", "_n2").alias("up"))


def ordered(linked: DataFrame) -> DataFrame:
    """``linked`` with ``late`` (largest turn among a node and all it comes after), ``depth`` and ``cyclic``."""
    state = stored(linked.select("*", F.col("turn").alias("late"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth")), "order")
    total = max(2, state.count())
    finished, active = state.where(F.col("up").isNull()), state.where(F.col("up").isNotNull())
    for _ in range(math.ceil(math.log2(total)) + 1):
        if not active.limit(1).count():
            break
        # Only messages that still point somewhere take part; where they point to may be finished.
        to = finished.unionByName(active).select(
            F.col("_conv").alias("_c"), F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("late").alias("_late"), F.col("depth").alias("_depth")
        )
        joined = active.join(to, (F.col("_conv") == F.col("_c")) & (F.col("up") == F.col("_n")), "left")
        moved = stored(
            joined.select(
                "_conv", "node", "turn", "_hash", F.col("_up").alias("up"), F.greatest("late", "_late").alias("late"),
                (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
            ),
            "order",
        )
        finished, active = finished.unionByName(moved.where(F.col("up").isNull())), moved.where(F.col("up").isNotNull())
    state = finished.unionByName(active)
    loops = F.col("up").isNotNull()
    return state.select(
        "_conv", "node", "turn", "_hash", F.when(loops, F.col("turn")).otherwise(F.col("late")).alias("late"),
        F.when(loops, 0).otherwise(F.col("depth")).cast("long").alias("depth"), loops.alias("cyclic"),
    )


def kind_of(value: Column) -> Column:
    """JSON type of a variant."""
    name = F.schema_of_variant(value)
    return (
        F.when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "BIGINT", "integer")
        .when(name.startswith("DECIMAL") | name.isin("DOUBLE", "FLOAT"), "number").when(name.startswith("ARRAY"), "array")
        .when(name.startswith("OBJECT"), "object").otherwise("null")
    )


def argument_errors(arguments: Column, spec: Column) -> Column:
    """Sorted complaints of a call's arguments (a variant) against its schema entries."""
    given = F.coalesce(arguments.try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>"))
    value = lambda s: F.try_element_at(given, s["arg"])
    kind = lambda s: kind_of(value(s))
    fits = lambda s: (kind(s) == s["type"]) | ((kind(s) == "integer") & (s["type"] == "number"))
    wrong = F.transform(spec, lambda s: F.when(
        value(s).isNull(), F.when(s["required"], F.concat(F.lit("missing "), s["arg"]))
    ).when(~fits(s), F.concat(s["arg"], F.lit(" is no "), s["type"])))
    extra = F.transform(
        F.array_except(F.map_keys(given), F.transform(spec, lambda s: s["arg"])), lambda a: F.concat(F.lit("unexpected "), a)
    )
    return F.array_sort(F.concat(F.filter(wrong, lambda e: e.isNotNull()), extra))


def link(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per message: conv_id, position (from 0), turn, kind, id, status, errors and the canonical ``json``."""
    rows = parsed(messages)
    ranges = max(16, -(-rows.count() // RANGE_ROWS))
    order = stored(ordered(nodes(rows)), "linked")
    mine = order.select(
        F.col("_conv").alias("_c1"), F.col("node").alias("_n1"), F.col("turn").alias("_t1"), F.col("_hash").alias("_h1"), "late", "depth", "cyclic"
    )
    other = order.select(F.col("_conv").alias("_c2"), F.col("node").alias("_n2"))
    partner = F.concat(F.when(F.col("kind") == "call", "result:").otherwise("call:"), F.col("id"))
    joined = rows.withColumn("_node", F.when(F.col("id").isNotNull(), F.concat_ws(":", "kind", "id"))).withColumn("_partner", partner)
    joined = joined.join(
        mine, (F.col("_conv") == F.col("_c1")) & (F.col("_node") == F.col("_n1")) & F.col("turn").eqNullSafe(F.col("_t1")) & (F.col("_hash") == F.col("_h1")), "left"
    ).join(other, (F.col("_conv") == F.col("_c2")) & (F.col("_partner") == F.col("_n2")), "left")
    specs = schemas.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("arg", "type", "required"))).alias("_spec"))
    joined = joined.join(specs.withColumnRenamed("name", "_tool"), F.col("name") == F.col("_tool"), "left")
    call = F.col("kind") == "call"
    status = (
        F.when(F.col("kind") == "message", F.lit(None)).when(F.col("_n1").isNull(), "duplicate").when(F.col("cyclic"), "cyclic")
        .when(call, F.when(F.col("_n2").isNotNull(), "answered").otherwise("unanswered"))
        .otherwise(F.when(F.col("_n2").isNotNull(), "linked").otherwise("orphan"))
    )
    errors = F.when(call, F.when(F.col("_spec").isNull(), F.array(F.lit("unknown tool"))).otherwise(argument_errors(F.col("arguments"), F.col("_spec"))))
    rows = joined.select(
        "conv_id", "_conv", "turn", "role", "text", "kind", "id", "name", "arguments", "content", status.alias("status"), errors.alias("errors"),
        F.coalesce("late", "turn").alias("late"), F.coalesce("depth", F.lit(0)).alias("depth"), "_hash",
    )
    field = lambda name, of=None: F.col(of or name).alias(name)
    json = (
        F.when(call, F.to_json(F.struct(field("arguments"), field("id"), field("name"), field("role"))))
        .when(F.col("kind") == "result", F.to_json(F.struct(field("content"), field("id"), field("role"))))
        .otherwise(F.to_json(F.struct(field("content", "text"), field("role"))))
    )
    slim = rows.select("conv_id", "_conv", "turn", "kind", "id", "status", "errors", json.alias("json"), "late", "depth", "_hash")
    placed = numbered(laid_out(slim, ranges, ["_conv", "late", "depth", "turn", "kind", "id", "json", "_hash"], "places"), ["_conv"], "place")
    return placed.select("conv_id", (F.col("place") - 1).cast("long").alias("position"), "turn", "kind", "id", "status", "errors", "json")
