"""Chat formatting: link tool calls with their results, order them, check arguments, write canonical JSON.

Events are rows: a message, a call (with an identifier, a tool's name, arguments as JSON and the identifiers it waits
for) or a result (with the identifier it answers).  Results are joined to calls by conversation and identifier.

The order is topological: by place, then step.  A call's place is its turn, unless it waits for a call that comes
later: then it takes that call's place, one step behind it.  Only calls that are in the wrong order with one they wait
for are moved, in rounds of joins, as many as the longest chain of such moves (none where calls wait for earlier ones
alone); calls on or behind a cycle get no place.  A result has its call's place and step.  Rows carry their sort key
(place, step, turn), so no conversation is gathered into one task.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import join_hot, staged

#: JSON types of a schema, as schema_of_variant names them; an integer is a number without a fraction, however it is written.
TYPES = {"string": "^STRING$", "integer": "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$", "number": "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$", "boolean": "^BOOLEAN$", "object": "^OBJECT.*$", "array": "^ARRAY.*$"}


def canonical_json(text: Column) -> Column:
    """A JSON text with sorted keys and no white space; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def member(value: Column, name: str) -> Column:
    """The member of a variant object under a key, taken literally; keys may hold any character but both kinds of quotes."""
    if "'" in name and '"' in name:
        raise ValueError(f"parameter name {name} has both kinds of quotes")
    quote = '"' if "'" in name else "'"
    return F.try_variant_get(value, f"$[{quote}{name}{quote}]", "variant")


def fits(value: Column, kind: str) -> Column:
    """Whether a variant has a type of TYPES; null where it is missing."""
    typed = F.schema_of_variant(value).rlike(TYPES[kind])
    if kind != "integer":
        return typed
    # of decimals the digits tell, of doubles the value
    whole = F.to_json(value).rlike(r"^-?[0-9]+(\.0+)?$")
    large = F.schema_of_variant(value).rlike("^(DOUBLE|FLOAT)$") & (F.try_variant_get(value, "$", "double") % 1 == 0)
    return typed & (whole | F.coalesce(large, F.lit(False)))


def argument_faults(name: Column, arguments: Column, schemas: Mapping[str, Mapping[str, str]]) -> Column:
    """What is wrong with a call's arguments: array<string>, empty if nothing.

    schemas: tool -> parameter -> type, with ``?`` after it if the parameter may be missing; other keys aren't allowed.  Names
    are taken literally, dots and all.  Arguments with a repeated key are no JSON.
    """
    parsed = F.try_parse_json(arguments)
    not_object = ~F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    keys = F.json_object_keys(arguments)
    faults = F.when(not_object, F.array(F.lit("arguments are no object"))).otherwise(F.array(F.lit("unknown tool")))
    for tool, parameters in schemas.items():
        checks = [F.transform(F.array_except(keys, F.array(*[F.lit(p) for p in parameters]) if parameters else F.array().cast("array<string>")), lambda k: F.concat(F.lit("extra "), k))]
        for parameter, kind in parameters.items():
            value = member(parsed, parameter)
            there = F.array_contains(keys, parameter)
            wrong = there & ~F.coalesce(fits(value, kind.rstrip("?")), F.lit(False))
            found = F.when(wrong, F.lit(f"{parameter} is no {kind.rstrip('?')}"))
            if not kind.endswith("?"):
                found = F.when(~there, F.lit(f"{parameter} is missing")).otherwise(found)
            checks.append(F.array_compact(F.array(found)))
        faults = F.when(~not_object & (name == tool), F.flatten(F.array(*checks))).otherwise(faults)
    return faults


#: The place of calls on or behind a cycle, while order is sought.
NEVER = 1 << 62


def call_order(calls: DataFrame) -> DataFrame:
    """calls (conv, call_id, call_turn, after: array<string>) -> conv, call_id, place, step (null on or behind a cycle)."""
    ids = ["conv", "call_id"]
    waits = calls.select(*ids, F.explode("after").alias("before"))
    known = calls.select("conv", F.col("call_id").alias("before"))
    waits = staged(waits.join(known, ["conv", "before"], "left_semi").distinct(), "waits")
    now = calls.select(*ids, F.struct(F.col("call_turn").cast("long").alias("place"), F.lit(0).cast("long").alias("step")).alias("at"))
    sizes = calls.groupBy("conv").agg(F.count("*").alias("n_calls"))
    while True:
        both = waits.join(now.withColumnRenamed("at", "own"), ids).join(now.select("conv", F.col("call_id").alias("before"), F.col("at").alias("other")), ["conv", "before"])
        wrong = both.where((F.col("own.place") < NEVER) & (F.col("other") >= F.col("own")))
        moved = wrong.groupBy(*ids).agg(F.max("other").alias("other"))
        # more steps than calls: a cycle
        moved = moved.join(sizes, "conv").withColumn("never", (F.col("other.place") == NEVER) | (F.col("other.step") >= F.col("n_calls")))
        new = F.struct(F.when(F.col("never"), NEVER).otherwise(F.col("other.place")).alias("place"), F.when(F.col("never"), 0).otherwise(F.col("other.step") + 1).alias("step"))
        moved = staged(moved.select(*ids, new.alias("new")), "moved")
        if not moved.take(1):
            break
        now = staged(now.join(moved, ids, "left").select(*ids, F.coalesce("new", "at").alias("at")), "order")
    ok = F.col("at.place") < NEVER
    return now.select(*ids, F.when(ok, F.col("at.place")).alias("place"), F.when(ok, F.col("at.step")).alias("step"))


def link(events: DataFrame, schemas: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """events (conv, turn, kind, call_id, name, arguments, after, content) -> one row per event, in canonical JSON.

    Adds place and step (null for messages), status and json.  status: ``message``; ``linked``, ``unanswered`` or ``repeated`` (a
    later call with an identifier that its conversation has used) for calls, ``invalid`` before these if the arguments
    don't fit their tool's schema; ``linked``, ``orphan`` (no such call, or only a later one) or ``repeated`` (not the first
    answer) for results; rows of one turn are alike first.  Nulls: a call or result without conversation, turn or identifier
    is ``unanswered`` or ``orphan`` and has no place.  Any other kind is a message.
    """
    ids = ["conv", "call_id"]
    linkable = F.col("kind").isin("call", "result") & F.col("conv").isNotNull() & F.col("turn").isNotNull() & F.col("call_id").isNotNull()
    linked, alone = events.where(F.coalesce(linkable, F.lit(False))), events.where(~F.coalesce(linkable, F.lit(False)))
    is_call = F.col("kind") == "call"
    # one row per identifier: its first call, and how many events bear it
    calls = linked.groupBy(*ids).agg(
        F.min(F.when(is_call, F.col("turn"))).alias("call_turn"), F.min_by(F.when(is_call, F.col("after")), F.when(is_call, F.col("turn"))).alias("after"),
        F.count("*").alias("held"),
    )
    calls = staged(calls, "calls")
    first = calls.where("call_turn IS NOT NULL")
    total = calls.agg(F.sum("held")).first()[0] or 0
    results = join_hot(linked.where("kind = 'result'"), first.select(*ids, "call_turn", "held"), ids, "held", total).where("turn >= call_turn")
    answers = results.groupBy(*ids).agg(F.min("turn").alias("answer_turn"))
    order = call_order(first.select(*ids, "call_turn", F.coalesce("after", F.array().cast("array<string>")).alias("after")))
    known = staged(first.drop("after").join(answers, ids, "left").join(order, ids, "left"), "known-calls")
    both = join_hot(linked, known, ids, "held", total, "left").drop("held")
    empty = {c: F.lit(None).cast(known.schema[c].dataType) for c in ("call_turn", "answer_turn", "place", "step")}
    both = both.unionByName(alone.withColumns(empty))
    faults = argument_faults(F.col("name"), F.col("arguments"), schemas)
    call_status = (
        F.when(F.col("turn") > F.col("call_turn"), "repeated").when(F.size("faults") > 0, "invalid").when(F.col("answer_turn").isNull(), "unanswered").otherwise("linked")
    )
    result_status = F.when(F.col("call_turn").isNull() | (F.col("turn") < F.col("call_turn")), "orphan").when(F.col("turn") > F.col("answer_turn"), "repeated").otherwise("linked")
    both = both.withColumn("faults", F.when(F.col("kind") == "call", faults))
    both = both.withColumn("status", F.when(F.col("kind") == "call", call_status).when(F.col("kind") == "result", result_status).otherwise("message"))
    as_text = F.try_parse_json(F.to_json(F.struct(F.col("arguments").alias("text"))))
    # keys in sorted order; nulls are left out
    parts = F.struct(
        F.when(F.col("arguments").isNotNull(), F.coalesce(F.try_parse_json("arguments"), as_text)).alias("arguments"),
        "content", "conv", F.when(F.size("faults") > 0, F.col("faults")).alias("faults"), F.col("call_id").alias("id"), "kind", "name", "place", "status", "step", "turn",
    )
    return both.select("conv", "turn", "kind", "call_id", "place", "step", "status", F.to_json(parts).alias("json"))
