"""Chat formatting with tool calls (operator 1).

Calls and results arrive as rows. Within a conversation a result is linked to
its call by identifier, with one hash join; a call may name a call whose result
it uses. Calls are ordered topologically: a call's level is one more than that
of the call it uses, its result stands between them, and calls of one level
follow their turns. Levels are found by pointer doubling, in as many joins as
the logarithm of the longest chain, so a conversation of any length is never
gathered in one task. Arguments are validated against a schema per tool and
written as canonical JSON: keys sorted, no spaces, numbers plain.

Every call gets one status: ``ok``; ``no_result`` if nothing answers it;
``repeated_id`` if another call of the conversation has its identifier (the
first by turn keeps it); ``missing_parent`` or ``cycle`` if the call it uses
does not exist or depends on it. Results without a call are rows of status
``no_call``; of several results with one identifier the first by turn is linked
and the others are ``repeated_result``. Argument faults are listed apart.

Defined cases: null conversation ids, identifiers, names and arguments are
values like any other (an unnamed tool has no schema; null arguments are not
JSON); repeated rows are repeated identifiers; empty tables give empty results;
extra columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.ordering import number_rows
from flowlens.plans.workspace import stored

MAX_DOUBLINGS = 64


def canonical_json(value) -> str:
    """JSON with sorted keys and no spaces; whole floats lose their fraction."""
    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        if isinstance(v, float) and v.is_integer() and abs(v) < 2**53:
            return int(v)
        return v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


_KINDS = {
    "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None,
    "integer": lambda v: not isinstance(v, bool) and (isinstance(v, int) or isinstance(v, float) and v.is_integer()),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list),
}


def schema_faults(value, schema: dict, at: str = "$") -> list[str]:
    """Faults of a value under the common part of JSON Schema, in a fixed order."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_KINDS[k](value) for k in kinds):
        return [f"{at}: not {'/'.join(kinds)}"]
    faults = []
    if "enum" in schema and value not in schema["enum"]:
        faults.append(f"{at}: not allowed")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            faults.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", math.inf):
            faults.append(f"{at}: too long")
    if _KINDS["number"](value):
        if value < schema.get("minimum", -math.inf):
            faults.append(f"{at}: too small")
        if value > schema.get("maximum", math.inf):
            faults.append(f"{at}: too large")
    if isinstance(value, list) and "items" in schema:
        for k, item in enumerate(value):
            faults += schema_faults(item, schema["items"], f"{at}[{k}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        faults += [f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                faults += schema_faults(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                faults.append(f"{at}.{k}: unknown")
    return faults


def checked_arguments(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``calls`` with ``canonical`` (null where the arguments are not a JSON value) and ``faults``."""
    def one(name, text) -> tuple[str | None, list[str]]:
        try:
            value = json.loads(text)
            shown = canonical_json(value)
            shown.encode()  # lone surrogates have no UTF-8 form
            faults = schema_faults(value, schemas[name]) if name in schemas else ["$: unknown tool"]
        except (TypeError, ValueError, RecursionError):
            return None, ["$: not JSON"]
        return shown, faults

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("name", "arguments"))
            found = [one(n, t) for n, t in zip(names, texts)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([c for c, _ in found], pa.string()),
                 pa.array([f for _, f in found], pa.list_(pa.string()))],
                names=[*batch.schema.names, "canonical", "faults"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in calls.schema.fields)
    return calls.mapInArrow(run, f"{fields}, canonical string, faults array<string>")


def _levels(calls: DataFrame) -> DataFrame:
    """(key, level, root): steps up to a call without a parent; root is false on or behind a cycle.

    Every round doubles how far each pointer reaches. After as many rounds as
    the logarithm of the number of calls, what still points on is in a cycle.
    """
    state = stored(
        calls.select("key", F.col("up").alias("jump"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("level")),
        "levels",
    )
    total = state.count()
    for _ in range(min(MAX_DOUBLINGS, max(1, total).bit_length() + 1)):
        open_rows = state.filter("jump is not null")
        if not open_rows.head(1):
            break
        far = state.select(F.col("key").alias("jump"), F.col("jump").alias("next"), F.col("level").alias("more"))
        moved = open_rows.join(far, "jump").select("key", F.col("next").alias("jump"), (F.col("level") + F.col("more")).alias("level"))
        state = stored(state.filter("jump is null").unionByName(moved), "levels")
    return state.select("key", "level", F.col("jump").isNull().alias("rooted"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call and per unlinked result, in conversation order.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), parent_id.
    ``results``: conv_id, turn, call_id, content. The answer has conv_id,
    position (0-based topological place in the conversation), call_id, name,
    level, call_turn, result_turn, content, canonical, faults, status.
    """
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", "parent_id")
    results = results.select("conv_id", "turn", "call_id", "content")
    # Equal identifiers of one conversation: the first by turn owns it. Counting is
    # a pre-aggregated minimum; a row of a repeated identifier gets no link.
    place = F.struct("turn", F.xxhash64("name", "arguments", "parent_id").alias("t"))
    key = F.struct("conv_id", "call_id")
    calls = stored(checked_arguments(calls, schemas).withColumns({"key": key, "place": place}), "calls")
    owners = calls.groupBy("key").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("same"))
    ranked = calls.join(owners, "key")
    exact = Window.partitionBy("key", "place").orderBy("arguments")
    twins = ranked.filter((F.col("same") > 1) & (F.col("place") == F.col("first"))).withColumn("k", F.row_number().over(exact))
    single = ranked.filter(F.col("same") == 1).withColumn("k", F.lit(1))
    later = ranked.filter((F.col("same") > 1) & (F.col("place") != F.col("first"))).withColumn("k", F.lit(2))
    ranked = stored(single.unionByName(twins).unionByName(later).drop("first", "same"), "calls")
    owned = ranked.filter("k = 1").withColumn(
        "parent", F.when(F.col("parent_id").isNotNull(), F.struct("conv_id", F.col("parent_id").alias("call_id")))
    )
    known = owned.select(F.col("key").alias("parent"), F.lit(True).alias("found"))
    owned = stored(
        owned.join(known, "parent", "left").withColumn("up", F.when(F.col("found"), F.col("parent"))), "owned"
    )
    levels = _levels(owned)
    answers = results.withColumns({"key": key, "place": F.struct("turn", F.xxhash64("content").alias("t"), "content")})
    first = answers.groupBy("key").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("same"))
    linked = (
        owned.join(levels, "key").join(first.select("key", F.col("first").alias("answer")), "key", "left")
        .select(
            "conv_id", "call_id", "name", F.when(F.col("rooted"), F.col("level")).alias("level"),
            F.col("turn").alias("call_turn"), F.col("answer.turn").alias("result_turn"),
            F.col("answer.content").alias("content"), "canonical", "faults",
            F.when(~F.col("rooted"), "cycle").when(F.col("parent").isNotNull() & F.col("found").isNull(), "missing_parent")
            .when(F.col("answer").isNull(), "no_result").otherwise("ok").alias("status"),
        )
    )
    nothing = lambda kind: F.lit(None).cast(kind)
    repeated = ranked.filter("k > 1").select(
        "conv_id", "call_id", "name", nothing("long").alias("level"), F.col("turn").alias("call_turn"),
        nothing("long").alias("result_turn"), nothing("string").alias("content"), "canonical", "faults",
        F.lit("repeated_id").alias("status"),
    )
    # Copies of the first result beyond the linked one, and results nobody asked for.
    counted = answers.groupBy("key", "conv_id", "call_id", "place").agg(F.count(F.lit(1)).alias("n"))
    judged = counted.join(first.select("key", "first"), "key").join(
        owned.select("key", F.lit(True).alias("asked")), "key", "left"
    )
    spare = F.col("n") - F.when(F.col("asked") & (F.col("place") == F.col("first")), 1).otherwise(0)
    loose = judged.withColumn("spare", spare).filter("spare > 0").select(
        "conv_id", "call_id", nothing("string").alias("name"), nothing("long").alias("level"),
        nothing("long").alias("call_turn"), F.col("place.turn").alias("result_turn"), F.col("place.content").alias("content"),
        nothing("string").alias("canonical"), F.array().cast("array<string>").alias("faults"),
        F.when(F.col("asked"), "repeated_result").otherwise("no_call").alias("status"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("spare"))).alias("copy"),
    ).drop("copy")
    return linked.unionByName(repeated).unionByName(loose)


def ordered(linked: DataFrame, bucket_turns: int = 256) -> DataFrame:
    """Adds ``position``: by level (unlevelled rows last), turn and call id, from 0 in each conversation."""
    turn = F.coalesce("call_turn", "result_turn", F.lit(0))
    level = F.coalesce("level", F.lit(1 << 40))
    bucket = F.struct(
        F.floor(level / F.lit(bucket_turns)).alias("l"), F.when(F.col("level").isNull(), F.floor(turn / F.lit(bucket_turns))).alias("t")
    )
    rest = [F.col(c) for c in ("call_id", "status", "result_turn", "canonical", "content")]
    return number_rows(linked, ["conv_id"], bucket, [level, turn, *rest], "position")


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, dict]]:
    """Calls and results that plain conversations imply, for tables without tool turns.

    Every assistant turn becomes a call of one of three tools, chosen by its
    length, with its text as argument; the next turn, if it is a user's, is its
    result. A call uses the result of the assistant turn that its number of
    words points back to. Turns without words leave out a required argument, so
    validation has something to find.
    """
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")
    kind = F.pmod(F.length(F.coalesce("text", F.lit(""))), F.lit(3))
    name = F.when(kind == 0, "search").when(kind == 1, "summarise").otherwise("translate")
    identifier = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    said = turns.filter(F.col("role") == "assistant")
    parent = F.when(words % 4 != 0, identifier(F.col("turn") - 2 * (words % 4)))
    calls = said.select(
        "conv_id", "turn", identifier(F.col("turn")).alias("call_id"), name.alias("name"),
        F.to_json(F.struct(
            F.col("text").alias("text"), words.alias("limit"),
            F.when(words % 5 == 0, F.lit("fr")).when(words % 7 == 0, F.lit("xx")).otherwise(F.lit("en")).alias("language"),
        )).alias("arguments"),
        F.when(F.col("turn") - 2 * (words % 4) >= 0, parent).alias("parent_id"),
    )
    results = turns.filter(F.col("role") == "user").filter(F.col("turn") > 0).select(
        "conv_id", "turn", identifier(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content")
    )
    shared = {"text": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 200}}
    schemas = {
        "search": {"type": "object", "properties": shared, "required": ["text"], "additionalProperties": False},
        "summarise": {"type": "object", "properties": shared, "required": ["text", "limit"]},
        "translate": {
            "type": "object", "required": ["text", "language"],
            "properties": shared | {"language": {"type": "string", "enum": ["de", "en", "fr"]}},
        },
    }
    return calls, results, schemas
