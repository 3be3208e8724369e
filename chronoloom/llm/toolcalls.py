"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON. DataFrame operations alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Variant type names by the JSON schema's type.
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",),
         "array": ("ARRAY",), "object": ("OBJECT",)}


@dataclass(frozen=True)
class Field:
    """An argument: its type, whether it has to be there, and bounds on its value (numbers) or length (strings)."""

    kind: str
    required: bool = True
    least: int | None = None
    most: int | None = None


Schemas = dict[str, dict[str, Field]]


def _quoted(text: Column) -> Column:
    """A JSON string, or null."""
    one = F.to_json(F.array(text))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substr(one, F.lit(2), F.length(one) - 2))


def _field_error(parsed: Column, name: str, field: Field) -> Column:
    value = F.try_variant_get(parsed, f"$['{name}']", "variant")
    kind = F.schema_of_variant(value)
    error = F.when(~F.coalesce(F.rlike(kind, F.lit("^(" + "|".join(TYPES[field.kind]) + ")\\b")), F.lit(False)), f"{name}:type")
    if field.kind in ("string", "integer", "number") and (field.least is not None or field.most is not None):
        size = (F.length(F.try_variant_get(value, "$", "string")).cast("double") if field.kind == "string"
                else F.try_variant_get(value, "$", "double"))
        inside = F.lit(True)
        if field.least is not None:
            inside = inside & (size >= field.least)
        if field.most is not None:
            inside = inside & (size <= field.most)
        error = error.when(~inside, f"{name}:range")
    if field.required:
        return F.when(value.isNull(), f"{name}:missing").otherwise(error)
    return F.when(value.isNotNull(), error)


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted error texts of a call: ``arguments`` against the schema of its name."""
    parsed = F.try_parse_json(arguments)
    is_object = F.rlike(F.schema_of_variant(parsed), F.lit("^OBJECT"))
    out = F.when(~F.coalesce(name.isin(*schemas), F.lit(False)), F.array(F.lit("unknown name")))
    out = out.when(~F.coalesce(is_object, F.lit(False)), F.array(F.lit("not an object")))
    for known, fields in schemas.items():
        unknown = F.transform(F.array_except(F.json_object_keys(arguments), F.array(*[F.lit(f) for f in fields])),
                              lambda k: F.concat(k, F.lit(":unknown")))
        errors = F.array_compact(F.array(*[_field_error(parsed, f, spec) for f, spec in fields.items()]))
        out = out.when(name == known, F.array_sort(F.concat(errors, unknown)))
    return out


def call_depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): how many calls lead to each one; null where the chain runs into a circle.

    ``calls`` (conv_id, call_id, parent_id), one row per call. Sorting by (conv_id, depth, call_id) is a topological order.
    A parent that is not there counts as none. Every round doubles the reach of each pointer by one equi-join of the
    open rows, so that a chain of n calls takes about log2(n) rounds; each is checkpointed.
    """
    parents = calls.select("conv_id", F.col("call_id").alias("parent_id"), F.lit(True).alias("there"))
    state = calls.join(parents, ["conv_id", "parent_id"], "left").select(
        "conv_id", "call_id", F.when(F.col("there"), F.col("parent_id")).alias("up"),
        F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth"))
    state = checkpointed(state)
    reach, total = 1, state.count()
    while reach <= total and not state.where("up IS NOT NULL").isEmpty():
        ahead = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        moved = state.where("up IS NOT NULL").join(ahead, ["conv_id", "up"]).select(
            "conv_id", "call_id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        state = checkpointed(state.where("up IS NULL").unionByName(moved))
        reach *= 2
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call and per result without a call: conv_id, call_id, parent_id, name, depth, copies, n_results, errors
    array<string>, message.

    ``calls`` (conv_id, call_id, parent_id, name, arguments as JSON text), ``results`` (conv_id, call_id, content); other columns
    are ignored. Calls and results meet in a hash join on their identifiers, results counted and reduced to the least
    content first, so that an identifier that very many rows share is one row. ``message`` is canonical JSON: sorted keys
    at every level, no white space, the text as a string for arguments that do not parse, null for missing ones and for a missing result.

    Equal rows are one call or result. Of different calls that share an identifier the least of parent, name and arguments is linked, with the least
    result, and ``copies`` and ``n_results`` count all of them; each other call and each other result is a row of its own, without a
    place in the order (depth null), so that none is lost. All these rows have the error 'repeated id'. Null
    identifiers are dropped. A null conversation is a conversation of its own. ``errors`` lists what the schema of the call's
    name forbids ('unknown name', 'not an object', 'x:missing', 'x:type', 'x:range', 'x:unknown'), and 'no result', 'no parent',
    'circle', 'no call', 'repeated id'. Empty tables give no rows.
    """
    body = F.struct("parent_id", "name", "arguments")
    conv = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("id"))
    one = calls.where("call_id IS NOT NULL").select(conv.alias("conv"), F.col("conv_id").alias("shown"), "call_id", body.alias("body")).groupBy(
        "conv", "call_id").agg(F.min("shown").alias("shown"), F.min("body").alias("body"), F.count("*").alias("copies"),
                               (~F.min("body").eqNullSafe(F.max("body"))).alias("several"))
    one = checkpointed(one.select(F.col("conv").alias("conv_id"), "call_id", "shown", "copies", "several", "body.*"))
    answers = results.where("call_id IS NOT NULL").select(conv.alias("conv"), F.col("conv_id").alias("shown"), "call_id", "content").groupBy(
        "conv", "call_id").agg(F.min("shown").alias("r_shown"), F.count("*").alias("n_results"), F.min("content").alias("content"),
        (~F.min("content").eqNullSafe(F.max("content"))).alias("several_results")).withColumnRenamed("conv", "conv_id")
    depths = call_depths(one.select("conv_id", "call_id", "parent_id"))
    known = one.select("conv_id", F.col("call_id").alias("parent_id"), F.lit(True).alias("parent_there"))
    linked = (one.join(depths, ["conv_id", "call_id"]).join(known, ["conv_id", "parent_id"], "left")
              .join(answers.hint("shuffle_hash"), ["conv_id", "call_id"], "left"))
    arguments = F.coalesce(F.to_json(F.try_parse_json(F.col("arguments"))), _quoted(F.col("arguments")))

    def written(arguments: Column, name: Column, parent: Column, result: Column) -> Column:
        parts = (("arguments", arguments), ("id", _quoted(F.col("call_id"))), ("name", name), ("parent", parent), ("result", result))
        return F.concat(F.lit("{"), *[F.concat(F.lit(("," if k else "") + f'"{n}":'), c) for k, (n, c) in enumerate(parts)], F.lit("}"))

    message = written(arguments, _quoted(F.col("name")), _quoted(F.col("parent_id")), _quoted(F.col("content")))
    repeated = F.array_compact(F.array(F.when(F.col("several") | F.coalesce("several_results", F.lit(False)), "repeated id")))
    links = F.array_compact(F.array(
        F.when(F.col("n_results").isNull(), "no result"), F.when(F.col("depth").isNull(), "circle"),
        F.when(F.col("parent_id").isNotNull() & F.col("parent_there").isNull(), "no parent")))
    found = linked.select(
        F.col("shown").alias("conv_id"), "call_id", "parent_id", "name", "depth", "copies", F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.concat(argument_errors(F.col("name"), F.col("arguments"), schemas), F.array_sort(links), repeated).alias("errors"), message.alias("message"))
    lost = answers.join(one.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").select(
        F.col("r_shown").alias("conv_id"), "call_id", F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("long").alias("depth"), F.lit(0).cast("long").alias("copies"), "n_results",
        F.when(F.col("several_results"), F.array(F.lit("no call"), F.lit("repeated id"))).otherwise(F.array(F.lit("no call"))).alias("errors"),
        written(F.lit("null"), F.lit("null"), F.lit("null"), _quoted(F.col("content"))).alias("message"))
    if one.where("several").isEmpty() and answers.where("several_results").isEmpty():
        return found.unionByName(lost)
    # each further call and result, told from the linked one by its whole content, so that no identifier is a hot key
    shown, none = F.col("shown").alias("conv_id"), F.lit(None).cast("string")
    calls_of = calls.where("call_id IS NOT NULL").select(conv.alias("key"), F.col("conv_id").alias("shown"), "call_id", "parent_id", "name", "arguments").groupBy(
        "key", "call_id", "parent_id", "name", "arguments").agg(F.min("shown").alias("shown"), F.count("*").alias("copies"))
    linked_call = one.select(F.col("conv_id").alias("key"), *[F.col(c).alias(f"l_{c}") for c in ("call_id", "parent_id", "name", "arguments")])
    further = _except(calls_of, linked_call, ("call_id", "parent_id", "name", "arguments")).select(
        shown, "call_id", "parent_id", "name", F.lit(None).cast("long").alias("depth"), "copies", F.lit(0).cast("long").alias("n_results"),
        F.concat(argument_errors(F.col("name"), F.col("arguments"), schemas), F.array(F.lit("repeated id"))).alias("errors"),
        written(arguments, _quoted(F.col("name")), _quoted(F.col("parent_id")), F.lit("null")).alias("message"))
    results_of = results.where("call_id IS NOT NULL AND content IS NOT NULL").select(
        conv.alias("key"), F.col("conv_id").alias("shown"), "call_id", "content").groupBy(
        "key", "call_id", "content").agg(F.min("shown").alias("shown"), F.count("*").alias("n_results"))
    linked_result = answers.select(F.col("conv_id").alias("key"), F.col("call_id").alias("l_call_id"), F.col("content").alias("l_content"))
    other = _except(results_of, linked_result, ("call_id", "content")).select(
        shown, "call_id", none.alias("parent_id"), none.alias("name"), F.lit(None).cast("long").alias("depth"), F.lit(0).cast("long").alias("copies"),
        "n_results", F.array(F.lit("repeated id")).alias("errors"),
        written(F.lit("null"), F.lit("null"), F.lit("null"), _quoted(F.col("content"))).alias("message"))
    return found.unionByName(lost).unionByName(further).unionByName(other)


def _except(rows: DataFrame, linked: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The rows that are not in ``linked`` (key, l_...), compared in the key and all of these columns, null with null."""
    linked = linked.withColumnRenamed("key", "l_key")
    same = F.col("key") == F.col("l_key")
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"l_{c}"))
    return rows.join(linked, same, "left_anti")


#: What the turns of a conversation are as calls.
TURNS: Schemas = {
    "configure": {"prompt": Field("string", least=1, most=8000), "turn": Field("integer", least=0, most=0)},
    "reply": {"prompt": Field("string", least=1, most=1000), "turn": Field("integer", least=0)},
}


def conversation_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, turn, role, text) as calls and results: a user turn calls ``reply`` and the turn after it answers; a system turn
    calls ``configure`` and has no answer. A call follows the call two turns before, at turn 1 the one before."""
    number = F.col("turn").cast("string")
    before = F.when(F.col("turn") >= 2, F.col("turn") - 2).when(F.col("turn") == 1, 0)
    calls = messages.where(F.col("role").isin("user", "system")).select(
        "conv_id", number.alias("call_id"), before.cast("string").alias("parent_id"),
        F.when(F.col("role") == "user", "reply").otherwise("configure").alias("name"),
        F.to_json(F.struct("turn", F.col("text").alias("prompt"))).alias("arguments"))
    results = messages.where(F.col("role").isin("assistant", "tool")).select(
        "conv_id", (F.col("turn") - 1).cast("string").alias("call_id"), F.col("text").alias("content"))
    return calls, results
