"""Chat formatting with linked tool calls.

Calls and results are linked by a hash join on (conversation, identifier). A call may refer to the results of
others; calls are ordered topologically, by levels: a call's level is one more than the highest level it refers to.
Levels come from a fold over a conversation's calls where all references point back, else from rounds of joins.
Arguments are validated against the tool's schema (required fields, types, ranges, no unknown fields), compiled into
column expressions that see each value's JSON type: "3" is no integer and 3 no string. Each conversation becomes
canonical JSON: keys in alphabetical order, no blanks, control characters escaped, calls in topological order with
their results inside, arguments with the types they came with.

Everything is DataFrame functions. A conversation's messages meet in one row at the end, so a conversation is the
unit that has to fit into a task, as it is in training.

Tables: calls (conv_id, call_id, tool, arguments: JSON object as text, refs: array of call ids, seq: place),
results (conv_id, call_id, content).

Defined results: null or malformed arguments are invalid, as are those with a repeated key or a number beyond the
range of doubles, and are written as the text they are; numbers inside nested values keep 38 digits; a call without a result and a result without a call are
reported, not dropped; of several results with one identifier the smallest content counts, of several calls all are
linked; references to unknown calls are ignored; calls in a cycle of references come last, by place, and count as
cyclic; null conversation ids form one conversation, null contents are JSON null; calls without an identifier
link with nothing; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


@dataclass(frozen=True)
class Field:
    """A field of a tool's arguments: `type` is string, integer, number or boolean; limits are of its value or length."""

    type: str
    required: bool = True
    low: float | None = None
    high: float | None = None


Schema = Mapping[str, Field]


def json_string(c: Column) -> Column:
    """A string as a JSON string (null: null): quotes, backslashes and control characters are escaped, nothing else."""
    whole = F.to_json(F.struct(c.alias("x")))
    return F.when(c.isNull(), "null").otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))


def json_object(parts: Mapping[str, Column]) -> Column:
    """A JSON object of columns that hold JSON texts, keys in alphabetical order."""
    items: list[Column] = []
    for k in sorted(parts):
        items += [F.lit(("," if items else "{") + f'"{k}":'), parts[k]]
    return F.concat(*items, F.lit("}")) if items else F.lit("{}")


def _values(arguments: Column) -> tuple[Column, Column]:
    """The fields of a JSON object with their types (null: no such object), and as plain texts."""
    whole, endless = F.try_parse_json(arguments), '"-?Infinity"'
    beyond = F.to_json(whole).rlike(endless) & ~arguments.rlike(endless)
    return F.when(~beyond, whole.try_cast("map<string,variant>")), F.from_json(arguments, "map<string,string>")


def _is(value: Column, type: str) -> Column:
    """Whether a variant is a string, boolean or number (all integers and decimals, as JSON knows one type)."""
    return F.schema_of_variant(value).rlike({"string": "^STRING$", "boolean": "^BOOLEAN$"}.get(type, "^(BIGINT|DOUBLE|DECIMAL)"))


def json_arguments(arguments: Column) -> Column:
    """Canonical JSON of the text of a JSON object, every value of the type it had."""
    fields, raw = _values(arguments)
    items = F.transform(F.array_sort(F.map_keys(fields)), lambda k: F.concat(json_string(k), F.lit(":"), F.when(_is(fields[k], "number"), raw[k]).otherwise(F.to_json(fields[k]))))
    return F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}"))


def schema_faults(arguments: Column, schema: Schema) -> Column:
    """Names of the fields at fault, sorted; ["?"] where the text is no JSON object."""
    fields, texts = _values(arguments)
    keys = F.map_keys(fields)
    faults = []
    for name, f in sorted(schema.items()):
        raw = texts[name]
        there = F.array_contains(keys, name)
        number = raw.try_cast("double")
        right = _is(fields[name], f.type)
        if f.type == "integer":
            right = right & raw.rlike(r"^-?(0|[1-9][0-9]*)$")
        size = F.char_length(raw).cast("double") if f.type == "string" else number
        for limit, ok in ((f.low, lambda x, y: x >= y), (f.high, lambda x, y: x <= y)):
            if limit is not None:
                right = right & ok(size, F.lit(float(limit)))
        fine = F.coalesce(right, F.lit(False)) if f.required else ~there | F.coalesce(right, F.lit(False))
        faults.append(F.when(~fine, F.lit(name)))
    known = F.array(*[F.lit(k) for k in sorted(schema)]) if schema else F.array().cast("array<string>")
    unknown = F.array_except(keys, known)
    found = F.array_compact(F.array(*faults)) if faults else F.array().cast("array<string>")
    return F.when(keys.isNull(), F.array(F.lit("?"))).otherwise(F.array_sort(F.array_union(found, unknown)))


def levels(calls: DataFrame, fold: int = 4096) -> DataFrame:
    """(conv, call_id, level) of every identified call; level null for calls in or behind a cycle.

    `calls` has conv, call_id, refs and seq. Where all references of a conversation point back, as they do in one
    that was recorded, a fold over its calls in order gives the levels; conversations with other references, or
    with more than `fold` calls, take the rounds.
    """
    nodes = calls.filter("call_id is not null").groupBy("conv", "call_id").agg(
        F.min("seq").alias("seq"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("refs", F.array().cast("array<string>"))))).alias("refs"))
    nodes = stored(nodes, "nodes")
    edges = nodes.select("conv", "call_id", "seq", F.explode("refs").alias("ref")).filter("ref is not null")
    edges = edges.join(nodes.select("conv", F.col("call_id").alias("ref"), F.col("seq").alias("at")), ["conv", "ref"])
    ahead = edges.filter(F.coalesce(~(F.col("at") < F.col("seq")), F.lit(True))).select("conv")
    long = nodes.groupBy("conv").count().filter(F.col("count") > fold).select("conv")
    hard = stored(ahead.union(long).distinct(), "hard")
    easy = nodes.join(hard, "conv", "left_anti").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("seq", "call_id", "refs"))).alias("calls"))

    def settle(done: Column, call: Column) -> Column:
        of = F.transform(call["refs"], lambda r: F.get(done["levels"], F.array_position(done["ids"], r).cast("int") - 1))
        level = F.coalesce(F.array_max(of) + 1, F.lit(0))
        return F.struct(F.array_append(done["ids"], call["call_id"]).alias("ids"), F.array_append(done["levels"], level).alias("levels"))

    nothing = F.struct(F.array().cast("array<string>").alias("ids"), F.array().cast("array<int>").alias("levels"))
    folded = easy.select("conv", F.aggregate("calls", nothing, settle).alias("done"))
    out = folded.select("conv", F.explode(F.arrays_zip("done.ids", "done.levels")).alias("x")).select("conv", F.col("x.ids").alias("call_id"), F.col("x.levels").alias("level"))
    if hard.isEmpty():
        return out
    return out.union(_rounds(nodes.join(hard, "conv", "left_semi").select("conv", "call_id"), edges.join(hard, "conv", "left_semi").select("conv", "call_id", "ref")))


def _rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Levels by rounds: each settles the calls all of whose references are settled."""
    waiting = stored(edges, "references")
    first = nodes.join(waiting.select("conv", "call_id").distinct(), ["conv", "call_id"], "left_anti")
    done = [stored(first.withColumn("level", F.lit(0)), "level")]
    while True:
        newest = done[-1].select("conv", F.col("call_id").alias("ref"), F.lit(True).alias("settled"))
        state = waiting.join(newest, ["conv", "ref"], "left")
        left = stored(state.filter("settled is null").select("conv", "call_id", "ref"), "references")
        ready = state.filter("settled").select("conv", "call_id").distinct().join(left.select("conv", "call_id").distinct(), ["conv", "call_id"], "left_anti")
        level = stored(ready.withColumn("level", F.lit(len(done))), "level")
        forget(waiting)
        waiting = left
        if level.isEmpty():
            break
        done.append(level)
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.union(waiting.select("conv", "call_id").distinct().withColumn("level", F.lit(None).cast("int")))


def linked_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Schema]) -> DataFrame:
    """Every call with its result, level and faults, and every result without a call (tool null)."""
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))  # a null id is not an empty one
    calls = stored(calls.select("conv_id", conv.alias("conv"), "call_id", "tool", "arguments", "refs", "seq"), "calls")
    answers = results.select("conv_id", conv.alias("conv"), "call_id", "content").groupBy("conv_id", "conv", "call_id").agg(F.min("content").alias("content"))
    faults = F.array(F.lit("?"))
    for tool, schema in schemas.items():
        faults = F.when(F.col("tool") == tool, schema_faults(F.col("arguments"), schema)).otherwise(faults)
    told = answers.filter("call_id is not null").select("conv", "call_id", "content", F.lit(True).alias("answered"))
    out = calls.withColumn("faults", faults).join(told, ["conv", "call_id"], "left").join(levels(calls), ["conv", "call_id"], "left")
    out = out.select("conv_id", "call_id", "tool", "arguments", "faults", "level", "seq", F.coalesce("answered", F.lit(False)).alias("answered"), "content")
    alone = answers.join(calls.select("conv", "call_id").distinct(), ["conv", "call_id"], "left_anti")
    return out.unionByName(alone.select("conv_id", "call_id", "content", F.lit(True).alias("answered")), allowMissingColumns=True)


def conversations_json(linked: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """One row per conversation: n_calls, n_linked, n_invalid, n_cyclic, n_orphans, depth and `json`.

    `others` (conv_id, role, content, seq) holds messages that are neither calls nor results; they come first.
    """
    call = json_object({
        "arguments": F.when(F.array_contains("faults", "?"), json_string(F.col("arguments"))).otherwise(json_arguments(F.col("arguments"))),
        "faults": F.concat(F.lit("["), F.array_join(F.transform("faults", json_string), ","), F.lit("]")),
        "id": json_string(F.col("call_id")), "name": json_string(F.col("tool")),
        "result": F.when(F.col("answered"), json_string(F.col("content"))).otherwise(F.lit("null")),
    })
    orphan = json_object({"id": json_string(F.col("call_id")), "result": json_string(F.col("content"))})
    kind = F.when(F.col("tool").isNull() & F.col("faults").isNull(), 2).otherwise(1)
    rows = linked.select("conv_id", "answered", "level", kind.alias("kind"), F.size("faults").alias("n_faults"), "seq", F.col("call_id").alias("by"),
                         F.when(kind == 2, orphan).otherwise(call).alias("text"))
    if others is not None:
        text = json_object({"content": json_string(F.col("content")), "role": json_string(F.col("role"))})
        rows = rows.unionByName(others.select("conv_id", F.lit(0).alias("kind"), "seq", text.alias("text")), allowMissingColumns=True)
    order = F.struct(F.col("kind"), F.coalesce("level", F.lit(2**31 - 1)).alias("level"), F.col("seq"), F.col("by"), F.col("text"))
    out = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(order)).alias("m"), F.count(F.when(F.col("kind") == 1, 1)).alias("n_calls"),
        F.count(F.when((F.col("kind") == 1) & F.col("answered"), 1)).alias("n_linked"), F.count(F.when((F.col("kind") == 1) & (F.col("n_faults") > 0), 1)).alias("n_invalid"),
        F.count(F.when((F.col("kind") == 1) & F.col("by").isNotNull() & F.col("level").isNull(), 1)).alias("n_cyclic"),
        F.count(F.when(F.col("kind") == 2, 1)).alias("n_orphans"), F.coalesce(F.max("level") + 1, F.lit(0)).alias("depth"))
    part = lambda k: F.concat(F.lit("["), F.array_join(F.transform(F.filter("m", lambda x: x["kind"] == k), lambda x: x["text"]), ","), F.lit("]"))
    json = json_object({"calls": part(1), "messages": part(0), "orphans": part(2)})
    return out.select("conv_id", "n_calls", "n_linked", "n_invalid", "n_cyclic", "n_orphans", "depth", json.alias("json"))


#: Arguments of the one tool that turns of a plain conversation call.
REPLY: Mapping[str, Schema] = {"reply": {"prompt": Field("string", low=1, high=600), "turn": Field("integer", low=0), "follows": Field("string", required=False)}}


def calls_of_turns(turns: DataFrame, asks: Sequence[str] = ("user",), answers: Sequence[str] = ("assistant", "tool")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A conversation table (conv_id, turn, role, text) as calls, results and other messages.

    A turn that asks calls the tool `reply`; the turn numbered one higher, if it answers, is that call's result. A call
    refers to the call two turns earlier, whose result it follows.
    """
    of = lambda t: F.concat(F.lit("call-"), t.cast("string"))
    asking, answering = F.col("role").isin(*asks), F.col("role").isin(*answers)
    arguments = json_object({"prompt": json_string(F.col("text")), "turn": F.col("turn").cast("string")})
    follows = json_object({"follows": json_string(of(F.col("turn") - 2)), "prompt": json_string(F.col("text")), "turn": F.col("turn").cast("string")})
    calls = turns.filter(asking).select("conv_id", of(F.col("turn")).alias("call_id"), F.lit("reply").alias("tool"),
                                        F.when(F.col("turn") >= 2, follows).otherwise(arguments).alias("arguments"), F.array(of(F.col("turn") - 2)).alias("refs"), F.col("turn").alias("seq"))
    results = turns.filter(answering).select("conv_id", of(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    others = turns.filter(F.coalesce(~asking & ~answering, F.lit(True))).select("conv_id", "role", F.col("text").alias("content"), F.col("turn").alias("seq"))
    return calls, results, others
