"""Tool calls in conversations: linking, order, validation and canonical JSON.

Calls and results meet by (conversation, identifier) in a hash join. A call may wait for one other call of its conversation
(`after`). Its depth, the number of calls before it, comes from pointer jumping over all conversations at once, in a number of
rounds that is the logarithm of the longest chain; so a conversation that holds a third of all calls is no group of its own. Calls that wait
for each other in a circle, or for such calls, have no depth. Order is (depth, turn, identifier). Arguments are checked
against the schema of the called tool, and each call goes out as JSON with sorted keys, no blanks and plain characters.

Rules: of calls (results) that share an identifier, the one with the smallest turn, then text, counts, and the others are
`repeated`. A call without result keeps a null result; a result without call is `orphan`. A call that waits for an unknown call
starts a chain. Null arguments are invalid. No calls give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrail.llm.common import stored

#: Fields of a schema: {name: (kind, required)}; other fields are not allowed.
Schema = dict[str, tuple[str, bool]]
_KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def errors(arguments: str | None, schema: Schema | None) -> list[str]:
    """What is wrong with a call's arguments; nothing if they are valid."""
    if schema is None:
        return ["unknown tool"]
    try:
        given = json.loads(arguments or "")
    except (ValueError, RecursionError):
        return ["no JSON"]
    if not isinstance(given, dict):
        return ["no object"]
    out = [f"missing {name}" for name, (_, required) in schema.items() if required and name not in given]
    for name, value in given.items():
        if name not in schema:
            out.append(f"unexpected {name}")
        elif not isinstance(value, _KINDS[schema[name][0]]) or isinstance(value, bool) != (schema[name][0] == "boolean"):
            out.append(f"{name} is no {schema[name][0]}")
    return sorted(out)


def canonical(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _first(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the row of each identifier that counts, the others)."""
    order = Window.partitionBy("conv_id", "call_id").orderBy("turn", F.to_json(F.struct("*")))
    ranked = rows.withColumn("__n", F.row_number().over(order))
    return ranked.filter("__n = 1").drop("__n"), ranked.filter("__n > 1").drop("__n")


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth); null in and behind circles. `calls`: stored, with distinct (conv_id, call_id)."""
    ids = calls.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"))
    known = calls.join(ids, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("after") == F.col("i")), "left")
    state = stored(known.select("conv_id", "call_id", F.col("i").alias("to"), F.when(F.col("i").isNotNull(), 1).otherwise(0).cast("long").alias("depth")), "chains")
    total, most, jump = state.count(), 1, state
    while True:
        # A chain is at most as long as there are calls: what still points on after that runs in a circle.
        waiting = state.filter("to IS NOT NULL")
        if waiting.isEmpty() or most > 2 * total:
            return state.select("conv_id", "call_id", F.when(F.col("to").isNull(), F.col("depth")).alias("depth"))
        jump = state.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.col("to").alias("next"), F.col("depth").alias("more"))
        state = stored(state.join(jump, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("to") == F.col("i")), "left").select(
            "conv_id", "call_id", F.col("next").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "chains")
        most *= 2


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """A row for every call and every result without call: (conv_id, call_id, turn, status, depth, position, result_turn,
    errors, json). `calls`: (conv_id, call_id, turn, name, arguments, after); `results`: (conv_id, call_id, turn, content).

    `status` is linked, open (no result), circular, repeated or orphan.
    """
    own, repeated = _first(calls.select("conv_id", "call_id", "turn", "name", "arguments", "after"))
    own = stored(own, "calls")
    got, again = _first(results.select("conv_id", "call_id", "turn", "content"))
    got = stored(got, "results").select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.col("turn").alias("result_turn"), "content")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("call_id").eqNullSafe(F.col("i"))
    deep = depths(own).select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), "depth")
    df = own.join(deep, same).drop("c", "i").join(got, same, "left")
    df = df.withColumn("status", F.when(F.col("depth").isNull(), "circular").when(F.col("c").isNotNull() | F.col("i").isNotNull(), "linked").otherwise("open"))
    df = df.drop("c", "i")
    # Numbers within a conversation, summed over depths first: depths are many where a conversation is long.
    level = Window.partitionBy("conv_id").orderBy("depth")
    levels = df.filter("depth IS NOT NULL").groupBy("conv_id", "depth").agg(F.count(F.lit(1)).alias("n"))
    levels = levels.select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), (F.sum("n").over(level) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("conv_id", "depth").orderBy("turn", "call_id"))
    df = df.withColumn("within", within).join(levels, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("depth") == F.col("d")), "left")
    df = df.withColumn("position", (F.col("before") + F.col("within")).cast("long")).drop("c", "d", "before", "within")
    none = {"depth": "LONG", "position": "LONG", "result_turn": "LONG", "content": "STRING"}
    df = df.unionByName(repeated.withColumns({k: F.lit(None).cast(t) for k, t in none.items()}).withColumn("status", F.lit("repeated")))
    ids = own.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"))
    none = {"depth": "LONG", "position": "LONG", "result_turn": "LONG", "name": "STRING", "arguments": "STRING", "after": "STRING"}
    orphans = got.select(F.col("c").alias("conv_id"), F.col("i").alias("call_id"), F.col("result_turn").alias("turn"), "content").join(ids, same, "left_anti")
    for rows, status in ((orphans, "orphan"), (again, "repeated")):
        df = df.unionByName(rows.withColumns({k: F.lit(None).cast(t) for k, t in none.items()}).withColumn("status", F.lit(status)))
    return _serialised(df, schemas)


def _serialised(df: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    names = ["conv_id", "call_id", "turn", "status", "depth", "position", "result_turn", "errors", "json"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string()]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], []
            for row in batch.select(["name", "arguments", "after", "content", "call_id"]).to_pylist():
                wrong = errors(row["arguments"], schemas.get(row["name"])) if row["name"] is not None else []
                try:
                    given = json.loads(row["arguments"] or "null")
                except (ValueError, RecursionError):
                    given = row["arguments"]
                call = {"id": row["call_id"], "name": row["name"], "arguments": given, "after": row["after"], "result": row["content"]}
                found.append(wrong)
                texts.append(canonical({k: v for k, v in call.items() if v is not None}))
            kept = [batch[n] for n in names[:7]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, kinds[7]), pa.array(texts, kinds[8])], names)

    cast = [F.col(n).cast("long" if k == pa.int64() else "string").alias(n) for n, k in zip(names[:7], kinds, strict=False)]
    texts = [F.col(n).cast("string").alias(n) for n in ("name", "arguments", "after", "content")]
    return df.select(*cast, *texts).mapInArrow(
        write, "conv_id LONG, call_id STRING, turn LONG, status STRING, depth LONG, position LONG, result_turn LONG, errors ARRAY<STRING>, json STRING")


SCHEMAS: dict[str, Schema] = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculate": {"expression": ("string", True), "digits": ("integer", True)},
    "lookup": {"key": ("string", True)},
}


def calls_of_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read from plain turns: an assistant's turn calls a tool, the user's next turn is its result.

    The tool follows the turn's number, the arguments hold the whole text and its length, and a call waits for that of the assistant's turn before.
    """
    turn = F.col("turn").cast("long")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"),
                                F.lower(F.col("role").cast("string")).alias("role"), F.col("text").cast("string").alias("text"))

    def name(at: Column) -> Column:
        return F.concat(F.lit("call-"), at)

    kind = F.pmod("turn", F.lit(3))
    text, size = F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit("")))
    arguments = F.when(kind == 0, F.to_json(F.struct(text.alias("query"), size.alias("limit")))).when(
        kind == 1, F.to_json(F.struct(text.alias("expression"), size.alias("digits")))).otherwise(F.to_json(F.struct(text.alias("key"))))
    calls = rows.filter("role = 'assistant'").select(
        "conv_id", name(F.col("turn")).alias("call_id"), "turn", F.get(F.array(*[F.lit(n) for n in SCHEMAS]), kind).alias("name"),
        arguments.alias("arguments"), F.when(F.col("turn") > 1, name(F.col("turn") - 2)).alias("after"))
    results = rows.filter("role IN ('user', 'tool') AND turn > 0").select(
        "conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def linked_conversations(conversations: DataFrame) -> DataFrame:
    calls, results = calls_of_turns(conversations)
    return link(calls, results, SCHEMAS)
