"""Chat formatting: tool calls linked to their results, put in order, checked and written as canonical JSON.

Calls and results meet in a hash join on (conversation, call id). A call stands after those that
it builds on, in whatever turn: levels are worked out by pointer doubling over the calls that still wait, so a
chain along a long conversation takes few rounds. Nothing is collected per conversation; rows carry the
numbers that put a conversation in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnseek.llm.common import shared_folder, written
from tarnseek.llm.schemas import fits

#: Columns of an event table. kind is message, call or result; arguments is JSON text; after names calls of the conversation.
EVENT = "conv_id, turn, part, kind, role, call_id, name, arguments, after, content"

_CALLS = "array<struct<id:string,name:string,arguments:string,after:array<string>>>"


def events_of(conversations: DataFrame) -> DataFrame:
    """Events of turns whose text is plain or says in JSON what was called.

    An assistant's ``{"tool_calls": [{"id", "name", "arguments", "after"}]}`` gives a call for each entry, a tool's
    ``{"tool_call_id", "content"}`` a result. All other texts, broken JSON among them, are messages.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    said = F.when(F.col("text").startswith("{"), F.from_json("text", f"tool_calls {_CALLS}, tool_call_id string, content string"))
    rows = rows.withColumn("said", said)
    is_calls = (F.col("role") == "assistant") & (F.size("said.tool_calls") > 0)
    is_result = (F.col("role") == "tool") & F.col("said.tool_call_id").isNotNull()
    rows = rows.withColumn("kind", F.when(is_calls, "call").when(is_result, "result").otherwise("message"))
    nothing = F.array(F.lit(None).cast(_CALLS[6:-1]))
    rows = rows.select("*", F.posexplode(F.when(F.col("kind") == "call", F.col("said.tool_calls")).otherwise(nothing)).alias("part", "c"))
    content = F.when(F.col("kind") == "message", F.col("text")).when(F.col("kind") == "result", F.col("said.content"))
    call_id = F.when(F.col("kind") == "result", F.col("said.tool_call_id")).otherwise(F.col("c.id"))
    return rows.select(
        "conv_id", "turn", "part", "kind", "role", call_id.alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"),
        F.col("c.after").alias("after"), content.alias("content"),
    )


def turns_as_calls(conversations: DataFrame) -> DataFrame:
    """Events of plain conversations: a user's turn is a call of the tool ``answer``, the turn after it its result.

    Each call builds on the one two turns before, if there is one. System turns are messages.
    """
    turn, user = F.col("turn").cast("long"), F.col("role") == "user"
    kind = F.when(user, "call").when(F.col("role") == "assistant", "result").otherwise("message")
    asked = F.when(user, turn).when(kind == "result", turn - 1)
    return conversations.select(
        "conv_id", turn.alias("turn"), F.lit(0).alias("part"), kind.alias("kind"), "role",
        F.concat(F.lit("c"), asked.cast("string")).alias("call_id"),
        F.when(user, "answer").alias("name"),
        F.when(user, F.to_json(F.struct(F.col("text").alias("prompt"), turn.alias("turn")))).alias("arguments"),
        F.when(user, F.array(F.concat(F.lit("c"), (turn - 2).cast("string")))).alias("after"),
        F.when(~user, F.col("text")).alias("content"),
    )


ANSWER_TOOL = {"answer": {"properties": {"prompt": {"type": "string"}, "turn": {"type": "integer"}}, "required": ["prompt", "turn"], "additionalProperties": False}}

def valid_arguments(tools: dict[str, dict], name: Column, arguments: Column) -> Column:
    """True if the arguments are a JSON object that fits the tool's schema; false for an unknown tool or broken JSON.

    Schemas with keywords that ``fits`` doesn't know raise ValueError here, when the query is built.
    """
    args = F.try_parse_json(arguments)
    out = F
    for tool, schema in tools.items():
        out = out.when(name == tool, fits({"type": "object"}, args) & fits(schema, args))
    found = F.lit(False) if out is F else out.otherwise(F.lit(False))
    return F.coalesce(args.isNotNull() & found, F.lit(False))


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls: 0 for those that build on no other, else one more than the highest they build on.

    Calls in a circle, and those that build on one, are left out. A call that has one edge left hands it on to the
    calls that build on it, so edges double their reach each round: chains and trees take as many rounds as their
    depth has binary digits. Calls that join several others wait for all of these. A round without a new level
    leaves circles alone.
    """
    key, target = ["conv_id", "call_id"], ["conv_id", "before"]
    named = calls.select(*key, F.explode(F.array_distinct("after")).alias("before"))
    edges = named.join(calls.select("conv_id", F.col("call_id").alias("before")), target, "left_semi")
    sources = calls.select(*key).join(edges, key, "left_anti").select(*key, F.lit(None).cast("string").alias("before"), F.lit(0).cast("long").alias("steps"))
    folder, n = shared_folder(calls.sparkSession, "call-levels"), 0
    now = _round(edges.select(*key, "before", F.lit(1).cast("long").alias("steps")).unionByName(sources), f"{folder}/round=0")
    while all(now.agg(F.count_if(F.col("open") == 0), F.count_if(F.col("open") > 0)).first()):
        n += 1
        settled = now.where("open = 0").select("conv_id", F.col("call_id").alias("before"), F.col("steps").alias("more"))
        waiting = now.where("open > 0")
        one = waiting.where("open = 1 and edges = 1").select(*key, "before", "steps").join(settled, target, "left")
        one = one.select(
            "conv_id", F.col("call_id").alias("before"), F.when(F.col("more").isNull(), F.col("before")).alias("next"),
            _added("steps", "more").alias("more"),
        )
        handed = one.unionByName(settled.withColumn("next", F.lit(None).cast("string")))
        ahead = waiting.where("before is not null").join(handed, target, "left")
        ahead = ahead.select(*key, F.when(F.col("more").isNull(), F.col("before")).otherwise(F.col("next")).alias("before"), _added("steps", "more").alias("steps"))
        now = _round(ahead.unionByName(waiting.where("before is null").select(*key, "before", "steps")), f"{folder}/round={n}")
    done = now.sparkSession.read.schema(now.schema).parquet(folder)
    return done.where("open = 0").select(*key, F.col("steps").alias("level"))


def _added(steps: str, more: str) -> Column:
    """The sum; kept from running over in circles, where it would double without end."""
    return F.least(F.col(steps) + F.coalesce(F.col(more), F.lit(0)), F.lit(2**61))


def _round(edges: DataFrame, path: str) -> DataFrame:
    """The longest edge from each call to each call before it, written, with how many edges a call has and how many are open.

    The target of an edge is null where it ends at a call that builds on nothing: a call that has no other has its level.
    """
    own = Window.partitionBy("conv_id", "call_id")
    longest = edges.repartition("conv_id", "call_id").groupBy("conv_id", "call_id", "before").agg(F.max("steps").alias("steps"))
    counted = longest.select("*", F.count("*").over(own).alias("edges"), F.count("before").over(own).alias("open"))
    counted.write.parquet(path)
    return counted.sparkSession.read.schema(counted.schema).parquet(path)


def link(events: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """One row per event: conv_id, turn, part, kind, call_id, status, level, valid, block, step and json.

    The first call of an id in a conversation, by turn and part, is the one that counts, and the first result after it.
    status of a call: linked, unanswered, duplicate (a later one of the id), or circular; of a result: linked, extra (a later
    one) or orphan (no call, or it comes before the call); of a message: message. Ids or conversations that are null never
    link. ``after`` may name calls of any turn of the conversation; names of calls that aren't there don't count. A level is
    above those of all calls that the call builds on, later turns' calls among them. In order of (block, level, step, turn, part) a
    conversation has every result after its call and every call after those of the same and earlier turns that it builds on.
    json has sorted keys, no white space, and no null members; arguments that aren't JSON stay as a string.
    Repeated rows stay repeated. An empty table gives an empty one.
    """
    at = F.struct("turn", "part")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    keyed = events.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    calls = keyed.where(is_call).groupBy("conv_id", "call_id").agg(F.min(at).alias("call_at"), F.min_by("after", at).alias("after"))
    calls = written(calls, "calls")
    results = keyed.where(is_result).select("conv_id", "call_id", at.alias("result_at")).join(calls.drop("after"), ["conv_id", "call_id"])
    results = results.where("result_at > call_at").groupBy("conv_id", "call_id").agg(F.min("result_at").alias("result_at"))
    heads = calls.drop("after").join(results, ["conv_id", "call_id"], "left").join(_levels(calls), ["conv_id", "call_id"], "left")
    heads = written(heads, "linked-calls")
    rows = events.join(heads, ["conv_id", "call_id"], "left")
    first = F.coalesce(at == F.col("call_at"), F.lit(False))
    call_status = (
        F.when(F.col("call_at").isNotNull() & ~first, "duplicate").when(first & F.col("level").isNull(), "circular")
        .when(F.col("result_at").isNotNull(), "linked").otherwise("unanswered")
    )
    result_status = F.when(F.col("result_at").isNull() | (at < F.col("call_at")), "orphan").when(at == F.col("result_at"), "linked").otherwise("extra")
    status = F.when(is_call, call_status).when(is_result, result_status).otherwise("message")
    valid = F.when(is_call, valid_arguments(tools, F.col("name"), F.col("arguments")))
    parsed = F.try_parse_json("arguments")
    body = F.struct(
        parsed.alias("arguments"), F.when(is_call | is_result, F.col("call_id")).alias("call_id"), "content", "name",
        F.when(parsed.isNull(), F.col("arguments")).alias("raw_arguments"), "role",
    )
    block = F.when(is_result & (status == "linked"), F.col("call_at.turn")).otherwise(F.col("turn"))
    step = F.when(is_call, 1).when(is_result, 2).otherwise(0)
    return rows.select(
        "conv_id", "turn", "part", "kind", "call_id", status.alias("status"), F.coalesce("level", F.lit(0)).alias("level"), valid.alias("valid"),
        block.alias("block"), step.alias("step"), F.to_json(body).alias("json"),
    )
