"""Chat formatting: tool calls and results are linked, ordered, checked and written as canonical JSON.

DataFrame functions only. A message's text may be a JSON object: an assistant's with "tool_calls", a list of
{id, name, arguments}, and a tool's with "tool_call_id" and "content". Beside these, every user's turn counts
as a call of the tool "respond" with the argument "prompt", and the assistant's turn right after it, if it
makes no calls, as its result. An argument of the form "$id", anywhere in a call's arguments, is the result of
the call with that identifier, so such calls come after the results that they use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Of each tool, its parameters: JSON type, and optionally required, minimum, maximum, min_length, max_length, enum.
SCHEMAS = {"respond": {"prompt": {"type": "string", "required": True, "min_length": 1}}}
_KINDS = {"string": "STRING", "integer": "BIGINT", "number": "DECIMAL|DOUBLE|FLOAT|BIGINT", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY"}


def items(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, place, kind, id, name, arguments, content) of messages, calls and results; place is theirs in their message.

    A text that isn't the JSON described above is plain content. Null texts count as empty, null roles as
    "unknown". Messages of an unknown conversation or turn are kept, but have no ids and link with nothing.
    """
    m = conversations.select(
        F.col("conv_id").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    parsed = F.when(F.col("role").isin("assistant", "tool") & F.col("text").startswith("{"), F.try_parse_json("text"))
    m = m.withColumn("v", parsed)
    calls = F.when(F.col("role") == "assistant", F.try_variant_get("v", "$.tool_calls", "array<variant>"))
    result_of = F.when(F.col("role") == "tool", F.try_variant_get("v", "$.tool_call_id", "string"))
    plain_id = lambda turn: F.concat(F.lit("turn "), F.col("conv_id").cast("string"), F.lit("."), turn.cast("string"))
    none = F.lit(None).cast("string")

    def item(kind: str, id_: Column, name: Column, arguments: Column, content: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), id_.alias("id"), name.alias("name"), arguments.alias("arguments"), content.alias("content"))

    explicit = F.transform(
        calls,
        lambda c: item(
            "call", F.try_variant_get(c, "$.id", "string"), F.try_variant_get(c, "$.name", "string"),
            # arguments may be an object or, as some services write it, a string that holds one
            F.to_json(F.coalesce(F.try_parse_json(F.try_variant_get(c, "$.arguments", "string")), F.try_variant_get(c, "$.arguments", "variant"))), none,
        ),
    )
    said = F.try_variant_get("v", "$.content", "string")
    one = (
        F.when(result_of.isNotNull(), F.array(item("result", result_of, none, none, F.coalesce(said, F.lit("")))))
        .when(F.size(calls) > 0, F.concat(explicit, F.when(F.length(said) > 0, F.array(item("message", none, none, none, said))).otherwise(F.array().cast("array<struct<kind:string,id:string,name:string,arguments:string,content:string>>"))))
        .when(F.col("role") == "user", F.array(item("call", plain_id(F.col("turn")), F.lit("respond"), F.to_json(F.struct(F.col("text").alias("prompt"))), none)))
        .when(F.col("role") == "assistant", F.array(item("result", plain_id(F.col("turn") - 1), none, none, F.col("text"))))
        .otherwise(F.array(item("message", none, none, none, F.col("text"))))
    )
    return m.select("conv_id", "turn", "role", F.posexplode(one).alias("place", "i")).select("conv_id", "turn", "role", "place", "i.*")


def problems(schemas: dict) -> Column:
    """Sorted problems of a call's arguments under its tool's schema; empty for other items."""
    v = F.try_parse_json("arguments")
    found = []
    for tool, parameters in sorted(schemas.items()):
        of_tool = (F.col("kind") == "call") & (F.col("name") == tool)
        for p, rule in sorted(parameters.items()):
            path = "$." + p
            value = F.try_variant_get(v, path, "variant")
            there = value.isNotNull() & ~F.is_variant_null(value)
            kind = F.schema_of_variant(value)
            text, number = F.try_variant_get(v, path, "string"), F.try_variant_get(v, path, "double")

            def when(bad: Column, what: str, of_tool=of_tool, p=p) -> None:
                found.append(F.when(of_tool & F.coalesce(bad, F.lit(False)), F.lit(f"{p}: {what}")))

            if rule.get("required"):
                when(~there, "missing")
            when(there & ~kind.rlike(f"^({_KINDS[rule['type']]})"), "not of type " + rule["type"])
            for key, what, bad in (
                ("minimum", "too small", lambda x: number < x), ("maximum", "too large", lambda x: number > x), ("min_length", "too short", lambda x: F.length(text) < x),
                ("max_length", "too long", lambda x: F.length(text) > x), ("enum", "not allowed", lambda x: ~text.isin(*x)),
            ):
                if key in rule:
                    when(there & bad(rule[key]), what)
    found.append(F.when((F.col("kind") == "call") & ~F.coalesce(F.col("name").isin(*schemas), F.lit(False)), F.lit("unknown tool")))
    found.append(F.when((F.col("kind") == "call") & v.isNull(), F.lit("arguments: not JSON")))
    return F.array_sort(F.array_compact(F.array(*found)))


def _place(turn: Column, step: Column, depth: Column) -> Column:
    return F.struct(turn.cast("long").alias("turn"), step.cast("long").alias("step"), depth.cast("int").alias("depth"))


def _behind(own: Column, other: Column) -> Column:
    """Its own place if that is behind the other, else the one right behind the other."""
    return F.when(own > other, own).otherwise(_place(other["turn"], other["step"], other["depth"] + 1))


def _result_place(call: Column, own: Column) -> Column:
    """A result's place given its call's: its own if that is behind, else right behind the call."""
    return F.when(own > call, own).when(call["depth"] == 0, _place(call["turn"], call["step"] + 1, F.lit(0))).otherwise(_place(call["turn"], call["step"], call["depth"] + 1))


def moved_calls(own: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, id, place, cyclic) of the calls that use results of others, in topological order.

    own are the items, ids the calls and results of each identifier. Rounds of one join each place the calls
    all of whose sources are placed, so that a chain takes as many rounds as it is long; without references
    nothing is run. Calls that no round can place lie on a cycle, or use one that does: they keep their own
    place and are marked. References to identifiers that are unknown or not one call's are no sources.
    """
    single = ids.where("calls = 1")
    refs = F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(r'"\$((?:[^"\\]|\\.)*)"'), F.lit(1))))
    uses = own.where("kind = 'call' and id is not null and conv_id is not null").where(F.col("arguments").contains('"$')).select("conv_id", "id", refs.alias("source"))
    uses = uses.join(single.select("conv_id", "id"), ["conv_id", "id"]).join(single.select("conv_id", F.col("id").alias("source")), ["conv_id", "source"])
    uses = materialise(uses.select("conv_id", "id", "source").distinct(), "chat-uses")
    if uses.isEmpty():
        return uses.select("conv_id", "id", F.lit(None).cast("struct<turn:bigint,step:bigint,depth:int>").alias("place"), F.lit(False).alias("cyclic")).limit(0)
    # the calls that take part, with their own places and those of their results
    nodes = uses.select("conv_id", "id").union(uses.select("conv_id", "source")).distinct().join(single, ["conv_id", "id"])
    nodes = materialise(nodes.select("conv_id", "id", "call_place", "result_place", (F.col("results") == 1).alias("answered")), "chat-nodes")
    placed = nodes.join(uses, ["conv_id", "id"], "left_anti").select("conv_id", "id", F.col("call_place").alias("place"))
    placed = materialise(placed, "chat-placed")
    known = 0
    while (now := placed.count()) > known:  # a round that places nothing is the last
        known = now
        end = F.when(F.col("answered"), _result_place(F.col("place"), F.col("result_place"))).otherwise(F.col("place"))
        ends = placed.join(nodes, ["conv_id", "id"]).select("conv_id", F.col("id").alias("source"), end.alias("end"))
        open_ = uses.join(placed.select("conv_id", "id"), ["conv_id", "id"], "left_anti").join(ends, ["conv_id", "source"], "left")
        ready = open_.groupBy("conv_id", "id").agg(F.count_if(F.col("end").isNull()).alias("missing"), F.max("end").alias("end")).where("missing = 0")
        ready = ready.join(nodes, ["conv_id", "id"]).select("conv_id", "id", _behind(F.col("call_place"), F.col("end")).alias("place"))
        placed = materialise(placed.union(ready), "chat-placed")
    return nodes.join(placed, ["conv_id", "id"], "left").select("conv_id", "id", F.coalesce("place", "call_place").alias("place"), F.col("place").isNull().alias("cyclic"))


def format_chat(conversations: DataFrame, schemas: dict | None = None) -> DataFrame:
    """One row per message, call and result: conv_id, turn, order_turn, order_step, order_depth, kind, id, status, valid, problems, json.

    Calls and results of a conversation are joined by identifier. status is answered, open, ambiguous (its id
    occurs on several calls or results) or cyclic (it uses, on whatever way, its own result) for calls,
    linked, orphan or ambiguous for results and plain for messages. Ordered by (order_turn, order_step,
    order_depth), each call comes before its result and after the results that its arguments name; an
    ambiguous result comes behind the first call of its id. Items that need not move stand where they are
    said, in the order of their message. valid tells whether the arguments meet the tool's schema. json has
    its keys in alphabetical order and no white space; keys without a value are left out. Repeated rows are
    kept; an empty table gives no rows.
    """
    own = materialise(items(conversations), "chat-items")
    place = _place(F.col("turn"), F.col("place") * 2, F.lit(0))
    of = lambda kind: F.when(F.col("kind") == kind, place)
    ids = own.where("id is not null and conv_id is not null").groupBy("conv_id", "id")
    ids = ids.agg(F.count_if(F.col("kind") == "call").alias("calls"), F.count_if(F.col("kind") == "result").alias("results"), F.min(of("call")).alias("call_place"), F.min(of("result")).alias("result_place"))
    ids = materialise(ids, "chat-ids")
    moved = moved_calls(own, ids)
    own = own.withColumn("own_place", place).drop("place").join(ids.drop("result_place"), ["conv_id", "id"], "left").join(moved, ["conv_id", "id"], "left")
    twice = (F.col("calls") > 1) | (F.col("results") > 1)
    status = (
        F.when(F.col("kind") == "message", "plain").when(twice, "ambiguous")
        .when(F.coalesce("cyclic", F.lit(False)) & (F.col("kind") == "call"), "cyclic")
        .when(F.col("kind") == "call", F.when(F.col("results") == 1, "answered").otherwise("open"))
        .otherwise(F.when(F.col("calls") == 1, "linked").otherwise("orphan"))
    )
    own = own.withColumn("status", status).withColumn("problems", problems(SCHEMAS if schemas is None else schemas))
    call = F.coalesce("place", "call_place")
    order = F.when((F.col("kind") == "call") & (F.col("calls") == 1), call).when((F.col("kind") == "result") & (F.col("calls") > 0) & F.col("call_place").isNotNull(), _result_place(call, F.col("own_place")))
    own = own.withColumn("order", F.coalesce(order, F.col("own_place")))
    line = F.to_json(
        F.struct(
            F.try_parse_json("arguments").alias("arguments"), F.col("content").alias("content"), F.col("conv_id").alias("conversation"), "id", F.col("kind").alias("kind"),
            "name", "role", "status", "turn",
        )
    )
    return own.select(
        "conv_id", "turn", F.col("order.turn").alias("order_turn"), F.col("order.step").alias("order_step"), F.col("order.depth").alias("order_depth"),
        "kind", "id", "status", (F.size("problems") == 0).alias("valid"), F.array_join("problems", "; ").alias("problems"), line.alias("json"),
    )
