"""Chat formatting with linked tool calls (native)."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.shared import materialise

#: What a tool's schema may say; other words are refused rather than ignored.
SCHEMA_WORDS = {"type", "properties", "required", "additionalProperties", "enum", "items", "description"}


def _json_type(kind: Column) -> Column:
    return (
        F.when(kind == "BIGINT", "integer").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string").when(kind == "VOID", "null")
        .when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise("number")
    )


def _calls(messages: DataFrame) -> DataFrame:
    """A row per tool call of assistant messages ``{"tool_calls": [{"id", "name", "arguments", "depends_on"}]}``."""
    asked = messages.where((F.col("role") == "assistant") & F.startswith(F.ltrim("text"), F.lit("{")))
    asked = asked.select("mid", "conv", F.try_variant_get(F.try_parse_json("text"), "$.tool_calls", "array<variant>").alias("calls"))
    rows = asked.select("mid", "conv", F.posexplode("calls").alias("pos", "call"))
    get = lambda path, kind: F.try_variant_get("call", path, kind)
    return rows.select(
        "mid", "conv", "pos", get("$.id", "string").alias("call_id"), get("$.name", "string").alias("name"),
        get("$.arguments", "variant").alias("args"), get("$.depends_on", "array<string>").alias("depends_on"),
    )


def _results(messages: DataFrame) -> DataFrame:
    """Tool messages ``{"tool_call_id": ...}``."""
    told = messages.where((F.col("role") == "tool") & F.startswith(F.ltrim("text"), F.lit("{")))
    return told.select("mid", "conv", F.try_variant_get(F.try_parse_json("text"), "$.tool_call_id", "string").alias("call_id"))


def _misfits(value: Column, schema: Mapping, path: Column | None = None) -> Column:
    """``kind:path`` for each part of a variant that its schema doesn't allow."""
    if unknown := set(schema) - SCHEMA_WORDS:
        raise ValueError(f"not understood in a tool's schema: {sorted(unknown)}")
    here = F.lit("") if path is None else path
    below = lambda name: name if path is None else F.concat(path, F.lit("."), name)
    none = F.array().cast("array<string>")
    kind, found = _json_type(F.schema_of_variant(value)), [none]
    if "enum" in schema:
        known = [json.dumps(x, separators=(",", ":"), ensure_ascii=False) for x in schema["enum"]]
        found.append(F.when(~F.to_json(value).isin(*known), F.array(F.concat(F.lit("enum:"), here))).otherwise(none))
    for name, inner in schema.get("properties", {}).items():
        part, at = F.try_variant_get(value, f"$[{json.dumps(name)}]", "variant"), below(F.lit(name))
        absent = F.array(F.concat(F.lit("missing:"), at)) if name in schema.get("required", ()) else none
        found.append(F.when(kind != "object", none).when(part.isNull(), absent).otherwise(_misfits(part, inner, at)))
    if schema.get("additionalProperties", True) is False:
        keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
        more = F.filter(keys, lambda k: ~k.isin(*schema.get("properties", {"": None})))
        found.append(F.when(kind == "object", F.transform(more, lambda k: F.concat(F.lit("unknown:"), below(k)))).otherwise(none))
    if "items" in schema:
        items = F.try_variant_get(value, "$", "array<variant>")
        each = F.transform(items, lambda x, i: _misfits(x, schema["items"], below(i.cast("string"))))
        found.append(F.when(kind == "array", F.flatten(each)).otherwise(none))
    inner = F.concat(*found)
    if "type" not in schema:
        return inner
    kinds = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
    fits = kind.isin(*kinds, *(["integer"] if "number" in kinds else []))
    return F.when(fits, inner).otherwise(F.array(F.concat(F.lit("type:"), here)))


def _errors(calls: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """``(mid, errors)``: what each call's arguments, absent ones being an empty object, miss of its tool's schema."""
    args = F.coalesce("args", F.parse_json(F.lit("{}")))
    found = F.array(F.concat(F.lit("tool:"), F.coalesce("name", F.lit(""))))
    for tool, schema in schemas.items():
        found = F.when(F.col("name") == tool, _misfits(args, schema)).otherwise(found)
    tagged = calls.select("mid", "pos", found.alias("found"))
    tagged = tagged.select("mid", F.transform("found", lambda x: F.concat(F.col("pos").cast("string"), F.lit(":"), x)).alias("found"))
    return tagged.groupBy("mid").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("errors"))


def _later(place: Column, steps: Column | int) -> Column:
    """A place some links further down."""
    return F.struct(place["at"].alias("at"), (place["level"] + steps).alias("level"))


def _order(messages: DataFrame, edges: DataFrame) -> DataFrame:
    """``(mid, at, level)`` of messages on the edges ``(before, after)``, in topological order.

    A message is placed not before any that must precede it, and one level
    below the latest of these; null marks messages on a cycle or behind one.

    Messages with one predecessor form chains.  Each round doubles how far such
    a message looks back, so chains of any length take few rounds; those that
    a round brings no nearer to a chain's head go round in a cycle.  Messages
    with several predecessors then are placed once all of these are, a round
    for each that waits for another.
    """
    nodes = edges.select(F.col("before").alias("mid")).unionByName(edges.select(F.col("after").alias("mid"))).distinct()
    waits = edges.groupBy(F.col("after").alias("mid")).agg(F.count("*").alias("open"), F.min("before").alias("to"))
    place = F.struct(F.coalesce("turn", F.lit(-1)).cast("long").alias("at"), F.lit(0).alias("level")).alias("place")
    own = messages.select("mid", place).join(nodes, "mid").join(waits, "mid", "left").select("mid", "place", F.coalesce("open", F.lit(0)).alias("open"), "to")
    own = materialise(own, "chat-nodes")
    chained = own.where("open = 1").select("mid", "place", "to", F.lit(1).alias("steps"))
    heads = own.where("open = 1").select(F.col("mid").alias("to")).withColumn("open", F.lit(True))
    now = materialise(chained.join(heads, "to", "left").select("mid", "place", "to", "steps", F.coalesce("open", F.lit(False)).alias("open")), "chat-chains")
    left, before = now.where("open").count(), -1
    while left and left != before:
        back = now.select(F.col("mid").alias("to"), F.col("place").alias("p"), F.col("to").alias("t"), F.col("steps").alias("s"), F.col("open").alias("o"))
        jumped = now.where("open").join(back, "to").select(
            "mid", F.greatest("place", _later(F.col("p"), F.col("steps"))).alias("place"), F.col("t").alias("to"), (F.col("steps") + F.col("s")).alias("steps"), F.col("o").alias("open")
        )
        now = materialise(now.where("not open").unionByName(jumped), "chat-chains")
        left, before = now.where("open").count(), left
    settled = now.where("not open").drop("open")
    ends = own.where("open <> 1").select("mid", F.when(F.col("open") == 0, F.col("place")).alias("done"))
    joins = own.where("open > 1").select("mid", "place", "open")
    if not joins.isEmpty():
        ends = ends.where("done is not null").unionByName(_joined(own, joins, settled, edges))
    reached = settled.join(ends.withColumnsRenamed({"mid": "to"}), "to", "left")
    reached = reached.select("mid", F.when(F.col("done").isNotNull(), F.greatest("place", _later(F.col("done"), F.col("steps")))).alias("done"))
    stuck = now.where("open").select("mid", F.lit(None).cast("struct<at:long,level:int>").alias("done"))
    return ends.unionByName(reached).unionByName(stuck).select("mid", "done.at", "done.level")


def _joined(own: DataFrame, joins: DataFrame, settled: DataFrame, edges: DataFrame) -> DataFrame:
    """``(mid, done)`` of messages with several predecessors, null where these are never all placed."""
    into = edges.join(joins.select(F.col("mid").alias("after")), "after", "left_semi")
    direct = own.where("open <> 1").select(F.col("mid").alias("before"), F.col("mid").alias("source"), F.lit(None).cast("struct<at:long,level:int>").alias("least"), F.lit(1).alias("steps"))
    chained = settled.select(F.col("mid").alias("before"), F.col("to").alias("source"), _later(F.col("place"), 1).alias("least"), (F.col("steps") + 1).alias("steps"))
    links = materialise(into.join(direct.unionByName(chained), "before").select("source", "after", "least", "steps"), "chat-joins")
    fresh = own.where("open = 0").select("mid", F.col("place").alias("done"))
    now = materialise(joins.withColumn("done", F.lit(None).cast("struct<at:long,level:int>")).withColumn("fresh", F.lit(False)), "chat-placed")
    while True:
        pushed = links.join(fresh.select(F.col("mid").alias("source"), "done"), "source").groupBy(F.col("after").alias("mid"))
        pushed = pushed.agg(F.count("*").alias("n"), F.max(F.greatest("least", _later(F.col("done"), F.col("steps")))).alias("least"))
        new = now.join(pushed, "mid", "left").withColumns({"left": F.col("open") - F.coalesce("n", F.lit(0)), "best": F.greatest("place", "least")})
        ready = (F.col("left") == 0) & (F.col("open") > 0)
        new = new.select("mid", F.col("best").alias("place"), F.col("left").alias("open"), F.when(ready, F.col("best")).otherwise(F.col("done")).alias("done"), ready.alias("fresh"))
        now = materialise(new, "chat-placed")
        fresh = now.where("fresh").select("mid", "done")
        if fresh.isEmpty():
            return now.select("mid", "done")


def format_chats(
    conversations: DataFrame,
    schemas: Mapping[str, Mapping] | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """A row per message: its place in the conversation, its links, and canonical JSON.

    Assistant messages whose text is a JSON object with ``tool_calls`` (each with
    ``id``, ``name``, ``arguments``, and perhaps ``depends_on``, ids whose
    results it needs) hold calls; tool messages whose text is a JSON object
    with ``tool_call_id`` hold results; all others are plain.  Results are
    joined with the first call of that id in their conversation, and messages
    put in topological order: by turn, but a result never before its call, and
    a call never before the results it depends on.  ``position`` counts from 0.

    ``link`` is null for plain messages, ``linked`` or ``orphan`` for results,
    ``answered`` or ``open`` for calls (all answered or not), ``cyclic`` for
    messages that wait for themselves or for such (they keep their turn).  ``errors`` tells
    where arguments miss their tool's JSON schema (``type``, ``properties``,
    ``required``, ``additionalProperties: false``, ``enum`` and ``items``, to any
    depth), as ``call:kind:path`` joined by semicolons, and which tools have
    none; null for messages without calls.

    ``message_json`` has sorted keys, no spaces and no null fields; a JSON text
    is given as a value with its keys sorted too, other text as ``content``.

    Nulls may stand anywhere: a null turn comes first, and a null conversation
    is one more.  Equal turns go by role, then by place in the table.  No task
    needs a whole conversation: positions come from a range sort and the counts
    of each conversation in each of its partitions.
    """
    names = {conv_col: "conv", turn_col: "turn", role_col: "role", text_col: "text"}
    messages = conversations.select(*[F.col(c).alias(n) for c, n in names.items()]).withColumn("mid", F.monotonically_increasing_id())
    messages = materialise(messages, "chat-messages")
    calls = _calls(messages)
    results = _results(messages).where("call_id is not null")
    calls, results = materialise(calls, "chat-calls-plain"), materialise(results, "chat-results")
    extra = None
    if not (calls.isEmpty() and results.isEmpty()):
        first = calls.where("call_id is not null").groupBy("conv", "call_id").agg(F.min("mid").alias("call_mid"))
        pair = results.join(first.hint("shuffle_hash"), (results["conv"].eqNullSafe(first["conv"])) & (results["call_id"] == first["call_id"]), "left").select("mid", results["conv"], results["call_id"], "call_mid")
        pair = materialise(pair, "chat-pairs")
        needs = calls.select(F.col("mid").alias("after"), F.col("conv").alias("c"), F.explode("depends_on").alias("need"))
        waits = needs.join(pair.hint("shuffle_hash"), F.col("c").eqNullSafe(F.col("conv")) & (F.col("need") == F.col("call_id"))).select(F.col("mid").alias("before"), "after")
        edges = pair.where("call_mid is not null").select(F.col("call_mid").alias("before"), F.col("mid").alias("after")).unionByName(waits).where("before <> after").distinct()
        order = _order(messages, materialise(edges, "chat-edges"))
        answered = calls.select("mid", "conv", "call_id").join(
            pair.where("call_mid is not null").select(F.col("conv").alias("pc"), F.col("call_id").alias("pi")).distinct(),
            F.col("conv").eqNullSafe(F.col("pc")) & (F.col("call_id") == F.col("pi")), "left",
        ).groupBy("mid").agg(F.min(F.col("pi").isNotNull()).alias("all"))
        link = answered.select("mid", F.when(F.col("all"), "answered").otherwise("open").alias("link")).unionByName(
            pair.select("mid", F.when(F.col("call_mid").isNotNull(), "linked").otherwise("orphan").alias("link"))
        )
        errors = calls.select("mid").distinct().join(_errors(calls, schemas or {}), "mid", "left").select("mid", F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))
        extra = materialise(link.join(order.withColumn("ordered", F.lit(True)), "mid", "left").join(errors, "mid", "left"), "chat-links")
    none = {"link": "string", "at": "long", "level": "int", "ordered": "boolean", "errors": "array<string>"}
    rows = messages.join(extra, "mid", "left") if extra is not None else messages.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    rows = rows.withColumn("link", F.when(F.col("ordered") & F.col("at").isNull(), "cyclic").otherwise(F.col("link")))
    key = [F.col("conv"), F.coalesce("at", "turn", F.lit(-1)).alias("k1"), F.coalesce("level", F.lit(0)).alias("k2"), F.col("turn"), F.col("role"), F.col("mid")]
    rows = rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("seq", F.monotonically_increasing_id())
    rows = materialise(rows.withColumn("part", F.shiftright("seq", 33)), "chat-sorted")
    held = rows.groupBy("conv", "part").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("conv").alias("hc"), F.col("part").alias("hp"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    rows = rows.join(held, F.col("conv").eqNullSafe(F.col("hc")) & (F.col("part") == F.col("hp")))
    rows = rows.withColumn("position", F.col("earlier") + F.col("seq") - F.col("first"))
    value = F.when(F.col("link").isNotNull(), F.try_parse_json("text"))
    body = F.struct(
        F.when(F.col("link").isNull(), F.col("text")).alias("content"), F.col("conv").alias("conv_id"), value.alias("data"), "position", "role", "turn"
    )
    return rows.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "position", "link",
        F.array_join("errors", ";").alias("errors"), F.to_json(body).alias("message_json"),
    )
