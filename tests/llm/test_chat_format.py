import json
import random

from pyspark.sql import functions as F

from glyphmill.llm import chat_format, queries

SCHEMA = "conv_id long, turn long, role string, text string"
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False},
    "scale": {"type": "object", "properties": {"by": {"type": "number"}}, "required": ["by"]},
}


def call(*calls):
    return json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments", "depends_on"), c)) for c in calls]})


def result(i, content="ok"):
    return json.dumps({"tool_call_id": i, "content": content})


def test_links_order_and_arguments(spark):
    rows = [
        (1, 0, "user", "find it"),
        (1, 1, "tool", result("a")),  # before its call
        (1, 2, "assistant", call(("a", "search", {"query": "x", "limit": 3}), ("b", "scale", {"by": 2}))),
        (1, 3, "assistant", call(("c", "search", {"limit": "many", "deep": True}, ["b"]))),  # needs a later result
        (1, 4, "user", "and then?"),
        (1, 5, "tool", result("b", {"z": 1, "a": [True, None]})),
        (1, 6, "tool", result("nobody")),
        (2, 0, "assistant", call(("a", "teleport", {}))),
        (2, 1, "assistant", '{"no": "calls"}'),
        (2, 2, "tool", "{broken"),
    ]
    out = chat_format.format_chats(spark.createDataFrame(rows, SCHEMA), TOOLS)
    got = {(r.conv_id, r.turn): r for r in out.collect()}
    order = [t for _, t in sorted((r.position, r.turn) for r in got.values() if r.conv_id == 1)]
    assert order == [0, 2, 1, 4, 5, 3, 6]
    assert [got[1, t].link for t in range(7)] == [None, "linked", "answered", "open", None, "linked", "orphan"]
    assert got[1, 2].errors == "" and got[1, 3].errors == "0:missing:query;0:type:limit;0:unknown:deep" and got[2, 0].errors == "0:tool:teleport"
    assert got[1, 5].message_json == '{"conv_id":1,"data":{"content":{"a":[true,null],"z":1},"tool_call_id":"b"},"position":4,"role":"tool","turn":5}'
    assert json.loads(got[2, 2].message_json) == {"content": "{broken", "conv_id": 2, "position": 2, "role": "tool", "turn": 2}


def test_cycles_chains_and_odd_rows(spark):
    rows = [(1, 0, "assistant", call(("a", "t", {}, ["b"]))), (1, 1, "tool", result("a")), (1, 2, "assistant", call(("b", "t", {}, ["a"]))), (1, 3, "tool", result("b"))]
    rows += [(2, 0, "tool", result("c2")), (2, 0, "assistant", call(("c2", "t", {}, ["c1"]))), (2, 0, "tool", result("c1")), (2, 0, "assistant", call(("c1", "t", {})))]
    rows += [(None, None, None, None), (None, 3, "user", "x"), (3, 1, "user", "same"), (3, 1, "user", "same"), (3, None, "system", "")]
    out = chat_format.format_chats(spark.createDataFrame(rows, SCHEMA).withColumn("position", F.lit("clash"))).collect()
    assert len(out) == len(rows)
    assert [r.position for r in sorted((r for r in out if r.conv_id == 1), key=lambda r: r.turn)] == [0, 1, 2, 3]
    assert {r.link for r in out if r.conv_id == 1} == {"cyclic"}
    two = [json.loads(r.message_json)["data"] for r in sorted((r for r in out if r.conv_id == 2), key=lambda r: r.position)]
    assert [d.get("tool_call_id") or d["tool_calls"][0]["id"] for d in two] == ["c1", "c1", "c2", "c2"]
    for conv in (None, 1, 2, 3):
        assert sorted(r.position for r in out if r.conv_id == conv) == list(range(sum(r.conv_id == conv for r in out)))
    assert [r.role for r in sorted((r for r in out if r.conv_id == 3), key=lambda r: r.position)] == ["system", "user", "user"]
    assert chat_format.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nested_schemas(spark):
    tools = {
        "book": {
            "type": "object",
            "properties": {
                "class": {"enum": ["first", 2, None]},
                "who": {"type": "array", "items": {"type": "object", "properties": {"name": {"type": "string"}, "age": {"type": ["integer", "null"]}}, "required": ["name"]}},
                "where": {"type": "object", "properties": {"at.x": {"type": "number"}}, "additionalProperties": False},
            },
        },
        "any": {},
    }
    given = [
        ("book", {"class": "first", "who": [{"name": "a", "age": 3}, {"name": "b", "age": None}], "where": {"at.x": 1.5}, "more": 1}),
        ("book", {"class": "third", "who": [{"name": 1}, {"age": "x"}, 5], "where": {"at.x": "no", "y": 1}}),
        ("book", {"class": None, "who": {}, "where": None}),
        ("book", [1]), ("book", None), ("any", {"x": 1}), (None, {}),
    ]
    text = json.dumps({"tool_calls": [{"id": str(i), "name": n} | ({} if a is None else {"arguments": a}) for i, (n, a) in enumerate(given)]})
    rows = [(1, 0, "assistant", text), (1, 1, "assistant", json.dumps({"tool_calls": [{"id": "x", "name": "book", "arguments": given[0][1]}]}))]
    out = {r.turn: r.errors for r in chat_format.format_chats(spark.createDataFrame(rows, SCHEMA), tools).collect()}
    assert out[1] == ""
    assert out[0].split(";") == sorted([
        "1:enum:class", "1:type:who.0.name", "1:missing:who.1.name", "1:type:who.1.age", "1:type:who.2", "1:type:where.at.x", "1:unknown:where.y",
        "2:type:who", "2:type:where", "3:type:", "6:tool:",
    ])


def test_long_chains_beside_a_cycle(spark):
    """Chains of any length are placed as a whole; only what is on or behind a cycle is cyclic."""
    rows = [(1, 0, "assistant", call(("a", "t", {}, ["a"]))), (1, 1, "tool", result("a")), (1, 2, "assistant", call(("b", "t", {}, ["a"]))), (1, 3, "user", "x")]
    rows += [(2, 600 - i, "assistant", call((f"c{i}", "t", {}, [f"c{i - 1}"] if i else []))) for i in range(250)] + [(2, None, "tool", result(f"c{i}")) for i in range(250)]
    out = chat_format.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r.link for r in sorted((r for r in out if r.conv_id == 1), key=lambda r: r.turn)] == ["cyclic"] * 3 + [None]
    chain = sorted((r for r in out if r.conv_id == 2), key=lambda r: r.position)
    data = [json.loads(r.message_json)["data"] for r in chain]
    assert [d.get("tool_call_id") or d["tool_calls"][0]["id"] for d in data] == [f"c{i}" for i in range(250) for _ in range(2)]
    assert [r.link for r in chain] == ["answered", "linked"] * 250
    assert [r.position for r in chain] == list(range(500))


def test_order_follows_brute_force(spark):
    """Random dependencies, cycles included: places by repeated relaxation."""
    rng = random.Random(3)
    rows = []
    for conv in range(30):
        n = rng.randint(1, 9)
        for i in range(n):
            needs = [f"k{rng.randrange(n)}" for _ in range(rng.choice([0, 1, 1, 2, 3]))] if conv % 3 == 0 else [f"k{rng.randrange(i)}" for _ in range(rng.choice([0, 1, 2, 2])) if i]
            rows.append((conv, rng.choice([None, *range(20)]), "assistant", call((f"k{i}", "t", {}, needs))))
            if rng.random() < 0.9:
                rows.append((conv, rng.choice([None, *range(20)]), "tool", result(f"k{i}")))
    out = chat_format.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()
    for conv in range(30):
        own = [r for r in rows if r[0] == conv]
        texts = [json.loads(r[3]) for r in own]
        call_of = {t["tool_calls"][0]["id"]: i for i, t in enumerate(texts) if "tool_calls" in t}
        result_of = {t["tool_call_id"]: i for i, t in enumerate(texts) if "tool_call_id" in t}
        before = [[call_of[t["tool_call_id"]]] if "tool_call_id" in t else [result_of[x] for x in set(t["tool_calls"][0]["depends_on"]) if x in result_of] for t in texts]
        done: dict[int, tuple] = {}
        while ready := [i for i in range(len(own)) if i not in done and all(b in done for b in before[i])]:
            for i in ready:
                done[i] = max([(-1 if own[i][1] is None else own[i][1], 0), *((done[b][0], done[b][1] + 1) for b in before[i])])
        key = lambda i: (done.get(i) or (-1 if own[i][1] is None else own[i][1], 0), own[i][1] is not None, own[i][1] or 0, own[i][2])
        got = sorted((r for r in out if r.conv_id == conv), key=lambda r: r.position)
        assert [(r.turn, r.role, r.link == "cyclic") for r in got] == [(own[i][1], own[i][2], i not in done) for i in sorted(range(len(own)), key=key)]


def test_whole_table(spark, sf_dir, duck):
    got = sorted(tuple(r) for r in queries.op3_chat_format(spark, sf_dir).select("conv_id", "turn", "position", "message_json").collect())
    assert got == sorted(duck(sf_dir).sql(f"select conv_id, turn, position, message_json from ({queries.ORACLE_OP3})").fetchall())


def test_plan_is_native(spark, small_dir):
    plan = queries.op3_chat_format(spark, small_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
