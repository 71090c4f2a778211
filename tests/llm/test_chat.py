import json
import random

import pytest

from tarnseek.llm import chat
from tarnseek.llm.registered import QUERIES, SQL
from tests.compare import TESTDATA, connect, differences

TOOLS = {
    "find": {"properties": {"q": {"type": "string"}, "n": {"type": "integer"}, "deep": {"type": "boolean"}, "how": {"type": "string", "enum": ["a", "b"]}}, "required": ["q"], "additionalProperties": False},
    "free": {"properties": {"x": {"type": "number"}, "o": {"type": "object"}, "l": {"type": "array"}}},
}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    path = f"{TESTDATA}/{sf}"
    df = QUERIES["op7_chat_format"](spark, path)
    assert differences(df, connect(path), SQL["op7_chat_format"]) == []
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def linked(spark, turns):
    """turns: (conv_id, turn, role, text or object)."""
    rows = [(c, t, r, x if x is None or isinstance(x, str) else json.dumps(x), "x", 1) for c, t, r, x in turns]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, status string, level int")
    return chat.link(chat.events_of(df), TOOLS)


def calls(*entries):
    return {"tool_calls": [{"id": i, "name": n, "arguments": a, **({"after": after} if after else {})} for i, n, a, after in entries]}


def result(i, text):
    return {"tool_call_id": i, "content": text}


def test_links_and_order(spark):
    out = linked(
        spark,
        [
            (1, 0, "user", "hello"),
            (1, 1, "assistant", calls(("b", "find", {"q": "two"}, ["a"]), ("a", "find", {"q": "one"}, None), ("c", "find", {"q": "x"}, ["b", "nowhere"]))),
            (1, 2, "tool", result("b", "B")), (1, 3, "tool", result("a", "A")), (1, 4, "tool", result("a", "again")), (1, 5, "tool", result("zzz", "?")),
            (1, 6, "assistant", calls(("a", "find", {"q": "later"}, None))),
            (2, 0, "tool", result("a", "too early")), (2, 1, "assistant", calls(("a", "find", {"q": "q"}, None))),
            (3, 0, "assistant", calls(("p", "find", {"q": "q"}, ["r"]), ("r", "find", {"q": "q"}, ["p"]), ("s", "find", {"q": "q"}, ["p"]))),
        ],
    )
    rows = {(r["conv_id"], r["turn"], r["part"]): r for r in out.collect()}
    status = {k: r["status"] for k, r in rows.items()}
    assert status == {
        (1, 0, 0): "message", (1, 1, 0): "linked", (1, 1, 1): "linked", (1, 1, 2): "unanswered", (1, 2, 0): "linked", (1, 3, 0): "linked",
        (1, 4, 0): "extra", (1, 5, 0): "orphan", (1, 6, 0): "duplicate", (2, 0, 0): "orphan", (2, 1, 0): "unanswered",
        (3, 0, 0): "circular", (3, 0, 1): "circular", (3, 0, 2): "circular",
    }
    order = sorted((r for r in rows.values() if r["conv_id"] == 1), key=lambda r: (r["block"], r["level"], r["step"], r["turn"], r["part"]))
    assert [(r["kind"], r["call_id"]) for r in order][:6] == [("message", None), ("call", "a"), ("result", "a"), ("call", "b"), ("result", "b"), ("call", "c")]


def test_long_chain_of_calls(spark):
    entries = [(f"c{i}", "find", {"q": "x"}, [f"c{i - 1}"] if i else None) for i in range(6)]
    out = linked(spark, [(1, 0, "assistant", calls(*reversed(entries)))])
    assert {r["call_id"]: r["level"] for r in out.collect()} == {f"c{i}": i for i in range(6)}


def test_circle_over_turns(spark):
    def one(turn, i, after):
        return (1, turn, "assistant", calls((i, "find", {"q": "x"}, after)))

    turns = [one(1, "a", ["b"]), one(3, "b", ["a"]), one(5, "on", ["b"]), one(6, "p", ["r"]), one(7, "q", ["p"]), one(8, "r", ["q"]), one(9, "self", ["self", "free"])]
    turns += [one(10, "free", None), one(11, "both", ["free", "a"]), one(0, "ahead", ["late"]), one(12, "late", ["free"]), (1, 13, "tool", result("a", "A"))]
    got = {r["call_id"]: (r["status"], r["level"]) for r in linked(spark, turns).collect() if r["kind"] == "call"}
    circular = {i: ("circular", 0) for i in ("a", "b", "on", "p", "q", "r", "self", "both")}
    assert got == circular | {"free": ("unanswered", 0), "late": ("unanswered", 1), "ahead": ("unanswered", 2)}


def test_levels_of_any_shape_over_turns(spark):
    """Chains, trees and joins over turns, against plain Python; 80 calls in a chain take few rounds."""
    rng = random.Random(7)
    shapes = {1: {i: [i - 1] if i else [] for i in range(80)}, 2: {i: [j for j in (i - 1, i - 2, i // 2) if 0 <= j < i] for i in range(12)}}
    shapes |= {c: {i: rng.sample(range(14), rng.choice([0, 1, 1, 1, 2, 3])) for i in range(14)} for c in range(3, 40)}
    turns = [(c, i, "assistant", calls((f"c{i}", "find", {"q": "x"}, [f"c{j}" for j in before]))) for c, shape in shapes.items() for i, before in shape.items()]
    expected = {}
    for c, shape in shapes.items():
        level = {}
        for _ in shape:
            level |= {i: 1 + max((level[j] for j in before), default=-1) for i, before in shape.items() if all(j in level for j in before)}
        expected |= {(c, f"c{i}"): ("unanswered", level[i]) if i in level else ("circular", 0) for i in shape}
    assert {s for s, _ in expected.values()} == {"unanswered", "circular"}
    assert {(r["conv_id"], r["call_id"]): (r["status"], r["level"]) for r in linked(spark, turns).collect()} == expected


@pytest.mark.parametrize(
    "name, arguments, valid",
    [
        ("find", {"q": "x"}, True), ("find", {"q": "x", "n": 3, "deep": True, "how": "b"}, True), ("find", {}, False), ("find", {"q": 1}, False),
        ("find", {"q": "x", "n": 1.5}, False), ("find", {"q": "x", "more": 1}, False), ("find", {"q": "x", "how": "c"}, False), ("find", {"q": None}, False),
        ("find", [1], False), ("free", {}, True), ("free", {"x": 1.5, "o": {"a": [1]}, "l": [1, "a"], "other": 1}, True), ("free", {"o": [1]}, False),
        ("unknown", {"q": "x"}, False), (None, {"q": "x"}, False), ("find", None, False),
    ],
)
def test_arguments_against_schemas(spark, name, arguments, valid):
    row = linked(spark, [(1, 0, "assistant", calls(("a", name, arguments, None)))]).first()
    assert row["valid"] is valid


def test_canonical_json(spark):
    args = {"n": 3, "q": 'é "quoted" \n', "deep": False}
    row = linked(spark, [(1, 0, "assistant", calls(("a", "find", args, None)))]).first()
    assert row["json"] == json.dumps({"arguments": args, "call_id": "a", "name": "find", "role": "assistant"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    broken = spark.createDataFrame([(1, 0, 0, "call", "assistant", "a", "find", "{not json", None, None)], "conv_id long, turn int, part int, kind string, role string, call_id string, name string, arguments string, after array<string>, content string")
    row = chat.link(broken, TOOLS).first()
    assert json.loads(row["json"])["raw_arguments"] == "{not json" and row["valid"] is False


def test_nulls_broken_texts_and_repeats(spark):
    turns = [(None, 0, "user", None), (1, None, None, ""), (1, 0, "assistant", "{broken"), (1, 0, "assistant", '{"tool_calls": []}'), (1, 1, "tool", "plain"), (1, 2, "user", "y" * 500_000)]
    turns += [(None, 1, "assistant", calls(("a", "find", {"q": "x"}, None))), (5, 1, "assistant", calls((None, "find", {"q": "x"}, None)))]
    turns += [(6, 1, "assistant", calls(("a", "find", {"q": "x"}, None)))] * 2
    rows = linked(spark, turns).collect()
    assert len(rows) == len(turns)
    assert sorted(r["status"] for r in rows if r["kind"] == "call") == ["unanswered"] * 4
    assert all(r["status"] == "message" for r in rows if r["kind"] == "message")


def test_empty_table(spark):
    assert linked(spark, []).count() == 0


NESTED = {
    "t": {
        "required": ["it's"], "additionalProperties": {"type": "integer"},
        "properties": {
            "it's": {"type": ["string", "null"], "pattern": "^a.*z$", "minLength": 3},
            "n": {"type": "integer", "minimum": -1, "exclusiveMaximum": 10, "multipleOf": 2},
            "e": {"enum": ["1", 2, None, [1, {"x": True}]]},
            "c": {"const": {"k": [1, "a"]}},
            "deep": {"type": "object", "required": ["l"], "additionalProperties": False, "properties": {"l": {"type": "array", "items": {"type": "object", "properties": {"v": {"maximum": 3}}}, "minItems": 1, "uniqueItems": True}}},
            "any": {"anyOf": [{"type": "string"}, {"type": "number", "minimum": 5}], "not": {"const": "no"}},
            "one": {"oneOf": [{"type": "integer"}, {"minimum": 3}]},
        },
    }
}


@pytest.mark.parametrize(
    "more, valid",
    [
        ({}, True), ({"it's": None}, True), ({"it's": "a.z"}, True), ({"it's": "az"}, False), ({"it's": "abc"}, False), ({"it's": 3}, False),
        ({"n": 4}, True), ({"n": 4.0}, True), ({"n": 3}, False), ({"n": -2}, False), ({"n": 10}, False), ({"n": 10**20}, False), ({"n": "4"}, False), ({"n": 2.5}, False),
        ({"e": "1"}, True), ({"e": 1}, False), ({"e": 2.0}, True), ({"e": None}, True), ({"e": [1, {"x": True}]}, True), ({"e": [1, {"x": 1}]}, False), ({"e": [1]}, False),
        ({"c": {"k": [1, "a"]}}, True), ({"c": {"k": [1, "a"], "z": 0}}, False), ({"c": {"k": ["a", 1]}}, False), ({"c": {}}, False),
        ({"deep": {"l": [{"v": 3}, {"v": 2}]}}, True), ({"deep": {"l": [{"v": 4}]}}, False), ({"deep": {"l": []}}, False), ({"deep": {"l": [{}, {}]}}, False),
        ({"deep": {"l": [1]}}, False), ({"deep": {}}, False), ({"deep": {"l": [{}], "m": 1}}, False), ({"deep": [1]}, False),
        ({"any": "yes"}, True), ({"any": "no"}, False), ({"any": 5}, True), ({"any": 4}, False), ({"any": None}, False),
        ({"one": 1}, True), ({"one": 4}, False), ({"one": 4.5}, True), ({"one": 2.5}, False), ({"other": 10**20}, True), ({"other": 1.0}, True), ({"other": "x"}, False),
    ],
)
def test_nested_schemas(spark, more, valid):
    args = {"it's": "a quiz"} | more
    rows = spark.createDataFrame([("t", json.dumps(args))], "name string, arguments string")
    assert rows.select(chat.valid_arguments(NESTED, rows["name"], rows["arguments"])).first()[0] is valid


@pytest.mark.parametrize("schema", [{"propertyNames": {}}, {"properties": {"a": {"if": {}}}}, {"items": {"contains": {}}}, {"type": "text"}])
def test_unknown_schema_keywords_are_refused(spark, schema):
    rows = spark.createDataFrame([("t", "{}")], "name string, arguments string")
    with pytest.raises(ValueError):
        rows.select(chat.valid_arguments({"t": schema}, rows["name"], rows["arguments"]))


def test_calls_written_as_json_against_sql(spark):
    path = f"{TESTDATA}/sf0.01"
    df = QUERIES["chat_tool_calls"](spark, path)
    assert differences(df, connect(path), SQL["chat_tool_calls"]) == []
    assert {r["valid"] for r in df.collect()} == {True, False, None}
