import json
import random

from imagora.llm import toolcalls

CALLS = "call_id string, parent_id string, tool string, arguments string, level int, valid string"
RESULTS = "call_id string, content string, n int"
SCHEMAS = "tool string, field string, type string, required boolean"


def link(spark, calls, results=(), schemas=()):
    df = toolcalls.link_calls(
        spark.createDataFrame([(*c, 1, "x") for c in calls], CALLS),
        spark.createDataFrame([(*r, 1) for r in results], RESULTS), spark.createDataFrame(list(schemas), SCHEMAS))
    return {r.call_id: r for r in df.collect()}


def test_order_of_chains_trees_and_cycles(spark):
    rng = random.Random(1)
    parent = {i: rng.randrange(i) if i % 5 else None for i in range(1, 150)}
    parent.update({i: i - 1 for i in range(201, 300)})
    parent.update({200: None, 400: 401, 401: 402, 402: 400, 403: 400, 500: 500, 600: 9999, 0: None})
    got = link(spark, [(str(i), None if p is None else str(p), "t", "{}") for i, p in parent.items()])

    def level(i):
        n, seen = 0, set()
        while parent[i] is not None and parent[i] in parent and parent[i] != i:
            if i in seen:
                return None
            seen.add(i)
            i, n = parent[i], n + 1
        return n

    assert {i: got[str(i)].level for i in parent} == {i: level(i) for i in parent}
    assert "cycle" in got["403"].errors


def test_arguments_against_fields(spark):
    schema = [("f", "a", "integer", True), ("f", "b", "string", False), ("f", "c", "array", False), ("f", "d", "number", False)]
    calls = [("1", '{"b": "x", "a": 1}'), ("2", '{"b": 2}'), ("3", '{"a": 1, "z": null, "c": [1], "d": 1.5}'), ("4", "[1]"),
             ("5", "not json"), ("6", None), ("7", '{"a": 1, "c": {"k": 1}, "d": true}')]
    got = link(spark, [(i, None, "f", a) for i, a in calls] + [("8", None, "g", "{}")], schemas=schema)
    assert {i: r.errors for i, r in got.items()} == {
        "1": [], "2": ["missing a", "not string: b"], "3": ["unknown z"], "4": ["arguments are not an object"],
        "5": ["arguments are not an object"], "6": ["arguments are not an object"], "7": ["not array: c", "not number: d"],
        "8": ["no such tool"]}
    assert [i for i, r in got.items() if r.valid] == ["1"]


def test_canonical_json(spark):
    got = link(spark, [("1", None, "f", '{ "b" : [1, {"y":2, "x":"é\\n"}] , "a":null}'), ("2", "1", "f", "oops")],
               [("1", "r2"), ("1", "r1"), ("9", "lost"), (None, "none")])
    want = {"arguments": {"a": None, "b": [1, {"x": "é\n", "y": 2}]}, "id": "1", "level": 0, "name": "f", "result": "r1"}
    assert got["1"].json == json.dumps(want, ensure_ascii=False, separators=(",", ":")) and got["1"].n_results == 2
    assert json.loads(got["2"].json) == {"arguments": "oops", "id": "2", "level": 1, "name": "f", "result": None}


def test_edges(spark):
    got = link(spark, [(None, None, "f", "{}"), ("1", None, None, "{}"), ("1", None, None, "{}"), ("2", "", "f", "")])
    assert set(got) == {"1", "2"} and got["1"].errors == ["no such tool"]
    assert link(spark, []) == {}
    turns = spark.createDataFrame([(1, 0, "user", None, "x"), (None, 1, "user", "t", "x"), (1, None, "user", "t", "x")],
                                  "conv_id bigint, turn bigint, role string, text string, id string")
    rows = toolcalls.link_calls(*toolcalls.from_conversations(turns)).collect()
    assert [(r.call_id, r.errors) for r in rows] == [("1:0", ["missing text"])]
