import json

from chronolith.llm import toolcalls

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after array<string>, level int"
RESULTS = "conv_id long, turn long, call_id string, content string, valid int"
TOOLS = {"sum": {"a": (("number",), True), "b": (("number", "string"), True), "note": (("string",), False)}, "none": {}}


def run(spark, calls, results):
    c = spark.createDataFrame([(*x, 0) for x in calls], CALLS)
    r = spark.createDataFrame([(*x, 0) for x in results], RESULTS)
    return {(x.conv_id, x.call_id): x for x in toolcalls.link(c, r, toolcalls.schemas(spark, TOOLS)).collect()}, toolcalls.orphans(c, r)


def test_links_orders_and_validates(spark):
    calls = [
        (1, 0, "x", "sum", '{"b": "2", "a" : 1, "note":"\\u00e9\\n"}', None),
        (1, 2, "y", "sum", '{"a": "no", "c": [1, {"z": 1, "b": 2}]}', ["x"]),
        (1, 4, "z", "none", "{}", ["y", "x", "lost"]),
        (1, 6, "p", "none", "[1]", ["q"]), (1, 8, "q", "none", "{", ["p"]), (1, 9, "r", "what", None, ["q"]),
        (1, 0, "x", "sum", '{"b": "2", "a" : 1, "note":"\\u00e9\\n"}', None),
        (2, 0, "x", "none", '{"a": 1, "a": 2}', []), (None, 1, None, "none", "{}", None), (2, None, None, None, "{}", None),
    ]
    results = [(1, 3, "x", 'three "3"'), (1, 1, "x", "two"), (2, 1, "x", None), (None, 2, None, "n"), (1, 1, "lost", "who"), (3, 1, "x", "far")]
    got, orphan = run(spark, calls, results)
    assert len(got) == 9
    x = got[1, "x"]
    assert (x.level, x.copies, x.n_results, x.valid, x.errors) == (0, 2, 2, True, "")
    assert x.message == '{"arguments":{"a":1,"b":"2","note":"é\\n"},"depends_on":[],"id":"x","name":"sum","result":"two"}'
    assert got[1, "y"].errors == "missing:b,kind:a,unknown:c" and got[1, "y"].level == 1
    assert '"c":[1,{"b":2,"z":1}]' in got[1, "y"].message
    assert got[1, "z"].errors == "unknown_call:lost" and got[1, "z"].level == 2
    assert got[1, "p"].errors == "not_an_object,cycle" and got[1, "p"].level is None
    assert got[1, "q"].errors == "not_json,cycle" and got[1, "r"].errors == "unknown_tool,not_json,cycle"
    assert got[2, "x"].errors == "not_json" and got[2, "x"].n_results == 1
    assert got[None, None].n_results == 1 and got[2, None].errors == "unknown_tool"
    for r in got.values():
        json.loads(r.message)
    assert sorted((r.conv_id, r.call_id) for r in orphan.collect()) == [(1, "lost"), (3, "x")]


def test_long_chain_and_empty(spark):
    calls = [(7, i, f"c{i}", "none", "{}", [f"c{i - 1}"] if i else None) for i in range(12)]
    got, _ = run(spark, calls, [])
    assert [got[7, f"c{i}"].level for i in range(12)] == list(range(12))
    fan = [(8, i, f"n{i}", "none", "{}", [f"n{j}" for j in range(max(0, i - 3), i)]) for i in range(9)]
    fan += [(8, 20 + i, f"t{i}", "none", "{}", [f"t{i - 1}" if i else "n8"]) for i in range(5)] + [(8, 30, "w", "none", "{}", ["t4", "n0", "t2"])]
    fan += [(8, 40, "k", "none", "{}", ["k"]), (8, 41, "l", "none", "{}", ["k", "n0"]), (8, 42, "m", "none", "{}", ["l"])]
    got, _ = run(spark, fan, [])
    assert [got[8, f"n{i}"].level for i in range(9)] == list(range(9)) and got[8, "t4"].level == 13 and got[8, "w"].level == 14
    assert [got[8, x].level for x in "klm"] == [None] * 3
    got, orphan = run(spark, [], [])
    assert got == {} and orphan.count() == 0


def test_main_path_runs_no_python(spark, sf_dir):
    df = toolcalls.op5_toolcalls(spark, sf_dir)
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_numbers_are_canonical(spark):
    from decimal import Decimal

    same = [("1.0", "1"), ("1e2", "100"), ("100", "100"), ("-0", "0"), ("-0.0e5", "0"), ("0.10", "0.1"), ("12.50E-1", "1.25"), ("5e-3", "0.005"), ("-1.5e+3", "-1500"),
            ("1234567890123456789012345678901234567890", "1234567890123456789012345678901234567890"), ("12345678901234567890123456789012345678901234", "12345678901234567890123456789012345678901234e0"), ("0.1234567890123456789012345678901234567890123", "1234567890123456789012345678901234567890123e-43"), ("1e60", "1e60"), ("10e59", "1e60"), ("1e-60", "1e-60")]
    calls = [(1, i, f"c{i:03}", "none", '{"k" : ' + n + ', "b":[' + n + ', "' + n + '\\\\ \\"2.0\\" "], "a 1.0": {"z": 1.50, "y": true}}', None) for i, (n, _) in enumerate(same)]
    calls += [(1, 900, "mark", "none", '{"a": "\\ue000 1.0 \\n"}', None), (1, 901, "bad", "none", '{"a": 01.0}', None)]
    got, _ = run(spark, calls, [])
    for i, (n, want) in enumerate(same):
        text = json.loads(got[1, f"c{i:03}"].message, parse_float=Decimal, parse_int=Decimal)["arguments"]
        assert text["k"] == Decimal(n) and text["b"][1] == n + '\\ "2.0" '
        assert f'"arguments":{{"a 1.0":{{"y":true,"z":1.5}},"b":[{want},"{n}' in got[1, f"c{i:03}"].message
        assert f'"k":{want}}}' in got[1, f"c{i:03}"].message
    assert json.loads(got[1, "mark"].message)["arguments"]["a"] == "\ue000 1.0 \n" and got[1, "bad"].errors.startswith("not_json")


def test_a_deep_ladder_takes_no_rounds(spark, monkeypatch):
    calls = [(9, i, f"c{i:04}", "none", "{}", [f"c{j:04}" for j in (i - 1, i - 2) if j >= 0]) for i in range(1000)]
    taken = []
    monkeypatch.setattr(toolcalls, "settled", lambda *a: taken.append(a))
    got, _ = run(spark, calls, [])
    assert [got[9, f"c{i:04}"].level for i in range(1000)] == list(range(1000)) and not taken


def test_fold_and_rounds_agree(spark):
    import random

    rnd = random.Random(3)
    calls = [(v, i, f"c{i:02}", "none", "{}", [f"c{rnd.randrange(i):02}" for _ in range(rnd.randrange(3))] if i else None) for v in range(4) for i in range(12)]
    folded, _ = run(spark, calls, [])
    shuffled = [(v, -t, *rest) for v, t, *rest in calls]  # now every call stands before its dependencies
    rounds, _ = run(spark, shuffled, [])
    assert {k: r.level for k, r in folded.items()} == {k: r.level for k, r in rounds.items()}
