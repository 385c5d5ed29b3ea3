from evalspark.llm import op1_tool_calls as op

CALLS = "conv bigint, call_id string, issued bigint, name string, arguments string, depends_on array<string>"
RESULTS = "conv bigint, call_id string, issued bigint, content string"
SCHEMAS = {"add": {"properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "number"},
                                  "tags": {"type": "array"}}, "required": ["a"]}}


def link(spark, calls, results):
    out = op.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS)
    return {(r["conv"], r["call_id"]): r for r in out.collect()}


def test_levels_cycles_and_missing_dependencies(spark):
    ok = '{"a": 1}'
    got = link(spark, [(1, "a", 0, "add", ok, []), (1, "b", 1, "add", ok, ["a"]),
                       (1, "c", 2, "add", ok, ["a", "b", "b"]), (1, "d", 3, "add", ok, ["gone"]),
                       (1, "x", 4, "add", ok, ["y"]), (1, "y", 5, "add", ok, ["x"]),
                       (1, "z", 6, "add", ok, ["y", "a"]), (2, "b", 0, "add", ok, ["a"]),
                       (2, "s", 0, "add", ok, ["s"]), (2, "n", 0, "add", ok, None)], [])
    level = {k: r["level"] for k, r in got.items()}
    assert level == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): 0, (1, "x"): None, (1, "y"): None,
                     (1, "z"): None, (2, "b"): 0, (2, "s"): None, (2, "n"): 0}
    assert got[1, "d"]["errors"] == ["depends_on: missing call"] and not got[1, "d"]["valid"]
    assert got[1, "a"]["valid"] and got[1, "a"]["status"] == "unanswered"


def test_levels_of_random_graphs_and_long_chains(spark):
    import random
    r = random.Random(4)
    calls, want = [], {}
    for conv in range(12):
        n = 130 if conv == 0 else r.randint(1, 14)
        deps = {}
        for i in range(n):
            if conv == 0:  # a chain whose shortcuts are issued after it
                deps[i] = [i - 1] * (i > 0) + [i - 7] * (i > 9)
            else:  # any direction, so cycles too
                deps[i] = [j for j in range(n) if j != i and r.random() < 0.09]
        level = {}
        for _ in range(n + 1):
            for i in range(n):
                if i not in level and all(j in level for j in deps[i]):
                    level[i] = 1 + max((level[j] for j in deps[i]), default=-1)
        for i in range(n):
            issued = -i if conv == 0 else i  # the last issued dependency is the wrong one to follow
            calls.append((conv, str(i), issued, "add", '{"a": 1}', [str(j) for j in deps[i]]))
            want[conv, str(i)] = level.get(i)
    got = link(spark, calls, [])
    assert {k: r["level"] for k, r in got.items()} == want


def test_arguments_and_canonical_json(spark):
    cases = {'{"b": 1.50, "a": 2}': [], '{"a": -1}': ["a: beyond minimum"], '{"b": 1}': ["a: missing"],
             '{"a": "1"}': ["a: not integer"], '{"a": 1, "z": 0, "c": 0}': ["c: unknown", "z: unknown"],
             '{"a": 1, "tags": [1]}': [], '{"a": 1, "tags": {}}': ["tags: not array"],
             "[1]": ["arguments: no object"], "{": ["arguments: no object"], None: ["arguments: no object"]}
    got = link(spark, [(1, str(i), i, "add", a, []) for i, a in enumerate(cases)]
               + [(1, "u", 99, "other", "{}", []), (1, "v", 99, None, "{}", [])], [])
    assert [got[1, str(i)]["errors"] for i in range(len(cases))] == list(cases.values())
    assert got[1, "u"]["errors"] == got[1, "v"]["errors"] == ["tool: unknown"]
    assert got[1, "0"]["canonical"] == ('{"arguments":{"a":2,"b":1.5},"depends_on":[],"id":"0","name":"add",'
                                        '"result":null}')
    assert got[1, "7"]["canonical"].startswith('{"arguments":null,')


def test_results_repeats_and_orphans(spark):
    got = link(spark, [(1, "a", 5, "add", '{"a": 1}', []), (1, "a", 0, "add", '{"a": 2}', []),
                       (1, None, 0, "add", "{}", [])],
               [(1, "a", 3, 'say "hi"\n'), (1, "a", 2, None), (1, "o", 0, "x"), (2, "a", 0, "y"), (1, None, 0, "z")])
    a = got[1, "a"]
    assert (a["n_calls"], a["n_results"], a["status"], a["issued"]) == (2, 2, "linked", 0)
    assert got[1, "o"]["status"] == got[2, "a"]["status"] == got[1, None]["status"] == "orphan"
    assert got[1, "o"]["canonical"] == '{"id":"o","result":"x"}'
    assert len(got) == 4
    assert link(spark, [], []) == {}
