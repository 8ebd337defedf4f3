"""Tool-call linking against brute force, canonical JSON, schema faults, chains."""

import json
import random

import pytest

from flowlens.llm import tool_calls as tc

SCHEMAS = {
    "find": {
        "type": "object", "required": ["q"], "additionalProperties": False,
        "properties": {"q": {"type": "string", "minLength": 1}, "n": {"type": "integer", "minimum": 0, "maximum": 9},
                       "tags": {"type": "array", "items": {"type": "string", "enum": ["a", "b"]}}},
    },
}
CALLS = "conv_id long, turn long, call_id string, name string, arguments string, parent_id string, extra int"
RESULTS = "conv_id long, turn long, call_id string, content string, name string"


def test_canonical_json():
    assert tc.canonical_json(json.loads('{"b": 1.0, "a": [1.5, {"z": null, "é": "x"}], "c": true}')) == (
        '{"a":[1.5,{"z":null,"é":"x"}],"b":1,"c":true}'
    )


@pytest.mark.parametrize("value,faults", [
    ({"q": "x", "n": 3}, []), ({"q": ""}, ["$.q: too short"]), ({"n": 10.0}, ["$.q: missing", "$.n: too large"]),
    ({"q": 1, "z": 1}, ["$.q: not string", "$.z: unknown"]), ({"q": "x", "n": True}, ["$.n: not integer"]),
    ({"q": "x", "tags": ["a", "c", 1]}, ["$.tags[1]: not allowed", "$.tags[2]: not string"]), ([], ["$: not object"]),
])
def test_schema_faults(value, faults):
    assert tc.schema_faults(value, SCHEMAS["find"]) == faults


def _brute(calls, results):
    out = []
    by_key, first_result = {}, {}
    for c in sorted(calls, key=lambda c: c[1]):
        by_key.setdefault((c[0], c[2]), c)
    for r in sorted(results, key=lambda r: r[1]):
        first_result.setdefault((r[0], r[2]), r)
    for c in calls:
        key = (c[0], c[2])
        if by_key[key] is not c:
            out.append((c[0], c[2], c[1], None, None, "repeated_id"))
            continue
        level, at, status = 0, c, None
        walked = {key}
        if c[5] is not None and (c[0], c[5]) not in by_key:
            status = "missing_parent"
        while at[5] is not None and (up := (at[0], at[5])) in by_key:
            if up in walked:
                status = "cycle"
                break
            walked.add(up)
            at, level = by_key[up], level + 1
        answer = first_result.get(key)
        level = None if status == "cycle" else level
        out.append((c[0], c[2], c[1], answer and answer[1], level, status or ("ok" if answer else "no_result")))
    for r in results:
        if (r[0], r[2]) not in by_key:
            out.append((r[0], r[2], None, r[1], None, "no_call"))
        elif first_result[(r[0], r[2])] is not r:
            out.append((r[0], r[2], None, r[1], None, "repeated_result"))
    return sorted(out, key=repr)


def _linked(spark, calls, results):
    return tc.link_tool_calls(
        spark.createDataFrame([(*c, 1) for c in calls], CALLS), spark.createDataFrame([(*r, "n") for r in results], RESULTS), SCHEMAS
    )


def test_links_match_brute_force(spark):
    rng = random.Random(12)
    calls, results = [], []
    for turn in range(160):
        conv = rng.choice([1, 2, None])
        ids = [c[2] for c in calls if c[0] == conv] or ["c0"]
        parent = rng.choice([None, None, rng.choice(ids), f"c{rng.randint(0, 90)}", "ghost"])
        calls.append((conv, turn, f"c{rng.randint(0, 90)}", "find", '{"q":"x"}', parent))
        if rng.random() < 0.7:
            results.append((rng.choice([conv, 3]), turn + 1, rng.choice(ids), f"r{turn}"))
    found = tc.ordered(_linked(spark, calls, results), bucket_turns=3).collect()
    assert sorted(((r.conv_id, r.call_id, r.call_turn, r.result_turn, r.level, r.status) for r in found), key=repr) == _brute(calls, results)
    for conv in (1, 2, 3, None):
        own = sorted((r for r in found if r.conv_id == conv), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own)))
        keys = [(1 << 40 if r.level is None else r.level, r.call_turn if r.call_turn is not None else r.result_turn) for r in own]
        assert keys == sorted(keys)


def test_long_chain_and_cycle(spark):
    chain = [(1, t, f"c{t}", "find", '{"q":"x"}', f"c{t - 1}" if t else None) for t in range(300)]
    ring = [(2, t, f"c{t}", "find", "{}", f"c{(t + 1) % 5}") for t in range(5)] + [(2, 9, "tail", "find", "[", "c0")]
    found = {(r.conv_id, r.call_id): r for r in _linked(spark, chain + ring, []).collect()}
    assert all(found[(1, f"c{t}")].level == t for t in range(300))
    assert {found[k].status for k in found if k[0] == 2} == {"cycle"}
    assert found[(2, "tail")].canonical is None and found[(2, "tail")].faults == ["$: not JSON"]
    assert found[(2, "c0")].faults == ["$.q: missing"]


def test_repeated_rows_and_nulls(spark):
    call = (1, 1, "a", None, None, None)
    found = [tuple(r) for r in _linked(spark, [call, call, (1, 2, None, "find", '{"q":"x"}', None)], [(1, 3, None, "r"), (1, 3, None, "r")]).collect()]
    status = sorted((str(r[1]), r[9]) for r in found)
    assert status == [("None", "ok"), ("None", "repeated_result"), ("a", "no_result"), ("a", "repeated_id")]


def test_empty_tables(spark):
    assert tc.ordered(_linked(spark, [], [])).count() == 0


@pytest.mark.parametrize("text,faults", [
    ('{"q": "\\ud800"}', ["$: not JSON"]), ('{"\\ud800": 1}', ["$: not JSON"]), ('{"q": "x", "n": %s}' % ("9" * 400), ["$.n: too large"]),
    ('{"q": "x", "n": 1e999}', ["$: not JSON"]), ('{"q": "x", "n": -%s}' % ("9" * 400), ["$.n: too small"]), ('{"q": "\\u00e9\\ud83d\\ude00"}', []),
])
def test_odd_json_does_not_end_the_job(spark, text, faults):
    """Lone surrogates have no UTF-8 form, and whole numbers may have any size."""
    calls = spark.createDataFrame([("find", text)], "name string, arguments string")
    row = tc.checked_arguments(calls, SCHEMAS).first()
    assert row["faults"] == faults and (row["canonical"] is None) == (faults == ["$: not JSON"])
