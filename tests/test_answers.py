"""JSON in answers against a table of cases; run events as a stream against the batch."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest

from larkspur.operators.answers import candidates, compiled, judged, schema_checks
from larkspur.sources import files
from larkspur.streaming import ledger_stream, sessions
from tests.test_sessions import rocks  # noqa: F401

CASES = [
    ({"type": "integer"}, [1, 2.0, -3], [True, 1.5, "1", None]), ({"type": ["string", "null"]}, ["", None], [0, []]), ({"enum": [1, "a", None]}, [1, "a", None, 1.0], [True, "b"]),
    ({"const": {"a": [1]}}, [{"a": [1]}], [{"a": [True]}, {}]), ({"minimum": 2, "maximum": 4}, [2, 4, "x"], [1, 5]), ({"exclusiveMinimum": 0, "multipleOf": 3}, [3, 9], [0, 4]),
    ({"minLength": 2, "maxLength": 3, "pattern": "^a"}, ["ab", 7], ["a", "abcd", "bb"]), ({"minItems": 1, "uniqueItems": True, "items": {"type": "number"}}, [[1], [1, 2]], [[], [1, 1], ["x"]]),
    ({"required": ["a"], "properties": {"a": {"type": "string"}}, "additionalProperties": False}, [{"a": ""}], [{}, {"a": 1}, {"a": "", "b": 1}]),
    ({"properties": {"a": {}}, "additionalProperties": {"type": "null"}}, [{"a": 1, "b": None}], [{"b": 1}]), ({"prefixItems": [{"type": "null"}], "items": {"type": "string"}}, [[None, "a"], []], [["a"], [None, 1]]),
    ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["", 5], [4]), ({"oneOf": [{"minimum": 5}, {"maximum": 9}]}, [3, 12], [7]), ({"not": {"type": "string"}}, [1], ["a"]), ({"allOf": [{"minimum": 1}, {"maximum": 1}]}, [1], [0, 2]),
    ({"$defs": {"n": {"properties": {"next": {"$ref": "#/$defs/n"}, "v": {"type": "integer"}}}}, "$ref": "#/$defs/n"}, [{"next": {"next": {"v": 1}}}], [{"next": {"next": {"v": "x"}}}]), (True, [1], []), (False, [], [1]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_schemas(case):
    schema, good, bad = CASES[case]
    check = compiled(schema)
    assert [list(check(x)) for x in good] == [[]] * len(good) and all(list(check(x)) for x in bad)


def test_candidates_and_errors():
    assert list(candidates('a {"x": 1} [2] {bad')) == [{"x": 1}, [2]]
    assert list(candidates('see ```json\n{"x": 1}\n``` or {"y": [3]}'))[0] == {"x": 1} and list(candidates(" 7 ")) == [7]
    schema = {"type": "object", "required": list("abcdef"), "properties": {"z": {"type": "integer"}}}
    valid, value, errors = judged('{"z": "t"} and then {"z": 2}', compiled(schema))
    assert (valid, value) == (False, None) and errors == [f"<root>: '{k}' is a required property" for k in "abcde"]
    assert judged('no {"z": "t"}; yes {"z": 2}', compiled({"properties": {"z": {"type": "integer"}}, "required": ["z"]})) == (True, '{"z": 2}', [])
    assert judged(None, compiled(True)) == (False, None, ["no JSON value found in the answer"])
    assert not judged("[0] " * 20 + "[1]", compiled({"items": {"const": 1}}))[0] and judged("[0] " * 19 + "[1]", compiled({"items": {"const": 1}}))[0]
    assert judged("[" * 5_000, compiled(True))[0] is False
    with pytest.raises(ValueError):
        compiled({"unevaluatedItems": False})


def test_frames(spark):
    rows = spark.createDataFrame([("a", '{"k": 1}', 0), ("b", None, 0), ("a", "x", 0)], "who string, text string, key int")
    found = schema_checks(rows, {"type": "object"}, "who").collect()
    assert sorted((r.who, r.valid, r.value, len(r.errors)) for r in found if r.value) == [("a", True, '{"k": 1}', 0)] and len(found) == 3
    assert schema_checks(rows.limit(0), True, "who").count() == 0


def test_run_events_in_any_order(spark, rocks, tmp_path):  # noqa: F811
    rng, start = random.Random(8), datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = []
    for run in range(8):
        for n in range(30):
            name = "run.completed" if n == 20 + run % 3 else "run.failed" if n == 27 else rng.choice(["tool.started", "tool.started", "text.delta"])
            if run == 7 and "run" in name:
                name = "text.delta"
            line = f"data: {json.dumps({'event' if run % 2 else 'type': name})}" if rng.random() < 0.9 or "run" in name else ": ping"
            rows.append((f"r{run}", n, line, start + timedelta(seconds=n)))
    schema = "run string, n long, line string, ts timestamp"
    expected = {r.run: (r.tools, r.status) for r in files.event_stream(spark.createDataFrame(rows, schema)).collect()}
    assert expected["r7"][1] is None and expected["r0"][1] == "run.completed"
    rng.shuffle(rows)
    for i, part in enumerate([*(rows[j : j + 60] + rows[:5] for j in range(0, len(rows), 60)), [("late", 0, "data: {}", start + timedelta(hours=5))], [("late", 1, "data: {}", start + timedelta(hours=5))]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b{i:03}")
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    ledger_stream.drained(sessions.run_events(lines, "ts", idle=600), f"{tmp_path}/out", f"{tmp_path}/checkpoint", "update")
    out = spark.read.parquet(f"{tmp_path}/out").where("ended").collect()
    assert {r.run: (r.tools, r.status) for r in out} == expected
