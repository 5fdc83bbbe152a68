"""Policies and tasks as relations, with every fault listed."""

import json

from larkspur.sources import policies

GOOD = {
    "default_model": "m2", "escalate_after_failures": 0, "learning": {"min_samples": 3}, "ladder": ["m1", "m2"],
    "models": {"m1": {"tier": 1, "price": {"input": 0.5}}, "m2": {"tier": 2, "price": {"input": 1.0, "output": 2.0}, "requires_approval": True}},
    "task_types": {"code": {"validator": "command", "tier_by_complexity": {c: "m1" for c in policies.COMPLEXITIES}}},
    "domain_default_task_type": {"work": "code"}, "domain_agent": {"work": "w", "home": "w"},
    "agents": {"w": {"domain": "work", "default_model": "m1", "max_tier": 7, "allowed_tenants": ["a", "b"], "allowed_tools": ["*"], "deny_domains": []}},
}


def test_relations_and_defaults(spark):
    r = policies.relations(spark.createDataFrame([("p", json.dumps(GOOD)), ("none", "not json"), ("null", None)], "policy string, body string"))
    rows = {k: sorted(map(tuple, df.collect()), key=str) for k, df in r.items()}
    assert rows["models"] == [("p", "m1", 1, False), ("p", "m2", 2, True)] and rows["ladder"] == [("p", 0, "m1"), ("p", 1, "m2")]
    assert rows["prices"] == [("p", "m1", "input", 0.5), ("p", "m2", "input", 1.0), ("p", "m2", "output", 2.0)] and len(rows["starts"]) == 5
    assert rows["permissions"] == [("p", "w", "tenant", "a"), ("p", "w", "tenant", "b"), ("p", "w", "tool", "*")]
    assert next(s for s in rows["settings"] if s[0] == "p")[1:] == ("m2", 2, 0.5, 0.8, 3, 0.8)


def test_every_fault_is_listed(spark):
    bad = json.loads(json.dumps(GOOD))
    bad |= {"default_model": "m9", "ladder": ["m2", "m1", "m8"], "domain_default_task_type": {"work": "odd"}, "domain_agent": {"work": "w"}}
    bad["task_types"]["code"] = {"validator": "luck", "tier_by_complexity": {"trivial": "m7", "simple": "m1", "medium": "m1", "hard": "m1"}}
    bad["agents"]["x"] = {"domain": "moon", "default_model": None, "max_tier": 8}
    rows = spark.createDataFrame([("good", json.dumps(GOOD)), ("bad", json.dumps(bad)), ("empty", "{}")], "policy string, body string")
    found = {}
    for r in policies.faults(rows, ["work", "home"]).collect():
        found.setdefault(r.policy, []).append((r.place, r.fault))
    assert "good" not in found
    assert sorted(found["empty"]) == [("default_model", "unknown model "), ("domain_agent.home", "missing"), ("domain_agent.work", "missing"), ("ladder", "empty")]
    assert sorted(found["bad"]) == sorted([
        ("default_model", "unknown model m9"), ("ladder.2", "unknown model m8"), ("ladder.1", "a lower tier than before"), ("task_types.code.validator", "unknown validator luck"), ("task_types.code.critical", "missing"),
        ("task_types.code.trivial", "unknown model m7"), ("domain_default_task_type.work", "unknown task type odd"), ("domain_agent.home", "missing"), ("agents.x", "unknown domain moon"), ("agents.x", "unknown model "), ("agents.x", "max_tier isn't 1 to 7"),
    ])


def test_tasks(spark):
    schema = {"type": "object", "required": ["key", "category"], "properties": {"key": {"type": "string"}, "category": {"enum": ["b", "a"]}}}
    files = [("1", {"key": "z", "category": "a"}), ("2", {"key": "y", "category": "b"}), ("3", {"key": "x", "category": "b"}), ("4", {"key": "z", "category": "b"}), ("5", {"key": 1, "category": "c"}), ("6", [1])]
    rows = spark.createDataFrame([*((p, json.dumps(b)) for p, b in files), ("7", "no"), ("8", None)], "path string, body string")
    found, problems = policies.tasks(rows, schema, ["b", "a"])
    assert [(r.key, r.category) for r in found.collect()] == [("x", "b"), ("y", "b"), ("z", "a")]
    told = sorted((r.path, r.problem) for r in problems.collect())
    assert [p for p, _ in told] == ["4", "5", "5", "6", "7", "8"] and told[0][1] == "key z is given in 1 too" and told[1][1] == "category: 'c' is not one of ['b', 'a']"
