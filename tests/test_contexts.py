"""Contexts against a plain reading of the rules, one request at a time."""

import math
import random

from larkspur.operators import contexts as c

MEMORY = "id long, tenant string, scope string, domain string, project string, kind string, content string, importance double, created_at long, vector array<double>"
REQUEST = "request long, tenants array<string>, domain string, project string, task string, project_text string, vector array<double>, budget int"


def brute(memories, requests, hits):
    cost = lambda t: math.ceil(len(t or "") / 4) + 4

    def near(a, b):
        size = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / size, 4) if size else None

    out = {}
    for request, tenants, domain, project, task, project_text, vector, budget in requests:
        own = [m for m in memories if m[1] in tenants]
        best = lambda rows, k: sorted(rows, key=lambda m: (-m[7], -m[8], m[0]))[:k]
        found = {}

        def add(rows, found=found):
            for m, s in rows:
                if m[0] not in found or (s is not None and (found[m[0]][1] is None or s > found[m[0]][1])):
                    found[m[0]] = (m, s)

        for kind in c.STANDING:
            add((m, None) for m in best([m for m in own if m[2] == "global" and m[5] == kind], 10))
        for kind in c.CONSTRAINTS:
            add((m, None) for m in best([m for m in own if domain and m[2] == "domain" and m[3] == domain and m[5] == kind], 10))
            add((m, None) for m in best([m for m in own if project and m[2] == "project" and m[4] == project and m[5] == kind], 10))
        if vector is None:
            add((m, None) for m in best([m for m in own if domain is None or m[3] == domain], 30))
        else:
            for k, rows in ((20, own), (10, [m for m in own if domain and m[3] == domain]), (15, [m for m in own if project and m[4] == project])):
                scored = sorted(((m, near(vector, m[9])) for m in rows if m[9] is not None), key=lambda x: (-(x[1] or -2), x[0][0]))
                add((m, s) for m, s in scored[:k] if s is not None and s >= 0.35)
        bucket = lambda m: 0 if m[5] in c.CONSTRAINTS else 2 if m[5] in c.DECISIONS else 1 if m[2] == "global" and m[5] in c.STANDING else 3
        items = sorted((bucket(m), -((0.5 if s is None else s) * 0.7 + m[7] * 0.3), m[0], m[6], m[6]) for m, s in found.values())
        items += sorted((4, -h[4], h[1], h[2], h[3]) for h in hits if h[0] == request)[:8]
        left, used, dropped, picked = budget, 0, 0, []
        for text in [task, *([project_text] if project_text else [])]:
            if cost(text) <= left:
                left, used = left - cost(text), used + cost(text)
            else:
                dropped += 1
        for b, _, i, text, other in items:
            text = other if b == 4 and left <= cost(text) else text
            if cost(text) <= left:
                left, used = left - cost(text), used + cost(text)
                picked.append((b, i, text, cost(text)))
            else:
                dropped += 1
        out[request] = (used, dropped, picked)
    return out


def test_contexts(spark):
    rng = random.Random(6)
    kinds = [*c.STANDING, *c.DECISIONS, "fact", "episode"]
    vector = lambda: [rng.gauss(0.4, 1) for _ in range(6)]
    memories = []
    for i in range(900):
        scope = rng.choice(["global", "domain", "project"])
        memories.append((i, rng.choice(["a", "a", "a", "b", "shared"]), scope, rng.choice(["x", "y"]) if scope == "domain" else None, rng.choice(["p", "q"]) if scope == "project" else None,
                         rng.choice(kinds), f"m{i} " * rng.randrange(1, 12), rng.randrange(11) / 10, rng.randrange(50), vector() if rng.random() < 0.9 else None))
    requests = [
        (1, ["a", "shared"], "x", "p", "do it", "the project", vector(), 900), (2, ["b"], None, None, "a task", None, vector(), 3000), (3, ["a"], "y", None, "t" * 90, "", None, 200),
        (4, ["a", "shared"], None, "q", "t", None, None, 500), (5, ["nobody"], "x", "p", "alone", None, vector(), 300), (6, ["a", "a"], "x", "p", "x" * 999, "y" * 999, vector(), 60), (7, ["b"], "x", "p", "", None, [0.0] * 6, 400),
    ]
    hits = [(r, 100 * r + i, f"d{i} " * rng.randrange(5, 60), f"s{i}", float(rng.randrange(1, 9))) for r in (1, 2, 3, 5) for i in range(12)]
    frames = spark.createDataFrame(memories, MEMORY), spark.createDataFrame(requests, REQUEST), spark.createDataFrame(hits, "request long, id long, content string, snippet string, score double")
    found = {r.request: (r.used, r.dropped, [tuple(i) for i in r["items"]]) for r in c.compiled(*frames).collect()}
    expected = brute(memories, requests, hits)
    for request in expected:
        assert found[request] == expected[request], request
    none = c.compiled(frames[0].limit(0), frames[1], frames[2].limit(0)).collect()
    assert len(none) == 7 and all(r["items"] == [] for r in none)


def test_many_requests_are_one_pass(spark):
    rng = random.Random(8)
    vector = lambda: [rng.gauss(0.4, 1) for _ in range(6)]
    memories = [(i, rng.choice("ab"), "global", None, None, "fact", "m", 0.5, i, vector()) for i in range(400)]
    memories += [memories[7]] * 60 + [(400, "a", "global", None, None, "fact", "m", 0.5, 0, [0.0] * 6)]
    requests = [(r, ["a", "b"] if r % 2 else ["a"], None, None, "t", None, vector(), 99) for r in range(600)]
    found = c.similar(spark.createDataFrame(memories, MEMORY).coalesce(1), spark.createDataFrame(requests, REQUEST), ["tenant"], 12)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # noqa: SLF001
    of = {}
    for r in found.collect():
        of.setdefault(r.request, []).append((r.id, r.similarity))
    near = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 4)
    for r, tenants, *_, asked, _ in requests:
        scored = sorted(((m[0], near(asked, m[9])) for m in memories[:400] if m[1] in tenants), key=lambda x: (-x[1], x[0]))
        assert sorted(of.get(r, []), key=lambda x: (-x[1], x[0])) == [x for x in scored[:12] if x[1] >= c.LEAST_SIMILARITY], r
