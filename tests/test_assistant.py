import hashlib
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from larkspur import reports
from larkspur.functions import decisions, numbers, texts
from larkspur.operators import bench, knowledge, search
from larkspur.sources import delimited, files, renders


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_typed_queries(spark):
    assert search.parsed('a "b Ç" -d or -"e f" G') == [[("a", True), ("b c", True), ("d", False)], [("e f", False), ("g", True)]]
    assert search.parsed('  "" or - ') == []
    docs = spark.createDataFrame([(1, "Um cão, um gato."), (2, "gato e cão"), (3, "o gato"), (4, None), (5, "")], "id long, text string")
    ask = lambda q: [tuple(r) for r in search.websearch(docs, q).collect()]
    assert ask("cao gato") == [(1, 2), (2, 2)] and ask('"um gato"') == [(1, 1)] and ask("gato -cão") == [(3, 1)]
    assert ask("um or o") == [(1, 2), (3, 1)] and ask("") == [] and ask("gato gato") == [(1, 1), (2, 1), (3, 1)]


def test_headline_and_scope(spark):
    text = " ".join(f"w{i}" for i in range(40)).replace("w7 ", "Gato ").replace("w30", "gáto,")
    row = one(spark, search.headline(F.lit(text), "gato", before=2, size=4), search.headline(F.lit("a b"), "x"), search.headline(F.lit(None).cast("string"), "x"))
    assert tuple(row) == ("w5 w6 «Gato» w8 … w28 w29 «gáto,» w31", "a b", "")
    assert search.tenant_scope("work", True) == ["work", "shared"] and search.tenant_scope("shared", True) == ["shared"]
    with pytest.raises(ValueError):
        search.tenant_scope("nobody")
    rows = spark.createDataFrame([(1, "work", None, "active"), (2, "work", "law", "active"), (3, "home", "law", "active"), (4, "work", "law", None)], "id long, tenant string, domain string, status string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(search.scoped(rows, ["work"])) == [1, 2] and ids(search.scoped(rows, ["work"], "law")) == [2] and ids(search.scoped(rows, ["work"], "law", False)) == [1, 2]
    with pytest.raises(PermissionError):
        search.guard(rows, "work")
    assert search.guard(rows.where("tenant = 'home'"), "home").count() == 1


def test_hybrid(spark):
    docs = spark.createDataFrame([(1, "cat"), (2, "cat cat"), (3, "dog")], "id long, text string")
    places = spark.createDataFrame([(3, 1), (1, 2), (99, 3)], "id long, place int")
    rows = search.hybrid(docs, "cat", places, 3, ["text"]).collect()
    assert [(r.id, r.text_place, r.vector_place) for r in rows] == [(1, 2, 2), (3, None, 1), (2, 1, None)]
    assert [r.id for r in search.hybrid(docs, "cat", None, 3, ["text"]).collect()] == [2, 1]


def test_gate_cases(spark):
    state = {"budget": "ok", "failures": 0, "iterations": 0, "max_iterations": 0, "tier": 3, "can_rise": True}
    none = {"validation": None, "exit_code": None, "critical": False, "architectural": False, "confidence": None}
    types = {"validation": "string", "exit_code": "int", "critical": "boolean", "architectural": "boolean", "confidence": "double"}
    cases = [
        ({"budget": "exhausted"}, {"validation": "pass"}, ("fail", "budget")), ({}, {"exit_code": 0}, ("done", "passed")), ({}, {"exit_code": 0, "validation": "fail"}, ("repair", "validation")),
        ({"max_iterations": 3, "iterations": 2}, {"validation": "fail"}, ("fail", "iterations")), ({"failures": 1}, {"exit_code": 2}, ("escalate", "failures")),
        ({"failures": 1, "can_rise": False}, {"exit_code": 2}, ("ask_human", "failures")), ({}, {"critical": True}, ("escalate", "critical")), ({"tier": 5}, {"critical": True}, ("done", "no evidence")),
        ({}, {"architectural": True}, ("escalate", "architecture")), ({}, {"confidence": 0.2}, ("escalate", "confidence")), ({}, {}, ("done", "no evidence")),
    ]
    found = one(spark, *[decisions.gate({k: F.lit(v) for k, v in (state | s).items()}, {k: F.lit(v).cast(types[k]) for k, v in (none | e).items()}) for s, e, _ in cases])
    assert [tuple(x) for x in found] == [w for _, _, w in cases]


def test_bench(spark):
    rows = [("c", "m", True, 0.25, 1000, 1500, 4, 1, True, None, None, "high"), ("c", "m", False, 0.25, 1000, 1500, 4, 0, False, True, None, None), ("c", "m", True, 9.0, 0, 0, 0, 0, None, None, "boom", "low"), ("c", "m", False, 0.25, 1000, 1500, 4, 0, None, True, "", "low")]
    names = "category string, start_model string, success boolean, cost_usd double, input_tokens int, output_tokens int, iterations int, escalations int, router_task_type_ok boolean, router_domain_ok boolean, error string, complexity string"
    runs = spark.createDataFrame(rows, names)
    s = bench.summary(runs).first()
    assert (s.runs, s.succeeded, s.cost_per_success_usd, s.avg_tokens, s.escalation_rate, s.router_task_type_accuracy, s.router_domain_accuracy) == (2, 1, 0.5, 2500.0, 0.5, 0.5, 1.0)
    s = bench.stats(runs, F.col("category")).first()
    assert (s.runs, s.errors, s.complexities) == (3, 1, "high,low")
    routing = spark.createDataFrame([("t", ["low", "high"], "a")], "task_type string, complexities array<string>, model string")
    suggested = spark.createDataFrame([("t", "low", "b"), ("t", "high", "a")], "task_type string, complexity string, model string")
    assert [tuple(r) for r in bench.better_routes(suggested, routing).collect()] == [("t", "low", "a", "b")]


def test_context(spark):
    memories = spark.createDataFrame([(1, "rule", "domain", "r" * 40, None, 0.1), (2, "decision", "global", "d" * 4000, 0.9, 1.0), (3, "preference", "global", "p" * 40, None, 0.9), (4, "note", "global", "n" * 40, 0.8, 0.5)], "id long, kind string, scope string, content string, similarity double, importance double")
    again = spark.createDataFrame([(4, "note", "global", "n" * 40, 0.95, 0.5)], memories.schema)
    found = knowledge.candidates(memories, again)
    assert {r.id: r.similarity for r in found.collect()} == {1: None, 2: 0.9, 3: None, 4: 0.95}
    hits = spark.createDataFrame([(7, "h" * 400, "short", 0.9), (8, "g" * 8, "g", 0.5)], "id long, content string, snippet string, score double")
    picked = knowledge.compiled(found, hits, 80, "task").orderBy("place").collect()
    # 80 - 5 for the task; 14 each for 1, 3 and 4, the decision doesn't fit; 33 are left: the snippet (6), then 6
    assert [(r.bucket, r.id, r.cost) for r in picked] == [(0, 1, 14), (1, 3, 14), (3, 4, 14), (4, 7, 6), (4, 8, 6)]
    assert picked[3].content == "short" and picked[4].content == "g" * 8


def test_store(spark):
    memories = spark.createDataFrame([(1, "active", datetime(2025, 1, 1), datetime(2025, 1, 1)), (2, "active", None, datetime(2025, 1, 1)), (3, "active", None, datetime(2025, 6, 1)), (4, "gone", datetime(2025, 1, 1), None)], "id long, status string, expires_at timestamp, reviewed_at timestamp")
    out = {r.id: (r.status, r.change) for r in knowledge.maintained(memories, F.lit(datetime(2025, 6, 2))).collect()}
    assert out == {1: ("deprecated", "deprecated"), 2: ("review", "review"), 3: ("active", None), 4: ("gone", None)}
    chunks, docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "document_id long, text string"), spark.createDataFrame([(1, "active"), (2, "gone")], "document_id long, status string")
    assert [r.text for r in knowledge.without_orphans(chunks, docs).collect()] == ["a"]
    jobs = spark.createDataFrame([(1, "done", 1), (2, "running", 1), (3, "failed", 3), (4, "done", 2)], "id long, status string, created long")
    assert sorted(r.id for r in knowledge.kept_jobs(jobs, 2).collect()) == [2, 3, 4]


def test_files(spark, tmp_path):
    (tmp_path / "v/.git").mkdir(parents=True)
    for name, data in (("v/a.md", b"one\ntwo"), ("v/b.exe", b"x"), ("v/c.md", b"y" * 99), ("v/.git/d.md", b"z")):
        (tmp_path / name).write_bytes(data)
    assert sorted(r.name for r in files.listing(spark, f"{tmp_path}/v").collect()) == ["a.md", "b.exe", "c.md"]
    assert [r.name for r in files.listing(spark, f"{tmp_path}/v", "a").collect()] == ["a.md"]
    with pytest.raises(ValueError):
        files.listing(spark, str(tmp_path), "../x")
    got = sorted((r.path[-5:], r.sha256, r.problem) for r in files.uploads(spark, f"{tmp_path}/v", ("md",), 50).collect())
    assert got == [("/a.md", hashlib.sha256(b"one\ntwo").hexdigest(), None), ("/c.md", None, "size"), ("b.exe", None, "type")]
    assert [r.text for r in files.plain_texts(spark, f"{tmp_path}/v/a.md").collect()] == ["one\ntwo"]
    at = lambda u: files.address(F.lit(u))
    row = one(spark, at("obsidian://V/a/b.md"), at("obsidian://V/../b.md"), at("plain"), files.resolved(F.lit("file://l/x/y"), {"file://l": "/data"}), files.parser_of(F.lit("a.MD"), {"md": "notes"}), files.parser_of(F.lit("a.x"), {"md": "notes"}))
    assert tuple(row) == (("obsidian", "V", "a/b.md"), None, None, "/data/x/y", "notes", None)
    (tmp_path / "t.csv").write_text("a,b\n" + "".join(f"{i},x\n" for i in range(60)))
    doc = files.table_document(delimited.read(spark, f"{tmp_path}/t.csv")).first()
    assert doc.text.split("\n")[:2] == ["a | b", "0 | x"] and doc.text.endswith("(10 more rows)") and (doc.columns, doc.rows, doc.truncated) == (["a", "b"], 60, True)


def test_settings():
    assert files.settings("# c\na: 1\nlist:\n  - x\n  - 'y z'\ngroup:\n  k: 2.5 # note\n  l: text\nlast:") == {"a": 1, "list": ["x", "y z"], "group": {"k": 2.5, "l": "text"}, "last": None}
    assert files.budgets("budget:\n  Casa: 100\n  Lazer: 50.5") == {"Casa": 100.0, "Lazer": 50.5} == files.budgets('{"Casa": 100, "Lazer": 50.5}')
    with pytest.raises(ValueError):
        files.budgets("Casa: much")
    assert files.variables("export A=1\n# B=2\nC='x y' # z\n D=\"q\"\nnothing") == {"A": "1", "C": "x y", "D": "q"}
    now = datetime(2025, 3, 10, tzinfo=UTC)
    assert [files.moment(t, now).isoformat() for t in ("2d", "1w", "2025-01-02", "2025-01-02T03:00+01:00")] == ["2025-03-08T00:00:00+00:00", "2025-03-03T00:00:00+00:00", "2025-01-02T00:00:00+00:00", "2025-01-02T03:00:00+01:00"]


def test_events_and_renders(spark, tmp_path):
    lines = [("r", 1, 'data: {"type":"tool.started"}'), ("r", 2, ": ping"), ("r", 3, 'data: {"type":"run.completed"}'), ("r", 4, 'data: {"type":"tool.started"}'), ("s", 1, 'data:{"type":"tool.started"}')]
    rows = files.event_stream(spark.createDataFrame(lines, "run string, n long, line string")).collect()
    assert sorted(map(tuple, rows)) == [("r", 1, "run.completed"), ("s", 1, None)]
    table = spark.createDataFrame([("b|c", 2), (None, 1)], "Regra string, n int")
    assert [r.line for r in renders.table_lines(table, [F.col("n")]).orderBy("place").collect()] == ["| Regra | n |", "|---|---|", "|  | 1 |", "| b\\|c | 2 |"]
    out = renders.categorised(table, F.lit("c"), F.lit("r"))
    assert out.columns == ["Regra", "n", "categoria", "regra_aplicada"]
    renders.export(out, f"{tmp_path}/x")
    assert spark.read.option("header", True).csv(f"{tmp_path}/x").count() == 2


def test_scalars(spark, sf):
    row = one(spark, texts.is_test_command(F.lit("cd x && pytest -q")), texts.is_test_command(F.lit("echo contest")), texts.exit_code(F.lit("exit code 1 ... exited with code: 2")), texts.exit_code(F.lit("ok")), texts.is_repository(F.lit("a/b.c")), texts.is_repository(F.lit("a/b/c")), texts.is_slug(F.lit("a--b")), texts.is_uri(F.lit("s3://b/../c")))
    assert tuple(row) == (True, False, 1, 0, True, False, False, False)
    row = one(spark, texts.listed([F.lit(None).cast("array<string>"), F.array(F.lit(" a "), F.lit(""), F.lit("a"), F.lit("b"))]), numbers.shown(F.lit(0.256), "percent"), numbers.shown(F.lit(0.0012), "usd"), numbers.shown(F.lit(12.0), "usd"), numbers.shown(F.lit(1234567), "number"), numbers.shown(F.lit(None).cast("double"), "usd"))
    assert tuple(row) == (["a", "b"], "25.6%", "$0.0012", "$12.00", "1,234,567", "-")
    assert reports.run(spark, "costs", sf).count() > 0
    with pytest.raises(ValueError):
        reports.run(spark, "none", sf)
