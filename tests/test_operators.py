"""Known answers for the operators, on small inputs of our own."""

import io
import math
import random
import wave
import zipfile
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import decisions, numbers, texts
from larkspur.operators import chunking, finance, joins, passages, retrieval
from larkspur.plans import ledger_reports
from larkspur.plans.registry import QUERIES
from larkspur.sources import delimited, notes, transcripts
from larkspur.streaming import ledger_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_cost_per_success(spark):
    rows = [("t", "m1", s, Decimal("0.25"), 1, 0, 0) for s in ("succeeded", "failed", "failed", "failed")] + [("t", "m2", "succeeded", Decimal("0.80"), 1, 0, 0), (None, "m2", "succeeded", Decimal("9"), 1, 0, 0), ("t", "m3", "failed", Decimal("1"), 1, 0, 0)]
    runs = spark.createDataFrame(rows, "task_type string, start_model string, status string, cost_usd decimal(12,6), iterations int, repairs int, escalations int")
    assert {r.start_model: r.cost_per_success for r in ledger_reports.costs(runs).collect()} == {"m1": 1.0, "m2": 0.8, "m3": None}


def test_distributions(spark):
    m = lambda **k: F.create_map(*[x for p, w in k.items() for x in (F.lit(p), F.lit(float(w)))])
    assert one(spark, F.round(decisions.confidence(m(a=0.9, b=0.1), F.lit(2)), 3)) == 0.531
    assert one(spark, decisions.confidence(m(a=1, b=0), F.lit(2))) == 1
    assert one(spark, F.round(decisions.confidence(m(a=0.5, b=0.5), F.lit(2)), 9)) == 0
    assert one(spark, decisions.confidence(m(a=1), F.lit(1))) == 1
    assert one(spark, decisions.normalized(m(a=0, b=0))) is None
    assert one(spark, F.round(decisions.expected_level(m(low=0.1, mid=0.6, high=0.3), F.array(F.lit("low"), F.lit("mid"), F.lit("high"))), 6)) == 1.2
    assert one(spark, decisions.choice(m(a=0.5, b=0.5), F.array(F.lit("b"), F.lit("a")))) == "b"
    logs = F.create_map(F.lit("A"), F.array(F.lit(math.log(0.4)), F.lit(math.log(0.3))), F.lit("B"), F.array(F.lit(math.log(0.2))))
    assert {k: round(v, 6) for k, v in one(spark, decisions.softmax(logs)).items()} == {"A": round(7 / 9, 6), "B": round(2 / 9, 6)}
    assert [one(spark, decisions.budget_state(F.lit(u), F.lit(v))) for u, v in ((1, 10), (8, 10), (10, 10), (5, -1), (0, 0))] == ["ok", "warn", "exhausted", "unlimited", "exhausted"]


@pytest.mark.parametrize(("text", "mark", "value"), [("R$ 1.234,56", ",", "1234.56"), ("(12,50)", ",", "-12.5"), ("12.5-", ".", "-12.5"), ("-1,000.25", ".", "-1000.25"), ("abc", ".", None), ("", ",", None), ("€ 3", ",", "3")])
def test_numbers(spark, text, mark, value):
    found = one(spark, numbers.parsed_number(F.lit(text), mark))
    assert found == (None if value is None else Decimal(value))


@pytest.mark.parametrize(("text", "day"), [("31/12/2025", "2025-12-31"), ("2025-01-02T10:00", "2025-01-02"), ("1-2-2025", "2025-02-01"), ("45658", "2025-01-01"), ("31/31/2025", None), ("x", None), ("12", None)])
def test_dates(spark, text, day):
    assert str(one(spark, numbers.parsed_date(F.lit(text)))) == str(day)


def test_limits_money_and_cost(spark):
    for text, value in (("1.500,00", "1500"), ("R$ 800", "800"), ("1,500", None), ("1.500", "1500"), ("12,5", "12.5")):
        assert one(spark, numbers.budget_limit(F.lit(text))) == (None if value is None else Decimal(value))
    assert one(spark, numbers.money(F.lit(Decimal("0.125")))) == Decimal("0.12")
    assert one(spark, numbers.cost(F.lit(1000), F.lit(400), F.lit(100), F.lit(3.0), F.lit(0.0), F.lit(15.0))) == pytest.approx((600 * 3 + 400 * 3 + 1500) / 1e6)
    assert one(spark, numbers.plain_name(F.lit("Descrição (R$)"))) == "descricao_r"
    assert str(one(spark, numbers.from_file_name(F.lit("IMG_20240131_1.jpg")))) == "2024-01-31"


def test_texts(spark):
    assert one(spark, texts.normalized(F.lit("a  \r\nb\n\n\n\nc\n"))) == "a\nb\n\nc"
    assert one(spark, texts.srt_time(F.lit(3725.0425))) == "01:02:05,043"
    assert one(spark, texts.route(F.lit("https://a.b/x/12/y?q=1#z"))) == "/x/{id}/y"
    assert one(spark, texts.event_type(F.lit('{"event":"","type":"t"}'))) == "t"
    assert one(spark, texts.event_type(F.lit("{}"))) == "unknown"
    assert one(spark, texts.snippet(F.lit("word " * 100), 12)) == "word word"
    assert one(spark, texts.answer_numbers(F.lit("R$ 1.234,50 e 12,5"))) == "R$ 1234.50 e 12.5"


def test_interval_join(spark):
    left = spark.createDataFrame([(1, 0.0, 10.0), (2, 100.0, 250.0), (3, 500.0, 500.5)], "id long, start double, end double")
    right = spark.createDataFrame([("a", 0.0, 4.0), ("b", 4.0, 200.0), ("a", 200.0, 240.0), ("c", 90.0, 110.0)], "label string, start double, end double")
    found = {r.id: (r.label, r.seconds) for r in joins.best_overlap(left, right, 7.0).collect()}
    assert found == {1: ("b", 6.0), 2: ("b", 100.0), 3: (None, None)}


def test_rules(spark):
    rows = spark.createDataFrame([("uber eats ltda",), ("uber",), ("padaria",), (None,)], "text string")
    found = [r.category for r in joins.categorize(rows, [("ride", "uber"), ("food", "uber eats")], F.col("text")).collect()]
    assert found == ["food", "ride", None, None]


def test_fusion(spark):
    lists = spark.createDataFrame([(0, 1, 7), (0, 2, 8), (1, 1, 8), (1, 2, 9)], "list int, place int, id long")
    assert [(r.id, r.score) for r in retrieval.fused(lists).collect()] == [(8, round(1 / 62 + 1 / 61, 6)), (7, round(1 / 61, 6)), (9, round(1 / 62, 6))]


def test_budget(spark):
    budget = spark.createDataFrame([("a", 500.0), ("b", 0.0), ("c", 100.0), ("d", 100.0)], "category string, limit double")
    spent = spark.createDataFrame([("a", 510.2), ("c", 100.0), ("x", 5.0)], "category string, spent double")
    assert {r.category: (r.status, r.used_pct) for r in finance.budget_review(spent, budget).collect()} == {"a": ("over", 102.0), "b": ("warn", 100.0), "c": ("warn", 100.0), "d": ("ok", 0.0), "x": ("unbudgeted", None)}


def test_months(spark):
    months = spark.createDataFrame([("2025-01", 100.0), ("2025-02", -53.0), ("2025-05", 0.0), ("2025-06", 4.0)], "month string, total double")
    assert [(r.delta_pct, r.gap) for r in finance.month_over_month(months).orderBy("month").collect()] == [(None, False), (-153.0, False), (100.0, True), (None, False)]


def test_chunks():
    text = "# A\n\n" + "\n\n".join(f"Paragraph {i} " + "word " * 60 for i in range(30)) + "\n\n## A1\n\n```py\n# no heading\n" + "x = 1\n" * 900 + "```\n\n# B\n\nend"
    found = [(p["heading"], p["content"]) for p in passages.passages(text)]
    assert all(passages.tokens(c) <= 500 for _, c in found)
    assert {h for h, _ in found} >= {"A", "A > A1"}
    assert sum(c.count("x = 1") for _, c in found) >= 900 and all(c.count("```") % 2 == 0 for _, c in found if "x = 1" in c)
    assert all(f"Paragraph {i} " in " ".join(c for _, c in found) for i in range(30))
    assert passages.passages(None) == [] and passages.passages("") == []


def test_fill_and_reduce(spark):
    assert one(spark, chunking.filled(F.array(F.lit(60), F.lit(30), F.lit(50), F.lit(10)), 100)) == [True, True, False, True]
    rows = spark.createDataFrame([("k", i, f"t{i}") for i in range(20)] + [("one", 0, "x")], "k string, i int, t string")
    out = {r.k: r.t for r in chunking.map_reduce(rows, "k", "i", "t", lambda ts: F.array_join(ts, ","), 3).collect()}
    assert out == {"k": ",".join(f"t{i}" for i in range(20)), "one": "x"}


def greedy(rows, budget):
    """(key, place, size) rows taken, by a plain fold in order."""
    left, out = {}, []
    for k, i, n in sorted(rows, key=lambda r: r[1]):
        if n is not None and n <= left.get(k, budget):
            left[k] = left.get(k, budget) - n
            out.append((k, i, n))
    return sorted(out, key=str)


def test_fill_looks_at_every_row(spark):
    rng = random.Random(5)
    mixed = [("hot", i, rng.choice([None, 0, 7, 90, 400, 5000])) for i in range(11_000)] + [("hot", 11_000, 0), ("hot", 11_001, 3)]
    nulls = [("nulls", i, None) for i in range(10_500)] + [("nulls", 10_500, 4), ("nulls", 10_501, 0)]
    late = [("late", i, 1000 - i // 11) for i in range(10_900)] + [(None, i, 30) for i in range(50)] + [(f"k{i % 40}", i, i % 300) for i in range(900)]
    gives = [("gives", i, rng.choice([-5, 20, 60])) for i in range(300)]
    for rows, blocks in ((mixed + nulls + late, (100_000, 3000)), (mixed[:1200] + gives, (250,))):
        df = spark.createDataFrame(rows, "k string, i int, n int")
        for block in blocks:
            found = chunking.fill_budget(df, "k", ["i"], "n", 1000, block)
            assert found.columns == ["k", "i", "n"]
            assert sorted(map(tuple, found.collect()), key=str) == greedy(rows, 1000)
    assert chunking.fill_budget(df.where("false"), "k", ["i"], "n", 1000).collect() == []


def test_context_fill(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("source", "doc_id", "text").collect()
    sizes = sorted((-(-len(r.text) // 4), r.doc_id, r.source) for r in docs if r.text is not None)
    expected = greedy([(s, (n, i), n) for n, i, s in sizes], 5000)
    found = QUERIES["context_fill"](spark, sf).collect()
    assert sorted(((r.source, (r.n_tokens, r.doc_id), r.n_tokens) for r in found), key=str) == expected


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, name string, d string")
    new = spark.createDataFrame([(2, "B", None), (3, "c", "z")], "k long, name string, d string")
    assert sorted(map(tuple, joins.upsert(old, new, ["k"], keep=("d",)).collect())) == [(1, "a", "x", "kept"), (2, "B", "y", "updated"), (3, "c", "z", "created")]
    fresh = spark.createDataFrame([(2, "n", "n"), (9, "n", "n"), (9, "o", "o"), (None, "p", "p"), (None, "p", "p")], "k long, name string, d string")
    assert joins.insert_if_absent(old, fresh, "k").count() == 5
    assert [r.k for r in joins.changed(old, old.withColumn("d", F.when(F.col("k") == 1, F.lit(None)).otherwise(F.col("d"))), "k", ["name", "d"]).collect()] == [1]


def test_delimited(spark, tmp_path):
    cases = {
        "bank.csv": "Data;Descrição;Valor\n01/02/2025;Café;1.234,56\n;;\n02/02/2025;\"a;b\";-10,00\n".encode(),
        "old.csv": "Data;Descrição;Valor\n01/02/2025;Café;1.234,56\n02/02/2025;\"a;b\";-10,00\n".encode("cp1252"),
        "top.csv": "Report\nof May\n\nData;Descrição;Valor\n01/02/2025;Café;1.234,56;extra\n02/02/2025;\"a;b\";-10,00\n".encode(),
    }
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
        df = delimited.read(spark, str(tmp_path / name))
        assert df.columns == ["_row", "Data", "Descrição", "Valor"], name
        assert [tuple(r)[1:] for r in df.orderBy("_row").collect()] == [("01/02/2025", "Café", "1.234,56"), ("02/02/2025", "a;b", "-10,00")], name
    (tmp_path / "again.csv").write_text('# note\nname,text\nname,text\nx,"two\nlines, here"\n\n# note,\ny,\n')
    rows = delimited.read(spark, str(tmp_path / "again.csv")).orderBy("_row").collect()
    assert [tuple(r) for r in rows] == [(2, "name", "text"), (3, "x", "two\nlines, here"), (4, "# note", None), (5, "y", None)]
    assert delimited.sniffed("a;b,c\n1;2\n3;4\n") == (";", 2) and delimited.sniffed("one\ntwo\n") == (",", 1)
    assert delimited.unique_names(["a", "", "a", "a"]) == ["a", "col_2", "a_2", "a_3"]
    (tmp_path / "t.json").write_text('{"transactions": [{"a": 1}, {"a": 2}]}')
    (tmp_path / "l.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert [delimited.read_json_rows(spark, str(tmp_path / f)).count() for f in ("t.json", "l.json")] == [2, 2]


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sheet = f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>in</t></is></c></row><row r="2"><c r="A2"><v>45658</v></c><c r="B2" t="b"><v>1</v></c></row></sheetData></worksheet>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>shared</t></si></sst>")
        z.writestr("xl/worksheets/s1.xml", sheet)
        z.writestr("xl/worksheets/s2.xml", f"<worksheet {ns}><sheetData/></worksheet>")
    (tmp_path / "b.xlsx").write_bytes(buffer.getvalue())
    assert [list(r.cells) for r in delimited.read_workbooks(spark, str(tmp_path / "b.xlsx")).orderBy("row").collect()] == [["shared", "", "in"], ["45658", "TRUE"]]
    assert delimited.read_workbooks(spark, str(tmp_path / "b.xlsx"), "Two").count() == 0


def test_transcripts(spark, tmp_path):
    (tmp_path / "a.vtt").write_text("WEBVTT\n\nNOTE x\n\n00:01.000 --> 00:02.500 align:start\n<b>Hello</b>\nthere\n\n00:02.500 --> 00:03.000\nHello there\n\n1:00:00.000 --> 1:00:01.000\nend\n")
    rows = transcripts.read_subtitles(spark, str(tmp_path / "a.vtt"))
    assert [(r.start, r.end, r.text) for r in rows.orderBy("place").collect()] == [(1.0, 2.5, "Hello there"), (3600.0, 3601.0, "end")]
    assert transcripts.rendered(rows, "path").first().srt == "1\n00:00:01,000 --> 00:00:02,500\nHello there\n\n2\n01:00:00,000 --> 01:00:01,000\nend"
    results = spark.createDataFrame([(1, '{"segments":[{"start":2,"end":1,"text":" a "},{"start":3,"end":4,"text":" "}]}'), (2, '{"text":"all","duration":9}'), (3, "{}")], "id long, json string")
    assert [tuple(r)[2:] for r in transcripts.segments(results).orderBy("id").collect()] == [(2.0, 2.0, "a"), (0.0, 9.0, "all")]
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setparams((1, 2, 1000, 0, "NONE", ""))
        x = np.full(20_000, 1000, dtype=np.int16)
        x[11_000:11_400] = 0
        w.writeframes(x.tobytes())
    r = transcripts.read_recordings(spark, str(tmp_path / "a.wav"), 10.0).first()
    assert r.seconds == 20.0 and 11.0 <= r.cuts[0] <= 11.4
    (tmp_path / "g.log").write_text('ts=1 level=error method=GET path=/a/1?x=2 status=500 dur=3\nts=2 level=info path=/a/2 status=200\nnoise\nts=3 path="/a/9" status=503\n')
    assert [tuple(r) for r in transcripts.server_errors(transcripts.read_gateway_log(spark, str(tmp_path / "g.log"))).collect()] == [("/a/{id}", 2)]


def test_notes(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "n.md").write_text("---\ntags: [x, y]\naliases:\n  - N\ncreated: 2025-01-01\n---\n# Title\n\nSee [[Other|that]] and ![[pic.png]] #tag #12 %%secret%%\n\n```\n#no [[no]]\n```\n")
    (tmp_path / "v" / "Templates").mkdir()
    (tmp_path / "v" / "Templates" / "t.md").write_text("x")
    (r,) = notes.read_notes(spark, str(tmp_path / "v")).collect()
    assert (r.title, r.tags, r.links, r.embeds, r.aliases, r.created) == ("Title", ["x", "y", "tag"], ["Other"], ["pic.png"], ["N"], "2025-01-01")
    assert "that" in r.body and "secret" not in r.body
    cases = {'Sure:\n```json\n{"a": 1,}\n```': '{"a": 1}', "{'a': True, 'b': None}": '{"a": true, "b": null}', '{"a": [1, 2': '{"a": [1, 2]}', 'x {"a": "b", "c": ': '{"a": "b"}', "none": None, '{"u": "http://x" // c\n}': '{"u": "http://x"}'}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", notes.json_of(F.col("t")).alias("j")).collect()
    assert {r.t: r.j for r in rows} == cases


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = ledger_stream.source(spark, str(tmp_path / "in"), events.schema)
    keyed = stream.withColumn("key", F.when(F.col("event_id") % 10 > 0, F.concat("user_id", F.lit("-"), "event_type")))
    ledger_stream.drained(ledger_stream.once(keyed, "key"), str(tmp_path / "once"), str(tmp_path / "c1"))
    expected = events.where("event_id % 10 > 0").select("user_id", "event_type").distinct().count() + events.where("event_id % 10 = 0").count()
    assert spark.read.parquet(str(tmp_path / "once")).count() == expected
    ledger_stream.drained(ledger_stream.session_totals(stream, "user_id", "value"), str(tmp_path / "sum"), str(tmp_path / "c2"), "update")
    last = spark.read.parquet(str(tmp_path / "sum")).groupBy("user_id").agg(F.max_by("calls", "batch").alias("calls"))
    assert {r.user_id: r.calls for r in last.collect()} == {r.user_id: r["count"] for r in events.groupBy("user_id").count().collect()}


def test_session_states(spark, tmp_path):
    rows = [(1, 1, "repair"), (1, 2, "repair"), (1, 3, "escalate"), (1, 4, "repair"), (1, 5, "succeeded"), (1, 6, "cancelled"), (2, 1, "succeeded"), (2, 2, "failed"), (3, 1, "repair")]
    spark.createDataFrame(rows, "session long, seq int, type string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ledger_stream.source(spark, str(tmp_path / "in"), "session long, seq int, type string")
    ledger_stream.drained(ledger_stream.session_states(stream), str(tmp_path / "out"), str(tmp_path / "c"), "update")
    assert sorted((r.session, r.status, r.failures, r.escalations) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "succeeded", 0, 1), (2, "failed", 0, 0), (3, "running", 1, 0)]
