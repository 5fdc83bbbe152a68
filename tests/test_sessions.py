"""Sessions and kept answers as streams, against plain folds."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from larkspur.operators import merges
from larkspur.streaming import ledger_stream, sessions

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
EVENTS = "session long, seq long, ts timestamp, kind string, action string, failed boolean, model string, tier int"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    sessions.stateful(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def files(spark, path, batches, schema):
    """One file a batch, in order of their names."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/b{i:03}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def test_fold():
    gate = lambda action, failed=True, model=None, tier=None: {"kind": "gate", "action": action, "failed": failed, "model": model, "tier": tier, "at": 5}
    run = dict(sessions.START)
    for event in (gate("repair"), gate("repair")):
        run = sessions.applied(run, event)
    assert (run["failures"], run["repairs"], run["status"], run["iterations"]) == (2, 2, "running", 2)
    up = sessions.applied(run, gate("escalate", True, "big", 2))
    assert (up["failures"], up["escalations"], up["model"], up["tier"]) == (0, 1, "big", 2)
    blocked = sessions.applied(up, gate("ask_human"))
    assert blocked["status"] == "blocked" and blocked["ended_at"] is None
    assert sessions.applied(blocked, {"kind": "reject", "action": None, "at": 9})["status"] == "failed"
    moved = sessions.applied(blocked, {"kind": "approve", "action": None, "model": "huge", "tier": 3, "at": 9})
    assert (moved["status"], moved["model"], moved["escalations"], moved["failures"]) == ("running", "huge", 2, 0)
    finish = lambda s: {"kind": "finish", "action": s, "at": 7}
    done = sessions.applied(moved, finish("succeeded"))
    assert sessions.applied(done, finish("cancelled"))["status"] == "succeeded" and sessions.applied(done, finish("failed"))["status"] == "failed"
    assert sessions.applied(sessions.applied(done, finish("failed")), finish("succeeded")) == {**done, "status": "failed"}


def test_repeated_and_unordered_events(spark, rocks, tmp_path):
    rng = random.Random(2)
    told = []
    for s in range(6):
        for seq in range(14):
            action = rng.choice(["repair", "escalate", "continue", "ask_human"])
            told.append((s, seq, START + timedelta(seconds=60 * seq + s), "gate", action, rng.random() < 0.5, f"m{seq}", seq % 4))
        told.append((s, 14, START + timedelta(seconds=60 * 14 + s), "finish", "succeeded", False, None, None))
    expected = {}
    for e in sorted(told, key=lambda e: e[:2]):
        run = expected.get(e[0], dict(sessions.START))
        expected[e[0]] = sessions.applied(run, {"seq": e[1], "at": int(e[2].timestamp()), "kind": e[3], "action": e[4], "failed": e[5], "model": e[6], "tier": e[7]})
    rng.shuffle(told)
    batches = [told[i : i + 20] + told[max(0, i - 5) : i] for i in range(0, len(told), 20)]  # some are told again
    batches.append([(99, 0, START + timedelta(hours=9), "gate", "continue", False, None, None)])  # moves the watermark
    batches.append([(99, 1, START + timedelta(hours=9, seconds=5), "gate", "continue", False, None, None)])
    stream = sessions.session_runs(files(spark, f"{tmp_path}/in", batches, EVENTS), "ts", idle=3_600, late="2 hours")
    ledger_stream.drained(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", "update")
    rows = spark.read.parquet(f"{tmp_path}/out").where("session < 99").collect()
    last = {}
    for r in sorted(rows, key=lambda r: (r.batch, r.evicted)):
        last[r.session] = r
    names = ["status", "model", "tier", "failures", "escalations", "repairs", "iterations", "ended_at"]
    assert {s: {c: r[c] for c in names} for s, r in last.items()} == {s: {c: r[c] for c in names} for s, r in expected.items()}
    assert all(r.evicted for r in last.values()) and sum(r.evicted for r in rows) == 6  # idle ones left the state


def test_kept_answers(spark, rocks, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice("abc") if i % 11 else None, START + timedelta(seconds=37 * i), i % 5 == 0, i % 7 == 0) for i in range(200)]
    schema = "id long, key string, ts timestamp, needs_human boolean, failed boolean"
    batch = merges.cached(spark.createDataFrame(rows, schema).select("id", "key", F.unix_timestamp("ts").alias("at"), "needs_human", "failed"), 600)
    expected, until = {}, {}
    for i, key, ts, human, failed in rows:
        at = int(ts.timestamp())
        expected[i] = key is not None and at < until.get(key, 0)
        if key is not None and not expected[i] and not human and not failed:
            until[key] = at + 600
    assert {r.id: r.cached for r in batch.collect()} == expected and sum(expected.values()) > 50
    stream = sessions.cached(files(spark, f"{tmp_path}/in", [rows[i : i + 40] for i in range(0, 200, 40)], schema), "ts", 600)
    ledger_stream.drained(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert {r.id: r.cached for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {i: c for i, c in expected.items() if i % 11}
