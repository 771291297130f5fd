import json
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.streaming import events as ev

BLANK = dict.fromkeys(ev.FIELDS)


def event(run, seq, kind, **more):
    return BLANK | {"run_id": run, "seq": seq, "kind": kind} | more


def changes(events):
    run, out = ev.Run(), []
    for e in events:
        out += [(*c, run.status) for c in run.step(e)]
    return run, out


def test_a_run_succeeds_once_after_its_task_and_final_message():
    run, out = changes([
        event("r", 1, "user"), event("r", 2, "start", task_id="t"), event("r", 3, "message", message_id="m", output="he"), event("r", 4, "message", message_id="m", output="hello"),
        event("r", 5, "end", task_id="old"), event("r", 6, "end", task_id="t"), event("r", 7, "message", message_id="m", output="hello", is_final=True), event("r", 8, "message", message_id="m", output="hello", is_final=True),
    ])
    assert [c[0] for c in out] == ["started", "append", "append", "completed"] and out[2][2] == "llo" and run.status == "succeeded"


def test_cancelling_and_release():
    run, out = changes([event("r", 1, "start", task_id="t"), event("r", 2, "stopping"), event("r", 3, "stopping"), event("r", 4, "released", task_id="x"), event("r", 5, "released"), event("r", 6, "start")])
    assert [c[0] for c in out] == ["started", "cancelling", "cancelled"] and run.status == "cancelled"


def test_tokens_deletes_and_replacement():
    run, out = changes([event("r", 1, "token", message_id="x", output="?"), event("r", 2, "message", message_id="m", output=""), event("r", 3, "token", message_id="m", output="ab"), event("r", 4, "token", message_id="m", output="zz", is_sequence=True), event("r", 5, "delete", message_id="m"), event("r", 6, "delete", message_id="m"), event("r", 7, "message", message_id="q", is_reasoning=True)])
    assert [c[:3] for c in out] == [("append", "m", "ab"), ("replace", "m", "zz"), ("retract", "m", ""), ("append", "q", "")]


def test_late_checkpoints_are_dropped():
    run, out = changes([event("r", k, "overlay", checkpoint_id=c, waiting=w) for k, (c, w) in enumerate([("05", False), ("03", True), ("07", True), ("06", False)])])
    assert [c[:3] for c in out] == [("needs_input", None, "07")] and run.latest_checkpoint == "07"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.text(alphabet="xy", max_size=4)), max_size=12))
def test_deltas_rebuild_contents(snapshots):
    _, out = changes([event("r", k, "message", message_id=m, output=t) for k, (m, t) in enumerate(snapshots)])
    held = {}
    for kind, m, text, _ in out:
        held[m] = held.get(m, "") + text if kind == "append" else text
    assert held == {m: t for m, t in dict(snapshots).items() if t or m in held}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["user", "start", "end", "stopping", "released", "message", "overlay", "delete"]), max_size=14), st.lists(st.sampled_from([None, "t1", "t2"]), min_size=14, max_size=14))
def test_terminal_states_absorb(kinds, tasks):
    run = ev.Run()
    for k, (kind, task) in enumerate(zip(kinds, tasks)):
        before = run.status
        run.step(event("r", k, kind, task_id=task, message_id="m", output="x", is_final=k % 2 == 0, checkpoint_id=str(k), waiting=True))
        assert before != "cancelled" or run.status == "cancelled"


def log():
    rows = []
    for r in range(6):
        rows += [event(f"r{r}", 1, "start", task_id="t"), event(f"r{r}", 2, "message", message_id="m", output="a"), event(f"r{r}", 3, "token", message_id="m", output="b"), event(f"r{r}", 4, "message", message_id="m", output="abc", is_final=True), event(f"r{r}", 5, "end", task_id="t")]
    return rows


@pytest.fixture
def rocksdb(spark):
    spark.conf.set(*ev.STATE_STORE)
    yield spark
    spark.conf.unset(ev.STATE_STORE[0])


def write_events(spark, rows, folder):
    spark.createDataFrame([tuple(r[f] for f in ev.FIELDS) for r in rows], ev.EVENT).coalesce(1).write.mode("append").json(str(folder))


def run_stream(spark, folder, name, **options):
    """All that is there now, in micro-batches of one file; goes on from the checkpoint of the run before."""
    stream = ev.stream_runs(spark.readStream.schema(ev.EVENT).option("maxFilesPerTrigger", 1).json(str(folder / "in")), **options)
    q = stream.writeStream.format("parquet").option("path", str(folder / name)).option("checkpointLocation", str(folder / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return q


def test_a_stream_that_is_restarted_equals_the_batch(rocksdb, tmp_path):
    rng = random.Random(4)
    kinds = ["user", "start", "end", "stopping", "released", "message", "message", "token", "token", "delete", "overlay"]
    rows = log() + [event(f"q{r}", k, rng.choice(kinds), task_id=rng.choice([None, "t"]), message_id=rng.choice("mno"), output=rng.choice(["", "a", "ab", "abc", "x"]), is_final=rng.random() < 0.4, is_sequence=rng.random() < 0.3, is_reasoning=rng.random() < 0.2, checkpoint_id=str(rng.randrange(5)), waiting=rng.random() < 0.5) for r in range(5) for k in range(40)]
    rows.sort(key=lambda r: r["seq"])
    for at in range(0, len(rows), 60):
        write_events(rocksdb, rows[at : at + 60], tmp_path / "in")
        run_stream(rocksdb, tmp_path, "out", finalise_ms=None)
    batch = ev.fold_runs(rocksdb.read.schema(ev.EVENT).json(str(tmp_path / "in")))
    got = rocksdb.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)
    assert ev.completions(got.where("run_id like 'r%'")).count() == 6


def test_a_token_writes_its_own_characters(rocksdb, tmp_path):
    write_events(rocksdb, [event("r", 1, "message", message_id="m", output="x" * 300_000)], tmp_path / "in")
    first = run_stream(rocksdb, tmp_path, "out", finalise_ms=None).recentProgress[-1]
    write_events(rocksdb, [event("r", k, "token", message_id="m", output="y") for k in range(2, 30)], tmp_path / "in")
    second = run_stream(rocksdb, tmp_path, "out", finalise_ms=None).recentProgress[-1]
    written = [p["stateOperators"][0]["customMetrics"]["rocksdbTotalBytesWritten"] for p in (first, second)]
    assert written[0] > 300_000 and written[1] < 20_000
    write_events(rocksdb, [event("r", 40, "message", message_id="m", output="x" * 300_000 + "y" * 28 + "!")], tmp_path / "in")
    run_stream(rocksdb, tmp_path, "out", finalise_ms=None)
    assert rocksdb.read.parquet(str(tmp_path / "out")).where("seq = 40").first().text == "!"


def test_a_deadline_fails_a_run_of_a_stream(rocksdb, tmp_path):
    rows = [event("r", 1, "start"), event("r", 2, "end"), event("s", 1, "start"), event("s", 2, "message", message_id="m", output="a", is_final=True), event("s", 3, "end")]
    write_events(rocksdb, rows, tmp_path / "in")
    q = ev.stream_runs(rocksdb.readStream.schema(ev.EVENT).json(str(tmp_path / "in")), 200).writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "ck")).start()
    end = time.time() + 90
    while time.time() < end and rocksdb.table("late").where("change = 'failed'").isEmpty():
        time.sleep(1)
    q.stop()
    assert [(r.run_id, r.seq, r.status) for r in rocksdb.table("late").where("change = 'failed'").collect()] == [("r", None, "failed")]


def test_keyed_state_needs_its_store(spark, tmp_path):
    write_events(spark, log(), tmp_path / "in")
    with pytest.raises(ValueError, match="RocksDB"):
        ev.stream_runs(spark.readStream.schema(ev.EVENT).json(str(tmp_path / "in")))


def test_a_deleted_final_message_gives_way_to_the_one_before():
    rows = [("message", "a", True), ("message", "b", True), ("message", "c", False), ("delete", "b", False), ("end", None, False), ("delete", "a", False), ("message", "a", True)]
    run, out = changes([event("r", 1, "start")] + [event("r", k + 2, kind, message_id=m, output=m, is_final=f) for k, (kind, m, f) in enumerate(rows)])
    assert [c[:2] for c in out if c[0] in ("completed", "retract")] == [("retract", "b"), ("completed", "a"), ("retract", "a")]


def test_completions_over_a_stream_need_a_time(spark, tmp_path):
    rows = [("r", "m", "completed", k) for k in range(3)] + [("r", "n", "completed", 4), ("r", "m", "append", 5)]
    spark.createDataFrame(rows, "run_id string, message_id string, change string, s long").withColumn("ts", F.timestamp_seconds("s")).write.parquet(str(tmp_path / "c"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "c")).schema).parquet(str(tmp_path / "c"))
    with pytest.raises(ValueError):
        ev.completions(stream)
    q = ev.completions(stream, "ts").writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.message_id for r in spark.table("once").collect()) == ["m", "n"]


def test_windows_over_a_stream(spark, tmp_path):
    spark.createDataFrame([(k, "a") for k in range(0, 7200, 600)], "s long, t string").selectExpr("timestamp_seconds(s) as ts", "t").write.parquet(str(tmp_path / "w"))
    df = spark.read.parquet(str(tmp_path / "w"))
    stream = ev.event_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "w")), "ts", "1 hour", "0 seconds", ["t"])
    q = stream.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.n for r in spark.table("windows").collect()] == [6]
    assert sorted(r.n for r in ev.event_counts(df, "ts", "1 hour", "0 seconds", ["t"]).collect()) == [6, 6]


def test_expiry():
    run, _ = changes([event("r", 1, "start"), event("r", 2, "end")])
    assert run.expire() == [("failed", None, "no final message")] and run.status == "failed" and run.expire() == []


def test_batch_folds(spark):
    df = spark.createDataFrame([("a", k, f"m{k % 2}", f"t{k}", str(k)) for k in range(6)], "run string, seq int, key string, text string, ck string")
    assert [r.sequence for r in ev.bounded_history(df, "run", ["seq"], 2).orderBy("seq").collect()] == [5, 6]
    assert {(r.key, r.position, r.text) for r in ev.upsert_messages(df, "key", "seq", "text").collect()} == {("m0", 0, "t4"), ("m1", 1, "t5")}
    nulls = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "run string, seq int")
    assert sorted((str(r.run), r.sequence) for r in ev.bounded_history(nulls, "run", ["seq"], 1).collect()) == [("None", 2), ("a", 1)]
    said = spark.createDataFrame([("c", 1, "assistant", "error"), ("c", 2, "user", "plain"), ("c", 3, "assistant", "stopped"), ("c", 4, "assistant", "error"), ("c", 5, "assistant", "error")], "conv string, turn int, role string, kind string")
    assert [r.turn for r in ev.latest_error(said, "conv", "turn", "role", "kind").collect()] == [5] and [r.turn for r in ev.latest_stop(said, "conv", "turn", "role", "kind").collect()] == [3]
    late = spark.createDataFrame([("a", 1, "05"), ("a", 2, "03"), ("a", 3, "05"), ("a", 4, "09")], "run string, seq int, ck string")
    assert [r.ck for r in ev.monotone_checkpoints(late, "run", "seq", "ck").orderBy("seq").collect()] == ["05", "05", "09"]


@pytest.mark.parametrize(("meta", "want"), [
    ({"section": "progress", "progress": {"done": True, "phases": [{"id": "1", "kind": "k", "state": "active", "label": "L", "count": {"done": 2, "total": 5}}, {"id": "2"}]}}, [(True, 1, "L", "L (2/5)")]),
    ({"section": "progress", "progress": {}}, [(False, 0, None, None)]),
    ({"section": "other"}, []),
])
def test_progress(spark, meta, want):
    df = spark.createDataFrame([(json.dumps(meta),)], "m string")
    got = ev.progress_phases(df, "m").select("done", F.size("phases"), "active", "message").collect()
    assert [tuple(r) for r in got] == want
