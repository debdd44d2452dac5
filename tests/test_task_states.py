"""Queues with timers, against the same rules folded over all events at once."""

import json
from datetime import datetime, timedelta, timezone

import pytest

from quarry.operators.limiter import Window
from quarry.streaming import task_states as ts

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(minutes):
    return (T0 + timedelta(minutes=minutes)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


@pytest.fixture(scope="module", autouse=True)
def state_store(spark):
    before = spark.conf.get(ts.STATE_STORE[0], None)
    spark.conf.set(*ts.STATE_STORE)
    yield
    spark.conf.unset(ts.STATE_STORE[0]) if before is None else spark.conf.set(ts.STATE_STORE[0], before)


def run(spark, tmp_path, schema, batches, make, keys=("task_id",)):
    """Rows of each batch, and the number of rows of state after the last."""
    source, name = tmp_path / "in", "s_" + "".join(c for c in tmp_path.name if c.isalnum())
    source.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    query = make(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
    try:
        for i, rows in enumerate(batches):
            (source / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
            query.processAllAvailable()
        state = [op["numRowsTotal"] for op in json.loads(query.lastProgress.json)["stateOperators"]] if hasattr(query.lastProgress, "json") else [op["numRowsTotal"] for op in query.lastProgress["stateOperators"]]
    finally:
        query.stop()
    return spark.table(name).collect(), state


def task(name, minutes, kind):
    return {"task_id": name, "at": at(minutes), "kind": kind}


def minutes(row):
    return (row["at"].astimezone(timezone.utc) - T0).total_seconds() / 60 if row["at"].tzinfo else (row["at"] - T0.replace(tzinfo=None)).total_seconds() / 60


def test_leases_run_out_and_tasks_are_forgotten(spark, tmp_path):
    batches = [
        [task("a", 0, "new"), task("b", 1, "new"), task("c", 2, "new"), task("a", 0.5, "new")],
        # An outcome that arrives before an earlier one of the same task.
        [task("c", 4, "done"), task("b", 3, "failed"), task("x", 3, "done")],
        [task("c", 3, "failed"), task("clock", 30, "new")],
        [task("a", 29.2, "done"), task("b", 29.5, "done"), task("clock", 29.8, "done")],
        [task("tick", 300, "done")],
        [task("tick", 301, "done")],
    ]
    rows, state = run(spark, tmp_path, "task_id string, at timestamp, kind string", batches, lambda s: ts.deliveries(s, lease_s=600, keep_s=3600, late="1 minute"))
    found = {}
    for r in rows:
        found.setdefault(r.task_id, []).append((round(minutes(r), 3), r.action, r.retries, r.deliveries))
    assert sorted(found["a"]) == [(0, "deliver", 0, 1), (10, "deliver", 0, 2), (20, "deliver", 0, 3), (29.2, "done", 0, 3)]
    assert sorted(found["b"]) == [(1, "deliver", 0, 1), (11, "deliver", 1, 2), (21, "deliver", 1, 3), (29.5, "done", 1, 3)]
    assert sorted(found["c"]) == [(2, "deliver", 0, 1), (4, "done", 0, 1)] or sorted(found["c"]) == [(2, "deliver", 0, 1), (4, "done", 1, 1)]
    assert "x" not in found
    # Only what the last events wait for is left: all tasks but the open one are forgotten.
    assert state[0] <= 12


def test_backoff_and_final_failure(spark, tmp_path):
    batches = [[task("a", 0, "new"), task("z", 0, "new")]] + [[task("a", m, "failed"), task("clock", m + 2, "failed")] for m in (1, 20, 100)] + [[task("clock", 200, "failed")], [task("clock", 201, "failed")]]
    rows, _ = run(spark, tmp_path, "task_id string, at timestamp, kind string", batches, lambda s: ts.deliveries(s, lease_s=60_000, retries=2, backoff_s=(300, 900), late="1 minute"))
    got = sorted((round(minutes(r), 3), r.action, r.retries) for r in rows if r.task_id == "a")
    assert got == [(0, "deliver", 0), (6, "deliver", 1), (35, "deliver", 2), (100, "fail", 2)]


def test_queues_in_a_chain(spark, tmp_path):
    def make(stream):
        first = ts.deliveries(stream.where("queue = 1").select("task_id", "at", "kind"), lease_s=600, late="1 minute")
        return ts.chained(first, stream.where("queue = 2").select("task_id", "at", "kind"), late="1 minute", lease_s=600)

    both = lambda *x: [dict(task(*r[1:]), queue=r[0]) for r in x]
    batches = [
        both((1, "a", 0, "new"), (1, "b", 0, "new")),
        both((1, "a", 5, "done"), (2, "b", 5, "done")),
        both((1, "clock", 20, "done"), (2, "clock", 20, "done")),
        both((2, "a", 19.5, "done"), (1, "clock", 40, "done"), (2, "clock", 40, "done")),
        both((1, "clock", 60, "done"), (2, "clock", 60, "done")),
        both((1, "clock", 61, "done"), (2, "clock", 61, "done")),
    ]
    rows, _ = run(spark, tmp_path, "task_id string, at timestamp, kind string, queue int", batches, make)
    # b is never done in the first queue, so the second does not know it.
    assert sorted((r.task_id, round(minutes(r), 3), r.action) for r in rows) == [("a", 5, "deliver"), ("a", 15, "deliver"), ("a", 19.5, "done")]


def test_limiter_forgets_keys_whose_window_has_ended(spark, tmp_path):
    attempt = lambda key, seq, s, ok=False: {"key": key, "seq": seq, "at": at(s / 60), "success": ok}
    batches = [
        [attempt("k", 1, 10), attempt("k", 0, 0), attempt("m", 0, 5, True)],
        [attempt("k", 2, 20), attempt("m", 1, 21), attempt("m", 2, 22), attempt("m", 3, 23)],
        [attempt("k", 3, 61), attempt("clock", 0, 200)],
        [attempt("clock", 1, 900)],
        [attempt("clock", 2, 901)],
    ]
    rows, state = run(spark, tmp_path, "key string, seq long, at timestamp, success boolean", batches, lambda s: ts.limited(s, 2, 60, late="3 minutes"))
    want = {}
    for key in "km":
        window = Window()
        for x in sorted((r for b in batches for r in b if r["key"] == key), key=lambda r: r["at"]):
            seconds = (datetime.fromisoformat(x["at"]) - T0).total_seconds()
            allowed, wait = window.attempt(seconds, 2, 60)
            want[key, x["seq"]] = allowed, wait
            if x["success"] and allowed:
                window.reset()
    assert {(r.key, r.seq): (r.allowed, r.retry_after) for r in rows if r.key != "clock"} == want
    assert want["k", 2] == (False, 40) and state[0] <= 12
