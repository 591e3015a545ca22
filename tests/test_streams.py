"""Streams that are stopped, resumed and asked to end, against batch folds and plain Python."""

from __future__ import annotations

import datetime
import json
import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import recognize
from gridloom.operators.recognize import Reading
from gridloom.streaming import cache, inbox, states, store

MOVES = "job_id long, status string, at timestamp, seq long"


def at(seconds: float) -> datetime.datetime:
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def arrive(spark, rows, schema, folder) -> None:
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def moves(n: int) -> list[tuple]:
    rng = random.Random(n)
    return [(rng.randrange(6), rng.choice(["queued", "running", "completed", "failed"]), at(rng.randrange(20)), i) for i in range(n)]


def test_job_states_of_a_stream_that_resumes(spark, tmp_path):
    """However transitions are dealt to batches and runs, jobs end as the batch fold has them."""
    rows = [*moves(60), (3, states.BEAT, at(90), 100)]
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    random.Random(1).shuffle(rows)
    for part in (rows[:25], rows[25:30], rows[30:]):
        arrive(spark, part, MOVES, source)
        states.keep_states(inbox.arrivals(spark, source, MOVES), states.appending(out), f"file://{tmp_path}/check").awaitTermination()
    want = inbox.job_states(spark.createDataFrame(rows, MOVES).where(F.col("status") != states.BEAT)).select("job_id", "status", "at", "attempt")
    changes = spark.read.parquet(out)
    assert sorted(states.newest_states(changes).collect()) == sorted(want.collect())
    # each batch changes a job once, and its versions count on over the runs
    assert changes.groupBy("job_id").agg((F.max("version") == F.count("*")).alias("ok")).where("not ok").count() == 0


def test_a_batch_gives_the_state_one_row_a_job(spark):
    """However many rows a job has, and however often they are cut down within a task, its state sees one of them."""
    rows = [*moves(400), (None, "running", None, 400), (None, states.BEAT, at(9), 401), (9, states.BEAT, at(1), 402), (9, "queued", None, 403)]
    given = spark.createDataFrame(rows, MOVES).select("job_id", F.unix_micros("at").alias("at"), "seq", F.expr("nullif(status, 'beat') status"), F.expr("bigint(status = 'running') attempts"))
    got = states.met(given.coalesce(1), 7)
    want = inbox.job_states(spark.createDataFrame(rows, MOVES).where(F.col("status") != states.BEAT)).select("job_id", "status", "attempt")
    assert got.count() == 8 and sorted(map(str, got.select("job_id", "status", F.col("attempts").alias("attempt")).collect())) == sorted(map(str, want.collect()))
    # without leases no job is handed to Python
    assert "transformWithState" in states.job_changes.__code__.co_names and "TransformWithState" not in states.job_changes(spark.createDataFrame(rows, MOVES))._jdf.queryExecution().toString()


def test_a_lone_silent_job_expires(spark, tmp_path):
    """A running job's lease ends by the clock, with nothing else heard; ended and queued jobs have none."""
    source, out = f"file://{tmp_path}/in", tmp_path / "out"
    arrive(spark, [(1, "running", at(0), 0), (2, "running", at(0), 1), (2, "completed", at(1), 2), (3, "queued", at(0), 3)], MOVES, source)
    with pytest.raises(ValueError, match="every"):
        states.keep_states(inbox.arrivals(spark, source, MOVES), states.appending(str(out)), f"file://{tmp_path}/check", 1.0)
    expired = threading.Event()

    def each(batch, number):
        rows = batch.collect()
        seen.extend(rows)
        if any(r.expired for r in rows):
            (tmp_path / "drain").write_text("")
            expired.set()

    seen: list = []
    gate = inbox.Gate(each)
    query = states.keep_states(inbox.arrivals(spark, source, MOVES), gate, f"file://{tmp_path}/check", 1.0, "200 milliseconds")
    threading.Timer(90, lambda: (tmp_path / "drain").write_text("")).start()
    inbox.run_until_asked(query, gate, f"file://{tmp_path}/drain", poll=0.1)
    assert expired.is_set()
    assert sorted((r.job_id, r.status, r.expired) for r in seen if r.expired) == [(1, "queued", True)]
    assert {(r.job_id, r.status) for r in seen} == {(1, "running"), (1, "queued"), (2, "completed"), (3, "queued")}


JOBS = 30


def first_jobs() -> list[dict]:
    rng = random.Random(5)
    out = []
    for i in range(JOBS):
        running = i % 4 == 0
        out.append(dict.fromkeys(store.NAMES) | {"id": i, "batch_id": None if i % 9 == 8 else i // 4, "status": "running" if running else rng.choice(["queued", "queued", "failed", "completed"]), "attempt": int(running), "done": 0, "total": 0, "created_at": at(rng.randrange(10)), "seq": i, "lease_owner": "w0" if running else None, "lease_until": at(rng.choice([5, 500])) if running and i % 8 else None})
    return out


def asked(n: int) -> list[dict]:
    rng = random.Random(n)
    kinds = ["claim"] * 4 + ["beat", "progress", "finish", "finish", "cancel", "delete", "recover", "submit"]
    out = []
    for i in range(n):
        kind = rng.choice(kinds)
        named = kind not in ("claim", "recover")
        out.append({"number": i, "kind": kind, "at": at(20 + i), "job_id": rng.randrange(JOBS + 6) if named else None, "batch_id": rng.randrange(9), "worker": f"w{rng.randrange(3)}", "seconds": rng.choice([1, 5, 40]), "status": rng.choice(["completed", "completed_with_warnings", "failed"]), "done": i, "total": 2 * i})
    return out


def plain_fold(jobs: list[dict], requests: list[dict]) -> tuple[dict[int, dict], list[tuple]]:
    """The store by a loop over all jobs for each request."""
    by, answers = {j["id"]: dict(j) for j in jobs}, []
    free = {"lease_owner": None, "lease_until": None}
    for r in requests:
        j, ok = by.get(r["job_id"]), False
        if r["kind"] == "claim":
            waiting = sorted((x for x in by.values() if x["status"] == "queued"), key=lambda x: (x["created_at"], x["seq"]))
            if waiting:
                j, ok = waiting[0], True
                j.update(status="running", attempt=j["attempt"] + 1, started_at=j["started_at"] or r["at"], lease_owner=r["worker"], lease_until=r["at"] + datetime.timedelta(seconds=r["seconds"]))
        elif r["kind"] == "recover":
            for x in by.values():
                if x["status"] == "running" and (x["lease_until"] is None or x["lease_until"] <= r["at"]):
                    x.update(status="queued", **free)
        elif r["kind"] == "submit":
            if j is None:
                ok = True
                by[r["job_id"]] = dict.fromkeys(store.NAMES) | {"id": r["job_id"], "batch_id": r["batch_id"], "status": "queued", "attempt": 0, "done": 0, "total": 0, "created_at": r["at"], "seq": r["number"]}
        elif j is not None:
            run = j["status"] == "running"
            if r["kind"] == "beat" and run and j["lease_owner"] == r["worker"]:
                ok = True
                j.update(lease_until=r["at"] + datetime.timedelta(seconds=r["seconds"]))
            elif r["kind"] == "progress" and run:
                ok = True
                j.update(done=r["done"], total=r["total"])
            elif r["kind"] == "finish" and run:
                ok = True
                j.update(status=r["status"], finished_at=r["at"], **free)
            elif r["kind"] == "cancel" and j["status"] in ("queued", "running"):
                ok = True
                j.update(status="cancelled", finished_at=r["at"], **free)
            elif r["kind"] == "delete" and not run:
                ok = True
                del by[j["id"]]
        answers.append((r["number"], r["kind"], j["id"] if ok and j else r["job_id"], ok))
    return by, answers


def test_written_store_equals_a_plain_fold(spark, tmp_path, monkeypatch):
    """A store whose writer fails in the middle of batches and resumes grants what a loop over the requests grants, and no job twice."""
    base = f"file://{tmp_path}"
    jobs, requests = first_jobs(), asked(80)
    store.seeded(spark.createDataFrame(jobs, store.JOB), f"{base}/store")
    for cut in range(0, 80, 20):
        arrive(spark, requests[cut : cut + 20], store.REQUEST, f"{base}/in")
    put, failures = store.put, iter([("answers", 0), ("batches", 1), ("jobs", 2)])
    due = [next(failures)]

    def failing(rows, path, version):
        if due[0] and path.endswith(due[0][0]) and version == due[0][1]:
            due[0] = next(failures, None)
            raise OSError("the writer is lost")
        put(rows, path, version)

    monkeypatch.setattr(store, "put", failing)
    lost = 0
    while True:
        try:
            inbox.start(inbox.arrivals(spark, f"{base}/in", store.REQUEST), store.serving(f"{base}/store", compact_every=2), f"{base}/check").awaitTermination()
            break
        except Exception as error:
            assert "the writer is lost" in str(error)
            lost += 1
    assert lost == 3
    want, answers = plain_fold(jobs, requests)
    now, batches = store.current(spark, f"{base}/store")
    assert sorted(tuple(r[c] for c in store.NAMES) for r in now.collect()) == sorted(tuple(j[c] for c in store.NAMES) for j in want.values())
    got = spark.read.parquet(f"{base}/store/answers").select("number", "kind", "job_id", "granted").collect()
    assert sorted(map(tuple, got)) == answers
    # parents: counts, statuses and emptied batches as a full roll-up has them
    full = {r.batch_id: (r.status, r.jobs) for r in store.rolled(spark.createDataFrame(list(want.values()), store.JOB), F.max("finished_at")).collect()}
    kept = {r.batch_id: r for r in batches.collect()}
    assert {b: (r.status, r.jobs) for b, r in kept.items()} == full
    assert all((r.completed_at is None) == (r.status in ("queued", "running")) for r in kept.values() if r.started_at)


def test_requests_that_are_apart_go_by_joins(spark, monkeypatch):
    """Recoveries and then claims by rank, other requests job by job: the same as in turn, also where the queue runs dry; claims that may reach a named job go in turn."""
    jobs, rng, groups, carried = first_jobs(), random.Random(7), [], store.carried
    monkeypatch.setattr(store, "carried", lambda pool, requests, n: groups.append((n, requests.where("kind = 'claim'").count())) or carried(pool, requests, n))
    monkeypatch.setattr(store, "GROUP", 3)
    waiting = [j["id"] for j in sorted(jobs, key=lambda j: (j["created_at"], j["seq"])) if j["status"] == "queued"]
    running = [j["id"] for j in jobs if j["status"] == "running"]
    ask = lambda kind, job=None: dict.fromkeys(c.split()[0] for c in store.REQUEST.split(", ")) | {"kind": kind, "job_id": job, "batch_id": 1, "worker": f"w{rng.randrange(3)}", "seconds": rng.choice([1, 9]), "status": "completed", "done": 2, "total": 3}
    other = [*(ask(k, j) for j in running for k in ("beat", "progress", "finish", "cancel")), ask("cancel", waiting[-1]), ask("submit", 90), ask("submit", 90), ask("delete", 90), ask("beat", 91)]
    rng.shuffle(other)
    few, many = [ask("claim") for _ in range(4)], [ask("claim") for _ in range(JOBS)]
    mixed = [*few, *other]
    rng.shuffle(mixed)
    for batch, shape in (([ask("recover"), ask("recover"), *many], []), (mixed, [(1 + len(other) // 3, 0)]), ([ask("recover"), *mixed], [(1, 4)]), (other, [(1 + len(other) // 3, 0)]), ([*few, ask("recover")], [(1, 4)]), ([*many, ask("cancel", waiting[-1])], [(1, len(many))])):
        requests = [r | {"number": i, "at": at(20 + i)} for i, r in enumerate(batch)]
        want, answers = plain_fold(jobs, requests)
        groups.clear()
        changed, said = store.turned(spark.createDataFrame(jobs, store.JOB), spark.createDataFrame(requests, store.REQUEST))
        now, ids = {j["id"]: j for j in jobs}, [r.id for r in changed.collect()]
        assert len(ids) == len(set(ids))
        for r in changed.collect():
            now[r.id] = {c: r[c] for c in store.NAMES}
            if r.gone:
                del now[r.id]
        assert now == {i: {c: j[c] for c in store.NAMES} for i, j in want.items()}
        assert sorted(map(tuple, said.collect())) == answers
        assert groups == shape


def test_only_touched_batches_are_rolled_up(spark):
    """An emptied batch goes, a finished one keeps its time, and jobs of other batches aren't counted."""
    jobs = spark.createDataFrame([{**dict.fromkeys(store.NAMES), "id": i, "batch_id": b, "status": s} for i, (b, s) in enumerate([(1, "completed"), (1, "failed"), (2, "queued"), (2, "completed"), (4, "completed")])], store.JOB)
    batches = spark.createDataFrame([(1, "running", 9, at(0), at(5)), (3, "completed", 1, at(1), at(2)), (4, "queued", 77, None, None)], store.BATCH.replace(", gone boolean", ""))
    touched = spark.createDataFrame([(1,), (2,), (3,)], "batch_id long")
    got = {r.batch_id: (r.status, r.jobs, r.started_at, r.completed_at, r.gone) for r in store.resynced(batches, jobs, touched, F.lit(at(60)).cast("timestamp")).collect()}
    assert got == {1: ("completed_with_errors", 2, at(0), at(5), False), 2: ("running", 2, None, None, False), 3: (None, 0, at(1), None, True)}


CROP = "page int, row int, col int, height int, width int, data binary"


def crop(page: int, row: int, value: int) -> tuple:
    return page, row, 0, 4, 4, bytes([value]) * 16


def test_cache_of_a_stream(spark, tmp_path, monkeypatch):
    """Cells are read once over batches, runs and stops; failures that may pass are read again; another version reads anew."""
    base, marks = f"file://{tmp_path}", tmp_path / "marks"
    marks.mkdir()

    def reader(fail: bool):
        class Marking:
            def recognize(self, cell: np.ndarray) -> Reading:
                value = int(cell[0, 0])
                (marks / f"{value}-{time.time_ns()}").write_text("")
                if value == 7 and fail:
                    raise RuntimeError("request failed: 429 rate limit")
                if value == 8:
                    raise RuntimeError("no such glyph")
                return Reading(f"v{value}", 50.0)

        return lambda crops: recognize.read_cells(crops, Marking, prepare=False)

    def run(fail: bool, version: int = 1, out: str = "out"):
        stream = inbox.arrivals(spark, f"{base}/in", CROP)
        each = cache.reading_each(f"{base}/cache", f"{base}/{out}", "plain", reader(fail), version)
        inbox.start(stream, each, f"{base}/check-{out}").awaitTermination()
        return {(r.page, r.row): (r.text, r.validation_error) for r in spark.read.parquet(f"{base}/{out}").collect()}

    read = lambda: sorted(int(m.name.split("-")[0]) for m in marks.iterdir())
    arrive(spark, [crop(1, 0, 1), crop(1, 1, 7), crop(1, 2, 8), crop(1, 3, 1)], CROP, f"{base}/in")
    first = run(True)
    assert first == {(1, 0): ("v1", None), (1, 3): ("v1", None), (1, 1): ("", "request failed: 429 rate limit"), (1, 2): ("", "no such glyph")} and read() == [1, 7, 8]
    # a stop after the attempts are written and before the readings are
    arrive(spark, [crop(2, 0, 1), crop(2, 1, 7), crop(2, 2, 9), crop(2, 3, 8)], CROP, f"{base}/in")
    attempts, calls = cache.attempts, []

    def failing(session, folder):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("stopped")
        return attempts(session, folder)

    monkeypatch.setattr(cache, "attempts", failing)
    with pytest.raises(Exception, match="stopped"):
        run(False)
    assert read() == [1, 7, 7, 8, 9]
    got = run(False)
    assert read() == [1, 7, 7, 8, 9] and {k: v for k, v in got.items() if k[0] == 2} == {(2, 0): ("v1", None), (2, 1): ("v7", None), (2, 2): ("v9", None), (2, 3): ("", "no such glyph")}
    run(False, 2, "again")
    assert read() == sorted([1, 7, 7, 8, 9] + [1, 7, 8, 9])


def test_passing_failures_stay_out_of_the_cache(spark):
    cells = spark.createDataFrame([crop(1, i, v) for i, v in enumerate([1, 2, 2])], CROP)
    none = spark.createDataFrame([], cache.ATTEMPT)

    class Failing:
        def recognize(self, cell):
            if cell[0, 0] == 2:
                raise RuntimeError("Connection reset")
            return Reading("one")

    readings, added = recognize.read_cached(cells, none, "s", lambda df: recognize.read_cells(df, Failing, prepare=False))
    assert sorted((r.row, r.text, r.validation_error) for r in readings.collect()) == [(0, "one", None), (1, "", "Connection reset"), (2, "", "Connection reset")]
    assert [(r.text, r.validation_error) for r in added.collect()] == [("one", None)]


def test_stop_after_the_current_batch(spark, tmp_path):
    """With input still arriving a worker stops after the batch that runs; the next run has all the rest, once; a reader of the status always finds it whole."""
    source, status = f"file://{tmp_path}/in", tmp_path / "status.json"
    done, over, states_seen, seen = spark.sparkContext.accumulator(0), threading.Event(), [], []

    def feed():
        for i in range(10_000):
            if over.is_set():
                return
            arrive(spark, [(i,)], "job_id long", source)
            time.sleep(0.05)

    def look():
        while not over.is_set():
            if status.exists():
                states_seen.append(json.loads(status.read_text()))

    def each(batch, number):
        def slow(rows):
            for b in rows:
                time.sleep(0.3)
                done.add(b.num_rows)
                yield b

        seen.append((number, [r.job_id for r in batch.repartition(8).mapInArrow(slow, "job_id long").collect()]))
        if number == 1:
            (tmp_path / "drain").write_text("")
            time.sleep(0.5)

    arrive(spark, [(-i,) for i in range(1, 9)], "job_id long", source)
    threads = [threading.Thread(target=f, daemon=True) for f in (feed, look)]
    for t in threads:
        t.start()
    gate = inbox.Gate(each)
    query = inbox.start(inbox.arrivals(spark, source, "job_id long", 1000), gate, f"file://{tmp_path}/check", "100 milliseconds")
    inbox.run_until_asked(query, gate, f"file://{tmp_path}/drain", f"file://{status}", 0.05, done)
    over.set()
    for t in threads:
        t.join()
    assert [n for n, _ in seen] == [0, 1] and not query.isActive
    last = json.loads(status.read_text())
    assert last["state"] == "stopped" and last["batch"] == 1 and {s["state"] for s in states_seen} <= {"running", "draining", "stopped"}
    # the count moved while the first batch ran
    assert len({s["done"] for s in states_seen if s["batch"] == 0}) > 1
    inbox.start(inbox.arrivals(spark, source, "job_id long", 1000), lambda batch, n: seen.append((n, [r.job_id for r in batch.collect()])), f"file://{tmp_path}/check").awaitTermination()
    every = sorted(i for _, ids in seen for i in ids)
    assert every == sorted(r.job_id for r in spark.read.parquet(source).collect()) and len(set(every)) == len(every)


def test_an_own_failure_is_no_drain(spark, tmp_path):
    source, status = f"file://{tmp_path}/in", tmp_path / "status.json"
    arrive(spark, [(1,)], "job_id long", source)

    def each(batch, number):
        raise RuntimeError("broken")

    gate = inbox.Gate(each)
    query = inbox.start(inbox.arrivals(spark, source, "job_id long"), gate, f"file://{tmp_path}/check")
    with pytest.raises(Exception, match="broken"):
        inbox.run_until_asked(query, gate, f"file://{tmp_path}/drain", f"file://{status}", 0.05)
    assert json.loads(status.read_text())["state"] == "failed"


def test_progress_moves_while_cells_are_read(spark):
    done, told = spark.sparkContext.accumulator(0), []

    class Slow:
        def recognize(self, cell):
            time.sleep(0.05)
            return Reading("x")

    cells = spark.createDataFrame([crop(1, i, i) for i in range(24)], CROP).repartition(8)
    with inbox.counting(done, 24, lambda n, of: told.append((n, of)), 0.02):
        recognize.read_cells(cells, Slow, prepare=False, done=done).collect()
    assert told[-1] == (24, 24) and len(told) > 2 and told == sorted(told)


def test_a_steady_source_cannot_hold_up_a_drain(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    arrive(spark, [(1,)], "job_id long", source)

    def each(batch, number):
        arrive(spark, [(number + 2,)], "job_id long", source)

    query = inbox.start(inbox.arrivals(spark, source, "job_id long"), each, f"file://{tmp_path}/check", "50 milliseconds")
    (tmp_path / "drain").write_text("")
    began = time.time()
    inbox.run_until_drained(query, f"file://{tmp_path}/drain", poll=0.05, patience=3)
    assert time.time() - began < 60 and not query.isActive
