"""Chunked folds with a hot key, sampling, and the streaming variants."""

import tempfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from monofila.operators import events as E
from monofila.operators import sampling as M
from monofila.operators import chunks as C
from monofila.operators.chunks import ordered_chunks, settle
from monofila.streaming.guards import _judge, accept_late, lockout_stream, rate_limit_stream
from test_event_folds import slow_accept, slow_lock

SCHEMA = "event_id bigint, user_id bigint, ts timestamp, bad boolean"


def events(spark, regular):
    """One user with most rows, the rest spread thin. Regular gaps never let a chunk
    forget its past, so entries must travel through every chunk of the hot user."""
    rng = np.random.default_rng(5)
    rows, at = [], 0
    for i in range(600):
        at += 60 if regular else int(rng.integers(1, 900))
        rows.append((i, 7, at, bool(rng.random() < 0.7)))
    rows += [(600 + i, int(u), int(t), bool(rng.random() < 0.7)) for i, (u, t) in enumerate(zip(rng.integers(1, 30, 200), rng.integers(0, 40_000, 200)))]
    order = rng.permutation(len(rows))
    data = spark.createDataFrame([rows[i] for i in order], "event_id bigint, user_id bigint, sec bigint, bad boolean")
    frame = data.select("event_id", "user_id", F.timestamp_seconds("sec").alias("ts"), "bad")
    by_user = {}
    for e, u, t, b in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        by_user.setdefault(u, []).append((e, t, b))
    return frame, by_user


@pytest.mark.parametrize("regular", [True, False])
@pytest.mark.parametrize("chunks", [1, 13])
def test_rate_limit_equals_the_sequential_check(spark, regular, chunks):
    frame, by_user = events(spark, regular)
    got = {r["event_id"]: r["accepted"] for r in E.rate_limit(frame, window_seconds=1000, chunks=chunks).collect()}
    for rows in by_user.values():
        wanted = slow_accept([t for _, t, _ in rows], 3, 1000)
        assert [got[e] for e, _, _ in rows] == wanted


@pytest.mark.parametrize("regular", [True, False])
@pytest.mark.parametrize("chunks", [1, 13])
def test_lockouts_equal_the_sequential_check(spark, regular, chunks):
    frame, by_user = events(spark, regular)
    found = E.lockouts(frame, F.col("bad"), failures=4, lock_seconds=700, chunks=chunks).collect()
    got = {r["event_id"]: r["outcome"] for r in found}
    for rows in by_user.values():
        wanted = slow_lock([t for _, t, _ in rows], [b for _, _, b in rows], 4, 700)
        assert [got[e] for e, _, _ in rows] == wanted


def passes(monkeypatch):
    """Jobs over the chunks, as they are started."""
    done = []
    for name in ("_summaries", "_courses"):
        monkeypatch.setattr(C, name, lambda *a, run=getattr(C, name), name=name: done.append(name) or run(*a))
    return done


def dense(spark, size, gap_every=None):
    """One user who never pauses for a window, or pauses that long every now and then."""
    rng = np.random.default_rng(8)
    rows = [(i, 7, 10 * i + (5_000 * (i // gap_every) if gap_every else 0), bool(rng.random() < 0.9)) for i in range(size)]
    frame = spark.createDataFrame(rows, "event_id bigint, user_id bigint, sec bigint, bad boolean")
    return rows, frame.select("event_id", "user_id", F.timestamp_seconds("sec").alias("ts"), "bad")


@pytest.mark.parametrize("steps", [100_000, 3])
def test_a_dense_user_is_locked_in_two_passes_whatever_the_chunks(spark, monkeypatch, steps):
    monkeypatch.setattr(C, "COURSE_STEPS", steps)
    rows, frame = dense(spark, 1_280)
    done = passes(monkeypatch)
    found = E.lockouts(frame, F.col("bad"), failures=4, lock_seconds=700, chunks=64 if steps > 3 else 6).collect()
    got = {r["event_id"]: r["outcome"] for r in found}
    assert [got[e] for e, *_ in rows] == slow_lock([t for _, _, t, _ in rows], [b for *_, b in rows], 4, 700)
    # Courses that are too long to be sent leave their chunks to be folded in turn.
    assert done == ["_summaries", "_courses"] if steps > 3 else len(done) > 2


def test_passes_do_not_grow_with_the_chunks_of_a_user_who_pauses(spark, monkeypatch):
    rows, frame = dense(spark, 960, gap_every=12)
    done, counts = passes(monkeypatch), []
    for chunks in (4, 40):
        done.clear()
        got = {r["event_id"]: r["accepted"] for r in E.rate_limit(frame, window_seconds=1000, chunks=chunks).collect()}
        counts.append(len(done))
        assert [got[e] for e, *_ in rows] == slow_accept([t for _, _, t, _ in rows], 3, 1000)
    assert counts[1] <= counts[0] + 1 <= 4


def test_failure_streaks_cross_chunks(spark):
    frame, by_user = events(spark, True)
    found = E.failure_streaks(frame, F.col("bad"), chunks=13).collect()
    got = {(r["user_id"], r["first_id"]): (r["n_failures"], r["last_id"], r["n_successes_before"]) for r in found}
    wanted = {}
    for user, rows in by_user.items():
        run, before = [], 0
        for e, _, b in [*rows, (None, None, False)]:
            if b:
                run.append(e)
                continue
            if run:
                wanted[(user, run[0])] = (len(run), run[-1], before)
            run, before = [], before + 1
    assert got == wanted


def test_text_keys_and_missing_keys(spark):
    at = "timestamp_seconds(id * 10)"
    frame = spark.range(40).selectExpr("concat('e', id) AS event_id", "CASE WHEN id % 2 = 0 THEN 'a@b' END AS user_id", f"{at} AS ts")
    got = E.rate_limit(frame, limit=2, window_seconds=100_000, chunks=5)
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "string", "int"]
    assert {r["user_id"]: r["s"] for r in got.groupBy("user_id").agg(F.sum("accepted").alias("s")).collect()} == {"a@b": 2, None: 2}
    with pytest.raises(Exception, match="event without time"):
        E.rate_limit(frame.withColumn("ts", F.lit(None).cast("timestamp"))).collect()


def test_chunks_are_even_and_split_the_hot_key(spark):
    frame, _ = events(spark, True)
    placed = ordered_chunks(frame, "user_id", "ts", "event_id", chunks=13)
    sizes = [r["count"] for r in placed.groupBy("chunk").count().collect()]
    assert len(sizes) == 13 and max(sizes) <= 3 * 800 // 13
    assert placed.filter("key = 7").select("chunk").distinct().count() >= 8
    from functools import partial
    assert len(settle(placed, partial(E.accept, limit=3, window=10**9))) >= 7


def test_retention(spark):
    frame = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-31'), (2, timestamp'2024-01-16'), (3, timestamp'2024-01-15 23:59:59') AS e(id, ts)")
    assert sorted(r["id"] for r in E.retain(frame).collect()) == [1, 2]
    fixed = E.retain(frame, reference=F.lit("2024-02-10").cast("timestamp"))
    assert [r["id"] for r in fixed.collect()] == [1]


def test_cohorts_are_exact_disjoint_and_repeatable(spark):
    rows = spark.range(10_000)
    cohorts = [("none", 0.065), ("own", 0.73)]
    split = M.split_cohorts(rows, "s", ["id"], cohorts, "other")
    sizes = {r["cohort"]: r["count"] for r in split.groupBy("cohort").count().collect()}
    assert sizes == {"none": 650, "own": int(9350 * 0.73), "other": 9350 - int(9350 * 0.73)}
    assert split.select("id").distinct().count() == 10_000
    again = M.split_cohorts(rows.repartition(7), "s", ["id"], cohorts, "other")
    assert split.exceptAll(again).isEmpty()


def test_counts_are_exact_and_asking_too_much_fails(spark):
    rows = spark.range(1000).withColumn("g", F.lit("all"))
    split = M.split_counts(rows, "s", ["id"], [("a", 100), ("b", 50)], "g")
    assert {r["cohort"]: r["count"] for r in split.groupBy("cohort").count().collect()} == {"a": 100, "b": 50}
    with pytest.raises(Exception, match="2000 rows asked for"):
        M.split_counts(rows, "s", ["id"], [("a", 2000)], "g").collect()


def test_weighted_draw_follows_the_weights(spark):
    drawn = spark.range(20_000).select(M.weighted_draw("s", [("a", 92), ("b", 5), ("c", 3)], "id").alias("v"))
    shares = {r["v"]: r["count"] / 20_000 for r in drawn.groupBy("v").count().collect()}
    assert abs(shares["a"] - 0.92) < 0.01 and abs(shares["b"] - 0.05) < 0.01
    assert spark.range(3).select(M.weighted_draw("s", [("only", 1)], "id").alias("v")).distinct().count() == 1


def test_injected_duplicates_are_what_the_detectors_see(spark):
    rows = spark.range(3000).select(
        "id", F.col("id").alias("person"), F.element_at(F.array(F.lit("D"), F.lit("W"), F.lit("O")), (F.col("id") % 3 + 1).cast("int")).alias("channel")
    )
    got = M.inject_duplicates(rows, "s", "id", "person", "channel", 0.05, 0.1)
    assert {r["injected"]: r["count"] for r in got.groupBy("injected").count().collect()} == {"multi": 150, "internal": 300, None: 2550}
    assert got.select("id").distinct().count() == 3000
    home = F.element_at(F.array(F.lit("D"), F.lit("W"), F.lit("O")), (F.col("person") % 3 + 1).cast("int"))
    placed = got.withColumn("home", home)
    assert placed.filter("injected = 'multi' AND home = channel").isEmpty()
    assert placed.filter("injected = 'internal' AND home <> channel").isEmpty()
    assert placed.filter("injected IS NULL AND person <> id").isEmpty()


def test_cohorts_do_not_depend_on_how_fine_buckets_are_cut(spark, monkeypatch):
    rows = spark.range(3_000)
    shares = [("a", 0.31), ("b", 0.5)]
    coarse = M.split_cohorts(rows, "s", ["id"], shares, "rest").orderBy("id").collect()
    monkeypatch.setattr(M, "RANKED", 0)
    assert M.split_cohorts(rows, "s", ["id"], shares, "rest").orderBy("id").collect() == coarse
    sizes = {n: sum(r["cohort"] == n for r in coarse) for n in ("a", "b", "rest")}
    assert sizes == {"a": 930, "b": 1_035, "rest": 1_035}


def test_one_channel_gets_only_internal_duplicates(spark):
    rows = spark.range(200).select("id", F.col("id").alias("person"), F.lit("D").alias("channel"))
    got = M.inject_duplicates(rows, "s", "id", "person", "channel", 0.1, 0.1)
    assert {r["injected"]: r["count"] for r in got.groupBy("injected").count().collect()} == {"internal": 20, None: 180}


def run_stream(spark, build, name):
    """Feed the same events as four files, in time order."""
    frame, by_user = events(spark, False)
    folder = tempfile.mkdtemp(prefix="monofila-stream-")
    ordered = frame.orderBy("ts", "event_id").collect()
    for i in range(4):
        part = spark.createDataFrame(ordered[i * 200 : (i + 1) * 200], SCHEMA).coalesce(1)
        part.write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    query = (
        build(stream).writeStream.outputMode("append").format("memory").queryName(name)
        .option("checkpointLocation", tempfile.mkdtemp(prefix="monofila-state-")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(240)
    assert query.exception() is None
    return {r["event_id"]: r[-1] for r in spark.table(name).collect()}, by_user


def test_rate_limit_stream(spark):
    got, by_user = run_stream(spark, lambda s: rate_limit_stream(s, window_seconds=1000), "limited")
    for rows in by_user.values():
        assert [got[e] for e, _, _ in rows] == slow_accept([t for _, t, _ in rows], 3, 1000)


def test_lockout_stream(spark):
    got, by_user = run_stream(spark, lambda s: lockout_stream(s, F.col("bad"), failures=4, lock_seconds=700), "locked")
    for rows in by_user.values():
        assert [got[e] for e, _, _ in rows] == slow_lock([t for _, t, _ in rows], [b for _, _, b in rows], 4, 700)


def test_a_late_attempt_gets_a_verdict(spark):
    """Event 3 arrives an hour of event time after the ones that follow it."""
    folder = tempfile.mkdtemp(prefix="monofila-stream-")
    arrivals = [(1, 10_000), (2, 10_010), (4, 20_000), (3, 16_000), (5, 20_005)]
    for event, second in arrivals:
        row = spark.createDataFrame([(event, 7, False)], "event_id bigint, user_id bigint, bad boolean")
        row.select("event_id", "user_id", F.timestamp_seconds(F.lit(second)).alias("ts"), "bad").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    query = (
        rate_limit_stream(stream, window_seconds=60).writeStream.outputMode("append").format("memory").queryName("late")
        .option("checkpointLocation", tempfile.mkdtemp(prefix="monofila-state-")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(240)
    assert query.exception() is None
    assert {r["event_id"] for r in spark.table("late").collect()} == {1, 2, 3, 4, 5}


def test_a_hot_key_is_never_held_as_a_whole(spark):
    """One key with a million attempts in one micro-batch: pieces stay at the batch size."""
    folder, state, size = tempfile.mkdtemp(prefix="monofila-stream-"), tempfile.mkdtemp(prefix="monofila-state-"), 1_000_000
    rows = spark.range(0, size, 1, 1).select(
        F.col("id").alias("event_id"), F.lit(7).cast("bigint").alias("user_id"),
        F.timestamp_seconds(F.col("id") * 10).alias("ts"), F.lit(False).alias("bad"),
    )
    rows.write.mode("append").parquet(folder)

    def fold(times, marks, carried):
        taken, carried = accept_late(times, marks, carried, 3, 100_000_000)
        return taken + 2 * len(times), carried

    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    judged = _judge(stream, F.col("bad"), "user_id", "ts", "event_id", 60, "1 minute", fold, lambda _, last: last, "int")
    query = (
        judged.writeStream.outputMode("append").format("memory").queryName("hot")
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(240)
    assert query.exception() is None
    assert len([p for p in query.recentProgress if p.numInputRows]) == 1
    # 10 seconds apart, three in 100 seconds: the first three of every ten.
    wrong = F.count_if(F.col("outcome") % 2 != (F.col("event_id") % 10 < 3).cast("int"))
    rows, largest, n_wrong = spark.table("hot").agg(F.count("*"), F.max(F.col("outcome") / 2).cast("int"), wrong).first()
    assert (rows, n_wrong) == (size, 0)
    assert largest <= int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))


def test_attempts_without_a_key_form_a_key(spark):
    folder = tempfile.mkdtemp(prefix="monofila-stream-")
    rows = [(i, None if i % 2 else 0, False) for i in range(12)]
    data = spark.createDataFrame(rows, "event_id bigint, user_id bigint, bad boolean")
    data.select("event_id", "user_id", F.timestamp_seconds("event_id").alias("ts"), "bad").coalesce(1).write.mode("append").parquet(folder)
    query = (
        rate_limit_stream(spark.readStream.schema(SCHEMA).parquet(folder)).writeStream.outputMode("append").format("memory")
        .queryName("keyless").option("checkpointLocation", tempfile.mkdtemp(prefix="monofila-state-")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(240)
    got = {r["event_id"]: (r["user_id"], r["accepted"]) for r in spark.table("keyless").collect()}
    assert got == {i: (None if i % 2 else 0, int(i < 6)) for i in range(12)}


def test_stream_state_is_dropped_when_it_stops_mattering(spark):
    folder, state = tempfile.mkdtemp(prefix="monofila-stream-"), tempfile.mkdtemp(prefix="monofila-state-")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    kept = []
    for i in range(4):
        batch = spark.createDataFrame([(i, i, True)], "event_id bigint, user_id bigint, bad boolean")
        at = F.timestamp_seconds(F.lit(1_700_000_000 + i * 5000)).alias("ts")
        batch.select("event_id", "user_id", at, "bad").coalesce(1).write.mode("append").parquet(folder)
        query = (
            rate_limit_stream(stream, window_seconds=1, idle_seconds=0, slack="0 seconds").writeStream.outputMode("append").format("noop")
            .option("checkpointLocation", state).trigger(availableNow=True).start()
        )
        assert query.awaitTermination(120)
        time.sleep(1.5)
        held = spark.read.format("statestore").option("stateVarName", "carried").load(state)
        kept.append(held.count())
    assert 1 <= max(kept) <= 2, "users whose window is over leave no state"
