import json
import random

from pyspark.sql import functions as F

from jsonloom.session import fresh_path
from jsonloom.streaming.session_timers import EVENTS, SESSIONS, events_by_second, session_stream, sessions


def brute(events, gap):
    out = []
    by = {}
    for k, t, kind in events:
        if k is not None and t is not None:
            by.setdefault(k, []).append((t, kind))
    for k, ts in by.items():
        ts.sort(key=lambda x: x[0])
        run = []
        for t in ts:
            if run and t[0] - run[-1][0] > gap:
                out.append((k, run))
                run = []
            run.append(t)
        out.append((k, run))
    result = []
    for k, run in out:
        kinds = {}
        for _, kind in run:
            kinds[kind or ""] = kinds.get(kind or "", 0) + 1
        result.append((k, run[0][0], run[-1][0], len(run), kinds))
    return sorted(result, key=repr)


def got(df):
    return sorted(((r.key_, r.start_s, r.end_s, r.events, (json.loads(r.types) if isinstance(r.types, str) else r.types) if r.types else None) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "actor string, t bigint, kind string, key_ int, t_ int")


def test_random_events_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"a{int(rng.expovariate(0.4))}", 1_000_000 + rng.randrange(0, 300_000), rng.choice(["x", "y", None])) for _ in range(900)]
    rows += [("hot", 1_000_000 + i * 700, "x") for i in range(600)] + [(None, 5, "x"), ("n", None, "x")]
    df = frame(spark, [(*r, 1, 2) for r in rows])
    assert got(sessions(df, F.col("actor"), F.col("t"), kind=F.col("kind"))) == brute(rows, 1800)


def test_gap_boundary_ties_and_long_sessions(spark):
    rows = [("a", 0, "x"), ("a", 1800, "x"), ("a", 3601, "x"), ("a", 3601, "x"), ("b", 7, None)] + [("c", i * 1800, "x") for i in range(60)]
    out = got(sessions(frame(spark, [(*r, 1, 2) for r in rows]), F.col("actor"), F.col("t")))
    assert [r[:4] for r in out] == [("a", 0, 1800, 2), ("a", 3601, 3601, 2), ("b", 7, 7, 1), ("c", 0, 59 * 1800, 60)]


def test_far_and_negative_instants(spark):
    rows = [("a", -5000, "x"), ("a", 10_000_000_000, "x"), ("a", 10_000_000_100, "x")]
    out = got(sessions(frame(spark, [(*r, 1, 2) for r in rows]), F.col("actor"), F.col("t")))
    assert [r[1:4] for r in out] == [(-5000, -5000, 1), (10_000_000_000, 10_000_000_100, 2)]


def test_empty(spark):
    assert got(sessions(frame(spark, []), F.col("actor"), F.col("t"))) == []


def test_stream_with_late_events(spark):
    """Batches out of order within the allowed lateness give the same sessions; only what the watermark has passed comes out."""
    work = fresh_path(spark, "late")
    batches = [[("a", 0), ("b", 100)], [("a", 3000)], [("a", 1500)], [("z", 90_000)]]
    for i, b in enumerate(batches):
        df = spark.createDataFrame([(k, t, None) for k, t in b], "actor string, t bigint, kind string")
        events_by_second(df, F.col("actor"), F.col("t")).write.mode("append").parquet(f"{work}/in")
        out = session_stream(spark.readStream.schema(EVENTS).parquet(f"{work}/in"), 1800, key_groups=3, late_s=7200)
        q = out.writeStream.format("parquet").option("checkpointLocation", f"{work}/p").option("path", f"{work}/out").trigger(availableNow=True).start()
        q.awaitTermination()
    assert [r[:4] for r in got(spark.read.schema(SESSIONS).parquet(f"{work}/out"))] == [("a", 0, 3000, 3), ("b", 100, 100, 1)]


def test_every_session_comes_from_a_timer():
    """Events alone emit nothing, however long the pauses between them; late ones may join sessions."""
    from jsonloom.streaming.session_timers import on_event, on_timers

    rng = random.Random(7)
    for _ in range(300):
        ts = [rng.randrange(0, 20_000) for _ in range(rng.randint(1, 12))]
        held = []
        for t in ts:
            on_event(held, t, "x", 1, 1800)
        assert [(s.start, s.end, sum(s.kinds.values())) for s in held] == sorted(r[1:4] for r in brute([("a", t, "x") for t in ts], 1800))
        mark = rng.randrange(0, 25_000)
        state = {"a": held}
        final = list(on_timers(state, mark * 1000, 1800))
        assert all(s.end + 1800 < mark for _, s in final) and all(s.end + 1800 >= mark for v in state.values() for s in v)


def test_batches_cut_at_ties_and_the_other_sessions_settings_stay(spark):
    """All events at two instants: cuts can't fall between equal instants; settings of the caller's session don't change."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    rows = [(f"k{i % 3}", 50 + 1801 * (i % 2), "x", 1, 2) for i in range(60)]
    out = got(sessions(frame(spark, rows), F.col("actor"), F.col("t"), kind=F.col("kind"), batches=7))
    assert out == sorted(((f"k{k}", t, t, 10, {"x": 10}) for k in range(3) for t in (50, 1851)), key=repr)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
