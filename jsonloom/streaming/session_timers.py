"""Sessions by keyed timers: the state of a key is its open sessions, and an event-time timer ends each of them.

Keys are hashed to key groups. Spark's stateful operator runs once a group; the group's state holds the
open sessions of each of its keys, and their timers."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from jsonloom.session import fresh_path, stage

#: The marker that ends a bounded input moves the watermark here, 2261-01-01, near the last moment that pandas
#: can hold. Later instants are allowed; only their timers are set to just before it.
END_OF_INPUT_S = 9_183_024_000

EVENTS = "key_ string, t_ bigint, kind_ string, n_ bigint"
SESSIONS = "key_ string, start_s bigint, end_s bigint, events bigint, types string"
STATE = "open string"
KEYS_A_GROUP = 500
ROWS_A_BATCH = 50_000  # of a key group on average
ROWS_OF_A_KEY = 1_000_000  # of the hottest key in a batch on average
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events_by_second(events: DataFrame, key: Column, instant_s: Column, kind: Column | None = None) -> DataFrame:
    """(key_, t_, kind_, n_): the events of one key, second and kind as one row, combined before any exchange;
    so a key has as many rows as seconds (times kinds) at most, whatever share of all events it holds."""
    rows = events.select(
        key.cast("string").alias("key_"), instant_s.cast("bigint").alias("t_"), (kind if kind is not None else F.lit(None)).cast("string").alias("kind_")
    ).where(F.col("key_").isNotNull() & F.col("t_").isNotNull())
    return rows.groupBy("key_", "t_", "kind_").agg(F.count(F.lit(1)).alias("n_"))


class OpenSession:
    """The state of a key's session: first and last event, number of events by kind."""

    __slots__ = ("start", "end", "kinds")

    def __init__(self, start: int, end: int, kinds: dict[str, int]) -> None:
        self.start, self.end, self.kinds = start, end, kinds


def on_event(sessions: list[OpenSession], t: int, kind: str, n: int, gap_s: int) -> None:
    """An event updates the open sessions of its key (in order of time): it extends the session that it falls into
    or that it follows within the gap, which resets that session's timer, or opens one. A late event may join two."""
    if sessions and t > sessions[-1].end + gap_s or not sessions:
        sessions.append(OpenSession(t, t, {kind: n}))
        return
    i = len(sessions) - 1
    while i > 0 and t < sessions[i].start - gap_s:
        i -= 1
    s = sessions[i]
    if t > s.end + gap_s:
        sessions.insert(i + 1, OpenSession(t, t, {kind: n}))
    elif t < s.start - gap_s:
        sessions.insert(i, OpenSession(t, t, {kind: n}))
    else:
        s.start, s.end = min(s.start, t), max(s.end, t)
        s.kinds[kind] = s.kinds.get(kind, 0) + n
        if i > 0 and s.start - sessions[i - 1].end <= gap_s:
            before = sessions.pop(i - 1)
            s.start = before.start
            for k, m in before.kinds.items():
                s.kinds[k] = s.kinds.get(k, 0) + m


def on_timers(held: dict[str, list[OpenSession]], mark_ms: int, gap_s: int) -> Iterator[tuple[str, OpenSession]]:
    """The sessions whose timer (last event + gap) the watermark has passed; they leave the state."""
    for key in list(held):
        due = [s for s in held[key] if timer_ms(s.end + gap_s) < mark_ms]
        if due:
            for s in due:
                yield key, s
            left = [s for s in held[key] if timer_ms(s.end + gap_s) >= mark_ms]
            if left:
                held[key] = left
            else:
                del held[key]


def timer_ms(at_s: int) -> int:
    """The moment of a timer; within what a watermark can pass."""
    return max(0, min(at_s, END_OF_INPUT_S - 1)) * 1000


def session_updater(gap_s: int):
    """The function of the stateful operator, for one group of keys: timers that are due fire first, then the events
    come, in order of time. Nothing but a timer emits a session."""

    def update(group: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: [OpenSession(*x) for x in v] for k, v in json.loads(state.get[0]).items()} if state.exists else {}
        mark = state.getCurrentWatermarkMs()
        done = list(on_timers(held, mark, gap_s))
        if not state.hasTimedOut:
            rows = [r for pdf in batches for r in zip(pdf["t_"].tolist(), pdf["key_"].tolist(), pdf["kind_"].tolist(), pdf["n_"].tolist(), strict=True)]
            if pd.isna(group[0]):  # the marker that ends the input
                return
            rows.sort(key=lambda r: r[0])
            for t, key, kind, n in rows:
                on_event(held.setdefault(key, []), t, kind or "", n, gap_s)
        if held:
            state.update((json.dumps({k: [(s.start, s.end, s.kinds) for s in v] for k, v in held.items()}),))
            state.setTimeoutTimestamp(max(min(timer_ms(s.end + gap_s) for v in held.values() for s in v), mark) + 1)
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame(
                {
                    "key_": [k for k, _ in done], "start_s": [s.start for _, s in done], "end_s": [s.end for _, s in done],
                    "events": [sum(s.kinds.values()) for _, s in done], "types": [json.dumps(s.kinds, sort_keys=True) for _, s in done],
                }
            )

    return update


def session_stream(events: DataFrame, gap_s: int, *, key_groups: int = 1024, late_s: int = 0) -> DataFrame:
    """Streaming DataFrame of events (``EVENTS``) -> streaming DataFrame of final sessions (``SESSIONS``; types as JSON).

    key_groups: keys are hashed to so many groups, each a state row with the timers of its keys (a call of the
        stateful function costs far more than a key). Choose it so that a group has at most some thousand
        keys with an open session.
    late_s: how far behind the newest event one may still come; later ones are dropped by Spark's
        watermark, which is what ends sessions at all."""
    at = F.least(F.greatest(F.col("t_"), F.lit(1)), F.lit(END_OF_INPUT_S))  # later than the first watermark, 0
    group = F.pmod(F.xxhash64("key_"), F.lit(key_groups))
    marked = events.withColumn("at_", F.timestamp_seconds(at)).withColumn("group_", F.when(F.col("key_").isNotNull(), group))
    return (
        marked.withWatermark("at_", f"{late_s} seconds")
        .groupBy("group_")
        .applyInPandasWithState(session_updater(gap_s), SESSIONS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def _own_session(spark: SparkSession, state_store: str) -> SparkSession:
    """A session of the same application with the same SQL settings but its own state store; what runs in others isn't touched."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if k.startswith("spark.sql.") and own.conf.isModifiable(k):
            own.conf.set(k, v)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", state_store)
    return own


def _bounds(rows: DataFrame, batches: int) -> list[int]:
    """Instants that cut the rows, in order of time, into about even batches. They lie within the watermark's range."""
    if batches < 2:
        return []
    at = rows.agg(F.percentile_approx("t_", [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    return sorted({t for t in at if 1 < t < END_OF_INPUT_S})


def sessions(
    events: DataFrame, key: Column, instant_s: Column, *, kind: Column | None = None, gap_s: int = 1800, batches: int = 4, state_store: str = ROCKS_DB
) -> DataFrame:
    """(key_, start_s, end_s, events, types): sessions of a stored table of events, run through the
    timers as a stream. A session ends where more than ``gap_s`` seconds pass without an event.

    The events, combined by key, second and kind, are cut by time into batches, which the stream takes in
    order; between two batches the watermark moves on and the timers that it passes end their sessions. Behind
    the last batch a marker row moves the watermark past all timers still set. There are ``batches`` of them
    at least, and more where a key group or the hottest key would have too many rows in one (both are
    counted first). Progress, state (in RocksDB, kept by Spark in the shared folder) and results outlive
    any executor.

    Edge cases: rows with NULL key or instant are left out; events of one instant belong together; a
    lone event is a session of length 0; empty input gives no rows. ``types`` (MAP) counts events by
    ``kind``, NULL kinds under ""; NULL without ``kind``."""
    spark = events.sparkSession
    work = fresh_path(spark, "sessions")
    rows = stage(events_by_second(events, key, instant_s, kind), "events")
    size = rows.groupBy("key_").count().agg(F.count(F.lit(1)).alias("keys"), F.max("count").alias("hottest"), F.sum("count").alias("rows")).first()
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size.keys // KEYS_A_GROUP)
    batches = max(batches, (size.rows or 0) // (groups * ROWS_A_BATCH), (size.hottest or 0) // ROWS_OF_A_KEY)
    bounds = _bounds(rows, batches)
    no = F.lit(0)
    for b in bounds:
        no = no + (F.col("t_") >= b).cast("int")
    if len(bounds) > 50:  # a search in a sorted list instead of a long sum
        no = F.size(F.filter(F.lit(bounds), lambda b: b <= F.col("t_")))
    end = spark.range(1, numPartitions=1).selectExpr("CAST(NULL AS STRING) AS key_", f"{END_OF_INPUT_S}L AS t_", "CAST(NULL AS STRING) AS kind_", "0L AS n_", f"{len(bounds)} AS batch_")
    rows.withColumn("batch_", no).unionByName(end).write.partitionBy("batch_").parquet(f"{work}/batches")
    own = _own_session(spark, state_store)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(work).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{work}/in"))
    for i in range(len(bounds) + 1):  # one batch after the other moves to where the stream reads
        if not fs.exists(path(f"{work}/batches/batch_={i}")):
            continue
        if not fs.rename(path(f"{work}/batches/batch_={i}"), path(f"{work}/in/{i}")):
            raise OSError(f"can't move batch {i} of {work}")
        stream = own.readStream.schema(EVENTS).parquet(f"{work}/in/*")
        query = (
            session_stream(stream, gap_s, key_groups=groups)
            .writeStream.format("parquet")
            .option("checkpointLocation", f"{work}/progress")
            .option("path", f"{work}/sessions")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    found = spark.read.schema(SESSIONS).parquet(f"{work}/sessions")
    types = F.from_json("types", "map<string,bigint>") if kind is not None else F.lit(None).cast("map<string,bigint>")
    return found.withColumn("types", types)
