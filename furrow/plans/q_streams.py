"""Streaming queries: each drains a replay of the events and is held against the batch result."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from furrow.plans.registry import query
from furrow.session import scratch
from furrow.streaming import flows as W


def _events(t, files: int = 4, closed: str | None = None):
    # Event time with a time zone, which windows and watermarks want.
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    path = W.replay(events, "ts", files)
    if closed:
        W.close(events, path, "ts", closed)
    return events, W.files_stream(t.spark, path, events.schema)


def _last(t, path: str, keys: list[str]):
    """The last batch's row of each key: a batch holds the newer rows of its keys."""
    df = t.spark.read.parquet(path)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in df.columns if c not in keys)), "batch").alias("s")).select(*keys, "s.*").drop("batch")


query("ST2 ST6", "tumbling_windows", """
  select cast(make_timestamp(cast(floor(epoch(ts)/(20*86400)) as bigint)*20*86400*1000000) as varchar) as start, event_type, count(*) as n, round(sum(value),4) as total from events group by 1,2
""")(lambda t: _tumbling(t))


def _tumbling(t):
    path = scratch(t.spark, "tumbling")
    W.run(W.tumbling(_events(t)[1], "ts", "20 days", "2 days", ["event_type"]), "update", W.by_batch(path))
    return _last(t, path, ["start", "event_type"]).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


query("ST7", "session_windows", """
  with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 12 hours then 0 else 1 end as f from events), s as (select *, sum(f) over (partition by user_id order by ts rows unbounded preceding) as k from g)
  select user_id, count(*) as n, cast(date_trunc('second', min(ts)) as varchar) as start from s group by user_id, k
""")(lambda t: _sessions(t))


def _sessions(t):
    path = scratch(t.spark, "sessions")
    W.run(W.sessions(_events(t, closed="30 days")[1], "ts", "12 hours", "1 day", "user_id"), "append", W.by_batch(path))
    return t.spark.read.parquet(path).where("user_id is not null").select("user_id", "n", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))


query("ST1 J8", "resume_by_status", "select distinct user_id from events where event_type<>'error'")(lambda t: _resume(t))


def _resume(t):
    path = scratch(t.spark, "status")
    W.run(_events(t)[1], "append", W.resume(path, "user_id", "event_type <> 'error'"))
    return t.spark.read.parquet(path).select("user_id")


query("ST4 ST5", "watchdog_and_breaker", """
  with e as (select user_id, ts, event_id, event_type='error' as f, row_number() over (partition by user_id order by ts, event_id) as r, epoch(ts)-epoch(lag(ts) over (partition by user_id order by ts, event_id)) as gap from events),
  g as (select user_id, f, r-row_number() over (partition by user_id, f order by r) as k from e), m as (select user_id, max(n) as longest from (select user_id, count(*) as n from g where f group by user_id, k) group by 1)
  select e.user_id, coalesce(max(m.longest),0) as longest, coalesce(max(m.longest),0)>=3 as tripped, max(gap)>86400 as stalled from e left join m on m.user_id=e.user_id group by 1
""")(lambda t: _watchdog(t))


def _watchdog(t):
    path = scratch(t.spark, "watchdog")
    stream = _events(t)[1].withColumn("failed", F.col("event_type") == "error")
    W.run(W.watchdog(stream, "user_id", "ts", "event_id", "failed", 86400.0, 3), "append", W.by_batch(path))
    return _last(t, path, ["user_id"])


query("ST3", "file_readiness", "select cast(3 as bigint) as later, cast(0 as bigint) as at_once")(lambda t: _ready(t))


def _ready(t):
    """Files that were just written are ready once they are old enough by the clock, and not at once."""
    path = W.replay(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", 3)
    some = lambda now, name: W.ready(path, t.spark, now).agg(F.count("*").alias(name))
    return some(time.time() + 3600, "later").crossJoin(some(time.time() - 3600, "at_once"))


query("ST8", "idempotent_upsert", "select cast(cast(ts as date) as varchar) as day, count(*) as n, round(sum(value),4) as total from events group by 1")(lambda t: _upsert(t))


def _upsert(t):
    path = scratch(t.spark, "days")
    events, stream = _events(t, 3)
    W.run(stream, "append", W.upsert_days(path, events, "ts"))
    return t.spark.read.parquet(path).select(F.col("day").cast("string").alias("day"), "n", F.round("total", 4).alias("total"))
