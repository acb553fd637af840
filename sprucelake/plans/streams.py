"""Structured Streaming queries as terminating runs."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from sprucelake.plans.registry import query
from sprucelake.session import table
from sprucelake.streaming import events as E

CLOSED = "(SELECT max(ts) - INTERVAL 30 MINUTE FROM events)"


@query(f"""
SELECT start, event_type, n, total FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
WHERE start + INTERVAL 6 HOUR <= {CLOSED}""")
def stream_tumbling(spark, d):
    """Windows that the watermark has closed."""
    return E.run(E.tumbling(E.event_stream(spark, d)), "tumbling").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_complete(spark, d):
    """All windows, in complete mode, by foreachBatch."""
    return E.run_batches(E.tumbling(E.event_stream(spark, d)), "complete", "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"""
SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 1 HOUR]) AS start FROM events)
WHERE start + INTERVAL 2 HOUR <= {CLOSED} GROUP BY 1""")
def stream_sliding(spark, d):
    return E.run(E.sliding(E.event_stream(spark, d)), "sliding").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"""
WITH f AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM events),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM f)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, session HAVING max(ts) + INTERVAL 2 HOUR <= {CLOSED}""")
def stream_sessions(spark, d):
    return E.run(E.user_sessions(E.event_stream(spark, d)), "sessions").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_id, user_id FROM events")
def stream_distinct(spark, d):
    return E.run(E.distinct_events(E.event_stream(spark, d)).select("event_id", "user_id"), "distinct")


@query("""
SELECT a.event_id AS click_id, b.event_id AS purchase_id FROM events a JOIN events b
ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 DAY""")
def stream_join(spark, d):
    return E.run(E.clicks_with_purchases(E.event_stream(spark, d)), "join")


@query("SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey")
def stream_static_join(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return E.run(E.event_stream(spark, d).join(customers, "user_id").select("event_id", "c_name"), "static")


@contextmanager
def rocks_db(spark):
    """The state store that arbitrary state needs, for the time of a run."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_state(spark, d):
    with rocks_db(spark):
        return E.run_batches(E.running_counts(E.event_stream(spark, d)), "state", "update", ["user_id"])


SESSIONS_SQL = """
WITH f AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM {rows}),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM f)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, session HAVING max(ts) + INTERVAL 2 HOUR <= {closed}"""


@query(SESSIONS_SQL.format(rows="events", closed=CLOSED))
def stream_timers(spark, d):
    """Sessions that a timer has closed, behind the watermark."""
    with rocks_db(spark):
        return E.run(E.idle_sessions(E.event_stream(spark, d)), "timers").withColumn("start", F.col("start").cast("timestamp_ntz"))


#: Disorder: of six batches in order of ids, three of ten ids come a batch later, and of the first one some ids come in the last, behind the watermark.
LATE = "event_id % 97 = 5 AND 5 * event_id < (SELECT max(event_id) + 1 FROM events)"
PUNCTUAL = f"(SELECT * FROM events WHERE NOT ({LATE}))"
PASSED = "(SELECT max(ts) - INTERVAL 14 DAY FROM events)"


def disordered(spark, d):
    events = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    n = events.agg(F.max("event_id")).first()[0] + 1
    batch = F.floor(F.col("event_id") * 5 / n).cast("int")
    late = (F.col("event_id") % 97 == 5) & (F.col("event_id") * 5 < n)
    return E.replayed(events, F.when(late, 5).otherwise(batch + (F.col("event_id") % 10 < 3).cast("int")), 6, "14 days")


@query(f"""
SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS place FROM {PUNCTUAL} WHERE ts < {PASSED}""")
def stream_in_order(spark, d):
    """Events that came out of order, put in order behind the watermark; late ones are dropped."""
    with rocks_db(spark):
        return E.run(E.in_order(disordered(spark, d)), "in-order").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(SESSIONS_SQL.format(rows=PUNCTUAL, closed=PASSED))
def stream_sessions_disordered(spark, d):
    """Sessions by timers of events that came out of order."""
    with rocks_db(spark):
        return E.run(E.idle_sessions(disordered(spark, d)), "disordered").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(SESSIONS_SQL.format(rows=PUNCTUAL, closed=PASSED))
def stream_session_window_disordered(spark, d):
    """The same by session_window."""
    return E.run(E.user_sessions(disordered(spark, d)), "disordered-window").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def stream_upsert(spark, d):
    """The last event of each user, kept in a table that each batch of a disordered stream updates."""
    out = E.run_upserts(disordered(spark, d).select("user_id", "event_id", "ts"), "upsert", ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def stream_time_to_live(spark, d):
    with rocks_db(spark):
        return E.run(E.first_seen(E.event_stream(spark, d)), "seen", single_batch=True)


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_memory(spark, d):
    """A handful of rows in a table in memory."""
    totals = E.event_stream(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return E.run_in_memory(totals, "stream_memory_totals")
