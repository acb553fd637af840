"""Queries whose keys may be of any size: inequality joins, hot keys in windows and as-of joins, percentiles, sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from sprucelake.operators.joins import asof_join
from sprucelake.operators.ordered import below, framed, numbered_in_key, running, within
from sprucelake.operators.percentiles import percentiles
from sprucelake.operators.sketches import count_min, estimates, heavy_hitters, merged, overcount
from sprucelake.plans.registry import query
from sprucelake.session import table, written

#: Half of all events belong to user 0 here.
HOT = "SELECT event_id, ts, event_type, value, CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END AS k FROM events"


def hot_events(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "event_type", "value", F.when(F.col("event_id") % 2 == 0, 0).otherwise(F.col("user_id")).alias("k"))


@query("SELECT o_orderkey, count(p_partkey) AS cheaper FROM orders LEFT JOIN part ON p_retailprice < o_totalprice / 300 GROUP BY 1")
def join_inequality(spark, d):
    """The parts that cost less than a three-hundredth of each order."""
    orders = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 300).alias("share"))
    return below(orders, table(spark, d, "part"), "share", "p_retailprice", name="cheaper").select("o_orderkey", "cheaper")


@query("""
SELECT c_custkey, count(s_suppkey) AS poorer, round(sum(s_acctbal), 2) AS total FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey AND s_acctbal <= c_acctbal GROUP BY 1""")
def join_inequality_keyed(spark, d):
    """For each customer the suppliers of the same nation with no larger balance, and their balances' sum."""
    out = below(table(spark, d, "customer"), table(spark, d, "supplier"), "c_acctbal", "s_acctbal", {"c_nationkey": "s_nationkey"}, strict=False, sums={"total": "s_acctbal"}, name="poorer")
    return out.select("c_custkey", "poorer", F.round("total", 2).alias("total"))


@query(f"""
WITH e AS ({HOT}) SELECT p.event_id, v.event_id AS view_id, v.value AS view_value FROM (SELECT * FROM e WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'view') v ON p.k = v.k AND p.ts >= v.ts""")
def join_asof_hot_key(spark, d):
    e = hot_events(spark, d)
    views = e.where("event_type = 'view'").select("k", F.col("ts").alias("seen"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    buys = e.where("event_type = 'purchase'").select("event_id", "k", "ts")
    return asof_join(buys, views, ["k"], "ts", "seen", ["view_id", "view_value"], hot_rows=200).select("event_id", "view_id", "view_value")


@query(f"""
WITH e AS ({HOT}) SELECT event_id, count(*) OVER w AS place, round(sum(value) OVER w, 2) AS total, max(value) OVER w AS most, min(value) OVER w AS least,
  last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER w AS last_view
FROM e WINDOW w AS (PARTITION BY k ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def window_running_hot_key(spark, d):
    """Running values whose keys lie in many chunks."""
    values = {"place": ("count", F.lit(1)), "total": ("sum", F.col("value")), "most": ("max", F.col("value")), "least": ("min", F.col("value")), "last_view": ("last", F.when(F.col("event_type") == "view", F.col("event_id")))}
    return running(hot_events(spark, d), ["k"], [F.asc("ts")], values).select("event_id", "place", F.round("total", 2).alias("total"), "most", "least", "last_view")


@query(f"""
WITH e AS ({HOT}) SELECT event_id, round(sum(value) OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS near,
  lag(event_id, 2) OVER w AS before, lead(event_id) OVER w AS after FROM e WINDOW w AS (PARTITION BY k ORDER BY ts)""")
def window_frame_hot_key(spark, d):
    """Frames of a few rows, for which a chunk's edges go to its neighbours."""
    made = lambda w: {"near": F.round(F.sum("value").over(w.rowsBetween(-2, 1)), 4), "before": F.lag("event_id", 2).over(w), "after": F.lead("event_id").over(w)}
    return framed(hot_events(spark, d), ["k"], [F.asc("ts")], 2, 1, made, rows=1000).select("event_id", "near", "before", "after")


@query(f"""
WITH e AS ({HOT}) SELECT event_id, count(*) OVER w AS day, round(sum(value) OVER w, 2) AS total FROM e
WINDOW w AS (PARTITION BY k ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)""")
def window_interval_hot_key(spark, d):
    """A day's frame before each event, as the difference of two running counts."""
    out = within(hot_events(spark, d), ["k"], "ts", F.col("ts") - F.expr("interval 1 day"), "day", {"total": "value"})
    return out.select("event_id", "day", F.round("total", 2).alias("total"))


@query(f"WITH e AS ({HOT}) SELECT event_id, row_number() OVER (PARTITION BY k ORDER BY value DESC, event_id)::BIGINT AS place FROM e")
def window_place_hot_key(spark, d):
    return numbered_in_key(hot_events(spark, d), ["k"], [F.desc("value"), F.asc("event_id")]).select("event_id", (F.col("place") + 1).alias("place"))


@query("""
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.5), 4) AS mid, quantile_disc(l_extendedprice, 0.25) AS q1, quantile_disc(l_extendedprice, 0.999) AS top FROM lineitem GROUP BY 1""")
def percentiles_selected(spark, d):
    """Percentiles of three large groups, none of which is sorted as a whole."""
    wanted = {"p90": (0.9, "cont"), "mid": (0.5, "cont"), "q1": (0.25, "disc"), "top": (0.999, "disc")}
    out = percentiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", wanted, most=1000)
    return out.select("l_returnflag", F.round("p90", 4).alias("p90"), F.round("mid", 4).alias("mid"), "q1", "top")


@query("SELECT l_partkey, count(*) AS n, true AS within FROM lineitem GROUP BY 1")
def count_min_bounds(spark, d):
    """Whether the estimate of every part, by a sketch merged from two, is within its bound of the exact count."""
    lines = table(spark, d, "lineitem").select("l_partkey", "l_linenumber")
    odd = F.col("l_linenumber") % 2 == 1
    sketch = written(merged(count_min(lines.where(odd), ["l_partkey"]), count_min(lines.where(~odd), ["l_partkey"])), "count-min")
    rows = sketch.where("line = 0").agg(F.sum("n")).first()[0] or 0
    exact = lines.groupBy("l_partkey").agg(F.count("*").alias("n"))
    both = exact.join(estimates(lines, ["l_partkey"], sketch), "l_partkey")
    return both.select("l_partkey", "n", F.col("estimate").between(F.col("n"), F.col("n") + overcount(rows)).alias("within"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 0.0075 * (SELECT count(*) FROM events)")
def frequent_users(spark, d):
    return heavy_hitters(table(spark, d, "events"), ["user_id"], 0.0075, width=1 << 12)
