"""Windows, time series, vectors and Python functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sprucelake.functions import udfs
from sprucelake.operators.groups import gap_filled, sessions, top_per_group
from sprucelake.operators.joins import join_small
from sprucelake.operators.vectors import approximate_nearest, nearest_by_products, vector_index
from sprucelake.plans.registry import query
from sprucelake.session import table

#: Rows of a group that Python gets, on average.
GROUP_ROWS = 100_000


@query("""
SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS r, dense_rank() OVER v AS dr FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def window_ranks(spark, d):
    w, v = W.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"), W.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(v).cast("long").alias("r"), F.dense_rank().over(v).cast("long").alias("dr"))


@query("""
SELECT p_partkey, ntile(4) OVER w AS quarter, round(cume_dist() OVER w, 6) AS cd, round(percent_rank() OVER w, 6) AS pr FROM part
WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)""")
def window_shares(spark, d):
    w = W.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    return table(spark, d, "part").select("p_partkey", F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.cume_dist().over(w), 6).alias("cd"), F.round(F.percent_rank().over(w), 6).alias("pr"))


@query("""
SELECT event_id, lag(value, 1) OVER w AS before, lead(value, 2, 0.0) OVER w AS later, first_value(event_id) OVER w AS first_id,
  last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_id,
  nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_id
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
def window_offsets(spark, d):
    w = W.partitionBy("user_id").orderBy("ts")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return table(spark, d, "events").select("event_id", F.lag("value", 1).over(w).alias("before"), F.lead("value", 2, 0.0).over(w).alias("later"), F.first("event_id").over(w).alias("first_id"), F.last("event_id").over(whole).alias("last_id"), F.nth_value("event_id", 2).over(whole).alias("second_id"))


@query("""
SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS near,
  max(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS most FROM events""")
def window_rows_frame(spark, d):
    w = W.partitionBy("user_id").orderBy("ts")
    return table(spark, d, "events").select("event_id", F.round(F.sum("value").over(w.rowsBetween(-2, 1)), 4).alias("near"), F.max("value").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("most"))


@query("""
SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM part""")
def window_range_frame(spark, d):
    return table(spark, d, "part").select("p_partkey", F.count("*").over(W.partitionBy("p_brand").orderBy("p_size").rangeBetween(-5, 5)).alias("near"))


@query("""
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day FROM events""")
def window_interval_frame(spark, d):
    table(spark, d, "events").createOrReplaceTempView("events_v")
    return spark.sql("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS day FROM events_v")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders QUALIFY rank <= 3")
def top_three_per_group(spark, d):
    return top_per_group(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark, d):
    out = table(spark, d, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""
SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY 1""")
def sliding_window(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


SESSIONS_SQL = """
WITH f AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM events),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) - 1 AS session FROM f)
"""


@query(SESSIONS_SQL + "SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, session")
def session_window(spark, d):
    out = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query(SESSIONS_SQL + "SELECT user_id, session::BIGINT AS session, round(sum(value), 4) AS total FROM g GROUP BY 1, 2")
def session_numbers(spark, d):
    return sessions(table(spark, d, "events"), ["user_id"], "ts", "2 hours").groupBy("user_id", "session").agg(F.round(F.sum("value"), 4).alias("total"))


@query("""
WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2),
s AS (SELECT event_type, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM h GROUP BY 1)
SELECT event_type, hour, last_value(n IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM s LEFT JOIN h USING (event_type, hour)""")
def gaps_filled(spark, d):
    hours = table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))
    return gap_filled(hours, ["event_type"], "hour", "1 hour", ["n"])


@query("""
SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 5) AS cosine,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id)::INT AS rank
FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5""")
def nearest_vectors(spark, d):
    """The job's query set: the vectors with ids divisible by 50."""
    v = table(spark, d, "embeddings")
    return nearest_by_products(v.where("vec_id % 50 = 0"), v, 5).withColumn("cosine", F.round("cosine", 5))


@query("SELECT count(*) AS queries, 5 * count(*) AS neighbours, true AS recall_90 FROM embeddings WHERE vec_id % 50 = 0")
def approximate_neighbours(spark, d):
    """The same query set through inverted lists: whether nine in ten of the exact neighbours are found."""
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 50 = 0")
    found = approximate_nearest(vector_index(v), asked, 5).select("query_id", "vec_id")
    exact = nearest_by_products(asked, v, 5).select("query_id", "vec_id", F.lit(1).alias("hit"))
    both = found.join(exact, ["query_id", "vec_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("neighbours"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_90"))


@query("SELECT c_custkey, (length(c_mktsegment) - length(regexp_replace(c_mktsegment, '[aeiouAEIOU]', '', 'g')))::BIGINT AS n FROM customer")
def udf_arrow(spark, d):
    return table(spark, d, "customer").select("c_custkey", udfs.vowels("c_mktsegment").alias("n"))


INITIALS_SQL = "SELECT p_partkey, list_reduce(list_transform(regexp_split_to_array(p_name, '\\s+'), lambda w: w[1]), lambda a, b: a || b) AS letters FROM part"


@query(INITIALS_SQL)
def udf_row(spark, d):
    return table(spark, d, "part").select("p_partkey", udfs.initials("p_name").alias("letters"))


@query(INITIALS_SQL)
def udf_row_arrow(spark, d):
    return table(spark, d, "part").select("p_partkey", udfs.initials_by_arrow("p_name").alias("letters"))


@query("SELECT event_type, round(sum(value * (event_id % 7 + 1)) / sum(event_id % 7 + 1), 5) AS mean FROM events GROUP BY 1")
def udf_aggregate(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(udfs.weighted_mean("value", (F.col("event_id") % 7 + 1).cast("double")), 5).alias("mean"))


@query("SELECT event_id, round(max(value) OVER (PARTITION BY user_id) - value, 2) AS below FROM events")
def udf_grouped_map(spark, d):
    """Python by groups of bounded size: a user's best is worked out before, and many events of one user lie in several groups."""
    events = table(spark, d, "events").select("event_id", "user_id", "value")
    users = events.groupBy("user_id").agg(F.max("value").alias("best"), F.ceil(F.count("*") / GROUP_ROWS).alias("parts"))
    dealt = join_small(events, users, ["user_id"]).withColumn("part", F.pmod(F.xxhash64("event_id"), F.col("parts")))
    return dealt.groupBy("user_id", "part").applyInPandas(udfs.below_best, "event_id long, below double")


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::BIGINT AS words FROM documents")
def udf_map_batches(spark, d):
    return table(spark, d, "documents").select("doc_id", "text").mapInPandas(udfs.lengths, "doc_id long, words long")


@query("SELECT item_id, unnest(string_split(text, ' ')) AS word FROM benchmark")
def udf_table_function(spark, d):
    spark.udtf.register("words_of", udfs.Words)
    table(spark, d, "benchmark").createOrReplaceTempView("benchmark_v")
    return spark.sql("SELECT item_id, word FROM benchmark_v, LATERAL words_of(text)")
