"""Scans, filters, joins, aggregation, ordering, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sprucelake.operators.groups import latest, numbered, top_per_group, two_step
from sprucelake.operators.joins import asof_join, band_join, join_small, salted_join
from sprucelake.plans.registry import query
from sprucelake.session import shared_folder, table, written
from sprucelake.sources import jdbc
from sprucelake.sources.calendar import Calendar
from sprucelake.sources.files import read, round_trip, write
from sprucelake.sources.row_groups import RowGroups, push_filters


#: In microseconds.
SIX_HOURS = 6 * 3600 * 1_000_000


def discounted() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))



@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
  round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'2001-06-01'").groupBy("l_returnflag", "l_linestatus")
    return rows.agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(discounted()), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue, count(*) AS n FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
def filter_range(spark, d):
    rows = table(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz'1997-01-01' AND l_shipdate < timestamp_ntz'1998-01-01'").where(F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return rows.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"), F.count("*").alias("n"))


@query("""
SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class FROM part
WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') AND p_type LIKE '%A%'""")
def filter_like_in_case(spark, d):
    size = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large")
    return table(spark, d, "part").where(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#23") & F.col("p_type").like("%A%")).select("p_partkey", size.alias("size_class"))


@query("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS status, nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM NULL AS was_f FROM orders")
def null_logic(spark, d):
    status = F.nullif("o_orderstatus", F.lit("F"))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(status, F.lit("none")).alias("status"), status.eqNullSafe(F.lit(None)).alias("was_f"))


@query("SELECT s_suppkey, s_name AS name, round(s_acctbal / 10, 3) AS tenth FROM supplier")
def struct_fields(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.struct(F.col("s_name").alias("name"), F.round(F.col("s_acctbal") / 10, 3).alias("tenth")).alias("s")).select("s_suppkey", "s.name", "s.tenth")


@query()
def sample_rows(spark, d):
    return table(spark, d, "orders").sample(0.1, seed=7).select("o_orderkey", "o_totalprice")


@query("""
SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate, o_orderpriority
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
GROUP BY 1, 3, 4 ORDER BY revenue DESC, o_orderkey LIMIT 10""")
def shipping_priority(spark, d):
    customers = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = table(spark, d, "orders").where("o_orderdate < timestamp_ntz'1998-03-15'")
    lines = table(spark, d, "lineitem").where("l_shipdate > timestamp_ntz'1998-03-15'")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey).join(lines, orders.o_orderkey == lines.l_orderkey)
    return rows.groupBy("o_orderkey", "o_orderdate", "o_orderpriority").agg(F.round(F.sum(discounted()), 2).alias("revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY 1""")
def join_six_tables(spark, d):
    t = lambda n: table(spark, d, n)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    sold = t("lineitem").select("l_orderkey", "l_suppkey", discounted().alias("price")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    bought = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = sold.join(bought, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum("price"), 2).alias("revenue"))


@query("""
SELECT o_orderkey, count(l_orderkey) AS n_lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45 GROUP BY 1""")
def join_left(spark, d):
    lines = table(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey")
    return table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n_lines"))


@query("""
SELECT a.p_partkey AS a_key, b.p_partkey AS b_key FROM (SELECT * FROM part WHERE p_size <= 20) a FULL JOIN (SELECT * FROM part WHERE p_size >= 15) b ON a.p_partkey = b.p_partkey""")
def join_full(spark, d):
    p = table(spark, d, "part")
    return p.where("p_size <= 20").select(F.col("p_partkey").alias("a_key")).join(p.where("p_size >= 15").select(F.col("p_partkey").alias("b_key")), F.col("a_key") == F.col("b_key"), "full")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def join_semi(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def not_in_subquery(spark, d):
    table(spark, d, "part").createOrReplaceTempView("part_v")
    table(spark, d, "lineitem").createOrReplaceTempView("lineitem_v")
    return spark.sql("SELECT p_partkey FROM part_v WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem_v WHERE l_quantity > 48)")


@query("SELECT count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate < o_orderdate")
def join_theta(spark, d):
    o, i = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.join(i, (o.o_orderkey == i.l_orderkey) & (i.l_shipdate < o.o_orderdate)).agg(F.count("*").alias("n"))


@query("SELECT r_name, n_name FROM region, nation")
def join_cross_small(spark, d):
    """Two tables of fixed size."""
    return table(spark, d, "region").select("r_name").crossJoin(F.broadcast(table(spark, d, "nation").select("n_name")))


@query("SELECT s_nationkey, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def join_checked_broadcast(spark, d):
    return join_small(table(spark, d, "supplier"), table(spark, d, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), ["s_nationkey"]).groupBy("s_nationkey").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def join_shuffled_hash(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority").hint("shuffle_hash")
    return table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT l_suppkey, s_name, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2")
def join_salted(spark, d):
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_quantity")
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return salted_join(lines, names, ["l_suppkey"], salts=4).groupBy("l_suppkey", "s_name").agg(F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT o_orderpriority, round(sum(l_tax), 2) AS tax FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def group_two_step(spark, d):
    o, i = table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), table(spark, d, "lineitem").select("l_orderkey", "l_tax")
    out = two_step(o.join(i, o.o_orderkey == i.l_orderkey), ["o_orderpriority"], {"tax": F.col("l_tax")})
    return out.select("o_orderpriority", F.round("tax", 2).alias("tax"))


@query("""
SELECT a.event_id AS error_id, b.event_id AS click_id FROM events a JOIN events b
ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'click' AND b.ts BETWEEN a.ts - INTERVAL 6 HOUR AND a.ts""")
def join_time_band(spark, d):
    e = table(spark, d, "events")
    a = e.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("ts").alias("at"), "user_id")
    b = e.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("ts").alias("click_at"), "user_id")
    # A click and the errors up to six hours behind it lie in one or two buckets of a user's time.
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    errors = a.select("error_id", "user_id", (micros("at") - F.lit(SIX_HOURS)).alias("low"), micros("at").alias("high"))
    return band_join(b.select("click_id", "user_id", micros("click_at").alias("t")), errors, "t", "low", "high", SIX_HOURS, ["user_id"]).select("error_id", "click_id")


@query("""
SELECT o_orderkey, b.lo FROM orders JOIN (SELECT range * 50000.0 AS lo, range * 50000.0 + 20000.0 AS hi FROM range(10)) b ON o_totalprice BETWEEN lo AND hi""")
def join_bands(spark, d):
    bands = spark.range(10).select((F.col("id") * 50000.0).alias("lo"), (F.col("id") * 50000.0 + 20000.0).alias("hi"))
    return band_join(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), bands, "o_totalprice", "lo", "hi", 25000.0).select("o_orderkey", "lo")


@query("""
WITH e AS (SELECT event_id, ts, nullif(user_id, 7) AS k, CASE WHEN event_id % 11 > 0 THEN ts END AS t, event_type, value FROM events)
SELECT p.event_id, v.event_id AS view_id, v.value AS view_value FROM (SELECT * FROM e WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'view' AND k IS NOT NULL AND t IS NOT NULL) v ON p.k = v.k AND p.t >= v.t""")
def join_asof_nulls(spark, d):
    """Keys and times with nulls on both sides: every left row comes back."""
    e = table(spark, d, "events").withColumn("k", F.nullif("user_id", F.lit(7))).withColumn("t", F.when(F.col("event_id") % 11 > 0, F.col("ts")))
    views = e.where("event_type = 'view'").select("k", F.col("t").alias("seen"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return asof_join(e.where("event_type = 'purchase'").select("event_id", "k", "t"), views, ["k"], "t", "seen", ["view_id", "view_value"]).select("event_id", "view_id", "view_value")


@query("""
SELECT e.event_id, v.event_id AS view_id, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.ts >= v.ts""")
def join_asof(spark, d):
    e = table(spark, d, "events")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return asof_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "seen", ["view_id", "view_value"]).select("event_id", "view_id", "view_value")


LATERAL_SQL = """
SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT c_custkey FROM customer),
LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)"""


@query(LATERAL_SQL)
def join_lateral(spark, d):
    """A lateral join, which Spark plans as a window with a limit for each group."""
    best = table(spark, d, "orders").where(F.col("o_custkey") == F.col("c_custkey").outer()).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(2)
    return table(spark, d, "customer").select("c_custkey").lateralJoin(best.select("o_orderkey", "o_totalprice"))


@query(LATERAL_SQL)
def join_lateral_sql(spark, d):
    for name in ("customer", "orders"):
        table(spark, d, name).createOrReplaceTempView(f"{name}_v")
    return spark.sql(LATERAL_SQL.replace("FROM customer", "FROM customer_v").replace("FROM orders", "FROM orders_v"))


@query(LATERAL_SQL)
def join_best_per_group(spark, d):
    """The same rows by top_per_group and a join."""
    best = top_per_group(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2)
    return table(spark, d, "customer").join(best, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders i WHERE i.o_custkey = o.o_custkey)")
def correlated_subquery(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.join(o.groupBy("o_custkey").agg((F.avg("o_totalprice") * 1.5).alias("least")), "o_custkey").where("o_totalprice > least").select("o_orderkey")


@query("SELECT l_returnflag, max(l_linestatus) AS last_status, list_sort(list(DISTINCT l_linestatus)) AS statuses FROM lineitem GROUP BY 1")
def group_strings_and_lists(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.max("l_linestatus").alias("last_status"), F.sort_array(F.collect_set("l_linestatus")).alias("statuses"))


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, sum(DISTINCT l_linenumber)::BIGINT AS numbers FROM lineitem GROUP BY 1")
def group_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"), F.sum_distinct("l_linenumber").alias("numbers"))


@query("""
SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12""")
def group_filter_having(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count("*").alias("n")).where("n > 12")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag)::INT AS g1, grouping(l_linestatus)::INT AS g2 FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def group_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"))


@query("SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def group_rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def group_sets(spark, d):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, d, "orders").groupingSets([[s], [p], []], s, p).agg(F.count("*").alias("n"))


@query("""
SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(covar_samp(l_quantity, l_tax), 6) AS cs,
  round(corr(l_quantity, l_extendedprice), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY 1""")
def group_statistics(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.stddev("l_quantity"), 6).alias("sd"), F.round(F.var_pop("l_quantity"), 6).alias("vp"), F.round(F.covar_samp("l_quantity", "l_tax"), 6).alias("cs"),
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"))


@query("""
SELECT p_brand, round(quantile_cont(p_retailprice, 0.9), 6) AS p90, median(p_size)::DOUBLE AS mid, quantile_disc(p_size, 0.25) AS q1 FROM part GROUP BY 1""")
def group_percentiles(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(F.percentile("p_retailprice", 0.9), 6).alias("p90"), F.median("p_size").alias("mid"), F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY p_size)").cast("int").alias("q1"))


@query("""
SELECT o_custkey, min_by(o_orderkey, o_orderkey) AS first_key, arg_max(o_totalprice, o_orderkey) AS last_price, bool_or(o_totalprice > 400000) AS any_big,
  bit_xor(o_orderkey) AS bits FROM orders GROUP BY 1""")
def group_by_extremes(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", "o_orderkey").alias("first_key"), F.max_by("o_totalprice", "o_orderkey").alias("last_price"), F.bool_or(F.col("o_totalprice") > 400000).alias("any_big"), F.bit_xor("o_orderkey").alias("bits"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def group_ordered_strings(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"))


@query("""
SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1""")
def pivoted(spark, d):
    out = table(spark, d, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.count("o_orderkey"))
    return out.select("o_orderstatus", F.coalesce("1-URGENT", F.lit(0)).alias("urgent"), F.coalesce("5-LOW", F.lit(0)).alias("low"))


@query("SELECT s_suppkey, 'balance' AS what, s_acctbal AS v FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey::DOUBLE FROM supplier")
def unpivoted(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return s.unpivot("s_suppkey", ["balance", "nation"], "what", "v")


@query()
def sketches(spark, d):
    """Approximate counts and quantiles; they differ from other engines' by design."""
    rows = table(spark, d, "lineitem").groupBy("l_returnflag")
    return rows.agg(F.approx_count_distinct("l_partkey").alias("parts"), F.approx_percentile("l_extendedprice", 0.5, 10000).alias("mid"), F.hll_sketch_estimate(F.hll_sketch_agg("l_orderkey")).alias("orders"), F.theta_sketch_estimate(F.theta_sketch_agg("l_suppkey")).alias("suppliers"))


@query("SELECT l_returnflag, true AS parts, true AS hll, true AS theta, true AS mid, true AS kll, true AS kll_rank FROM lineitem GROUP BY 1")
def sketch_bounds(spark, d):
    """Whether each sketch is within its bound of the exact figure: 3 % of counts, 1 % of ranks."""
    return sketches_checked(table(spark, d, "lineitem"))


def sketches_checked(rows: DataFrame) -> DataFrame:
    """For each l_returnflag whether the sketches of rows (of lineitem) are within their bounds.

    Keys are made distinct one column at a time and without sketches beside them: in one aggregate every combination of keys would have sketches of its own.
    Of percentiles only ranks are asked for, so a second pass counts the rows below the sketches' answers and nothing is sorted.
    """
    price, none = F.col("l_extendedprice"), F.lit(None).cast("long")
    sketched = rows.groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey", 0.01).alias("parts"), F.hll_sketch_estimate(F.hll_sketch_agg("l_orderkey", F.lit(14))).alias("hll"), F.theta_sketch_estimate(F.theta_sketch_agg("l_suppkey")).alias("theta"),
        F.approx_percentile(price, 0.5, 10000).alias("mid"), F.kll_sketch_agg_double(price, F.lit(400)).alias("kll"))
    sketched = sketched.withColumn("q", F.kll_sketch_get_quantile_double("kll", F.lit(0.5))).withColumn("kll_rank", F.kll_sketch_get_rank_double("kll", F.lit(50000.0))).drop("kll")
    sketched = written(sketched.withColumnRenamed("l_returnflag", "flag"), "sketched")  # a row for each flag
    n, mid, q = F.count(price), F.col("mid"), F.col("q")
    figures = {"n_price": n, "upto_mid": F.count_if(price <= mid), "under_mid": F.count_if(price < mid), "upto_q": F.count_if(price <= q), "under_q": F.count_if(price < q), "low": F.count_if(price <= 50000)}
    ranks = rows.join(F.broadcast(sketched.select("flag", "mid", "q")), F.col("l_returnflag").eqNullSafe(F.col("flag"))).groupBy("flag").agg(*[c.alias(x) for x, c in figures.items()])
    keys = {"n_parts": "l_partkey", "n_orders": "l_orderkey", "n_suppliers": "l_suppkey"}
    counts = [rows.select(F.col("l_returnflag").alias("flag"), k).where(F.col(k).isNotNull()).distinct().groupBy("flag").agg(F.count(k).alias(x)) for x, k in keys.items()]
    parts = [part.select("flag", *[F.col(x) if x in part.columns else none.alias(x) for x in (*figures, *keys)]) for part in (ranks, *counts)]
    exact = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy(F.col("flag").alias("l_returnflag")).agg(*[F.coalesce(F.max(x), F.lit(0)).alias(x) for x in (*figures, *keys)])
    found = exact.join(F.broadcast(sketched), F.col("l_returnflag").eqNullSafe(F.col("flag")))
    near = lambda a, b: F.abs(F.col(a) / F.nullif(F.col(b), F.lit(0)) - 1) <= 0.03
    # A value of the rows lies between two percentiles if the ranks (from 0) that it takes do.
    place = lambda share: (F.col("n_price") - 1) * share
    between = lambda x: F.when(F.col(x).isNotNull(), (F.col(f"upto_{x}") > F.ceil(place(0.49))) & (F.col(f"under_{x}") <= F.floor(place(0.51))))
    below = F.col("low") / F.nullif(F.col("n_price"), F.lit(0))
    return found.select("l_returnflag", near("parts", "n_parts").alias("parts"), near("hll", "n_orders").alias("hll"), near("theta", "n_suppliers").alias("theta"), between("mid").alias("mid"), between("q").alias("kll"), (F.abs(F.col("kll_rank") - below) <= 0.01).alias("kll_rank"))


@query("SELECT true AS share, true AS subset")
def sample_bounds(spark, d):
    """Whether a tenth of the rows is sampled, within five standard deviations, and no row that isn't there."""
    o = table(spark, d, "orders").select("o_orderkey")
    sampled = o.sample(0.1, seed=7)
    n, k, own = (F.col(c) for c in ("n", "k", "own"))
    counts = o.agg(F.count("*").alias("n")).crossJoin(sampled.agg(F.count("*").alias("k"))).crossJoin(sampled.distinct().join(o, "o_orderkey").agg(F.count("*").alias("own")))
    return counts.select((F.abs(k - n * 0.1) <= 5 * F.sqrt(n * 0.09)).alias("share"), (own == k).alias("subset"))


@query("SELECT least(floor(l_extendedprice / 10000), 10)::BIGINT AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def group_histogram(spark, d):
    return table(spark, d, "lineitem").groupBy((F.width_bucket("l_extendedprice", F.lit(0.0), F.lit(100000.0), F.lit(10)) - 1).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 5")
def top_with_offset(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(15).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY nullif(o_orderpriority, '1-URGENT') DESC NULLS LAST, o_orderkey)::BIGINT AS place FROM orders")
def order_nulls_last(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("p"))
    return numbered(o.orderBy(F.desc_nulls_last("p"), "o_orderkey")).select("o_orderkey", (F.col("number") + 1).alias("place"))


SETS = {"union_distinct": "UNION", "union_all": "UNION ALL", "intersect_distinct": "INTERSECT", "intersect_all": "INTERSECT ALL", "except_distinct": "EXCEPT", "except_all": "EXCEPT ALL"}


def _set_query(name: str):
    def run(spark, d):
        a = table(spark, d, "lineitem").where("l_quantity < 20").select("l_partkey", "l_linenumber")
        b = table(spark, d, "lineitem").where("l_quantity > 40").select("l_partkey", "l_linenumber")
        return {"union_distinct": lambda: a.union(b).distinct(), "union_all": lambda: a.union(b), "intersect_distinct": lambda: a.intersect(b), "intersect_all": lambda: a.intersectAll(b), "except_distinct": lambda: a.subtract(b), "except_all": lambda: a.exceptAll(b)}[name]()

    run.__name__ = f"set_{name}"
    return run


for _name, _op in SETS.items():
    query(f"SELECT l_partkey, l_linenumber FROM lineitem WHERE l_quantity < 20 {_op} SELECT l_partkey, l_linenumber FROM lineitem WHERE l_quantity > 40")(_set_query(_name))


@query("WITH RECURSIVE t(n, f) AS (SELECT 1, 1::BIGINT UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
def recursive_cte(spark, d):
    return spark.sql("WITH RECURSIVE t(n, f) AS (SELECT 1, 1L UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")


CHAIN_SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role, {size} AS chars, 1::BIGINT AS depth FROM conversations WHERE turn = 0
  UNION ALL SELECT c.conv_id, c.turn, c.role, t.chars + {size}, t.depth + 1 FROM t JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = t.turn + 1)
SELECT conv_id, turn, role, chars, depth FROM t"""


@query(CHAIN_SQL.format(size="length(text)"))
def recursive_chain(spark, d):
    """Conversations from their first turn on, as far as turns follow each other, with the length so far; a round for each turn."""
    c = table(spark, d, "conversations")
    c.select("conv_id", "turn", "role", F.length("text").cast("long").alias("size")).createOrReplaceTempView("turns_v")
    return spark.sql("""
        WITH RECURSIVE t(conv_id, turn, role, chars, depth) AS (
          SELECT conv_id, turn, role, size, 1L FROM turns_v WHERE turn = 0
          UNION ALL SELECT c.conv_id, c.turn, c.role, t.chars + c.size, t.depth + 1 FROM t JOIN turns_v c ON c.conv_id = t.conv_id AND c.turn = t.turn + 1)
        SELECT * FROM t""")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark, d):
    return latest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT col0 AS k, col1 AS v FROM (VALUES (1, 'a'), (2, NULL), (3, 'c'))")
def inline_rows(spark, d):
    return spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")


@query("""
SELECT o_orderkey, weight, round(o_totalprice * weight, 2) AS weighted FROM orders LEFT JOIN (VALUES ('1-URGENT', 3.0), ('2-HIGH', 2.0), ('5-LOW', NULL), ('none', 9.0)) w(priority, weight) ON o_orderpriority = priority""")
def inline_rows_joined(spark, d):
    """Rows given in the query itself, joined to a table."""
    weights = spark.createDataFrame([("1-URGENT", 3.0), ("2-HIGH", 2.0), ("5-LOW", None), ("none", 9.0)], "priority string, weight double")
    return table(spark, d, "orders").join(F.broadcast(weights), F.col("o_orderpriority") == F.col("priority"), "left").select("o_orderkey", "weight", F.round(F.col("o_totalprice") * F.col("weight"), 2).alias("weighted"))


def _format_query(fmt: str):
    def run(spark, d):
        return round_trip(table(spark, d, "supplier"), shared_folder(spark, f"supplier-{fmt}"), fmt)

    run.__name__ = f"source_{fmt}"
    return run


for _fmt in ("parquet", "orc", "json", "csv", "xml"):
    query("SELECT * FROM supplier")(_format_query(_fmt))


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def source_jdbc(spark, d):
    """Through a database inside this JVM, so in local mode only."""
    url, suppliers = "jdbc:derby:memory:sprucelake;create=true", table(spark, d, "supplier")
    jdbc.write_table(suppliers, url, "supplier", jdbc.EMBEDDED_DRIVER)
    read_back = jdbc.read_table(spark, url, "supplier", jdbc.EMBEDDED_DRIVER, "s_suppkey", 4, 0, 1000)
    return read_back.toDF(*[c.lower() for c in read_back.columns]).select(suppliers.columns)


@query("SELECT day::DATE AS day, isodow(day)::INT AS weekday, isodow(day) > 5 AS weekend FROM (SELECT unnest(generate_series(TIMESTAMP '2023-11-20', TIMESTAMP '2025-02-03', INTERVAL 1 DAY)) AS day)")
def source_python(spark, d):
    spark.dataSource.register(Calendar)
    return spark.read.format("calendar").options(first="2023-11-20", last="2025-02-03").load()


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'")
def source_row_groups(spark, d):
    """A source in Python over a table's files: a partition for each row group, with columns and filters of its own."""
    spark.dataSource.register(RowGroups)
    push_filters(spark)
    rows = spark.read.format("row_groups").options(path=f"{d}/orders.parquet", columns="o_orderkey,o_orderdate,o_totalprice,o_orderstatus").load()
    return rows.where("o_totalprice > 300000 and o_orderstatus = 'F'").select("o_orderkey", "o_orderdate", "o_totalprice")


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def source_row_groups_stream(spark, d):
    """The same source read as a stream, some row groups a batch."""
    spark.dataSource.register(RowGroups)
    rows = spark.readStream.format("row_groups").options(path=f"{d}/orders.parquet", columns="o_orderkey,o_orderpriority,o_totalprice", groups="1").load()
    out = shared_folder(spark, "row-groups")
    query_ = rows.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").start()
    try:
        query_.processAllAvailable()
    finally:
        query_.stop()
    return spark.read.schema(rows.schema).parquet(f"{out}/data").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT n_name AS line FROM nation")
def source_text(spark, d):
    path = shared_folder(spark, "nation-text")
    table(spark, d, "nation").select("n_name").write.text(path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT o_orderkey, year(o_orderdate)::INT AS y FROM orders WHERE year(o_orderdate) = 1997")
def partition_pruned(spark, d):
    """A write by year, and a read of one year's folder."""
    path = shared_folder(spark, "orders-by-year")
    write(table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y")), path, partition_by=["y"])
    return read(spark, path).where("y = 1997").select("o_orderkey", F.col("y").cast("int").alias("y"))


@query("""
SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' GROUP BY 1""")
def partition_pruned_by_join(spark, d):
    """Orders in folders by nation, joined with the nations of one region: only their folders are read."""
    path = shared_folder(spark, "orders-by-nation")
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    write(table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_totalprice", "c_nationkey"), path, partition_by=["c_nationkey"])
    region = table(spark, d, "region").where("r_name = 'ASIA'").select("r_regionkey")
    nations = table(spark, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    return read(spark, path).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))  # 25 nations at any scale


@query("SELECT l_orderkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def bucketed_join(spark, d):
    """Both sides bucketed by the key: neither join nor group shuffles."""
    for name, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        table(spark, d, name).write.mode("overwrite").option("path", shared_folder(spark, f"{name}-buckets")).bucketBy(8, key).sortBy(key).saveAsTable(f"{name}_bucketed")
    rows = spark.table("lineitem_bucketed").join(spark.table("orders_bucketed").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
