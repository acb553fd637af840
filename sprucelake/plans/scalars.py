"""Scalar functions by family."""

from __future__ import annotations

from pyspark.sql import functions as F

from sprucelake.plans.registry import query
from sprucelake.session import table


@query("""
SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_name) AS low, substring(c_name, 2, 4) AS part, length(c_name)::INT AS len, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '-') AS rp,
  reverse(c_mktsegment) AS rev, replace(c_name, '#', '/') AS rep, instr(c_mktsegment, 'U')::INT AS pos, repeat('ab', 2) AS rpt, trim('  x ') AS tr, concat_ws('|', c_name, c_mktsegment) AS cw,
  split_part(c_name, '#', 1) AS sp, translate(c_mktsegment, 'AEIOU', '12345') AS tl, ascii(c_mktsegment)::INT AS asc_, left(c_name, 3) AS lf, right(c_name, 3) AS rt, starts_with(c_mktsegment, 'B') AS sw FROM customer""")
def string_functions(spark, d):
    n, m = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, d, "customer").select(
        "c_custkey", F.upper(m).alias("up"), F.lower(n).alias("low"), F.substring(n, 2, 4).alias("part"), F.length(n).alias("len"), F.lpad(m, 12, "*").alias("lp"), F.rpad(m, 12, "-").alias("rp"),
        F.reverse(m).alias("rev"), F.replace(n, F.lit("#"), F.lit("/")).alias("rep"), F.instr(m, "U").alias("pos"), F.repeat(F.lit("ab"), 2).alias("rpt"), F.trim(F.lit("  x ")).alias("tr"), F.concat_ws("|", n, m).alias("cw"),
        F.split_part(n, F.lit("#"), F.lit(1)).alias("sp"), F.translate(m, "AEIOU", "12345").alias("tl"), F.ascii(m).alias("asc_"), F.left(n, F.lit(3)).alias("lf"), F.right(n, F.lit(3)).alias("rt"), F.startswith(m, F.lit("B")).alias("sw"))


@query("""
SELECT doc_id, regexp_replace(text, '[aeiou]', '_', 'g') AS masked, regexp_extract(text, '([A-Z][a-z]+)', 1) AS first_cap, len(regexp_extract_all(text, '[0-9]+'))::INT AS numbers,
  len(string_split_regex(text, '\\n'))::INT AS lines, levenshtein(source, lang)::INT AS dist FROM documents""")
def regex_functions(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(t, "[aeiou]", "_").alias("masked"), F.regexp_extract(t, "([A-Z][a-z]+)", 1).alias("first_cap"), F.regexp_count(t, F.lit("[0-9]+")).alias("numbers"), F.size(F.split(t, "\n")).alias("lines"), F.levenshtein("source", "lang").alias("dist"))


@query("""
SELECT o_orderkey, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS dd, dayofyear(o_orderdate)::INT AS dy, dayofweek(o_orderdate)::INT AS dw, weekofyear(o_orderdate)::INT AS wk,
  last_day(o_orderdate) AS eom, date_trunc('month', o_orderdate)::TIMESTAMP AS bom, (o_orderdate::DATE + 10)::DATE AS plus, (o_orderdate::DATE + INTERVAL 2 MONTH)::DATE AS months, strftime(o_orderdate, '%Y/%m/%d') AS fmt,
  date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INT AS days, o_orderdate + INTERVAL 90 MINUTE AS later FROM orders""")
def date_functions(spark, d):
    c = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", F.year(c).alias("y"), F.quarter(c).alias("q"), F.month(c).alias("m"), F.day(c).alias("dd"), F.dayofyear(c).alias("dy"), (F.dayofweek(c) - 1).alias("dw"), F.weekofyear(c).alias("wk"),
        F.last_day(c).alias("eom"), F.date_trunc("month", c).cast("timestamp_ntz").alias("bom"), F.date_add(c.cast("date"), 10).alias("plus"), F.add_months(c.cast("date"), 2).alias("months"), F.date_format(c, "yyyy/MM/dd").alias("fmt"),
        F.datediff(c.cast("date"), F.lit("1995-01-01").cast("date")).alias("days"), (c + F.expr("interval 90 minutes")).alias("later"))


@query("""
SELECT s_suppkey, abs(s_acctbal) AS a, ceil(s_acctbal)::BIGINT AS c, floor(s_acctbal)::BIGINT AS f, round(s_acctbal, 1) AS r, round(sqrt(abs(s_acctbal)), 6) AS sq, round(power(s_nationkey, 2), 2) AS pw,
  round(ln(abs(s_acctbal) + 1), 6) AS lg, round(exp(s_nationkey / 10.0), 6) AS ex, sign(s_acctbal)::DOUBLE AS sg, s_suppkey % 7 AS md, greatest(s_nationkey, 12) AS g, least(s_nationkey, 12) AS l FROM supplier""")
def math_functions(spark, d):
    b, n = F.col("s_acctbal"), F.col("s_nationkey")
    return table(spark, d, "supplier").select(
        "s_suppkey", F.abs(b).alias("a"), F.ceil(b).alias("c"), F.floor(b).alias("f"), F.round(b, 1).alias("r"), F.round(F.sqrt(F.abs(b)), 6).alias("sq"), F.round(F.pow(n, 2), 2).alias("pw"),
        F.round(F.ln(F.abs(b) + 1), 6).alias("lg"), F.round(F.exp(n / 10.0), 6).alias("ex"), F.signum(b).alias("sg"), (F.col("s_suppkey") % 7).alias("md"), F.greatest(n, F.lit(12)).alias("g"), F.least(n, F.lit(12)).alias("l"))


@query("""
WITH a AS (SELECT event_id, [user_id, event_id % 5, event_id % 3, user_id] AS xs FROM events)
SELECT event_id, len(xs)::INT AS n, list_max(xs) AS top, xs[1] AS head, list_sum(xs)::BIGINT AS total, list_filter(xs, lambda x: x > 2) AS big, list_transform(xs, lambda x: x * 2) AS twice, list_sort(list_distinct(xs)) AS uniq,
  list_contains(xs, 3) AS has3, xs[2:3] AS mid, range(1, 4) AS seq, array_to_string(xs, '-') AS joined, flatten([xs, [0]]) AS flat, list_sort(xs) AS sorted FROM a""")
def array_functions(spark, d):
    u, e = F.col("user_id"), F.col("event_id")
    x = F.col("xs")
    return table(spark, d, "events").select("event_id", F.array(u, e % 5, e % 3, u).alias("xs")).select(
        "event_id", F.size(x).alias("n"), F.array_max(x).alias("top"), x[0].alias("head"), F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y).alias("total"), F.filter(x, lambda y: y > 2).alias("big"), F.transform(x, lambda y: y * 2).alias("twice"), F.sort_array(F.array_distinct(x)).alias("uniq"),
        F.array_contains(x, F.lit(3).cast("long")).alias("has3"), F.slice(x, 2, 2).alias("mid"), F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long")).alias("seq"), F.array_join(x.cast("array<string>"), "-").alias("joined"), F.flatten(F.array(x, F.array(F.lit(0).cast("long")))).alias("flat"), F.sort_array(x).alias("sorted"))


@query("""
SELECT c_custkey, upper(left(c_mktsegment, 1)) || lower(substring(c_mktsegment, 2)) AS cap, coalesce(list_position(string_split(c_name, '#'), right(c_name, 9)), 0)::BIGINT AS place,
  coalesce(list_position([c_nationkey, 3, 7], 7), 0)::BIGINT AS seven FROM customer""")
def initcap_and_places(spark, d):
    parts = F.split("c_name", "#")
    return table(spark, d, "customer").select("c_custkey", F.initcap("c_mktsegment").alias("cap"), F.array_position(parts, F.right("c_name", F.lit(9))).alias("place"), F.array_position(F.array("c_nationkey", F.lit(3), F.lit(7)), F.lit(7)).alias("seven"))


@query("SELECT item_id, i - 1 AS place, w AS word FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM benchmark)")
def explode_with_place(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("place", "word")).withColumn("place", F.col("place").cast("long"))


@query("""
WITH m AS (SELECT s_suppkey, MAP {'nation': s_nationkey::DOUBLE, 'balance': s_acctbal} AS m FROM supplier)
SELECT s_suppkey, m['balance'] AS balance, list_sort(map_keys(m)) AS ks, len(map_values(m))::INT AS n FROM m""")
def map_functions(spark, d):
    m = F.create_map(F.lit("nation"), F.col("s_nationkey").cast("double"), F.lit("balance"), F.col("s_acctbal"))
    return table(spark, d, "supplier").select("s_suppkey", m.alias("m")).select("s_suppkey", F.col("m")["balance"].alias("balance"), F.sort_array(F.map_keys("m")).alias("ks"), F.size(F.map_values("m")).alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k, json_extract_string(props, '$.none') AS none FROM events")
def json_functions(spark, d):
    p = F.from_json("props", "k int")
    return table(spark, d, "events").select("event_id", p["k"].alias("k"), F.get_json_object("props", "$.none").alias("none"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def variant_functions(spark, d):
    return table(spark, d, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "long").alias("k"))


@query("SELECT doc_id, md5(text) AS m, sha256(text) AS s FROM documents")
def hash_functions(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("m"), F.sha2("text", 256).alias("s"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^(https?)', 1) AS scheme FROM pages")
def url_functions(spark, d):
    return table(spark, d, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.parse_url("url", F.lit("PROTOCOL")).alias("scheme"))


@query("SELECT o_orderkey, (o_totalprice * 100)::DECIMAL(18,2)::DOUBLE AS cents, o_totalprice > 100000 AS big, try_cast(o_orderstatus AS INT) AS none FROM orders")
def casts(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") * 100).cast("decimal(18,2)").cast("double").alias("cents"), (F.col("o_totalprice") > 100000).alias("big"), F.col("o_orderstatus").try_cast("int").alias("none"))
