"""Queries over the text tables with built-in functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sprucelake.operators.joins import join_small
from sprucelake.plans.registry import query
from sprucelake.session import table


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def repeated_texts(spark, d):
    """Hashes first: only texts whose hash occurs again are shuffled and compared."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.xxhash64("text").alias("print"))
    again = docs.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print")
    return join_small(docs, again, ["print"], "left_semi").groupBy("print", "text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1").select("doc_id", "copies")


@query("""
SELECT md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS print, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1""")
def normalised_texts(spark, d):
    print_ = F.md5(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")))
    return table(spark, d, "documents").groupBy(print_.alias("print")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'))::INT AS mails FROM documents")
def mail_addresses(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")).alias("mails"))


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM documents) WHERE w <> '' GROUP BY 1 ORDER BY n DESC, word LIMIT 100")
def frequent_words(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(100)


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def page_titles(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS whole, count(*) AS turns FROM conversations GROUP BY 1")
def conversations_assembled(spark, d):
    turns = F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(turns["line"], "\n").alias("whole"), F.count("*").alias("turns"))


@query("SELECT lang, quality, count(*) AS n, round(avg(n_chars), 4) AS mean_chars FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 GROUP BY 1, 2")
def labelled_quality(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").where("toxic = 0"), "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT line, count(DISTINCT doc_id) AS docs FROM l WHERE length(line) >= 30 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5""")
def repeated_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") >= 30)
    return lines.distinct().groupBy("line").agg(F.count("*").alias("docs")).where("docs >= 5")


@query("SELECT source, lang, count(*) AS docs, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY CUBE (source, lang)")
def corpus_cube(spark, d):
    return table(spark, d, "documents").cube("source", "lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
