"""Queries on incremental and streaming jobs (N, A4 and G4 of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import text_jobs
from quantloom.plans.registry import query
from quantloom.sources.fixtures import table
from quantloom.sources.lists import read_master, write_master
from quantloom.sources.scratch import scratch_path
from quantloom.streaming import jobs

_NOW = "2024-02-01 00:00:00"


@query("a4_master_roundtrip", "SELECT p_partkey AS row_no, p_name AS descr, CAST(p_size AS VARCHAR) AS qty FROM part")
def a4(spark, sf_dir):
    path = scratch_path(spark)
    write_master(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_no"), F.col("p_name").alias("descr"), F.col("p_size").cast("string").alias("qty")), path)
    return read_master(spark, path, "row_no bigint, descr string, qty string")


@query("g4_union_sources", "SELECT p_partkey AS id, 'part' AS source FROM part UNION ALL SELECT o_orderkey, 'order' FROM orders ORDER BY id, source")
def g4(spark, sf_dir):
    one = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("part").alias("source"))
    return one.unionByName(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("source"))).orderBy("id", "source")


@query("n1_incremental_index", """
SELECT doc_id AS path, CASE WHEN doc_id % 10 = 0 THEN 'delete' WHEN doc_id % 20 = 1 THEN 'index new' WHEN doc_id % 7 = 0 THEN 'index changed' ELSE 'skip' END AS action FROM documents
""")
def n1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(1).alias("mtime"))
    new = docs.where("path % 10 <> 0").withColumn("mtime", F.when(F.col("path") % 7 == 0, 2).otherwise(1))
    return jobs.snapshot_plan(docs.where("path % 20 <> 1"), new)


@query("n2_cursor_fetch", "SELECT event_id, user_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-15' ORDER BY ts, event_id LIMIT 500")
def n2(spark, sf_dir):
    return jobs.cursor_fetch(table(spark, sf_dir, "events"), F.lit("2024-01-15 13:00:00").cast("timestamp"), 500, ["ts", "event_id"]).select("event_id", "user_id")


@query("n3_task_state", """
SELECT task_id, status, changes FROM (SELECT task_id, status, count(*) OVER (PARTITION BY task_id) AS changes, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, event_id DESC) AS n FROM task_log) WHERE n = 1
""")
def n3(spark, sf_dir):
    return jobs.task_states(table(spark, sf_dir, "task_log")).drop("since")


def _table_stream(spark, sf_dir, name):
    """The table's files as a stream; a table of one file is found by its name in the folder."""
    given = table(spark, sf_dir, name)
    reader = spark.readStream.schema(given.schema)
    if given.inputFiles()[0].endswith(f"/{name}.parquet"):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


@query("n1_index_stream", """
SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS mtime, length(coalesce(text, '')) AS chars, CASE WHEN doc_id % 20 = 1 OR doc_id % 7 = 0 THEN 1 ELSE 0 END AS made FROM documents WHERE doc_id % 10 <> 0
""")
def n1_stream(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    first = docs.where("path % 20 <> 1").withColumn("mtime", F.lit(1)).withColumns({"scan": F.lit(0), "made": F.lit(0)})
    second = docs.where("path % 10 <> 0").withColumn("mtime", F.when(F.col("path") % 7 == 0, 2).otherwise(1)).withColumns({"scan": F.lit(1), "made": F.lit(1)})
    listings, base = scratch_path(spark), scratch_path(spark)
    work = lambda df: df.select("path", "mtime", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("chars"), "made")
    for scan in (first, second):  # the index is stopped and started again between the two
        scan.write.mode("append").parquet(listings)
        jobs.incremental_index(spark.readStream.schema(scan.schema).parquet(listings), base, work)
    return spark.read.parquet(jobs.newest(spark, base))


@query("n3_watched_tasks", """
WITH l AS (SELECT *, count(*) OVER (PARTITION BY task_id) AS changes, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, event_id DESC) AS n, max(ts) OVER () AS newest FROM task_log)
SELECT task_id, CASE WHEN status = 'processing' AND ts + INTERVAL 2 DAY < newest - INTERVAL 1 HOUR THEN 'failed' ELSE status END AS status, changes FROM l WHERE n = 1
""")
def n3_stream(spark, sf_dir):
    status = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type").isin("view", "click"), "processing").when(F.col("event_type") == "purchase", "done").otherwise("failed")
    log = _table_stream(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), "event_id", "ts", status.alias("status"))
    base = scratch_path(spark)
    jobs.upserted(jobs.watched_state_stream(log, "2 days", late="1 hour"), base, ["task_id"], "rev", "update")
    return spark.read.parquet(jobs.newest(spark, base)).select("task_id", "status", "changes")


@query("n4_stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def n4(spark, sf_dir):
    return jobs.drained(jobs.deduplicated_stream(_table_stream(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "40 days").select("user_id", "event_type"))


_SCORES = f"""
WITH a AS (SELECT item_id, count(*) AS c, max(ts) AS last FROM access GROUP BY item_id), i AS (SELECT c_custkey AS item_id, 0.5::DOUBLE + c_custkey % 10 / 10.0::DOUBLE AS base FROM customer),
s AS (SELECT i.item_id, base, coalesce(c, 0) AS count, round(least(greatest(base * exp(-0.05::DOUBLE * coalesce((epoch_us(TIMESTAMP '{_NOW}') - epoch_us(last)) / 86400000000.0::DOUBLE, 0)) * (1 + 0.3::DOUBLE * ln(1 + coalesce(c, 0))), 0), 10), 6) AS score FROM i LEFT JOIN a ON a.item_id = i.item_id)
"""


def _scores(spark, sf_dir):
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id"), (F.lit(0.5) + F.col("c_custkey") % 10 / 10.0).alias("base"))
    return jobs.decay_scores(items, table(spark, sf_dir, "access"), F.lit(_NOW).cast("timestamp"), 0.05, 0.3)


@query("n5_decay_scores", f"{_SCORES} SELECT * FROM s")
def n5(spark, sf_dir):
    return _scores(spark, sf_dir)


@query("n6_decay_cleanup", f"{_SCORES} SELECT item_id, score FROM s WHERE score < 0.8 ORDER BY score, item_id")
def n6(spark, sf_dir):
    return jobs.decay_cleanup(_scores(spark, sf_dir).select("item_id", "score"), 0.8)


@query("n7_session_growth", """
WITH l AS (SELECT conv_id, trim(unnest(string_split(text, chr(10)))) AS line FROM conversations)
SELECT conv_id, least(8, count(DISTINCT line)) AS candidates FROM l WHERE length(line) BETWEEN 6 AND 120 AND regexp_matches(line, 'the|de') AND NOT regexp_matches(line, '[!$]') GROUP BY conv_id HAVING count(DISTINCT line) >= 2
""")
def n7(spark, sf_dir):
    return jobs.session_growth(table(spark, sf_dir, "conversations"), lambda m: text_jobs.memory_candidates(m, "the|de", "[!$]"))


@query("n7_closed_sessions", """
WITH m AS (SELECT conv_id, turn, text, turn // 4 AS s, 1704067200 + (conv_id * 1440 + turn // 4 * 120 + turn % 4) * 60 AS sec FROM conversations),
c AS (SELECT conv_id, s, min(sec) AS first_sec, max(sec) + 1800 AS last_sec FROM m WHERE sec IS NOT NULL GROUP BY 1, 2),
l AS (SELECT m.conv_id, first_sec, trim(unnest(string_split(text, chr(10)))) AS line FROM m JOIN c ON m.conv_id = c.conv_id AND m.s = c.s WHERE last_sec <= (SELECT max(sec) FROM m) - 3600)
SELECT conv_id, first_sec, least(8, count(DISTINCT line)) AS candidates FROM l WHERE length(line) BETWEEN 6 AND 120 AND regexp_matches(line, 'the|de') AND NOT regexp_matches(line, '[!$]') GROUP BY 1, 2
""")
def n7_stream(spark, sf_dir):
    ts = F.expr("timestamp_seconds(1704067200 + (conv_id * 1440 + turn div 4 * 120 + turn % 4) * 60)")
    base = scratch_path(spark)
    talk = lambda: table(spark, sf_dir, "conversations").withColumn("ts", ts)
    jobs.grow_from_sessions(_table_stream(spark, sf_dir, "conversations").withColumn("ts", ts), talk, base, "30 minutes", "1 hour", lambda m: text_jobs.memory_candidates(m, "the|de", "[!$]"))
    mined = spark.read.option("recursiveFileLookup", True).schema("conv_id bigint, nth int, line string, first timestamp").parquet(f"{base}/mined")
    return mined.groupBy("conv_id", F.unix_seconds("first").alias("first_sec")).agg(F.count("*").alias("candidates"))


@query("n_windowed_counts", """
SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2
""")
def n8(spark, sf_dir):
    out = jobs.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "1 day", "2 hours")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")
