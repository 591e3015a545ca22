"""Queries that run a bounded stream to its end; their batch equals their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.streaming import inbox, states

from .registry import query, scratch, table


@query("SELECT event_id, user_id, event_type FROM events WHERE value > 20")
def st1_available_now(spark, d):
    source, base = table(spark, d, "events"), scratch(spark)
    source.repartition(3, "event_id").write.parquet(f"{base}/in")
    rows = inbox.drained(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", lambda df: df.where("value > 20").select("event_id", "user_id", "event_type"), source.schema)
    return rows.select("event_id", "user_id", "event_type")


@query("SELECT to_timestamp(floor(epoch(ts) / 21600) * 21600)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st_windowed_counts(spark, d):
    return inbox.windowed_counts(table(spark, d, "events"), "ts", "event_type", "6 hours", "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH t AS (SELECT user_id AS job_id, ts AS moment, event_id AS seq, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status FROM events) SELECT job_id, arg_max(status, (moment, seq)) AS status, count_if(status = 'running') AS attempt FROM t GROUP BY job_id""")
def st6_job_states(spark, d):
    """Three runs of a stream, each one batch of what has arrived since, however many files, and resuming from the one before."""
    status = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "completed").otherwise("failed")
    moves = table(spark, d, "events").select(F.col("user_id").alias("job_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"))
    base = scratch(spark)
    for i in range(3):
        moves.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == i).write.mode("append").parquet(f"{base}/in")
        states.keep_states(inbox.arrivals(spark, f"{base}/in", moves.schema, 1_000_000), states.appending(f"{base}/out"), f"{base}/checkpoint").awaitTermination()
    return states.newest_states(spark.read.parquet(f"{base}/out")).select("job_id", "status", "attempt")


@query("""WITH e AS (SELECT user_id AS job_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events), c AS (SELECT *, sum(s) OVER (PARTITION BY job_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT job_id, max(ts) AS last_beat FROM c GROUP BY job_id, k""")
def st2_expired_leases(spark, d):
    beats = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"))
    return inbox.expired_leases(beats, 21600).select("job_id", F.col("last_beat").cast("timestamp_ntz").alias("last_beat"))
