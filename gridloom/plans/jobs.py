"""Queries of the job store, with orders as jobs and customers as documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import jobs as j
from gridloom.streaming import inbox, store

from .registry import query, scratch, table

STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'completed_with_warnings' END ELSE CASE WHEN o_orderkey % 4 = 0 THEN 'running' WHEN o_orderkey % 4 = 1 THEN 'queued' ELSE 'cancelled' END END"
NOW = "TIMESTAMP '1999-01-01 00:00:00'"


def jobs(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("document_id"), F.col("o_orderdate").alias("created_at"), F.expr(STATUS).alias("status"), (F.col("o_orderkey") % 2).cast("int").alias("attempt"), F.lit(None).cast("timestamp").alias("started_at"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate").cast("timestamp")).alias("lease_until"), F.concat(F.lit("w"), (F.col("o_orderkey") % 5).cast("string")).alias("lease_owner"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit(0).alias("done"), F.lit(0).alias("total"))


def documents(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_mktsegment").alias("name"))


@query(f"""WITH r AS (SELECT o_custkey AS document_id, o_orderkey AS id, {STATUS} AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS i FROM orders) SELECT c_custkey AS document_id, c_mktsegment AS name, id, status FROM customer LEFT JOIN r ON c_custkey = document_id AND i = 1""")
def j1_latest_job(spark, d):
    return j.with_latest(documents(spark, d), jobs(spark, d), "document_id", ["id", "status"])


@query(f"""WITH r AS (SELECT o_custkey AS document_id, {STATUS} AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS i FROM orders) SELECT c_custkey AS document_id, c_mktsegment AS name, coalesce(status, 'pending') AS status FROM customer LEFT JOIN r ON c_custkey = document_id AND i = 1""")
def j5_document_status(spark, d):
    return j.document_status(documents(spark, d), jobs(spark, d), "document_id")


@query("SELECT o_orderkey AS id, o_custkey AS document_id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 50")
def j2_page(spark, d):
    return j.page_of(jobs(spark, d), [F.col("created_at").desc(), F.col("seq").desc()], 25, 50).select("id", "document_id")


@query(f"""WITH s(status) AS (VALUES ('pending'), ('queued'), ('running'), ('completed'), ('completed_with_warnings'), ('failed'), ('cancelled')), c AS (SELECT {STATUS} AS status, count(*) AS n FROM orders GROUP BY 1) SELECT status, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (status) UNION ALL SELECT 'total', count(*) FROM orders""")
def j3_counts(spark, d):
    return j.counts_by(jobs(spark, d), "status", list(j.STATES))


@query("SELECT o_orderkey AS id, o_custkey AS document_id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def j9_listed(spark, d):
    return j.listed(jobs(spark, d), 500).select("id", "document_id")


@query("SELECT c_custkey AS document_id, 'queued' AS status, 0 AS attempt, CAST(NULL AS VARCHAR) AS lease_owner FROM customer")
def j9_created(spark, d):
    return j.created(documents(spark, d), F.lit("1999-01-01").cast("timestamp")).select("document_id", "status", "attempt", "lease_owner")


@query(f"SELECT o_orderkey AS job_id, {STATUS} AS status, o_custkey AS document_id, CASE WHEN {STATUS} LIKE 'completed%' THEN '/api/jobs/' || o_orderkey || '/result' END AS result_url FROM orders")
def j23_public(spark, d):
    done = jobs(spark, d).withColumn("result_path", F.when(F.col("status").startswith("completed"), "x"))
    return j.public(done, {"id": "job_id", "status": "status", "document_id": "document_id"}, F.concat(F.lit("/api/jobs/"), F.col("id").cast("string"), F.lit("/result")))


@query("SELECT 75 < count(*) AS has_more, count(*) AS total FROM orders")
def j4_has_more(spark, d):
    return jobs(spark, d).agg(F.count("*").alias("total")).select(j.has_more(F.col("total"), 50, 25).alias("has_more"), "total")


ROLLUP = f"""SELECT o_custkey AS document_id, count(*) AS jobs, CASE WHEN bool_or(s = 'running') THEN 'running' WHEN bool_or(s = 'queued') AND bool_or(s <> 'queued') THEN 'running' WHEN bool_or(s = 'queued') THEN 'queued'
 WHEN bool_and(s IN ('completed', 'completed_with_warnings')) THEN CASE WHEN bool_or(s = 'completed_with_warnings') THEN 'completed_with_warnings' ELSE 'completed' END WHEN bool_and(s = 'cancelled') THEN 'cancelled' WHEN bool_and(s = 'failed') THEN 'failed' ELSE 'completed_with_errors' END AS status
 FROM (SELECT *, {STATUS} AS s FROM orders) GROUP BY 1"""


@query(f"SELECT *, status NOT IN ('running', 'queued') AS over FROM ({ROLLUP})")
def j6_batch_rollup(spark, d):
    return j.batches(jobs(spark, d), "document_id", F.lit("1999-01-01").cast("timestamp")).select("document_id", "jobs", "status", F.col("completed_at").isNotNull().alias("over"))


@query("""SELECT c_custkey AS document_id, 'queued' AS status, CASE WHEN c_custkey % 2 = 0 THEN '{"k":1}' ELSE '{}' END AS settings_json FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def j7_snapshot(spark, d):
    docs = j.document_status(documents(spark, d), jobs(spark, d), "document_id").withColumn("settings_json", F.when(F.col("document_id") % 2 == 0, '{"k":1}'))
    return j.snapshot(docs, "{}", "b1").select("document_id", "status", "settings_json")


@query(f"SELECT o_custkey AS document_id, string_agg(o_orderkey, ',' ORDER BY o_orderdate, o_orderkey) AS ids FROM orders GROUP BY 1")
def j8_batch_detail(spark, d):
    detail = j.batch_detail(jobs(spark, d), "document_id", ["created_at", "seq"], ["id"])
    return detail.select("document_id", F.array_join(F.transform("jobs", lambda x: x["id"].cast("string")), ",").alias("ids"))


@query(f"SELECT o_orderkey AS id, 'running' AS status, CAST(o_orderkey % 2 + 1 AS INT) AS attempt, 'me' AS lease_owner FROM orders WHERE {STATUS} = 'queued' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def j10_claim(spark, d):
    return j.claimed(jobs(spark, d), "me", F.lit("1999-01-01").cast("timestamp"), 300).select("id", "status", "attempt", "lease_owner")


@query(f"SELECT count(*) AS n, count_if({STATUS} = 'running' AND o_orderkey = 8 AND o_orderkey % 5 = 3) AS changed FROM orders")
def j11_heartbeat(spark, d):
    after = j.beaten(jobs(spark, d), "8", "w3", F.lit("2005-01-01").cast("timestamp"))
    return after.agg(F.count("*").alias("n"), F.count_if(F.col("lease_until") == F.lit("2005-01-01").cast("timestamp")).alias("changed"))


@query(f"SELECT count(*) AS n, count_if({STATUS} = 'running' AND o_orderkey = 16) AS changed FROM orders")
def j12_progress(spark, d):
    return j.progressed(jobs(spark, d), "16", 3, 9).agg(F.count("*").alias("n"), F.count_if(F.col("done") == 3).alias("changed"))


@query(f"SELECT s AS status, count(*) AS n FROM (SELECT CASE WHEN {STATUS} = 'running' AND o_orderkey = 16 THEN 'failed' ELSE {STATUS} END AS s FROM orders) GROUP BY 1")
def j13_finish(spark, d):
    return j.finished(jobs(spark, d), "16", "failed", F.lit("1999-01-01").cast("timestamp")).groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT s AS status, count(*) AS n FROM (SELECT CASE WHEN {STATUS} IN ('queued', 'running') AND o_orderkey IN (5, 8, 12, 16, 20, 21) THEN 'cancelled' ELSE {STATUS} END AS s FROM orders) GROUP BY 1")
def j14_cancel(spark, d):
    return j.cancelled(jobs(spark, d), ["5", "8", "12", "16", "20", "21"], F.lit("1999-01-01").cast("timestamp")).groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey AS id FROM orders WHERE {STATUS} = 'running' AND (o_orderkey % 3 = 0 OR o_orderdate <= TIMESTAMP '1997-01-01')")
def j15_expired(spark, d):
    return jobs(spark, d).where(j.is_expired(F.lit("1997-01-01").cast("timestamp"))).select("id")


@query(f"SELECT s AS status, count(*) AS n FROM (SELECT CASE WHEN {STATUS} = 'running' AND (o_orderkey % 3 = 0 OR o_orderdate <= TIMESTAMP '1997-01-01') THEN 'queued' ELSE {STATUS} END AS s FROM orders) GROUP BY 1")
def j15_recovered(spark, d):
    return j.recovered(jobs(spark, d), F.lit("1997-01-01").cast("timestamp")).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey IN (2, 4) THEN 'new' ELSE 'old' END AS settings_json FROM orders")
def j16_settings_edit(spark, d):
    edits = spark.createDataFrame([(2, "new"), (4, "new")], "id long, settings string")
    return j.settings_edits(jobs(spark, d).withColumn("settings_json", F.lit("old")), edits).select("id", "settings_json")


@query(f"SELECT count(*) AS n FROM orders WHERE NOT (o_custkey < 500 AND {STATUS} <> 'running')")
def j17_deleted(spark, d):
    all_jobs = jobs(spark, d)
    return j.deleted(all_jobs, all_jobs.where("document_id < 500")).agg(F.count("*").alias("n"))


@query(f"SELECT o_custkey AS document_id, count(*) AS active FROM orders WHERE {STATUS} IN ('queued', 'running') GROUP BY 1 HAVING count(*) > 1")
def j19_twice_active(spark, d):
    return j.twice_active(jobs(spark, d), "document_id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def j20_orphans(spark, d):
    return j.orphans(jobs(spark, d), documents(spark, d).where("document_id % 2 = 0"), "document_id").select("id")


@query("SELECT 4 AS version, 2 AS pending, FALSE AS unknown")
def j21_schema_version(spark, d):
    return j.schema_version(table(spark, d, "region").select(F.col("r_regionkey").alias("version")), 6)


@query(f"SELECT 2 * count(*) AS active FROM orders WHERE {STATUS} IN ('queued', 'running')")
def j22_active_jobs(spark, d):
    return j.active_jobs([jobs(spark, d), jobs(spark, d)])


@query("SELECT r_name, string_agg(n_name, ',' ORDER BY n_nationkey) AS visible FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 0 GROUP BY r_name")
def j24_visible_columns(spark, d):
    n = table(spark, d, "nation").where("n_nationkey % 3 <> 0").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.batch_detail(n, "r_name", ["n_nationkey"], ["n_name"]).select("r_name", F.array_join(F.transform("jobs", lambda x: x["n_name"]), ",").alias("visible"))


@query("SELECT o_orderkey AS id FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment <> 'BUILDING' WHERE c_custkey IS NULL")
def j25_without_document(spark, d):
    known = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("document_id"))
    return jobs(spark, d).join(known, "document_id", "left_anti").select("id")


@query("""WITH f AS (SELECT c_custkey, 'f' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png' ELSE '.exe' END AS name, c_custkey % 90 * 1000000 AS n, count(*) OVER (PARTITION BY CASE WHEN c_custkey % 1000 < 150 THEN c_custkey // 1000 * 1000 ELSE c_custkey // 90 * 10 + 1 END) > 100 AS many FROM customer)
SELECT name, CASE WHEN many THEN 'too many files' WHEN name LIKE '%.exe' THEN 'type' WHEN n = 0 THEN 'empty' WHEN n > 52428800 THEN 'too large' ELSE 'no PDF' END AS error FROM f WHERE many OR name LIKE '%.exe' OR n = 0 OR n > 52428800 OR (name LIKE '%.PDF' AND c_custkey % 2 = 0)""")
def j26_upload_errors(spark, d):
    k = F.col("c_custkey")
    request = F.when(k % 1000 < 150, F.floor(k / 1000) * 1000).otherwise(F.floor(k / 90) * 10 + 1)
    files = table(spark, d, "customer").select(request.alias("request"), F.concat(F.lit("f"), k.cast("string"), F.when(k % 3 == 0, ".PDF").when(k % 3 == 1, ".png").otherwise(".exe")).alias("name"), (k % 90 * 1000000).alias("length"), F.when(k % 2 == 1, "x%PDF-1.4").otherwise("").cast("binary").alias("head"))
    return j.upload_errors(files, "request")


def written_jobs(spark, d):
    """jobs() as rows of a written store: customers are their batches, and some running jobs' leases are over."""
    o = jobs(spark, d)
    running = F.col("status") == "running"
    return o.select("id", F.col("document_id").alias("batch_id"), "status", "attempt", F.lit(0).cast("long").alias("done"), F.lit(0).cast("long").alias("total"), F.col("created_at").cast("timestamp").alias("created_at"), "seq", "started_at", F.lit(None).cast("timestamp").alias("finished_at"), F.when(running, F.col("lease_owner")).alias("lease_owner"), F.when(running, F.col("lease_until")).alias("lease_until"))


RECOVERED = f"SELECT o_orderkey AS id, o_custkey AS batch_id, o_orderdate, CASE WHEN {STATUS} = 'running' AND (o_orderkey % 3 = 0 OR o_orderdate <= TIMESTAMP '1997-01-01') THEN 'queued' ELSE {STATUS} END AS s FROM orders"


@query(f"""WITH j AS ({RECOVERED}), q AS (SELECT id, row_number() OVER (ORDER BY o_orderdate, id) AS i FROM j WHERE s = 'queued'), c AS (SELECT user_id, row_number() OVER (ORDER BY event_id) AS i FROM events WHERE event_type = 'purchase'), t AS (SELECT q.id, 'u' || user_id AS owner FROM q JOIN c USING (i)),
a AS (SELECT j.id, j.batch_id, CASE WHEN t.id IS NOT NULL THEN 'running' ELSE s END AS status, CAST(j.id % 2 + CASE WHEN t.id IS NULL THEN 0 ELSE 1 END AS INT) AS attempt, CASE WHEN t.id IS NOT NULL THEN owner WHEN s = 'running' THEN 'w' || j.id % 5 END AS lease_owner FROM j LEFT JOIN t ON j.id = t.id)
SELECT id, status, attempt, lease_owner FROM a""")
def j10_written_claims(spark, d):
    """A recovery and a claim for each purchase, in their order, by a stream of several batches."""
    base = scratch(spark)
    claims = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("number"), F.lit("claim").alias("kind"), F.lit("1999-01-01").cast("timestamp").alias("at"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("worker"), F.lit(300).cast("long").alias("seconds"))
    first = spark.createDataFrame([(-1, "recover")], "number long, kind string").withColumn("at", F.lit("1997-01-01").cast("timestamp"))
    requests = claims.unionByName(first, allowMissingColumns=True)
    empty = spark.createDataFrame([], store.REQUEST)
    for i, (low, high) in enumerate(thirds(requests)):
        part = empty.unionByName(requests.where(F.col("number").between(low, high)), allowMissingColumns=True)
        part.repartition(1).write.mode("append").parquet(f"{base}/in")
    store.seeded(written_jobs(spark, d), f"{base}/store")
    inbox.start(inbox.arrivals(spark, f"{base}/in", empty.schema, 1), store.serving(f"{base}/store"), f"{base}/checkpoint").awaitTermination()
    return store.current(spark, f"{base}/store")[0].select("id", "status", "attempt", "lease_owner")


def thirds(requests):
    """Ranges of numbers that cut requests into three runs."""
    low, high = requests.agg(F.min("number"), F.max("number")).first()
    cuts = [low - 1, low + (high - low) // 3, low + (high - low) * 2 // 3, high]
    return [(a + 1, b) for a, b in zip(cuts, cuts[1:], strict=False)]


@query(f"SELECT o_custkey AS batch_id, count(*) AS jobs, {ROLLUP.split('count(*) AS jobs,')[1].split(' AS status')[0]} AS status FROM (SELECT *, {STATUS} AS s FROM orders) WHERE NOT (o_orderkey % 7 < 3 AND s <> 'running') GROUP BY 1")
def j17_parents(spark, d):
    """Batches after deletions, of which only the touched ones were rolled up again."""
    before = written_jobs(spark, d)
    batches = store.rolled(before, F.max("finished_at"))
    after = j.deleted(before, before.where("id % 7 < 3"))
    touched = before.join(after.select("id"), "id", "left_anti").select("batch_id").distinct()
    own = store.resynced(batches.drop("gone"), after, touched, F.lit("1999-01-01").cast("timestamp"))
    rest = batches.join(touched, "batch_id", "left_anti")
    return rest.unionByName(own).where("not gone").select("batch_id", "jobs", "status")
