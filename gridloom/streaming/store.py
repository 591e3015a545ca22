"""The job store, written by one stream of requests: claims, beats, ends, cancellations, recoveries, deletions.

A batch of requests makes a new version of the store: the rows that it changes,
in a folder of its number. The store as of a version is the newest row of each
job below it, so a batch that runs again after a stop sees what it saw before,
writes the same rows, and takes the place of itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import timedelta
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridloom.functions.deploy import stored
from gridloom.operators.jobs import batch_status, is_expired

from .inbox import at_path

JOB = "id long, batch_id long, status string, attempt int, done long, total long, created_at timestamp, seq long, started_at timestamp, finished_at timestamp, lease_owner string, lease_until timestamp"
ROW = f"{JOB}, gone boolean"
#: What is asked for; of the columns after `at`, each kind uses some.
REQUEST = "number long, kind string, at timestamp, job_id long, batch_id long, worker string, seconds long, status string, done long, total long"
ANSWER = "number long, kind string, job_id long, granted boolean"
BATCH = "batch_id long, status string, jobs long, started_at timestamp, completed_at timestamp, gone boolean"
NAMES = [c.split()[0] for c in JOB.split(", ")]
FREE = {"lease_owner": None, "lease_until": None}


def place_of(job: dict) -> tuple:
    """Where a queued job stands in the queue: the oldest first, and of one time the first that came."""
    return job["created_at"], job["seq"], job["id"]


def granted(jobs: dict[int, dict], queue: list[tuple], r: dict) -> int | None:
    """Carries out one request on jobs by id; the id of the job that it changed, None if it is refused.

    queue is a heap that has every queued job, and may have others.
    """
    kind, at, job = r["kind"], r["at"], jobs.get(r["job_id"])
    if kind == "claim":
        while queue and (jobs[queue[0][-1]]["status"] != "queued" or jobs[queue[0][-1]]["gone"]):
            heappop(queue)
        if not queue:
            return None
        job = jobs[heappop(queue)[-1]]
        job |= {"status": "running", "attempt": job["attempt"] + 1, "started_at": job["started_at"] or at, "lease_owner": r["worker"], "lease_until": at + timedelta(seconds=max(1, r["seconds"] or 0))}
        return job["id"]
    if kind == "submit":
        if job is not None and not job["gone"]:
            return None
        jobs[r["job_id"]] = dict.fromkeys(NAMES) | {"id": r["job_id"], "batch_id": r["batch_id"], "status": "queued", "attempt": 0, "done": 0, "total": 0, "created_at": at, "seq": r["number"], "gone": False}
        heappush(queue, place_of(jobs[r["job_id"]]))
        return r["job_id"]
    if kind == "recover":
        expired = [j for j in jobs.values() if j["status"] == "running" and not j["gone"] and (j["lease_until"] is None or j["lease_until"] <= at)]
        for j in expired:
            j |= {"status": "queued", **FREE}
            heappush(queue, place_of(j))
        return None
    if job is None or job["gone"]:
        return None
    running = job["status"] == "running"
    if kind == "beat" and running and job["lease_owner"] == r["worker"]:
        job |= {"lease_until": at + timedelta(seconds=max(1, r["seconds"] or 0))}
    elif kind == "progress" and running:
        job |= {"done": r["done"], "total": r["total"]}
    elif kind == "finish" and running:
        job |= {"status": r["status"], "finished_at": at, **FREE}
    elif kind == "cancel" and job["status"] in ("queued", "running"):
        job |= {"status": "cancelled", "finished_at": at, **FREE}
    elif kind == "delete" and not running:
        job |= {"gone": True}
    else:
        return None
    return job["id"]


def folded(jobs: dict[int, dict], requests: Iterable[dict]) -> Iterator[tuple[int, str, int | None, bool]]:
    """An ANSWER to each request, carried out in order of their numbers; jobs change in place."""
    queue = [place_of(j) for j in jobs.values() if j["status"] == "queued"]
    heapify(queue)
    for r in sorted(requests, key=lambda r: r["number"]):
        job = granted(jobs, queue, r)
        yield r["number"], r["kind"], job if job is not None else r["job_id"], job is not None


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `rank`, from 1 in that order of rows that differ in it: within ranges of rows, after the counts of the ranges before."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = stored(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    # a row for each range
    counts = own.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return own.join(F.broadcast(before), "_part").withColumn("rank", place + F.col("_before")).drop("_part", "_before")


def carried(pool: DataFrame, requests: DataFrame, groups: int) -> DataFrame:
    """(row, answer) of requests that are carried out on jobs of the pool, in turn within each of so many groups of jobs."""
    schema = T.StructType([T.StructField("row", T._parse_datatype_string(ROW)), T.StructField("answer", T._parse_datatype_string(ANSWER))])
    types = to_arrow_schema(schema)

    def fold(own: pa.Table, asked: pa.Table) -> pa.Table:
        known = {j["id"]: j | {"gone": False} for j in own.select(NAMES).to_pylist()}
        before = {i: dict(j) for i, j in known.items()}
        answers = list(folded(known, asked.to_pylist()))
        rows = [{"row": j, "answer": None} for i, j in known.items() if j != before.get(i)]
        rows += [{"row": None, "answer": dict(zip(types.field("answer").type.names, a, strict=True))} for a in answers]
        return pa.Table.from_pylist(rows, schema=types)

    group = lambda key: F.pmod(F.xxhash64(key), F.lit(groups)).alias("_group")
    both = pool.select(*NAMES, group("id")).groupBy("_group").cogroup(requests.select("*", group("job_id")).groupBy("_group"))
    return stored(both.applyInArrow(fold, schema))


#: Requests on jobs that they name, in one group that a task carries out in turn.
GROUP = 10_000


def queue_place(at: Column, seq: Column, job: Column) -> Column:
    """place_of() as a column."""
    return F.struct(F.unix_micros(at).alias("at"), seq.cast("long").alias("seq"), job.cast("long").alias("id"))


def apart(jobs: DataFrame, live: DataFrame, requests: DataFrame, sizes: dict) -> tuple[DataFrame, DataFrame] | None:
    """What turned() gives, by joins: claims take the queue by rank, and other requests are carried out job by job.

    None where requests do depend on each other: where a recovery comes after another
    request, or where the claims may reach a job that the batch names.
    """
    c = F.col
    recovery, claims, named = (sizes.get(k) for k in ("recover", "claim", "named"))
    if recovery and any(x and x.first <= recovery.last for x in (claims, named)):
        return None
    expired = is_expired(F.lit(recovery.at)) if recovery else F.lit(False)
    freed = {"status": F.when(expired, "queued").otherwise(c("status")), **{x: F.when(~expired, c(x)) for x in FREE}, "_freed": expired}
    live = live.withColumns(freed)
    queue = live.where("status = 'queued'")
    rows, answers = live.where("_freed"), requests.where("kind = 'recover'").select("number", "kind", "job_id", F.lit(False).alias("granted"))
    found = []
    if named:
        asked = requests.where(~c("kind").isin("claim", "recover"))
        ids = stored(asked.select(c("job_id").alias("id")).distinct())
        own = stored(jobs.join(ids, "id", "left_semi").withColumns(freed))
        queue = queue.join(ids, "id", "left_anti")
        waiting = own.where("status = 'queued'").select(queue_place(c("created_at"), c("seq"), c("id")).alias("p"))
        waiting = waiting.unionByName(asked.where("kind = 'submit'").select(queue_place(c("at"), c("number"), c("job_id")).alias("p")))
        first = waiting.agg(F.min("p")).first()[0]
        if claims and first:
            queue = queue.where(queue_place(c("created_at"), c("seq"), c("id")) < F.struct(*(F.lit(first[n]).cast("long").alias(n) for n in ("at", "seq", "id"))))
            if queue.count() < claims.n:
                return None
        result = carried(own, asked, 1 + named.n // GROUP)
        found.append(result.where("row is not null").select("row.*"))
        answers = answers.unionByName(result.where("answer is not null").select("answer.*"))
    if claims:
        asked = ranked(requests.where("kind = 'claim'").select("number", "at", "worker", "seconds", c("job_id").alias("_named")), "number")
        both = stored(asked.join(ranked(queue.drop("_freed"), "created_at", "seq", "id"), "rank", "left"))
        lease = F.greatest(F.lit(1), F.coalesce("seconds", F.lit(0))) * 1_000_000
        taken = {"status": F.lit("running"), "attempt": (c("attempt") + 1).cast("int"), "started_at": F.coalesce("started_at", "at"), "lease_owner": c("worker"), "lease_until": F.timestamp_micros(F.unix_micros("at") + lease), "gone": F.lit(False)}
        found.append(both.where("id is not null").withColumns(taken).select(*NAMES, "gone"))
        answers = answers.unionByName(both.select("number", F.lit("claim").alias("kind"), F.coalesce("id", "_named").alias("job_id"), c("id").isNotNull().alias("granted")))
    rows = rows.withColumn("gone", F.lit(False)).select(*NAMES, "gone")
    for more in found:
        rows = rows.join(more.select("id"), "id", "left_anti").select(*NAMES, "gone").unionByName(more)
    return rows, answers


def turned(jobs: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed rows of jobs, answers) of a batch of requests.

    Where requests depend on those before them in ways that apart() can't cut, one task takes them in turn, and
    with them only the jobs that they may touch: those they name, and as many
    as there are requests of the oldest queued jobs, and of the oldest whose lease
    has run out at each recovery. All other expired jobs are queued again by a rule.
    """
    kind = F.when(F.col("kind").isin("claim", "recover"), F.col("kind")).otherwise("named").alias("kind")
    sizes = {r.kind: r for r in requests.groupBy(kind).agg(F.count("*").alias("n"), F.min("number").alias("first"), F.max("number").alias("last"), F.max("at").alias("at")).collect()}
    live = stored(jobs.where("status in ('queued', 'running')"))
    found = apart(jobs, live, requests, sizes)
    if found:
        return found
    few = sum(r.n for r in sizes.values())
    times = [r.at for r in requests.where("kind = 'recover'").select("at").distinct().collect()]
    oldest = lambda rows: rows.orderBy("created_at", "seq").limit(few)
    pool = jobs.join(requests.select(F.col("job_id").alias("id")).where("id is not null").distinct(), "id", "left_semi")
    for rows in (live.where("status = 'queued'"), *(live.where(is_expired(F.lit(t))) for t in times)):
        pool = pool.unionByName(oldest(rows))
    pool = stored(pool.dropDuplicates(["id"]))
    result = carried(pool, requests, 1)
    changed = result.where("row is not null").select("row.*")
    if times:
        rest = live.where(is_expired(F.lit(max(times)))).join(pool.select("id"), "id", "left_anti")
        free = {"status": F.lit("queued"), "lease_owner": F.lit(None).cast("string"), "lease_until": F.lit(None).cast("timestamp"), "gone": F.lit(False)}
        changed = changed.unionByName(rest.withColumns(free))
    return changed, result.where("answer is not null").select("answer.*")


def versions(path: str) -> list[int]:
    """Numbers of the whole version folders below a path."""
    store, name = at_path(path)
    found = store.get_file_info(fs.FileSelector(name, allow_not_found=True))
    whole = [f.base_name.partition("=")[2] for f in found if f.base_name.startswith("version=") and store.get_file_info(f"{f.path}/_SUCCESS").type == fs.FileType.File]
    return sorted(map(int, whole))


def newest(spark: SparkSession, path: str, key: str, schema: str, below: int | None = None) -> DataFrame:
    """The newest row of each key in the versions below one, those that are gone left out."""
    chosen, whole = ([v for v in versions(p) if below is None or v < below] for p in (path, f"{path}.whole"))
    since = [f"{path}/version={v}" for v in chosen if not whole or v > whole[-1]]
    rows = spark.createDataFrame([], f"{schema}, version long")
    for base, folders in ((path, since), (f"{path}.whole", [f"{path}.whole/version={v}" for v in whole[-1:]])):
        if folders:
            rows = rows.unionByName(spark.read.schema(f"{schema}, version long").option("basePath", base).parquet(*folders))
    rest = [c for c in rows.columns if c not in (key, "version")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "version").alias("r")).where("not r.gone")
    return last.select(key, *[f"r.{c}" for c in rest if c != "gone"])


def put(rows: DataFrame, path: str, version: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/version={version}")


def seeded(jobs: DataFrame, store: str) -> None:
    """The store's first version, from a table of jobs, with the roll-ups of their batches."""
    put(jobs.select(*NAMES).withColumn("gone", F.lit(False)), f"{store}/jobs", -1)
    put(rolled(jobs, F.max("finished_at")), f"{store}/batches", -1)


def compacted(spark: SparkSession, store: str, version: int) -> None:
    """Whole tables as of a version, beside its changes, so that reading need not go back further."""
    for name, key, schema in (("jobs", "id", ROW), ("batches", "batch_id", BATCH)):
        put(newest(spark, f"{store}/{name}", key, schema, version + 1).withColumn("gone", F.lit(False)), f"{store}/{name}.whole", version)


def rolled(jobs: DataFrame, over: Column) -> DataFrame:
    """BATCH rows of all batches that jobs name; `over` is when one that is over came to its end."""
    out = jobs.where("batch_id is not null").groupBy("batch_id").agg(batch_status(F.col("status")).alias("status"), F.count("*").alias("jobs"), F.min("started_at").alias("started_at"), over.alias("over"))
    ended = ~F.col("status").isin("queued", "running")
    return out.select("batch_id", "status", "jobs", "started_at", F.when(ended, F.col("over")).alias("completed_at"), F.lit(False).alias("gone"))


def resynced(batches: DataFrame, jobs: DataFrame, touched: DataFrame, now: Column) -> DataFrame:
    """BATCH rows of the touched batches (batch_id): their counts, statuses and times, and those without jobs as gone.

    Only jobs of touched batches are rolled up. A batch that was over keeps its time.
    """
    own = rolled(jobs.join(touched, "batch_id", "left_semi"), now).withColumnsRenamed({"completed_at": "_over", "started_at": "_started"})
    before = batches.join(touched, "batch_id", "left_semi").select("batch_id", F.col("completed_at").alias("_was"), F.col("started_at").alias("_first"))
    both = touched.join(own, "batch_id", "left").join(before, "batch_id", "left")
    gone = F.col("jobs").isNull()
    completed = F.when(F.col("_over").isNotNull(), F.coalesce("_was", "_over"))
    return both.select("batch_id", "status", F.coalesce("jobs", F.lit(0)).alias("jobs"), F.coalesce("_first", "_started").alias("started_at"), completed.alias("completed_at"), gone.alias("gone"))


def serving(store: str, compact_every: int = 100) -> Callable[[DataFrame, int], None]:
    """What the single writer does with a batch of requests: version `number` of jobs, answers and batches.

    Versions are whole once written, so readers see a batch's requests all or
    not at all; answers come last, when everything that they tell of is there.
    """

    def each(requests: DataFrame, number: int) -> None:
        spark = requests.sparkSession
        before = newest(spark, f"{store}/jobs", "id", ROW, number)
        changed, answers = turned(before, requests)
        put(changed, f"{store}/jobs", number)
        changed = spark.read.schema(ROW).parquet(f"{store}/jobs/version={number}")
        # the batches of the rows that changed; a deleted row keeps the one it had
        touched = stored(changed.where("batch_id is not null").select("batch_id").distinct())
        jobs = newest(spark, f"{store}/jobs", "id", ROW, number + 1)
        now = F.lit(requests.agg(F.max("at")).first()[0]).cast("timestamp")
        put(resynced(newest(spark, f"{store}/batches", "batch_id", BATCH, number), jobs, touched, now), f"{store}/batches", number)
        put(answers, f"{store}/answers", number)
        if number % compact_every == compact_every - 1:
            compacted(spark, store, number)

    return each


def current(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """(jobs, batches) as of the last version that has been answered."""
    answered = versions(f"{store}/answers")
    below = answered[-1] + 1 if answered else 0
    return newest(spark, f"{store}/jobs", "id", ROW, below), newest(spark, f"{store}/batches", "batch_id", BATCH, below)
