"""The job store as tables: latest jobs, roll-ups, claims, leases, edits, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: States of a job, fixed values.
STATES = ("pending", "queued", "running", "completed", "completed_with_warnings", "failed", "cancelled")
TERMINAL = ("completed", "completed_with_warnings", "completed_with_errors", "failed", "cancelled")


def latest(jobs: DataFrame, key: str, time: str = "created_at", seq: str = "seq") -> DataFrame:
    """The newest job of each key, later arrivals before earlier ones of the same time; one aggregate, no sort."""
    rest = [c for c in jobs.columns if c != key]
    best = jobs.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(time, seq)).alias("_job"))
    return best.select(key, "_job.*")


def with_latest(documents: DataFrame, jobs: DataFrame, key: str, columns: list[str], **order: str) -> DataFrame:
    """documents with columns of their newest job, null where there is none."""
    return documents.join(latest(jobs, key, **order).select(key, *columns), key, "left")


def document_status(documents: DataFrame, jobs: DataFrame, key: str, **order: str) -> DataFrame:
    return with_latest(documents, jobs, key, ["status"], **order).withColumn("status", F.coalesce("status", F.lit("pending")))


def page_of(df: DataFrame, order: list[Column], limit: int, offset: int, most: int = 500) -> DataFrame:
    """A page of a list: limit clamped to 1 to `most`, offset to 0 or more."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(most, max(1, limit)))


def created(submissions: DataFrame, now: Column) -> DataFrame:
    """Rows for the job table from submissions: queued, with no attempt, no lease and no result yet."""
    none = lambda kind: F.lit(None).cast(kind)
    start = {"status": F.lit("queued"), "stage": F.lit("queued"), "attempt": F.lit(0), "done": F.lit(0), "total": F.lit(0), "created_at": now, "updated_at": now}
    return submissions.withColumns(start | {"started_at": none("timestamp"), "finished_at": none("timestamp"), "lease_owner": none("string"), "lease_until": none("timestamp"), "result_path": none("string"), "error": none("string")})


def listed(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """The newest jobs, 1 to 100 of them, later arrivals first among equals."""
    return page_of(jobs, [F.col("created_at").desc(), F.col("seq").desc()], limit, 0, 100)


def public(rows: DataFrame, names: dict[str, str], result_url: Column | None = None) -> DataFrame:
    """What users may see of jobs, documents or batches: columns by their public names, in that order, and a link where there is a result."""
    shown = rows.select(*[F.col(c).alias(n) for c, n in names.items()], *([] if result_url is None else [F.when(F.col("result_path").isNotNull(), result_url).alias("result_url")]))
    return shown


def has_more(total: Column, offset: int, size: int) -> Column:
    return F.lit(offset + size) < total


def counts_by(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """(column, n) for each of the values, zeros included, and for 'total'."""
    spine = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    out = spine.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))
    return out.unionByName(df.agg(F.lit("total").alias(column), F.count("*").alias("n")).select(column, "n"))


def batch_status(status: Column) -> Column:
    """Status of a batch, as an aggregate over its jobs' statuses."""
    done = status.isin("completed", "completed_with_warnings")
    waiting = F.bool_or(status == "queued")
    return (
        F.when(F.bool_or(status == "running"), "running")
        .when(waiting & F.bool_or(status != "queued"), "running")
        .when(waiting, "queued")
        .when(F.bool_and(done), F.when(F.bool_or(status == "completed_with_warnings"), "completed_with_warnings").otherwise("completed"))
        .when(F.bool_and(status == "cancelled"), "cancelled")
        .when(F.bool_and(status == "failed"), "failed")
        .otherwise("completed_with_errors")
    )


def batches(jobs: DataFrame, key: str, now: Column) -> DataFrame:
    """(key, status, jobs, completed_at) of each batch; completed_at only once it is over."""
    out = jobs.groupBy(key).agg(batch_status(F.col("status")).alias("status"), F.count("*").alias("jobs"))
    return out.withColumn("completed_at", F.when(F.col("status").isin(*TERMINAL), now))


def snapshot(documents: DataFrame, defaults: str, batch_id: str) -> DataFrame:
    """New queued jobs for all pending documents, with their own settings or else the defaults."""
    return documents.where("status = 'pending'").select("document_id", F.lit(batch_id).alias("batch_id"), F.lit("queued").alias("status"), F.coalesce("settings_json", F.lit(defaults)).alias("settings_json"), F.lit(0).alias("attempt"))


def batch_detail(jobs: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """(key, jobs): each batch's jobs as an ordered array."""
    return jobs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *columns))).alias("jobs"))


def claimed(jobs: DataFrame, worker: str, now: Column, lease_seconds: int) -> DataFrame:
    """The oldest queued job as a running one, leased to the worker."""
    until = now + F.make_dt_interval(secs=F.lit(max(1, lease_seconds)))
    one = jobs.where("status = 'queued'").orderBy("created_at", "seq").limit(1)
    return one.withColumns({"status": F.lit("running"), "attempt": F.col("attempt") + 1, "lease_owner": F.lit(worker), "lease_until": until, "started_at": F.coalesce("started_at", now)})


def changed(jobs: DataFrame, when: Column, to: dict[str, Column]) -> DataFrame:
    """jobs with columns replaced in the rows where the condition holds."""
    return jobs.withColumns({c: F.when(when, v).otherwise(F.col(c)) for c, v in to.items()})


def beaten(jobs: DataFrame, job: str, worker: str, until: Column) -> DataFrame:
    """A heartbeat: only the owner of a running job's lease prolongs it."""
    return changed(jobs, (F.col("id") == job) & (F.col("status") == "running") & (F.col("lease_owner") == worker), {"lease_until": until})


def progressed(jobs: DataFrame, job: str, done: int, total: int) -> DataFrame:
    return changed(jobs, (F.col("id") == job) & (F.col("status") == "running"), {"done": F.lit(done), "total": F.lit(total)})


def finished(jobs: DataFrame, job: str, status: str, now: Column) -> DataFrame:
    """A running job's end; its lease goes."""
    return changed(jobs, (F.col("id") == job) & (F.col("status") == "running"), {"status": F.lit(status), "finished_at": now, "lease_owner": F.lit(None), "lease_until": F.lit(None)})


def cancelled(jobs: DataFrame, ids: list[str], now: Column) -> DataFrame:
    return changed(jobs, F.col("id").isin(*ids) & F.col("status").isin("queued", "running"), {"status": F.lit("cancelled"), "finished_at": now, "lease_owner": F.lit(None), "lease_until": F.lit(None)})


def is_expired(now: Column) -> Column:
    return (F.col("status") == "running") & (F.col("lease_until").isNull() | (F.col("lease_until") <= now))


def recovered(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs whose lease ran out are queued again."""
    return changed(jobs, is_expired(now), {"status": F.lit("queued"), "lease_owner": F.lit(None), "lease_until": F.lit(None)})


def deleted(jobs: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Jobs without those of the given ids, unless they are running."""
    gone = jobs.where("status <> 'running'").select(key).join(ids.select(key), key, "left_semi")
    return jobs.join(gone, key, "left_anti")


def settings_edits(jobs: DataFrame, edits: DataFrame, key: str = "id") -> DataFrame:
    """jobs with new settings_json from edits (key, settings); nothing changes if any edit is to a job that was tried or isn't there."""
    bad = edits.join(jobs.where("attempt = 0").select(key), key, "left_anti").agg((F.count("*") > 0).alias("_bad"))
    out = jobs.join(edits.withColumnRenamed("settings", "_new"), key, "left").crossJoin(F.broadcast(bad))
    return out.withColumn("settings_json", F.when(~F.col("_bad"), F.coalesce("_new", "settings_json")).otherwise(F.col("settings_json"))).drop("_new", "_bad")


def twice_active(jobs: DataFrame, key: str) -> DataFrame:
    """(key, active): keys with more than one queued or running job."""
    return jobs.where(F.col("status").isin("queued", "running")).groupBy(key).agg(F.count("*").alias("active")).where("active > 1")


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows that name a parent which isn't there."""
    return rows.where(F.col(key).isNotNull()).join(parents.select(key).distinct(), key, "left_anti")


def schema_version(migrations: DataFrame, known: int) -> DataFrame:
    """(version, pending, unknown) of a migrations table."""
    v = F.coalesce(F.max("version"), F.lit(0))
    return migrations.agg(v.alias("version"), F.greatest(F.lit(0), F.lit(known) - v).alias("pending"), (v > known).alias("unknown"))


def active_jobs(tables: list[DataFrame]) -> DataFrame:
    """Queued and running jobs over several stores."""
    out = tables[0].select("status")
    for t in tables[1:]:
        out = out.union(t.select("status"))
    return out.where(F.col("status").isin("queued", "running")).agg(F.count("*").alias("active"))


def upload_errors(files: DataFrame, request: str | None = None, most_files: int = 100, most_bytes: int = 50 << 20) -> DataFrame:
    """(name, error) of uploads (name, length, head) that are refused; head is the first 1024 bytes. All files are one request, or those with equal `request`."""
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]+)\z", 1))
    error = F.when(~suffix.isin(".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp"), "type").when(F.col("length") == 0, "empty").when(F.col("length") > most_bytes, "too large").when((suffix == ".pdf") & (F.instr(F.col("head").cast("string"), "%PDF-") == 0), "no PDF")
    if request is None:
        counted = files.crossJoin(F.broadcast(files.agg((F.count("*") > most_files).alias("_many"))))
    else:
        counted = files.join(files.groupBy(request).agg((F.count("*") > most_files).alias("_many")), request)
    return counted.select("name", F.when(F.col("_many"), "too many files").otherwise(error).alias("error")).where("error is not null")
