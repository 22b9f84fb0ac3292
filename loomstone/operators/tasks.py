"""The task queue as a table: each operator returns the rows it concerns, or the next state of all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ingest import assign_ids

ACTIVE = ("PENDING", "RUNNING")
MAX_ERROR, MAX_ATTEMPTS = 2000, 3


def stats(tasks: DataFrame) -> DataFrame:
    """One row: pending, running, success, failed and total."""
    one = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0)).alias(s.lower())
    return tasks.agg(*[one(s) for s in ("PENDING", "RUNNING", "SUCCESS", "FAILED")], F.count(F.lit(1)).alias("total"))


def enqueue(tasks: DataFrame, files: DataFrame, priority: int = 1) -> DataFrame:
    """Files to be queued: documents and images still without results and without an active task."""
    wanted = files.where(F.col("file_type").isin("doc", "image") & (F.col("status") == "METADATA_ONLY") & (F.col("is_deleted") == 0))
    busy = tasks.where(F.col("status").isin(*ACTIVE)).select("file_id")
    return wanted.join(busy, "file_id", "left_anti").select("file_id", F.lit(priority).alias("priority"), F.lit("PENDING").alias("status"))


def queue(tasks: DataFrame, fresh: DataFrame, now: int) -> DataFrame:
    """tasks with new ones for the files in fresh (file_id, priority), but for those that have an active one."""
    busy = tasks.where(F.col("status").isin(*ACTIVE)).select("file_id")
    new = fresh.groupBy("file_id").agg(F.min("priority").alias("priority")).join(busy, "file_id", "left_anti")
    none = lambda c: F.lit(None).cast(dict(tasks.dtypes)[c])
    given = {"file_id": F.col("file_id"), "priority": F.col("priority").cast(dict(tasks.dtypes)["priority"]), "status": F.lit("PENDING"), "attempt": F.lit(0), "max_attempts": F.lit(MAX_ATTEMPTS), "updated_at": F.lit(now), "task_type": F.lit("index_file")}
    new = new.select(*[(given[c].cast(dict(tasks.dtypes)[c]) if c in given else none(c)).alias(c) for c in tasks.columns])
    return assign_ids(tasks.unionByName(new), "task_id", "file_id")


def claim(tasks: DataFrame, limit: int = 8) -> DataFrame:
    """The next pending tasks, now running, with an attempt more."""
    due = tasks.where("status = 'PENDING'").orderBy("priority", "task_id").limit(limit)
    return due.withColumns({"status": F.lit("RUNNING"), "attempt": F.col("attempt") + 1})


def _states(files: DataFrame, told: DataFrame) -> DataFrame:
    """files with the status told (file_id, _status)."""
    return files.join(told, "file_id", "left").withColumn("status", F.coalesce("_status", "status")).select(files.columns)


def claimed(tasks: DataFrame, files: DataFrame, now: int, limit: int = 8) -> tuple[DataFrame, DataFrame]:
    """The next state of tasks and files once a batch is claimed: its tasks run, its files are PROCESSING."""
    # At most limit rows, so they can go to every task.
    due = F.broadcast(claim(tasks, limit).select("task_id", F.lit(True).alias("_due")))
    marked = tasks.join(due, "task_id", "left")
    mine = F.col("_due").isNotNull()
    state = {"status": F.when(mine, "RUNNING").otherwise(F.col("status")), "attempt": F.col("attempt") + F.when(mine, 1).otherwise(0), "updated_at": F.when(mine, F.lit(now)).otherwise(F.col("updated_at"))}
    after = marked.withColumns({k: v.cast(dict(tasks.dtypes)[k]) for k, v in state.items()}).select(tasks.columns)
    own = marked.where(mine).select("file_id").distinct().withColumn("_status", F.lit("PROCESSING"))
    return after, _states(files, own)


def with_files(tasks: DataFrame, files: DataFrame, wanted: DataFrame) -> DataFrame:
    """What a worker needs of the wanted task_ids; a task whose file is gone isn't among them."""
    return tasks.join(wanted.select("task_id"), "task_id", "left_semi").join(files, "file_id").select("task_id", "file_id", "path", "file_type")


def finish(tasks: DataFrame, done: DataFrame, now: int | None = None) -> DataFrame:
    """done (task_id, error or null): tasks end as SUCCESS or FAILED, errors cut to MAX_ERROR characters. A success
    leaves the last error as it was, and other tasks stay as they are. now: when, where tasks have updated_at."""
    ends = done.select("task_id", F.lit(True).alias("_end"), F.substring("error", 1, MAX_ERROR).alias("_error"))
    if "last_error" not in tasks.columns:
        tasks = tasks.withColumn("last_error", F.lit(None).cast("string"))
    state = F.when(F.col("_end").isNull(), F.col("status")).when(F.col("_error").isNull(), "SUCCESS").otherwise("FAILED")
    out = tasks.join(ends, "task_id", "left").withColumns({"status": state, "last_error": F.coalesce("_error", "last_error")})
    if now is not None:
        out = out.withColumn("updated_at", F.when(F.col("_end"), F.lit(now)).otherwise(F.col("updated_at")).cast(dict(tasks.dtypes)["updated_at"]))
    return out.select(tasks.columns)


def finish_files(files: DataFrame, tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Files after their tasks have ended: AI_DONE, or FAILED; of several tasks of a file the last one counts."""
    own = tasks.select("task_id", "file_id").join(done, "task_id")
    said = own.groupBy("file_id").agg(F.max_by(F.when(F.col("error").isNull(), "AI_DONE").otherwise("FAILED"), "task_id").alias("_status"))
    return _states(files, said)


def recover(tasks: DataFrame) -> DataFrame:
    """Running tasks are pending again."""
    return tasks.withColumn("status", F.when(F.col("status") == "RUNNING", "PENDING").otherwise(F.col("status")))


def failed(tasks: DataFrame, files: DataFrame, k: int = 50) -> DataFrame:
    rows = tasks.where("status = 'FAILED'").orderBy(F.desc("updated_at"), "task_id").limit(k)
    return rows.join(files.select("file_id", "filename"), "file_id", "left").select("task_id", "file_id", F.coalesce("filename", F.lit("<deleted>")).alias("filename"), "attempt", "updated_at")


def retry(tasks: DataFrame, wanted: DataFrame) -> DataFrame:
    """What a retry of each wanted task_id comes to; the order of the checks matters."""
    rows = wanted.select("task_id").join(tasks.select("task_id", "status", "attempt", "max_attempts"), "task_id", "left")
    said = F.when(F.col("status").isNull(), "NOT_FOUND").when(F.col("attempt") >= F.col("max_attempts"), "MAX_ATTEMPTS").when(F.col("status") != "FAILED", "NOT_FAILED").otherwise("RETRIED")
    return rows.select("task_id", said.alias("result"))


def retried(tasks: DataFrame, wanted: DataFrame, now: int) -> DataFrame:
    """tasks after the retries that come to RETRIED: these are pending again."""
    own = retry(tasks, wanted).where("result = 'RETRIED'").select("task_id", F.lit(True).alias("_again")).distinct()
    out = tasks.join(own, "task_id", "left")
    return out.withColumns({"status": F.when(F.col("_again"), "PENDING").otherwise(F.col("status")), "updated_at": F.when(F.col("_again"), F.lit(now)).otherwise(F.col("updated_at")).cast(dict(tasks.dtypes)["updated_at"])}).select(tasks.columns)


def reindex(tasks: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted task_id: NOT_FOUND, ALREADY_ACTIVE if its file has an active task, or QUEUED."""
    rows = wanted.select("task_id").join(tasks.select("task_id", "file_id"), "task_id", "left")
    busy = tasks.where(F.col("status").isin(*ACTIVE)).select("file_id").distinct().withColumn("_busy", F.lit(True))
    said = F.when(F.col("file_id").isNull(), "NOT_FOUND").when(F.col("_busy"), "ALREADY_ACTIVE").otherwise("QUEUED")
    return rows.join(busy, "file_id", "left").select("task_id", "file_id", said.alias("result"))


def reindexed(tasks: DataFrame, wanted: DataFrame, now: int) -> DataFrame:
    """tasks with a new one, of the highest priority, for each file that reindex queues; old tasks stay."""
    return queue(tasks, reindex(tasks, wanted).where("result = 'QUEUED'").select("file_id", F.lit(0).alias("priority")), now)


def last_per_file(tasks: DataFrame) -> DataFrame:
    """The latest task of each file."""
    return tasks.groupBy("file_id").agg(F.max(F.struct("updated_at", "task_id", "status")).alias("m")).select("file_id", "m.task_id", "m.status", "m.updated_at")
