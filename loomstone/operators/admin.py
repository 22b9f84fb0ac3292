"""Settings, scan roots, jobs, heartbeats and health: small tables, and what is told of them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.files import canonical_root, root_covers

#: Settings with what they are if nobody has set them, and what they may be.
DEFAULTS = {"search_mode": "hybrid", "w_kw": 1.0, "w_sem": 1.0, "topK": 50}
MODES, WEIGHTS, RESULTS = ("keyword", "semantic", "hybrid"), (0.1, 10.0), (1, 200)
ROOTS_KEY = "index_roots"
ROOT = "array<struct<path:string,enabled:boolean,created_at:bigint>>"
#: Seconds without a sign after which a worker counts as dead.
ALIVE = 15


# ---- settings


def put(settings: DataFrame, fresh: DataFrame) -> DataFrame:
    """settings (key, value as JSON) with the values of fresh (key, value, at) in place of theirs: the latest of a key."""
    last = fresh.groupBy("key").agg(F.max_by("value", "at").alias("value"))
    return settings.join(last.select("key"), "key", "left_anti").unionByName(last)


def checked(patch: dict) -> dict:
    """The part of patch that are settings with a value; ValueError if one is out of its range."""
    own = {k: v for k, v in patch.items() if k in DEFAULTS and v is not None}
    ranges = {"w_kw": WEIGHTS, "w_sem": WEIGHTS, "topK": RESULTS}
    for k, v in own.items():
        good = v in MODES if k == "search_mode" else isinstance(v, int | float) and not isinstance(v, bool) and ranges[k][0] <= v <= ranges[k][1] and (k != "topK" or v == int(v))
        if not good:
            raise ValueError(f"{k} can't be {v!r}")
    return own


def current(settings: DataFrame) -> dict:
    """All settings, defaults where nobody has set them."""
    found = {r["key"]: json.loads(r["value"]) for r in settings.where(F.col("key").isin(*DEFAULTS)).collect()}
    return DEFAULTS | found


def upgraded(value: Column, now: int) -> Column:
    """Roots as they are kept now, from JSON that lists them so, or their paths only, as it once was."""
    old = F.from_json(value, "array<string>")
    listed = F.transform(old, lambda p: F.struct(p.alias("path"), F.lit(True).alias("enabled"), F.lit(now).cast("bigint").alias("created_at")))
    return F.when(F.get_json_object(value, "$[0].path").isNotNull(), F.from_json(value, ROOT)).otherwise(listed)


def first_member(value: Column) -> tuple[Column, Column]:
    """Of an object in JSON, the value of its first key, and how many keys it has."""
    keys = F.json_object_keys(value)
    return F.element_at(F.from_json(value, "map<string,string>"), F.element_at(keys, 1)), F.size(keys).cast("long")


# ---- roots


def root_key(path: Column) -> Column:
    return F.lower(canonical_root(path))


def root_verdicts(roots: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each path of wanted: ROOT_ALREADY_EXISTS, ROOT_ALREADY_COVERED (one lies under the other) or ADDED. Both are
    lists that users type in."""
    a = wanted.select("path").distinct()
    b = roots.select(F.col("path").alias("root"))
    touching = root_covers(F.col("path"), F.col("root")) | root_covers(F.col("root"), F.col("path"))
    met = a.join(b, touching, "left")
    same = F.max((root_key(F.col("path")) == root_key(F.col("root"))).cast("int"))
    return met.groupBy("path").agg(F.when(same == 1, "ROOT_ALREADY_EXISTS").when(F.count("root") > 0, "ROOT_ALREADY_COVERED").otherwise("ADDED").alias("result"))


def add_roots(roots: DataFrame, wanted: DataFrame, now: int) -> DataFrame:
    good = root_verdicts(roots, wanted).where("result = 'ADDED'")
    return roots.unionByName(good.select(canonical_root(F.col("path")).alias("path"), F.lit(True).alias("enabled"), F.lit(now).cast("bigint").alias("created_at")))


def remove_roots(roots: DataFrame, gone: DataFrame) -> DataFrame:
    """roots without those of gone (path); what was indexed under them stays."""
    keys = gone.select(root_key(F.col("path")).alias("_key")).distinct()
    return roots.withColumn("_key", root_key(F.col("path"))).join(keys, "_key", "left_anti").select(roots.columns)


def toggle_roots(roots: DataFrame, told: DataFrame) -> DataFrame:
    """roots with enabled as told (path, enabled)."""
    keys = told.groupBy(root_key(F.col("path")).alias("_key")).agg(F.last("enabled").alias("_on"))
    return roots.withColumn("_key", root_key(F.col("path"))).join(keys, "_key", "left").withColumn("enabled", F.coalesce("_on", "enabled")).select(roots.columns)


def covered_counts(files: DataFrame, roots: DataFrame) -> DataFrame:
    """For each root how many files that aren't deleted lie under it. A file's folders are looked up among the roots, so
    it is a join of equal keys whatever their number."""
    own = roots.select("root", F.regexp_replace(root_key(F.col("root")), r"\\+$", "").alias("_key"))
    parts = F.split(F.regexp_replace(root_key(F.col("path")), r"\\+$", ""), r"\\")
    above = F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda i: F.array_join(F.slice("_parts", 1, i), "\\"))
    held = files.where("is_deleted = 0").select(parts.alias("_parts")).select(F.explode(above).alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
    return own.join(held, "_key", "left").select("root", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# ---- jobs


def jobs(log: DataFrame) -> DataFrame:
    """What a log of scan jobs comes to: a row for each, with the last said of each column. log: job_id, at and, in each
    row, what was said then (null for nothing): root_path, scan_type, status, scanned_files, error_count, total_files,
    cursor_path. A job that has ended has no cursor."""
    said = [c for c in log.columns if c not in ("job_id", "at", "cursor_path")]
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    rows = log.groupBy("job_id").agg(*[last(c).alias(c) for c in said], last("cursor_path").alias("cursor_path"), F.min("at").alias("started_at"), F.max(F.when(F.col("status") != "RUNNING", F.col("at"))).alias("finished_at"))
    return rows.withColumn("cursor_path", F.when(F.col("status") == "RUNNING", F.col("cursor_path")))


def recent(jobs: DataFrame, k: int = 20) -> DataFrame:
    """The last k jobs."""
    return jobs.orderBy(F.desc("job_id")).limit(k)


def running(jobs: DataFrame, k: int = 20) -> DataFrame:
    """One row: whether one of the last k jobs is running."""
    return recent(jobs, k).agg(F.coalesce(F.max(F.col("status") == "RUNNING"), F.lit(False)).alias("running"))


# ---- signs of life


def beat(heartbeats: DataFrame, signs: DataFrame) -> DataFrame:
    """heartbeats (worker_id, last_seen) after more signs."""
    return heartbeats.unionByName(signs.select(heartbeats.columns)).groupBy("worker_id").agg(F.max("last_seen").alias("last_seen"))


def alive(heartbeats: DataFrame, now: int) -> DataFrame:
    return heartbeats.select("worker_id", (F.col("last_seen") >= now - ALIVE).alias("alive"))


def health(components: DataFrame, vital: tuple[str, ...] = ("sqlite", "qdrant", "worker")) -> DataFrame:
    """components (component, ok) to one row: ok if all vital ones are, else degraded; and which aren't ok. Without its
    semantic part a system searches by keywords, so that isn't vital."""
    bad = F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("component"))))
    good = F.count_if(F.col("ok") & F.col("component").isin(*vital)) == len(vital)
    return components.agg(F.when(good, "ok").otherwise("degraded").alias("status"), bad.alias("down"))


# ---- statistics


def storage(files: DataFrame) -> DataFrame:
    """Bytes and number of the files of each type that aren't deleted."""
    return files.where("is_deleted = 0").groupBy("file_type").agg(F.sum("size_bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))


def ranks(rows: DataFrame, group: str, value: str, shares: dict[str, float], width: float) -> DataFrame:
    """Of each group n and the values at stated shares of its order (place floor(n * share)). Ranks are counted within
    ranges of width of the value, so that no task holds a whole group."""
    from pyspark.sql import Window as W

    per = rows.groupBy(group, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c")).withColumn("b", F.floor(F.col("v") / width))
    bins = per.groupBy(group, "b").agg(F.sum("c").alias("bc"))
    bins = bins.withColumn("base", F.sum("bc").over(W.partitionBy(group).orderBy("b")) - F.col("bc")).withColumn("n", F.sum("bc").over(W.partitionBy(group)))
    own = per.join(bins, [group, "b"]).withColumn("upto", F.col("base") + F.sum("c").over(W.partitionBy(group, "b").orderBy("v")))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * p)), F.col("v")))
    return own.groupBy(group).agg(F.first("n").alias("n"), *[at(p).alias(k) for k, p in shares.items()])
