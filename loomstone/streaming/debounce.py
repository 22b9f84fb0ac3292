"""Change events as a stream: quiet ends a batch, and a batch is coalesced by path.

The watermark is ours: the batch form has none. Events later than it are dropped by the stream; they
would start a batch of their own otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.events import coalesce_kinds, replay


def read_changes(spark: SparkSession, folder: str, schema: StructType, max_files: int = 100) -> DataFrame:
    """An event log that grows by files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def debounced(events: DataFrame, gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Per path: quiet for gap closes its batch; (start, end, action, path, target). A move counts for both its paths: what
    came before it is forgotten, and it is a rename of its source. Kinds that cancel out are gone. Sessions are by path,
    so they are spread over tasks; a global timer would need one task for all events."""
    dest = F.col("dest") if "dest" in events.columns else F.lit(None).cast("string")
    move = F.col("kind") == "moved"
    mine = lambda path, kind: F.struct(path.alias("path"), F.lit(kind).alias("kind"), dest.alias("dest"))
    each = F.when(move, F.array(mine(F.col("path"), "moved"), mine(dest, "moved here"))).otherwise(F.array(F.struct(F.col("path"), F.col("kind"), dest.alias("dest"))))
    rows = events.withWatermark("ts", late).select("ts", F.explode(each).alias("e")).select("ts", "e.*")
    held = rows.groupBy(F.session_window("ts", gap).alias("w"), "path").agg(F.array_sort(F.collect_list(F.struct("ts", "kind", "dest"))).alias("log"))
    moved = lambda x: x["kind"].isin("moved", "moved here")
    last = F.array_max(F.transform(F.filter("log", moved), lambda x: x["ts"]))
    kinds = F.transform(F.filter("log", lambda x: ~moved(x) & (last.isNull() | (x["ts"] > last))), lambda x: x["kind"])
    none = F.lit(None).cast("string")
    own = F.when(F.size(kinds) > 0, coalesce_kinds(kinds))
    acts = F.concat(F.array(F.struct(own.alias("action"), none.alias("target"))), F.transform(F.filter("log", lambda x: x["kind"] == "moved"), lambda x: F.struct(F.lit("rename").alias("action"), x["dest"].alias("target"))))
    out = held.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "path", F.explode(acts).alias("a"))
    return out.select("start", "end", "a.action", "path", "a.target").where("action IS NOT NULL")


def apply_in_order(apply: Callable[[str, DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: changes, then deletions, then renames. A batch is applied again after a failure, so apply must
    be idempotent."""

    def run(batch: DataFrame, epoch: int) -> None:
        kept = batch.persist()
        for action in ("change", "delete", "rename"):
            apply(action, kept.where(F.col("action") == action), epoch)
        kept.unpersist()

    return run


def replaying(journal: DataFrame, apply: Callable[[str, DataFrame, int], None], checkpoint: str, roots: DataFrame | None = None):
    """A journal that grows by files, replayed: all records there are by now are one batch, so that both names of a rename
    meet; its actions are applied in order of step, and only then does the checkpoint, which is the cursor, move on.
    After a failure the batch comes again, so apply must be idempotent."""

    def run(batch: DataFrame, epoch: int) -> None:
        kept = replay(batch, -1, roots).persist()
        for step in (1, 2, 3, 4):
            own = kept.where(F.col("step") == step)
            for action in ("delete", "rename", "upsert", "defer"):
                apply(action, own.where(F.col("action") == action), epoch)
        kept.unpersist()

    return journal.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(once=True).start()


def start(events: DataFrame, apply: Callable[[str, DataFrame, int], None], checkpoint: str, every: str = "500 milliseconds", **kw):
    """The checkpoint holds the cursor: it moves on only after apply has ended."""
    return debounced(events, **kw).writeStream.foreachBatch(apply_in_order(apply)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
