"""Change events and journal records in batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.files import canonical_root

# Reason bits of journal records.
OVERWRITE, EXTEND, CREATE, DELETE, OLD_NAME, NEW_NAME = 0x1, 0x2, 0x100, 0x200, 0x1000, 0x2000


def coalesce_kinds(kinds):
    """What a set of kinds comes to: created and deleted cancel out (null), deleted wins, else change."""
    gone = F.array_contains(kinds, "deleted")
    return F.when(gone & F.array_contains(kinds, "created"), F.lit(None).cast("string")).when(gone, "delete").otherwise("change")


def ordered(events: DataFrame) -> Column:
    """A place of each event in time; event_id, where there, parts events of one instant."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return F.struct(at.alias("at"), (F.col("event_id") if "event_id" in events.columns else F.lit(0)).cast("long").alias("id"))


#: Stretches of gap whose windows are found in one task, however many events they hold.
STRETCHES = 1800


def windows(events: DataFrame, gap: float = 2.0) -> DataFrame:
    """events with `flush_start`: when the batch began that gap seconds of quiet, over all paths, ended.

    Events of one stretch of gap seconds are always in one batch, so a row for each stretch decides: a batch
    begins where a stretch's first event comes gap after the last one of any stretch before. Stretches are
    ordered within groups of STRETCHES, and over groups only one row each."""
    us = int(gap * 1_000_000)
    rows = events.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("_s", F.expr(f"_at div {us} - if(_at % {us} < 0, 1, 0)"))
    own = rows.groupBy("_s").agg(F.min("_at").alias("first"), F.max("_at").alias("last")).withColumn("_g", F.floor(F.col("_s") / STRETCHES))
    inside, over = W.partitionBy("_g").orderBy("_s"), W.orderBy("_g")
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    groups = own.groupBy("_g").agg(F.min("first").alias("g_first"), F.max("last").alias("g_last"))
    groups = groups.withColumn("g_new", F.coalesce(F.col("g_first") - F.lag("g_last").over(over) >= us, F.lit(True)))
    # Within a group, the first stretch is taken to begin no batch; whether it does is known from the groups.
    own = own.withColumn("new", F.coalesce(F.col("first") - F.lag("last").over(inside) >= us, F.lit(False))).withColumn("since", F.max(F.when(F.col("new"), F.col("first"))).over(upto))
    ends = own.groupBy("_g").agg(F.max("since").alias("g_since")).join(groups, "_g")
    # The batch that a group's last stretch belongs to, handed on to the next groups.
    begun = F.coalesce("g_since", F.when(F.col("g_new"), F.col("g_first")))
    ends = ends.withColumn("g_carry", F.last(begun, ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, -1)))
    ends = ends.select("_g", F.when(F.col("g_new"), F.col("g_first")).otherwise(F.col("g_carry")).alias("g_start"))
    starts = own.join(ends, "_g").select("_s", F.xxhash64("_s").alias("_s2"), F.timestamp_micros(F.coalesce("since", "g_start")).alias("flush_start"))
    # The further key makes Spark exchange both sides, so that it can split a very busy stretch.
    return rows.withColumn("_s2", F.xxhash64("_s")).join(starts, ["_s", "_s2"]).select(*events.columns, "flush_start")


def forget_moved(rows: DataFrame, window: str = "flush_start") -> DataFrame:
    """Of each window, events of a path that come after the last move that names it, as source or target: a move
    makes what is pending for its paths forgotten. Moves themselves are not among them."""
    at = ordered(rows)
    moves = rows.where("kind = 'moved'").select(window, at.alias("moved_at"), F.explode(F.array_distinct(F.array("path", "dest"))).alias("path"))
    last = moves.groupBy(window, "path").agg(F.max("moved_at").alias("moved_at"))
    pending = rows.where("kind <> 'moved'").withColumn("_o", at).join(last, [window, "path"], "left")
    return pending.where("moved_at IS NULL OR _o > moved_at").select(rows.columns)


def debounce(events: DataFrame, gap: float = 2.0, roots: DataFrame | None = None) -> DataFrame:
    """(flush_start, step, action, path, target): what each batch comes to, in order of step: change, delete, rename.

    Every event, moves included, puts the end of its batch off. Paths whose kinds cancel out are gone; each
    move is a rename of its own. roots: only what lies under an enabled one counts (of a move, its source)."""
    rows = windows(events, gap)
    if "dest" not in rows.columns:
        rows = rows.withColumn("dest", F.lit(None).cast("string"))
    own = forget_moved(rows).groupBy("flush_start", "path").agg(coalesce_kinds(F.collect_set("kind")).alias("action")).where("action IS NOT NULL")
    own = own.select("flush_start", F.when(F.col("action") == "change", 1).otherwise(2).alias("step"), "action", "path", F.lit(None).cast("string").alias("target"))
    moves = rows.where("kind = 'moved'").select("flush_start", F.lit(3).alias("step"), F.lit("rename").alias("action"), "path", F.col("dest").alias("target"))
    out = own.unionByName(moves)
    return covered(out, roots) if roots is not None else out


def sessions(events: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """Per path: start, end of silence, events."""
    w = F.session_window(F.col("ts").cast("timestamp"), gap)
    return events.groupBy("path", w.alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select("path", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")


def reason_class():
    """One class of a record's bits; deletion comes before names, and these before content."""
    has = lambda bit: F.col("reason").bitwiseAND(F.lit(bit)) != 0
    return F.when(has(DELETE), "delete").when(has(OLD_NAME), "old").when(has(NEW_NAME), "new").when(has(CREATE) | has(EXTEND) | has(OVERWRITE), "upsert")


def replay(journal: DataFrame, cursor: int = 0, roots: DataFrame | None = None) -> DataFrame:
    """Records after cursor, to what is done, in order of step: 1 delete, 2 rename (or what an old name alone comes
    to), 3 upsert, 4 upsert of what was renamed into a root.

    A record without a path is one whose path couldn't be found out. An old name whose new one is such a record is
    deferred: the file may be living, and a scan settles it. An old name alone has left the roots and is deleted. A
    new name alone is a new file. A rename to the same path is nothing, and a rename takes the place of the same
    file's deletion and changes. roots: records outside the enabled ones don't count."""
    after = journal.where(F.col("usn") > cursor)
    lost = after.where(F.col("path").isNull() & (F.col("reason").bitwiseAND(F.lit(NEW_NAME)) != 0)).select("file_ref").distinct().withColumn("lost", F.lit(True))
    own = after.where(F.col("path").isNotNull()).withColumn("class", reason_class()).where("class IS NOT NULL")
    if roots is not None:
        own = covered(own, roots)
    wide = own.groupBy("file_ref").pivot("class", ["delete", "old", "new", "upsert"]).agg(F.max_by("path", "usn")).join(lost, "file_ref", "left")
    old, new = F.col("old"), F.col("new")
    told = lambda step, action, path, target=None: F.struct(F.lit(step).alias("step"), F.lit(action).alias("action"), F.col(path).alias("path"), (F.col(target) if target else F.lit(None).cast("string")).alias("target"))
    renamed = old.isNotNull() & new.isNotNull()
    rows = F.array(
        F.when(F.col("delete").isNotNull() & ~renamed, told(1, "delete", "delete")),
        F.when(renamed & (old != new), told(2, "rename", "old", "new")),
        F.when(old.isNotNull() & new.isNull(), F.when(F.col("lost"), told(2, "defer", "old")).otherwise(told(2, "delete", "old"))),
        F.when(F.col("upsert").isNotNull() & ~renamed, told(3, "upsert", "upsert")),
        F.when(old.isNull() & new.isNotNull(), told(4, "upsert", "new")),
    )
    return wide.select("file_ref", F.explode(F.array_compact(rows)).alias("r")).select("file_ref", "r.*")


def name_pairs(journal: DataFrame) -> DataFrame:
    """(file_ref, old_path, new_path): the last old and the last new name of each file that has either."""
    own = journal.where(F.col("path").isNotNull() & reason_class().isin("old", "new")).withColumn("class", reason_class())
    last = lambda k: F.max_by(F.when(F.col("class") == k, F.col("path")), F.when(F.col("class") == k, F.col("usn")))
    return own.groupBy("file_ref").agg(last("old").alias("old_path"), last("new").alias("new_path"))


def rotated(state: DataFrame, cursors: DataFrame) -> DataFrame:
    """Per volume: first_run, rescan (another journal, or the cursor is too old) or replay."""
    both = state.join(cursors.withColumnsRenamed({"journal_id": "c_journal", "usn": "c_usn"}), "volume", "left")
    said = F.when(F.col("c_journal").isNull(), "first_run").when((F.col("c_journal") != F.col("journal_id")) | (F.col("c_usn") < F.col("lowest_valid_usn")), "rescan").otherwise("replay")
    return both.select("volume", said.alias("action"), F.when(said == "replay", F.col("c_usn")).otherwise(F.col("next_usn")).alias("start_usn"))


def resolve_paths(dirs: DataFrame, depth: int = 64) -> DataFrame:
    """(ref, parent, name) to (ref, path), roots being refs that are their own parent or have none listed. Each
    round doubles the known part of every chain, so depth takes log2(depth) joins; cycles never end, and go."""
    top = dirs.join(dirs.select(F.col("ref").alias("parent"), F.lit(1).alias("_p")), "parent", "left")
    done = F.col("_p").isNull() | (F.col("parent") == F.col("ref"))
    paths = top.select("ref", F.when(done, F.lit(None)).otherwise(F.col("parent")).alias("up"), F.col("name").alias("path"))
    n = 1
    while n < depth:
        above = paths.select(F.col("ref").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        paths = paths.join(above, "up", "left").select("ref", F.col("up2").alias("up"), F.concat_ws("/", "path2", "path").alias("path"))
        n *= 2
    return paths.where("up IS NULL").select("ref", "path")


#: Characters of all roots up to which they are sent to every task; more of them go by the folders of the paths.
ROOTS_BYTES = 8 << 20


def covered(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows whose path is, or lies under, an enabled root, in any case of letters and kind of slash. Roots are settings
    that users type in, so they are few; how many is measured."""
    on = roots.where("enabled").select(F.regexp_replace(F.lower(canonical_root(F.col("root"))), r"\\+$", "").alias("_root")).distinct()
    key = F.regexp_replace(F.lower(canonical_root(F.col("path"))), r"\\+$", "")
    if on.agg(F.coalesce(F.sum(F.length("_root") + 1), F.lit(0))).head()[0] <= ROOTS_BYTES:
        return rows.withColumn("_key", key).join(F.broadcast(on), (F.col("_key") == F.col("_root")) | F.col("_key").startswith(F.concat("_root", F.lit("\\"))), "left_semi").drop("_key")
    # Every folder above a path, and the path itself, may be a root: an equality join instead of one of ranges.
    keyed = rows.select(F.struct(*rows.columns).alias("_row"), F.monotonically_increasing_id().alias("_n"), F.split(key, r"\\").alias("_parts"))
    above = keyed.select("_n", "_row", F.explode(F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda i: F.array_join(F.slice("_parts", 1, i), "\\"))).alias("_root"))
    return above.join(on, "_root", "left_semi").dropDuplicates(["_n"]).select("_row.*")


def fallback(outcomes: DataFrame, roots: DataFrame) -> DataFrame:
    """outcomes (volume, ok), roots (volume, root): the roots to scan instead, those of volumes that weren't replayed well."""
    good = outcomes.groupBy("volume").agg(F.every("ok").alias("ok")).where("ok")
    return roots.join(good.select("volume"), "volume", "left_anti").select("volume", "root")


def read_batch(journal: DataFrame, cursor: int, size: int) -> tuple[DataFrame, int]:
    """The first size records from cursor on, in order, and the cursor after them."""
    rows = journal.where(F.col("usn") >= cursor).orderBy("usn").limit(size)
    last = rows.agg(F.max("usn")).head()[0]
    return rows, cursor if last is None else last + 1
