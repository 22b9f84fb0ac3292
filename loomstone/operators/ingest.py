"""Snapshots: upsert, deletion, reuse of derived rows by content, and consistency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

META = ["filename", "dir_path", "extension", "file_type", "size_bytes", "mtime_ns", "ctime_ns"]


def upsert(known: DataFrame, scanned: DataFrame, fold_case: bool = False) -> DataFrame:
    """The next snapshot, with op: insert, revive, update or keep, and index_op: what the keyword index has to do,
    insert (new and revived files), replace (another name or folder) or nothing (null).

    New paths get ids after the largest. A deleted path comes back under its id, as new. A path whose size
    or modified time differs is set back to METADATA_ONLY only if it was AI_DONE. Content hashes stay until a
    file is processed. fold_case: paths that differ in case are one, and are spelled as scanned."""
    key = F.lower("path") if fold_case else F.col("path")
    a = known.withColumn("_key", key)
    b = scanned.select(key.alias("_key"), F.col("path").alias("s_path"), *[F.col(c).alias(f"s_{c}") for c in META])
    both = a.join(b, "_key", "full")
    new, seen = F.col("file_id").isNull(), F.col("s_path").isNotNull()
    revived = ~new & seen & (F.col("is_deleted") == 1)
    changed = (F.col("size_bytes") != F.col("s_size_bytes")) | (F.col("mtime_ns") != F.col("s_mtime_ns"))
    renamed = (F.col("filename") != F.col("s_filename")) | (F.col("dir_path") != F.col("s_dir_path"))
    op = F.when(new, "insert").when(revived, "revive").when(seen & changed, "update").otherwise("keep")
    index_op = F.when(new | revived, "insert").when(seen & renamed, "replace")
    status = F.when(new | revived | (seen & changed & (F.col("status") == "AI_DONE")), "METADATA_ONLY").otherwise(F.col("status"))
    out = both.select("file_id", F.coalesce("s_path", "path").alias("path"), *[F.coalesce(f"s_{c}", c).alias(c) for c in META], "content_hash", status.alias("status"), F.when(seen, 0).otherwise(F.col("is_deleted")).alias("is_deleted"), op.alias("op"), index_op.alias("index_op"))
    return assign_ids(out)


def assign_ids(rows: DataFrame, id_col: str = "file_id", order: str = "path") -> DataFrame:
    """Ids after the largest for rows without one, in order: ranks within ranges of the order, offset by the
    counts of the ranges before, so no task holds all new rows."""
    new = rows.where(F.col(id_col).isNull()).withColumn("_b", F.substring(F.md5(F.col(order).cast("string")), 1, 3))
    counts = new.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))  # 4096 rows at most
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    top = rows.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    rank = F.row_number().over(W.partitionBy("_b").orderBy(order))
    numbered = new.withColumn("_r", rank).join(F.broadcast(base.select("_b", "_base")), "_b").crossJoin(F.broadcast(top)).withColumn(id_col, F.col("_top") + F.col("_base") + F.col("_r"))
    return rows.where(F.col(id_col).isNotNull()).unionByName(numbered.select(rows.columns))


def soft_delete(files: DataFrame, gone: DataFrame, key: str = "file_id") -> DataFrame:
    """is_deleted set for the keys in gone; doing it twice changes nothing."""
    marks = gone.select(key).distinct().withColumn("_gone", F.lit(1))
    return files.join(marks, key, "left").withColumn("is_deleted", F.coalesce("_gone", "is_deleted")).drop("_gone").select(files.columns)


def missing_on_disk(known: DataFrame, scanned: DataFrame) -> DataFrame:
    """Active files that the scan didn't see."""
    return known.where("is_deleted = 0").join(scanned.select("path"), "path", "left_anti")


def cascade(derived: DataFrame, files: DataFrame) -> DataFrame:
    """Derived rows whose file exists."""
    return derived.join(files.select("file_id"), "file_id", "left_semi")


def replace_chunks(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """The files of fresh get its chunks instead of their own."""
    return chunks.join(fresh.select("file_id").distinct(), "file_id", "left_anti").unionByName(fresh)


def upsert_points(points: DataFrame, fresh: DataFrame, key: str = "vec_id") -> DataFrame:
    return points.join(fresh.select(key), key, "left_anti").unionByName(fresh.dropDuplicates([key]))


def delete_points(points: DataFrame, gone: DataFrame, key: str = "file_id") -> DataFrame:
    """points without those whose key (file_id, or vec_id) is in gone."""
    return points.join(gone.select(key).distinct(), key, "left_anti")


def point_keys(points: DataFrame, files: DataFrame) -> DataFrame:
    """Ids and keys of the points of files."""
    return points.join(files.select("file_id").distinct(), "file_id", "left_semi").select("vec_id", "file_id", "source_type", "chunk_index")


def point_counts(points: DataFrame) -> DataFrame:
    return points.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


def completeness(files: DataFrame, chunks: DataFrame, ocr: DataFrame | None = None) -> DataFrame:
    """ai_complete of each file: a document has document chunks and all of these are embedded; an image has been read
    (a row in ocr, even if no text was found; without that table, this isn't asked) and has recognised text or a
    caption, all embedded. Embedded is status 1."""
    kinds = ("doc_chunk", "ocr", "image_caption")
    is_done = (F.col("embedding_status") == 1).cast("int")
    counts = chunks.groupBy("file_id").agg(*[F.sum((F.col("source_type") == s).cast("int")).alias(f"n_{s}") for s in kinds], *[F.sum(F.when(F.col("source_type") == s, is_done).otherwise(0)).alias(f"d_{s}") for s in kinds], F.count(F.lit(1)).alias("n"), F.sum(is_done).alias("done"))
    own = files.join(counts, "file_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    was_read = F.lit(True)
    if ocr is not None:
        own = own.join(ocr.select("file_id", F.lit(True).alias("_read")).distinct(), "file_id", "left")
        was_read = F.col("_read").isNotNull()
    image, embedded = n("n_ocr") + n("n_image_caption"), n("d_ocr") + n("d_image_caption")
    rule = F.when(F.col("file_type") == "doc", (n("n_doc_chunk") > 0) & (n("n_doc_chunk") == n("d_doc_chunk"))).otherwise(was_read & (image > 0) & (image == embedded))
    return own.select("file_id", "file_type", n("n").alias("n"), n("done").alias("done"), rule.alias("ai_complete"))


def reuse(files: DataFrame, fresh: DataFrame, complete: DataFrame) -> DataFrame:
    """fresh (file_id, hash of its content now) to (file_id, hash, verdict, source_id): same_file if that is its
    hash already and its results are complete; clone if the smallest other id of that hash and type, deleted or
    not, has complete results; else none. complete: file_id and ai_complete.

    The two smallest ids of each content are enough, so equal files are never paired with one another."""
    good = complete.where("ai_complete").select("file_id").distinct()
    known = files.where("content_hash IS NOT NULL").select("file_id", F.col("content_hash").alias("hash"), "file_type")
    first = known.groupBy("hash", "file_type").agg(F.min("file_id").alias("first")).withColumn("h2", F.xxhash64("hash"))
    # The further key makes Spark exchange both sides, so that it can split a content with very many files.
    rest = known.withColumn("h2", F.xxhash64("hash")).join(first, ["hash", "h2", "file_type"]).where("file_id <> first")
    second = rest.groupBy("hash", "file_type").agg(F.min("file_id").alias("second"))
    two = first.join(second, ["hash", "file_type"], "left").select("hash", "h2", "file_type", "first", "second")
    own = fresh.select("file_id", "hash").join(files.select("file_id", "file_type", F.col("content_hash").alias("old")), "file_id")
    own = own.withColumn("h2", F.xxhash64("hash")).join(two, ["hash", "h2", "file_type"], "left")
    own = own.withColumn("source_id", F.when(F.col("first") == F.col("file_id"), F.col("second")).otherwise(F.col("first")))
    done = lambda col, name: own.join(good.select(F.col("file_id").alias(col), F.lit(True).alias(name)), col, "left")
    own = done("file_id", "_own")
    own = done("source_id", "_source")
    verdict = F.when((F.col("old") == F.col("hash")) & F.col("_own"), "same_file").when(F.col("_source"), "clone").otherwise("none")
    return own.select("file_id", "hash", verdict.alias("verdict"), F.when(verdict == "clone", F.col("source_id")).alias("source_id"))


def clone_chunks(chunks: DataFrame, plan: DataFrame) -> DataFrame:
    """Chunks of source_id under file_id: key and point id new, text as it is."""
    return plan.select("file_id", "source_id").join(chunks.withColumnRenamed("file_id", "source_id"), "source_id").select("file_id", "source_id", "source_type", "chunk_index", "chunk_text", "embedding_status")


def clone_points(points: DataFrame, plan: DataFrame, chunks: DataFrame) -> DataFrame:
    """Points of the source's embedded chunks under file_id, those that exist."""
    embedded = chunks.where("embedding_status = 1").select(F.col("file_id").alias("source_id"), "source_type", "chunk_index")
    own = points.withColumnRenamed("file_id", "source_id").join(embedded, ["source_id", "source_type", "chunk_index"], "left_semi")
    return plan.select("file_id", "source_id").join(own, "source_id").drop("source_id")


def stale_points(points: DataFrame, chunks: DataFrame) -> DataFrame:
    """Points without a chunk of the same file, source and index."""
    return points.join(chunks.select("file_id", "source_type", "chunk_index"), ["file_id", "source_type", "chunk_index"], "left_anti")


def missing_vectors(chunks: DataFrame, points: DataFrame) -> DataFrame:
    """Chunks that say they are embedded but have no point: a count for each file."""
    lost = chunks.where("embedding_status = 1").join(points.select("file_id", "source_type", "chunk_index"), ["file_id", "source_type", "chunk_index"], "left_anti")
    return lost.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_missing"))


def integrity(postings: DataFrame, files: DataFrame) -> DataFrame:
    """Ids in one of postings and files only, and in which; none if all is well."""
    a, b = postings.select("file_id").distinct().withColumn("p", F.lit(1)), files.select("file_id").withColumn("f", F.lit(1))
    return a.join(b, "file_id", "full").where("p IS NULL OR f IS NULL").select("file_id", F.when(F.col("p").isNull(), "no postings").otherwise("no file").alias("problem"))


def from_cursor(scanned: DataFrame, cursor: str | None) -> DataFrame:
    """What is left of an interrupted scan: files under the folder that it was about to enter; all without one."""
    return scanned if not cursor else scanned.where(F.col("path").startswith(cursor.rstrip("/") + "/"))


def lookup(files: DataFrame, paths: list[str] = (), folders: list[str] = ()) -> DataFrame:
    """Files at paths, or under folders; both reach the scan as filters."""
    under = [F.col("path").startswith(f.rstrip("/") + "/") for f in folders]
    return files.where(reduce(lambda a, b: a | b, under, F.col("path").isin(*paths) if paths else F.lit(False)))
