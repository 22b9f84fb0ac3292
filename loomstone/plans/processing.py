"""From files to chunks and vectors: what a worker does for a batch of files, as plans over whole tables.

A batch goes through these steps, each over all its files at once: hash the content, decide on reuse, copy what
another file has, read and cut what is new, embed what is pending, and reject what has changed meanwhile. The
result is the next state of every table and an outcome (file_id, error) for each file, which ends its task."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chunk import chunks, segmented
from ..functions.hashing import EmbeddingProvider, embed, point_id
from ..functions.segment import DEFAULT, Segmenter
from ..functions.text import estimate_tokens, exif_epoch, split_terms
from ..operators import ingest
from ..session import shared_path

KEY = ["file_id", "source_type", "chunk_index"]
IMAGE_KINDS = ("ocr", "image_caption")
PENDING, SUCCESS, FAILED = 0, 1, 2


@dataclass
class State:
    """files; chunks (KEY, chunk_text, chunk_text_seg, token_count, embedding_status); ocr (file_id, text, lang,
    confidence); exif (file_id, taken_epoch); points (KEY, vec_id, embedding)."""

    files: DataFrame
    chunks: DataFrame
    ocr: DataFrame
    exif: DataFrame
    points: DataFrame


@dataclass
class Models:
    """embedding: None leaves chunks pending (keywords only). Images come with their recognised text and caption as
    columns, made by whatever recognises them."""

    embedding: EmbeddingProvider | None = None
    segmenter: Segmenter = DEFAULT


CHUNK = [*KEY, "chunk_text", "chunk_text_seg", "token_count", "embedding_status"]


#: Characters of chunks that a worker holds before it passes them on.
HELD_CHARS = 1 << 20


def fresh_chunks(rows: DataFrame, models: Models) -> DataFrame:
    """rows (file_id, text, ocr_text, caption) to chunks, still to be embedded: of text those that it is cut into, of
    recognised text (its terms taken apart) and of captions one each; none of what is null or empty. Texts are cut and
    segmented by one worker, which takes them one by one and holds HELD_CHARS of chunks."""
    segmenter = models.segmenter

    def cut(batches):
        import pyarrow as pa

        kinds = pa.schema([("file_id", pa.int64()), ("source_type", pa.string()), ("chunk_index", pa.int32()), ("chunk_text", pa.string()), ("chunk_text_seg", pa.string())])
        for batch in batches:
            out, held = [], 0
            for file_id, *texts in zip(*(column_values(batch.column(i)) for i in range(4)), strict=True):
                text, ocr, said = (x or "" for x in texts)
                for source, parts in (("doc_chunk", chunks(text)), ("ocr", [ocr] if ocr else []), ("image_caption", [said] if said else [])):
                    out += [(file_id, source, i, x, segmented(x, segmenter)) for i, x in enumerate(parts)]
                    held += sum(map(len, parts))
                if held > HELD_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.types, strict=True)], schema=kinds)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.types, strict=True)], schema=kinds)

    found = rows.select(F.col("file_id").cast("long"), "text", split_terms(F.col("ocr_text")).alias("ocr_text"), "caption").mapInArrow(cut, "file_id long, source_type string, chunk_index int, chunk_text string, chunk_text_seg string")
    return found.withColumns({"token_count": estimate_tokens(F.col("chunk_text")), "embedding_status": F.lit(PENDING)}).select(CHUNK)


def column_values(column):
    """One at a time, so that a batch isn't held as Python objects besides."""
    return (x.as_py() for x in column)


def document_chunks(docs: DataFrame, models: Models) -> DataFrame:
    """docs (file_id, text) cut into chunks."""
    return fresh_chunks(docs.select("file_id", "text", *[F.lit(None).cast("string").alias(c) for c in ("ocr_text", "caption")]), models)


def image_chunks(images: DataFrame, models: Models) -> DataFrame:
    """images (file_id, ocr_text, caption): recognised text with its terms taken apart, and the caption; none for empty ones."""
    return fresh_chunks(images.select("file_id", F.lit(None).cast("string").alias("text"), "ocr_text", "caption"), models)


def joined_words(lines: Column) -> tuple[Column, Column]:
    """lines (array of text and score) that a recogniser found, to the text and the mean confidence; 0 without text."""
    good = F.filter(F.transform(lines, lambda x: F.struct(F.trim(x["text"]).alias("text"), x["score"].alias("score"))), lambda x: x["text"] != "")
    mean = F.aggregate(good, F.lit(0.0), lambda s, x: s + x["score"]) / F.size(good)
    return F.array_join(F.transform(good, lambda x: x["text"]), " "), F.when(F.size(good) > 0, mean).otherwise(0.0)


def caption(embedding: Column, labels: DataFrame, k: int = 3, least: float = 0.2) -> tuple[Column, DataFrame]:
    """Text of the k labels nearest to an image, of those above least; labels (label, embedding) is a vocabulary, whose
    single row of names and vectors has to be joined to the images: (expression, that row)."""
    from ..functions.text import cosine

    row = labels.agg(F.array_sort(F.collect_list(F.struct("label", F.col("embedding").alias("vector")))).alias("_labels"))
    scored = F.transform("_labels", lambda x: F.struct((-cosine(embedding, x["vector"])).alias("minus"), x["label"].alias("label")))
    best = F.filter(F.slice(F.array_sort(scored), 1, k), lambda x: -x["minus"] >= least)
    return F.array_join(F.transform(best, lambda x: x["label"]), "，"), row


def _without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("file_id").distinct(), "file_id", "left_anti")


def _marked(files: DataFrame, told: DataFrame) -> DataFrame:
    """files with hash and status of told (file_id, hash, done)."""
    own = told.select("file_id", F.col("hash").alias("_hash"), F.col("done").alias("_done"))
    return files.join(own, "file_id", "left").withColumns({"content_hash": F.coalesce("_hash", "content_hash"), "status": F.when(F.col("_done"), "AI_DONE").when(~F.col("_done"), "FAILED").otherwise(F.col("status"))}).select(files.columns)


def embed_pending(state: State, models: Models, only: DataFrame | None = None) -> State:
    """Chunks without a vector get one (of the files in only, else of all), and are SUCCESS; points of these files
    whose chunk is gone are taken out after that."""
    if models.embedding is None:
        return state
    due = state.chunks.where(F.col("embedding_status") == PENDING)
    if only is not None:
        due = due.join(only.select("file_id").distinct(), "file_id", "left_semi")
    vectors = due.select(*KEY, point_id(F.col("file_id"), F.col("source_type"), F.col("chunk_index")).alias("vec_id"), embed(F.col("chunk_text"), models.embedding).alias("embedding"))
    kept = state.points.join(vectors.select(KEY), KEY, "left_anti")
    touched = due.select("file_id").distinct().withColumn("_touched", F.lit(True))
    alive = state.chunks.select(*KEY, F.lit(True).alias("_alive"))
    kept = kept.join(touched, "file_id", "left").join(alive, KEY, "left").where("_touched IS NULL OR _alive").select(*KEY, "vec_id", "embedding")
    keys = due.select(*KEY, F.lit(True).alias("_due"))
    chunks = state.chunks.join(keys, KEY, "left").withColumn("embedding_status", F.when(F.col("_due"), SUCCESS).otherwise(F.col("embedding_status"))).select(CHUNK)
    return replace(state, chunks=chunks, points=kept.unionByName(vectors.withColumn("embedding", F.col("embedding").cast(dict(state.points.dtypes)["embedding"]))))


def reembed(state: State, models: Models, files: DataFrame) -> State:
    """All chunks of files embedded anew, whatever their status."""
    if models.embedding is None:
        return state
    own = files.select("file_id", F.lit(True).alias("_again")).distinct()
    chunks = state.chunks.join(own, "file_id", "left").withColumn("embedding_status", F.when(F.col("_again"), PENDING).otherwise(F.col("embedding_status"))).select(CHUNK)
    return embed_pending(replace(state, chunks=chunks), models, files)


def heal(state: State, models: Models, files: DataFrame) -> State:
    """Of files, those with embedded chunks that have no point are embedded again."""
    lost = ingest.missing_vectors(state.chunks, state.points).join(files.select("file_id"), "file_id", "left_semi")
    return reembed(state, models, lost)


def copied(state: State, plan: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, recognised texts and points of plan's sources, under the file's own ids."""
    points = ingest.clone_points(state.points, plan, state.chunks)
    points = points.select(*KEY, point_id(F.col("file_id"), F.col("source_type"), F.col("chunk_index")).alias("vec_id"), "embedding")
    has = points.select(*KEY, F.lit(True).alias("_has"))
    source = state.chunks.withColumnRenamed("file_id", "source_id")
    chunks = plan.select("file_id", "source_id").join(source, "source_id").join(has, KEY, "left").withColumn("embedding_status", F.when(F.col("_has"), SUCCESS).otherwise(PENDING)).select(CHUNK)
    read = plan.select("file_id", "source_id").join(state.ocr.withColumnRenamed("file_id", "source_id"), "source_id").select(state.ocr.columns)
    return chunks, read, points


def clone(state: State, models: Models, plan: DataFrame) -> State:
    """plan (file_id, source_id, hash): results of the source, under the file's own ids. Chunks whose vector exists come
    with it, others are pending and embedded then. Names, places and times of the source aren't copied."""
    chunks, read, points = copied(state, plan)
    after = State(
        _marked(state.files, plan.withColumn("done", F.lit(True))),
        _without(state.chunks, plan).unionByName(chunks),
        _without(state.ocr, read).unionByName(read),
        state.exif,
        state.points.join(points.select(KEY), KEY, "left_anti").unionByName(points),
    )
    return embed_pending(after, models, plan)


def exif_rows(state: State, content: DataFrame) -> DataFrame:
    """exif with the times taken that content (file_id, taken) tells; files without one keep what they have."""
    own = content.select("file_id", exif_epoch(F.col("taken")).alias("taken_epoch")).where("taken_epoch IS NOT NULL")
    return _without(state.exif, own).unionByName(own.select(state.exif.columns))


def changed_meanwhile(before: DataFrame, after: DataFrame) -> DataFrame:
    """before, after (file_id, size_bytes, mtime_ns, hash): files whose size or time differ, and whose content does too.
    Files that are gone by then are left to the deletion that follows."""
    now = after.select("file_id", *[F.col(c).alias(f"_{c}") for c in ("size_bytes", "mtime_ns", "hash")])
    moved = (F.col("size_bytes") != F.col("_size_bytes")) | (F.col("mtime_ns") != F.col("_mtime_ns"))
    return before.join(now, "file_id").where(moved & ~F.col("hash").eqNullSafe(F.col("_hash"))).select("file_id", F.lit("file changed during processing").alias("error"))


def process(state: State, content: DataFrame, models: Models, after: DataFrame | None = None) -> tuple[State, DataFrame]:
    """content: the batch's files as they are read: file_id, hash, text (documents), ocr_text, confidence, caption and
    taken (images), error (what can't be read, else null). after: a second look at size, time and hash, as content has
    them. Returns the next state and each file's outcome (file_id, verdict, error).

    What a batch makes is written once: files, recognised texts, times, and the chunks and points that are new. Without
    a model, chunks and points that stay are those of the state before, which has to stay where it is until `written`
    copies them; so a batch costs what it changes. Ids are joined first, and texts meet only one join each."""
    # Without its content a file can't be hashed, so it fails before anything of it changes.
    told_bad = F.col("error").isNotNull() | F.col("hash").isNull()
    bad = content.where(told_bad).select("file_id", F.coalesce("error", F.lit("content hash failed")).alias("error"))
    good = content.where(~told_bad)
    # What was decided is written: plans over it stay small.
    plan = _saved(ingest.reuse(state.files, good, ingest.completeness(state.files, state.chunks, state.ocr)).join(state.files.select("file_id", "file_type"), "file_id"), "reuse")
    same, copies, fresh = (plan.where(F.col("verdict") == v) for v in ("same_file", "clone", "none"))
    due = fresh.where("file_type IN ('doc', 'image')").select("file_id", F.col("file_type").alias("_kind"))
    image = F.col("_kind") == "image"
    new = good.join(due, "file_id").select("file_id", F.when(~image, F.col("text")).alias("text"), *[F.when(image, F.col(c)).alias(c) for c in ("ocr_text", "caption")])
    cut = _saved(fresh_chunks(new, models), "cut")
    read = good.join(due.where(image), "file_id").select("file_id", F.col("ocr_text").alias("text"), F.lit("zh+en").alias("lang"), F.col("confidence").cast("double").alias("confidence")).select(state.ocr.columns)
    # Copies are of the state before: a source may be in the batch too, and the plan is about its old results.
    own_chunks, own_read, own_points = (_saved(x, f"copied-{n}") for x, n in zip(copied(state, copies), ("chunks", "ocr", "points"), strict=True))
    gone = due.unionByName(copies.select("file_id", F.lit("copy").alias("_kind")))
    stays = F.col("_kind").isNull() | (image & ~F.col("source_type").isin(*IMAGE_KINDS))
    kept = state.chunks.join(gone, "file_id", "left").where(stays).select(CHUNK)
    pictures = good.join(state.files.where("file_type = 'image'").select("file_id"), "file_id", "left_semi")
    put = read.unionByName(own_read)
    points = state.points.join(own_points.select(KEY), KEY, "left_anti").unionByName(own_points)
    out = State(_marked(state.files, plan.select("file_id", "hash", F.lit(True).alias("done"))), kept.unionByName(cut).unionByName(own_chunks), _without(state.ocr, put).unionByName(put), exif_rows(state, pictures), points)
    if models.embedding is not None:
        out = written(heal(written(embed_pending(written(out), models, due.select("file_id").unionByName(copies.select("file_id")))), models, same))
    else:
        out = replace(out, **{n: _saved(getattr(out, n), n) for n in ("files", "ocr", "exif")})
    failed = bad
    if after is not None:
        failed = failed.unionByName(changed_meanwhile(good.join(state.files.select("file_id", "size_bytes", "mtime_ns"), "file_id"), after.join(fresh.select("file_id"), "file_id", "left_semi")))
    out = replace(out, files=_marked(out.files, failed.select("file_id", F.lit(None).cast("string").alias("hash"), F.lit(False).alias("done")).distinct()))
    told = content.select("file_id").join(plan.select("file_id", "verdict"), "file_id", "left").join(failed, "file_id", "left")
    return out, told.select("file_id", "verdict", "error")


def _saved(df: DataFrame, name: str) -> DataFrame:
    at = shared_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def written(state: State) -> State:
    """The state, written to the shared folder and read again."""
    return State(*[_saved(getattr(state, n), n) for n in ("files", "chunks", "ocr", "exif", "points")])


# ---- changes on disk


def rename_plan(files: DataFrame, chunks: DataFrame, moves: DataFrame) -> DataFrame:
    """moves (path, target) to (path, target, verdict, file_id, target_id): rename (the source keeps its id), merge (the
    target is an artefact of the move: alike in size and time, without results; it goes, then as rename), conflict
    (the target is another file: both are looked at again) or new (no source is known: the target is)."""
    side = lambda p, path: files.select(F.col("path").alias(path), F.col("file_id").alias(f"{p}id"), F.col("size_bytes").alias(f"{p}size"), F.col("mtime_ns").alias(f"{p}mtime"), F.col("is_deleted").alias(f"{p}deleted"))
    has = chunks.select(F.col("file_id").alias("t_id"), F.lit(True).alias("_has")).distinct()
    both = moves.select("path", "target").join(side("s_", "path"), "path", "left").join(side("t_", "target").where("t_deleted = 0"), "target", "left").join(has, "t_id", "left")
    alike = F.col("s_id").isNotNull() & (F.col("s_size") == F.col("t_size")) & (F.col("s_mtime") == F.col("t_mtime")) & F.col("_has").isNull()
    said = F.when(F.col("t_id").isNotNull() & alike, "merge").when(F.col("t_id").isNotNull(), "conflict").when(F.col("s_id").isNull(), "new").otherwise("rename")
    return both.select("path", "target", said.alias("verdict"), F.col("s_id").alias("file_id"), F.col("t_id").alias("target_id"))


def renamed(files: DataFrame, plan: DataFrame) -> DataFrame:
    """files after the renames and merges of plan: path, name, folder, extension and type are those of the target."""
    from ..functions.files import extension, file_type

    gone = plan.where("verdict = 'merge'").select(F.col("target_id").alias("file_id"))
    own = plan.where("verdict IN ('rename', 'merge')").groupBy("file_id").agg(F.max("target").alias("_target"))
    rows = files.join(gone, "file_id", "left_anti").join(own, "file_id", "left")
    name = F.regexp_extract("_target", r"[^/\\\\]*$", 0)
    new = {"path": F.col("_target"), "filename": name, "dir_path": F.regexp_replace("_target", r"[/\\\\][^/\\\\]*$", ""), "extension": extension(name), "file_type": file_type(extension(name))}
    return rows.withColumns({c: F.when(F.col("_target").isNotNull(), v).otherwise(F.col(c)) for c, v in new.items()}).select(files.columns)


def look_again(plan: DataFrame) -> DataFrame:
    """Paths that are to be looked at on disk: both of a conflict, the target of what is new."""
    return plan.where("verdict IN ('conflict', 'new')").select(F.explode(F.when(F.col("verdict") == "conflict", F.array("path", "target")).otherwise(F.array("target"))).alias("path")).distinct()


def applied(files: DataFrame, paths: DataFrame, on_disk: DataFrame) -> DataFrame:
    """files after a look at paths: those on_disk (as a scan gives them) are taken over, others marked as deleted."""
    found = on_disk.join(paths.select("path").distinct(), "path", "left_semi")
    gone = paths.select("path").distinct().join(on_disk.select("path"), "path", "left_anti")
    after = ingest.upsert(files, found).select(files.columns)
    return ingest.soft_delete(after, gone, "path")
