"""Channels, their fusion, and what is told about each result."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cosine, local_iso, snippet
from .filters import UnifiedFilter, canonical, seconds, with_exif

TOP, RRF_K = 200, 60
BODY_TYPES = ("doc_chunk", "ocr")
TRIPLE = ["file_id", "source_type", "chunk_index"]


def merge_keyword(names: DataFrame, bodies: DataFrame, mode: str = "reference", k: int = TOP) -> DataFrame:
    """Filename hits (file_id, score) and body hits (chunk_id, file_id, score, source_type) to (file_id, score, rank, evidence).

    reference: scores as BM25 gives them (smaller is better), a file with body hits only stays at 0, a file
    with both has the larger, and ranks go by descending score. relevance: the best of the negated scores."""
    sign = 1 if mode == "reference" else -1
    a = names.select("file_id", (sign * F.col("score")).alias("own"), F.lit("filename").alias("channel"), F.lit(None).cast("long").alias("chunk_id"))
    b = bodies.select("file_id", (sign * F.col("score")).alias("own"), F.lit("body").alias("channel"), "chunk_id")
    score = F.max("own")
    if mode == "reference":
        score = F.when(F.max(F.when(F.col("channel") == "filename", 1)).isNull(), F.lit(0.0)).otherwise(score)
    evidence = F.array_sort(F.collect_list(F.struct("channel", "chunk_id", F.col("own").alias("score"))))
    merged = a.unionByName(b).groupBy("file_id").agg(score.alias("score"), evidence.alias("evidence"))
    return ranked(merged.orderBy(F.desc("score"), "file_id").limit(k))


def held(rows: DataFrame) -> DataFrame:
    """A channel's rows, TOP at most (or k), computed once and kept by the driver: they are used several times."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def among(rows: DataFrame, few: DataFrame, *on: str) -> DataFrame:
    """rows whose keys are in few, which has the rows of a channel at most: these go to every task, so rows aren't dealt."""
    return rows.join(F.broadcast(few.select(*on).distinct()), list(on), "left_semi")


def ranked(df: DataFrame) -> DataFrame:
    """rank by (score descending, id), of rows that are few already."""
    return df.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "file_id")))


def by_form(hits: Iterable[DataFrame], least: int = 3) -> DataFrame:
    """The first form with enough hits, else the last. Each hit list is a top-k, so it is held once it is looked
    at; later forms aren't made if an earlier one is enough."""
    for h in hits:
        own = held(h)
        if len({r["file_id"] for r in own.select("file_id").collect()}) >= least:
            break
    return own


def nearest(points: DataFrame, vector: list[float], k: int = TOP) -> DataFrame:
    """The k points of largest cosine, exactly; the vector is a literal, so there is no join."""
    at = F.array(*[F.lit(float(x)) for x in vector])
    return points.withColumn("score", cosine(F.col("embedding"), at)).orderBy(F.desc("score"), "vec_id").limit(k)


def semantic(points: DataFrame, chunks: DataFrame, files: DataFrame, exif: DataFrame, vector: list[float], f: UnifiedFilter = UnifiedFilter(), k: int = TOP) -> DataFrame:
    """Top points; only those with a chunk of the same file, source and index; only files that pass; the best chunk of each."""
    top = held(nearest(points, vector, k))
    top = top.join(among(chunks.select(TRIPLE), top, *TRIPLE), TRIPLE, "left_semi")
    passing = with_exif(among(files, top, "file_id"), among(exif, top, "file_id")).where(canonical(f)).select("file_id")
    best = top.join(passing, "file_id", "left_semi").groupBy("file_id").agg(F.max(F.struct(F.col("score"), (-F.col("vec_id")).alias("v"), "source_type", "chunk_index")).alias("m"))
    return ranked(best.select("file_id", "m.score", "m.source_type", "m.chunk_index").orderBy(F.desc("score"), "file_id").limit(k))


def fuse(keyword: DataFrame, vectors: DataFrame, w_keyword: float = 1.0, w_semantic: float = 1.0) -> DataFrame:
    """Weighted reciprocal ranks: file_id, rrf_score, keyword_score, semantic_score."""
    a = keyword.select("file_id", F.col("rank").alias("rk"), F.col("score").alias("keyword_score"))
    b = vectors.select("file_id", F.col("rank").alias("rs"), F.col("score").alias("semantic_score"))
    share = lambda w, r: F.coalesce(F.lit(w) / (RRF_K + F.col(r)), F.lit(0.0))
    return a.join(b, "file_id", "full").select("file_id", (share(w_keyword, "rk") + share(w_semantic, "rs")).alias("rrf_score"), "keyword_score", "semantic_score")


def time_info(basis: str) -> Column:
    """basis, confidence and value of the time shown: the taken time is exact, its stand-in a fallback."""
    shown = lambda b, c, v: F.struct(F.lit(b).alias("basis"), F.lit(c).alias("confidence"), local_iso(v).alias("value"))
    if basis in ("ctime", "mtime"):
        return shown(basis, "exact", seconds(f"{basis}_ns"))
    return F.when(F.col("taken_epoch").isNotNull(), shown("exif", "exact", F.col("taken_epoch"))).otherwise(shown("mtime", "fallback", seconds("mtime_ns")))


RESULT = ["file_id", "path", "filename", "dir_path", "extension", "file_type", "size_bytes", "mtime_ns", "rrf_score", "keyword_score", "semantic_score", "time_info", "match_reasons"]


def finalize(fused: DataFrame, files: DataFrame, exif: DataFrame, chunks: DataFrame, keyword: DataFrame, vectors: DataFrame, f: UnifiedFilter, k: int = 50) -> DataFrame:
    """The k best, then the filter once more (so fewer may be left), with what matched in each."""
    top = fused.orderBy(F.desc("rrf_score"), "file_id").limit(k)
    rows = top.join(with_exif(among(files, top, "file_id"), among(exif, top, "file_id")).where(canonical(f)), "file_id")
    text = chunks.select("chunk_id", "file_id", "source_type", "chunk_index", snippet(F.col("chunk_text")).alias("text"))
    reason = lambda channel, score, text: F.struct(channel.alias("channel"), text.alias("text"), score.alias("score"), F.lit(None).cast("string").alias("basis"), F.lit(None).cast("string").alias("confidence"))
    # Only the texts that are told of leave the tasks that read them.
    matched = keyword.join(top.select("file_id"), "file_id", "left_semi").select("file_id", F.explode("evidence").alias("e")).select("file_id", "e.*")
    said = matched.join(among(text, matched, "chunk_id").select("chunk_id", "text"), "chunk_id", "left").select("file_id", reason(F.col("channel"), F.col("score"), F.col("text")).alias("r"))
    near = vectors.join(top.select("file_id"), "file_id", "left_semi")
    seen = near.join(among(text, near, *TRIPLE).drop("chunk_id"), TRIPLE, "left").select("file_id", reason(F.lit("semantic"), F.col("score"), F.col("text")).alias("r"))
    reasons = said.unionByName(seen).groupBy("file_id").agg(F.array_sort(F.collect_list("r")).alias("reasons"))
    rows = rows.join(reasons, "file_id", "left").withColumn("time_info", time_info(f.basis))
    timed = F.array(F.struct(F.lit("time").alias("channel"), F.col("time_info.value").alias("text"), F.lit(None).cast("double").alias("score"), F.col("time_info.basis").alias("basis"), F.col("time_info.confidence").alias("confidence")))
    own = F.coalesce("reasons", F.array().cast(timed_type()))
    rows = rows.withColumn("match_reasons", F.concat(own, timed) if f.timed else own)
    return rows.select(RESULT).orderBy(F.desc("rrf_score"), "file_id")


def timed_type() -> str:
    return "array<struct<channel:string,text:string,score:double,basis:string,confidence:string>>"
