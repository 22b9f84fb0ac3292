"""Queries from text to results: parse, filter, channels, fusion; what a channel's failure comes to."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass, field
from datetime import UTC, datetime, tzinfo

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.segment import DEFAULT, Segmenter, query_words
from ..functions.timeparse import Parsed, parse
from ..operators import bm25, search
from ..operators.filters import UnifiedFilter, canonical, metadata_only, with_exif


#: Fixed value: what is put before a query for the embedding model.
INSTRUCTION = "为这个句子生成表示以用于检索相关文章："


class ChannelError(RuntimeError):
    """KEYWORD_CHANNEL_FAILED, SEMANTIC_CHANNEL_FAILED or BOTH_CHANNELS_FAILED."""


@dataclass
class Outcome:
    parsed: Parsed
    results: DataFrame | None
    degraded: list[str] = field(default_factory=list)
    stages_ms: dict[str, float] = field(default_factory=dict)


def unified(p: Parsed) -> UnifiedFilter:
    t = p.time
    return UnifiedFilter(t and t.start, t and t.end, t.basis if t else "exif", tuple(p.file_types), tuple(p.extensions))


@dataclass
class Engine:
    """files, exif, chunks and points are tables; embed gives a query's vector (None: no semantic channel).

    Queries are embedded with INSTRUCTION before them, as retrieval models want it; texts aren't. names and bodies:
    standing indexes of file names and of chunks, by which keywords are looked up; without, texts are scanned."""

    files: DataFrame
    exif: DataFrame
    chunks: DataFrame
    points: DataFrame
    embed: Callable[[str], list[float]] | None = None
    mode: str = "reference"
    segmenter: Segmenter = DEFAULT
    keyword_seconds: float = 60.0
    semantic_seconds: float = 60.0
    prefilter: bool = False
    names: bm25.Index | None = None
    bodies: bm25.Index | None = None
    instruction: str = INSTRUCTION

    def keyword(self, text: str, f: UnifiedFilter) -> DataFrame | None:
        """The first form with three files or more, of names and bodies; files that don't pass go after the
        top hits are taken (prefilter: before, which needs a scan)."""
        passing = with_exif(self.files, self.exif).where(canonical(f)).select("file_id")
        names = self.files.select("file_id", "filename", F.regexp_replace("dir_path", "/", " ").alias("dirs"))
        bodies = self.chunks.where(F.col("source_type").isin(*search.BODY_TYPES))
        if self.prefilter:
            names, bodies = (x.join(passing, "file_id", "left_semi") for x in (names, bodies))

        def hits(query: bm25.Query) -> DataFrame:
            by_index = not self.prefilter
            a = self.names.search(query) if by_index and self.names else bm25.scan(names, ["filename", "filename", "dirs"], query)
            b = self.bodies.search(query) if by_index and self.bodies else bm25.scan(bodies, ["chunk_text", "chunk_text"], query, key="chunk_id")
            return search.merge_keyword(*(x.join(passing, "file_id", "left_semi") for x in (a, b)), self.mode)

        forms = bm25.forms(query_words(text, self.segmenter))
        return search.by_form(hits(q) for q in forms) if forms else None

    def semantic(self, text: str, f: UnifiedFilter, k: int) -> DataFrame:
        return search.semantic(self.points, self.chunks, self.files, self.exif, self.embed(self.instruction + text), f, max(k, search.TOP))

    def semantic_only(self, text: str, k: int = 50) -> DataFrame:
        """The semantic channel by itself, of the text as it is: nothing in it is read as a filter."""
        if self.embed is None:
            raise ChannelError("SEMANTIC_CHANNEL_FAILED")
        own = search.semantic(self.points, self.chunks, self.files, self.exif, self.embed(self.instruction + text), UnifiedFilter(), k)
        return own.withColumnRenamed("score", "semantic_score").join(self.files, "file_id").orderBy("rank")

    def _run(self, spark: SparkSession, tag: str, make: Callable[[], DataFrame | None]) -> DataFrame | None:
        """The channel's rows: 200 at most, so they are held by the driver between the channels and their fusion."""
        spark.addTag(tag)
        try:
            df = make()
            return None if df is None else spark.createDataFrame(df.collect(), df.schema)
        finally:
            spark.removeTag(tag)

    def search(self, query: str, k: int = 50, mode: str = "hybrid", now: datetime | None = None, tz: tzinfo = UTC) -> Outcome:
        began, spark = time.monotonic(), self.files.sparkSession
        p = parse(query, now or datetime.now(tz), tz, self.segmenter)
        f, text = unified(p), p.text.strip()
        out = Outcome(p, None, stages_ms={"parser": 1e3 * (time.monotonic() - began)})
        if not text:
            if not f.empty:
                rows = metadata_only(self.files, self.exif, f, k)
                none = F.lit(None)
                out.results = rows.withColumns({"rrf_score": none.cast("double"), "keyword_score": none.cast("double"), "semantic_score": none.cast("double"), "time_info": search.time_info(f.basis), "match_reasons": F.array().cast(search.timed_type())}).select(search.RESULT)
            return out
        wanted = {"keyword": mode in ("hybrid", "keyword"), "semantic": mode in ("hybrid", "semantic")}
        if wanted["semantic"] and self.embed is None:
            if mode == "semantic":
                raise ChannelError("SEMANTIC_CHANNEL_FAILED")
            wanted["semantic"], out.degraded = False, ["semantic"]
        makers = {"keyword": lambda: self.keyword(text, f), "semantic": lambda: self.semantic(text, f, k)}
        limits = {"keyword": self.keyword_seconds, "semantic": self.semantic_seconds}
        found, failed = {}, []
        pool = ThreadPoolExecutor(2)
        base = f"search-{threading.get_ident()}-{time.monotonic_ns()}"
        runs = {c: pool.submit(self._run, spark, f"{base}-{c}", makers[c]) for c, on in wanted.items() if on}
        for c, run in runs.items():
            start = time.monotonic()
            try:
                found[c] = run.result(timeout=limits[c])
            except (Late, PySparkException, RuntimeError):
                spark.interruptTag(f"{base}-{c}") if hasattr(spark, "interruptTag") else None
                failed.append(c)
            out.stages_ms["fts" if c == "keyword" else c] = 1e3 * (time.monotonic() - start)
        pool.shutdown(wait=False)
        if failed and len(failed) == len(runs):
            raise ChannelError("BOTH_CHANNELS_FAILED" if len(failed) == 2 else f"{failed[0].upper()}_CHANNEL_FAILED")
        out.degraded += failed
        start = time.monotonic()
        nothing_k = spark.createDataFrame([], "file_id bigint, score double, evidence array<struct<channel:string,chunk_id:bigint,score:double>>, rank int")
        nothing_s = spark.createDataFrame([], "file_id bigint, score double, source_type string, chunk_index int, rank int")
        kw = found.get("keyword") if found.get("keyword") is not None else nothing_k
        sem = found.get("semantic") if found.get("semantic") is not None else nothing_s
        fused = search.fuse(kw, sem)
        if mode != "hybrid" or out.degraded:
            fused = fused.where("rrf_score > 0")
        out.results = search.finalize(fused, self.files, self.exif, self.chunks, kw, sem, f, k)
        out.stages_ms["finalize"] = 1e3 * (time.monotonic() - start)
        out.stages_ms["total"] = 1e3 * (time.monotonic() - began)
        return out


def percentile(values: list[float], p: float) -> float:
    """The value at place int(n * p) of the sorted ones, the last at most."""
    return sorted(values)[min(len(values) - 1, int(len(values) * p))]
