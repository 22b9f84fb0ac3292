"""Registered queries over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import files as ff
from ..functions import text as ft
from ..operators import admin, bm25, events, ingest, search, tasks
from ..operators.filters import UnifiedFilter, apply, metadata_only, with_exif
from ..session import shared_path, ship
from ..sources.tables import Tables, sql
from . import processing

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, body: str | None = None, *ctes: str):
    def add(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(Tables(spark, sf_dir))

        _QUERIES[name] = run
        if body:
            _SQL[name] = sql(body, *ctes)
        return fn

    return add


# ---- filters

#: Three days in the range of the tables' times.
LO, HI = 1704240000, 1705104000


@query("meta_filter_type_ext", "SELECT file_id, path, extension FROM files WHERE is_deleted = 0 AND file_type IN ('image', 'doc') AND extension IN ('.jpg', '.pdf')", "files")
def _(t):
    return apply(t.files, t.exif, UnifiedFilter(file_types=("image", "doc"), extensions=("jpg", ".pdf"))).select("file_id", "path", "extension")


@query("meta_time_exif_fallback", f"""SELECT f.file_id, taken_epoch FROM files f LEFT JOIN exif e ON f.file_id = e.file_id
WHERE is_deleted = 0 AND ((taken_epoch IS NOT NULL AND taken_epoch >= {LO} AND taken_epoch < {HI}) OR (taken_epoch IS NULL AND mtime_ns // 1000000000 >= {LO} AND mtime_ns // 1000000000 < {HI}))""", "files", "exif")
def _(t):
    return apply(t.files, t.exif, UnifiedFilter(LO, HI)).select("file_id", "taken_epoch")


@query("meta_time_ctime", f"SELECT file_id, ctime_ns FROM files WHERE is_deleted = 0 AND ctime_ns // 1000000000 >= {LO} AND ctime_ns // 1000000000 < {HI}", "files")
def _(t):
    return apply(t.files, t.exif, UnifiedFilter(LO, HI, "ctime")).select("file_id", "ctime_ns")


@query("meta_time_mtime", f"SELECT file_id, mtime_ns FROM files WHERE is_deleted = 0 AND mtime_ns // 1000000000 >= {LO} AND mtime_ns // 1000000000 < {HI}", "files")
def _(t):
    return apply(t.files, t.exif, UnifiedFilter(LO, HI, "mtime")).select("file_id", "mtime_ns")


@query("meta_include_deleted", "SELECT file_id, is_deleted FROM files WHERE file_type = 'video'", "files")
def _(t):
    return apply(t.files, t.exif, UnifiedFilter(file_types=("video",), include_deleted=True)).select("file_id", "is_deleted")


@query("meta_only_topk", """SELECT f.file_id, path, coalesce(taken_epoch, mtime_ns // 1000000000) AS shown FROM files f LEFT JOIN exif e ON f.file_id = e.file_id
WHERE is_deleted = 0 AND file_type = 'image' AND coalesce(taken_epoch, mtime_ns // 1000000000) >= 1704240000 AND coalesce(taken_epoch, mtime_ns // 1000000000) < 1999999999 ORDER BY shown DESC, f.file_id LIMIT 50""", "files", "exif")
def _(t):
    out = metadata_only(t.files, t.exif, UnifiedFilter(LO, 1999999999, file_types=("image",)))
    return out.select("file_id", "path", F.coalesce("taken_epoch", F.expr("mtime_ns div 1000000000")).alias("shown"))


@query("meta_only_newest", "SELECT file_id, mtime_ns FROM files WHERE is_deleted = 0 AND extension IN ('.md', '.txt') ORDER BY mtime_ns DESC, file_id LIMIT 50", "files")
def _(t):
    return metadata_only(t.files, t.exif, UnifiedFilter(extensions=("md", "txt"))).select("file_id", "mtime_ns")


@query("files_exif_left_join", "SELECT f.file_id, taken_epoch, size_bytes FROM files f LEFT JOIN exif e ON f.file_id = e.file_id", "files", "exif")
def _(t):
    return with_exif(t.files, t.exif).select("file_id", "taken_epoch", "size_bytes")


@query("key_lookup", "SELECT file_id, path FROM files WHERE path = '/src3/en/note-en-63.docx' OR starts_with(path, '/src1/de/')", "files")
def _(t):
    return ingest.lookup(t.files, ["/src3/en/note-en-63.docx"], ["/src1/de/"]).select("file_id", "path")


# ---- scalar and text functions

_TOK = "list_filter(regexp_split_to_array(strip_accents(lower({0})), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


@query("tokenize_terms", f"SELECT doc_id, len({_TOK.format('text')}) AS n_tokens, array_to_string({_TOK.format('text')}[1:12], ' ') AS head FROM documents")
def _(t):
    toks = ft.tokens(F.col("text"))
    return t.raw("documents").select("doc_id", toks.alias("toks")).select("doc_id", F.size("toks").alias("n_tokens"), F.array_join(F.slice("toks", 1, 12), " ").alias("head"))


@query("tokenize_terms_all", f"SELECT doc_id, i AS part, toks[i] AS token FROM (SELECT doc_id, toks, unnest(generate_series(1, len(toks))) AS i FROM (SELECT doc_id, {_TOK.format('text')} AS toks FROM documents))")
def _(t):
    return t.raw("documents").select("doc_id", F.posexplode(ft.tokens(F.col("text"))).alias("i", "token")).select("doc_id", (F.col("i") + 1).cast("long").alias("part"), "token")


@query("est_tokens", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) + length(regexp_replace(text, '[A-Za-z0-9_\\s]', '', 'g')) AS n FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", ft.estimate_tokens(F.col("text")).alias("n"))


@query("paragraph_split", """SELECT doc_id, i AS part, trim(p[i]) AS paragraph FROM (SELECT doc_id, p, unnest(generate_series(1, len(p))) AS i FROM
(SELECT doc_id, list_filter(regexp_split_to_array(replace(text, chr(10), chr(10) || ' ' || chr(10)), '\\n\\s*\\n'), lambda x: trim(x) <> '') AS p FROM documents))""")
def _(t):
    spaced = F.replace(F.col("text"), F.lit("\n"), F.lit("\n \n"))
    return t.raw("documents").select("doc_id", F.posexplode(ft.paragraphs(spaced)).alias("i", "paragraph")).select("doc_id", (F.col("i") + 1).cast("long").alias("part"), "paragraph")


@query("sentence_split", """SELECT doc_id, i AS part, s[i] AS sentence FROM (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS i FROM
(SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^。！？!?.\\n]*[。！？!?.\\n]|[^。！？!?.\\n]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents))""")
def _(t):
    return t.raw("documents").select("doc_id", F.posexplode(ft.sentences(F.col("text"))).alias("i", "sentence")).select("doc_id", (F.col("i") + 1).cast("long").alias("part"), "sentence")


@query("camel_digit_split", """SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace('Vip' || c_mktsegment || c_custkey || 'AiNote', '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'), ' +', ' ', 'g') AS words FROM customer""")
def _(t):
    glued = F.concat(F.lit("Vip"), "c_mktsegment", F.col("c_custkey").cast("string"), F.lit("AiNote"))
    return t.raw("customer").select("c_custkey", ft.split_terms(glued).alias("words"))


@query("snippet80", "SELECT chunk_id, substr(chunk_text, 1, 80) AS snippet FROM chunks", "chunks")
def _(t):
    return t.chunks.select("chunk_id", ft.snippet(F.col("chunk_text")).alias("snippet"))


@query("query_clean", """SELECT p_partkey, regexp_replace(p_name || ' (' || p_brand || ')-"' || p_type || '"*', '["''(){}\\[\\]*:^+\\-~]', ' ', 'g') AS cleaned FROM part""")
def _(t):
    raw = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(')-"'), "p_type", F.lit('"*'))
    return t.raw("part").select("p_partkey", ft.clean_query(raw).alias("cleaned"))


@query("ext_type_map", "SELECT extension, CASE lower(extension) WHEN '.jpg' THEN 'image' WHEN '.png' THEN 'image' WHEN '.pdf' THEN 'doc' WHEN '.docx' THEN 'doc' WHEN '.txt' THEN 'doc' WHEN '.md' THEN 'doc' WHEN '.mp4' THEN 'video' ELSE 'other' END AS kind, count(*) AS n FROM files GROUP BY 1, 2", "files")
def _(t):
    return t.files.groupBy("extension", ff.file_type(F.col("extension")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("mime_map", "SELECT extension, CASE lower(extension) WHEN '.jpg' THEN 'image/jpg' WHEN '.png' THEN 'image/png' WHEN '.pdf' THEN 'application/pdf' WHEN '.docx' THEN 'application/msword' WHEN '.txt' THEN 'text/plain' WHEN '.md' THEN 'text/plain' WHEN '.mp4' THEN 'video/mp4' END AS mime, count(*) AS n FROM files GROUP BY 1, 2", "files")
def _(t):
    return t.files.groupBy("extension", ff.mime_type(F.col("extension")).alias("mime")).agg(F.count(F.lit(1)).alias("n"))


@query("scan_skips", """SELECT file_id, path FROM (SELECT file_id, '/' || CASE WHEN file_id % 4 = 0 THEN 'node_modules' WHEN file_id % 4 = 1 THEN 'Windows' ELSE 'home' END || path AS path, extension FROM files)
WHERE NOT (path LIKE '/node_modules/%' OR path LIKE '/Windows/%') AND lower(extension) NOT IN ('.tmp', '.log', '.exe', '.ini')""", "files")
def _(t):
    top = F.when(F.col("file_id") % 4 == 0, "node_modules").when(F.col("file_id") % 4 == 1, "Windows").otherwise("home")
    rows = t.files.withColumn("path", F.concat(F.lit("/"), top, "path"))
    return rows.where(~ff.skip_dir(F.col("path")) & ~ff.skip_extension(F.col("extension"))).select("file_id", "path")


@query("file_meta", "SELECT file_id, lower(regexp_extract(filename, '(\\.[^.]+)$', 1)) AS ext, trim(replace(dir_path, '/', ' ')) AS dir_tokens FROM files", "files")
def _(t):
    return t.files.select("file_id", ff.extension(F.col("filename")).alias("ext"), ff.dir_tokens(F.col("dir_path")).alias("dir_tokens"))


@query("root_cover_count", """SELECT root, count(*) AS n FROM files JOIN (SELECT '/src1' AS root UNION ALL SELECT '/src2/' UNION ALL SELECT '/src3/en') r
ON starts_with(path, rtrim(root, '/') || '/') WHERE is_deleted = 0 GROUP BY root""", "files")
def _(t):
    return admin.covered_counts(t.files, t.spark.createDataFrame([("/src1",), ("/src2/",), ("/src3/en",)], "root string"))


@query("time_iso", "SELECT file_id, strftime(to_timestamp(mtime_ns // 1000000000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso, strftime(to_timestamp(mtime_ns // 1000000000) AT TIME ZONE 'UTC', '%Y:%m:%d %H:%M:%S') AS exif_text, mtime_ns // 1000000000 AS back FROM files", "files")
def _(t):
    at = F.timestamp_seconds(F.expr("mtime_ns div 1000000000"))
    text = F.date_format(at, "yyyy:MM:dd HH:mm:ss")
    return t.files.select("file_id", ft.local_iso(F.expr("mtime_ns div 1000000000")).alias("iso"), text.alias("exif_text"), ft.exif_epoch(text).alias("back"))


@query("time_ranges", "SELECT file_id, CAST(date_trunc('day', d) AS DATE) AS day0, CAST(date_trunc('week', d) AS DATE) AS monday, CAST(date_trunc('month', d) AS DATE) AS month0 FROM (SELECT file_id, to_timestamp(mtime_ns // 1000000000) AT TIME ZONE 'UTC' AS d FROM files)", "files")
def _(t):
    at = F.timestamp_seconds(F.expr("mtime_ns div 1000000000"))
    return t.files.select("file_id", *[F.date_trunc(u, at).cast("date").alias(n) for u, n in (("day", "day0"), ("week", "monday"), ("month", "month0"))])


@query("logical_keys", "SELECT chunk_id, file_id || ':' || source_type || ':' || chunk_index AS logical_key FROM chunks", "chunks")
def _(t):
    return t.chunks.select("chunk_id", ft.logical_key(F.col("file_id"), F.col("source_type"), F.col("chunk_index")).alias("logical_key"))


@query("json_settings", "SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props)) AS n_keys FROM events")
def _(t):
    value, n = admin.first_member(F.col("props"))
    return t.raw("events").select("event_id", value.alias("first_value"), n.alias("n_keys"))


# ---- keyword channel

WORDS = ["the", "er"]
_PREFIX = "list_filter(toks, lambda x: starts_with(x, '{0}'))"


def _bm25(terms: list[tuple[str, bool]], source: str, key: str, every: bool, fields: str) -> str:
    """terms: (word, prefix). source: rows with toks and dl, and fields."""
    count = [f"len({_PREFIX.format(w)})" if p else f"len(list_filter(toks, lambda x: x = '{w}'))" for w, p in terms]
    f = ", ".join(f"{c} * m AS f{i}" for i, c in enumerate(count))
    df = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(len(terms)))
    part = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / average))" for i in range(len(terms)))
    hit = (" AND " if every else " OR ").join(f"f{i} > 0" for i in range(len(terms)))
    return f"SELECT {fields}, -({part}) AS score FROM (SELECT *, {f} FROM ({source})) c, (SELECT count(*) AS n, avg(dl) AS average, {df} FROM (SELECT *, {f} FROM ({source}))) s WHERE {hit} ORDER BY score, {key} LIMIT 200"


_BODY = f"SELECT chunk_id, file_id, source_type, toks, 2 AS m, 2.0 * len(toks) AS dl FROM (SELECT *, {_TOK.format('chunk_text')} AS toks FROM chunks WHERE source_type IN ('doc_chunk', 'ocr'))"
_NAME = f"SELECT file_id, toks, 1 AS m, 1.0 * len(toks) AS dl FROM (SELECT file_id, list_concat(list_concat({_TOK.format('filename')}, {_TOK.format('filename')}), {_TOK.format('dir_path')}) AS toks FROM files)"
_FIELDS = "chunk_id, file_id, source_type"
BODY = ["chunk_text", "chunk_text"]


def _bodies(t):
    return t.chunks.where(F.col("source_type").isin(*search.BODY_TYPES))


def _names(t):
    return t.files.select("file_id", "filename", "dir_path")


NAME = ["filename", "filename", "dir_path"]


def _body_index(t):
    return bm25.standing("bodies", t.dir, _bodies(t), BODY, "chunk_id", ("file_id", "source_type"))


def _name_index(t):
    return bm25.standing("names", t.dir, _names(t), NAME, "file_id")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _scan_query(name: str, terms, every: bool, where: str, scan: bool = False):
    body = where == "body"
    inner = _bm25(terms, _BODY if body else _NAME, "chunk_id" if body else "file_id", every, _FIELDS if body else "file_id")
    fields = _FIELDS if body else "file_id"

    @query(name, f"SELECT {fields}, round(score, 6) AS score FROM ({inner})", *(["chunks"] if body else ["files"]))
    def _(t):
        q = bm25.Query(tuple(bm25.Term((w,), p) for w, p in terms), every)
        if scan:
            out = bm25.scan(_bodies(t), BODY, q, key="chunk_id") if body else bm25.scan(_names(t), NAME, q)
        else:
            out = (_body_index(t) if body else _name_index(t)).search(q)
        return _rounded(out.select(*[c.strip() for c in fields.split(",")], "score"), "score")


_scan_query("bm25_body_or", [("that", True), ("erth", True)], False, "body")
_scan_query("bm25_body_and", [("that", True), ("erth", True)], True, "body")
_scan_query("bm25_body_prefix", [("thes", True)], True, "body")
_scan_query("bm25_body_word", [("with", False)], True, "body")
_scan_query("bm25_filename", [("pdf", True), ("en", True)], True, "names")
# The same without an index, in one pass over the texts.
_scan_query("bm25_body_scan", [("that", True), ("erth", True)], True, "body", scan=True)
_scan_query("bm25_filename_scan", [("pdf", True), ("en", True)], False, "names", scan=True)


@query("bm25_phrase", f"""SELECT chunk_id, file_id, round(-(greatest(ln((n - d + 0.5) / (d + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / average))), 6) AS score FROM
(SELECT *, 2 * len(list_filter(range(1, len(toks)), lambda i: toks[i] = 'of' AND toks[i + 1] = 'the')) AS f FROM ({_BODY})) c,
(SELECT count(*) AS n, avg(dl) AS average, count(*) FILTER (WHERE len(list_filter(range(1, len(toks)), lambda i: toks[i] = 'of' AND toks[i + 1] = 'the')) > 0) AS d FROM ({_BODY})) s
WHERE f > 0 ORDER BY -(greatest(ln((n - d + 0.5) / (d + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / average))), chunk_id LIMIT 200""", "chunks")
def _(t):
    q = bm25.Query((bm25.Term(("of", "the")),))
    return _rounded(_body_index(t).search(q).select("chunk_id", "file_id", "score"), "score")


@query("bm25_df_stats", f"SELECT term, count(DISTINCT chunk_id) AS df, 2 * count(*) AS cf FROM (SELECT chunk_id, unnest(toks) AS term FROM ({_BODY})) GROUP BY term", "chunks")
def _(t):
    return _body_index(t).statistics()


@query("bm25_index_update", "SELECT chunk_id, round(score, 6) AS score FROM (" + _bm25([("that", True), ("erth", True)], f"SELECT chunk_id, CASE WHEN file_id % 5 = 0 THEN ['that', 'that', 'erth'] ELSE toks END AS toks, m, CASE WHEN file_id % 5 = 0 THEN 6.0 ELSE dl END AS dl FROM ({_BODY}) WHERE file_id % 7 <> 0", "chunk_id", True, "chunk_id") + ")", "chunks")
def _(t):
    """An index from which some rows are taken, and others put in anew."""
    bodies = _bodies(t)
    index = bm25.Index(t.spark, shared_path(t.spark, "index-update"), BODY, "chunk_id").build(bodies)
    index.update(gone=bodies.where("file_id % 7 = 0"), fresh=bodies.where("file_id % 5 = 0 AND file_id % 7 <> 0").withColumn("chunk_text", F.lit("That, that erth")))
    return _rounded(index.search(bm25.forms(["that", "erth"])[1]), "score")


@query("bm25_index_integrity", "SELECT chunk_id, 'no row' AS problem FROM chunks WHERE source_type IN ('doc_chunk', 'ocr') AND file_id % 50 = 0", "chunks")
def _(t):
    return _body_index(t).integrity(_bodies(t).where("file_id % 50 <> 0"))


_KW_TERMS = [("en", True), ("thes", True)]
_KW = f"""names AS ({_bm25(_KW_TERMS, _NAME, 'file_id', False, 'file_id')}), bodies AS ({_bm25(_KW_TERMS, _BODY, 'chunk_id', False, _FIELDS)}),
merged AS (SELECT file_id, CASE WHEN count(*) FILTER (WHERE channel = 'f') = 0 THEN 0.0 ELSE max(own) END AS reference, max(-own) AS relevance, count(*) AS n_evidence
FROM (SELECT file_id, score AS own, 'f' AS channel FROM names UNION ALL SELECT file_id, score, 'b' FROM bodies) GROUP BY file_id)"""


def _kw_sql(mode: str) -> str:
    head = sql("", "files", "chunks").rstrip()
    return f"{head}, {_KW} SELECT file_id, round({mode}, 6) AS score, row_number() OVER (ORDER BY {mode} DESC, file_id) AS rank, n_evidence FROM merged ORDER BY {mode} DESC, file_id LIMIT 200"


def _keyword(t, mode: str) -> DataFrame:
    q = bm25.Query(tuple(bm25.Term((w,), p) for w, p in _KW_TERMS), False)
    return search.merge_keyword(_name_index(t).search(q), _body_index(t).search(q), mode)


for _mode in ("reference", "relevance"):

    @query(f"kw_merge_{_mode}")
    def _(t, mode=_mode):
        return _rounded(_keyword(t, mode).select("file_id", "score", F.col("rank").cast("long").alias("rank"), F.size("evidence").cast("long").alias("n_evidence")), "score")

    _SQL[f"kw_merge_{_mode}"] = _kw_sql(_mode)


@query("kw_form_fallback", "SELECT chunk_id, file_id, round(score, 6) AS score FROM (" + _bm25([("that", True), ("zzzz", True)], _BODY, "chunk_id", False, _FIELDS) + ")", "chunks")
def _(t):
    hits = (_body_index(t).search(q) for q in bm25.forms(["that", "zzzz"]))
    return _rounded(search.by_form(hits).select("chunk_id", "file_id", "score"), "score")


# ---- vectors, fusion, results

_V = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM points WHERE vec_id = 7)"
_NEAR = f"SELECT vec_id, file_id, source_type, chunk_index, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS score FROM points, {_V} v ORDER BY score DESC, vec_id LIMIT 200"
_SEM = f"""near AS ({_NEAR}), best AS (SELECT n.*, row_number() OVER (PARTITION BY n.file_id ORDER BY score DESC, vec_id) AS r FROM near n
JOIN files f ON f.file_id = n.file_id AND is_deleted = 0 WHERE (n.file_id, n.source_type, n.chunk_index) IN (SELECT (file_id, source_type, chunk_index) FROM chunks)),
sem AS (SELECT file_id, score, source_type, chunk_index, row_number() OVER (ORDER BY score DESC, file_id) AS rank FROM best WHERE r = 1)"""


def _vector(t) -> list[float]:
    return [float(x) for x in t.points.where("vec_id = 7").select("embedding").head()[0]]


@query("cosine_topk", f"SELECT vec_id, file_id, round(score, 6) AS score FROM ({_NEAR})", "points")
def _(t):
    return _rounded(search.nearest(t.points, _vector(t)).select("vec_id", "file_id", "score"), "score")


@query("cosine_dedup_max", f"SELECT file_id, round(max(score), 6) AS score FROM ({_NEAR}) GROUP BY file_id", "points")
def _(t):
    return _rounded(search.nearest(t.points, _vector(t)).groupBy("file_id").agg(F.max("score").alias("score")), "score")


@query("point_triple_semi", "SELECT vec_id FROM points WHERE (file_id, source_type, chunk_index) IN (SELECT (file_id, source_type, chunk_index) FROM chunks)", "points", "chunks")
def _(t):
    return t.points.join(t.chunks.select(search.TRIPLE), search.TRIPLE, "left_semi").select("vec_id")


@query("semantic_channel")
def _(t):
    out = search.semantic(t.points, t.chunks, t.files, t.exif, _vector(t))
    return _rounded(out.select("file_id", "score", "source_type", "chunk_index", F.col("rank").cast("long").alias("rank")), "score")


_SQL["semantic_channel"] = sql("", "files", "chunks", "points").rstrip() + f", {_SEM} SELECT file_id, round(score, 6) AS score, source_type, chunk_index, rank FROM sem"


def _fused_sql(wk: float, ws: float) -> str:
    head = sql("", "files", "exif", "chunks", "points").rstrip()
    return f"""{head}, {_KW}, {_SEM}, kw AS (SELECT file_id, reference AS score, row_number() OVER (ORDER BY reference DESC, file_id) AS rank FROM merged ORDER BY rank LIMIT 200),
fused AS (SELECT file_id, coalesce({wk} / (60 + kw.rank), 0) + coalesce({ws} / (60 + sem.rank), 0) AS rrf, kw.score AS keyword_score, sem.score AS semantic_score FROM kw FULL JOIN sem USING (file_id))"""


def _fused(t, wk: float = 1.0, ws: float = 1.0):
    return search.fuse(search.held(_keyword(t, "reference")), search.held(search.semantic(t.points, t.chunks, t.files, t.exif, _vector(t))), wk, ws)


for _name, _wk, _ws in (("rrf_fuse", 1.0, 1.0), ("rrf_weighted", 10.0, 1.0)):

    @query(_name)
    def _(t, wk=_wk, ws=_ws):
        return _fused(t, wk, ws).select("file_id", F.round("rrf_score", 9).alias("rrf_score"), F.round("keyword_score", 6).alias("keyword_score"), F.round("semantic_score", 6).alias("semantic_score"))

    _SQL[_name] = _fused_sql(_wk, _ws) + " SELECT file_id, round(rrf, 9) AS rrf_score, round(keyword_score, 6) AS keyword_score, round(semantic_score, 6) AS semantic_score FROM fused"


_HYBRID = """ SELECT f.file_id, path, filename, dir_path, extension, file_type, size_bytes, mtime_ns, round(rrf, 9) AS rrf_score, round(keyword_score, 6) AS keyword_score, round(semantic_score, 6) AS semantic_score,
CASE WHEN taken_epoch IS NULL THEN 'mtime' ELSE 'exif' END AS time_basis, CASE WHEN taken_epoch IS NULL THEN 'fallback' ELSE 'exact' END AS time_confidence, strftime(to_timestamp(coalesce(taken_epoch, mtime_ns // 1000000000)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00' AS time_shown
FROM (SELECT * FROM fused ORDER BY rrf DESC, file_id LIMIT 50) t JOIN files f ON f.file_id = t.file_id AND is_deleted = 0 LEFT JOIN exif x ON x.file_id = f.file_id"""


@query("hybrid_search")
def hybrid(t):
    kw, sem = search.held(_keyword(t, "reference")), search.held(search.semantic(t.points, t.chunks, t.files, t.exif, _vector(t)))
    out = search.finalize(search.fuse(kw, sem), t.files, t.exif, t.chunks, kw, sem, UnifiedFilter())
    time = [F.col(f"time_info.{a}").alias(f"time_{b}") for a, b in (("basis", "basis"), ("confidence", "confidence"), ("value", "shown"))]
    return out.select(*search.RESULT[:8], F.round("rrf_score", 9).alias("rrf_score"), F.round("keyword_score", 6).alias("keyword_score"), F.round("semantic_score", 6).alias("semantic_score"), *time)


_SQL["hybrid_search"] = _fused_sql(1.0, 1.0) + _HYBRID


@query("match_reasons")
def _(t):
    kw, sem = search.held(_keyword(t, "reference")), search.held(search.semantic(t.points, t.chunks, t.files, t.exif, _vector(t)))
    out = search.finalize(search.fuse(kw, sem), t.files, t.exif, t.chunks, kw, sem, UnifiedFilter())
    return out.select("file_id", F.explode("match_reasons").alias("r")).groupBy("file_id", "r.channel").agg(F.count(F.lit(1)).alias("n"), F.max("r.text").alias("last_text"))


_SQL["match_reasons"] = _fused_sql(1.0, 1.0) + """ , top AS (SELECT t.file_id FROM (SELECT * FROM fused ORDER BY rrf DESC, file_id LIMIT 50) t JOIN files f ON f.file_id = t.file_id AND is_deleted = 0),
said AS (SELECT file_id, 'filename' AS channel, NULL AS text FROM names WHERE file_id IN (SELECT file_id FROM kw)
UNION ALL SELECT b.file_id, 'body', substr(chunk_text, 1, 80) FROM bodies b JOIN chunks c USING (chunk_id) WHERE b.file_id IN (SELECT file_id FROM kw)
UNION ALL SELECT s.file_id, 'semantic', substr(chunk_text, 1, 80) FROM sem s LEFT JOIN chunks c ON s.file_id = c.file_id AND s.source_type = c.source_type AND s.chunk_index = c.chunk_index)
SELECT file_id, channel, count(*) AS n, max(text) AS last_text FROM said WHERE file_id IN (SELECT file_id FROM top) GROUP BY file_id, channel"""


@query("time_info", """SELECT f.file_id, CASE WHEN taken_epoch IS NULL THEN 'mtime' ELSE 'exif' END AS basis, CASE WHEN taken_epoch IS NULL THEN 'fallback' ELSE 'exact' END AS confidence,
strftime(to_timestamp(coalesce(taken_epoch, mtime_ns // 1000000000)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00' AS shown FROM files f LEFT JOIN exif e ON f.file_id = e.file_id""", "files", "exif")
def _(t):
    return with_exif(t.files, t.exif).withColumn("i", search.time_info("exif")).select("file_id", "i.basis", "i.confidence", F.col("i.value").alias("shown"))


@query("labels_top3", "SELECT p.vec_id, coalesce(caption, '') AS caption FROM points p LEFT JOIN (SELECT vec_id, string_agg(printf('%02d', label_id), '，' ORDER BY score DESC, label_id) AS caption FROM (SELECT a.vec_id, l.label_id, score, row_number() OVER (PARTITION BY a.vec_id ORDER BY score DESC, label_id) AS r FROM (SELECT p.vec_id, l.vec_id AS label_id, list_cosine_similarity(CAST(p.embedding AS DOUBLE[]), CAST(l.embedding AS DOUBLE[])) AS score FROM points p, points l WHERE l.vec_id < 12) a JOIN (SELECT vec_id AS label_id FROM points) l USING (label_id)) WHERE r <= 3 AND score >= 0.2 GROUP BY vec_id) c ON p.vec_id = c.vec_id", "points")
def _(t):
    labels = t.points.where("vec_id < 12").select(F.format_string("%02d", "vec_id").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))  # a vocabulary of 12
    text, vocabulary = processing.caption(F.col("embedding"), labels)
    # One row, of the vocabulary's size.
    return t.points.crossJoin(F.broadcast(vocabulary)).select("vec_id", text.alias("caption"))


# ---- tasks

@query("task_stats", "SELECT count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'RUNNING') AS running, count(*) FILTER (WHERE status = 'SUCCESS') AS success, count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) AS total FROM tasks", "tasks")
def _(t):
    return tasks.stats(t.tasks)


@query("task_claim", "SELECT task_id, file_id, 'RUNNING' AS status, CAST(attempt + 1 AS INT) AS attempt FROM tasks WHERE status = 'PENDING' ORDER BY priority, task_id LIMIT 8", "tasks")
def _(t):
    return tasks.claim(t.tasks).select("task_id", "file_id", "status", "attempt")


_DUE = "due AS (SELECT task_id, file_id FROM tasks WHERE status = 'PENDING' ORDER BY priority, task_id LIMIT 8)"


@query("task_claim_tasks")
def _(t):
    return tasks.claimed(t.tasks, t.files, 999)[0].select("task_id", "status", "attempt", "updated_at", "last_error")


_SQL["task_claim_tasks"] = sql("", "tasks").rstrip() + f", {_DUE} SELECT t.task_id, CASE WHEN d.task_id IS NULL THEN status ELSE 'RUNNING' END AS status, CAST(attempt + CASE WHEN d.task_id IS NULL THEN 0 ELSE 1 END AS INT) AS attempt, CASE WHEN d.task_id IS NULL THEN updated_at ELSE 999 END AS updated_at, last_error FROM tasks t LEFT JOIN due d ON t.task_id = d.task_id"


@query("task_claim_files")
def _(t):
    return tasks.claimed(t.tasks, t.files, 999)[1].select("file_id", "status")


_SQL["task_claim_files"] = sql("", "tasks", "files").rstrip() + f", {_DUE} SELECT file_id, CASE WHEN file_id IN (SELECT file_id FROM due) THEN 'PROCESSING' ELSE status END AS status FROM files"


@query("task_with_files", "SELECT task_id, t.file_id, path, file_type FROM tasks t JOIN files f ON t.file_id = f.file_id WHERE t.status = 'RUNNING'", "tasks", "files")
def _(t):
    return tasks.with_files(t.tasks, t.files, t.tasks.where("status = 'RUNNING'"))


@query("task_failed_list", "SELECT task_id, t.file_id, coalesce(filename, '<deleted>') AS filename, attempt, updated_at FROM (SELECT * FROM tasks WHERE status = 'FAILED' ORDER BY updated_at DESC, task_id LIMIT 50) t LEFT JOIN files f ON t.file_id = f.file_id", "tasks", "files")
def _(t):
    return tasks.failed(t.tasks, t.files)


@query("task_retry_status", "SELECT w.task_id, CASE WHEN status IS NULL THEN 'NOT_FOUND' WHEN attempt >= max_attempts THEN 'MAX_ATTEMPTS' WHEN status <> 'FAILED' THEN 'NOT_FAILED' ELSE 'RETRIED' END AS result FROM (SELECT l_orderkey + l_linenumber - 1 AS task_id FROM lineitem) w LEFT JOIN tasks t ON w.task_id = t.task_id", "tasks")
def _(t):
    return tasks.retry(t.tasks, t.raw("lineitem").select((F.col("l_orderkey") + F.col("l_linenumber") - 1).alias("task_id")))


@query("task_retried", "SELECT t.task_id, CASE WHEN w.task_id IS NOT NULL AND attempt < max_attempts AND status = 'FAILED' THEN 'PENDING' ELSE status END AS status, CASE WHEN w.task_id IS NOT NULL AND attempt < max_attempts AND status = 'FAILED' THEN 999 ELSE updated_at END AS updated_at FROM tasks t LEFT JOIN (SELECT DISTINCT o_custkey AS task_id FROM orders) w ON t.task_id = w.task_id", "tasks")
def _(t):
    return tasks.retried(t.tasks, t.raw("orders").select(F.col("o_custkey").alias("task_id")), 999).select("task_id", "status", "updated_at")


@query("task_reindex_status", "SELECT w.task_id, t.file_id, CASE WHEN t.file_id IS NULL THEN 'NOT_FOUND' WHEN t.file_id IN (SELECT file_id FROM tasks WHERE status IN ('PENDING', 'RUNNING')) THEN 'ALREADY_ACTIVE' ELSE 'QUEUED' END AS result FROM (SELECT o_custkey AS task_id FROM orders) w LEFT JOIN tasks t ON w.task_id = t.task_id", "tasks")
def _(t):
    return tasks.reindex(t.tasks, t.raw("orders").select(F.col("o_custkey").alias("task_id")))


@query("task_reindexed", "SELECT CASE WHEN fresh THEN NULL ELSE task_id END AS known_id, file_id, priority, status, attempt FROM (SELECT false AS fresh, task_id, file_id, priority, status, attempt FROM tasks UNION ALL SELECT true, NULL, file_id, 0, 'PENDING', 0 FROM (SELECT DISTINCT file_id FROM tasks WHERE task_id IN (SELECT o_custkey FROM orders) AND file_id NOT IN (SELECT file_id FROM tasks WHERE status IN ('PENDING', 'RUNNING'))))", "tasks")
def _(t):
    out = tasks.reindexed(t.tasks, t.raw("orders").select(F.col("o_custkey").alias("task_id")), 999).withColumn("fresh", F.col("updated_at") == 999)
    known = t.tasks.select(F.col("task_id").alias("known_id"))
    return out.join(known, out["task_id"] == known["known_id"], "left").select("known_id", "file_id", "priority", "status", "attempt")


@query("task_enqueue_anti", "SELECT file_id, 1 AS priority, 'PENDING' AS status FROM files WHERE file_type IN ('doc', 'image') AND status = 'METADATA_ONLY' AND is_deleted = 0 AND file_id NOT IN (SELECT file_id FROM tasks WHERE status IN ('PENDING', 'RUNNING'))", "files", "tasks")
def _(t):
    return tasks.enqueue(t.tasks, t.files)


@query("task_recover", "SELECT task_id, CASE WHEN status = 'RUNNING' THEN 'PENDING' ELSE status END AS status FROM tasks", "tasks")
def _(t):
    return tasks.recover(t.tasks).select("task_id", "status")


@query("task_finish", "SELECT task_id, CASE WHEN task_id % 3 = 0 THEN 'SUCCESS' WHEN task_id % 3 = 1 THEN 'FAILED' ELSE status END AS status, CASE WHEN task_id % 3 = 1 THEN 'broken' ELSE last_error END AS last_error, CASE WHEN task_id % 3 < 2 THEN 999 ELSE updated_at END AS updated_at FROM tasks", "tasks")
def _(t):
    return tasks.finish(t.tasks, _ends(t), 999).select("task_id", "status", "last_error", "updated_at")


def _ends(t):
    return t.tasks.where("task_id % 3 < 2").select("task_id", F.when(F.col("task_id") % 3 == 1, "broken").alias("error"))


@query("task_finish_files", "SELECT f.file_id, coalesce(said, status) AS status FROM files f LEFT JOIN (SELECT file_id, arg_max(CASE WHEN task_id % 3 = 0 THEN 'AI_DONE' ELSE 'FAILED' END, task_id) AS said FROM tasks WHERE task_id % 3 < 2 GROUP BY file_id) t ON f.file_id = t.file_id", "tasks", "files")
def _(t):
    return tasks.finish_files(t.files, t.tasks, _ends(t)).select("file_id", "status")


@query("job_latest", "SELECT file_id, arg_max(task_id, (updated_at, task_id)) AS task_id, arg_max(status, (updated_at, task_id)) AS status, max(updated_at) AS updated_at FROM tasks GROUP BY file_id", "tasks")
def _(t):
    return tasks.last_per_file(t.tasks)


# ---- snapshots

_SCAN = "scanned AS (SELECT CASE WHEN file_id % 10 = 9 THEN '/new' || path ELSE path END AS path, filename, CASE WHEN file_id % 15 = 0 THEN dir_path || '/x' ELSE dir_path END AS dir_path, extension, file_type, CASE WHEN file_id % 6 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, mtime_ns, ctime_ns FROM files WHERE file_id % 11 <> 0)"


def _scanned(t):
    rows = t.files.where("file_id % 11 <> 0")
    return rows.select(F.expr("CASE WHEN file_id % 10 = 9 THEN '/new' || path ELSE path END").alias("path"), "filename", F.expr("CASE WHEN file_id % 15 = 0 THEN dir_path || '/x' ELSE dir_path END").alias("dir_path"), "extension", "file_type", F.expr("CASE WHEN file_id % 6 = 0 THEN size_bytes + 1 ELSE size_bytes END").alias("size_bytes"), "mtime_ns", "ctime_ns")


@query("upsert_snapshot")
def _(t):
    out = ingest.upsert(t.files, _scanned(t))
    return out.select(F.when(F.col("op") == "insert", F.lit(None)).otherwise(F.col("file_id")).alias("known_id"), "path", "size_bytes", "content_hash", "status", "is_deleted", "op", "index_op")


_SQL["upsert_snapshot"] = sql("", "files").rstrip() + f""", {_SCAN} SELECT f.file_id AS known_id, coalesce(f.path, s.path) AS path, coalesce(s.size_bytes, f.size_bytes) AS size_bytes, f.content_hash,
CASE WHEN f.file_id IS NULL OR (s.path IS NOT NULL AND f.is_deleted = 1) THEN 'insert' WHEN s.path IS NOT NULL AND (s.filename <> f.filename OR s.dir_path <> f.dir_path) THEN 'replace' END AS index_op,
CASE WHEN f.file_id IS NULL OR (s.path IS NOT NULL AND f.is_deleted = 1) OR (s.path IS NOT NULL AND (s.size_bytes <> f.size_bytes OR s.mtime_ns <> f.mtime_ns) AND f.status = 'AI_DONE') THEN 'METADATA_ONLY' ELSE f.status END AS status,
CASE WHEN s.path IS NOT NULL THEN 0 ELSE f.is_deleted END AS is_deleted,
CASE WHEN f.file_id IS NULL THEN 'insert' WHEN s.path IS NOT NULL AND f.is_deleted = 1 THEN 'revive' WHEN s.path IS NOT NULL AND (s.size_bytes <> f.size_bytes OR s.mtime_ns <> f.mtime_ns) THEN 'update' ELSE 'keep' END AS op
FROM files f FULL JOIN scanned s ON f.path = s.path"""


@query("upsert_new_ids")
def _(t):
    out = ingest.upsert(t.files, _scanned(t)).where("op = 'insert'")
    return out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_id").alias("n_ids"), F.min("file_id").alias("lo"), F.max("file_id").alias("hi"))


_SQL["upsert_new_ids"] = sql("", "files").rstrip() + f", {_SCAN}, new AS (SELECT path FROM scanned WHERE path NOT IN (SELECT path FROM files)) SELECT count(*) AS n, count(*) AS n_ids, (SELECT max(file_id) FROM files) + 1 AS lo, (SELECT max(file_id) FROM files) + count(*) AS hi FROM new"


@query("delete_sync_anti")
def _(t):
    return ingest.missing_on_disk(t.files, _scanned(t)).select("file_id", "path")


_SQL["delete_sync_anti"] = sql("", "files").rstrip() + f", {_SCAN} SELECT file_id, path FROM files WHERE is_deleted = 0 AND path NOT IN (SELECT path FROM scanned)"


@query("soft_delete", "SELECT file_id, CASE WHEN file_id % 13 = 0 THEN 1 ELSE is_deleted END AS is_deleted FROM files", "files")
def _(t):
    return ingest.soft_delete(t.files, t.files.where("file_id % 13 = 0")).select("file_id", "is_deleted")


@query("cascade_semi", "SELECT chunk_id FROM chunks WHERE file_id IN (SELECT file_id FROM files WHERE is_deleted = 0)", "chunks", "files")
def _(t):
    return ingest.cascade(t.chunks, t.files.where("is_deleted = 0")).select("chunk_id")


@query("replace_chunks", "SELECT file_id, count(*) AS n, min(chunk_text) AS least FROM (SELECT file_id, chunk_text FROM chunks WHERE file_id % 7 <> 0 UNION ALL SELECT file_id, 'fresh' FROM files WHERE file_id % 7 = 0) GROUP BY file_id", "chunks", "files")
def _(t):
    fresh = t.files.where("file_id % 7 = 0").select(F.lit(-1).cast("long").alias("chunk_id"), "file_id", F.lit("doc_chunk").alias("source_type"), F.lit(0).alias("chunk_index"), F.lit("fresh").alias("chunk_text"), F.lit(0).alias("embedding_status"))
    return ingest.replace_chunks(t.chunks, fresh).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_text").alias("least"))


@query("upsert_points", "SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN -1 ELSE file_id END AS file_id FROM points", "points")
def _(t):
    fresh = t.points.where("vec_id % 4 = 0").withColumn("file_id", F.lit(-1).cast("long"))
    return ingest.upsert_points(t.points, fresh).select("vec_id", "file_id")


@query("chunk_counts", "SELECT file_id, source_type, count(*) AS n, sum(CASE WHEN embedding_status = 1 THEN 1 ELSE 0 END)::BIGINT AS done FROM chunks GROUP BY ALL", "chunks")
def _(t):
    return t.chunks.groupBy("file_id", "source_type").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("embedding_status") == 1).cast("long")).alias("done"))


_COMPLETE = """complete AS (SELECT f.file_id, file_type, coalesce(n, 0) AS n, coalesce(done, 0)::BIGINT AS done,
CASE WHEN file_type = 'doc' THEN coalesce(d, 0) > 0 AND d = dd ELSE f.file_id IN (SELECT file_id FROM ocr) AND coalesce(i, 0) > 0 AND i = di END AS ai_complete
FROM files f LEFT JOIN (SELECT file_id, count(*) AS n, count(*) FILTER (WHERE embedding_status = 1) AS done, count(*) FILTER (WHERE source_type = 'doc_chunk') AS d, count(*) FILTER (WHERE source_type = 'doc_chunk' AND embedding_status = 1) AS dd,
count(*) FILTER (WHERE source_type <> 'doc_chunk') AS i, count(*) FILTER (WHERE source_type <> 'doc_chunk' AND embedding_status = 1) AS di FROM chunks GROUP BY file_id) c ON f.file_id = c.file_id)"""


@query("ai_completeness")
def _(t):
    return ingest.completeness(t.files, t.chunks, t.ocr)


_SQL["ai_completeness"] = sql("", "files", "chunks", "ocr").rstrip() + f", {_COMPLETE} SELECT * FROM complete"

#: What is read of the files now: a tenth have changed, another tenth hold what their neighbour holds.
_FRESH = "fresh AS (SELECT file_id, CASE WHEN file_id % 10 = 9 THEN 'changed' WHEN file_id % 10 = 4 THEN lead_hash ELSE content_hash END AS hash FROM (SELECT *, md5(file_id::VARCHAR) AS own, (SELECT content_hash FROM files y WHERE y.file_id = x.file_id + 8) AS lead_hash FROM files x) WHERE is_deleted = 0 AND file_type IN ('doc', 'image') AND CASE WHEN file_id % 10 = 4 THEN lead_hash ELSE '' END IS NOT NULL)"
_REUSE = f"""{_COMPLETE}, {_FRESH}, source AS (SELECT r.file_id, min(x.file_id) AS source_id FROM fresh r JOIN files f ON f.file_id = r.file_id JOIN files x ON x.content_hash = r.hash AND x.file_type = f.file_type AND x.file_id <> f.file_id GROUP BY r.file_id),
reuse AS (SELECT r.file_id, r.hash, CASE WHEN f.content_hash = r.hash AND c.ai_complete THEN 'same_file' WHEN o.ai_complete THEN 'clone' ELSE 'none' END AS verdict, source_id AS src
FROM fresh r JOIN files f ON f.file_id = r.file_id LEFT JOIN complete c ON c.file_id = r.file_id LEFT JOIN source s ON s.file_id = r.file_id LEFT JOIN complete o ON o.file_id = s.source_id)"""


def _fresh(t):
    files = t.files
    lead = files.select((F.col("file_id") - 8).alias("file_id"), F.col("content_hash").alias("lead_hash"))
    hash_ = F.expr("CASE WHEN file_id % 10 = 9 THEN 'changed' WHEN file_id % 10 = 4 THEN lead_hash ELSE content_hash END")
    return files.where("is_deleted = 0 AND file_type IN ('doc', 'image')").join(lead, "file_id", "left").select("file_id", hash_.alias("hash")).where("hash IS NOT NULL")


def _reuse(t):
    return ingest.reuse(t.files, _fresh(t), ingest.completeness(t.files, t.chunks, t.ocr))


@query("hash_reuse_source")
def _(t):
    return _reuse(t)


_SQL["hash_reuse_source"] = sql("", "files", "chunks", "ocr").rstrip() + f", {_REUSE} SELECT file_id, hash, verdict, CASE WHEN verdict = 'clone' THEN src END AS source_id FROM reuse WHERE hash IS NOT NULL"


@query("clone_chunks")
def _(t):
    return ingest.clone_chunks(t.chunks, _reuse(t).where("verdict = 'clone'"))


_SQL["clone_chunks"] = sql("", "files", "chunks", "ocr").rstrip() + f", {_REUSE} SELECT r.file_id, src AS source_id, source_type, chunk_index, chunk_text, embedding_status FROM reuse r JOIN chunks c ON c.file_id = r.src WHERE verdict = 'clone'"


@query("clone_points")
def _(t):
    return ingest.clone_points(t.points, _reuse(t).where("verdict = 'clone'"), t.chunks).select("file_id", "source_type", "chunk_index", "vec_id")


_SQL["clone_points"] = sql("", "files", "chunks", "ocr", "points").rstrip() + f", {_REUSE} SELECT r.file_id, p.source_type, p.chunk_index, p.vec_id FROM reuse r JOIN points p ON p.file_id = r.src WHERE verdict = 'clone' AND EXISTS (SELECT 1 FROM chunks c WHERE c.file_id = p.file_id AND c.source_type = p.source_type AND c.chunk_index = p.chunk_index AND c.embedding_status = 1)"


@query("stale_points", "SELECT vec_id FROM points p WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.file_id = p.file_id AND c.source_type = p.source_type AND c.chunk_index = p.chunk_index)", "points", "chunks")
def _(t):
    return ingest.stale_points(t.points, t.chunks).select("vec_id")


@query("missing_vectors", "SELECT file_id, count(*) AS n_missing FROM chunks c WHERE embedding_status = 1 AND NOT EXISTS (SELECT 1 FROM points p WHERE c.file_id = p.file_id AND c.source_type = p.source_type AND c.chunk_index = p.chunk_index) GROUP BY file_id", "points", "chunks")
def _(t):
    return ingest.missing_vectors(t.chunks, t.points)


@query("integrity_check", "SELECT file_id, 'no postings' AS problem FROM files WHERE file_id NOT IN (SELECT file_id FROM chunks WHERE source_type IN ('doc_chunk', 'ocr'))", "files", "chunks")
def _(t):
    return ingest.integrity(_bodies(t), t.files)


@query("storage_bytes", "SELECT file_type, sum(size_bytes)::BIGINT AS bytes, count(*) AS n FROM files WHERE is_deleted = 0 GROUP BY file_type", "files")
def _(t):
    return admin.storage(t.files)


@query("latency_percentiles", "SELECT o_orderpriority, count(*) AS n, list_sort(list(o_totalprice))[least(count(*) - 1, (count(*) * 0.5)::BIGINT - CASE WHEN (count(*) * 0.5)::BIGINT > count(*) * 0.5 THEN 1 ELSE 0 END) + 1] AS p50, list_sort(list(o_totalprice))[least(count(*) - 1, floor(count(*) * 0.95)::BIGINT) + 1] AS p95 FROM orders GROUP BY 1")
def _(t):
    return admin.ranks(t.raw("orders"), "o_orderpriority", "o_totalprice", {"p50": 0.5, "p95": 0.95}, 1000)


# ---- events

@query("event_coalesce", "SELECT path, CASE WHEN 'deleted' IN (SELECT unnest(k)) AND 'created' IN (SELECT unnest(k)) THEN NULL WHEN 'deleted' IN (SELECT unnest(k)) THEN 'delete' ELSE 'change' END AS action FROM (SELECT path, list(DISTINCT kind) AS k FROM changes GROUP BY path)", "changes")
def _(t):
    return t.changes.groupBy("path").agg(events.coalesce_kinds(F.collect_set("kind")).alias("action"))


_WINDOWS = """e AS (SELECT event_id, epoch_us(ts) AS us, ts, path, kind, dest FROM changes),
g AS (SELECT us, CASE WHEN lag(us) OVER (ORDER BY us) IS NULL OR us - lag(us) OVER (ORDER BY us) >= 2000000 THEN 1 ELSE 0 END AS fresh FROM (SELECT DISTINCT us FROM e)),
s AS (SELECT us, min(us) OVER (PARTITION BY grp) AS start FROM (SELECT us, sum(fresh) OVER (ORDER BY us) AS grp FROM g)),
w AS (SELECT e.*, start FROM e JOIN s ON e.us = s.us),
named AS (SELECT start, path AS p, us, event_id FROM w WHERE kind = 'moved' UNION ALL SELECT start, dest, us, event_id FROM w WHERE kind = 'moved'),
pending AS (SELECT * FROM w WHERE kind <> 'moved' AND NOT EXISTS (SELECT 1 FROM named m WHERE m.start = w.start AND m.p = w.path AND (m.us > w.us OR (m.us = w.us AND m.event_id > w.event_id))))"""


@query("event_debounce_session")
def _(t):
    return events.debounce(t.changes).withColumn("flush_start", F.unix_micros("flush_start"))


_SQL["event_debounce_session"] = sql("", "changes").rstrip() + f""", {_WINDOWS}, b AS (SELECT start, path, bool_or(kind = 'deleted') AS d, bool_or(kind = 'created') AS c FROM pending GROUP BY start, path)
SELECT start AS flush_start, CASE WHEN d THEN 2 ELSE 1 END AS step, CASE WHEN d THEN 'delete' ELSE 'change' END AS action, path, NULL AS target FROM b WHERE NOT (d AND c)
UNION ALL SELECT start, 3, 'rename', path, dest FROM w WHERE kind = 'moved'"""


@query("event_path_sessions", """, g AS (SELECT path, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY path ORDER BY ts)) >= 600000000 OR lag(ts) OVER (PARTITION BY path ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM changes),
s AS (SELECT path, ts, sum(fresh) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS grp FROM g)
SELECT path, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n_events FROM s GROUP BY path, grp""", "changes")
def _(t):
    return events.sessions(t.changes).select("path", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n_events")


_SQL["event_path_sessions"] = _SQL["event_path_sessions"].replace(") , g AS", "), g AS")


@query("event_moves")
def _(t):
    return events.forget_moved(events.windows(t.changes)).select("event_id", "path", "kind")


_SQL["event_moves"] = sql("", "changes").rstrip() + f", {_WINDOWS} SELECT event_id, path, kind FROM pending"


@query("event_root_semi", "SELECT event_id FROM changes WHERE lower(path) = '/watch/1.txt' OR starts_with(lower(path), '/watch/1.txt/') OR lower(path) = '/watch/2.txt'", "changes")
def _(t):
    roots = t.spark.createDataFrame([("/WATCH/1.txt", True), ("/watch/2.TXT/", True), ("/watch", False)], "root string, enabled boolean")
    return events.covered(t.changes.withColumn("path", F.initcap("path")), roots).select("event_id")


@query("usn_reason_decode", "SELECT usn, CASE WHEN reason & 512 <> 0 THEN 'delete' WHEN reason & 4096 <> 0 THEN 'old' WHEN reason & 8192 <> 0 THEN 'new' WHEN reason & 259 <> 0 THEN 'upsert' END AS kind FROM journal", "journal")
def _(t):
    return t.journal.select("usn", events.reason_class().alias("kind"))


_REPLAY = """, c AS (SELECT *, CASE WHEN reason & 512 <> 0 THEN 'delete' WHEN reason & 4096 <> 0 THEN 'old' WHEN reason & 8192 <> 0 THEN 'new' ELSE 'upsert' END AS k FROM journal WHERE usn > {0} AND path IS NOT NULL),
lost AS (SELECT file_ref FROM journal WHERE usn > {0} AND path IS NULL AND reason & 8192 <> 0),
l AS (SELECT file_ref, max(CASE WHEN k = 'delete' THEN p END) AS d, max(CASE WHEN k = 'old' THEN p END) AS o, max(CASE WHEN k = 'new' THEN p END) AS n, max(CASE WHEN k = 'upsert' THEN p END) AS u
FROM (SELECT file_ref, k, arg_max(path, usn) AS p FROM c GROUP BY file_ref, k) GROUP BY file_ref)
SELECT file_ref, 1 AS step, 'delete' AS action, d AS path, NULL AS target FROM l WHERE d IS NOT NULL AND (o IS NULL OR n IS NULL)
UNION ALL SELECT file_ref, 2, 'rename', o, n FROM l WHERE o <> n
UNION ALL SELECT file_ref, 2, CASE WHEN file_ref IN (SELECT file_ref FROM lost) THEN 'defer' ELSE 'delete' END, o, NULL FROM l WHERE o IS NOT NULL AND n IS NULL
UNION ALL SELECT file_ref, 3, 'upsert', u, NULL FROM l WHERE u IS NOT NULL AND (o IS NULL OR n IS NULL)
UNION ALL SELECT file_ref, 4, 'upsert', n, NULL FROM l WHERE n IS NOT NULL AND o IS NULL"""
for _name, _cursor in (("journal_replay", 0), ("journal_replay_cursor", 800)):

    @query(_name)
    def _(t, cursor=_cursor):
        return events.replay(t.journal, cursor)

    _SQL[_name] = sql("", "journal").rstrip() + _REPLAY.format(_cursor)


@query("rename_pairing", "SELECT coalesce(o.file_ref, n.file_ref) AS file_ref, o.path AS old_path, n.path AS new_path FROM (SELECT file_ref, arg_max(path, usn) AS path FROM journal WHERE reason = 4096 AND path IS NOT NULL GROUP BY 1) o FULL JOIN (SELECT file_ref, arg_max(path, usn) AS path FROM journal WHERE reason = 8192 AND path IS NOT NULL GROUP BY 1) n ON o.file_ref = n.file_ref", "journal")
def _(t):
    return events.name_pairs(t.journal)


@query("resolve_paths", "WITH RECURSIVE d AS (SELECT c_custkey AS ref, c_custkey // 7 AS parent, c_name AS name FROM customer), p AS (SELECT ref, name AS path FROM d WHERE parent = ref OR parent NOT IN (SELECT ref FROM d) UNION ALL SELECT d.ref, p.path || '/' || d.name FROM d JOIN p ON d.parent = p.ref WHERE d.ref <> d.parent) SELECT ref, path FROM p")
def _(t):
    return events.resolve_paths(t.raw("customer").select(F.col("c_custkey").alias("ref"), F.expr("c_custkey div 7").alias("parent"), F.col("c_name").alias("name")))


# ---- without SQL: Python functions inside

@query("chunk_text")
def _(t):
    from ..functions.chunk import chunk_table

    rows = chunk_table(t.raw("documents").select(F.col("doc_id").alias("file_id"), "text"))
    return rows.select("file_id", "chunk_index", "chunk_text", "token_count")


@query("segment_text")
def _(t):
    from ..functions.chunk import segment

    return t.chunks.select("chunk_id", segment(F.col("chunk_text")).alias("chunk_text_seg"))


@query("content_hash_xxh3")
def _(t):
    from ..functions.hashing import content_hash

    return t.raw("documents").select("doc_id", content_hash(F.col("text").cast("binary")).alias("content_hash"))


@query("point_ids")
def _(t):
    from ..functions.hashing import point_id

    return t.chunks.select("chunk_id", point_id(F.col("file_id"), F.col("source_type"), F.col("chunk_index")).alias("point_id"))


@query("embed_text")
def _(t):
    from ..functions.hashing import embed

    return t.chunks.select("chunk_id", embed(F.col("chunk_text")).alias("embedding"))


from . import upkeep  # noqa: E402, F401  its queries join the ones above


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(Tables(spark, sf_dir))
