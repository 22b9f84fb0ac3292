"""The data model over the test tables. Each table is given by expressions that Spark and DuckDB read
alike, so the SQL to compare with is built from the same text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = """
doc_id AS file_id
'/' || source || '/' || lang || '/note-' || lang || '-' || doc_id || {ext} AS path
'note-' || lang || '-' || doc_id || {ext} AS filename
'/' || source || '/' || lang AS dir_path
{ext} AS extension
CASE WHEN doc_id % 8 IN (0, 1) THEN 'image' WHEN doc_id % 8 IN (2, 3, 4, 5) THEN 'doc' WHEN doc_id % 8 = 6 THEN 'video' ELSE 'other' END AS file_type
n_chars AS size_bytes
(1704067200 + doc_id * 3600) * 1000000000 AS mtime_ns
(1703980800 + doc_id * 1800) * 1000000000 AS ctime_ns
md5(text) AS content_hash
CASE WHEN doc_id % 5 = 0 THEN 'AI_DONE' WHEN doc_id % 5 = 1 THEN 'FAILED' ELSE 'METADATA_ONLY' END AS status
CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS is_deleted
""".replace("{ext}", "(CASE doc_id % 8 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.pdf' WHEN 3 THEN '.docx' WHEN 4 THEN '.txt' WHEN 5 THEN '.md' WHEN 6 THEN '.mp4' ELSE '.xyz' END)")
EXIF = """
doc_id AS file_id
1704067200 + doc_id * 3600 + 43200 AS taken_epoch
"""
OCR = """
doc_id AS file_id
substr(text, 1, 200) AS text
'zh+en' AS lang
doc_id % 100 / 100.0D AS confidence
"""
OCR_WHERE = " WHERE doc_id % 8 IN (0, 1) AND doc_id % 16 <> 1"
POINTS = """
vec_id * 7 % 1100 AS file_id
CASE vec_id * 7 % 1100 % 5 WHEN 0 THEN 'ocr' WHEN 1 THEN 'image_caption' ELSE 'doc_chunk' END AS source_type
CAST(vec_id % 6 AS int) AS chunk_index
vec_id
embedding
"""
TASKS = """
o_orderkey AS task_id
o_orderkey % 1200 AS file_id
'process' AS task_type
CAST(o_orderkey % 3 AS int) AS priority
CASE WHEN o_orderstatus = 'O' THEN 'PENDING' WHEN o_orderstatus = 'F' THEN 'FAILED' WHEN o_orderkey % 2 = 0 THEN 'RUNNING' ELSE 'SUCCESS' END AS status
CAST(o_orderkey % 4 AS int) AS attempt
3 AS max_attempts
o_custkey AS updated_at
CASE WHEN o_orderkey % 7 = 0 THEN 'earlier' END AS last_error
"""
EVENTS = """
event_id
ts
user_id
'/' || 'watch/' || user_id || '.txt' AS path
CASE event_type WHEN 'click' THEN 'modified' WHEN 'view' THEN 'modified' WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'deleted' ELSE 'moved' END AS kind
'/' || 'watch/' || user_id % 10 || '.txt' AS dest
"""
JOURNAL = """
event_id AS usn
user_id AS file_ref
CASE WHEN event_id % 13 IN (5, 6) THEN NULL ELSE '/' || 'watch/' || user_id || '-' || event_id % 50 END AS path
CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 256 WHEN 'signup' THEN 4096 WHEN 'purchase' THEN 8192 ELSE 512 END AS reason
"""


def _sql(expressions: str, source: str, where: str = "") -> str:
    return f"SELECT {', '.join(expressions.strip().splitlines())} FROM {source}{where}"


#: Common table expressions for the SQL side.
CTE = {
    "files": _sql(FILES, "documents"),
    "exif": _sql(EXIF, "documents", " WHERE doc_id % 3 = 0"),
    "chunks": """SELECT doc_id * 100000 + (i - 1) AS chunk_id, doc_id AS file_id,
  CASE doc_id % 5 WHEN 0 THEN 'ocr' WHEN 1 THEN 'image_caption' ELSE 'doc_chunk' END AS source_type,
  CAST(i - 1 AS INT) AS chunk_index, l[i] AS chunk_text, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE CAST((doc_id + i) % 3 AS INT) END AS embedding_status
  FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE l[i] <> ''""",
    "ocr": _sql(OCR, "documents", OCR_WHERE).replace("100.0D", "100.0::DOUBLE"),
    "points": _sql(POINTS, "embeddings"),
    "tasks": _sql(TASKS, "orders"),
    "changes": _sql(EVENTS, "events"),
    "journal": _sql(JOURNAL, "events"),
}


def sql(body: str, *names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in names) + " " + body if names else body


class Tables:
    """Lazy DataFrames of the data model over one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _of(self, name: str, expressions: str) -> DataFrame:
        return self.raw(name).selectExpr(*expressions.strip().splitlines())

    @property
    def files(self) -> DataFrame:
        return self._of("documents", FILES)

    @property
    def exif(self) -> DataFrame:
        return self.raw("documents").where("doc_id % 3 = 0").selectExpr(*EXIF.strip().splitlines())

    @property
    def chunks(self) -> DataFrame:
        lines = self.raw("documents").select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n", -1)).alias("i", "chunk_text")).where("chunk_text <> ''")
        return lines.selectExpr(
            "file_id * 100000 + i AS chunk_id", "file_id", "CASE file_id % 5 WHEN 0 THEN 'ocr' WHEN 1 THEN 'image_caption' ELSE 'doc_chunk' END AS source_type", "i AS chunk_index", "chunk_text", "CASE WHEN file_id % 3 = 0 THEN 1 ELSE CAST((file_id + i + 1) % 3 AS int) END AS embedding_status"
        )

    @property
    def ocr(self) -> DataFrame:
        return self.raw("documents").where(OCR_WHERE.removeprefix(" WHERE ")).selectExpr(*OCR.strip().splitlines())

    @property
    def points(self) -> DataFrame:
        return self._of("embeddings", POINTS)

    @property
    def tasks(self) -> DataFrame:
        return self._of("orders", TASKS)

    @property
    def changes(self) -> DataFrame:
        return self._of("events", EVENTS)

    @property
    def journal(self) -> DataFrame:
        return self._of("events", JOURNAL)
