"""The tables' columns, by version, and how a table of an earlier version is brought up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of each table, in order, with the version that brought them where it isn't the first.
TABLES = {
    "files": "id bigint, path string, filename string, dir_path string, extension string, size_bytes bigint, mtime_ns bigint, ctime_ns bigint, file_type string, mime_type string, content_hash string, status string, is_deleted int, created_at bigint, updated_at bigint",
    "exif": "file_id bigint, datetime_original string, datetime_original_epoch bigint",
    "ocr_text": "file_id bigint, text string, lang string, confidence double, created_at bigint",
    "chunks": "id bigint, file_id bigint, source_type string, chunk_index int, chunk_text string, chunk_text_seg string, token_count int, embedding_status int, created_at bigint, updated_at bigint",
    "ai_tasks": "id bigint, file_id bigint, task_type string, priority int, status string, attempt int, max_attempts int, last_error string, created_at bigint, updated_at bigint",
    "index_jobs": "id bigint, root_path string, scan_type string, status string, total_files bigint, scanned_files bigint, error_count bigint, cursor_path string, started_at bigint, finished_at bigint",
    "settings": "key string, value string",
    "worker_heartbeat": "worker_id string, last_seen bigint",
}
ADDED = {("exif", "datetime_original_epoch"): 2, ("worker_heartbeat", "worker_id"): 3, ("worker_heartbeat", "last_seen"): 3, ("index_jobs", "cursor_path"): 4}
VERSION = 4
#: What a column is where a row doesn't say.
DEFAULTS = {"status": {"files": "METADATA_ONLY", "ai_tasks": "PENDING", "index_jobs": "PENDING"}, "is_deleted": 0, "embedding_status": 0, "priority": 1, "attempt": 0, "max_attempts": 3, "scanned_files": 0, "error_count": 0}


def columns(name: str, version: int = VERSION) -> list[tuple[str, str]]:
    own = [tuple(c.split(" ", 1)) for c in TABLES[name].split(", ")]
    return [(c, kind) for c, kind in own if ADDED.get((name, c), 1) <= version]


def upgraded(df: DataFrame, name: str) -> DataFrame:
    """A table of any earlier version with the columns it has now: new ones with their defaults, or null; nulls where a
    default is set are that default. Of times taken that only a text tells, the epoch is computed. Doing it again
    changes nothing; columns that no version has are an error."""
    from ..functions.text import exif_epoch

    known = columns(name)
    strange = set(df.columns) - {c for c, _ in known}
    if strange:
        raise ValueError(f"{name} has no column {', '.join(sorted(strange))}")

    def value(c: str, kind: str):
        own = F.col(c) if c in df.columns else F.lit(None)
        if (name, c) == ("exif", "datetime_original_epoch"):
            own = F.coalesce(own.cast(kind), exif_epoch(F.col("datetime_original")))
        default = DEFAULTS.get(c)
        default = default.get(name) if isinstance(default, dict) else default
        return (own if default is None else F.coalesce(own, F.lit(default))).cast(kind).alias(c)

    return df.select(*[value(c, kind) for c, kind in known])
