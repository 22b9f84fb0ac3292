"""Text functions, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .segment import BREAKS, CLASSES, RESERVED

# Letters with marks, and without.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, Latin marks stripped."""
    flat = F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN)
    return F.filter(F.split(flat, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def estimate_tokens(text: Column) -> Column:
    """ASCII words and every other character that isn't white space."""
    return F.size(F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+)"), 1)) + F.char_length(F.regexp_replace(text, r"(?U)[A-Za-z0-9_]|\s", ""))


def split_terms(text: Column) -> Column:
    """Blanks where a term's parts meet: at the edges of camel case and between letters and digits."""
    between = "|".join(f"(?<=[{CLASSES[a]}])(?=[{CLASSES[b]}])" for a, b in BREAKS)
    return F.regexp_replace(text, between, " ")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[。！？!?.\n])"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def snippet(text: Column, size: int = 80) -> Column:
    return F.substring(text, 1, size)


def clean_query(text: Column) -> Column:
    """Characters that a match expression reserves become blanks."""
    return F.translate(text, RESERVED, " " * len(RESERVED))


def local_iso(epoch: Column) -> Column:
    """Seconds to RFC 3339 with a numeric offset, in the session's zone."""
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ssxxx")


def exif_epoch(text: Column) -> Column:
    """`yyyy:MM:dd HH:mm:ss` to seconds, in the session's zone; what isn't one is null."""
    return F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")))


def logical_key(file_id: Column, source_type: Column, index: Column) -> Column:
    return F.concat_ws(":", file_id.cast("string"), source_type, index.cast("string"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))
