"""File trees and documents as DataFrames."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import dir_tokens, extension, file_type, mime_type, skip_dir, skip_extension

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def scan_tree(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """A row for each file under root that a scan takes. Spark lists paths, sizes and modified times; there
    is no creation time in its listing, so ctime_ns is the modified one. content: also the bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(raw["path"], "^[a-z0-9]+:(//[^/]*)?(?=/)", "")
    rows = raw.select(path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("filename"), "length", "modificationTime", *(["content"] if content else []))
    inside = F.expr("substring(path, length('{}') + 1)".format(root.removeprefix("file://").rstrip("/").replace("'", "\\'")))
    ext, ns = extension(F.col("filename")), F.unix_micros("modificationTime") * 1000
    return rows.where(~skip_dir(inside) & ~skip_extension(ext)).select(
        "path", "filename", F.regexp_replace("path", "/[^/]*$", "").alias("dir_path"), dir_tokens(F.regexp_replace("path", "/[^/]*$", "")).alias("dir_tokens"),
        ext.alias("extension"), F.col("length").alias("size_bytes"), ns.alias("mtime_ns"), ns.alias("ctime_ns"), file_type(ext).alias("file_type"), mime_type(ext).alias("mime_type"), *(["content"] if content else []),
    )


def docx_text(raw: bytes) -> str:
    """Paragraphs, then tables with cells joined by bars and rows by line ends; blocks are apart by a blank line."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{_W}body")
    words = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    blocks = [words(p) for p in body.findall(f"{_W}p")]
    for table in body.findall(f"{_W}tbl"):
        blocks.append("\n".join(" | ".join(words(c).strip() for c in row.findall(f"{_W}tc")) for row in table.findall(f"{_W}tr")))
    return "\n\n".join(b for b in blocks if b.strip())


def plain_text(raw: bytes) -> str:
    return raw.decode("utf-8", errors="replace")


def pdf_text(raw: bytes) -> str:
    from pypdf import PdfReader  # an optional library

    return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(raw)).pages)


#: Readers by extension: functions of bytes. `extract` takes others, and may be given one for these.
READERS: dict[str, Callable[[bytes], str]] = {".txt": plain_text, ".md": plain_text, ".markdown": plain_text, ".docx": docx_text, ".pdf": pdf_text}


def extract(ext: Column, content: Column, readers: dict[str, Callable[[bytes], str]] | None = None) -> Column:
    """(text, error) by extension; what can't be read has an error instead."""
    own = READERS | (readers or {})

    def one(e: str, raw: bytes) -> tuple[str | None, str | None]:
        try:
            if e not in own:
                raise ValueError(f"no reader for {e or 'files without extension'}")
            return own[e](raw), None
        except Exception as x:  # a damaged file must not end the job: its error is its result
            return None, f"{type(x).__name__}: {x}"[:2000]

    def run(ext: pd.Series, content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(e, c) for e, c in zip(ext, content, strict=True)], columns=["text", "error"])

    return F.pandas_udf(run, "struct<text:string,error:string>")(ext, content)


def recognise(content: Column, recogniser: Callable[[bytes], list[tuple[str, float]]]) -> Column:
    """(text, confidence, error) of images. recogniser: the lines and scores that it reads in an image. Blank lines don't
    count; an image without text is empty with confidence 0, which isn't an error; what can't be decoded is one."""

    def one(raw: bytes) -> tuple[str | None, float | None, str | None]:
        try:
            found = [(t.strip(), s) for t, s in recogniser(raw) if t.strip()]
            return " ".join(t for t, _ in found), sum(s for _, s in found) / len(found) if found else 0.0, None
        except Exception as x:
            return None, None, f"{type(x).__name__}: {x}"[:2000]

    def run(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(c) for c in content], columns=["text", "confidence", "error"])

    return F.pandas_udf(run, "struct<text:string,confidence:double,error:string>")(content)


def exif_time(content: Column) -> Column:
    """The time taken (tag 0x9003) as the file has it, or null."""
    return F.pandas_udf(_exif, "string")(content)


_DATE = re.compile(rb"(?:19|20)\d\d:[01]\d:[0-3]\d [0-2]\d:[0-5]\d:[0-5]\d")


def read_exif(raw: bytes | None) -> str | None:
    """Walks the TIFF directories of a JPEG's EXIF block to tag 0x9003."""
    import struct

    if not raw or (at := raw.find(b"Exif\0\0")) < 0:
        return None
    tiff = raw[at + 6 :]
    e = "<" if tiff[:2] == b"II" else ">"

    def entries(offset):
        (n,) = struct.unpack_from(e + "H", tiff, offset)
        for k in range(n):
            tag, kind, count, value = struct.unpack_from(e + "HHII", tiff, offset + 2 + 12 * k)
            yield tag, kind, count, value

    try:
        first = struct.unpack_from(e + "I", tiff, 4)[0]
        sub = next(v for tag, _, _, v in entries(first) if tag == 0x8769)
        count, where = next((c, v) for tag, _, c, v in entries(sub) if tag == 0x9003)
        found = tiff[where : where + count].rstrip(b"\0")
        return found.decode() if _DATE.fullmatch(found) else None
    except (StopIteration, struct.error, UnicodeDecodeError):
        return None


def _exif(content: pd.Series) -> pd.Series:
    return content.map(read_exif)
