"""Path, extension and type functions, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of each file type, types of content, and what a scan skips.
FILE_TYPES = {
    "image": ".jpg .jpeg .png .gif .bmp .webp .heic .tiff .svg",
    "doc": ".txt .md .markdown .pdf .doc .docx .xls .xlsx .ppt .pptx .csv .json .html .htm .rtf .epub",
    "video": ".mp4 .avi .mkv .mov .wmv .flv .webm",
    "audio": ".mp3 .wav .flac .aac .ogg .m4a",
    "archive": ".zip .rar .7z .tar .gz .bz2",
}
MIME_TYPES = {
    "text/plain": ".txt .md .markdown .csv .json .html .htm .rtf",
    "application/pdf": ".pdf",
    "application/msword": ".doc .docx",
    "application/vnd.ms-excel": ".xls .xlsx",
    "application/vnd.ms-powerpoint": ".ppt .pptx",
    "application/zip": ".zip .rar .7z .tar .gz .bz2",
}
SKIPPED_EXTENSIONS = ".tmp .temp .bak .log .cache .swp .lock .part .crdownload .dll .exe .msi .sys .ini"
SKIPPED_DIRS = ("$recycle.bin", "system volume information", "windows", "program files", "program files (x86)", "programdata", "recovery", "perflogs", "appdata", "node_modules", ".git", ".svn", ".hg", ".venv", "venv", "__pycache__")


def file_type(ext: Column) -> Column:
    """Type of an extension (with its dot, any case); what isn't listed is other."""
    low, out = F.lower(ext), F
    for kind, exts in FILE_TYPES.items():
        out = out.when(low.isin(exts.split()), kind)
    return out.otherwise("other")


def mime_type(ext: Column) -> Column:
    """Content type, by listed extension or family; else null."""
    low, out = F.lower(ext), F
    for kind in ("image", "video", "audio"):
        out = out.when(low.isin(FILE_TYPES[kind].split()), F.concat(F.lit(f"{kind}/"), F.substring(low, 2, 20)))
    for kind, exts in MIME_TYPES.items():
        out = out.when(low.isin(exts.split()), kind)
    return out


def extension(name: Column) -> Column:
    """The last dot and what follows, lower-cased; empty where there is none, or only a leading one."""
    return F.lower(F.regexp_extract(name, r"^.*[^./\\](\.[^./\\]+)$", 1))


def skip_extension(ext: Column) -> Column:
    return F.lower(ext).isin(SKIPPED_EXTENSIONS.split())


def skip_dir(path: Column) -> Column:
    """Whether some folder of the path is skipped."""
    return F.exists(F.split(F.lower(path), r"[/\\]"), lambda x: x.isin(*SKIPPED_DIRS))


def dir_tokens(path: Column) -> Column:
    return F.trim(F.regexp_replace(path, r"[/\\]+", " "))


def canonical_root(path: Column) -> Column:
    r"""One kind of slash, none at the end, except after a bare drive."""
    flat = F.regexp_replace(F.regexp_replace(path, "/", r"\\"), r"(?<!^)\\{2,}", r"\\")
    bare = F.regexp_replace(flat, r"\\+$", "")
    return F.when(bare.rlike(r"^[A-Za-z]:$"), F.concat(bare, F.lit("\\"))).otherwise(bare)


def root_covers(child: Column, parent: Column) -> Column:
    """Whether child is parent or lies under it, in any case of letters."""
    c = F.lower(canonical_root(child))
    p = F.regexp_replace(F.lower(canonical_root(parent)), r"\\+$", "")
    return (F.regexp_replace(c, r"\\+$", "") == p) | c.startswith(F.concat(p, F.lit("\\")))
