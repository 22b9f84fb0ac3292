"""The canonical filter: one predicate for every channel and for the final recheck."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NS = 1_000_000_000


@dataclass(frozen=True)
class UnifiedFilter:
    """Time bounds are seconds, half open. basis: exif (taken time, or else modified), ctime or mtime."""

    time_from: int | None = None
    time_to: int | None = None
    basis: str = "exif"
    file_types: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    include_deleted: bool = False

    @property
    def timed(self) -> bool:
        return self.time_from is not None

    @property
    def empty(self) -> bool:
        return not (self.timed or self.file_types or self.extensions)


def seconds(ns: str) -> Column:
    return F.expr(f"{ns} div {NS}")


def time_basis(basis: str) -> Column:
    """Seconds that a time filter looks at; needs taken_epoch for exif."""
    if basis == "exif":
        return F.coalesce(F.col("taken_epoch"), seconds("mtime_ns"))
    return seconds("ctime_ns" if basis == "ctime" else "mtime_ns")


def canonical(f: UnifiedFilter) -> Column:
    parts = [] if f.include_deleted else [F.col("is_deleted") == 0]
    if f.file_types:
        parts.append(F.col("file_type").isin(*f.file_types))
    if f.extensions:
        parts.append(F.col("extension").isin(*(x if x.startswith(".") else f".{x}" for x in f.extensions)))
    if f.timed:
        if f.basis == "exif":
            parts.append((time_basis("exif") >= f.time_from) & (time_basis("exif") < f.time_to))
        else:  # bounds on the column itself, so that they reach the scan
            ns = F.col("ctime_ns" if f.basis == "ctime" else "mtime_ns")
            parts.append((ns >= f.time_from * NS) & (ns < f.time_to * NS))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def with_exif(files: DataFrame, exif: DataFrame) -> DataFrame:
    return files.join(exif.select("file_id", "taken_epoch"), "file_id", "left")


def apply(files: DataFrame, exif: DataFrame, f: UnifiedFilter) -> DataFrame:
    """Files that pass. exif is joined only where the filter looks at taken times."""
    return (with_exif(files, exif) if f.timed and f.basis == "exif" else files).where(canonical(f))


def metadata_only(files: DataFrame, exif: DataFrame, f: UnifiedFilter, k: int = 50) -> DataFrame:
    """Newest first by the time that the filter names: modified without one, taken or modified for exif."""
    own = time_basis(f.basis) if f.timed else F.col("mtime_ns")
    return with_exif(files, exif).where(canonical(f)).orderBy(own.desc(), "file_id").limit(k)
