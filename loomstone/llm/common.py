"""What the operators of this subpackage share: tables, shared folders, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, shared_path, ship  # noqa: F401

#: Bytes of text that the vectorised operators work on at a time.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    at = shared_path(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def packed(docs: DataFrame, **named: str) -> DataFrame:
    """The whole row as one column, row, beside copies of the named ones: so no name in docs, whatever it is,
    meets one that an operator uses. `select("row.*")` brings the columns back."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *[docs[f"`{c}`"].alias(k) for k, c in named.items()])


def arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def whole(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(col, pa.ChunkedArray):
        return pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    return col


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string array; null counts as empty."""
    col = pc.fill_null(whole(col).cast(pa.large_string()), "")
    _, offs, data = col.buffers()
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes each; a longer text stands alone."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def by_slice(fn, schema: pa.Schema, text_col: str = "text", limit: int = SLICE_BYTES):
    """mapInArrow body: fn(batch slice, bytes, offsets) -> dict of columns, a row for each input row."""

    def run(batches):
        for batch in batches:
            data, offs = text_buffers(batch.column(batch.schema.get_field_index(text_col)))
            for i, j in slices(offs, limit):
                part = batch.slice(i, j - i)
                cols = fn(part, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                arrays = [c if isinstance(c := cols[f.name], pa.Array) else pa.array(c, f.type) for f in schema]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run
