"""Line dedup, in DataFrame functions only: explode normalised lines, hash, count distinct
documents per hash, drop lines over the threshold, reassemble by position.

Edge cases. Null or empty text: one empty line, whose key is empty and never dropped. Very long texts:
whole; a line is a row, and a text is put together again from positions in linear time. A document is a
doc_id: rows that share one count once, and each row is cleaned on its own; equal rows get equal results.
Rows with a null id count as one document. Ties: a line in exactly min_docs documents goes, in all of
them. An empty table gives no rows. Other columns, whatever their names, pass through: they travel inside
one column, so none can meet a name used here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, packed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: `[\x20\x09-\x0D]`
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """Stripped of blanks at both ends, A-Z lower-cased. lower() does it faster where there is only ASCII."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def key_hash(line: Column) -> Column:
    """128 bits, so that different keys don't meet at any corpus size in practice."""
    return F.unhex(F.md5(line_key(line).cast("binary")))


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """A row for each line whose key is long enough: row identity (id, rk), position, key hash."""
    rows = docs.select(docs[f"`{id_col}`"].alias("id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("rk"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.where(F.char_length(F.btrim("line", F.lit(BLANKS))) >= min_chars).select("id", "rk", "pos", key_hash(F.col("line")).alias("h"))


def frequent(lines: DataFrame, min_docs: int = 10) -> DataFrame:
    """Hashes of the keys found in min_docs documents or more. Pairs are made distinct on (hash, id), so
    that a line in a third of all documents is spread over all tasks, and then counted with a partial sum."""
    return lines.select("h", "id").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("h")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """For each row: row (all of docs' columns), n_lines (before), n_dropped and kept, the text of the other lines."""
    # Hashed once, and read twice from the shared folder: to count, and to find the rows that hold a frequent line.
    lines = materialize(_lines(docs, id_col, text_col, min_chars), "lines")
    # The further key makes Spark exchange the counted hashes again, so that it can split a very common line's rows.
    often = frequent(lines, min_docs).withColumn("h2", F.xxhash64("h"))
    hits = lines.withColumn("h2", F.xxhash64("h")).join(often, ["h", "h2"], "left_semi")
    drops = hits.groupBy("id", "rk").agg(F.collect_set("pos").alias("drop")).withColumnsRenamed({"id": "did", "rk": "drk"})
    whole = packed(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    whole = whole.select("row", "id", "text", F.xxhash64("text").alias("rk"))
    out = whole.join(drops, F.col("id").eqNullSafe(F.col("did")) & (F.col("rk") == F.col("drk")), "left").withColumn("split", F.split("text", "\n", -1))
    n, drop = F.size("split"), F.coalesce("drop", F.array().cast("array<int>"))
    # Positions left, found by a hash set, so that very long texts stay linear.
    left = F.array_except(F.sequence(F.lit(0), n - 1), drop)
    kept = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("split"), i)), "\n"))
    return out.select("row", n.cast("long").alias("n_lines"), F.size(drop).cast("long").alias("n_dropped"), kept.alias("kept"))


def clean(docs: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """docs with the frequent lines gone from text, and n_chars, where there, set anew. A null text becomes empty."""
    new = {text_col: F.col("kept")} | ({"n_chars": F.char_length("kept").cast("long")} if "n_chars" in docs.columns else {})
    out = dedup_lines(docs, text_col=text_col, **kw)
    return out.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), often AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE o.k IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often o USING (k)
GROUP BY doc_id
"""
