"""A corpus, from raw documents to packed sequences, in stages that are each written and read again.

Every stage takes any table with doc_id and text; it keeps other columns, whatever their names, sets n_chars
anew where it changes a text and the column is there, and works on whole texts, however long. Empty tables
give no rows. What nulls, empty texts, ties and repeated rows come to is said with each stage."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from loomstone.llm import decontaminate, line_dedup, near_dedup, packing, repetition
from loomstone.llm.common import materialize, shared_dir, ship, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null and empty texts are among them, and repeated rows go or stay alike."""
    return repetition.keep(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go (ten itself included); documents stay, with the text that is left,
    even if none is. A null text becomes empty. Rows that share an id count once, rows without one as one document."""
    return line_dedup.clean(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the smallest id stays, in all
    its rows. Texts without words, and rows without an id, stay."""
    return near_dedup.keep(docs, shingle=5, threshold=(4, 5))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go (a twentieth of the words or more); from others the words that benchmark windows
    cover are cut. Null texts stay null, and each row stands alone."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces, ids included, with their places in sequences of 4096. A null or empty text is the end token."""
    return packing.pack(docs, with_ids=True)



def _ready(stage):
    """A stage may be called alone: the session gets its shared folder and this package first."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shared_dir(spark)
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality_rules", _ready(quality_rules)),
    ("line_dedup", _ready(line_dedup_stage)),
    ("near_dedup", _ready(near_dedup_stage)),
    ("decontamination", _ready(decontamination)),
    ("packing", _ready(pack)),
]

#: Suffix arrays, MinHash and tokenizers have no SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
