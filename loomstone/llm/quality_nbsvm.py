"""Quality classifier: Naive Bayes support vectors. Indicators of n-grams (bytes, words, pairs of words) are
scaled by the classes' log-count ratios, a linear hinge-loss model is fit on them by dual coordinate descent,
and its margin is turned into a probability on rows kept aside.

The model is fit on at most MAX_ROWS labelled rows, those with the smallest hashes of their ids; every
document is scored, on its whole text. Features of a text leave the executors in at most 2**BITS / 4 bytes,
however long it is: 256 MB at most for all, and they stay packed on the driver.

Edge cases. Null or empty text: no n-grams, scored by the bias alone. Very long texts: whole. Of ids labelled
more than once the smallest label counts; of rows that share an id one text is learned, that of the smallest
hash. Labels that are null, or of ids without a document, count for nothing. With labels of one class only,
or none, or fewer than ten, every score is the share of the class (none: 0.5). Ties: equal texts have equal
scores. An empty table of documents gives no rows. Each row stands alone; extra columns, whatever their
names, do no harm."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_type
from .ngrams import Indicators, dual_coordinate_descent, pack, platt, texts_of, unpack

#: Labelled rows that the model is fit on at most.
MAX_ROWS, BITS, COST, MIXED, THRESHOLD = 4000, 18, 4.0, 0.25, 0.3


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def featurize(docs: DataFrame, key: str, text: str, bits: int, words: bool = False) -> DataFrame:
    """key and grams, the packed n-gram numbers of the text."""
    kind, dim = arrow_type(docs, key), 2 << bits if words else 1 << bits

    def run(batches):
        of = Indicators(bits, words=words)
        for batch in batches:
            rows = [pack(of(x), dim) for x in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.array(rows, pa.binary())], names=["key", "grams"])

    return docs.select(key, text).mapInArrow(run, f"key {dict(docs.dtypes)[key]}, grams binary")


class Model:
    """margin(features) and score(margin)."""

    def __init__(self, rows: list[bytes], y: np.ndarray, bits: int, cost: float = COST, mixed: float = MIXED) -> None:
        dim = 2 << bits
        self.w, self.b, self.a, self.c = np.zeros(dim), 0.0, 1.0, 0.0
        share = float((y > 0).mean()) if len(y) else 0.5
        if share in (0.0, 1.0) or len(y) < 10:
            self.a, self.b, self.c = 0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
            return
        aside = np.arange(len(y)) % 5 == 0
        self._fit([r for r, x in zip(rows, aside, strict=True) if not x], y[~aside], dim, cost, mixed)
        margins = np.array([self.margin(unpack(r)) for r, x in zip(rows, aside, strict=True) if x])
        self.a, self.c = platt(margins, y[aside])
        self._fit(rows, y, dim, cost, mixed)

    def _fit(self, rows, y, dim, cost, mixed) -> None:
        p, q = np.ones(dim), np.ones(dim)
        for r, t in zip(rows, y, strict=True):
            (p if t > 0 else q)[unpack(r)] += 1
        ratio = np.log(p / p.sum()) - np.log(q / q.sum())
        # Classes weigh the same in all, so that the rarer one isn't given up.
        pos, neg = (y > 0).sum(), (y <= 0).sum()
        costs = np.where(y > 0, cost * len(y) / (2 * pos), cost * len(y) / (2 * neg))
        w, self.b = dual_coordinate_descent(rows, y, dim, costs, weight=ratio)
        # Between the support vector weights and their mean size, which is Naive Bayes.
        self.w = ratio * ((1 - mixed) * np.abs(w).mean() + mixed * w) / mixed

    def margin(self, grams: np.ndarray) -> float:
        return float(self.w[grams].sum()) / np.sqrt(max(1, len(grams))) + self.b

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * margin + self.c, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, bits: int = BITS) -> Model:
    """labels: the rows to learn from."""
    one = labels.select(labels[f"`{id_col}`"].alias("key"), labels[f"`{label_col}`"].cast("int").alias("y")).dropna().groupBy("key").agg(F.min("y").alias("y"))
    # At most max_rows ids and labels: small enough to send to every task.
    sample = one.orderBy(F.xxhash64("key"), "key").limit(max_rows)
    texts = docs.select(docs[f"`{id_col}`"].alias("key"), docs[f"`{text_col}`"].alias("text"))
    chosen = texts.join(F.broadcast(sample), "key").groupBy("key", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = featurize(chosen.select(F.struct("key", "y").alias("pair"), "text"), "pair", "text", bits, words=True).select("key.key", "key.y", "grams").collect()
    found = sorted(found, key=lambda r: r["key"])
    return Model([bytes(r["grams"]) for r in found], np.array([1.0 if r["y"] > 0 else -1.0 for r in found]), bits)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """For each row: id and score, 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
    kind = arrow_type(source, "id")

    def run(batches):
        own, of = sent.value, Indicators(bits, words=True)
        for batch in batches:
            got = [own.score(own.margin(of(x))) for x in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.array(got, pa.float64())], names=["id", "score"])

    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, score double")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    learn = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    out = score(docs, train(docs, learn))
    return out.select(F.col("id").alias("doc_id"), (fold(F.col("id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
