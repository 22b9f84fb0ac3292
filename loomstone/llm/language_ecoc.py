"""Language ID by error-correcting output codes: each language has a codeword, a binary n-gram classifier
predicts each bit, and loss-weighted decoding takes the nearest codeword.

Up to five languages have the exhaustive code (all ways to part them in two), more have random dense codes
of at least ten bits for each doubling of their number, drawn for large row and column distances. A bit's
classifier is linear with hinge loss on indicators of byte n-grams, fit by dual coordinate descent. The
distance to a codeword is the sum over bits of the hinge loss of the margin against the codeword's bit,
each weighed by the classifier's accuracy on rows kept aside. The score is the share of the nearest
codeword in exp(-distance); `ambiguous` marks scores under AMBIGUOUS.

At most MAX_ROWS rows of each language are learned from, and MAX_TOTAL of all (though one of each language
at least): those with the smallest hashes of id and text, found by a threshold that the languages' counts
give, so no task sorts a language. A row's features take 2**BITS / 8 bytes at most.

Edge cases. Null text, and text without a letter (so empty text, too): `und` with score 0. Very long texts:
whole. With one language only, all other texts are that language with score 1; with none, `und`. Ties: of
equally near codewords the first language in order. Repeated rows are learned once. An empty table gives no
rows. Each row stands alone; extra columns, whatever their names, do no harm."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_type
from .ngrams import Indicators, dual_coordinate_descent, texts_of, unpack
from .quality_nbsvm import featurize, fold

#: Rows of each language, and of all, that are learned at most.
MAX_ROWS, MAX_TOTAL, BITS, COST, AMBIGUOUS = 600, 24_000, 16, 1.0, 0.6
#: Languages of which a table is sent to every task; more go by a shuffle.
FEW = 10_000
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = True


def code_matrix(k: int, seed: int = 3) -> np.ndarray:
    """k codewords of -1 and 1."""
    if k <= 5:
        cols = [[1 if i in left else -1 for i in range(k)] for n in range(1, k) for left in combinations(range(k), n) if 0 in left]
        return np.array(cols).T
    rng, best, size = np.random.default_rng(seed), None, 10 * int(np.ceil(np.log2(k)))
    if k > 1000:  # distances of so many are good by their mere number; all pairs of them would be too many
        while True:
            m = rng.choice([-1, 1], (k, 2 * size))
            if len(np.unique(m, axis=0)) == k and (np.abs(m.sum(0)) < k).all():
                return m
    for _ in range(200):
        m = rng.choice([-1, 1], (k, size))
        if (np.abs(m.sum(0)) == k).any():
            continue
        rows = np.abs(m @ m.T - size * np.eye(k, dtype=int)).max()
        cols = np.abs(m.T @ m - k * np.eye(size, dtype=int)).max()
        worst = max(((size + (m @ m.T - 2 * size * np.eye(k, dtype=int))).max() / size), rows / size, cols / k)
        if best is None or worst < best[0]:
            best = (worst, m)
    return best[1]


class Model:
    def __init__(self, rows: list[bytes], langs: list[str], bits: int) -> None:
        self.langs = sorted(set(langs))
        if len(self.langs) < 2:
            return
        self.code = code_matrix(len(self.langs))
        place = {x: i for i, x in enumerate(self.langs)}
        number = np.array([place[x] for x in langs])
        aside = np.arange(len(rows)) % 5 == 0
        n, dim = self.code.shape[1], 1 << bits
        self.w, self.b, self.trust = np.zeros((dim, n)), np.zeros(n), np.ones(n)
        pick = lambda x, keep: [v for v, ok in zip(x, keep, strict=True) if ok]
        for k in range(n):
            y = self.code[number, k].astype(float)
            w, b = dual_coordinate_descent(pick(rows, ~aside), y[~aside], dim, np.full((~aside).sum(), COST), epochs=8)
            tested = [unpack(r) for r in pick(rows, aside)]
            right = [t * (w[r].sum() / np.sqrt(max(1, len(r))) + b) > 0 for r, t in zip(tested, y[aside], strict=True)]
            self.trust[k] = max(2 * (sum(right) + 1) / (len(right) + 2) - 1, 0.01)
            self.w[:, k], self.b[k] = dual_coordinate_descent(rows, y, dim, np.full(len(rows), COST), epochs=8)
        self.w = self.w.astype(np.float32)

    def predict(self, grams: np.ndarray) -> tuple[str, float]:
        if len(self.langs) < 2:
            return (self.langs[0], 1.0) if self.langs else ("und", 0.0)
        margin = self.w[grams].sum(0, dtype=np.float64) / np.sqrt(max(1, len(grams))) + self.b
        loss = (np.maximum(0, 1 - self.code * margin) * self.trust).sum(1)
        p = np.exp(loss.min() - loss)
        return self.langs[int(loss.argmin())], float(p.max() / p.sum())


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS, max_total: int = MAX_TOTAL, bits: int = BITS) -> Model:
    """docs: the rows to learn from."""
    known = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"), docs[f"`{lang_col}`"].cast("string").alias("lang")).dropna(subset=["text", "lang"])
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    each = max(1, min(max_rows, max_total // max(1, len(counts))))
    # A share of the hash space that holds as many as wanted, with room to spare.
    share = {k: min(1.0, (each + 6 * each**0.5 + 10) / n) for k, n in counts.items()}
    most = docs.sparkSession.createDataFrame([(k, min((1 << 63) - 1, int(x * (1 << 64)) - (1 << 63))) for k, x in share.items()], "lang string, most bigint")
    chosen = known.withColumn("k", F.xxhash64(F.col("id").cast("string"), "text")).join(F.broadcast(most) if len(counts) <= FEW else most, "lang").where("k <= most")
    chosen = chosen.dropDuplicates(["k", "lang"]).select(F.struct("k", "lang").alias("pair"), "text")
    found = featurize(chosen, "pair", "text", bits).select("key.k", "key.lang", "grams").collect()
    used: dict[str, int] = {}
    rows, langs = [], []
    for r in sorted(found, key=lambda r: (r["k"], r["lang"])):
        used[r["lang"]] = used.get(r["lang"], 0) + 1
        if used[r["lang"]] <= each:
            rows.append(bytes(r["grams"]))
            langs.append(r["lang"])
    return Model(rows, langs, bits)


def has_letter(data: np.ndarray) -> bool:
    return bool(_LETTERS[data].any()) or (bool((data > 127).any()) and any(c.isalpha() for c in data.tobytes().decode()))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """For each row: id, lang_pred, score and ambiguous."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
    kind = arrow_type(source, "id")

    def run(batches):
        own, of = sent.value, Indicators(bits)
        for batch in batches:
            got = [own.predict(of(x)) if has_letter(x) else ("und", 0.0) for x in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64()), pa.array([x < AMBIGUOUS for _, x in got], pa.bool_())], names=["id", "lang_pred", "score", "ambiguous"])

    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, lang_pred string, score double, ambiguous boolean")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train(docs.where(fold(F.col("doc_id"), 3) != 1)))
    return out.select(F.col("id").alias("doc_id"), (fold(F.col("id"), 3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")
