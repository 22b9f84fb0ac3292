"""BM25 keyword search over one or more text columns of a table.

A term is a word, a prefix or a phrase; its count in a row is over all columns, the row's length too. A column
listed more than once counts as often, and is cut into words once. Two ways give the same scores: `scan` counts
terms row by row inside one pass (no shuffle: a sum of a few numbers for the statistics, a top-k for the
result), `Index` keeps postings in files that are sorted by term, so a query reads the parts with its terms."""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import shared_path

K1, B, FLOOR = 1.2, 0.75, 1e-6


@dataclass(frozen=True)
class Term:
    """words: one word, or several in a row (phrase). prefix: the word's beginning is enough."""

    words: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Query:
    """every: rows must hold all terms (else any)."""

    terms: tuple[Term, ...]
    every: bool = True


def forms(words: list[str]) -> list[Query]:
    """Phrase, then all words as prefixes, then any; a single word has one form."""
    low = [w.lower() for w in words]
    prefixes = tuple(Term((w,), True) for w in low)
    if len(low) < 2:
        return [Query(prefixes)] if low else []
    return [Query((Term(tuple(low)),)), Query(prefixes), Query(prefixes, every=False)]


def count_in(toks: Column, term: Term) -> Column:
    if len(term.words) > 1:
        # Words are letters and digits only. Looking ahead, so that occurrences may overlap.
        flat = F.concat(F.lit(" "), F.array_join(toks, "  "), F.lit(" "))
        return F.regexp_count(flat, F.lit("(?= " + "  ".join(term.words) + " )"))
    word = term.words[0]
    return F.size(F.filter(toks, lambda x: x.startswith(word) if term.prefix else x == word))


def idf(n: Column, df: Column) -> Column:
    """Logarithm of the odds, never below FLOOR."""
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(FLOOR))


def part(f: Column, length: Column, average: Column) -> Column:
    return f * (K1 + 1) / (f + K1 * (1 - B + B * length / average))


def scan(df: DataFrame, columns: list[str], query: Query, k: int | None = 200, key: str = "file_id") -> DataFrame:
    """df's matching rows with score, negative and smaller where better; the k best by (score, key)."""
    own = Counter(columns)
    toks = df.select("*", *[tokens(F.col(c)).alias(f"_t{i}") for i, c in enumerate(own)])
    total = lambda of: sum((n * of(F.col(f"_t{i}")) for i, n in enumerate(own.values())), F.lit(0))
    counted = toks.select("*", total(F.size).alias("_len"), *[total(lambda c, t=t: count_in(c, t)).alias(f"_f{j}") for j, t in enumerate(query.terms)])
    fs = [F.col(f"_f{j}") for j in range(len(query.terms))]
    # One row of a few numbers, so it can go to every task.
    stats = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *[F.sum((f > 0).cast("int")).alias(f"_d{j}") for j, f in enumerate(fs)])
    hit = reduce(lambda a, b: a & b if query.every else a | b, [f > 0 for f in fs])
    score = sum((idf(F.col("_n"), F.col(f"_d{j}")) * part(f, F.col("_len"), F.col("_avg")) for j, f in enumerate(fs)), F.lit(0.0))
    out = counted.where(hit).crossJoin(F.broadcast(stats)).withColumn("score", -score).select(*df.columns, "score")
    return out.orderBy("score", key).limit(k) if k else out


class Index:
    """Postings (term, key, tf, at) and lengths (key, len, part) in a folder: tf over all columns, at the word's places,
    of which each column has a range of its own.

    Postings are dealt over files by row, so a term of very many rows is spread, and are sorted by term
    within: a filter on term or on its beginning is pushed into the scan, whose statistics leave out the row groups
    without it. Texts are dealt before they are cut, to files of a bounded number of words, so that no posting is
    shuffled and a file's postings are sorted in memory. Statistics (rows, average length, parts) are
    in a small file beside. `update` writes the next version and then moves the pointer to it, so readers see one
    or the other; it doesn't cut other rows into words again, nor write their postings again: rows put in have postings
    of their own, a part, and a row's length tells the part that counts. After PARTS of them all become one."""

    #: Between the places of one column and of the next.
    GAP = 1 << 24
    #: Bytes of a file of postings, at most and about, and what a posting takes.
    FILE_BYTES, POSTING_BYTES = 128 << 20, 24
    #: So many parts are read side by side.
    PARTS = 8

    def __init__(self, spark, folder: str, columns: list[str], key: str, extra: tuple[str, ...] = ()) -> None:
        """extra: further columns of the indexed rows that results carry."""
        self.spark, self.folder, self.columns, self.key, self.extra = spark, folder.rstrip("/"), columns, key, tuple(extra)

    # ---- versions

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _names(self) -> list[str]:
        fs, root = self._fs(), self._path("")
        return [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []

    def version(self) -> int:
        """Of the versions whose statistics are written, the last; 0 if there is none."""
        return max((int(x.removeprefix("stats-")) for x in self._names() if x.startswith("stats-") and self._fs().exists(self._path(f"{x}/_SUCCESS"))), default=0)

    def _stats(self):
        """n, average and parts of the version to read."""
        return self.spark.read.parquet(f"{self.folder}/stats-{self.version()}").head()

    def _write(self, lengths: DataFrame, parts: list[int], postings) -> None:
        """parts: those that stay. postings: makes the new part's from the number of its files; None if there is none."""
        v, before = self.version() + 1, self._stats()["parts"] if self.version() else []
        lengths.write.mode("overwrite").parquet(f"{self.folder}/lengths-{v}")
        told = self.spark.read.parquet(f"{self.folder}/lengths-{v}").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("average"), F.coalesce(F.sum(F.when(F.col("part") == v, F.col("len"))), F.lit(0)).alias("total")).head()
        if postings is not None:
            files = max(1, -(-told["total"] * self.POSTING_BYTES // self.FILE_BYTES), min(8, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
            postings(files).sortWithinPartitions("term", self.key).write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{self.folder}/postings-{v}")
            parts = [*parts, v]
        # Last, as it makes the version the one to read.
        self.spark.createDataFrame([(told["n"], told["average"], parts)], "n bigint, average double, parts array<int>").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/stats-{v}")
        for old in ("stats", "lengths"):
            self._fs().delete(self._path(f"{old}-{v - 2}"), True)
        for x in self._names():
            if x.startswith("postings-") and int(x.removeprefix("postings-")) not in {*parts, *before}:
                self._fs().delete(self._path(x), True)

    # ---- writing

    def _lengths(self, df: DataFrame, part: int) -> DataFrame:
        length = sum((n * F.size(tokens(F.col(c))) for c, n in Counter(self.columns).items()), F.lit(0))
        return df.select(self.key, *self.extra, length.alias("len"), F.lit(part).alias("part"))

    def _cut(self, df: DataFrame) -> DataFrame:
        """Postings of each row, made inside it: its words are sorted, and each run of one word becomes a posting."""
        own = Counter(self.columns)
        place = lambda i: lambda w, p: F.struct(w.alias("term"), (p + i * self.GAP).alias("p"))
        each = [F.transform(tokens(F.col(c)), place(i)) for i, c in enumerate(own)]
        words = df.select(self.key, F.sort_array(F.concat(*each)).alias("s"))
        n, term = F.size("s"), lambda i: F.get("s", i)["term"]
        first = F.filter(F.slice(F.sequence(F.lit(0), n), 1, n), lambda i: (i == 0) | (term(i) != term(i - 1)))
        runs = words.select(self.key, "s", first.alias("b"))
        at = lambda i, j: F.transform(F.sequence(i, F.coalesce(F.get("b", j + 1), n) - 1), lambda k: F.get("s", k)["p"])
        # Outer, as Spark cuts the texts twice for an inner one (it asks for the size of what it explodes first).
        rows = runs.select(self.key, F.explode_outer(F.transform("b", lambda i, j: F.struct(term(i).alias("term"), at(i, j).alias("at")))).alias("w")).where("w IS NOT NULL")
        return rows.select("w.term", self.key, self._times(F.col("w.at")).cast("int").alias("tf"), "w.at")

    def _times(self, places: Column) -> Column:
        """How many there are, once for each listing of their column."""
        own = list(Counter(self.columns).values())
        if len(own) == 1:
            return F.size(places) * own[0]
        times = F.create_map(*[x for i, n in enumerate(own) for x in (F.lit(i), F.lit(n))])
        return F.aggregate(places, F.lit(0), lambda s, p: s + times[F.floor(p / self.GAP).cast("int")])

    def _part(self, df: DataFrame):
        return lambda files: self._cut(df.select(self.key, *dict.fromkeys(self.columns)).repartition(files, self.key))

    def build(self, df: DataFrame) -> Index:
        """All anew."""
        self._write(self._lengths(df, self.version() + 1), [], self._part(df))
        return self

    def update(self, gone: DataFrame | None = None, fresh: DataFrame | None = None) -> Index:
        """Rows of gone (key) are taken out, those of fresh put in, in place of any with their key."""
        if len(self._stats()["parts"]) >= self.PARTS:
            self._fold()
        lengths, parts = self.lengths, self._stats()["parts"]
        out = [x.select(self.key) for x in (gone, fresh) if x is not None]
        if out:
            lengths = lengths.join(reduce(DataFrame.unionByName, out).distinct(), self.key, "left_anti")
        if fresh is not None:
            lengths = lengths.unionByName(self._lengths(fresh, self.version() + 1))
        self._write(lengths, parts, None if fresh is None else self._part(fresh))
        return self

    def _fold(self) -> None:
        """One part of all."""
        postings = self.postings
        self._write(self.lengths.withColumn("part", F.lit(self.version() + 1)), [], lambda files: postings.repartition(files, self.key))

    # ---- reading

    def _rows(self, where: Column | None = None) -> DataFrame:
        """Postings of all parts, with part: also those of rows that have been taken out since."""
        read = [self.spark.read.parquet(f"{self.folder}/postings-{p}").withColumn("part", F.lit(p)) for p in self._stats()["parts"]]
        rows = reduce(DataFrame.unionByName, read)
        return rows if where is None else rows.where(where)

    def _living(self, rows: DataFrame) -> DataFrame:
        """rows (key, part) without those of rows that have been taken out; an index of its first version has none."""
        return rows if self.version() == 1 else rows.join(self.lengths.select(self.key, "part"), [self.key, "part"], "left_semi")

    @property
    def postings(self) -> DataFrame:
        return self._living(self._rows()).select("term", self.key, "tf", "at")

    @property
    def lengths(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/lengths-{self.version()}")

    def statistics(self) -> DataFrame:
        """term, df: rows that hold it, and tf in all."""
        return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))

    def _hits(self, term: Term) -> DataFrame:
        """key, part and f, how often a row holds the term."""
        at = F.col("term")
        if len(term.words) == 1:
            word = term.words[0]
            return self._rows(at.startswith(word) if term.prefix else at == word).groupBy(self.key, "part").agg(F.sum("tf").alias("f"))
        # Places at which all words of the phrase stand one after the other, once for each listing of the column.
        moved = lambda i: lambda p: p - i
        starts = reduce(lambda a, b: a.join(b, [self.key, "part"]), [self._rows(at == w).select(self.key, "part", F.transform("at", moved(i)).alias(f"_p{i}")) for i, w in enumerate(term.words)])
        both = reduce(F.array_intersect, [F.col(f"_p{i}") for i in range(len(term.words))])
        return starts.select(self.key, "part", self._times(both).alias("f")).where("f > 0")

    def search(self, query: Query, k: int | None = 200) -> DataFrame:
        """Matching rows (key, extra, score), as `scan` gives them."""
        n, average, _ = self._stats()
        found = self._living(reduce(DataFrame.unionByName, [self._hits(t).withColumn("j", F.lit(j)) for j, t in enumerate(query.terms)]))
        df = found.groupBy("j").agg(F.count(F.lit(1)).alias("df"))  # a row a term
        scored = found.join(F.broadcast(df), "j").join(self.lengths, [self.key, "part"])
        value = idf(F.lit(n), F.col("df")) * part(F.col("f"), F.col("len"), F.lit(average))
        scored = scored.groupBy(self.key, *self.extra).agg((-F.sum(value)).alias("score"), F.count(F.lit(1)).alias("terms"))
        if query.every:
            scored = scored.where(F.col("terms") == len(query.terms))
        out = scored.select(self.key, *self.extra, "score")
        return out.orderBy("score", self.key).limit(k) if k else out

    def integrity(self, df: DataFrame) -> DataFrame:
        """Keys in the index or in df only, and in which; no rows if all is well."""
        a, b = self.lengths.select(self.key, F.lit(1).alias("p")), df.select(self.key).withColumn("f", F.lit(1))
        return a.join(b, self.key, "full").where("p IS NULL OR f IS NULL").select(self.key, F.when(F.col("p").isNull(), "no postings").otherwise("no row").alias("problem"))


_OPEN: dict[tuple[str, str], Index] = {}


def standing(name: str, source: str, df: DataFrame, columns: list[str], key: str, extra: tuple[str, ...] = ()) -> Index:
    """The index of a table, built in the shared folder when first asked for in an application."""
    spark = df.sparkSession
    at = (spark.sparkContext.applicationId, f"{source}:{name}")
    if at not in _OPEN:
        _OPEN[at] = Index(spark, shared_path(spark, f"index-{name}"), columns, key, extra).build(df)
    return _OPEN[at]
