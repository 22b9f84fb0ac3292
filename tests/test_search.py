"""Keyword and vector channels, fusion and what failures come to."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from loomstone.operators import bm25, search
from loomstone.operators.filters import UnifiedFilter
from loomstone.plans.hybrid import ChannelError, Engine, percentile

ROWS = [("机器学习 note", "机器 学习 note"), ("cat", "cat cat dog"), ("resume.pdf", "resume . pdf"), ("Éclair_x", "a b c d e f"), ("zz", "机器 学 学习"), ("dog house", "a dog in the dog house the dog")]


def fts5(expression):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(a, b, tokenize='unicode61')")
    db.executemany("insert into t(a, b) values (?, ?)", ROWS)
    return [(k, round(s, 9)) for k, s in db.execute("select rowid, bm25(t) from t where t match ? order by bm25(t), rowid", (expression,))]


@pytest.mark.parametrize(
    ("words", "form", "expression"),
    [(["cat"], 0, "cat*"), (["机器", "学习"], 1, "机器* AND 学习*"), (["机器", "学习"], 0, '"机器 学习"'), (["dog", "a"], 2, "dog* OR a*"), (["the", "dog"], 0, '"the dog"'), (["器学"], 0, "器学*")],
)
def test_bm25_is_that_of_fts5(spark, tmp_path, words, form, expression):
    df = spark.createDataFrame([(i + 1, *r) for i, r in enumerate(ROWS)], "file_id bigint, a string, b string")
    q = bm25.forms(words)[form]
    got = [(r["file_id"], round(r["score"], 9)) for r in bm25.scan(df, ["a", "b"], q).collect()]
    assert got == fts5(expression)
    index = bm25.Index(spark, f"file://{tmp_path}/index", ["a", "b"], "file_id").build(df.where("file_id <> 2"))
    # The second row is put in later, others are taken out and put in again.
    index.update(gone=df.where("file_id = 4"), fresh=df.where("file_id IN (2, 3)")).update(fresh=df.where("file_id = 4"))
    assert index.version() == 3 and index.integrity(df).count() == 0
    assert [(r["file_id"], round(r["score"], 9)) for r in index.search(q).collect()] == expression_rows(expression)


def expression_rows(expression):
    return fts5(expression)


def test_index_counts_listed_columns_and_prunes(spark, tmp_path):
    df = spark.createDataFrame([(i, f"w{i % 50} word{i:04} the lazy dog", "x") for i in range(2000)], "k bigint, t string, e string")
    index = bm25.Index(spark, f"file://{tmp_path}/index", ["t", "t"], "k", ("e",)).build(df)
    for q in (bm25.Query((bm25.Term(("lazy", "dog")),)), *bm25.forms(["w7", "word00"])[1:]):
        want = [(r["k"], round(r["score"], 9)) for r in bm25.scan(df, ["t", "t"], q, key="k").collect()]
        assert [(r["k"], round(r["score"], 9)) for r in index.search(q).collect()] == want and want
    told = index.postings.where(F.col("term").startswith("word00"))._jdf.queryExecution().toString()
    assert "StringStartsWith(term,word00)" in told
    empty = bm25.Index(spark, f"file://{tmp_path}/none", ["t"], "k").build(df.where("false"))
    assert empty.search(bm25.forms(["a"])[0]).count() == 0 and empty.update(fresh=df).search(bm25.forms(["w7"])[0]).count() == 40


@pytest.fixture(scope="module")
def engine(spark):
    files = spark.createDataFrame(
        [(1, "/x/photo-cat.jpg", "photo-cat.jpg", ".jpg", "image", 0), (2, "/x/cat-notes.txt", "cat-notes.txt", ".txt", "doc", 0), (3, "/x/dog.txt", "dog.txt", ".txt", "doc", 0), (4, "/x/cat-old.txt", "cat-old.txt", ".txt", "doc", 1), (5, "/x/cat-cat.md", "cat-cat.md", ".md", "doc", 0)],
        "file_id bigint, path string, filename string, extension string, file_type string, is_deleted int",
    ).selectExpr("*", "'/x' AS dir_path", "10L AS size_bytes", "file_id * 1000000000 AS mtime_ns", "file_id * 1000000000 AS ctime_ns")
    chunks = spark.createDataFrame([(10, 1, "image_caption", 0, "a sleeping cat"), (11, 2, "doc_chunk", 0, "a cat is an animal"), (12, 3, "doc_chunk", 0, "the dog met a cat"), (13, 4, "doc_chunk", 0, "cat")], "chunk_id bigint, file_id bigint, source_type string, chunk_index int, chunk_text string")
    points = spark.createDataFrame([(1, 1, "image_caption", 0, [1.0, 0.0]), (2, 2, "doc_chunk", 0, [0.9, 0.1]), (3, 3, "doc_chunk", 0, [0.0, 1.0]), (4, 4, "doc_chunk", 0, [1.0, 0.0]), (5, 2, "doc_chunk", 7, [1.0, 0.0])], "vec_id bigint, file_id bigint, source_type string, chunk_index int, embedding array<double>")
    exif = spark.createDataFrame([(1, 500)], "file_id bigint, taken_epoch bigint")
    return Engine(files, exif, chunks, points, lambda text: [1.0, 0.0])


def test_semantic_excludes_orphans_and_deleted(engine):
    got = search.semantic(engine.points, engine.chunks, engine.files, engine.exif, [1.0, 0.0]).collect()
    assert [r["file_id"] for r in got] == [1, 2, 3] and got[0]["score"] == pytest.approx(1.0)
    only = search.semantic(engine.points, engine.chunks, engine.files, engine.exif, [1.0, 0.0], UnifiedFilter(extensions=("txt",))).collect()
    assert [r["file_id"] for r in only] == [2, 3]


def test_rank_direction_of_both_modes(engine):
    q = bm25.forms(["cat"])[0]
    names = bm25.scan(engine.files.where("is_deleted = 0"), ["filename"], q)
    bodies = bm25.scan(engine.chunks.where("source_type <> 'image_caption' and file_id <> 4"), ["chunk_text"], q, key="chunk_id")
    by = {m: [r["file_id"] for r in search.merge_keyword(names, bodies, m).orderBy("rank").collect()] for m in ("reference", "relevance")}
    assert by["reference"][0] == 3  # a body hit only keeps 0, the largest score
    assert by["relevance"][-1] != by["reference"][-1] and set(by["reference"]) == set(by["relevance"]) == {1, 2, 3, 5}


def test_hybrid(engine):
    out = engine.search("cat", k=10)
    rows = out.results.collect()
    assert out.degraded == [] and {r["file_id"] for r in rows} == {1, 2, 3, 5}
    both = next(r for r in rows if r["file_id"] == 2)
    assert both["rrf_score"] > 1 / 61 and {x["channel"] for x in both["match_reasons"]} == {"filename", "body", "semantic"}
    assert all(a["rrf_score"] >= b["rrf_score"] for a, b in zip(rows, rows[1:], strict=False))
    assert {"parser", "fts", "semantic", "finalize", "total"} <= set(out.stages_ms)


def test_indexes_stand_for_scans(spark, engine, tmp_path):
    from dataclasses import replace

    names = bm25.Index(spark, f"file://{tmp_path}/n", ["filename", "filename", "dir_path"], "file_id").build(engine.files)
    bodies = bm25.Index(spark, f"file://{tmp_path}/b", ["chunk_text", "chunk_text"], "chunk_id", ("file_id", "source_type")).build(engine.chunks.where(F.col("source_type").isin(*search.BODY_TYPES)))
    by_index = replace(engine, names=names, bodies=bodies)
    rows = lambda e, q: [(r["file_id"], round(r["rrf_score"], 9)) for r in e.search(q, k=10).results.collect()]
    for query in ("cat", "cat dog", "sleeping"):
        assert rows(by_index, query) == rows(engine, query)


def test_queries_are_embedded_with_an_instruction(engine):
    from dataclasses import replace

    seen = []
    other = replace(engine, embed=lambda text: seen.append(text) or [1.0, 0.0])
    got = other.semantic_only("2026-08-14 图片", k=4).collect()
    assert seen[0].endswith("2026-08-14 图片") and len(seen[0]) > 20 and [r["file_id"] for r in got] == [1, 2] and got[0]["path"] == "/x/photo-cat.jpg"
    with pytest.raises(ChannelError):
        replace(engine, embed=None).semantic_only("x")


def test_captions_aren_t_keywords(engine):
    assert [r["file_id"] for r in engine.search("sleeping", mode="keyword").results.collect()] == []


def test_metadata_only_and_empty(engine):
    rows = engine.search("图片", k=5).results.collect()
    assert [r["file_id"] for r in rows] == [1] and rows[0]["rrf_score"] is None and rows[0]["time_info"]["basis"] == "exif"
    assert engine.search("   ").results is None


def test_degradation(engine):
    from dataclasses import replace

    def broken(text):
        raise RuntimeError("no model")

    out = replace(engine, embed=broken).search("cat")
    assert out.degraded == ["semantic"] and out.results.count() > 0
    assert replace(engine, embed=None).search("cat").degraded == ["semantic"]
    with pytest.raises(ChannelError, match="SEMANTIC_CHANNEL_FAILED"):
        replace(engine, embed=None).search("cat", mode="semantic")
    with pytest.raises(ChannelError, match="SEMANTIC_CHANNEL_FAILED"):
        replace(engine, embed=broken).search("cat", mode="semantic")
    no_keywords = replace(engine, chunks=engine.chunks.withColumn("chunk_text", F.raise_error(F.lit("lost")).cast("string")))
    with pytest.raises(ChannelError, match="KEYWORD_CHANNEL_FAILED"):
        no_keywords.search("cat", mode="keyword")
    with pytest.raises(ChannelError, match="BOTH_CHANNELS_FAILED"):
        replace(no_keywords, embed=broken).search("cat")


def test_fusion_commutes_and_weighs(spark):
    a = spark.createDataFrame([(1, 1, 5.0), (2, 2, 4.0)], "file_id bigint, rank int, score double")
    b = spark.createDataFrame([(2, 1, 0.9), (3, 2, 0.8)], "file_id bigint, rank int, score double")
    one = {r[0]: r[1] for r in search.fuse(a, b).collect()}
    assert one == pytest.approx({r[0]: r[1] for r in search.fuse(b, a).collect()}) and max(one, key=one.get) == 2
    heavy = {r[0]: r[1] for r in search.fuse(a, b, 10, 1).collect()}
    assert heavy[1] == pytest.approx(10 / 61) and heavy[3] == pytest.approx(1 / 62)


def test_percentile():
    assert percentile([5, 1, 3, 2, 4], 0.5) == 3 and percentile([1.0], 0.95) == 1.0


def test_postings_are_made_without_shuffling_words(spark, tmp_path):
    """Texts are exchanged once, before they are cut, and no posting is (words by the million would be shuffled and spilled)."""
    long = " ".join(f"w{i % 97}" for i in range(3000))
    df = spark.createDataFrame([(1, "b a b", "a"), (2, None, ""), (3, "", None), (4, "..", "Été"), (5, long, "w1")], "k bigint, t string, u string")
    index = bm25.Index(spark, f"file://{tmp_path}/index", ["t", "t", "u"], "k")
    postings = index._part(df)(3)
    told = postings.sortWithinPartitions("term", "k")._jdf.queryExecution().executedPlan().toString()
    assert told.count("Exchange") == 1 and "Aggregate" not in told
    got = {(r["term"], r["k"]): (r["tf"], r["at"]) for r in postings.collect()}
    gap = bm25.Index.GAP
    assert got[("b", 1)] == (4, [0, 2]) and got[("a", 1)] == (3, [1, gap]) and got[("ete", 4)] == (1, [gap])
    assert got[("w1", 5)] == (2 * len(range(1, 3000, 97)) + 1, [*range(1, 3000, 97), gap]) and len(got) == 3 + 97
    index.build(df)
    assert {(r["k"], r["len"]) for r in index.lengths.collect()} == {(1, 7), (2, 0), (3, 0), (4, 1), (5, 6001)}


def test_reasons_deal_only_texts_that_are_told(spark, engine):
    """However large the tables are: what a channel's few rows don't ask for isn't dealt."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kw = spark.createDataFrame([(2, -1.0, [("body", 11, -1.0), ("filename", None, -2.0)], 1)], "file_id bigint, score double, evidence array<struct<channel:string,chunk_id:bigint,score:double>>, rank int")
        sem = search.held(search.semantic(engine.points, engine.chunks, engine.files, engine.exif, [1.0, 0.0]))
        out = search.finalize(search.fuse(kw, sem), engine.files, engine.exif, engine.chunks, kw, sem, search.UnifiedFilter())
        told = out._jdf.queryExecution().optimizedPlan().toString()
        # files and exif, and the texts of each channel
        assert told.count("Join LeftSemi") >= 4 and told.count("strategy=broadcast") >= 4
        got = {r["file_id"]: [(x["channel"], x["text"]) for x in r["match_reasons"]] for r in out.collect()}
        assert ("body", "a cat is an animal") in got[2] and ("filename", None) in got[2]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_update_leaves_other_postings_as_they_are(spark, tmp_path):
    df = spark.createDataFrame([(i, f"w{i} dog") for i in range(20)], "k bigint, t string")
    index = bm25.Index(spark, f"file://{tmp_path}/index", ["t"], "k").build(df)
    files = lambda: {f.name: f.stat().st_mtime_ns for f in (tmp_path / "index" / "postings-1").iterdir()}
    before = files()
    index.update(gone=df.where("k < 5"), fresh=df.where("k = 7").withColumn("t", F.lit("cat dog")))
    assert files() == before and spark.read.parquet(f"{tmp_path}/index/postings-2").count() == 2
    got = {r["term"]: (r["df"], r["cf"]) for r in index.statistics().collect()}
    assert got["dog"] == (15, 15) and got["cat"] == (1, 1) and "w3" not in got and "w7" not in got
