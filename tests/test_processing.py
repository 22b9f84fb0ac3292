"""Processing of files, renames, settings, roots, jobs and plug-ins on small tables."""

import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from loomstone.functions.hashing import HashingEmbedder
from loomstone.operators import admin
from loomstone.plans import processing as pr
from loomstone.sources.files import extract, recognise
from loomstone.streaming import debounce

FILES = "file_id bigint, path string, filename string, dir_path string, extension string, file_type string, size_bytes bigint, mtime_ns bigint, content_hash string, status string, is_deleted int"
CHUNKS = "file_id bigint, source_type string, chunk_index int, chunk_text string, chunk_text_seg string, token_count int, embedding_status int"
CONTENT = "file_id bigint, hash string, text string, ocr_text string, confidence double, caption string, taken string, error string"


def file(k, kind, hash_=None, status="METADATA_ONLY", deleted=0, path=None, size=1):
    path = path or f"/d/{k}.x"
    return (k, path, path.rsplit("/", 1)[-1], path.rsplit("/", 1)[0], ".x", kind, size, 1, hash_, status, deleted)


def chunk(k, source, i, text, done=1):
    return (k, source, i, text, text, 1, done)


@pytest.fixture(scope="module")
def state(spark):
    vector = lambda text: [float(x) for x in HashingEmbedder(4).embed([text])[0]]
    files = [file(1, "doc", "h1", "AI_DONE"), file(2, "doc"), file(3, "doc", "h3", "AI_DONE"), file(4, "image", "i4", "AI_DONE", 1), file(5, "image"), file(6, "doc"), file(7, "doc"), file(8, "image"), file(9, "doc", "h9", "AI_DONE")]
    chunks = [chunk(1, "doc_chunk", 0, "one"), chunk(1, "doc_chunk", 1, "two"), chunk(3, "doc_chunk", 0, "old text"), chunk(3, "doc_chunk", 1, "old rest"), chunk(4, "ocr", 0, "sign"), chunk(4, "image_caption", 0, "a sign"), chunk(9, "doc_chunk", 0, "lost")]
    points = [(1, "doc_chunk", 0, 11, vector("one")), (3, "doc_chunk", 0, 31, vector("x")), (3, "doc_chunk", 1, 32, vector("x")), (4, "ocr", 0, 41, vector("sign"))]
    return pr.State(
        spark.createDataFrame(files, FILES),
        spark.createDataFrame(chunks, CHUNKS),
        spark.createDataFrame([(4, "sign", "zh+en", 0.7)], "file_id bigint, text string, lang string, confidence double"),
        spark.createDataFrame([(4, 5)], "file_id bigint, taken_epoch bigint"),
        spark.createDataFrame(points, "file_id bigint, source_type string, chunk_index int, vec_id bigint, embedding array<float>"),
    )


def test_process(spark, state):
    content = spark.createDataFrame(
        [
            (1, "h1", "one", None, None, None, None, None),  # as it was: nothing but a lost vector to heal
            (2, "h1", "one", None, None, None, None, None),  # what 1 holds
            (3, "new", "fresh text here", None, None, None, None, None),  # changed
            (5, "i4", None, "sign", 0.7, None, "1970:01:02 00:00:00", None),  # what the deleted 4 holds
            (6, None, None, None, None, None, None, "no such file"),
            (7, "h7", "  ", None, None, None, None, None),  # without text
            (8, "i8", None, "NewYork2026", 0.9, "bridge", None, None),
        ],
        CONTENT,
    )
    models = pr.Models(HashingEmbedder(4))
    out, told = pr.process(state, content, models)
    assert {r["file_id"]: (r["verdict"], r["error"]) for r in told.collect()} == {1: ("same_file", None), 2: ("clone", None), 3: ("none", None), 5: ("clone", None), 6: (None, "no such file"), 7: ("none", None), 8: ("none", None)}
    assert {r["file_id"]: (r["content_hash"], r["status"]) for r in out.files.collect()} == {1: ("h1", "AI_DONE"), 2: ("h1", "AI_DONE"), 3: ("new", "AI_DONE"), 4: ("i4", "AI_DONE"), 5: ("i4", "AI_DONE"), 6: (None, "FAILED"), 7: ("h7", "AI_DONE"), 8: ("i8", "AI_DONE"), 9: ("h9", "AI_DONE")}
    chunks = sorted((r["file_id"], r["source_type"], r["chunk_text"], r["embedding_status"]) for r in out.chunks.collect())
    assert chunks == sorted(
        [(1, "doc_chunk", "one", 1), (1, "doc_chunk", "two", 1), (2, "doc_chunk", "one", 1), (2, "doc_chunk", "two", 1), (3, "doc_chunk", "fresh text here", 1), (4, "ocr", "sign", 1), (4, "image_caption", "a sign", 1), (5, "ocr", "sign", 1), (5, "image_caption", "a sign", 1), (8, "ocr", "New York 2026", 1), (8, "image_caption", "bridge", 1), (9, "doc_chunk", "lost", 1)]
    )
    keys = sorted((r["file_id"], r["source_type"], r["chunk_index"]) for r in out.points.collect())
    # Every chunk of the batch has a vector; the changed file's second one is gone; 9, not of the batch, isn't healed.
    assert keys == sorted([(r["file_id"], r["source_type"], r["chunk_index"]) for r in out.chunks.where("file_id NOT IN (4, 9)").collect()] + [(4, "ocr", 0)])
    assert len({r["vec_id"] for r in out.points.collect()}) == len(keys)
    assert {r["file_id"]: r["text"] for r in out.ocr.collect()} == {4: "sign", 5: "sign", 8: "NewYork2026"}
    assert {r["file_id"]: r["taken_epoch"] for r in out.exif.collect()} == {4: 5, 5: 86400}
    # Again, from what was written: nothing new is found, and nothing changes.
    kept = pr.written(out)
    again, told = pr.process(kept, content, models)
    assert {r["file_id"]: r["verdict"] for r in told.where("error IS NULL").collect()} == {1: "same_file", 2: "same_file", 3: "same_file", 5: "same_file", 7: "none", 8: "same_file"}
    assert again.chunks.exceptAll(kept.chunks).count() == 0 and again.points.count() == kept.points.count()


@pytest.mark.parametrize("embedding", [None, HashingEmbedder(4)])
def test_copies_of_sources_that_change_in_the_same_batch(spark, state, embedding):
    before = replace(state, files=state.files.where("file_id <> 5").unionByName(spark.createDataFrame([file(5, "image", "i5", "AI_DONE")], FILES)))
    rows = [
        (2, "h1", "one", None, None, None, None, None),  # what 1 held, which holds other text now
        (1, "h1b", "now long and other text", None, None, None, None, None),
        (3, "h1", "one", None, None, None, None, None),  # a copy of 1 now, and 7 has what it held
        (7, "h3", "old text", None, None, None, None, None),
        (5, "i4", None, "sign", 0.7, None, None, None),  # what 4 held, whose picture is another now
        (4, "i4b", None, "door", 0.2, "a door", None, None),
    ]
    out, told = pr.process(before, spark.createDataFrame(rows, CONTENT), pr.Models(embedding))
    assert {r["file_id"]: r["verdict"] for r in told.collect()} == {1: "none", 2: "clone", 3: "clone", 4: "none", 5: "clone", 7: "clone"}
    chunks = sorted((r["file_id"], r["source_type"], r["chunk_text"]) for r in out.chunks.where("file_id <> 9").collect())
    old = [(k, "doc_chunk", x) for k in (2, 3) for x in ("one", "two")] + [(7, "doc_chunk", x) for x in ("old text", "old rest")] + [(5, "ocr", "sign"), (5, "image_caption", "a sign")]
    assert chunks == sorted([*old, (1, "doc_chunk", "now long and other text"), (4, "ocr", "door"), (4, "image_caption", "a door")])
    assert {r["file_id"]: (r["text"], r["confidence"]) for r in out.ocr.collect()} == {4: ("door", 0.2), 5: ("sign", 0.7)}
    # Vectors come from the state before as well; 1's second chunk and 4's caption had none to copy.
    status = {(r["file_id"], r["source_type"], r["chunk_index"]): r["embedding_status"] for r in out.chunks.where("file_id <> 9").collect()}
    copied = {(2, "doc_chunk", 0), (3, "doc_chunk", 0), (7, "doc_chunk", 0), (7, "doc_chunk", 1), (5, "ocr", 0)}
    assert {k for k, v in status.items() if v == 1} == (set(status) if embedding else copied)
    vectors = {(r["file_id"], r["source_type"], r["chunk_index"]): list(r["embedding"]) for r in out.points.collect()}
    held = {(r["file_id"], r["source_type"], r["chunk_index"]): list(r["embedding"]) for r in state.points.collect()}
    for key in copied:
        source = {2: 1, 3: 1, 7: 3, 5: 4}[key[0]]
        assert vectors[key] == held[(source, *key[1:])]


def test_without_models_chunks_stay_pending(spark, state):
    content = spark.createDataFrame([(2, "hx", "some text", None, None, None, None, None)], CONTENT)
    out, _ = pr.process(state, content, pr.Models())
    assert [r["embedding_status"] for r in out.chunks.where("file_id = 2").collect()] == [0] and out.points.where("file_id = 2").count() == 0
    later = pr.embed_pending(out, pr.Models(HashingEmbedder(4)))
    assert later.points.where("file_id = 2").count() == 1 and later.chunks.where("embedding_status <> 1").count() == 0
    healed = pr.heal(state, pr.Models(HashingEmbedder(4)), state.files.where("file_id = 9"))
    assert healed.points.where("file_id = 9").count() == 1 and healed.points.where("file_id = 1").count() == 1


def test_changed_meanwhile(spark, state):
    content = spark.createDataFrame([(k, f"n{k}", "t", None, None, None, None, None) for k in (2, 6, 7)], CONTENT)
    after = spark.createDataFrame([(2, 5, 1, "other"), (6, 5, 1, "n6"), (7, 1, 1, "other")], "file_id bigint, size_bytes bigint, mtime_ns bigint, hash string")
    out, told = pr.process(state, content, pr.Models(), after)
    assert {r["file_id"]: r["error"] for r in told.collect()} == {2: "file changed during processing", 6: None, 7: None}
    assert {r["file_id"]: r["status"] for r in out.files.where("file_id IN (2, 6, 7)").collect()} == {2: "FAILED", 6: "AI_DONE", 7: "AI_DONE"}


def test_renames(spark, state):
    files = state.files.unionByName(spark.createDataFrame([file(20, "doc", path="/new/a.PDF"), file(21, "doc", path="/new/b.x", size=9), file(22, "doc", path="/gone/c.x", deleted=1)], FILES))
    moves = spark.createDataFrame([("/d/2.x", "/new/a.PDF"), ("/d/6.x", "/new/b.x"), ("/d/7.x", "/gone/c.x"), ("/d/1.x", "/d/3.x"), ("/none", "/new/z")], "path string, target string")
    plan = pr.rename_plan(files, state.chunks, moves)
    assert {r["path"]: r["verdict"] for r in plan.collect()} == {"/d/2.x": "merge", "/d/6.x": "conflict", "/d/7.x": "rename", "/d/1.x": "conflict", "/none": "new"}
    after = {r["file_id"]: r for r in pr.renamed(files, plan).collect()}
    assert after[2]["path"] == "/new/a.PDF" and after[2]["extension"] == ".pdf" and after[2]["dir_path"] == "/new" and 20 not in after and after[7]["filename"] == "c.x" and after[6]["path"] == "/d/6.x"
    assert sorted(r["path"] for r in pr.look_again(plan).collect()) == ["/d/1.x", "/d/3.x", "/d/6.x", "/new/b.x", "/new/z"]


def test_settings(spark):
    settings = spark.createDataFrame([("topK", "20"), ("w_kw", "2.5"), ("other", '"x"')], "key string, value string")
    assert admin.current(settings) == {"search_mode": "hybrid", "w_kw": 2.5, "w_sem": 1.0, "topK": 20}
    assert admin.checked({"topK": 200, "w_sem": None, "x": 1, "search_mode": "keyword"}) == {"topK": 200, "search_mode": "keyword"}
    for bad in ({"topK": 0}, {"topK": 201}, {"topK": 1.5}, {"w_kw": 0.01}, {"w_sem": 11}, {"search_mode": "best"}, {"w_kw": True}):
        with pytest.raises(ValueError):
            admin.checked(bad)


def test_recognisers_and_readers(spark):
    def read(raw):
        if raw == b"?":
            raise ValueError("broken")
        return [(x, 0.5) for x in raw.decode().split("|")]

    rows = spark.createDataFrame([(1, ".png", bytearray(b"a| |b")), (2, ".png", bytearray(b"")), (3, ".png", bytearray(b"?")), (4, ".zzz", bytearray(b"q"))], "k int, e string, c binary")
    got = {r["k"]: r for r in rows.select("k", recognise(F.col("c"), read).alias("o"), extract(F.col("e"), F.col("c"), {".zzz": lambda raw: raw.decode() * 2}).alias("x")).collect()}
    assert got[1]["o"]["text"] == "a b" and got[1]["o"]["confidence"] == 0.5 and got[2]["o"]["confidence"] == 0.0 and got[2]["o"]["text"] == "" and got[3]["o"]["error"] == "ValueError: broken"
    assert got[4]["x"]["text"] == "qq" and "no reader" in got[1]["x"]["error"]


def wait(seen, n):
    end = time.time() + 90
    while len(seen) < n and time.time() < end:
        time.sleep(0.5)


def test_streamed_renames(spark, tmp_path):
    rows = [("/a", "modified", 0.0, None), ("/a", "moved", 0.5, "/b"), ("/b", "modified", 1.0, None), ("/c", "created", 1.0, None), ("/z", "created", 100.0, None)]
    e = spark.createDataFrame(rows, "path string, kind string, s double, dest string").select("path", "kind", "dest", F.timestamp_micros((F.col("s") * 1000000).cast("long")).alias("ts"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    q = debounce.start(debounce.read_changes(spark, str(tmp_path / "in"), e.schema), lambda action, df, epoch: seen.extend((action, r["path"], r["target"]) for r in df.collect()), str(tmp_path / "cp"), every="0 seconds")
    wait(seen, 3)
    q.stop()
    assert seen[-1] == ("rename", "/a", "/b") and sorted(seen) == [("change", "/b", None), ("change", "/c", None), ("rename", "/a", "/b")]


def test_streamed_replay_goes_on_after_its_cursor(spark, tmp_path):
    schema = "usn bigint, file_ref bigint, path string, reason int"
    spark.createDataFrame([(1, 1, "/a", 0x1000), (2, 1, "/b", 0x2000), (3, 2, "/c", 0x200)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []

    def run():
        source = debounce.read_changes(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        debounce.replaying(source, lambda action, df, epoch: seen.extend((action, r["path"]) for r in df.collect()), str(tmp_path / "cp")).awaitTermination(120)

    run()
    assert seen == [("delete", "/c"), ("rename", "/a")]
    spark.createDataFrame([(4, 3, "/d", 0x100)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert seen[2:] == [("upsert", "/d")]


def test_a_batch_writes_what_it_changes(spark, state, monkeypatch):
    """Chunks and points of other files aren't written again, and no text is written twice."""
    wrote = []
    saved = pr._saved
    monkeypatch.setattr(pr, "_saved", lambda df, name: wrote.append(saved(df, name)) or wrote[-1])
    content = spark.createDataFrame([(2, "h1", "one", None, None, None, None, None), (3, "new", "fresh text here", None, None, None, None, None)], CONTENT)
    out, _ = pr.process(state, content, pr.Models())
    rows = [(r["file_id"], r["chunk_text"]) for df in wrote if "chunk_text" in df.columns for r in df.collect()]
    assert sorted(rows) == [(2, "one"), (2, "two"), (3, "fresh text here")]
    assert {r["file_id"] for df in wrote if "vec_id" in df.columns for r in df.collect()} == {2}
    kept = sorted((r["file_id"], r["chunk_text"]) for r in state.chunks.where("file_id <> 3").collect())
    assert sorted((r["file_id"], r["chunk_text"]) for r in out.chunks.collect()) == sorted([*kept, *rows])


def test_one_worker_of_a_task_cuts_and_segments(spark):
    """A second Python function would hold a batch of texts besides; chunks leave a worker in small batches."""
    from loomstone.functions.chunk import chunks, segmented

    texts = [None, "", "a b. " * 900, "one\n\ntwo 机器学习"] * 3
    rows = spark.createDataFrame([(i, t, "NewYork2026" if i == 1 else None, "a sign" if i == 1 else "") for i, t in enumerate(texts)], "file_id long, text string, ocr_text string, caption string").coalesce(1)
    df = pr.fresh_chunks(rows, pr.Models())
    told = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in told and "EvalPython" not in told
    got = [(r["file_id"], r["source_type"], r["chunk_index"], r["chunk_text"], r["chunk_text_seg"]) for r in df.collect()]
    want = [(i, "doc_chunk", j, c, segmented(c)) for i, t in enumerate(texts) for j, c in enumerate(chunks(t))]
    assert sorted(got) == sorted([*want, (1, "ocr", 0, "New York 2026", "New York 2026"), (1, "image_caption", 0, "a sign", "a sign")])
