"""Snapshots, tasks, events, sources and the stream."""

import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from loomstone.functions.hashing import content_hash, embed, point_id
from loomstone.operators import events, ingest, tasks
from loomstone.sources.files import exif_time, extract, scan_tree
from loomstone.streaming import debounce

FILE = "file_id bigint, path string, filename string, dir_path string, extension string, file_type string, size_bytes bigint, mtime_ns bigint, ctime_ns bigint, content_hash string, status string, is_deleted int"


def file(k, path, size=1, status="METADATA_ONLY", deleted=0, mtime=1, kind="doc"):
    return (k, path, path.rsplit("/", 1)[-1], "/", ".txt", kind, size, mtime, 1, "h", status, deleted)


def test_upsert(spark):
    known = spark.createDataFrame([file(1, "/a"), file(2, "/b", status="AI_DONE"), file(3, "/c", status="FAILED"), file(4, "/d", deleted=1), file(5, "/e")], FILE)
    scanned = spark.createDataFrame([file(None, "/a"), file(None, "/b", 2), file(None, "/c", 2), file(None, "/d"), file(None, "/new1"), file(None, "/new2")], FILE).drop("file_id", "status", "is_deleted", "content_hash")
    got = {r["path"]: r for r in ingest.upsert(known, scanned).collect()}
    assert {p: r["op"] for p, r in got.items()} == {"/a": "keep", "/b": "update", "/c": "update", "/d": "revive", "/e": "keep", "/new1": "insert", "/new2": "insert"}
    assert got["/b"]["status"] == "METADATA_ONLY" and got["/c"]["status"] == "FAILED" and got["/d"]["file_id"] == 4
    assert {got["/new1"]["file_id"], got["/new2"]["file_id"]} == {6, 7}
    again = ingest.upsert(spark.createDataFrame([tuple(r)[:-2] for r in got.values()], ingest.upsert(known, scanned).drop("op", "index_op").schema).select(*[c.split()[0] for c in FILE.split(", ")]), scanned)
    assert {r["op"] for r in again.collect()} == {"keep"}
    folded = ingest.upsert(known, scanned.withColumn("path", F.upper("path")), fold_case=True)
    assert folded.where("op = 'insert'").count() == 2
    assert {r["file_id"]: r["path"] for r in folded.where("file_id < 6").collect()} == {1: "/A", 2: "/B", 3: "/C", 4: "/D", 5: "/e"}
    assert got["/b"]["content_hash"] == "h" and got["/d"]["content_hash"] == "h" and got["/new1"]["content_hash"] is None
    assert {p: r["index_op"] for p, r in got.items()} == {"/a": None, "/b": None, "/c": None, "/d": "insert", "/e": None, "/new1": "insert", "/new2": "insert"}
    elsewhere = ingest.upsert(known, scanned.where("path = '/a'").withColumn("dir_path", F.lit("/other"))).where("file_id = 1").head()
    assert elsewhere["index_op"] == "replace" and elsewhere["op"] == "keep" and elsewhere["dir_path"] == "/other"
    assert [r["path"] for r in ingest.missing_on_disk(known, scanned).collect()] == ["/e"]
    twice = ingest.soft_delete(ingest.soft_delete(known, known.where("file_id = 1")), known.where("file_id = 1"))
    assert sorted(r["file_id"] for r in twice.where("is_deleted = 1").collect()) == [1, 4]


def test_reuse_and_completeness(spark):
    """Same file, clones of the smallest complete source (a deleted one, too), an incomplete source, another type."""
    rows = [file(1, "/1"), file(2, "/2", deleted=1), file(3, "/3"), file(4, "/4"), file(5, "/5"), file(6, "/6", kind="image"), file(7, "/7", kind="image"), file(8, "/8", kind="image"), file(9, "/9")]
    hashes = {1: "x", 2: "y", 3: "y", 4: "z", 5: "z", 6: "i", 7: "i", 8: "x", 9: None}
    files = spark.createDataFrame([(*r[:9], hashes[r[0]], *r[10:]) for r in rows], FILE)
    chunks = spark.createDataFrame([(10, 1, "doc_chunk", 0, "a", 1), (11, 1, "doc_chunk", 1, "b", 1), (12, 2, "doc_chunk", 0, "c", 1), (13, 4, "doc_chunk", 0, "d", 0), (14, 5, "doc_chunk", 0, "d", 1), (15, 6, "ocr", 0, "e", 1), (16, 7, "image_caption", 0, "f", 1), (17, 8, "doc_chunk", 0, "g", 1)], "chunk_id bigint, file_id bigint, source_type string, chunk_index int, chunk_text string, embedding_status int")
    ocr = spark.createDataFrame([(6, ""), (8, "")], "file_id bigint, text string")
    assert {r["file_id"] for r in ingest.completeness(files, chunks, ocr).where("ai_complete").collect()} == {1, 2, 5, 6}
    assert {r["file_id"] for r in ingest.completeness(files, chunks).where("ai_complete").collect()} == {1, 2, 5, 6, 7}
    complete = ingest.completeness(files, chunks, ocr)
    fresh = spark.createDataFrame([(1, "x"), (3, "y"), (5, "z"), (4, "z"), (7, "i"), (8, "x"), (9, "x"), (2, "new")], "file_id bigint, hash string")
    got = {r["file_id"]: (r["verdict"], r["source_id"]) for r in ingest.reuse(files, fresh, complete).collect()}
    # 4 takes 5; 5 is complete itself; a 9 of the same content as 4 and 5 would look at 4 alone, which isn't complete.
    assert got == {1: ("same_file", None), 3: ("clone", 2), 5: ("same_file", None), 4: ("clone", 5), 7: ("clone", 6), 8: ("none", None), 9: ("clone", 1), 2: ("none", None)}
    assert ingest.reuse(files, spark.createDataFrame([(9, "z")], "file_id bigint, hash string"), complete).head()["verdict"] == "none"
    plan = ingest.reuse(files, fresh, complete).where("verdict = 'clone'")
    assert sorted((r["file_id"], r["chunk_text"]) for r in ingest.clone_chunks(chunks, plan).collect()) == [(3, "c"), (4, "d"), (7, "e"), (9, "a"), (9, "b")]


def test_tasks(spark):
    rows = [(1, 1, 1, "PENDING", 0, 5), (2, 2, 0, "PENDING", 0, 6), (3, 3, 0, "FAILED", 3, 7), (4, 4, 0, "FAILED", 1, 8), (5, 5, 0, "RUNNING", 1, 9), (6, 6, 0, "SUCCESS", 1, 9)]
    t = spark.createDataFrame(rows, "task_id bigint, file_id bigint, priority int, status string, attempt int, updated_at bigint").withColumn("max_attempts", F.lit(3))
    assert [r["task_id"] for r in tasks.claim(t, 2).collect()] == [2, 1]
    assert tasks.stats(t).head().asDict() == {"pending": 2, "running": 1, "success": 1, "failed": 2, "total": 6}
    wanted = spark.createDataFrame([(k,) for k in (1, 3, 4, 99)], "task_id bigint")
    assert {r[0]: r[1] for r in tasks.retry(t, wanted).collect()} == {1: "NOT_FAILED", 3: "MAX_ATTEMPTS", 4: "RETRIED", 99: "NOT_FOUND"}
    assert {r["task_id"]: r["result"] for r in tasks.reindex(t, wanted).collect()} == {1: "ALREADY_ACTIVE", 3: "QUEUED", 4: "QUEUED", 99: "NOT_FOUND"}
    assert tasks.recover(t).where("status = 'RUNNING'").count() == 0
    done = spark.createDataFrame([(5, None), (1, "x" * 5000)], "task_id bigint, error string")
    end = {r["task_id"]: r for r in tasks.finish(t, done).collect()}
    assert end[5]["status"] == "SUCCESS" and end[1]["status"] == "FAILED" and len(end[1]["last_error"]) == 2000 and end[2]["status"] == "PENDING"
    again = {r["task_id"]: r for r in tasks.finish(tasks.finish(t, done), spark.createDataFrame([(1, None)], "task_id bigint, error string"), 77).collect()}
    assert len(again[1]["last_error"]) == 2000 and again[1]["status"] == "SUCCESS" and again[1]["updated_at"] == 77 and again[5]["updated_at"] == 9
    files = spark.createDataFrame([file(1, "/a"), file(7, "/b"), file(8, "/c", kind="video"), file(4, "/d")], FILE)
    after, states = tasks.claimed(t, files, 50, 1)
    assert {r["task_id"]: (r["status"], r["attempt"]) for r in after.collect()}[2] == ("RUNNING", 1) and after.where("status = 'RUNNING'").count() == 2
    after, states = tasks.claimed(t, files, 50, 2)
    assert {r["file_id"]: r["status"] for r in states.collect()} == {1: "PROCESSING", 7: "METADATA_ONLY", 8: "METADATA_ONLY", 4: "METADATA_ONLY"}
    assert {r["file_id"]: r["status"] for r in tasks.finish_files(files, t, spark.createDataFrame([(1, None), (4, "bad")], "task_id bigint, error string")).collect()} == {1: "AI_DONE", 4: "FAILED", 7: "METADATA_ONLY", 8: "METADATA_ONLY"}
    new = tasks.reindexed(t, wanted, 60).where("task_id > 6").collect()
    assert sorted((r["task_id"], r["file_id"], r["priority"], r["status"]) for r in new) in ([(7, 3, 0, "PENDING"), (8, 4, 0, "PENDING")], [(7, 4, 0, "PENDING"), (8, 3, 0, "PENDING")])
    assert [r["task_id"] for r in tasks.retried(t, wanted, 60).where("updated_at = 60").collect()] == [4]
    assert [r["task_id"] for r in tasks.with_files(t, files, t).collect()] in ([1, 4], [4, 1])
    assert {r["file_id"] for r in tasks.enqueue(t, files).collect()} == {7, 4}
    assert tasks.failed(t, files.where("false")).head()["filename"] == "<deleted>"


def at(spark, rows, schema="path string, kind string, s double, dest string"):
    df = spark.createDataFrame([(*r, None)[:4] for r in rows], schema)
    return df.withColumns({"ts": F.timestamp_micros(F.round(F.col("s") * 1000000).cast("long")), "event_id": (F.col("s") * 1000).cast("long")})


def told(df):
    return sorted((r["flush_start"].timestamp(), r["step"], r["action"], r["path"], r["target"] or "") for r in df.collect())


def test_debounce(spark):
    rows = [("/a", "created", 0.0), ("/a", "deleted", 1.0), ("/b", "created", 1.5), ("/b", "modified", 2.0), ("/c", "deleted", 9.0), ("/c", "modified", 9.5), ("/a", "created", 30.0)]
    got = told(events.debounce(at(spark, rows)))
    assert got == [(0, 1, "change", "/b", ""), (9, 2, "delete", "/c", ""), (30, 1, "change", "/a", "")]
    # A move puts the end of its batch off, and what was pending for its paths is forgotten; what comes after isn't.
    rows = [("/a", "modified", 0.0), ("/b", "created", 0.5), ("/a", "moved", 1.5, "/b"), ("/b", "modified", 3.0), ("/z", "created", 3.2), ("/a", "created", 20.0)]
    assert told(events.debounce(at(spark, rows))) == [(0, 1, "change", "/b", ""), (0, 1, "change", "/z", ""), (0, 3, "rename", "/a", "/b"), (20, 1, "change", "/a", "")]
    # A move of another batch leaves earlier ones alone.
    rows = [("/a", "modified", 0.0), ("/a", "moved", 10.0, "/b")]
    assert told(events.debounce(at(spark, rows))) == [(0, 1, "change", "/a", ""), (10, 3, "rename", "/a", "/b")]
    roots = spark.createDataFrame([("/A", True), ("/b", False)], "root string, enabled boolean")
    assert told(events.debounce(at(spark, [("/a/x", "created", 0.0), ("/b/y", "created", 0.0), ("/ab", "created", 0.0)]), roots=roots)) == [(0, 1, "change", "/a/x", "")]


def test_debounce_windows_against_a_timer(spark):
    """Busy times over many stretches, quiet ones, other gaps, and times before 1970."""
    import random

    for gap, seed in ((2.0, 1), (0.5, 2), (5000.0, 3)):
        r, s, rows = random.Random(seed), -7000.0, []
        for _ in range(600):
            s += r.choice([0.0, gap / 3, gap * 0.999, gap, gap * 1.5, gap * 4000 if r.random() < 0.02 else gap / 2])
            s = round(s, 3)
            rows.append((f"/{r.randrange(5)}", "modified", s))
        want, last, start = {}, None, None
        for _, _, t in rows:
            start = t if last is None or round((t - last) * 1e6) >= round(gap * 1e6) else start
            want[t], last = start, t
        got = {x["s"]: x["flush_start"].timestamp() for x in events.windows(at(spark, rows), gap).collect()}
        assert {k: round(v, 3) for k, v in got.items()} == want


def test_roots_many(spark, monkeypatch):
    roots = spark.createDataFrame([("/A/b", True), ("/c/", True), ("/d", False)], "root string, enabled boolean")
    rows = spark.createDataFrame([(p,) for p in ("/a/B/x", "/a/b", "/a/bc", "/C", "/c/y/z", "/d/e", "/")], "path string")
    few = sorted(r["path"] for r in events.covered(rows, roots).collect())
    monkeypatch.setattr(events, "ROOTS_BYTES", 0)
    assert few == sorted(r["path"] for r in events.covered(rows, roots).collect()) == ["/C", "/a/B/x", "/a/b", "/c/y/z"]


def test_journal(spark):
    c, d, o, n = events.CREATE, events.DELETE, events.OLD_NAME, events.NEW_NAME
    rows = [(1, 1, "/a", o), (2, 1, "/b", n), (3, 1, "/b", c), (4, 2, "/x", n), (5, 3, "/s", o), (6, 3, "/s", n), (7, 4, "/k", c), (8, 4, "/k", c | d), (9, 5, "/u", c), (10, 6, "/z", 1 << 20)]
    # A new name that can't be found out: deferred. One that is missing: gone. Unresolved changes: nothing.
    rows += [(11, 7, "/live", o), (12, 7, None, n | c), (13, 8, "/gone", o), (14, 9, None, c), (15, 1, "/b", d), (16, 10, None, o), (17, 10, "/into", n)]
    j = spark.createDataFrame(rows, "usn bigint, file_ref bigint, path string, reason int")
    got = sorted((r["step"], r["action"], r["path"], r["target"] or "") for r in events.replay(j).collect())
    assert got == [(1, "delete", "/k", ""), (2, "defer", "/live", ""), (2, "delete", "/gone", ""), (2, "rename", "/a", "/b"), (3, "upsert", "/k", ""), (3, "upsert", "/u", ""), (4, "upsert", "/into", ""), (4, "upsert", "/x", "")]
    roots = spark.createDataFrame([("/A", True), ("/Live", True)], "root string, enabled boolean")
    assert sorted((r["action"], r["path"]) for r in events.replay(j, 0, roots).collect()) == [("defer", "/live"), ("delete", "/a")]
    assert [r["path"] for r in events.replay(j, 16).collect()] == ["/into"]
    first, cursor = events.read_batch(j, 3, 4)
    assert sorted(r["usn"] for r in first.collect()) == [3, 4, 5, 6] and cursor == 7 and events.read_batch(j, 99, 4)[1] == 99
    state = spark.createDataFrame([("C", 7, 100, 10), ("D", 8, 100, 10), ("E", 7, 100, 10), ("F", 7, 100, 50)], "volume string, journal_id bigint, next_usn bigint, lowest_valid_usn bigint")
    cursors = spark.createDataFrame([("D", 7, 20), ("E", 7, 20), ("F", 7, 20)], "volume string, journal_id bigint, usn bigint")
    assert {r[0]: (r[1], r[2]) for r in events.rotated(state, cursors).collect()} == {"C": ("first_run", 100), "D": ("rescan", 100), "E": ("replay", 20), "F": ("rescan", 100)}
    ends, own = spark.createDataFrame([("C", True), ("D", False)], "volume string, ok boolean"), spark.createDataFrame([("C", "/c"), ("D", "/d1"), ("D", "/d2"), ("E", "/e")], "volume string, root string")
    assert sorted(r["root"] for r in events.fallback(ends, own).collect()) == ["/d1", "/d2", "/e"]
    dirs = spark.createDataFrame([(1, 0, "r"), (2, 1, "a"), (3, 2, "b"), (8, 9, "x"), (9, 8, "y")], "ref bigint, parent bigint, name string")
    assert {r[0]: r[1] for r in events.resolve_paths(dirs).collect()} == {1: "r", 2: "r/a", 3: "r/a/b"}


def test_stream_of_changes(spark, tmp_path):
    rows = [("/a", "created", 0.0), ("/a", "deleted", 1.0), ("/b", "created", 1.5), ("/b", "deleted", 9.0), ("/z", "created", 100.0)]
    e = spark.createDataFrame(rows, "path string, kind string, s double").select("path", "kind", F.timestamp_micros((F.col("s") * 1000000).cast("long")).alias("ts"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    q = debounce.start(debounce.read_changes(spark, str(tmp_path / "in"), e.schema), lambda action, df, epoch: seen.extend((action, r["path"]) for r in df.collect()), str(tmp_path / "cp"), every="0 seconds")
    end = time.time() + 60
    while len(seen) < 2 and time.time() < end:
        time.sleep(0.5)
    q.stop()
    assert sorted(seen) == [("change", "/b"), ("delete", "/b")]


def docx(*paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    cell = lambda x: f"<w:tc><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc>"
    body += f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('c')}{cell('d')}</w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_sources(spark, tmp_path):
    import struct

    date = b"2026:08:15 10:00:00\0"
    tiff = b"II*\0" + struct.pack("<IHHHIII", 8, 1, 0x8769, 4, 1, 26, 0) + struct.pack("<HHHIII", 1, 0x9003, 2, 20, 44, 0) + date
    for name, raw in (("a.txt", b"caf\xff"), ("sub/b.docx", docx("one", "two")), ("node_modules/c.txt", b"x"), ("d.tmp", b"x"), ("e.zzz", b"?"), ("f.JPG", b"\xff\xd8Exif\0\0" + tiff), ("g.docx", b"broken")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    rows = scan_tree(spark, str(tmp_path), content=True).withColumn("e", extract(F.col("extension"), F.col("content"))).withColumn("taken", exif_time(F.col("content"))).withColumn("h", content_hash(F.col("content")))
    got = {r["filename"]: r for r in rows.collect()}
    assert set(got) == {"a.txt", "b.docx", "e.zzz", "f.JPG", "g.docx"}
    assert got["a.txt"]["e"]["text"] == "caf\ufffd" and got["b.docx"]["e"]["text"] == "one\n\ntwo\n\na | b\nc | d"
    assert got["e.zzz"]["e"]["error"] and got["g.docx"]["e"]["error"] and got["f.JPG"]["taken"] == "2026:08:15 10:00:00"
    assert got["f.JPG"]["file_type"] == "image" and got["a.txt"]["size_bytes"] == 4 and len(got["a.txt"]["h"]) == 16


def test_keys_and_vectors(spark):
    import xxhash

    r = spark.range(1).select(point_id(F.lit(5), F.lit("ocr"), F.lit(0)).alias("p"), embed(F.lit("a b a")).alias("v")).head()
    assert r["p"] % (1 << 64) == xxhash.xxh3_64_intdigest("5:ocr:0") and sum(x * x for x in r["v"]) == pytest.approx(1)
