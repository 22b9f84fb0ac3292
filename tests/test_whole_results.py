"""Whole results where the registered SQL, or the rows it compares, say less."""

import pytest
from pyspark.sql import functions as F

from loomstone.operators import tasks
from loomstone.plans import registry
from loomstone.sources.tables import Tables

SF = "/root/testdata/sf0.01"


def test_enqueue_heeds_active_tasks_of_any_priority(spark):
    t = Tables(spark, SF)
    busy = {r["file_id"] for r in t.tasks.where(F.col("status").isin(*tasks.ACTIVE)).collect()}
    wanted = {r["file_id"] for r in t.files.where("file_type IN ('doc', 'image') AND status = 'METADATA_ONLY' AND is_deleted = 0").collect()}
    got = [r["file_id"] for r in registry.queries()["task_enqueue_anti"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted - busy


@pytest.mark.parametrize("priority", [0, 1, 2])
def test_enqueue_fixture(spark, priority):
    files = spark.createDataFrame([(k, "doc", "METADATA_ONLY", 0) for k in range(4)], "file_id bigint, file_type string, status string, is_deleted int")
    queue = spark.createDataFrame([(0, "PENDING", priority), (1, "RUNNING", priority), (2, "SUCCESS", priority)], "file_id bigint, status string, priority int")
    assert sorted(r["file_id"] for r in tasks.enqueue(queue, files).collect()) == [2, 3]


def test_tokenizer_returns_every_token(spark):
    t = Tables(spark, SF)
    got = {}
    for r in registry.queries()["tokenize_terms_all"](spark, SF).collect():
        got.setdefault(r["doc_id"], []).append((r["part"], r["token"]))
    counts = {r["doc_id"]: r["n_tokens"] for r in registry.queries()["tokenize_terms"](spark, SF).collect() if r["n_tokens"]}
    assert {k: len(v) for k, v in got.items()} == counts and max(counts.values()) > 12
    plain = {r["doc_id"]: r["text"] for r in t.raw("documents").collect() if r["text"] and r["text"].isascii()}
    assert any(counts.get(k, 0) > 12 for k in plain)
    for k, text in plain.items():
        want = "".join(c.lower() if c.isalnum() else " " for c in text).split()
        assert [x for _, x in sorted(got.get(k, []))] == want


def plain_chunks(text, limit=256, overlap=32):
    """Chunks from what is said of them: paragraphs, then sentences while they fit, then windows."""
    import re

    count = lambda t: len(re.findall(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]", t))
    out = []
    for p in re.split(r"\n\s*\n", text.strip()):
        if count(p.strip()) <= limit:
            out.append(p)
            continue
        now = ""
        for s in re.findall(r"[^。！？!?.\n]*[。！？!?.\n]|[^。！？!?.\n]+", p.strip()):
            s = s.strip()
            if count(s) > limit:
                out.append(now)
                now = ""
                while len(s) > limit:
                    cut = s[:limit].rfind(" ")
                    cut = cut if cut >= limit // 2 else limit
                    out.append(s[:cut])
                    s = s[cut - overlap :] if cut > overlap else s[cut:]
                out.append(s)
            elif now and count(now + s) > limit:
                out.append(now)
                now = now[-overlap:] + s
            else:
                now += s
        out.append(now)
    return [c.strip() for c in out if c.strip()]


def test_python_functions_against_plain_ones(spark):
    """Queries without SQL: chunks, segments, hashes, ids and vectors, over whole tables."""
    import numpy as np
    import xxhash

    from loomstone.functions.hashing import HashingEmbedder
    from loomstone.functions.segment import DEFAULT

    sf = "/root/testdata/sf0.001"
    t, q = Tables(spark, sf), registry.queries()
    docs = {r["doc_id"]: r["text"] for r in t.raw("documents").select("doc_id", "text").collect()}
    chunks = {r["chunk_id"]: r for r in t.chunks.collect()}
    got = {}
    for r in q["chunk_text"](spark, sf).collect():
        got.setdefault(r["file_id"], []).append((r["chunk_index"], r["chunk_text"]))
    assert {k: [c for _, c in sorted(v)] for k, v in got.items()} == {k: c for k, v in docs.items() if (c := plain_chunks(v or ""))}
    assert {r["doc_id"]: r["content_hash"] for r in q["content_hash_xxh3"](spark, sf).collect()} == {k: None if v is None else xxhash.xxh3_64_hexdigest(v.encode()) for k, v in docs.items()}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    assert {r["chunk_id"]: r["point_id"] for r in q["point_ids"](spark, sf).collect()} == {k: signed(xxhash.xxh3_64_intdigest(f"{r['file_id']}:{r['source_type']}:{r['chunk_index']}")) for k, r in chunks.items()}
    assert {r["chunk_id"]: r["chunk_text_seg"] for r in q["segment_text"](spark, sf).collect()} == {k: " ".join(w for w in DEFAULT.cut(r["chunk_text"]) if w.strip()) for k, r in chunks.items()}
    vectors = {r["chunk_id"]: r["embedding"] for r in q["embed_text"](spark, sf).collect()}
    keys = sorted(chunks)
    assert np.allclose([vectors[k] for k in keys], HashingEmbedder().embed([chunks[k]["chunk_text"] for k in keys]), atol=1e-6)


def test_cells_recall(spark, tmp_path):
    """Every point whose id 50 divides, against all points, as the exact search finds them."""
    import numpy as np

    from loomstone.operators.vectors import Cells, unit

    points = Tables(spark, SF).points.select("vec_id", "embedding")
    index = Cells(spark, f"file://{tmp_path}/cells").build(points)
    rows = sorted((r["vec_id"], r["embedding"]) for r in points.collect())
    ids, x = np.array([k for k, _ in rows]), unit(np.array([v for _, v in rows], np.float64))
    found = total = 0
    for i in np.flatnonzero(ids % 50 == 0)[:12]:
        best = set(ids[np.lexsort((ids, -(x @ x[i])))[:10]].tolist())
        found += len(best & {r["vec_id"] for r in index.search(x[i].tolist(), 10).select("vec_id").collect()})
        total += 10
    assert found >= 0.9 * total
    assert "PushedFilters: [In(cell" in index.search(x[0].tolist(), 10)._jdf.queryExecution().toString()
    none = Cells(spark, f"file://{tmp_path}/none").build(points.where("false"))
    assert none.search([1.0, 0.0], 5).count() == 0


def test_schema_upgrades(spark):
    from loomstone.sources import schema

    old = spark.createDataFrame([(1, "1970:01:02 00:00:00"), (2, None)], "file_id bigint, datetime_original string")
    new = schema.upgraded(old, "exif")
    assert [r["datetime_original_epoch"] for r in new.orderBy("file_id").collect()] == [86400, None]
    assert schema.upgraded(new, "exif").collect() == new.collect() and len(schema.columns("exif", 1)) == 2
    tasks_ = schema.upgraded(spark.createDataFrame([(1, 5)], "id bigint, file_id bigint"), "ai_tasks").head()
    assert (tasks_["status"], tasks_["priority"], tasks_["attempt"], tasks_["max_attempts"]) == ("PENDING", 1, 0, 3)
    with pytest.raises(ValueError):
        schema.upgraded(old.withColumn("x", F.lit(1)), "exif")


def test_shared_folder_is_cleared(spark, monkeypatch):
    import os
    import tempfile

    from loomstone import session

    monkeypatch.setattr(session, "shared_dir", lambda spark, at=tempfile.mkdtemp(): at)
    at = session.shared_path(spark, "x")
    spark.range(3).write.parquet(at)
    assert os.path.exists(at)
    session.clear(spark)
    assert not os.path.exists(at)
