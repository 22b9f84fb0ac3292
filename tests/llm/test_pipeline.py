"""The pipeline's rows against a brute-force version of every stage, and its edge cases."""

import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from loomstone.llm import decontaminate, near_dedup, packing
from loomstone.llm.common import table

from .test_text_operators import plain_line_dedup

SF = "/root/testdata/sf0.001"


def passes(text):
    """The quality rules, with repeats found between neighbours of the sorted suffixes."""
    w = (text or "").encode().split()
    n = len(w)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    again = {i + k for i in range(n - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    if n < 50 or 100 * len(again) > 50 * n:
        return False
    order, best = sorted(range(n), key=lambda i: w[i:]), [0] * n
    for a, b in zip(order, order[1:], strict=False):
        m = 0
        while a + m < n and b + m < n and w[a + m] == w[b + m]:
            m += 1
        best[a], best[b] = max(best[a], m), max(best[b], m)
    covered = {j for i in range(n) if best[i] >= 8 for j in range(i, i + best[i])}
    return len(covered) <= 0.3 * n and max(best) <= 40


def decontaminated(rows, items, window=13):
    """Rows that stay, without their hit words."""
    find = lambda t: [(m.start(), m.end()) for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)]
    lower = lambda t: re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (t or "").encode())
    known = set()
    for _, t in items:
        low = lower(t)
        w = [low[a:b] for a, b in find(low)]
        m = min(window, len(w))
        known |= {tuple(w[i : i + m]) for i in range(len(w) - m + 1) if m}
    out = []
    for k, t in rows:
        low, raw = lower(t), (t or "").encode()
        at = find(low)
        w = [low[a:b] for a, b in at]
        hit = {j for m in {len(x) for x in known} for i in range(len(w) - m + 1) if tuple(w[i : i + m]) in known for j in range(i, i + m)}
        if hit and 20 * len(hit) >= len(w):
            continue
        for i in sorted(hit, reverse=True):
            if i + 1 in hit:
                raw = raw[: at[i][0]] + raw[at[i + 1][0] :]
            else:
                raw = raw[: at[i][0]] + b" " + raw[at[i][1] :]
                if i - 1 in hit:
                    continue
        out.append((k, raw.decode()))
    return out


def test_run(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    rows = [x for x in rows if passes(x[1])]
    rows = [(k, text) for k, _, _, text in plain_line_dedup(rows, 10)]
    kept = {x[0] for x in near_dedup.brute(rows, 5, (4, 5)) if x[3]}
    rows = decontaminated([x for x in rows if x[0] in kept], items)
    enc, want = packing.encoder(packing.default_tokenizer()), []
    for k, text in rows:
        raw = enc.library(text or "") + np.array([1], "<u4").tobytes()
        want += [(k, i, a, zlib.crc32(raw[4 * a : 4 * (a + 4096)])) for i, a in enumerate(range(0, len(raw) // 4, 4096))]
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted((int(r.doc_id), int(r.piece), int(r.start), int(r.ids_crc32)) for r in out.itertuples()) == sorted(want)
    assert all(len(r.ids) == r.length and zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in out.itertuples())
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= packing.SIZE


def test_words_are_cut_as_by_brute_force(spark):
    """The smallest tables have no document that is hit a little, so here are some."""
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    text = max((t for _, t in items), key=lambda t: len((t or "").split()))
    own = [f"own{i}" for i in range(900)]
    rows = [(1, " ".join(own) + ",\n" + text + "! " + " ".join(own)), (2, text + "\t" + " ".join(own + own)), (3, " ".join(own[:20]) + " " + text), (4, None)]
    got = decontaminate.clean(spark.createDataFrame(rows, "doc_id bigint, text string"), table(spark, SF, "benchmark"))
    want = decontaminated(rows, items)
    assert sorted((r["doc_id"], r["text"] or "") for r in got.collect()) == want and [k for k, _ in want] == [1, 2, 4] and all(len(t) < len(dict(rows)[k]) for k, t in want[:2])


def test_stages_take_odd_tables(spark):
    """Empty tables, nulls in any column, repeated rows, and columns named like those used inside."""
    names = "row id text_ _id _rk _drop kept split spans cut sig comp".split()
    own = " ".join(f"w{i}" for i in range(80))
    rows = [(1, own, "en", "s", len(own)), (1, own, "en", "s", len(own)), (2, own + " end", None, None, None), (None, own.upper(), None, None, None), (3, None, None, None, None), (4, "", "", "", 0)]
    df = spark.createDataFrame([(*x, *names) for x in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in names))
    for docs in (df, df.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, SF)
            n = got.count()
            assert n == 0 if docs is not df else n == {"quality_rules": 4, "near_dedup": 5}.get(name, 6), name
            if name != "packing":
                assert got.columns == docs.columns and all(tuple(r)[5:] == tuple(names) for r in got.collect())


def test_stages_keep_columns(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
