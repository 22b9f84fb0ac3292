"""Operators over groups of rows, classifiers, archives and packing."""

import gzip
import random
import struct
import zipfile

import numpy as np
import pytest

from loomstone.llm import language_ecoc, near_dedup, packing, quality_nbsvm, zip_warc
from loomstone.llm.components import components


def near_texts(seed=2):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(2000)]
    out = [None, "", " ", "one", "One", "one two", "a b c d", "A B C D e"]
    for _ in range(12):
        base = [r.choice(vocab) for _ in range(r.randint(20, 120))]
        out += [" ".join(base)] * r.randint(1, 4)
        for _ in range(r.randint(0, 25)):
            w = list(base)
            for _ in range(r.randint(1, 5)):
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append(" ".join(w))
    r.shuffle(out)
    return out


def near_rows(df, **kw):
    return sorted((r["id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(df, **kw).collect())


def test_near_dedup(spark):
    rows = list(enumerate(near_texts()))
    names = "row id sig band pivot comp a b n bytes node k1".split()
    df = spark.createDataFrame([(i, t, *names) for i, t in rows], "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names)).repartition(4)
    assert near_rows(df, shingle=4, threshold=(80, 100)) == sorted(x[:3] for x in near_dedup.brute(rows))
    kept = near_dedup.keep(df, shingle=4, threshold=(80, 100))
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.collect()) == sorted((i, t, *names) for (i, t), x in zip(rows, near_dedup.brute(rows), strict=True) if x[3])


def test_near_dedup_bands_large_buckets_again(spark, monkeypatch):
    """Blocks of four, with and without fine bands: most buckets are large and mixed. Ids are strings here."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rows = list(enumerate(near_texts(5)))
    df = spark.createDataFrame([(f"d{i:04}", t) for i, t in rows], "doc_id string, text string")
    for copies in (0, 1000):
        monkeypatch.setattr(near_dedup, "COPIES", copies)
        assert near_rows(df, shingle=4) == sorted((f"d{i:04}", n, f"d{c:04}") for i, n, c, _ in near_dedup.brute(rows))


def test_near_dedup_template(spark, monkeypatch):
    """Pages that share half of their words come apart by fine bands: hardly any of them are left to sweep."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "COPIES", 4)
    swept, plain = [], near_dedup._sweep_rows
    monkeypatch.setattr(near_dedup, "_sweep_rows", lambda *x: swept.append(plain(*x)) or swept[-1])
    r = random.Random(8)
    template = " ".join(f"t{i}" for i in range(60))
    rows = [(i, template + " " + " ".join(f"o{r.randrange(10**6)}" for _ in range(50))) for i in range(1500)]
    rows += [(2000 + i, rows[i][1] + " end") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert near_rows(df) == sorted(x[:3] for x in near_dedup.brute(rows, 5, (4, 5)))
    assert len(swept) == 2 and swept[1].count() < 20 * len(rows)


def test_near_dedup_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(7, text), (7, text), (3, text.upper()), (None, text), (9, None), (7, "  ")], "doc_id bigint, text string")
    got = sorted((r["id"] or -1, r["component_id"]) for r in near_dedup.near_groups(df).collect())
    assert got == [(-1, None), (3, 3), (7, 3), (7, 3), (7, 3), (9, 9)]
    assert near_dedup.near_groups(df.where("false")).count() == 0
    assert sorted((r["doc_id"] or -1) for r in near_dedup.keep(df).collect()) == [-1, 3, 9]


def test_near_dedup_ties_long_words_and_long_texts(spark):
    """A pair of exactly 0.8 is linked; words with equal polynomial hashes are different; whole long texts count."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    base = [f"w{i}" for i in range(13)]  # 10 shingles of four
    long = [f"u{i}" for i in range(200000)]
    rows = [(1, word), (2, other), (3, word), (4, " ".join(base[:12])), (5, " ".join([*base[:11], "x", "y"])), (6, " ".join(base[:11] + ["z"])), (7, " ".join(long)), (8, " ".join(long[:170000])), (9, " ".join(long[:120000]))]
    assert near_rows(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=4, threshold=(80, 100)) == [x[:3] for x in near_dedup.brute(rows)]
    assert [x[2] for x in near_dedup.brute(rows)] == [1, 2, 1, 4, 5, 4, 7, 7, 9]


def test_bayesian_bounds():
    need = [near_dedup.least_matches(n, (4, 5)) for n in range(20, 101, 20)]
    assert need == sorted(need) and need[0] < 20 and need[-1] < 80
    rng = np.random.default_rng(0)
    same = rng.integers(0, 9, (500, 100), dtype=np.uint32)
    other = np.where(rng.random((500, 100)) < 0.8, same, same + 100)
    assert near_dedup.survives(same, other, (4, 5))[0].all()
    assert not near_dedup.survives(same, np.where(rng.random((500, 100)) < 0.2, same, same + 100), (4, 5))[0].any()


def test_components_of_a_path(spark):
    n = 300
    order = random.Random(1).sample(range(n), n)
    links = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(1000, 1001), (5000, 5000)], "a bigint, b bigint")
    got = {r["node"]: r["comp"] for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(n)) and got[1001] == 1000 and 5000 not in got
    assert components(links.where("false")).count() == 0


PAGES = [(5, "http://a/\r\nX: y", "p" * 200), (2, "u2", "p" * 200), (9, None, "p" * 200), (3, "u3", "s" * 99), (4, "u4", "s" * 99), (1, "u1", None), (6, "u6", ""), (7, "u7", "é" * 60), (8, "u8", "é" * 60), (8, "u8", "é" * 60)]


def test_warc_round_trip(spark):
    import hashlib

    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or 0, r["payload"]) for r in zip_warc.read(zip_warc.write(pages)).collect())
    first = {2: None, 5: 2, 9: 2, 7: None, 8: 7}
    want = []
    for k, _, html in PAGES:
        raw = (html or "").encode()
        ref = first.get(k)
        want.append((k, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if ref else "response", ref or 0, None if ref else html or ""))
    assert got == sorted(want, key=lambda x: x[:5])
    assert zip_warc.read(zip_warc.write(pages.where("false"))).count() == 0


def test_warc_ids_names_and_tasks(spark):
    """String ids, extra columns with names used inside, very long payloads; and packages are read by several tasks."""
    from pyspark.sql import functions as F

    rows = [(f"p {i}\n:%é", None, ("x" * 3_000_000 if i < 2 else f"{i % 30} " * 60), "d", "r", "n") for i in range(60)] + [("", "u", "y", "d", "r", "n"), (None, "u", "z" * 200, "d", "r", "n")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string, digest string, refers_to string, n string").repartition(3)
    packages = zip_warc.write(pages, package_bytes=400)
    assert packages.count() > 8
    found = zip_warc.read(packages, id_type="string")
    got = {r["page_id"]: r for r in found.collect()}
    assert set(got) == {r[0] for r in rows} and got["p 1\n:%é"]["refers_to"] == "p 0\n:%é" and got["p 0\n:%é"]["payload"] == "x" * 3_000_000
    first = {}
    for k, _, html, *_ in sorted(rows, key=lambda r: r[0] or "~"):
        own = got[k]
        assert own["refers_to"] == (first.setdefault(html, k) if len(html) >= 100 and first.setdefault(html, k) != k else None)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    zip_warc.remove(packages)
    with pytest.raises(Exception):
        found.collect()


def test_packages_are_zip_files(tmp_path):
    for zip64 in (None, True):
        at = tmp_path / f"{zip64}.wacz"
        records = [zip_warc.record("response", i, f"u{i}", b"x" * i, "d", i, None) for i in range(20)]
        zip_warc.write_package(f"file://{at}", iter(records), zip64)
        with zipfile.ZipFile(at) as z:
            assert z.testzip() is None and z.namelist() == [zip_warc.MEMBER, zip_warc.INDEX]
            assert gzip.decompress(z.read(zip_warc.MEMBER)).count(b"WARC/1.1") == 20
        package = zip_warc.Package(f"file://{at}")
        one = package.index()[7]
        assert next(package.records([one]))[1] == b"x" * 7
        assert [p for _, p in package.records()] == [b"x" * i for i in range(20)]


def test_directory_of_other_writers(tmp_path):
    at = tmp_path / "other.zip"
    with zipfile.ZipFile(at, "w") as z:
        z.comment = b"PK\x05\x06 a comment that looks like an end record"
        with z.open(zipfile.ZipInfo("big"), "w", force_zip64=True) as f:
            f.write(b"stored")
        z.writestr("packed", b"y" * 100, zipfile.ZIP_DEFLATED)
    raw = at.read_bytes()
    read = lambda a, n: raw[a : a + n]
    found = zip_warc.read_directory(read, len(raw))
    method, size, header = found["big"]
    a = zip_warc.data_offset(read, header)
    assert method == 0 and raw[a : a + size] == b"stored" and found["packed"][0] == 8
    with pytest.raises(ValueError):
        zip_warc.read_directory(lambda a, n: b"\0" * n, 100)


def test_zip64_offsets():
    big = 5 << 32
    raw = zip_warc.directory([("m", 1, big, big)], 7)
    offset = len(raw)
    assert struct.unpack_from("<I", raw, offset - 22)[0] == zip_warc.EOCD
    raw = b"\0" * 7 + raw
    assert zip_warc.read_directory(lambda a, n: raw[a : a + n], len(raw))["m"] == (0, big, big)


def test_tokens_are_the_library_s():
    enc = packing.Encoder(packing.default_tokenizer())
    assert enc.own
    odd = ["", " ", "don't we'll_x", "naïve Ünï ß÷×ªº 12½ ǅ İstanbul ΣΑΣ", "á é", "<|endoftext|> x", "日本 🙂 x", "x\x0by\x0cz\x1cw v", "A" * 5000, "''s's'ss"]
    r = random.Random(0)
    odd += ["".join(r.choice("aZ9é'_ -\n|%ßÖ.,") for _ in range(300)) for _ in range(100)]
    assert all(enc.encode(t) == enc.library(t) for t in odd)


def _encoded(enc, texts):
    raws = [t.encode() for t in texts]
    return enc.encode_all(np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)]))


def test_words_are_merged_here(tmp_path):
    """New words don't go to the library one by one: in op5's tables a fifth of a text's words are new to a slice."""
    import json

    class Counted(packing.Words):
        asked = 0

        def __missing__(self, word):
            Counted.asked += 1
            return super().__missing__(word)

    with open(packing.default_tokenizer()) as f:
        said = json.load(f)
    said["model"]["end_of_word_suffix"] = None
    (tmp_path / "plain.json").write_text(json.dumps(said))
    r = random.Random(8)
    letters = "aabcdeeefghiijklmnnoopqrrsstttuvwxyzéàßÖ"
    texts = [" ".join("".join(r.choices(letters, k=r.randint(1, 28 if k < 40 else 16))) for _ in range(100)) for k in range(60)]
    texts += ["".join(r.choices("!!--..%'", k=r.randint(1, 40))) for _ in range(100)] + ["the thethethe aaaaaaaaaaaaaa innin"]
    for path in (packing.default_tokenizer(), str(tmp_path / "plain.json")):
        enc = packing.Encoder(path)
        assert enc.own
        enc.words, Counted.asked = Counted(enc.tokenizer.model), 0
        assert [enc.encode(t) for t in texts] == _encoded(enc, texts) == [enc.library(t) for t in texts]
        longer = {w for t in texts for w in t.lower().split() if len(w.encode()) > 32}
        assert longer and Counted.asked <= len(longer)


def test_texts_of_a_slice_are_cut_apart():
    enc = packing.Encoder(packing.default_tokenizer())
    odd = ["don'", "t", "'", "s", "'s", "'re", "'r", "e", "we'", "", "'ll", "'v", "5's 'd'm''t", "!'s", "é's'é", "É", "'T'RE'x", "<|endof", "text|>", "<|endoftext|>", "a<|startoftext|>b", "日本", "×", "÷", "\x7f", "\x0b", " ", "\t\r\n", "x" * 40, "ÀÖØÞßàöøþÿ", "12é34", "\x00", "i\u0307", "e\u0301"]
    r = random.Random(5)
    for _ in range(300):
        texts = r.choices(odd, k=r.randint(0, 12))
        texts += ["".join(r.choices("'srevltmd é!5\n", k=r.randint(0, 9))) for _ in range(r.randint(0, 12))]
        assert _encoded(enc, texts) == [enc.library(t) for t in texts]


def test_other_settings_go_to_the_library(tmp_path):
    import json

    for change in (lambda d: d["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex="[a-z]+|[^a-z]"), lambda d: d.update(normalizer=None)):
        with open(packing.default_tokenizer()) as f:
            said = json.load(f)
        change(said)
        at = tmp_path / "other.json"
        at.write_text(json.dumps(said))
        enc = packing.Encoder(str(at))
        assert not enc.own and enc.encode("The QUICK fox's 42") == enc.library("The QUICK fox's 42")


def test_small_components_are_written_in_few_files(spark):
    from loomstone.llm.common import materialize
    from loomstone.llm.components import TASKS, merged

    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(held, ("40", "false"), strict=True):
            spark.conf.set(k, v)
        rows = [(i, i + 1) for i in range(300) if i % 10 < 9]
        comps = components(materialize(spark.createDataFrame(rows, "a bigint, b bigint"), "links"))
        more = merged(comps, materialize(spark.createDataFrame([(9, 10), (900, 901)], "a bigint, b bigint"), "links"))
        assert sorted(tuple(r) for r in comps.collect()) == [(i, i - i % 10) for i in range(300)]
        assert sorted(tuple(r) for r in more.collect()) == [(i, i - i % 10 if i > 19 else 0) for i in range(300)] + [(900, 900), (901, 900)]
        assert max(len(comps.inputFiles()), len(more.inputFiles())) <= TASKS
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_pieces_come_in_slices():
    """A batch of many texts isn't given back whole: a worker would hold its ids several times."""
    import pyarrow as pa

    from loomstone.llm.common import SLICE_BYTES

    r = random.Random(4)
    texts = [" ".join(r.choice("the of and to in naïve 日本".split()) for _ in range(r.randint(0, 800))) for _ in range(2500)]
    texts = [None, "", *texts, "of " * SLICE_BYTES, None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array([None, *range(len(texts) - 1)], pa.int64()), pa.array(texts)], names=["doc_id", "text"]).slice(1)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))]
    enc = packing.encoder(packing.default_tokenizer())
    for n in (6, 5):
        got = list(packing._pieces(None, 100, n == 6, pa.schema(fields[:n]))(iter([batch, batch.slice(0, 0)])))
        assert len(got) > 3 and all(pa.compute.sum(x.column("length")).as_py() <= SLICE_BYTES + x.num_rows for x in got if x.column("doc_id").to_pylist() != [len(texts) - 4] * x.num_rows)
        rows = pa.Table.from_batches(got).to_pylist()
        assert [x["doc_id"] for x in rows if not x["piece"]] == batch.column(0).to_pylist()
        if n == 6:
            own: dict = {}
            for x in rows:
                assert x["start"] == len(own.setdefault(x["doc_id"], [])) and x["length"] == len(x["ids"])
                own[x["doc_id"]] += x["ids"]
            assert [np.array(v, "<u4").tobytes() for v in own.values()] == [enc.encode(t or "") + np.array([1], "<u4").tobytes() for t in texts[1:]]


def test_packing_query_against_the_library(spark):
    """op5's rows on the smallest tables: pieces and CRCs by the library, gapless sequences, no more than first fit takes."""
    import zlib

    sf = "/root/testdata/sf0.001"
    enc, want = packing.encoder(packing.default_tokenizer()), {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        raw = enc.library(r["text"] or "") + np.array([1], "<u4").tobytes()
        for k, at in enumerate(range(0, len(raw) // 4, 4096)):
            own = raw[4 * at : 4 * (at + 4096)]
            want[r["doc_id"], k] = (at, len(own) // 4, zlib.crc32(own))
    got = packing.query(spark, sf).toPandas()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want and len(got) == len(want)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 4096
    assert got.sequence_id.nunique() <= first_fit(got.length.tolist(), 4096)


def first_fit(lengths, size):
    """Sequences that first fit takes, longest pieces first."""
    room = []
    for x in sorted(lengths, reverse=True):
        k = next((k for k, r in enumerate(room) if r >= x), None)
        if k is None:
            room.append(size)
            k = -1
        room[k] -= x
    return len(room)


def test_packing(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("the of and to in".split()) for _ in range(r.choice([0, 1, 30, 60, 99, 100, 250])))) for i in range(300)] + [(300, None), (300, None), (301, "")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id bigint, text string, length int")
    got = packing.pack(df, size=100, with_ids=True).toPandas()
    enc = packing.encoder(packing.default_tokenizer())
    assert len(got[got.doc_id == 300]) == 2
    for k, text in rows[:300] + rows[302:]:
        own = got[got.doc_id == k].sort_values("piece")
        ids = [*np.frombuffer(enc.library(text or ""), "<u4"), 1]
        assert [int(x) for p in own.ids for x in p] == [int(x) for x in ids]
        assert all(own.length.iloc[:-1] == 100) and list(own.start) == [100 * i for i in range(len(own))]
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 100
    assert got.sequence_id.nunique() <= first_fit(got.length.tolist(), 100)
    assert packing.pack(df.where("false")).count() == 0


def test_plan_uses_every_piece():
    r = random.Random(9)
    for _ in range(20):
        have = {r.randint(1, 64): r.randint(1, 500) for _ in range(r.randint(1, 30))}
        used = {}
        for pattern, times in packing.Plan(have, 64).patterns:
            assert sum(pattern) <= 64 and times > 0
            for x in pattern:
                used[x] = used.get(x, 0) + times
        assert used == have


LANGS = {"en": "the of and to in is that it", "fr": "le la les des une est que qui", "de": "der die das und ist nicht ein", "es": "el los las una que es por con"}


def prose(lang, r, n=40):
    return " ".join(r.choice(LANGS[lang].split()) + r.choice(["", "", "s", "en"]) for _ in range(n))


def test_language(spark):
    r = random.Random(4)
    rows = [(i, prose(lang, r), lang) for i in range(240) for lang in [list(LANGS)[i % 4]]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_ecoc.train(df.where("doc_id < 160"))
    odd = [(900, None, None), (901, "12 -- 34", None), (902, "", "en")]
    got = {r["id"]: r for r in language_ecoc.identify(spark.createDataFrame(rows + odd, df.schema), model).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in rows[160:]) >= 76
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k, _, _ in odd)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    one = language_ecoc.train(df.where("lang = 'de'"))
    assert {r["lang_pred"] for r in language_ecoc.identify(df, one).collect()} == {"de"}
    none = language_ecoc.train(df.where("false"))
    assert {r["lang_pred"] for r in language_ecoc.identify(df, none).collect()} == {"und"}


def test_codes_are_far_apart():
    for k in (2, 3, 4, 5, 12, 40, 1200):
        m = language_ecoc.code_matrix(k)
        d = min(int((m[:i] != m[i]).sum(1).min()) for i in range(1, k))
        assert d >= (1 if k == 2 else 2) and len({tuple(c) for c in m.T}) == m.shape[1]


def test_quality(spark):
    r = random.Random(6)
    good = [(i, prose("en", r), 1) for i in range(150)]
    bad = [(1000 + i, prose("en", r, 20).replace(" ", "### ") if i % 2 else "spam spam " * 15, 0) for i in range(90)]
    rows = good + bad
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows] + [(5000, None, "x"), (5001, "", "x")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if k % 3] + [(7, None), (None, 1), (99999, 0)], "doc_id bigint, quality int")
    model = quality_nbsvm.train(docs, labels)
    got = {x["id"]: x["score"] for x in quality_nbsvm.score(docs, model).collect()}
    held = [(got[k] >= 0.3) == bool(y) for k, _, y in rows if k % 3 == 0]
    assert sum(held) >= 0.97 * len(held) and all(0 <= x <= 1 for x in got.values())
    for only, low, high in ((labels.where("quality = 1"), 0.9, 1.0), (labels.where("false"), 0.4, 0.6)):
        scores = {x["score"] for x in quality_nbsvm.score(docs, quality_nbsvm.train(docs, only)).collect()}
        assert len(scores) == 1 and low <= scores.pop() <= high


def test_packed_features():
    from loomstone.llm.ngrams import Indicators, pack, unpack

    of = Indicators(10, words=True)
    for text in (b"", b"a", b"one two two", bytes(range(256)) * 40):
        found = of(np.frombuffer(text, np.uint8))
        raw = pack(found, 2 << 10)
        assert unpack(raw).tolist() == found.tolist() and len(raw) <= (2 << 10) // 8 + 1
    assert len(of(np.frombuffer(b"two two", np.uint8))) > len(of(np.frombuffer(b"two", np.uint8)))


def test_classifiers_take_odd_tables(spark):
    """Empty tables, many languages, very long texts, repeated rows, clashing names, string ids."""
    r = random.Random(5)
    names = "id key pair grams y k most lang_pred score".split()
    rows = [(f"d{i}", prose(lang, r), lang, *names) for i in range(80) for lang in [list(LANGS)[i % 4]]]
    rows += [("long", prose("de", r, 400_000), "de", *names)] + [rows[0]] * 50 + [(f"m{i}", f"zq{i} zq{i} zq{i}", f"x{i}", *names) for i in range(450)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string, " + ", ".join(f"{n} string" for n in names))
    four = language_ecoc.train(df.where("lang not like 'x%'"))
    got = {x["id"]: x["lang_pred"] for x in language_ecoc.identify(df, four).collect()}
    assert got["long"] == "de" and sum(got[f"d{i}"] == list(LANGS)[i % 4] for i in range(80)) >= 78
    many = language_ecoc.train(df, max_total=900)
    assert len(many.langs) == 454
    assert language_ecoc.identify(df.where("false"), four).count() == 0
    labels = spark.createDataFrame([(x[0], i % 2, "t") for i, x in enumerate(rows[:81])], "doc_id string, quality int, text string")
    model = quality_nbsvm.train(df, labels)
    scores = quality_nbsvm.score(df, model).collect()
    assert len(scores) == len(rows) and len({x["score"] for x in scores if x["id"] == "d0"}) == 1
    assert quality_nbsvm.score(df.where("false"), quality_nbsvm.train(df.where("false"), labels)).count() == 0


def test_held_out_accuracy(spark):
    """The two queries on rows they didn't learn from."""
    sf = "/root/testdata/sf0.01"
    labels = {x["doc_id"]: x["quality"] for x in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [x for x in quality_nbsvm.query(spark, sf).collect() if x["held_out"] and x["doc_id"] in labels]
    assert sum(x["predicted"] == labels[x["doc_id"]] for x in held) > 0.9 * len(held) > 0
    langs = {x["doc_id"]: x["lang"] for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    told = [x for x in language_ecoc.query(spark, sf).collect() if x["held_out"] and langs[x["doc_id"]] and x["lang_pred"] != "und"]
    assert sum(x["lang_pred"] == langs[x["doc_id"]] for x in told) > 0.97 * len(told) > 0
