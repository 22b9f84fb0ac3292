"""Parsing, chunking, segmentation and scalar functions."""

from datetime import datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from loomstone.functions import files as ff
from loomstone.functions import text as ft
from loomstone.functions.chunk import chunks, size
from loomstone.functions.segment import query_words
from loomstone.functions.timeparse import basis_hint, parse
from loomstone.operators.bm25 import forms

ZONE = ZoneInfo("Asia/Shanghai")
NOW = datetime(2026, 8, 16, 14, 30, tzinfo=ZONE)


def days(p):
    return tuple(datetime.fromtimestamp(x, ZONE).strftime("%m-%d") for x in (p.time.start, p.time.end))


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("今天", ("08-16", "08-17")), ("昨天", ("08-15", "08-16")), ("前天", ("08-14", "08-15")), ("本周", ("08-10", "08-17")), ("上周", ("08-03", "08-10")), ("本月", ("08-01", "09-01")),
        ("2026-08-14", ("08-14", "08-15")), ("2026/8/14", ("08-14", "08-15")), ("2026年8月14日", ("08-14", "08-15")), ("8月14日", ("08-14", "08-15")),
        ("2026-08-01 到 2026-08-14", ("08-01", "08-15")), ("2026-08-01~2026-08-14", ("08-01", "08-15")), ("2026-08-01—2026-08-14", ("08-01", "08-15")), ("2026-08-14 至 2026-08-01", ("08-14", "08-15")),
    ],
)
def test_times(query, want):
    assert days(parse(query, NOW, ZONE)) == want


def test_structured_parts():
    p = parse("昨天的自由女神照片", NOW, ZONE)
    assert p.file_types == ["image"] and p.text == "自由女神" and p.time.basis == "exif"
    assert parse("机器学习pdf文档", NOW, ZONE).extensions == ["pdf"]
    p = parse("doc文档", NOW, ZONE)
    assert p.file_types == ["doc"] and p.extensions == []
    assert parse("图片搜索", NOW, ZONE).file_types == []
    assert parse("python3.11 notes", NOW, ZONE).time is None
    assert parse("report 2026-13-45", NOW, ZONE).method == "fallback"
    assert parse("  ", NOW, ZONE).text == ""
    p = parse("a.pdf b.docx PDF txt xlongrunpdfabcd", NOW, ZONE)
    assert p.extensions == ["pdf", "docx", "txt"] and p.text == "a b . PDF xlongrunpdfabcd"
    p = parse("10月31日 doc xdoc notes", NOW, ZONE)
    assert days(p) == ("10-31", "11-01") and p.extensions == ["doc"] and p.text == "xdoc notes"
    assert [basis_hint(x) for x in ("建筑", "照片", "修改", "x")] == ["ctime", "exif", "mtime", "exif"]


def test_forms():
    two = forms(query_words("New York"))
    assert [(len(q.terms), q.every, q.terms[0].prefix) for q in two] == [(1, True, False), (2, True, True), (2, False, True)]
    assert forms(query_words("and")) == [] and len(forms(query_words("report"))) == 1
    assert query_words("2026-08-14") == ["2026", "08", "14"] and query_words("NewYork2026AI") == ["New", "York", "2026", "AI"]


def test_chunks():
    assert chunks("one\n\ntwo\n \nthree") == ["one", "two", "three"] and chunks(None) == chunks("  ") == []
    long = chunks(" ".join(f"This is sentence number {i} of many." for i in range(60)))
    assert len(long) >= 2 and all(size(c) <= 256 for c in long)
    assert all(size(c) <= 256 + 32 for c in chunks("\n".join(f"w{i} x_{i}" for i in range(900)) + "\n\n" + "字。" * 700))
    hard = chunks("字" * 1000)
    assert len(hard) > 1 and all(len(c) <= 300 for c in hard) and hard[0][-32:] == hard[1][:32]


def test_columns(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).head()[0]
    lit = F.lit
    assert value(ft.tokens(lit("Éclair_x 机器 学习, B2!"))) == ["eclair", "x", "机器", "学习", "b2"]
    assert value(ft.split_terms(lit("NewYork2026AI"))) == "New York 2026 AI"
    assert value(ft.estimate_tokens(lit("ab_1 机器\u3000x"))) == 4
    assert value(ft.paragraphs(lit("a\n\n b \n\t\nc\n\n"))) == ["a", "b", "c"]
    assert value(ft.sentences(lit("A b. C!\nd"))) == ["A b.", "C!", "d"]
    assert value(ft.exif_epoch(lit("2026:13:99 99:99:99"))) is None and value(ft.exif_epoch(lit("1970:01:02 00:00:00"))) == 86400
    assert value(ft.local_iso(lit(0))) == "1970-01-01T00:00:00+00:00"
    assert value(ff.root_covers(lit("D:\\PhotoX"), lit("D:\\Photos"))) is False
    assert value(ff.root_covers(lit("d:/photos/2026"), lit("D:\\Photos\\"))) is True and value(ff.root_covers(lit("D:\\Photos"), lit("d:"))) is True
    assert value(ff.extension(lit("a.Tar.GZ"))) == ".gz" and value(ff.extension(lit(".bashrc"))) == ""
    assert value(ff.file_type(lit(".HEIC"))) == "image" and value(ff.mime_type(lit(".zzz"))) is None
    assert value(ff.skip_dir(lit("/a/Node_Modules/b"))) is True
