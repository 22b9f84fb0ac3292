"""Quality rules by suffix-array repetition: longest-common-prefix intervals find maximal repeated word
sequences of a text, their spans are united, and the covered fraction and the longest repeat are limited.

Suffix arrays of many texts are built at once by prefix doubling in numpy: a rank holds the text's
number, so sequences are equal only within one text. Words are numbered by their bytes, so no hash decides
what is equal. Base rules (word count, repeated three-word windows) come first.

Edge cases. Null or empty text: no words, base_failed, not kept. Very long texts: whole, alone in a slice.
Ties: a share of exactly max_covered and a repeat of exactly max_longest words pass; exactly half of the
words in repeated windows passes. Each row stands alone, so repeated rows get equal verdicts, and null or
repeated ids do no harm. An empty table gives no rows. `keep` passes other columns on, whatever their
names; `rules` returns the id as _id and no others."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slice
from .words import NOT_SPACE, bounds, byte_class, exact_ids

#: `[#*$%&|<>]`
SYMBOLS = byte_class(*((ord(c), ord(c)) for c in "#*$%&|<>"))
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A repeat counts from so many words; of a text, so much may be covered, and one repeat may be so long. A share of
#: over half of MAX_COVERED would leave the longest repeat nothing to decide: its two copies are covered already.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST, MAX_LONGEST_SHARE = 8, 0.3, 40, 0.0


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Of each key, how many keys are smaller: a group's first place in sorted order."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.empty(len(keys), bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    out = np.empty(len(keys), np.int64)
    out[order] = first
    return out


def suffix_array(symbols: np.ndarray, text: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of all texts' words and the longest common prefix of each suffix and the one before it.

    symbols: word ids; text: each word's text; last: end position of each word's text."""
    n = len(symbols)
    at = np.arange(n)
    by_word = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    rank = _ranks(text.astype(np.int64) * (n + 1) + by_word)
    # Kept for the prefixes' lengths; small numbers, as a long text that repeats itself has many levels.
    small = np.int32 if n < 1 << 31 else np.int64
    levels, step = [rank.astype(small)], 1
    while True:
        size = np.bincount(rank, minlength=n)
        active = np.flatnonzero(size[rank] > 1)
        if not len(active):
            break
        nxt = active + step
        second = np.where(nxt < last[active], rank[np.minimum(nxt, n - 1)] + 1, 0)
        within = _ranks(rank[active] * (n + 1) + second)
        # Active suffixes of one group stand together in that order; the place within the group is added.
        base = _ranks(rank[active])
        new = rank.copy()
        new[active] = rank[active] + within - base
        rank = new
        levels.append(rank.astype(small))
        step *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = at
    lcp = np.zeros(n, np.int64)
    if n > 1:
        left, right = sa[:-1].copy(), sa[1:].copy()
        live = np.flatnonzero(levels[0][left] == levels[0][right])
        a, b = left[live], right[live]
        got = np.zeros(len(live), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            ok = (a < last[left[live]]) & (b < last[right[live]])
            ok &= levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)]
            got[ok] += 1 << k
            a[ok] += 1 << k
            b[ok] += 1 << k
        lcp[1:][live] = got
    return sa, lcp


def repeats(symbols: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Words covered by repeats of least words or more, and the longest repeat, of each text. The deepest
    interval around a suffix has the larger of the two prefixes that it shares with its neighbours; that
    is the longest repeat that starts there, and the union over all starts is that of all maximal ones."""
    n, first = len(symbols), np.concatenate(([0], np.cumsum(counts)))
    covered, longest = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    if not n:
        return covered, longest
    text = np.repeat(np.arange(len(counts)), counts)
    sa, lcp = suffix_array(symbols, text, first[1:][text])
    deepest = lcp.copy()
    deepest[:-1] = np.maximum(deepest[:-1], lcp[1:])
    from_here = np.empty(n, np.int64)
    from_here[sa] = deepest
    np.maximum.at(longest, text, from_here)
    edge = np.zeros(n + 1, np.int64)
    s = np.flatnonzero(from_here >= least)
    np.add.at(edge, s, 1)
    np.add.at(edge, s + from_here[s], -1)
    sums = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
    return sums[first[1:]] - sums[first[:-1]], longest


def repeat_words(symbols: np.ndarray, counts: np.ndarray, size: int = 3) -> np.ndarray:
    """Words of each text inside windows of size words that occur twice or more in it."""
    n, first = len(symbols), np.concatenate(([0], np.cumsum(counts)))
    if n < size:
        return np.zeros(len(counts), np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    ids = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    key = text.astype(np.int64)
    whole = np.flatnonzero(text[: n - size + 1] == text[size - 1 :])
    key = key[whole]
    for k in range(size):
        key = _ranks(key * (n + 1) + ids[whole + k])
    seen = np.bincount(key, minlength=len(key) or 1)
    edge = np.zeros(n + 1, np.int64)
    s = whole[seen[key] > 1] if len(key) else whole
    np.add.at(edge, s, 1)
    np.add.at(edge, s + size, -1)
    sums = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
    return sums[first[1:]] - sums[first[:-1]]


def _dup_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


SCHEMA = pa.schema([("_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")), ("base_failed", pa.bool_()), ("kept", pa.bool_())])


def measure(data: np.ndarray, offs: np.ndarray, min_repeat: int, max_covered: float, max_longest: int, max_share: float) -> dict:
    s, e, counts = bounds(data, offs, NOT_SPACE)
    first = np.concatenate(([0], np.cumsum(counts)))
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = np.concatenate(([0], np.cumsum(points[e] - points[s])))
    marks = np.concatenate(([0], np.cumsum(SYMBOLS[data])))
    symbols = exact_ids(data, s, e)
    raw = data.tobytes()
    again = repeat_words(symbols, counts)
    covered, longest = repeats(symbols, counts, min_repeat)
    failed = (counts < MIN_WORDS) | (100 * again > MAX_REPEAT_PERCENT * counts)
    rejected = (covered > max_covered * counts) | ((longest > max_longest) & (longest > max_share * counts))
    return {
        "n_words": counts, "word_chars": chars[first[1:]] - chars[first[:-1]], "n_symbols": marks[offs[1:]] - marks[offs[:-1]],
        "n_dup_lines": [_dup_lines(raw[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)],
        "n_repeat_words": again, "n_covered": covered, "longest_repeat": longest, "base_failed": failed, "kept": ~failed & ~rejected,
    }


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, max_share: float = MAX_LONGEST_SHARE) -> DataFrame:
    """For each row its id as _id, the measures and the verdict."""
    from pyspark.sql.pandas.types import to_arrow_type

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = SCHEMA.set(0, pa.field("_id", to_arrow_type(source.schema["_id"].dataType)))
    kind = dict(source.dtypes)["_id"]
    ddl = f"_id {kind}, " + ", ".join(f"{f.name} {'boolean' if f.type == pa.bool_() else 'bigint'}" for f in list(schema)[1:])

    def work(part, data, offs):
        return {"_id": part.column(0), **measure(data, offs, min_repeat, max_covered, max_longest, max_share)}

    return source.mapInArrow(by_slice(work, schema, "_text"), ddl)


def keep(docs: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs that pass, with their columns as they are."""
    limits = {"min_repeat": MIN_REPEAT, "max_covered": MAX_COVERED, "max_longest": MAX_LONGEST, "max_share": MAX_LONGEST_SHARE} | kw
    schema = pa.schema([("kept", pa.bool_())])
    verdicts = by_slice(lambda part, data, offs: {"kept": measure(data, offs, **limits)["kept"]}, schema, text_col)

    def run(batches):
        for batch in batches:
            flags = [x for b in verdicts(iter([batch])) for x in b.column(0).to_pylist()]
            yield batch.filter(pa.array(flags, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return rules(table(spark, sf_dir, "documents")).withColumnRenamed("_id", "doc_id")


def brute(doc_id, text: str | None, min_repeat: int = MIN_REPEAT) -> tuple:
    """A row of the query from plain Python, for tests."""
    raw = (text or "").encode()
    w = raw.split()
    n = len(w)
    chars, marks = sum(len(x.decode()) for x in w), sum(raw.count(c) for c in b"#*$%&|<>")
    seen = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    again = {i + k for i in range(n - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    covered, longest = set(), 0
    for i in range(n):
        best = 0
        for j in range(n):
            if i != j:
                m = 0
                while i + m < n and j + m < n and w[i + m] == w[j + m]:
                    m += 1
                best = max(best, m)
        longest = max(longest, best)
        if best >= min_repeat:
            covered.update(range(i, i + best))
    failed = n < MIN_WORDS or 100 * len(again) > MAX_REPEAT_PERCENT * n
    bad = len(covered) > MAX_COVERED * n or (longest > MAX_LONGEST and longest > MAX_LONGEST_SHARE * n)
    return doc_id, n, chars, marks, _dup_lines(raw), len(again), len(covered), longest, failed, not failed and not bad
