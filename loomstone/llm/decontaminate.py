"""Benchmark decontamination: a generalised suffix automaton of the normalised items; documents are
streamed through it, and the longest matching length is tracked at each word.

Where the match is window words long or more, its last window words are a window of an item, and are hit; an
item of fewer words is a window as a whole. The automaton is built on the driver from the benchmark, whose
size is measured first. Up to max_words one automaton and one pass do it. Beyond, a pass over all documents
with the hashes of all windows (8 bytes for each word of the benchmark; FILTER_WORDS words in one set) finds
those that may hold one, which are few; only they are written, and then go through one automaton after
another. Both ways run the same scan.

Words are hashed by numpy, and only runs of words that all occur in the benchmark enter an automaton; there
the words themselves are compared, so hashes decide nothing.

Edge cases. Null or empty text: no words, not contaminated. Very long texts: whole. Items without words have
no windows; repeated items count each; a null item_id sorts as the empty string. Ties: a document with
exactly num/den of its words hit is contaminated. Every row stands alone, so repeated rows, null and
repeated ids do no harm. An empty table gives no rows, an empty benchmark no hits. Other columns, whatever
their names, travel inside one column and pass through `clean`."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow_type, by_slice, materialize, packed
from .words import ALNUM, LOWER, bounds, hashes, windows

#: Words of the benchmark in one automaton: about 1 kB each in a worker, so at most 200 MB.
MAX_WORDS = 200_000
#: Words of the benchmark in one set of window hashes.
FILTER_WORDS = 20_000_000


def item_words(text: str | None) -> list[bytes]:
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    s, e, _ = bounds(data, np.array([0, len(data)]), ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]


def word_hashes(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([0, *map(len, words)])
    return hashes(np.frombuffer(b"".join(words), np.uint8), ends[:-1], ends[1:])


class Windows:
    """Hashes of all windows of items, by their lengths."""

    def __init__(self, items, window: int) -> None:
        found: dict[int, list[np.ndarray]] = defaultdict(list)
        for _, words in items:
            if words:
                m = min(window, len(words))
                found[m].append(np.unique(windows(word_hashes(words), m)))
        self.by_length = {m: np.unique(np.concatenate(x)) for m, x in found.items()}

    def touched(self, wh: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Which texts hold a window, as far as hashes tell."""
        text, out = np.repeat(np.arange(len(counts)), counts), np.zeros(len(counts), bool)
        for m, known in self.by_length.items():
            h = windows(wh, m)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            begin = np.flatnonzero((known[at] == h) & (text[: len(h)] == text[m - 1 :])) if len(h) else np.zeros(0, np.int64)
            out[text[begin]] = True
        return out


class Automaton:
    """Generalised suffix automaton over word ids, with the items of each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.names = [name for name, _ in items]
        words = [[self.vocab.setdefault(w, len(self.vocab)) for w in ws] for _, ws in items]
        for ws in words:
            last = 0
            for c in ws:
                last = self._extend(last, c)
        owners: list[set[int]] = [set() for _ in self.len]
        short: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, ws in enumerate(words):
            v = 0
            for c in ws:
                v = self.next[v][c]
                u = v
                while u > 0 and k not in owners[u]:
                    owners[u].add(k)
                    u = self.link[u]
            if 0 < len(ws) < window:
                short[v].append((len(ws), k))
        self.owners = [tuple(sorted(x)) for x in owners]
        #: Items shorter than a window that end where the state does, by way of its suffixes.
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.len)
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            self.short[v] = tuple(short.get(v, ())) + self.short[self.link[v]]
        self.least = min((min(len(ws), window) for ws in words if ws), default=0)
        self.hashed = np.sort(word_hashes(list(self.vocab)))

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.len.append(length)
        self.next.append(nxt)
        self.link.append(link)
        return len(self.len) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """q, or a copy of it that holds only strings up to those of p with c."""
        if self.len[q] == self.len[p] + 1:
            return q
        copy = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c)
        new, p = self._state(self.len[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][c], c)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words that windows cover, one for each window's end, and the items of those windows."""
        spans, found, v, n = [], set(), 0, 0
        nxt, link, length, window, vocab = self.next, self.link, self.len, self.window, self.vocab
        for i, w in enumerate(words):
            c = vocab.get(w, -1)
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v, n = nxt[v][c], n + 1
            else:
                n = 0
            if n >= window:
                u = v
                while length[link[u]] >= window:
                    u = link[u]
                spans.append((i - window + 1, i + 1))
                found.update(self.owners[u])
            if self.short[v]:
                for m, k in self.short[v]:
                    if m <= n:
                        spans.append((i - m + 1, i + 1))
                        found.add(k)
        return spans, found


def _runs(ok: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of ok that don't pass the texts' first words."""
    n = len(ok)
    start = ok.copy()
    start[1:] &= ~ok[:-1]
    first = first[first < n]
    start[first] = ok[first]
    end = np.zeros(n, bool)
    end[:-1] = ok[:-1] & ~ok[1:]
    end[-1] = ok[-1]
    before = first[first > 0] - 1
    end[before] = ok[before]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
MEASURES = {"n_words": ("bigint", pa.int64()), "spans": ("array<struct<start:int,end:int>>", SPANS), "items": ("array<string>", pa.list_(pa.string())), "n_items": ("bigint", pa.int64()), "cut": ("string", pa.string())}


def _scan(auto, schema: pa.Schema):
    """Batches of row and text, and the measures of earlier automata, if any, to all of these."""

    def work(part: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> dict:
        a, raw = auto.value, data
        data = LOWER[data]
        s, e, counts = bounds(data, offs, ALNUM)
        first = np.concatenate(([0], np.cumsum(counts)))
        hit, items, n_items = np.zeros(len(s), bool), [set() for _ in counts], np.zeros(len(counts), np.int64)
        if "spans" in part.schema.names:
            for d, (spans, names) in enumerate(zip(part.column("spans").to_pylist(), part.column("items").to_pylist(), strict=True)):
                for x in spans:
                    hit[first[d] + x["start"] : first[d] + x["end"]] = True
                items[d] |= set(names)
            n_items += np.asarray(part.column("n_items"))
        if a.least and len(s) >= a.least:
            h = hashes(data, s, e)
            at = np.minimum(np.searchsorted(a.hashed, h), len(a.hashed) - 1)
            lo, hi = _runs(a.hashed[at] == h, first[:-1])
            long = hi - lo >= a.least
            new: dict[int, set[int]] = defaultdict(set)
            for i, j in zip(lo[long].tolist(), hi[long].tolist(), strict=True):
                spans, found = a.scan([data[s[k] : e[k]].tobytes() for k in range(i, j)])
                for x, y in spans:
                    hit[i + x : i + y] = True
                if found:
                    new[int(np.searchsorted(first, i, side="right")) - 1] |= found
            for d, found in new.items():
                n_items[d] += len(found)
                items[d] |= {a.names[k] for k in found}
        spans, cut = [], []
        sums = np.concatenate(([0], np.cumsum(hit)))
        for d, n in enumerate((sums[first[1:]] - sums[first[:-1]]).tolist()):
            spans.append([])
            cut.append(None)
            if n:
                x, y = _runs(hit[first[d] : first[d + 1]], np.zeros(0, np.int64))
                spans[-1] = [{"start": p, "end": q} for p, q in zip(x.tolist(), y.tolist(), strict=True)]
                cut[-1] = _without(raw, offs[d], offs[d + 1], s[first[d] : first[d + 1]], e[first[d] : first[d + 1]], x, y)
        return {"row": part.column("row"), "text": part.column("text"), "n_words": counts, "spans": spans, "items": [sorted(x) for x in items], "n_items": n_items, "cut": cut}

    return by_slice(work, schema)


def _without(raw: np.ndarray, lo: int, hi: int, s: np.ndarray, e: np.ndarray, x: np.ndarray, y: np.ndarray) -> str:
    """The text at lo to hi without words x to y of each span, nor what stands between these; a blank takes their place."""
    out, at = [], lo
    for p, q in zip(x.tolist(), y.tolist(), strict=True):
        out.append(raw[at : s[p]].tobytes())
        at = e[q - 1]
    return b" ".join([*out, raw[at:hi].tobytes()]).decode()


def _maybe(sets: list, schema: pa.Schema):
    def work(part: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> dict:
        low = LOWER[data]
        s, e, counts = bounds(low, offs, ALNUM)
        wh = hashes(low, s, e)
        found = np.zeros(len(counts), bool)
        for own in sets:
            found |= own.value.touched(wh, counts)
        return {"row": part.column("row"), "text": part.column("text"), "n_words": counts, "maybe": found}

    return by_slice(work, schema)


def report(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, max_words: int = MAX_WORDS) -> DataFrame:
    """For each row: row (all of docs' columns), n_words, n_items, items (ids of items with an occurring window), spans
    (hit words, end exclusive) and cut, the text without these words (null where there are none)."""
    spark = docs.sparkSession
    text = F.coalesce(benchmark[f"`{item_text}`"], F.lit(""))
    # A word and what parts it are two characters at least.
    rows = benchmark.select(F.coalesce(benchmark[f"`{item_id}`"].cast("string"), F.lit("")).alias("id"), text.alias("text"), (F.length(text).cast("long") + 1).alias("size"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0]
    parts = max(1, -(-total // (2 * max_words)))

    def items(k: int, n: int) -> list[tuple[str, list[bytes]]]:
        own = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        return [(i, item_words(t)) for i, t in sorted((r["id"], r["text"]) for r in own.select("id", "text").toLocalIterator())]

    source = packed(docs, text=text_col)
    fields = [("row", arrow_type(source, "row")), ("text", pa.string())]
    schema = pa.schema([*fields, *((c, x) for c, (_, x) in MEASURES.items())])
    types = _with(source, ", ".join(f"{c} {kind}" for c, (kind, _) in MEASURES.items()))

    def scan(df: DataFrame, k: int) -> DataFrame:
        return df.mapInArrow(_scan(spark.sparkContext.broadcast(Automaton(items(k, parts), window)), schema), types)

    if parts == 1:
        return scan(source, 0).drop("text")
    n = max(1, -(-total // (2 * FILTER_WORDS)))
    sets = [spark.sparkContext.broadcast(Windows(items(k, n), window)) for k in range(n)]
    flagged = source.mapInArrow(_maybe(sets, pa.schema([*fields, ("n_words", pa.int64()), ("maybe", pa.bool_())])), _with(source, "n_words bigint, maybe boolean"))
    some = materialize(flagged.where("maybe").select("row", "text"), "decontaminate")
    for k in range(parts):
        some = materialize(scan(some, k), "decontaminate")
    none = {"spans": F.array(), "items": F.array(), "n_items": F.lit(0), "cut": F.lit(None)}
    rest = flagged.where(~F.col("maybe")).select("row", "n_words", *[c.cast(MEASURES[k][0]).alias(k) for k, c in none.items()])
    return rest.unionByName(some.drop("text"))


def _with(df: DataFrame, ddl: str) -> StructType:
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def verdict(found: DataFrame, num: int = 1, den: int = 20) -> DataFrame:
    """Adds n_hit and contaminated: some word is hit, and num/den of the words or more."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]).cast("long"))
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (den * F.col("n_hit") >= num * F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", num: int = 1, den: int = 20, **kw) -> DataFrame:
    """docs without contaminated rows; from the others' text the hit words are cut, with what stands
    between them, and n_chars, where there, is set anew for these."""
    found = verdict(report(docs, benchmark, text_col, **kw), num, den).where(~F.col("contaminated"))
    new = {text_col: F.coalesce("cut", F.col(f"row.`{text_col}`"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("cut").isNull(), F.col("row.n_chars")).otherwise(F.char_length("cut").cast(dict(docs.dtypes)["n_chars"]))
    return found.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = verdict(report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def brute(docs: list[tuple], items: list[tuple], window: int = 13) -> list[tuple]:
    """The query's rows from plain Python, for tests."""
    wins: dict[tuple, set] = defaultdict(set)
    for k, (name, text) in enumerate(items):
        w = item_words(text)
        if w:
            m = min(window, len(w))
            for i in range(len(w) - m + 1):
                wins[tuple(w[i : i + m])].add(k)
    sizes, out = {len(x) for x in wins}, []
    for doc_id, text in docs:
        w, hit, found = item_words(text), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if own := wins.get(tuple(w[i : i + m])):
                    hit.update(range(i, i + m))
                    found |= own
        ids = ",".join(sorted({str(items[k][0]) for k in found}))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out
