"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted over the cluster; repeated
windows merge into maximal removal intervals.

A word goes if a window over it starts with the same words in a document with a smaller id. Rows are dealt
into blocks of about BLOCK_BYTES of text. A block sends, for each shard of the hash space, its distinct
hashes (80 bits: sorted, so the first 64 as differences of six bytes) and the smallest id of each; so a
window found in a third of all documents is one entry of each block. A shard answers with a bit for each
entry: whether a smaller id has it elsewhere. The block hashes its texts again and marks words. Only packed
hashes and bits cross the network besides the texts, once.

Scale. A shard has about SHARD_BYTES of entries, so their number grows with the input, and so do messages;
an empty one isn't sent, so there is never more than one for each distinct window of a block: the worst is
a row a window, which is linear. With 64 bits for each of n windows, n**2 / 2**65 pairs would be taken as
equal wrongly; 80 bits leave 3e-5 expected pairs at 30 GB. Within a block the same 80 bits are compared.

Edge cases. Null or empty text: no words. Very long texts: whole, a text is never cut into blocks. Ties: rows
that share an id are one document, whose windows don't remove words of one another; each row is judged on
its own, so repeated rows get equal results. Null ids come after all others, as one document; they and a
very common id are dealt over all blocks by their texts. An empty table gives no rows. Ids may be of any
type that has an order. Other columns, whatever their names, pass through `clean`."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from .common import arrow_type, packed, slices, text_buffers, whole
from .words import NOT_SPACE, bounds, cover, hashes, windows

WINDOW = 13
#: Of text in a block, whose arrays take about 12 times as much in a worker; and of entries in a shard (6 times).
BLOCK_BYTES, SHARD_BYTES = 6 << 20, 32 << 20
#: Of entries for each byte of text, about: ten for each word.
ENTRY_SHARE = 1.7
_MORE = 0xC2B2AE3D27D4EB4F


def _doc_windows(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """starts, ends of words, words per text, starts of whole windows (as word numbers), their hashes: 64 bits and 16 more."""
    ss, es, cs, hs = [], [], [], []
    for i, j in slices(offs):
        s, e, c = bounds(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], NOT_SPACE)
        hs.append(hashes(data[offs[i] : offs[j]], s, e))
        ss.append(s + offs[i])
        es.append(e + offs[i])
        cs.append(c)
    none = np.zeros(0, np.int64)
    s, e, c = (np.concatenate(x) if x else none for x in (ss, es, cs))
    wh = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
    h, more = windows(wh, size), (windows(wh, size, _MORE) >> np.uint64(48)).astype(np.uint16)
    text = np.repeat(np.arange(len(c)), c)
    at = np.flatnonzero(text[: len(h)] == text[size - 1 :]) if len(h) else none
    return s, e, c, at, h[at], more[at]


def _sorted(h: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (h, more), and which places begin a new pair. That two with equal h differ in more is next to never."""
    by = np.argsort(h, kind="stable")
    for _ in range(2):
        a, b = h[by], more[by]
        new = np.ones(len(by), bool)
        new[1:] = a[1:] != a[:-1]
        odd = ~new[1:] & (b[1:] != b[:-1])
        if not odd.any():
            break
        by = np.lexsort((more, h))
        new[1:] |= b[1:] != b[:-1]
    return by, new


def ranks(ids: pa.Array) -> np.ndarray:
    """0 for the smallest id, 1 for the next, the last for nulls; equal ids have equal ranks."""
    if not len(ids):
        return np.zeros(0, np.int64)
    return np.asarray(pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense")).astype(np.int64) - 1


def _block(ids: pa.Array, texts: pa.Array, size: int) -> dict:
    data, offs = text_buffers(texts)
    rank = ranks(ids)
    s, e, c, at, h, more = _doc_windows(data, offs, size)
    first = np.concatenate(([0], np.cumsum(c)))
    row = np.searchsorted(first, at, side="right") - 1
    by, new = _sorted(h, more)
    group = np.flatnonzero(new)
    own = rank[row[by]] if len(by) else by
    least = np.minimum.reduceat(own, group) if len(group) else group
    holder = np.zeros(int(rank.max()) + 1 if len(rank) else 0, np.int64)
    holder[rank] = np.arange(len(rank))
    return {"data": data, "s": s, "e": e, "c": c, "first": first, "at": at, "by": by, "new": new, "own": own, "hash": h[by][group], "more": more[by][group], "least": least, "holder": holder}


def _pack(hs: np.ndarray) -> bytes:
    """Sorted 64-bit hashes as differences: six bytes each, eight where one doesn't fit."""
    d = np.diff(hs, prepend=np.uint64(0))
    if len(d) > 1 and not (d[1:] >> np.uint64(48)).any():
        return b"\x06" + d[:1].tobytes() + np.ascontiguousarray(d[1:].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
    return b"\x08" + hs.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    if raw[:1] == b"\x08":
        return np.frombuffer(raw, np.uint64, offset=1)
    rest = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, 6)
    d = np.zeros((len(rest) + 1, 8), np.uint8)
    d[0] = np.frombuffer(raw, np.uint8, count=8, offset=1)
    d[1:, :6] = rest
    return np.cumsum(d.view(np.uint64).ravel(), dtype=np.uint64)


def _cuts(hs: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's hashes begin and end: shards are equal ranges of the hash space."""
    edges = np.array([(k << 64) // shards for k in range(1, shards)], np.uint64)
    return np.concatenate(([0], np.searchsorted(hs, edges), [len(hs)])).astype(np.int64)


def _send(size: int, shards: int, id_type: pa.DataType):
    def run(table: pa.Table) -> pa.Table:
        ids = whole(table.column("id"))
        b = _block(ids, table.column("text"), size)
        cut, block = _cuts(b["hash"], shards), table.column("block")[0].as_py()
        cols, holders, ends = [[], [], []], [], [0]
        full = np.flatnonzero(np.diff(cut))
        for k in full.tolist():
            x, y = cut[k], cut[k + 1]
            used, place = np.unique(b["least"][x:y], return_inverse=True)
            small = place.astype(np.uint16 if len(used) < 65536 else np.uint32)
            for col, raw in zip(cols, (_pack(b["hash"][x:y]), b["more"][x:y].tobytes(), small.tobytes()), strict=True):
                col.append(raw)
            holders.append(b["holder"][used])
            ends.append(ends[-1] + len(used))
        own = ids.take(pa.array(np.concatenate(holders) if holders else np.zeros(0, np.int64)))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), own.cast(id_type))
        return pa.table({"shard": pa.array(full, pa.int32()), "block": pa.array([block] * len(full), pa.int32()), "hashes": pa.array(cols[0], pa.binary()), "more": pa.array(cols[1], pa.binary()), "docs": pa.array(cols[2], pa.binary()), "ids": lists})

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Of one shard: for each block's entries, whether a smaller id has the hash in another block."""
    ids = whole(table.column("ids"))
    rank, begin = ranks(ids.flatten()), 0
    hs, more, least, lengths = [], [], [], []
    for h, m, d, n in zip(*(table.column(c) for c in ("hashes", "more", "docs")), pc.list_value_length(ids).to_pylist(), strict=True):
        h, d = _unpack(h.as_py()), d.as_py()
        hs.append(h)
        more.append(np.frombuffer(m.as_py(), np.uint16))
        least.append(rank[begin : begin + n][np.frombuffer(d, np.uint16 if len(d) == 2 * len(h) else np.uint32)])
        lengths.append(len(h))
        begin += n
    h, least = np.concatenate(hs), np.concatenate(least)
    order, new = _sorted(h, np.concatenate(more))
    group = np.flatnonzero(new)
    smallest = np.minimum.reduceat(least[order], group)
    later = np.empty(len(h), bool)
    later[order] = least[order] > np.repeat(smallest, np.diff(np.append(group, len(h))))
    bits = [np.packbits(x).tobytes() for x in np.split(later, np.cumsum(lengths)[:-1])]
    return pa.table({"block": table.column("block").cast(pa.int32()), "shard": table.column("shard").cast(pa.int32()), "bits": pa.array(bits, pa.binary())})


def _mark(size: int, shards: int, with_text: bool, schema: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        b = _block(whole(left.column("id")), left.column("text"), size)
        cut = _cuts(b["hash"], shards)
        elsewhere = np.zeros(len(b["hash"]), bool)
        for k, raw in zip(right.column("shard").to_pylist(), right.column("bits"), strict=True):
            n = cut[k + 1] - cut[k]
            elsewhere[cut[k] : cut[k + 1]] = np.unpackbits(np.frombuffer(raw.as_py(), np.uint8), count=n).astype(bool)
        entry = np.cumsum(b["new"]) - 1
        again = elsewhere[entry] | (b["own"] > b["least"][entry]) if len(entry) else np.zeros(0, bool)
        gone = cover(b["at"][b["by"][again]], size, len(b["s"]))
        raw, out = b["data"].tobytes(), []
        sums = np.concatenate(([0], np.cumsum(gone)))
        removed = sums[b["first"][1:]] - sums[b["first"][:-1]]
        for i in range(len(b["c"])):
            x, y = b["first"][i], b["first"][i + 1]
            s, e = b["s"][x:y], b["e"][x:y]
            if removed[i]:
                live = ~gone[x:y]
                s, e = s[live], e[live]
            out.append(b" ".join([raw[p:q] for p, q in zip(s.tolist(), e.tolist(), strict=True)]))
        cols = {"n_words": pa.array(b["c"], pa.int64()), "n_removed": pa.array(removed, pa.int64())}
        if with_text:
            cols["kept"] = pa.array([x.decode() for x in out], pa.string())
        else:
            cols["kept_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string())
        return pa.table({f.name: cols[f.name] if f.name in cols else left.column(f.name) for f in schema}).cast(schema)

    return run


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, with_text: bool = True, with_row: bool = False, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """For each row: id, n_words, n_removed and the words kept (or their SHA-256), and if asked for row, all of docs' columns."""
    source, blocks, shards = deal(docs, id_col, text_col, with_row, block_bytes, shard_bytes)
    bits = messages(source, size, shards).groupBy("shard").applyInArrow(_answer, "block int, shard int, bits binary")
    told = ["id", "row"] if with_row else ["id"]
    kept = "kept" if with_text else "kept_sha256"
    schema = pa.schema([*((c, arrow_type(source, c)) for c in told), ("n_words", pa.int64()), ("n_removed", pa.int64()), (kept, pa.string())])
    kinds = source.select(told).schema.add("n_words", LongType()).add("n_removed", LongType()).add(kept, StringType())
    return source.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(_mark(size, shards, with_text, schema), kinds)


def deal(docs: DataFrame, id_col: str, text_col: str, with_row: bool, block_bytes: int, shard_bytes: int) -> tuple[DataFrame, int, int]:
    """Rows with their block, and how many blocks and shards there are."""
    source = packed(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    total = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks, shards = max(least, -(-total // block_bytes)), max(least, -(-int(ENTRY_SHARE * total) // shard_bytes))
    # An id may lie in several blocks: ids are compared by value everywhere.
    source = source.select(*(["row"] if with_row else []), "id", "text", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int").alias("block"))
    return source, blocks, shards


def messages(source: DataFrame, size: int, shards: int) -> DataFrame:
    kind = dict(source.dtypes)["id"]
    ddl = f"shard int, block int, hashes binary, more binary, docs binary, ids array<{kind}>"
    return source.select("id", "text", "block").groupBy("block").applyInArrow(_send(size, shards, arrow_type(source, "id")), ddl)


def clean(docs: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """docs whose texts are the words kept, joined by blanks, where any word goes; others stay as they are. n_chars, where there, is set anew."""
    out = dedup_windows(docs, text_col=text_col, with_row=True, **kw)
    cut = F.col("n_removed") > 0
    new = {text_col: F.when(cut, F.col("kept")).otherwise(F.col(f"row.`{text_col}`"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.char_length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    return out.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = dedup_windows(table(spark, sf_dir, "documents"), with_text=False)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def brute(docs: list[tuple], size: int = WINDOW) -> list[tuple]:
    """The query's rows from plain Python, for tests."""
    words = [(k, (t or "").encode().split()) for k, t in docs]
    least: dict[tuple, int] = {}
    for k, w in words:
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            least[key] = min(k, least.get(key, k))
    out = []
    for k, w in words:
        gone = {i + j for i in range(len(w) - size + 1) if least[tuple(w[i : i + size])] < k for j in range(size)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
