"""Best-fit packing with exact-complement hashing.

Texts become token pieces of at most SIZE tokens. Packing works on the histogram of piece lengths, which
has at most SIZE entries however many pieces there are, so the driver plans it: open a sequence with the
longest length left, look up single, pair and triple sums of available lengths that fill the gap exactly,
and else place the longest length that fits and look again. A combination is used as often as its
lengths are available, so a plan has few patterns, each with a count. Pieces then find their places by
their rank within their length; ranks are counted in blocks of a hash of the id, so a length that a third
of all pieces have is spread over many tasks.

Edge cases. Null or empty text: one piece, the end token. Very long texts: whole, in pieces of SIZE; only they
are cut. Ties: pieces of equal length are ranked by block, id, piece number and CRC, so a rerun places them
alike; repeated rows, and rows without an id, are packed each on its own. An empty table gives no rows. Only
the id and the text are read, and the result has its own columns, so no name can clash.

Token ids are those of the tokenizer file. Where its settings are those below, a slice of texts is cut into words
here, and each distinct word is merged once, many words at a time; words of over 32 bytes, and texts with characters
outside SIMPLE, are given to the tokenizers library, as are all texts of a file with other settings."""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, slices, text_buffers

SIZE, END_ID, BLOCK_TOKENS = 4096, 1, 1_000_000
TOKENIZER = "word_bpe_49k.json"
#: Words that the library was asked for, kept in a worker's table; when full it starts anew. Only speed depends on it.
CACHE_WORDS = 100_000
#: Bits for a place in a word that is merged here, so longer words are the library's; and the rank of what is no pair.
PLACE = 5
LAST = 1 << 25
#: An odd number that spreads pairs over a hash table.
SPREAD = 0x9E3779B97F4A7C15

# The settings of a tokenizer file for which words are cut here.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: ASCII, and the Latin-1 letters that are composed, have simple lower case, and are letters for both libraries.
SIMPLE = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]")
#: Kinds of bytes in UTF-8. Only lead byte C3 is a letter's, so a byte from 80 on belongs to it if its text is simple.
OTHER, SPACE, MARK, DIGIT, LETTER = range(5)


def _shown() -> dict[int, str]:
    """Byte-level models spell bytes as characters: printable ones as themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}


_SHOWN = _shown()


def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """For each byte its kind, and the byte of the lower-cased letter."""
    kind, lower = np.full(256, OTHER, np.uint8), np.arange(256, dtype=np.uint8)
    for c in filter(SIMPLE.fullmatch, map(chr, range(256))):
        kind[list(c.encode())] = LETTER if c.isalpha() else DIGIT if c.isdigit() else SPACE if c.isspace() else MARK
        lower[list(c.encode())] = list(c.lower().encode())
    return kind, lower


_KIND, _LOWER = _bytes()


def cut_words(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """What SPLITTER's pattern cuts from simple texts once they are lower-cased, and the place of each text's first word."""
    kind, low = _KIND[data], _LOWER[data]
    starts = kind == DIGIT
    starts[1:] |= kind[1:] != kind[:-1]
    starts[offs[:-1][offs[:-1] < offs[1:]]] = True
    # An apostrophe that begins a run of marks and has one of these endings after it in its text is a word with it.
    quote = np.flatnonzero(starts & (low == ord("'")))
    room = offs[np.searchsorted(offs, quote, side="right")] - quote
    for end in (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"):
        at = quote[room > len(end)]
        for k, c in enumerate(end, 1):
            at = at[low[at + k] == c]
        starts[at + 1] = False
        # The text's next byte begins a word, if there is one.
        after = at + len(end) + 1
        starts[after[~np.isin(after, offs)]] = True
    used = kind != SPACE
    starts &= used
    first = np.searchsorted(np.flatnonzero(starts), offs)
    places = np.append(np.flatnonzero(starts[used]), np.count_nonzero(used)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(low[used])]), first


class Words(dict):
    """Ids of words, given as UTF-8, looked up in the model when first asked for."""

    def __init__(self, model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        shown = word.decode("latin-1").translate(_SHOWN)
        self[word] = ids = np.array([x.id for x in self.model.tokenize(shown)], "<u4").tobytes()
        return ids


class Merges:
    """Byte pair merges of many words at once, as the library does them one by one: of a word's pairs the one that comes
    first in the list, and of equal ones the leftmost."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str) -> None:
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.new = np.array([vocab[a + b] for a, b in pairs], np.int32)
        #: Greater than all ids: what follows a word's last symbol.
        self.none = max(vocab.values()) + 1
        # A hash table with four places a pair or more: a pair's is the first free one from its hash on.
        self.bits = (4 * len(pairs) + 1).bit_length()
        self.keys, self.ranks = np.full(1 << self.bits, -1), np.full(1 << self.bits, LAST, np.int32)
        for rank, (a, b) in enumerate(pairs):
            key = vocab[a] * (self.none + 1) + vocab[b]
            at = key * SPREAD % (1 << 64) >> 64 - self.bits
            while self.keys[at] not in (-1, key):
                at = (at + 1) % (1 << self.bits)
            self.keys[at], self.ranks[at] = key, rank
        #: Symbols of bytes, and of bytes that end a word; ranks of the pairs that they make.
        self.byte = np.array([vocab.get(_SHOWN[b] + end, self.none) for end in ("", suffix) for b in range(256)], np.int32)
        self.first = self.rank(np.repeat(self.byte[:256], 512), np.tile(self.byte, 256)).reshape(256, 512)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * (self.none + 1) + b
        at = ((key.view(np.uint64) * np.uint64(SPREAD)) >> np.uint64(64 - self.bits)).view(np.int64)
        there = self.keys[at]
        again = np.flatnonzero((there != key) & (there >= 0))
        while len(again):
            at[again] = (at[again] + 1) % (1 << self.bits)
            there = self.keys[at[again]]
            again = again[(there != key[again]) & (there >= 0)]
        # A free place has the rank of what is no pair.
        return self.ranks[at]

    def ids(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of equal length, a column each, to their ids, word by word, and how many each has."""
        size, n = text.shape
        text = text.astype(np.int32)
        text[-1] += 256
        # One row more stands for what is before a word's first symbol and after its last.
        symbols = np.vstack([self.byte[text], np.full((1, n), self.none, np.int32)])
        after, before = np.repeat(np.arange(1, size + 2), n).reshape(size + 1, n), np.repeat(np.arange(-1, size), n).reshape(size + 1, n)
        before[0] = size
        # For each symbol the rank of the pair that it begins, and its place: the least is the next to be merged.
        pairs = np.full((size + 1, n), LAST << PLACE, np.int32)
        pairs[: size - 1] = (self.first[text[:-1], text[1:]] << PLACE) + np.arange(size - 1, dtype=np.int32)[:, None]
        flat, flat_pairs, flat_after, flat_before = symbols.ravel(), pairs.ravel(), after.ravel(), before.ravel()
        for _ in range(size - 1):
            least = pairs[: size - 1].min(axis=0)
            column = np.flatnonzero(least < LAST << PLACE)
            if not len(column):
                break
            least = least[column]
            row, new = least & ((1 << PLACE) - 1), self.new[least >> PLACE]
            here = row * n + column
            gone = flat_after[here] * n + column
            right = flat_after[gone]
            flat[here], flat[gone], flat_pairs[gone] = new, -1, LAST << PLACE
            flat_after[here] = right
            right = right * n + column
            flat_before[right] = row
            flat_pairs[here] = (self.rank(new, flat[right]) << PLACE) + row
            left = flat_before[here]
            inside = np.flatnonzero(left < size)
            left, at = left[inside], left[inside] * n + column[inside]
            flat_pairs[at] = (self.rank(flat[at], new[inside]) << PLACE) + left
        kept = symbols[:-1].T >= 0
        return symbols[:-1].T[kept], kept.sum(axis=1)


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.words = Words(self.tokenizer.model)
        with open(path) as f:
            said = json.load(f)
        model = said["model"]
        plain = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix"))
        #: Whether words may be cut here; if not, all texts go to the library.
        self.own = plain and said["normalizer"] == NORMALIZER and said["pre_tokenizer"] == SPLITTER and not said["post_processor"]
        if self.own:
            self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
            self.own = bool((self.merges.byte.reshape(2, 256)[:, _LOWER[_KIND > SPACE]] < self.merges.none).all())
        #: Strings that the library takes out of a text before it normalises it.
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        raw = text.encode()
        return self.encode_all(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]

    def encode_all(self, data: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """For each text, given as UTF-8 and offsets. Distinct words are looked up once."""
        own = np.full(len(offs) - 1, self.own)
        if self.own:
            own[np.searchsorted(offs, np.flatnonzero(_KIND[data] == OTHER), side="right") - 1] = False
            raw = data.tobytes()
            for x in (x.encode() for x in self.special):
                at = raw.find(x)
                while at >= 0:
                    i = int(np.searchsorted(offs, at, side="right")) - 1
                    if at + len(x) <= offs[i + 1]:
                        own[i] = False
                    at = raw.find(x, at + 1)
        sizes = np.diff(offs)
        ids = iter(self._own(data if own.all() else data[np.repeat(own, sizes)], np.cumsum([0, *sizes[own]])))
        return [next(ids) if own[i] else self.library(data[offs[i] : offs[i + 1]].tobytes().decode()) for i in range(len(own))]

    def _own(self, data: np.ndarray, offs: np.ndarray) -> list[bytes]:
        words, first = cut_words(data, offs)
        coded = words.dictionary_encode()
        which, (ids, at, n) = np.asarray(coded.indices), self._ids(coded.dictionary)
        at, n = at[which], n[which]
        ends = np.cumsum(np.append(0, n))
        ids = ids[np.repeat(at - ends[:-1], n) + np.arange(ends[-1])]
        return [ids[i:j].tobytes() for i, j in pairwise(ends[first].tolist())]

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words one after another, and where each word's begin and how many they are."""
        _, offs, data = words.buffers()
        offs, data = np.frombuffer(offs, np.int32)[: len(words) + 1], np.frombuffer(data, np.uint8)
        length = np.diff(offs)
        found, at, n, total = [np.empty(0, "<u4")], np.empty(len(words), np.int64), np.empty(len(words), np.int64), 0
        for size in np.unique(length).tolist():
            own = np.flatnonzero(length == size)
            if size <= 1 << PLACE:
                ids, n[own] = self.merges.ids(data[offs[own] + np.arange(size)[:, None]])
            else:
                raws = [self.words[x] for x in words.take(pa.array(own)).to_pylist()]
                ids, n[own] = np.frombuffer(b"".join(raws), "<u4"), [len(x) // 4 for x in raws]
            at[own] = total + np.cumsum(n[own]) - n[own]
            total += len(ids)
            found.append(ids.astype("<u4", copy=False))
        return np.concatenate(found), at, n


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _pieces(path: str | None, size: int, with_ids: bool, schema: pa.Schema):
    end = np.array([END_ID], "<u4").tobytes()

    def cut(enc: Encoder, ids: pa.Array, data: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
        raws = [raw + end for raw in enc.encode_all(data, offs)]
        cols: list[list] = [[] for _ in range(5)]
        for i, raw in enumerate(raws):
            for k, at in enumerate(range(0, len(raw), 4 * size)):
                own = raw[at : at + 4 * size]
                for c, v in zip(cols, (i, k, at // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                    c.append(v)
        arrays = [ids.take(pa.array(cols[0], pa.int64())), *(pa.array(c, f.type) for c, f in zip(cols[1:], list(schema)[1:5], strict=True))]
        if with_ids:
            # Pieces follow one another without gaps, so their ids are one buffer that isn't copied again.
            arrays.append(pa.ListArray.from_arrays(np.cumsum([0, *cols[3]], dtype=np.int32), np.frombuffer(b"".join(raws), "<i4")))
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches):
        enc = encoder(path or default_tokenizer())
        for batch in batches:
            # A batch may have thousands of texts, and their ids take several times their bytes: a slice at a time.
            ids, (data, offs) = batch.column(0), text_buffers(batch.column(1))
            for i, j in slices(offs):
                yield cut(enc, ids.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])

    return run


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces: id, piece, start, length, ids_crc32 and, if asked for, ids."""
    from pyspark.sql.pandas.types import to_arrow_type

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    fields = [("doc_id", to_arrow_type(source.schema["doc_id"].dataType)), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    ddl = f"doc_id {dict(source.dtypes)['doc_id']}, piece int, start bigint, length bigint, ids_crc32 bigint"
    if with_ids:
        fields, ddl = [*fields, ("ids", pa.list_(pa.int32()))], ddl + ", ids array<int>"
    return source.mapInArrow(_pieces(path, size, with_ids, pa.schema(fields)), ddl)


class Plan:
    """Patterns of lengths that share a sequence, each with the number of sequences that have it."""

    def __init__(self, histogram: dict[int, int], size: int) -> None:
        self.size = size
        self.left = np.zeros(size + 1, np.int64)
        for length, n in histogram.items():
            self.left[length] = n
        self.patterns: list[tuple[list[int], int]] = []
        self._pairs: np.ndarray | None = None
        self._run()

    def _pair_sums(self) -> np.ndarray:
        """Which sums two available lengths have. Lengths only run out, so an old table holds every sum there still is."""
        if self._pairs is None:
            have = (self.left > 0).astype(float)
            n = 2 * len(have)
            self._pairs = np.fft.irfft(np.fft.rfft(have, n) ** 2, n)[: len(have)] > 0.5
        return self._pairs

    def _pair(self, gap: int, left: np.ndarray) -> list[int] | None:
        a = np.arange(1, gap // 2 + 1)
        ok = (left[a] > 0) & (left[gap - a] > 0)
        if gap % 2 == 0 and len(a):
            ok[-1] &= left[gap // 2] > 1
        at = np.flatnonzero(ok)
        return [int(gap - a[at[0]]), int(a[at[0]])] if len(at) else None

    def _exact(self, gap: int, left: np.ndarray) -> list[int] | None:
        if left[gap] > 0:
            return [gap]
        if found := self._pair(gap, left):
            return found
        sums = self._pair_sums()
        a = np.flatnonzero(left[: gap - 1] > 0)
        for c in a[sums[gap - a]][::-1].tolist():
            left[c] -= 1
            found = self._pair(gap - c, left)
            left[c] += 1
            if found:
                return sorted([c, *found], reverse=True)
        return None

    def _run(self) -> None:
        while True:
            have = np.flatnonzero(self.left)
            if not len(have):
                break
            first = int(have[-1])
            left = self.left.copy()
            left[first] -= 1
            pattern, gap = [first], self.size - first
            while gap:
                if found := self._exact(gap, left):
                    pattern += found
                    break
                fits = np.flatnonzero(left[1 : gap + 1] > 0)
                if not len(fits):
                    break
                pattern.append(int(fits[-1]) + 1)
                left[pattern[-1]] -= 1
                gap -= pattern[-1]
            lengths, uses = np.unique(pattern, return_counts=True)
            times = int((self.left[lengths] // uses).min())
            self.left[lengths] -= uses * times
            self.patterns.append((pattern, times))
            if (self.left[lengths] == 0).any() and len(self.patterns) % 64 == 0:
                self._pairs = None

    def rows(self) -> dict[int, dict[str, np.ndarray]]:
        """For each length, slots in order of rank: first rank, first sequence and offset of each run of slots."""
        slots: dict[int, list[tuple[int, int, int]]] = {}
        sequence = 0
        for pattern, times in self.patterns:
            offset = 0
            for length in pattern:
                slots.setdefault(length, []).append((times, sequence, offset))
                offset += length
            sequence += times
        return {k: {"rank": np.cumsum([0] + [x[0] for x in v[:-1]]), "sequence": np.array([x[1] for x in v]), "offset": np.array([x[2] for x in v])} for k, v in slots.items()}


def place(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """pieces (with length) and sequence_id and offset."""
    spark = pieces.sparkSession
    # At most size rows, each a length and a count.
    # With token ids, a block has about BLOCK_TOKENS of them, as a task holds a block in memory.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.sparkContext.broadcast(Plan(histogram, size).rows())
    blocks = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), sum(histogram.values()) // 100_000, sum(k * n for k, n in histogram.items()) // BLOCK_TOKENS if "ids" in pieces.columns else 0)
    dealt = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).cast("int"))
    # Before each block: how many pieces of a length the blocks before it have. A length has a row a block at most.
    earlier = W.partitionBy("length").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    counts = dealt.groupBy("_block", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("_block", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_base"))
    # Counts come as rows of their block: with token ids on the left, a cogroup had groups with an empty right side.
    both = dealt.withColumn("_base", F.lit(None).cast("bigint")).unionByName(counts, allowMissingColumns=True)
    columns = pieces.columns
    schema = pa.schema([*_fields(pieces), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        counted = pc.is_valid(table.column("_base"))
        own, table = table.filter(counted).select(["length", "_base"]), table.filter(pc.invert(counted))
        slots = plan.value
        length = np.asarray(table.column("length").combine_chunks())
        base = np.zeros(size + 1, np.int64)
        base[np.asarray(own.column("length").combine_chunks())] = np.asarray(own.column("_base").combine_chunks())
        # The same order however often the task is run.
        order = np.asarray(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("length", "doc_id", "piece", "ids_crc32")]))
        values, first, n = np.unique(length[order], return_index=True, return_counts=True)
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for v, f, m in zip(values.tolist(), first.tolist(), n.tolist(), strict=True):
            rank = base[v] + np.arange(m)
            at = np.searchsorted(slots[v]["rank"], rank, side="right") - 1
            sequence[order[f : f + m]] = slots[v]["sequence"][at] + rank - slots[v]["rank"][at]
            offset[order[f : f + m]] = slots[v]["offset"][at]
        out = table.select(columns).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        return out.cast(schema)

    ddl = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id bigint, offset bigint"
    return both.groupBy("_block").applyInArrow(run, ddl)


def _fields(df: DataFrame) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(df.schema))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces with their token ids and places. Tokens are made once and kept in the shared folder: the histogram and the places are read from there."""
    return place(materialize(tokenize(docs, id_col, text_col, size, path, with_ids), "pieces"), size)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return pack(table(spark, sf_dir, "documents")).drop("ids")
