"""MinHash near-dedup with sequential Bayesian verification.

1. Every text's set of distinct word shingles gives a key of the set (128 bits, over shingle hashes of 128
   bits) and a signature of BANDS x ROWS minima. Equal sets are one node, that of the smallest id.
2. Signatures are cut into bands; nodes with an equal band share a bucket. Each bucket has a pivot, drawn
   by a hash, and pairs every other member with it: as many pairs as members, however large the bucket.
3. A pair's signatures are compared batch by batch. With a uniform prior the posterior probability that
   the similarity reaches the threshold, given m equal of n, is that of at most m successes in n + 1
   trials; below MISS the pair is dropped.
4. Survivors are verified exactly on the full sets, from the texts.
5. Of a bucket that is still in several components, the members outside its largest one have to meet all
   others. Where that would copy members more than COPIES times, as in large buckets of texts that share a
   template, the members are banded again, by FINE bands of more hashes, and go through 2 to 4 once more. A
   pair of the threshold shares a fine band as surely as a band, texts that only share a template rarely do,
   so such buckets come apart.
6. What is still mixed after that is swept: members outside a bucket's largest component are compared with
   all others, in blocks inside tasks, by the same batches and then on the full sets, until they are in one
   component. Only links leave a task. So the pivots lose no link that the bands propose.

Bands miss a pair at the threshold of 0.8 with probability (1 - 0.8**4)**25 < 2e-6, fine ones with
(1 - 0.8**8)**75 < 2e-6, and fewer above it. Of a bucket of n members with k outside its largest component a
sweep sends n * ceil(k / BLOCK) + k * ceil(n / BLOCK) copies; it is quadratic only for texts of which many
have similarities just under the threshold, as a template of less doesn't fill fine buckets.

Edge cases. Null or empty text, or text without words: an empty set, linked with nothing. Fewer words than
a shingle has: the whole sequence is the one shingle. Very long texts: whole. Ties: a pair of exactly the
threshold is linked; of equal ids the smallest set key stands for the document, and all its rows get its
component; of a group the smallest id stays, in all its rows. Rows with a null id are linked with nothing,
and stay. An empty table gives no rows. Ids may be of any type that has an order. Other columns, whatever
their names, pass through `keep`."""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_type, by_slice, materialize, packed, slices, text_buffers, whole
from .components import components, merged
from .words import LOWER, NOT_SPACE, bounds, hashes, mix, windows

BANDS, ROWS = 25, 4
#: Bands and rows by which members of large mixed buckets are banded again.
FINE = 75, 8
#: Probability at which a pair is given up, and hashes compared before each decision.
MISS, BATCH = 1e-6, 20
#: Members of a bucket, and bytes of their texts, in a block; a sweep compares two blocks in one task.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Copies of a member that a sweep may send on average; a bucket that would send more is banded again first.
COPIES = 16

_MORE = 0xC2B2AE3D27D4EB4F


def _draw(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n odd multipliers and as many summands."""
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, 64 more bits of each, and how many each text has."""
    data = LOWER[data]
    s, e, counts = bounds(data, offs, NOT_SPACE)
    first = np.concatenate(([0], np.cumsum(counts)))
    text = np.repeat(np.arange(len(counts)), counts)
    few = np.flatnonzero((counts > 0) & (counts < size))
    whole, both = None, []
    for seed, base in enumerate((0xD6E8FEB86659FD93, _MORE)):
        wh = hashes(data, s, e, seed)
        h = windows(wh, size, base)
        if whole is None:
            whole = np.flatnonzero(text[: len(h)] == text[size - 1 :]) if len(h) else np.zeros(0, np.int64)
        short = [mix(windows(wh[first[i] : first[i + 1]], int(counts[i]), base) + np.uint64(counts[i])) for i in few]
        both.append(np.concatenate([h[whole], *short]))
    owner = np.concatenate((text[whole], few))
    h, more = both
    order = np.lexsort((h, owner))
    h, more, owner = h[order], more[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], more[new], np.bincount(owner[new], minlength=len(counts))


def set_keys(h: np.ndarray, more: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """128 bits of each set, as two numbers."""
    first = np.concatenate(([0], np.cumsum(counts))).tolist()
    digest = b"".join(hashlib.md5(h[a:b].tobytes() + more[a:b].tobytes()).digest() for a, b in zip(first[:-1], first[1:], strict=True))
    return np.frombuffer(digest, np.int64).reshape(-1, 2)


def signatures(h: np.ndarray, counts: np.ndarray, size: int = BANDS * ROWS, seed: int = 20240229) -> np.ndarray:
    """size minima of each non-empty set, as uint32."""
    full = np.flatnonzero(counts)
    first = np.concatenate(([0], np.cumsum(counts[full])))[:-1]
    out = np.empty((len(full), size), np.uint32)
    with np.errstate(over="ignore"):
        for k, (mul, add) in enumerate(zip(*_draw(size, seed), strict=True)):
            out[:, k] = np.minimum.reduceat(((h * mul + add) >> np.uint64(32)).astype(np.uint32), first) if len(first) else 0
    return out


def least_matches(n: int, threshold: tuple[int, int], miss: float = MISS) -> int:
    """Fewest equal hashes of n with which a pair is still kept."""
    t, total = threshold[0] / threshold[1], 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def survives(a: np.ndarray, b: np.ndarray, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of signatures: which pairs are still likely after the last batch, and their equal hashes."""
    live, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    width = a.shape[1]
    for x in range(0, width, BATCH):
        y = min(x + BATCH, width)
        equal[live] += (a[live, x:y] == b[live, x:y]).sum(1)
        live = live[equal[live] >= least_matches(y, threshold)]
    ok = np.zeros(len(a), bool)
    ok[live] = True
    return ok, equal


def describe(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, n (set size), bytes, k1 and k2 (128 bits of the set) and sig, of each row."""
    source = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
    fields = [(c, pa.int64()) for c in ("n", "bytes", "k1", "k2")]
    schema = pa.schema([("id", arrow_type(source, "id")), *fields, ("sig", pa.binary())])

    def work(part, data, offs):
        h, more, counts = shingle_sets(data, offs, size)
        key = set_keys(h, more, counts)
        sig = [None] * len(counts)
        for i, row in zip(np.flatnonzero(counts).tolist(), signatures(h, counts), strict=True):
            sig[i] = row.tobytes()
        return {"id": part.column(0).cast(schema[0].type), "n": counts, "bytes": np.diff(offs), "k1": key[:, 0], "k2": key[:, 1], "sig": sig}

    return source.mapInArrow(by_slice(work, schema, "text"), f"id {dict(source.dtypes)['id']}, n bigint, bytes bigint, k1 bigint, k2 bigint, sig binary")


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each text and band."""
    sig = sig.reshape(-1, bands, rows).astype(np.uint64)
    key = np.zeros((len(sig), bands), np.uint64)
    with np.errstate(over="ignore"):
        key += np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(40)
        for k in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k])
    return key.view(np.int64)


def _rows(key: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
    again = pa.array(np.repeat(np.arange(len(ids)), key.shape[1]))
    return pa.RecordBatch.from_arrays([pa.array(key.ravel()), ids.take(again)], names=["band", "id"])


def _band_rows(batches):
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32)
        yield _rows(band_keys(sig, BANDS, ROWS), batch.column("id"))


def _fine_rows(size: int):
    """Bands of FINE[0] x FINE[1] fresh hashes, from the texts."""

    def run(batches):
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            for i, j in slices(offs):
                h, _, counts = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], size)
                sig = signatures(h, counts, FINE[0] * FINE[1], 20250307)
                yield _rows(band_keys(sig, *FINE), batch.column("id").slice(i, j - i).filter(pa.array(counts > 0)))

    return run


def _prune(threshold):
    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            ok, equal = survives(a, b, threshold)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(equal, pa.int64())], names=["a", "b", "equal"]).filter(pa.array(ok))

    return run


def _exact(size: int, threshold: tuple[int, int]):
    def shingles(text: str) -> set:
        w = LOWER[np.frombuffer(text.encode(), np.uint8)].tobytes().split()
        return set(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else {tuple(w)}

    def run(batches):
        for batch in batches:
            ok, last, own = [], None, set()
            for ta, tb in zip(batch.column("ta"), batch.column("tb"), strict=True):
                ta, tb = ta.as_py(), tb.as_py()
                if ta != last:
                    last, own = ta, shingles(ta)
                other = shingles(tb)
                both = len(own & other)
                ok.append(threshold[1] * both >= threshold[0] * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _sweep(size: int, threshold: tuple[int, int], id_type: pa.DataType):
    """Of a block of a bucket's members and a block of those outside its largest component: links between
    components, as few as join them."""
    schema = pa.schema([("a", id_type), ("b", id_type)])

    def run(table: pa.Table) -> pa.Table:
        ids, comp = whole(table.column("id")), np.asarray(whole(table.column("comp")).dictionary_encode().indices).copy()
        key, side = (np.asarray(whole(table.column(c))) for c in ("key", "side"))
        h, counts = [], []
        data, offs = text_buffers(table.column("text"))
        for i, j in slices(offs):
            own, _, n = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], size)
            h.append(own)
            counts.append(n)
        h, counts = np.concatenate(h), np.concatenate(counts)
        first = np.concatenate(([0], np.cumsum(counts)))
        sig = signatures(h, counts)
        sets: dict[int, set] = {}

        def own_set(i: int) -> set:
            if i not in sets:
                sets[i] = set(h[first[i] : first[i + 1]].tolist())
            return sets[i]

        # side 0: a member; 1: a member outside the largest component; 2: the latter as what members are compared with.
        left, right = np.flatnonzero(side < 2), np.flatnonzero(side == 2)
        out: list[tuple[int, int]] = []
        for j in right.tolist():
            # Two on the outside meet in two tasks, or twice in one: the smaller key is on the left.
            other = left[(comp[left] != comp[j]) & ((side[left] == 0) | (key[left] <= key[j]))]
            if not len(other):
                continue
            small, large = np.minimum(counts[j], counts[other]), np.maximum(counts[j], counts[other])
            other = other[threshold[1] * small >= threshold[0] * large]
            ok, equal = survives(np.broadcast_to(sig[j], (len(other), sig.shape[1])), sig[other], threshold)
            for i in other[ok][np.argsort(-equal[ok], kind="stable")].tolist():
                if comp[i] != comp[j]:
                    both = len(own_set(i) & own_set(j))
                    if threshold[1] * both >= threshold[0] * (counts[i] + counts[j] - both):
                        out.append((i, j))
                        comp[comp == comp[j]] = comp[i]
        pick = lambda k: ids.take(pa.array([x[k] for x in out], pa.int64())).cast(id_type)
        return pa.table({"a": pick(0), "b": pick(1)}, schema=schema)

    return run


def _buckets(bands: DataFrame, name: str) -> DataFrame:
    """band, id, pivot and size of the buckets of two members or more."""
    # Four orders of pivots: buckets of one group mostly share theirs, so a member has few distinct pairs.
    drawn = F.min_by("id", F.xxhash64(F.pmod("band", F.lit(4)), "id"))
    # A further join key makes Spark exchange both sides again, so that it can split a key with very many rows.
    pivots = bands.groupBy("band").agg(drawn.alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1").withColumn("b2", F.xxhash64("band"))
    return materialize(bands.withColumn("b2", F.xxhash64("band")).join(pivots, ["band", "b2"]).select("band", "id", "pivot", "size"), name)


def _star(shared: DataFrame) -> DataFrame:
    return shared.where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def _labelled(rows: DataFrame, comps: DataFrame, col: str = "id", name: str = "comp") -> DataFrame:
    """rows with the component of a node column; a node without links is its own."""
    own = comps.select(F.col("node").alias("_node"), F.col("comp").alias("_comp"))
    return rows.join(own, rows[col] == own["_node"], "left").withColumn(name, F.coalesce("_comp", col)).drop("_node", "_comp")


def _mixed(shared: DataFrame, comps: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (band, id, comp, bytes) of buckets of three or more, and of those in several components a row
    (band, main, parts, outer_parts, copies): blocks of all and of those outside main, and copies of a member in a
    sweep. Of buckets with the same members one is enough."""
    members = _labelled(shared.where("size > 2").select("band", "id"), comps).join(nodes.select("id", "bytes"), "id")
    same = [F.sum(F.expr("cast(xxhash64(id) as decimal(20, 0))")).alias("s1"), F.expr("bit_xor(xxhash64(id, 1))").alias("s2")]
    by_comp = members.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), *same)
    mixed = by_comp.groupBy("band").agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("size"), F.sum("bytes").alias("bytes"), F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("most"), F.sum("s1").alias("s1"), F.expr("bit_xor(s2)").alias("s2")).where("comps > 1")
    least = mixed.groupBy("size", "s1", "s2").agg(F.min(F.struct("band", "bytes", "main", "most")).alias("m"))
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.ceil(n * F.col("bytes") / F.col("size") / BLOCK_BYTES), F.lit(1)).cast("int")
    plan = least.select("m.*", "size").withColumn("outside", F.col("size") - F.col("most")).withColumns({"parts": blocks(F.col("size")), "outer_parts": blocks(F.col("outside"))})
    copies = F.col("outer_parts") + F.col("outside") * F.col("parts") / F.col("size")
    return members, plan.select("band", "main", "parts", "outer_parts", copies.alias("copies"))


def _sweep_rows(members: DataFrame, mixed: DataFrame) -> DataFrame:
    """A row for each member, block of its own and block of members outside the largest component that it meets."""
    plan = mixed.withColumn("b2", F.xxhash64("band")).drop("copies")
    rows = members.drop("bytes").withColumn("b2", F.xxhash64("band")).join(plan, ["band", "b2"]).withColumn("key", F.xxhash64("id"))
    rows = rows.withColumns({"outside": F.col("comp") != F.col("main"), "x": F.pmod("key", F.col("parts")).cast("int"), "y": F.pmod(F.xxhash64("key"), F.col("outer_parts")).cast("int")})
    left = rows.select("band", "id", "comp", "key", F.col("outside").cast("int").alias("side"), "x", F.explode(F.sequence(F.lit(0), F.col("outer_parts") - 1)).alias("y"))
    right = rows.where("outside").select("band", "id", "comp", "key", F.lit(2).alias("side"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("x"), "y")
    return left.unionByName(right)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """For each row: id, n_shingles and component_id, the smallest id that its links reach."""
    meta = materialize(describe(docs, id_col, text_col, shingle), "signatures")
    kind = dict(meta.dtypes)["id"]
    full = meta.where("n > 0 and id is not null")
    reps = full.groupBy("k1", "k2").agg(F.min("id").alias("rep")).withColumn("k3", F.xxhash64("k1", "k2"))
    owners = full.select("id", "k1", "k2", F.xxhash64("k1", "k2").alias("k3")).join(reps, ["k1", "k2", "k3"]).select("id", "rep")
    member = materialize(owners.groupBy("id").agg(F.min("rep").alias("rep")), "members")
    nodes = full.join(member.where("id = rep").select("id"), "id", "left_semi").groupBy("id").agg(F.min_by(F.struct("sig", "bytes"), F.struct("k1", "k2")).alias("m"))
    nodes = materialize(nodes.select("id", "m.sig", "m.bytes"), "nodes")
    shared = _buckets(nodes.mapInArrow(_band_rows, f"band bigint, id {kind}"), "buckets")
    star = materialize(_star(shared), "pairs")

    # Always by a shuffle: how many ids are wanted grows with the documents, so the plan is the same at every size.
    wanted = star.select(F.col("a").alias("id")).union(star.select("b")).distinct()
    text = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text")).where("text is not null").join(wanted.hint("shuffle_merge"), "id", "left_semi")
    again = materialize(meta.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "repeated")
    texts = materialize(_of_node(text, again, shingle) if again.limit(1).count() else text, "texts")
    sigs = nodes.select("id", "sig")

    def likely(pairs: DataFrame) -> DataFrame:
        compared = pairs.join(sigs.withColumnsRenamed({"id": "a", "sig": "sa"}), "a").join(sigs.withColumnsRenamed({"id": "b", "sig": "sb"}), "b")
        return materialize(compared.select("a", "b", "sa", "sb").mapInArrow(_prune(threshold), f"a {kind}, b {kind}, equal bigint"), "likely")

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.select("a", "b").join(texts.withColumnsRenamed({"id": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"id": "b", "text": "tb"}), "b")
        return materialize(both.select("a", "b", "ta", "tb").mapInArrow(_exact(shingle, threshold), f"a {kind}, b {kind}"), "links")

    def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
        return merged(comps, links) if links.limit(1).count() else comps

    comps = components(verify(likely(star)))

    members, mixed = _mixed(shared, comps, nodes)
    mixed = materialize(mixed, "mixed")
    too_large = F.col("copies") > COPIES
    sweeps = [_sweep_rows(members, mixed.where(~too_large))]
    if mixed.where(too_large).limit(1).count():
        large = mixed.where(too_large).select("band", F.xxhash64("band").alias("b2"))
        crowd = members.withColumn("b2", F.xxhash64("band")).join(large, ["band", "b2"], "left_semi").select("id").distinct()
        fine = _buckets(texts.join(crowd, "id", "left_semi").select("id", "text").mapInArrow(_fine_rows(shingle), f"band bigint, id {kind}"), "buckets")
        apart = _labelled(_labelled(_star(fine), comps, "a", "ca"), comps, "b", "cb").where("ca <> cb").select("a", "b").join(star, ["a", "b"], "left_anti")
        comps = joined(comps, verify(likely(apart)))
        sweeps.append(_sweep_rows(*_mixed(fine, comps, nodes)))
    rows = sweeps[0] if len(sweeps) == 1 else sweeps[0].unionByName(sweeps[1])
    found = rows.join(texts, "id").groupBy("band", "x", "y").applyInArrow(_sweep(shingle, threshold, arrow_type(meta, "id")), f"a {kind}, b {kind}")
    found = materialize(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "swept")
    comps = joined(comps, verify(found))

    found = _labelled(member, comps, "rep", "component").select(F.col("id").alias("own"), "component")
    out = meta.select("id", "n").join(found, F.col("id") == F.col("own"), "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _of_node(text: DataFrame, again: DataFrame, shingle: int) -> DataFrame:
    """One text of each id; of those that have several rows (again) the one with the smallest set key, which
    stands for the id."""
    schema = pa.schema([("id", arrow_type(text, "id")), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("text", pa.string())])

    def work(part, data, offs):
        h, more, counts = shingle_sets(data, offs, shingle)
        key = set_keys(h, more, counts)
        return {"id": part.column(0).cast(schema[0].type), "k1": key[:, 0], "k2": key[:, 1], "n": counts, "text": part.column(1)}

    told = text.join(again, "id", "left_semi").select("id", "text").mapInArrow(by_slice(work, schema, "text"), f"id {dict(text.dtypes)['id']}, k1 bigint, k2 bigint, n bigint, text string")
    best = told.where("n > 0").groupBy("id").agg(F.min_by("text", F.struct("k1", "k2", F.xxhash64("text"))).alias("text"))
    return text.join(again, "id", "left_anti").unionByName(best)


def keep(docs: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """The rows of docs whose id is the smallest of its group."""
    gone = near_groups(docs, id_col, **kw).where("id <> component_id").select("id").distinct()
    return packed(docs, id=id_col).join(materialize(gone, "gone"), "id", "left_anti").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = near_groups(table(spark, sf_dir, "documents"), shingle=4, threshold=(80, 100))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def brute(docs: list[tuple], size: int = 4, threshold: tuple[int, int] = (80, 100)) -> list[tuple]:
    """The query's rows from all pairs in plain Python, for tests."""
    sets = []
    for _, text in docs:
        w = bytes(LOWER[np.frombuffer((text or "").encode(), np.uint8)]).split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    comp = list(range(len(docs)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    where: dict = {}
    for i, own in enumerate(sets):
        seen: dict[int, int] = {}
        for x in own:
            for j in where.get(x, ()):
                seen[j] = seen.get(j, 0) + 1
            where.setdefault(x, []).append(i)
        for j, both in seen.items():
            if threshold[1] * both >= threshold[0] * (len(own) + len(sets[j]) - both):
                a, b = root(i), root(j)
                comp[b] = a
    least: dict[int, int] = {}
    for i, (k, _) in enumerate(docs):
        least[root(i)] = min(k, least.get(root(i), k))
    return [(k, len(sets[i]), least[root(i)], k == least[root(i)]) for i, (k, _) in enumerate(docs)]
