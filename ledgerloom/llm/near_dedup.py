"""Near-duplicate classes by circulant MinHash with exact verification.

Method:

1. Texts with equal sets of word shingles form a class; its smallest identifier stands for it.
2. A class is signed with COORDINATES minima from two permutations, one of them circularly
   shifted by one place a coordinate, and filed under one key a band. At the least similarity that
   counts (0.75) a pair shares no band with probability (1 - 0.75^4)^32 = 5e-6.
3. In each bucket all members whose sizes allow a link are verified against its smallest one, on
   full sets. The links found join classes into components.
4. Buckets whose other members still are of several components are compared in full (the smallest one
   has met them all): members of the component that most of them belong to against all others, and the
   others among each other. Both are cut into
   blocks of bounded rows and bytes, each pair of blocks is one group, and a group yields at most one
   link for each component it holds, never its pairs. Counts of common shingles are exact (a product
   of 0/1 matrices over the shingles that occur twice). A large group of near copies and few
   strangers thus costs its members times the blocks of strangers; only a bucket of many components
   of like size is quadratic in its blocks.

Texts move only where they are needed: those of classes that share a bucket, to become sets, and those
of rows that go or repeat each other, to be told from the ones that a filter (``among``) takes for them.

So no candidate is left out, and neither a bucket nor a group of copies meets in one task: members
join their pivot's set by shares, and keys with a thousandth of all rows, of which there are at most
a thousand or so, are joined from a broadcast of HOT_KEYS rows.

Defined results: texts without words (null, empty, blank) have no shingles and link with nothing;
fewer than SHINGLE_WORDS words are one shingle; rows with a null doc_id are linked like any other and
carry the smallest id of their component, null where it has none, and of such a component one class is
kept; rows that repeat a doc_id with the same text share
its component, and with different texts each row follows its own text; other columns are ignored by
``resolve`` and pass through ``drop_near_copies``, which drops rows by doc_id and text (texts are told
apart by 64-bit hashes within a doc_id); an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, sized_slices, texts_of

SHINGLE_WORDS = 5
#: Links: LINK_PERCENT of the union's size at least is common.
LINK_PERCENT = 75
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
#: Members and shingles of a block, about; a group of the full comparison holds two blocks at most.
BLOCK_MEMBERS = 512
BLOCK_SHINGLES = 1 << 20
#: Members of a share, where a bucket's members are joined to one row of the bucket.
SHARE_MEMBERS = 128
#: A join's key of more rows than this, and than the HOT_KEYS-th part of all, is hot; so there are at most HOT_KEYS.
HOT_ROWS = 16_384
HOT_KEYS = 1024
#: Bits of a filter for each of its keys, about, and at most in all (8 MB, in maps of MAP_BITS each, as Spark builds them).
KEY_BITS = 16
FILTER_BITS = 1 << 26
MAP_BITS = 1 << 15
#: Bytes of texts or sets that a task works on at a time.
STEP_BYTES = 1 << 20
#: Shares into which a class's members are dealt for the way back to documents.
SHARES = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix64(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(1 << n.bit_length(), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles; a text of fewer words is one shingle, one without words has none."""
    worded = [t.encode().lower().split() for t in texts]
    whole = b" ".join(b" ".join(w) for w in worded if w)
    raw = np.frombuffer(whole, np.uint8)
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    gaps = np.flatnonzero(raw == 32)
    begins, ends = np.append(0, gaps + 1), np.append(gaps, len(raw))
    out, at = [], 0
    for words in worded:
        n = len(words)
        if n:
            last = at + max(n - SHINGLE_WORDS, 0) + 1
            first = begins[at:last]
            hashes = _mix64((sums[ends[at + min(n, SHINGLE_WORDS) - 1 : at + n]] - sums[first]) * down[first])
            hashes.sort()
            out.append(hashes[np.append(True, hashes[1:] != hashes[:-1])])
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """COORDINATES minima of each non-empty set: one permutation places the shingles on a circle, a second, shifted by one place a coordinate, ranks them."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    places = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), COORDINATES), np.uint32)
    rank, shifted = np.empty_like(places), np.empty_like(places)
    for k in range(COORDINATES):
        np.subtract(places, np.uint32(k), out=rank)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            np.right_shift(rank, np.uint32(shift), out=shifted)
            np.bitwise_xor(rank, shifted, out=rank)
            np.multiply(rank, np.uint32(factor), out=rank)
        np.right_shift(rank, np.uint32(16), out=shifted)
        np.bitwise_xor(rank, shifted, out=rank)
        out[:, k] = np.minimum.reduceat(rank, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, bands told apart."""
    grouped = signature.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), grouped.shape[:2])
    for k in range(ROWS):
        key = _mix64(key * _BASE + grouped[:, :, k])
    return key.view(np.int64)


def _set_hash(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles, digest_size=16).digest()


def features(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_hash (null without shingles) and bands, one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, STEP_BYTES):
            sets = shingle_sets(texts_of(batch))
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(signatures(full)).tolist() if full else [])
            yield pa.record_batch(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("text_hash"),
                    pa.array(map(len, sets), pa.int64()),
                    pa.array([_set_hash(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_hash", "n_shingles", "set_hash", "bands"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_hash binary, bands array<long>")


def _key(text_hash: Column) -> Column:
    """A number of doc_id and text; a null doc_id does not count."""
    return F.xxhash64(F.col("doc_id").cast("long"), text_hash)


def among(rows: DataFrame, keys: DataFrame, key: str, n: int) -> DataFrame:
    """rows with ``maybe``: false only where their key (hashed, long) is none of the n keys; a larger filter is right more often.

    The filter is one broadcast of at most FILTER_BITS, so rows do not move. A join must follow for the rows it lets pass.
    """
    bits = max(MAP_BITS, min(FILTER_BITS, 1 << (KEY_BITS * n).bit_length()))
    place = F.pmod(F.col(key), F.lit(bits))
    spot = [F.floor(place / MAP_BITS).cast("int").alias("map"), F.pmod(place, F.lit(MAP_BITS)).cast("int").alias("bit")]
    # Dealt by map first, or each task would send every map.
    maps = keys.select(*spot).repartition("map").groupBy("map").agg(F.bitmap_construct_agg(F.col("bit").cast("long")).alias("bitmap"))
    byte = F.conv(F.hex(F.substr("bitmap", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, F.pmod("bit", F.lit(8))) == 1
    return rows.select("*", *spot).join(F.broadcast(maps), "map", "left").select(*rows.columns, F.coalesce(hit, F.lit(False)).alias("maybe"))


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and shingles (64-bit hashes) of the wanted classes (id, doc_id, text_hash), from one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, STEP_BYTES):
            yield pa.record_batch([batch.column("id"), pa.array([s.tobytes() for s in shingle_sets(texts_of(batch))], pa.binary())], names=["id", "shingles"])

    wanted = cut(wanted.select("id", "text_hash", _key(F.col("text_hash")).alias("key")))
    texts = docs.select(_key(F.xxhash64("text")).alias("key"), F.xxhash64("text").alias("text_hash"), "text")
    held = among(texts, wanted, "key", wanted.count()).where("maybe").groupBy("key", "text_hash").agg(F.first("text").alias("text"))
    return held.join(wanted.hint("shuffle_hash"), ["key", "text_hash"]).select("id", "text").mapInArrow(run, "id long, shingles binary")


def _verified(pairs: DataFrame) -> DataFrame:
    """a, b of the pairs (a, b, one, other) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, STEP_BYTES, "one", "other"):
            fine = []
            for one, other in zip(batch.column("one").to_pylist(), batch.column("other").to_pylist(), strict=True):
                x, y = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                fine.append(100 * common >= LINK_PERCENT * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    return pairs.select("a", "b", "one", "other").mapInArrow(run, "a long, b long")


def joined(rows: DataFrame, keyed: DataFrame, key: str, members: str, total: int) -> DataFrame:
    """rows with the row that keyed has for each key. members: how many rows have the key; total: of how many in all.

    Hot keys' rows are joined from a broadcast of at most HOT_KEYS rows, the others by shuffle.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    if total <= limit:
        return rows.join(keyed, key)
    hot = cut(keyed.where(F.col(members) > limit))
    if hot.isEmpty():
        return rows.join(keyed, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed.where(F.col(members) <= limit), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) for every id of the edges (a, b): alternating large and small stars until nothing changes."""
    edges = cut(edges.select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).where("big <> small").distinct())
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("big", "small"))).first()
        if state == before:
            return edges.select(F.col("big").alias("id"), F.col("small").alias("component")).union(edges.select("small", "small")).distinct()
        before = state
        both = edges.select(F.col("big").alias("u"), F.col("small").alias("v")).union(edges.select("small", "big"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
        large = joined(both.where("v > u"), least, "u", "degree", 2 * state[0]).select(F.col("v").alias("big"), F.col("m").alias("small")).distinct()
        root = large.groupBy("big").agg(F.min("small").alias("root"), F.count(F.lit(1)).alias("degree"))
        small = joined(large, root, "big", "degree", 2 * state[0])
        edges = cut(small.select(F.explode(F.array(F.struct("big", F.col("root").alias("small")), F.struct(F.col("small").alias("big"), F.col("root").alias("small")))).alias("e")).select("e.*").where("big <> small").distinct())


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as the product of 0/1 matrices over shingles that occur twice, some columns at a time."""
    sizes = [len(s) for s in sets]
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(sets)), sizes), count[column] > 1
    number = np.cumsum(count > 1) - 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out, step = np.zeros((len(sets), len(sets)), np.float32), 4096
    for at in range(0, int((count > 1).sum()), step):
        low, high = np.searchsorted(column, [at, at + step])
        some = np.zeros((len(sets), step), np.float32)
        some[row[low:high], column[low:high] - at] = 1
        out += some @ some.T
    return out


def _block_links(group: pa.Table) -> pa.Table:
    """Links between different components of a group, one for each that a link joins to others at most."""
    label = group.column("component").to_pylist()
    sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
    sizes = np.array([len(s) for s in sets], np.float64)
    common = common_counts(sets).astype(np.float64)
    _, own = np.unique(label, return_inverse=True)
    linked = (100 * common >= LINK_PERCENT * (sizes[:, None] + sizes[None, :] - common)) & (own[:, None] < own[None, :])
    root = {x: x for x in label}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*(k.tolist() for k in np.nonzero(linked))):
        a, b = find(label[i]), find(label[j])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((a, b))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _alike(one: Column, other: Column) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(one, other) >= LINK_PERCENT * F.greatest(one, other)


def _star_links(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links of members to their buckets' smallest one. A pivot's set goes once to each share of its members."""
    star = buckets.where("id <> pivot").where(_alike(F.col("n"), F.col("pivot_n"))).groupBy(F.col("pivot").alias("a"), F.col("id").alias("b")).agg(F.max("members").alias("members"))
    dealt = star.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("members") / SHARE_MEMBERS)).alias("share"))
    pivots = dealt.select("a", "share").distinct().join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("one")), "a")
    members = dealt.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("other")), "b")
    return _verified(members.join(pivots, ["a", "share"]))


def _in_blocks(labelled: DataFrame) -> DataFrame:
    """band, id, component and group (kind, i, j) of the members (band, id, n, component) of buckets that hold several components; one row for each group that a member is compared in.

    The component with most members of a bucket is its major one. Groups of kind 0 hold a block of
    the major one and a block of the others, groups of kind 1 two blocks of the others.
    """
    parts = labelled.groupBy("band", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles"))
    blocks = lambda m, shingles: F.greatest(F.ceil(m / BLOCK_MEMBERS), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")
    first = F.max_by(F.struct("component", "m", "shingles"), F.struct("m", F.col("component")))
    mixed = parts.groupBy("band").agg(F.count(F.lit(1)).alias("k"), first.alias("major"), F.sum("m").alias("m"), F.sum("shingles").alias("shingles")).where("k > 1")
    shaped = mixed.select("band", F.col("major.component").alias("major"), blocks(F.col("major.m"), F.col("major.shingles")).alias("ours"), blocks(F.col("m") - F.col("major.m"), F.col("shingles") - F.col("major.shingles")).alias("others"), F.ceil(F.col("m") / SHARE_MEMBERS).cast("int").alias("shares"))
    # A large bucket's members are dealt out for this join: each share meets a copy of the bucket's row.
    wanted = shaped.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    dealt = labelled.withColumn("share", F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("members") / SHARE_MEMBERS)).cast("int")).join(wanted, ["band", "share"])
    major, own = F.col("component") == F.col("major"), lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    group = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    against = F.when(major, F.transform(upto("others"), lambda j: group(0, own("ours"), j))).otherwise(
        F.concat(F.transform(upto("ours"), lambda i: group(0, i, own("others"))), F.transform(upto("others"), lambda j: group(1, F.least(j, own("others")), F.greatest(j, own("others")))))
    )
    return dealt.select("band", "id", "component", F.explode(against).alias("g")).select("band", "id", "component", "g.*")


def link(docs: DataFrame, classes: DataFrame, places: DataFrame) -> DataFrame:
    """id, component of those classes (id, n, bands) that have a link, from the texts of docs; places (id, doc_id, text_hash) tells where a class's text is."""
    filed = classes.select("id", "n", F.explode("bands").alias("band"))
    members = lambda bands: bands.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    # Most bands hold one class; only a count moves for them, and the rows of the others are few.
    shared = cut(filed.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    filed = cut(joined(among(filed, shared, "band", shared.count()).where("maybe").drop("maybe"), shared, "band", "members", members(shared)).drop("members"))
    shape = filed.groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("id", "n")).alias("least"), F.bit_xor(F.xxhash64("id")).alias("content"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("total"))
    # Bands that hold the same classes count once.
    kept = cut(shape.groupBy("members", "least", "content", "total").agg(F.min("band").alias("band")).select("band", F.col("least.id").alias("pivot"), F.col("least.n").alias("pivot_n"), "members"))
    buckets = cut(joined(filed, kept, "band", "members", members(kept)))
    sets = cut(_sets_of(docs, places.join(buckets.select("id").distinct(), "id", "left_semi")))

    first = components(_star_links(buckets, sets))
    # The stars have compared all with the pivot.
    others = buckets.where("id <> pivot AND members > 2").withColumn("members", F.col("members") - 1)
    labelled = cut(others.join(first, "id", "left").select("band", "id", "n", "members", F.coalesce("component", "id").alias("component")))
    second = components(_in_blocks(labelled).join(sets, "id").groupBy("band", "kind", "i", "j").applyInArrow(_block_links, "a long, b long"))
    # Components of the second round are made of those of the first.
    merged = first.join(second.withColumnRenamed("component", "outer").withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("outer", "component").alias("component"))
    return merged.union(second.join(first.select("id"), "id", "left_anti"))


def _decided(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and kept; one row a document."""
    marked = cut(features(docs).withColumn("share", F.pmod(F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id())), F.lit(SHARES))))
    worded = marked.where("set_hash IS NOT NULL")
    leaves = worded.groupBy("set_hash", "share").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")).alias("least"))
    classes = cut(leaves.groupBy("set_hash").agg(F.min("least").alias("least")).select("set_hash", "least.doc_id", "least.text_hash"))
    # Classes of one doc_id (rows that repeat it with other texts) and classes without one are told apart by their sets.
    repeated = cut(classes.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("again")))
    nameless = not classes.where("doc_id IS NULL").isEmpty()
    unique = repeated.isEmpty() and not nameless
    if unique:
        classes = classes.withColumn("id", F.col("doc_id"))
    else:
        own = F.col("doc_id").isNull() | F.coalesce("again", F.lit(False))
        classes = cut(classes.join(repeated, "doc_id", "left").select("set_hash", "doc_id", "text_hash", F.when(own, F.xxhash64("set_hash")).otherwise(F.col("doc_id")).alias("id")))
    signature = [F.first("n_shingles").alias("n"), F.first("bands").alias("bands")]
    named = worded.join(classes.select("id", "doc_id", "set_hash"), ["doc_id", "set_hash"])
    signed = named.groupBy("doc_id", "set_hash").agg(F.first("id").alias("id"), *signature).select("id", "n", "bands")
    if nameless:
        once = worded.where("doc_id IS NULL").groupBy("set_hash").agg(*signature)
        signed = signed.union(once.join(classes.where("doc_id IS NULL").select("id", "set_hash"), "set_hash").select("id", "n", "bands"))
    linked = link(docs, cut(signed), classes.select("id", "doc_id", "text_hash"))
    known = classes.join(linked, "id", "left").select("set_hash", "doc_id", "id", F.coalesce("component", "id").alias("component_id"), F.lit(False).alias("heads"))
    if not unique:
        least = known.groupBy("component_id").agg(F.min("doc_id").alias("least_id"), F.min("id").alias("head")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        dealt = known.withColumn("share", F.pmod(F.xxhash64("set_hash"), F.lit(SHARES)).cast("int"))
        known = dealt.join(least, ["component_id", "share"], "left").select("set_hash", F.col("least_id").alias("component_id"), (F.col("least_id").isNull() & (F.col("id") == F.col("head"))).alias("heads"))
    below = leaves.select("set_hash", "share").join(known.select("set_hash", "component_id", "heads"), "set_hash")
    out = marked.join(below, ["set_hash", "share"], "left").withColumn("component_id", F.when(F.col("set_hash").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    # Without any id in its component, a row stays if its class heads it, or if it has no words.
    kept = F.when(F.col("component_id").isNull(), F.col("set_hash").isNull() | F.col("heads")).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out.select("doc_id", "text_hash", "n_shingles", "component_id", kept.alias("kept"))


def resolve(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept; one row a document."""
    return _decided(docs).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns: of each group of linked documents the one with the smallest id. Decided without texts; only rows that may go or repeat both id and text move, to meet the decision, and only the latter meet each other, after each task has kept one of them."""
    some = cut(_decided(docs).groupBy("doc_id", "text_hash").agg(F.count_if("kept").alias("rows")).where("rows <> 1").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "rows", _key(F.col("text_hash")).alias("key")))
    text_hash = F.xxhash64("text")
    tested = among(docs.select("doc_id", text_hash.alias("text_hash"), _key(text_hash).alias("key"), F.struct("*").alias("row")), some, "key", some.count())

    def met(rows: DataFrame, how: str) -> DataFrame:
        moved = tested.where("maybe")
        return moved.join(rows.drop("key").hint("shuffle_hash"), moved["doc_id"].eqNullSafe(rows["id"]) & (moved["text_hash"] == rows["hash"]), how)

    out = tested.where("NOT maybe").unionByName(met(some, "left_anti"))
    repeated = some.where("rows > 1")
    if not repeated.isEmpty():
        out = out.unionByName(met(repeated, "left_semi").dropDuplicates(["doc_id", "text_hash"]))
    return out.select("row.*")
