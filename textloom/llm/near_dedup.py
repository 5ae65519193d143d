"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

Two documents with similarity s differ in a binomial(K, 1-s) number of signature places. The distance
threshold T is set so that a pair at the similarity threshold exceeds it with probability MISS at
most. Signatures are split into m = T // (r+1) + 1 chunks, so that of T differences some chunk has r
at most: each chunk is indexed under every choice of its places without r of them (ERRORS = 1: a key
for each place, which its chunk leaves out), and all pairs within T share a key. What follows is exact:

1. Equal sets become one representative.
2. Of each bucket (the representatives of a key) the member that meets most others leads; leader and
   members within T compare full shingle sets. So a family of near copies takes a comparison for each
   copy and not for each pair, and a page that all of them come from is found as their leader.
3. Members of a bucket that are within T and still in different components form clusters, with fewer
   links than members; a cluster compares full sets through inverted lists.

Components of all links are the groups. A leader with very many members is dealt to many tasks.
Buckets and clusters of very many members that no leader links are dealt out as pairs of blocks, as
all their pairs have to be compared.
"""

from __future__ import annotations

import struct
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, heavy, in_batches, keyed, only, ranges, salted, salted_join, saved, slices, text_buffer
from .components import Sets, components
from .minhash import shingle_hashes, signatures
from .winnow import mix

PLACES, BITS, MISS, ERRORS = 80, 16, 1e-6, 1
#: Members of a bucket, documents of a cluster and its shingles that one task compares at most; half of it is a block.
BUCKET, CLUSTER, CLUSTER_SHINGLES = 2048, 256, 500_000


def distance_threshold(similarity: float, places: int = PLACES, miss: float = MISS) -> int:
    """Least T with P(binomial(places, 1 - similarity) > T) <= miss."""
    p, tail, t = 1 - similarity, 0.0, places
    while t > 0:
        tail += comb(places, t) * p**t * (1 - p) ** (places - t)
        if tail > miss:
            return t
        t -= 1
    return 0


def chunk_keys(sigs: np.ndarray, threshold: int, errors: int = 0) -> np.ndarray:
    """Keys (documents x keys): pairs within threshold share one at least."""
    n, places = sigs.shape
    m = threshold // (errors + 1) + 1
    bounds = np.linspace(0, places, m + 1).astype(int)
    out = []
    for c in range(m):
        own = range(bounds[c], bounds[c + 1])
        for i, kept in enumerate(combinations(own, max(1, len(own) - errors))):
            key = np.full(n, c * 1000 + i + 1, np.uint64)
            for place in kept:
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sigs[:, place])
            out.append(key)
    return np.stack(out, axis=1).view(np.int64) if n else np.zeros((0, len(out)), np.int64)


def bucket_links(sigs: np.ndarray, group: np.ndarray, sizes: np.ndarray, threshold: int, percent: int) -> list[tuple[int, int]]:
    """Links among rows, fewer than rows, that join all pairs of different groups within threshold whose sets' sizes allow the similarity."""
    sets, links = Sets(len(sigs)), []
    for i in range(len(sigs) - 1):
        rest = np.flatnonzero(group[i + 1 :] != group[i]) + i + 1
        a, b = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
        rest = rest[100 * a >= percent * b]
        for j in rest[(sigs[rest] != sigs[i]).sum(axis=1) <= threshold].tolist():
            if sets.join(i, j):
                links.append((i, j))
    return links


def set_links(shingles: np.ndarray, offsets: np.ndarray, group: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join all sets of different groups with 100 * intersection >= percent * union; sets are sorted and distinct."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    _, term = np.unique(shingles, return_inverse=True)
    doc = np.repeat(np.arange(n), sizes)
    order = np.argsort(term, kind="stable")
    posting, bounds = doc[order], np.concatenate([[0], np.cumsum(np.bincount(term))])
    sets, links = Sets(n), []
    for i in range(n):
        own = term[offsets[i] : offsets[i + 1]]
        lengths = bounds[own + 1] - bounds[own]
        own, lengths = own[lengths > 1], lengths[lengths > 1]
        if 100 * len(own) < percent * sizes[i]:
            continue  # too few of its shingles stand in any other
        both = np.bincount(posting[ranges(bounds[own], lengths)], minlength=n)
        for j in np.flatnonzero((100 * both >= percent * (sizes[i] + sizes - both)) & (group != group[i])).tolist():
            if sets.join(i, j):
                links.append((i, j))
    return links


def described(rows: DataFrame, size: int, places: int = PLACES, bits: int = BITS) -> DataFrame:
    """(key, doc_id, n_shingles, set, sig): size of the set, its name (two 64-bit hashes and the size), and its signature."""

    def run(batches):
        for batch in batches:
            data, off = text_buffer(batch.column(2))
            for a, b in slices(off, 1 << 20):
                hashes, bounds = shingle_hashes(data[off[a] : off[b]], off[a : b + 1] - off[a], size)
                sigs = signatures(hashes, bounds, places, bits)
                sets = [np.unique(hashes[s:e]) for s, e in zip(bounds[:-1], bounds[1:])]
                names = [struct.pack("<QQQ", int(mix(x + np.uint64(1)).sum(dtype=np.uint64)), int(mix(x + _SALT).sum(dtype=np.uint64)), len(x)) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(x) for x in sets], pa.int64()), pa.array(names, pa.binary()), pa.array([x.tobytes() for x in sigs], pa.binary())],
                    ["key", "doc_id", "n_shingles", "set", "sig"],
                )

    return in_batches(rows.select("key", "doc_id", "text"), run, "key long, doc_id long, n_shingles long, set binary, sig binary")


_SALT = np.uint64(0x5851F42D4C957F2D)


def _shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """(key, data): the sorted distinct shingle hashes of each document."""

    def run(batches):
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            for a, b in slices(off, 1 << 20):
                hashes, bounds = shingle_hashes(data[off[a] : off[b]], off[a : b + 1] - off[a], size)
                sets = [np.unique(hashes[s:e]).tobytes() for s, e in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], ["key", "data"])

    return in_batches(rows.select("key", "text"), run, "key long, data binary")


def _blocks(df: DataFrame, count: str) -> DataFrame:
    """Deal rows of a group in ``count`` blocks out to all pairs of its blocks (columns lo, hi)."""
    block = F.pmod(F.xxhash64("key"), F.col(count)).cast("long")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    return df.withColumn("_b", block).withColumn("_o", other).withColumn("lo", F.least("_b", "_o")).withColumn("hi", F.greatest("_b", "_o")).drop("_b", "_o", count)


def runs(batches, names: tuple[str, ...]):
    """(first row of its group?, slice) of batches that are sorted by names, in order; a group may come in several slices."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1)
        cut = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
        bounds = [0, *cut.tolist(), len(ids)]
        for s, e in zip(bounds[:-1], bounds[1:]):
            yield tuple(ids[s]) != last, batch.slice(s, e - s)
            last = tuple(ids[s])


def _groups(batches, names: tuple[str, ...]):
    """Whole groups of rows that are sorted by names, as lists of batches."""
    held: list[pa.RecordBatch] = []
    for first, part in runs(batches, names):
        if first and held:
            yield held
            held = []
        held.append(part)
    if held:
        yield held


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def meet(pairs: DataFrame, things: DataFrame, test, parts: int) -> DataFrame:
    """Pairs (u, v) for which test(data of u, offsets and data of several v) holds; things has a row (key, data) for each.

    The data of u stand first in their task, and those of its v stream past; u with very many v is dealt to many tasks.
    """
    hot = heavy(pairs, "u")
    dealt = salted(pairs, "u", hot, "v")
    lead = dealt.select("u", "_salt").distinct().join(things, F.col("u") == F.col("key")).select("u", "_salt", F.lit(0).alias("kind"), F.col("u").alias("v"), "data")
    rest = dealt.join(things, F.col("v") == F.col("key")).select("u", "_salt", F.lit(1).alias("kind"), "v", "data")
    order = ("u", "_salt")

    def run(batches):
        held = None
        for _, part in runs(batches, (*order, "kind")):
            data, off = text_buffer(part.column("data"))
            if part.column("kind")[0].as_py() == 0:
                held = data
                continue
            hit = np.flatnonzero(test(held, data, off))
            if len(hit):
                yield part.select(["u", "v"]).take(pa.array(hit))

    return in_batches(lead.unionByName(rest).repartition(parts, *order).sortWithinPartitions(*order, "kind", "v"), run, "u long, v long")


def near_components(rows: DataFrame, size: int, percent: int, places: int = PLACES, bits: int = BITS, errors: int = ERRORS, bucket: int = BUCKET, cluster: int = CLUSTER) -> DataFrame:
    """(key, doc_id, n_shingles, component) of keyed documents; component is the least key linked, directly or not."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    threshold = distance_threshold(percent / 100, places)
    docs = saved(described(rows, size, places, bits), "signatures")
    some = docs.where("n_shingles > 0")
    reps = saved(some.groupBy("set").agg(F.min(F.struct("key", "n_shingles", "sig")).alias("rep")).select("set", "rep.*"), "representatives")
    width = np.uint16 if bits <= 16 else np.uint32

    def keys_of(batches):
        for batch in batches:
            data, _ = text_buffer(batch.column(1))
            keys = chunk_keys(data.view(width).reshape(batch.num_rows, places), threshold, errors)
            own = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(own)], ["bucket", "key"])

    # a bucket holds one key at most of each document, so it is a small share of all keys
    each = in_batches(reps.select("key", "sig"), keys_of, "bucket long, key long")
    shared = saved(each.withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).where("n > 1"), "buckets")
    weight = shared.groupBy("key").agg(F.sum("n").alias("w"))
    leader = F.first("key").over(Window.partitionBy("bucket").orderBy(F.col("w").desc(), "key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    followers = saved(shared.join(weight, "key").select("bucket", "key", leader.alias("leader")).where("key <> leader"), "followers")
    drop_path(spark, shared)

    def within(u, v, off):
        u, v = u.view(width), v.view(width).reshape(-1, places)
        return (u != v).sum(axis=1) <= threshold

    def similar(u, v, off):
        u, v, bounds = u.view(np.uint64), v.view(np.uint64), off // 8
        at = np.minimum(np.searchsorted(u, v), len(u) - 1)
        both = np.add.reduceat((u[at] == v).astype(np.int64), bounds[:-1])
        return 100 * both >= percent * (len(u) + np.diff(bounds) - both)

    led = followers.select(F.col("leader").alias("u"), F.col("key").alias("v")).distinct()
    near = saved(meet(led, reps.select("key", F.col("sig").alias("data")), within, parts), "pairs")
    used = saved(near.select(F.col("u").alias("key")).unionByName(near.select(F.col("v").alias("key"))).distinct(), "met")
    sets_of_led = saved(_shingle_sets(only(rows, used), size), "sets")
    links = saved(meet(near, sets_of_led, similar, parts), "links")
    found = saved(components(links), "components")
    # followers of one bucket in different components have not met
    of = followers.select("bucket", "key").join(found.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    of = saved(of, "followers-in")
    mixed = of.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n")).where("a <> b")
    mixed = mixed.select("bucket", F.expr(f"case when n <= {bucket} then 1L else (n + {bucket // 2 - 1}) div {bucket // 2} end").alias("blocks"))
    left = of.join(mixed, "bucket").join(reps.select("key", "n_shingles", "sig"), "key")
    order = ("bucket", "lo", "hi")

    def link_buckets(batches):
        out: set[tuple[int, int]] = set()
        for group in _groups(batches, order):
            ids, in_, n = (np.concatenate([b.column(c).to_numpy() for b in group]) for c in ("key", "component", "n_shingles"))
            sigs = np.concatenate([text_buffer(b.column("sig"))[0] for b in group]).view(width).reshape(len(ids), places)
            out.update((int(ids[a]), int(ids[b])) for a, b in bucket_links(sigs, in_, n, threshold, percent))
            if len(out) > 50_000:
                yield _pairs(list(out))
                out = set()
        if out:
            yield _pairs(list(out))

    dealt = _blocks(left, "blocks").select(*order, "key", "component", "n_shingles", "sig").repartition(parts, *order).sortWithinPartitions(*order, "key")
    clusters = components(in_batches(dealt, link_buckets, "u long, v long"))
    clusters = saved(clusters.select(F.col("node").alias("key"), F.col("component").alias("cluster")).join(reps.select("key", "n_shingles"), "key"), "clusters")
    over = F.greatest(F.ceil(F.count("*") / cluster), F.ceil(F.sum("n_shingles") / CLUSTER_SHINGLES))
    held = clusters.groupBy("cluster").agg(over.alias("over")).select("cluster", F.expr("case when over <= 1 then 1L else 2 * over end").alias("blocks"))
    placed = salted_join(clusters.select("cluster", "key"), held, "cluster", "key").join(found.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    sets = _shingle_sets(only(rows, clusters.select("key")), size)
    dealt = _blocks(sets.join(placed, "key"), "blocks")
    order = ("cluster", "lo", "hi")

    def link_clusters(batches):
        for group in _groups(batches, ("cluster", "lo", "hi")):
            ids, in_ = (np.concatenate([b.column(c).to_numpy() for b in group]) for c in ("key", "component"))
            data, off = text_buffer(pa.concat_arrays([b.column("data") for b in group]))
            links = set_links(data.view(np.uint64), off // 8, in_, percent)
            if links:
                yield _pairs([(int(ids[a]), int(ids[b])) for a, b in links])

    more = saved(in_batches(dealt.select(*order, "key", "component", "data").repartition(parts, *order).sortWithinPartitions(*order, "key"), link_clusters, "u long, v long"), "links")
    if more.limit(1).count():
        found = saved(components(links.unionByName(more)), "components")
    for old in (followers, of, near, used, sets_of_led):
        drop_path(spark, old)
    of_rep = reps.join(found.select(F.col("node").alias("key"), "component"), "key", "left").select("set", F.coalesce("component", "key").alias("component"))
    columns = ("key", "doc_id", "n_shingles", "component")
    alone = docs.where("n_shingles = 0").withColumn("component", F.col("key")).select(*columns)
    return salted_join(some.select("set", "key", "doc_id", "n_shingles"), of_rep, "set", "key").select(*columns).unionByName(alone)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): groups of documents linked by 100 * intersection >= percent * union.

    Sets are distinct shingles of ``size`` words in lower case (A-Z); a text of fewer words is one
    shingle; a null text or one without words has none and stays alone. component_id is the smallest doc_id of
    the group, kept says that doc_id is component_id. Rows that share a doc_id are compared as
    documents of their own; null doc_ids come last and a group of them alone has a null id; an
    empty table gives an empty result; other columns play no part. A pair at the threshold itself is
    missed with a probability of MISS at most, one that is more similar with less.
    """
    found = saved(near_components(keyed(docs), size, percent, **options), "near-groups")
    # the least key of a group is that of its least doc_id
    ids = found.where("key = component").select("component", F.col("doc_id").alias("component_id"))
    return salted_join(found, ids, "component", "key").select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
