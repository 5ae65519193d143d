"""Approximate nearest neighbours: a graph by NN-descent in Spark joins, and greedy search on it.

Equal vectors are one node with a list of ids. Nodes are dealt to shards of about SHARD by the cells of
pivots (k-means on a bounded sample), so that a shard holds near nodes, has its own graph, and all its
vectors fit a task. A round of NN-descent joins the sampled neighbours of each node, and the nodes
that have it as a neighbour, with their neighbour lists: candidates are neighbours of neighbours, as
packed lists of numbers. They meet the shard's vectors, and each node keeps its K nearest.

A query searches the graphs of its own cell greedily. Its k-th distance there then says which other shards
may hold nearer nodes: those with a cell whose pivot, less the cell's radius, is not farther. Routing
thus loses nothing; where vectors have clusters it keeps most shards away, else none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_bounds, drop_path, ranges, salted_join, saved, text_buffer
from .knn_join import SLACK, by_dim, matrix, nearest_pivot, pivots_of

#: Nodes of a shard at most, neighbours kept, neighbours sampled each way in a round, rounds, and parts of a shard that score at a time.
SHARD, K, SAMPLE, ROUNDS, PARTS = 25_000, 24, 12, 8, 4
#: Nodes that a search keeps as candidates, and expands at a time; queries that share a copy of a shard, about.
BEAM, STEP, ASKED = 200, 16, 1024
#: Pivots at most; cells beyond SHARD nodes have several shards.
PIVOTS = 2048
#: Ids of equal vectors that can matter to a search: its k nearest may all be copies, one of them the query.
COPIES = 101


@dataclass
class Places:
    """Where nodes are: pivots of each dimension, radii of their cells, and shards (number, cells) of each dimension."""

    centres: dict[int, np.ndarray]
    radius: dict[int, np.ndarray]
    shards: dict[int, list[tuple[int, list[int]]]]

    def home(self, d: int, v: np.ndarray):
        """(shard, rows) of the shards of each vector's own cell, among cells that have nodes."""
        full = np.flatnonzero(self.radius[d] >= 0)
        cell = full[nearest_pivot(v, self.centres[d][full])[0]]
        for shard, cells in self.shards[d]:
            at = np.flatnonzero(np.isin(cell, cells))
            if len(at):
                yield shard, at

    def others(self, d: int, v: np.ndarray, reach: np.ndarray):
        """(shard, rows) of shards that may hold nodes within reach of each vector, and are not its home."""
        at_home = {shard: at for shard, at in self.home(d, v)}
        far = np.stack([np.sqrt(((v - p) ** 2).sum(axis=1)) for p in self.centres[d]], axis=1)
        may = ~(far * (1 - SLACK) - np.maximum(self.radius[d], 0) > reach[:, None] * (1 + SLACK))
        for shard, cells in self.shards[d]:
            want = may[:, cells].any(axis=1)
            want[at_home.get(shard, [])] = False
            if want.any():
                yield shard, np.flatnonzero(want)


@dataclass
class Index:
    nodes: DataFrame
    graph: DataFrame
    places: Places


def _centred(v: np.ndarray) -> np.ndarray:
    """Vectors of a shard in single precision, moved and scaled so that what tells them apart is kept."""
    v = v - v.mean(axis=0)
    return (v / max(np.abs(v).max(initial=0), 1e-300)).astype(np.float32)


def _shards(counts: dict[tuple[int, int], int], centres: dict[int, np.ndarray], shard: int) -> tuple[dict[int, list], dict[tuple[int, int], tuple[int, int]]]:
    """Shards of each dimension, and (first shard, how many) of each cell: near cells together up to ``shard`` nodes, larger cells split."""
    shards: dict[int, list] = {}
    of: dict[tuple[int, int], tuple[int, int]] = {}
    number = 0
    for d in sorted({d for d, _ in counts}):
        shards[d], left = [], sorted(c for x, c in counts if x == d)
        here, n = left[0], shard + 1
        while left:
            here = left.pop(int(((centres[d][left] - centres[d][here]) ** 2).sum(axis=1).argmin()))
            size = counts[d, here]
            parts = -(-size // shard)
            if parts > 1 or n + size > shard:
                of[d, here] = (number, parts)
                shards[d] += [(number + i, [here]) for i in range(parts)]
                number, n = number + parts, size if parts == 1 else shard + 1
            else:
                of[d, here] = (number - 1, 1)
                shards[d][-1][1].append(here)
                n += size
    return shards, of


def _nodes(rows: DataFrame, shard: int) -> tuple[DataFrame, Places]:
    """(shard, node, v binary of doubles, ids): distinct vectors, numbered within their shard, and where they are."""
    spark = rows.sparkSession
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    kept = rows.select("id", "v").distinct().withColumn("r", rank).where(F.col("r") <= COPIES)
    distinct = kept.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = saved(distinct.withColumn("dim", F.size("v")), "nn-distinct")
    n = distinct.count()
    centres = pivots_of(distinct, n, min(PIVOTS, max(1, 4 * (n // shard))))
    sent = spark.sparkContext.broadcast(centres)  # of bounded size

    def cell_of(batches):
        for batch in batches:
            for d, at in by_dim(batch, 2):
                v = matrix(batch.column(0).take(pa.array(at)))
                cell, e = nearest_pivot(v, sent.value.get(d, np.zeros((1, d))))
                packed = pa.array([x.tobytes() for x in v], pa.binary())
                yield pa.RecordBatch.from_arrays([packed, batch.column(1).take(pa.array(at)), pa.array(np.full(len(at), d), pa.int32()), pa.array(cell, pa.int32()), pa.array(np.where(np.isnan(e), np.inf, e))], ["v", "ids", "dim", "cell", "e"])

    placed = saved(distinct.select("v", "ids", "dim").mapInArrow(cell_of, "v binary, ids array<long>, dim int, cell int, e double"), "nn-cells")
    drop_path(spark, distinct)
    cells = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("e").alias("e")).collect()  # a row for each pivot
    for d in {r.dim for r in cells}:
        centres.setdefault(d, np.zeros((1, d)))
    shards, of = _shards({(r.dim, r.cell): r.n for r in cells}, centres, shard)
    radius = {d: np.full(len(p), -1.0) for d, p in centres.items()}
    for r in cells:
        radius[r.dim][r.cell] = r.e
    if not cells:
        return placed.select(F.lit(0).alias("shard"), F.lit(0).alias("node"), "v", "ids"), Places(centres, radius, shards)
    deal = spark.createDataFrame([(d, c, first, parts) for (d, c), (first, parts) in of.items()], "dim int, cell int, first int, parts int")
    number_ = F.col("first") + F.pmod(F.xxhash64(F.col("ids")[0]), F.col("parts")).cast("int")
    dealt = placed.join(F.broadcast(deal), ["dim", "cell"]).select(number_.alias("shard"), "v", "ids")

    def number(batches):
        last, at = None, 0
        for batch in batches:
            out = []
            for x in batch.column(0).to_pylist():
                at = at + 1 if x == last else 0
                last = x
                out.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int32()), batch.column(1), batch.column(2)], ["shard", "node", "v", "ids"])

    rows = dealt.repartition("shard").sortWithinPartitions("shard", F.col("ids")[0])
    nodes = saved(rows.mapInArrow(number, "shard int, node int, v binary, ids array<long>"), "nn-nodes")
    drop_path(spark, placed)
    return nodes, Places(centres, radius, shards)


def nearest(vectors: np.ndarray, own: np.ndarray, candidates: list[np.ndarray], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The k nearest of each node's candidates, and their squared distances."""
    out = []
    for u, c in zip(own.tolist(), candidates):
        c = np.unique(c)
        c = c[c != u]
        d = vectors[c] - vectors[u]
        d = np.einsum("ij,ij->i", d, d)
        if len(c) > k:
            o = np.argpartition(d, k)[:k]
            c, d = c[o], d[o]
        o = np.lexsort((c, d))
        out.append((c[o].astype(np.int32), d[o]))
    return out


def _score(nodes: DataFrame, candidates: DataFrame, k: int, parts: int) -> DataFrame:
    """(shard, node, near, fresh): candidates (shard, node, near, old) of a node meet the vectors of its shard.

    Lists flagged old are the node's own; neighbours that aren't among them are fresh.
    """
    vectors = nodes.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), "node", F.col("v").alias("data"), F.lit(False).alias("old"))
    asked = candidates.select("shard", F.pmod("node", F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "node", F.col("near").alias("data"), "old")
    order = ("shard", "part")

    def run(batches):
        from .near_dedup import _groups

        held: np.ndarray | None = None
        for group in _groups(batches, (*order, "kind")):
            shard, part, kind = (group[0].column(n)[0].as_py() for n in (*order, "kind"))
            if kind == 0:
                held = np.concatenate([text_buffer(b.column("data"))[0] for b in group]).view(np.float64)
                held = _centred(held.reshape(sum(b.num_rows for b in group), -1))
                continue
            node = np.concatenate([b.column("node").to_numpy() for b in group])
            old = np.concatenate([b.column("old").to_numpy(zero_copy_only=False) for b in group])
            lists = [np.frombuffer(x.as_buffer(), np.int32) for b in group for x in b.column("data")]
            cut = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]]))
            own = node[cut[:-1]]
            got = nearest(held, own, [np.concatenate(lists[s:e]) for s, e in zip(cut[:-1], cut[1:])], k)
            known = [np.concatenate([lists[i] for i in range(s, e) if old[i]] or [np.zeros(0, np.int32)]) for s, e in zip(cut[:-1], cut[1:])]
            near = [c.tobytes() for c, _ in got]
            fresh = [(~np.isin(c, o)).tobytes() for (c, _), o in zip(got, known)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), shard), pa.int32()), pa.array(own, pa.int32()), pa.array(near, pa.binary()), pa.array(fresh, pa.binary())], ["shard", "node", "near", "fresh"])

    rows = vectors.unionByName(asked).repartition(*order).sortWithinPartitions(*order, "kind", "node")
    return rows.mapInArrow(run, "shard int, node int, near binary, fresh binary")


def _sampled(graph: DataFrame, sample: int) -> DataFrame:
    """(shard, node, via): up to ``sample`` neighbours of each node, fresh ones first."""

    def run(batches):
        for batch in batches:
            node, via, shard = [], [], []
            for s, u, near, fresh in zip(*(batch.column(i).to_pylist() for i in range(4))):
                c, f = np.frombuffer(near, np.int32), np.frombuffer(fresh, bool)
                c = np.concatenate([c[f], c[~f]])[:sample] if f.any() else c[:0]
                via.append(c)
                node.append(np.full(len(c), u, np.int32))
                shard.append(np.full(len(c), s, np.int32))
            if node:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (shard, node, via)], ["shard", "node", "via"])

    return graph.select("shard", "node", "near", "fresh").mapInArrow(run, "shard int, node int, via int")


def build(rows: DataFrame, k: int = K, sample: int = SAMPLE, rounds: int = ROUNDS, shard: int = SHARD, parts: int = PARTS, still: float = 0.02) -> Index:
    """The index of a table of ``knn_join.vectors``; every distinct vector is a node in it, with its COPIES smallest ids.

    Ends after rounds, or once fewer than ``still`` of all neighbours are new in a round. Without rows it is empty.
    """
    spark = rows.sparkSession
    arrow_bounds(spark)
    nodes, places = _nodes(rows, shard)
    size = nodes.groupBy("shard").agg(F.count("*").alias("n"))

    def start(batches):
        for batch in batches:
            shards, node, n = (batch.column(i).to_numpy() for i in range(3))
            first = [np.random.default_rng((int(s), int(u))).integers(0, m, k, np.int32).tobytes() for s, u, m in zip(shards, node, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(first, pa.binary()), pa.array([False] * len(first))], ["shard", "node", "near", "old"])

    kind = "shard int, node int, near binary, old boolean"
    first = nodes.select("shard", "node").join(size, "shard").select("shard", "node", "n").mapInArrow(start, kind)
    graph = saved(_score(nodes, first, k, parts), "nn-graph")
    for _ in range(rounds):
        ahead = saved(_sampled(graph, sample), "nn-sample")
        back = ahead.select("shard", F.col("via").alias("node"), F.col("node").alias("via"))
        few = Window.partitionBy("shard", "node").orderBy(F.xxhash64("via", "node"))
        back = back.withColumn("r", F.row_number().over(few)).where(F.col("r") <= sample).drop("r")
        lists = graph.select("shard", F.col("node").alias("via"), "near")
        found = ahead.unionByName(back).join(lists, ["shard", "via"]).select("shard", "node", "near", F.lit(False).alias("old"))
        backs = back.groupBy("shard", "node").agg(F.collect_list("via").alias("vias"))  # at most sample each

        def pack(batches):
            for batch in batches:
                data = [np.asarray(x, np.int32).tobytes() for x in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary()), pa.array([False] * len(data))], ["shard", "node", "near", "old"])

        candidates = found.unionByName(backs.mapInArrow(pack, kind)).unionByName(graph.select("shard", "node", "near", F.lit(True).alias("old")))
        old, graph = graph, saved(_score(nodes, candidates, k, parts), "nn-graph")
        for gone in (old, ahead):
            drop_path(spark, gone)
        fresh, total = graph.select(F.sum(F.expr("length(replace(hex(fresh), '00', ''))") / 2), F.sum(F.length("fresh"))).first()
        if not total or fresh < still * total:
            break
    return Index(nodes, graph, places)


def entry_nodes(links: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Nodes to start searches from: some spread evenly, and as many more as it takes for every node to be within two links of one.

    So each component of the graph has an entry, and of tight groups without links between them none is out of reach.
    """
    n = len(bounds) - 1
    spread = np.unique(np.linspace(0, n - 1, min(n, 64)).astype(np.int64))
    near, entries = np.zeros(n, bool), []
    for u in [*spread.tolist(), *range(n)]:
        if near[u] and len(entries) >= len(spread):
            continue
        entries.append(u)
        around = links[bounds[u] : bounds[u + 1]]
        near[u] = True
        near[around] = True
        near[links[ranges(bounds[around], bounds[around + 1] - bounds[around])]] = True
    return np.array(entries, np.int64)


def greedy(vectors: np.ndarray, links: np.ndarray, bounds: np.ndarray, query: np.ndarray, entries: np.ndarray, beam: int, step: int, told: list | None = None) -> np.ndarray:
    """Nodes nearest to query that a best-first search from entries finds, nearest first; told gets the number of nodes looked at."""
    seen = np.zeros(len(vectors), bool)
    seen[entries] = True
    far = lambda c: ((vectors[c] - query) ** 2).sum(axis=1)
    pool, dist, done = entries, far(entries), np.zeros(len(entries), bool)
    while True:
        o = np.argsort(dist, kind="stable")[:beam]
        pool, dist, done = pool[o], dist[o], done[o]
        todo = np.flatnonzero(~done)[:step]
        if not len(todo):
            if told is not None:
                told.append(int(seen.sum()))
            return pool
        done[todo] = True
        new = np.concatenate([links[bounds[u] : bounds[u + 1]] for u in pool[todo]])
        new = np.unique(new[~seen[new]])
        seen[new] = True
        pool, dist, done = np.concatenate([pool, new]), np.concatenate([dist, far(new)]), np.concatenate([done, np.zeros(len(new), bool)])


def _found(index: Index, asked: DataFrame, k: int, beam: int, step: int) -> DataFrame:
    """(query_id, vec_id, score) of the k nearest in each shard that a query (shard, id, data) asks; a shard is copied for each ASKED of its queries."""
    sizes = asked.groupBy("shard").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("subs"))
    dealt = salted_join(asked, sizes, "shard", "id").withColumn("sub", F.pmod(F.xxhash64("id"), "subs").cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub")
    kept = index.nodes.join(index.graph.select("shard", "node", "near"), ["shard", "node"], "left").join(sizes, "shard")
    kept = kept.select("shard", each, F.lit(0).alias("kind"), F.col("node").cast("long").alias("id"), F.col("v").alias("data"), "near", "ids")
    rows = kept.unionByName(dealt.select("shard", "sub", F.lit(1).alias("kind"), "id", "data", F.lit(None).cast("binary").alias("near"), F.lit(None).cast("array<long>").alias("ids")))
    order = ("shard", "sub")

    def run(batches):
        from .near_dedup import runs

        held: list[pa.RecordBatch] = []  # of a shard, at most SHARD nodes
        for first, part in runs(batches, order):
            if first:
                held, exact = [], None
            kind = part.column("kind").to_numpy()
            cut = int(np.searchsorted(kind, 1))
            if cut:
                held.append(part.slice(0, cut))
            asks = part.slice(cut)
            if not asks.num_rows:
                continue
            if exact is None:
                n = sum(b.num_rows for b in held)
                exact = np.concatenate([text_buffer(b.column("data"))[0] for b in held]).view(np.float64).reshape(n, -1)
                middle = exact.mean(axis=0)
                size = max(np.abs(exact - middle).max(initial=0), 1e-300)
                quick = _centred(exact)
                ids = [x for b in held for x in b.column("ids").to_pylist()]
                near = [np.frombuffer(x.as_buffer(), np.int32) if x.is_valid else np.zeros(0, np.int32) for b in held for x in b.column("near")]
                sizes = np.array([len(x) for x in near])
                u, v = np.repeat(np.arange(n), sizes), np.concatenate(near)
                both = np.unique(np.concatenate([u * n + v, v.astype(np.int64) * n + u]))
                links, bounds = (both % n).astype(np.int32), np.searchsorted(both // n, np.arange(n + 1))
                entries = np.arange(n) if n <= beam else entry_nodes(links, bounds)
            data, out = text_buffer(asks.column("data"))[0].view(np.float64).reshape(asks.num_rows, -1), []
            for own, q in zip(asks.column("id").to_pylist(), data):
                pool = greedy(quick, links, bounds, ((q - middle) / size).astype(np.float32), entries, beam, step)[: 3 * k + 10]
                d = np.sqrt(((exact[pool] - q) ** 2).sum(axis=1))
                out += [(own, i, x) for x, i in sorted((x, i) for p, x in zip(pool.tolist(), d.tolist()) for i in ids[p] if i != own)[:k]]
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

    return rows.repartition(*order).sortWithinPartitions(*order, "kind", "id").mapInArrow(run, "query_id long, vec_id long, score double")


def search(index: Index, queries: DataFrame, k: int = 10, beam: int = BEAM, step: int = STEP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of other ids that the search finds, by Euclidean distance.

    Only vectors of a query's own dimension are its candidates; with k candidates or fewer it gets all.
    Ties go to the smaller id; rows of one id and vector count once; of queries that share an id the
    least vector is asked; without queries or vectors the result is empty. k may be up to COPIES - 1.
    """
    if k >= min(COPIES, beam):
        raise ValueError(f"k may be up to {min(COPIES, beam) - 1}")
    spark, places = queries.sparkSession, index.places
    asked = saved(queries.groupBy("id").agg(F.min("v").alias("v")).select("id", "v", F.size("v").alias("dim"), F.lit(None).cast("double").alias("reach")), "nn-queries")
    if not places.shards:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sent = spark.sparkContext.broadcast(places)  # of bounded size

    def routed(home: bool):
        def run(batches):
            for batch in batches:
                for d, at in by_dim(batch, 2):
                    if d not in sent.value.shards:
                        continue
                    rows = batch.take(pa.array(at))
                    v = matrix(rows.column(1))
                    reach = np.array([np.inf if x is None else x for x in rows.column(3).to_pylist()])
                    packed = pa.array([x.tobytes() for x in v], pa.binary())
                    for shard, own in sent.value.home(d, v) if home else sent.value.others(d, v, reach):
                        own = pa.array(own)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), shard), pa.int32()), rows.column(0).take(own), packed.take(own)], ["shard", "id", "data"])

        return run

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    kind = "shard int, id long, data binary"
    found = _found(index, saved(asked.mapInArrow(routed(True), kind), "nn-routed"), k, beam, step)
    if any(len(x) > 1 for x in places.shards.values()):
        found = saved(found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"), "nn-found")
        reach = found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.max("score")).alias("reach"))
        again = asked.drop("reach").join(reach, "id", "left").select("id", "v", "dim", "reach")
        found = found.unionByName(_found(index, saved(again.mapInArrow(routed(False), kind), "nn-routed"), k, beam, step))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
