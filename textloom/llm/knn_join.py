"""Exact top-k search by a Voronoi kNN join, on integer inner products.

Queries and data are dealt to the cells of pivots (k-means on a bounded sample). For a query q of cell g
(pivot p, radius r) and a data row x of cell c (pivot m), with e = |x - m|:

    q.m + p.(x - m) - r e  <=  q.x  <=  q.m + p.(x - m) + r e

Three summaries follow. Of each query cell and its nearest data cells: the greatest lower parts
p.(x - m) - r e, a few for each pair of cells. From them each query's sure score, which k other
rows are certain to reach. From those, the least upper part that a row of cell c needs to matter to any query of
cell g. Only rows that have it are sent there. Near query cells are joined to groups, groups of many
queries or rows are salted by what is left after the bound, data stream past the queries, and the
parts' winners meet at the query. Bounds are widened by far more than floating point can err.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_bounds, drop_path, saved

#: Pivots at most, queries in a group, and data rows of one part of a group, about.
PIVOTS, QUERIES, PART = 256, 4096, 16_384
#: How many times smaller groups of queries may be where bounds keep most rows from them, and queries that a row meets in the time of its sending.
FINER, COPY = 16, 100
#: Sampled rows for the pivots at most, and bytes of them; data cells of which a query cell knows the best lower parts.
SAMPLE, SAMPLE_BYTES, NEAREST = 16_384, 16 << 20, 6
#: Share of a bound's terms by which it is widened.
SLACK = 1e-9


def vectors(df: DataFrame, id_col: str, vec_col: str, scale: float | None, nonzero: bool = False) -> DataFrame:
    """(id long, v array<double>) of rows with whole finite vectors; with scale, floor(scale * x).

    Null vectors and those that hold nulls or non-finite components drop out, and with nonzero those of
    length zero; null ids too, and vectors without any component, which have no product to rank by.
    """
    arrow_bounds(df.sparkSession)
    good = "v is not null and id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    if nonzero:
        good += " and exists(v, x -> x <> 0)"
    # floor gives a long; larger components have no fraction anyway
    out = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("raw")).where(F.col("id").isNotNull())
    out = out.withColumn("v", F.transform("raw", lambda x: x.cast("double"))).where(good)
    if scale is not None:
        out = out.withColumn("v", F.transform("v", lambda x: F.when(F.abs(x) < 2.0**50, F.floor(x * scale).cast("double")).otherwise(x * scale)))
    return out.select("id", "v")


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: in doubles where all sums stay under 2^53, else in Python integers."""
    most = np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * queries.shape[1]
    if most < 2**53:
        return (queries @ data.T).astype(np.int64)
    if most < 2**63:
        return queries.astype(np.int64) @ data.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(queries) @ whole(data).T
    return np.array([[max(-(2**63), min(2**63 - 1, int(x))) for x in row] for row in exact], np.int64)


def merge_best(score: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, held: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the k best of each row among a block of scores and those held; ties to the smaller id, a row's own id left out."""
    n = len(score)
    least = np.iinfo(np.int64).min
    mine = ids[None, :] == own[:, None]
    if score.shape[1] > k:
        edge = np.partition(np.where(mine, least, score), score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        rows, cols = np.nonzero((score >= edge[:, None]) & ~mine)
    else:
        rows, cols = np.nonzero(~mine)
    r, i, s = (np.concatenate(x) for x in zip(held, (rows, ids[cols], score[rows, cols])))
    order = np.lexsort((i, ~s, r))
    r, i, s = r[order], i[order], s[order]
    first = np.searchsorted(r, np.arange(n))
    keep = np.arange(len(r)) - first[r] < k
    return r[keep], i[keep], s[keep]


def centres_of(sample: np.ndarray, most: int, steps: int = 6) -> np.ndarray:
    """Pivots by k-means: far-apart rows of the sample to start with, moved to the means of their cells."""
    with np.errstate(all="ignore"):
        sample = sample[np.isfinite((sample * sample).sum(axis=1))]
        if not len(sample):
            return sample
        r = np.random.default_rng(5)
        far, picked = np.full(len(sample), np.inf), [0]
        while len(picked) < min(most, len(sample)):
            far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
            total = far.sum()
            if not total > 0 or not np.isfinite(total):
                break
            picked.append(int(min(len(sample) - 1, np.searchsorted(np.cumsum(far), r.random() * total))))
        at = sample[np.unique(picked)]
        for _ in range(steps):
            cell = nearest_pivot(sample, at)[0]
            count = np.bincount(cell, minlength=len(at))
            sums = np.zeros_like(at)
            np.add.at(sums, cell, sample)
            at = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], at)
        return at


def nearest_pivot(v: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each row and its distance to the cell's pivot."""
    far = (v * v).sum(axis=1)[:, None] - 2 * v @ p.T + (p * p).sum(axis=1)
    cell = np.where(np.isnan(far), np.inf, far).argmin(axis=1)
    return cell, np.sqrt(((v - p[cell]) ** 2).sum(axis=1))


def pivots_of(rows: DataFrame, n: int, most: int) -> dict[int, np.ndarray]:
    """Pivots for each dimension, from a sample of SAMPLE rows (and SAMPLE_BYTES) at most of a saved table (v, dim) of n rows."""
    dim = rows.agg(F.max("dim")).first()[0] or 0
    if not n or not dim:
        return {}
    bound = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    some = rows if n <= bound else rows.where(F.rand(3) < 0.9 * bound / n)
    sample = some.select("dim", "v").limit(bound).toArrow()
    dims, out = sample.column("dim").to_numpy(), {}
    for d in np.unique(dims).tolist():
        v = matrix(sample.column("v").combine_chunks().take(pa.array(np.flatnonzero(dims == d))))
        out[d] = centres_of(v, max(1, min(most, int(2 * n**0.5))))
    return {d: p for d, p in out.items() if len(p)}


def by_dim(batch: pa.RecordBatch, column: int):
    """(dimension, row numbers) of a batch."""
    dims = batch.column(column).to_numpy()
    for d in np.unique(dims).tolist():
        yield d, np.flatnonzero(dims == d)


class Bounds:
    """What is known of query cells: pivots of all cells, and for each dimension the query cells, their radii and counts."""

    def __init__(self, centres: dict[int, np.ndarray], cells: list[tuple[int, int, int, float]], k: int) -> None:
        self.centres, self.k = centres, k
        self.cells: dict[int, np.ndarray] = {}
        self.radius: dict[int, np.ndarray] = {}
        self.count: dict[int, np.ndarray] = {}
        for d in {c[0] for c in cells}:
            own = sorted(c[1:] for c in cells if c[0] == d)
            self.cells[d] = np.array([c for c, _, _ in own])
            self.count[d] = np.array([n for _, n, _ in own])
            self.radius[d] = np.array([np.inf if r is None or np.isnan(r) else r for _, _, r in own])
        #: Of each dimension, for each query cell, lower parts (query cell, data cell, part, id) of a few best rows; and the least upper part needed.
        self.sure: dict[int, tuple[np.ndarray, ...]] = {}
        self.need: dict[int, np.ndarray] = {}

    def pivots(self, d: int) -> np.ndarray:
        return self.centres.get(d, np.zeros((1, d)))

    def near(self, d: int) -> np.ndarray:
        """For each query cell, the data cells that promise most."""
        p = self.pivots(d)
        return np.argsort(-(p[self.cells[d]] @ p.T), axis=1, kind="stable")[:, :NEAREST]

    def parts(self, d: int, v: np.ndarray, cell: np.ndarray, e: np.ndarray, chosen=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """(rows x query cells): p.(x - m), and how far the true score may be from it."""
        p = self.pivots(d)
        own = p[self.cells[d]][chosen]
        middle = (v - p[cell]) @ own.T
        spread = e[:, None] * self.radius[d][chosen]
        spread = spread + SLACK * (spread + e[:, None] * np.linalg.norm(own, axis=1) + np.abs(middle))
        return middle, np.where(np.isnan(spread), np.inf, spread)

    def lower(self, d: int, v: np.ndarray, cell: np.ndarray, e: np.ndarray, ids: np.ndarray, held: dict) -> None:
        """Keep in held[(query cell, data cell)] the k + 1 best lower parts, of distinct ids, with those of these rows."""
        near = self.near(d)
        for c in np.unique(cell).tolist():
            at = np.flatnonzero(cell == c)
            for g in np.flatnonzero((near == c).any(axis=1)).tolist():
                middle, spread = self.parts(d, v[at], cell[at], e[at], [g])
                low = (middle - spread)[:, 0]
                old = held.get((d, g, c), (np.zeros(0), np.zeros(0, np.int64)))
                part, own = np.concatenate([old[0], np.where(np.isnan(low), -np.inf, low)]), np.concatenate([old[1], ids[at]])
                order = np.lexsort((own, -part))
                order = order[np.sort(np.unique(own[order], return_index=True)[1])[: self.k + 1]]
                held[d, g, c] = part[order], own[order]

    def sure_scores(self, d: int, q: np.ndarray, g: int, ids: np.ndarray) -> np.ndarray:
        """For each query of a query cell, a score that k rows of other ids are certain to reach."""
        cells, data_cell, part, row = self.sure.get(d, (np.zeros(0, int),) * 4)
        mine = cells == g
        if mine.sum() < self.k:
            return np.full(len(q), -np.inf)
        m = self.pivots(d)[data_cell[mine]]
        low = q @ m.T + part[mine]
        low = low - SLACK * (np.abs(low) + np.abs(part[mine]) + np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(m, axis=1))
        low = np.where(np.isnan(low) | (ids[:, None] == row[mine]), -np.inf, low)
        best = np.partition(low, low.shape[1] - self.k, axis=1)[:, low.shape[1] - self.k]
        return np.minimum(best, 2.0**63 - 2048)

    def needs(self, d: int, q: np.ndarray, g: int, ids: np.ndarray) -> np.ndarray:
        """For each data cell, the least upper part with which a row could matter to one of these queries of a cell."""
        p, sure = self.pivots(d), self.sure_scores(d, q, g, ids)
        here = q @ p.T
        room = SLACK * (np.abs(here) + np.abs(sure)[:, None] + np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(p, axis=1))
        need = sure[:, None] - here - room
        return np.where(np.isnan(need), -np.inf, need).min(axis=0)

    def wanted(self, d: int, v: np.ndarray, cell: np.ndarray, e: np.ndarray) -> np.ndarray:
        """(rows x query cells): may the row be among the k best of a query there?"""
        middle, spread = self.parts(d, v, cell, e)
        return ~(middle + spread < self.need[d][:, cell].T)


def near_groups(bounds: Bounds, most: int) -> list[tuple[int, list[int], int]]:
    """(dimension, query cells, queries): near cells end to end, in groups of about ``most`` queries."""
    out = []
    for d, cells in sorted(bounds.cells.items()):
        p, left = bounds.pivots(d)[cells], list(range(len(cells)))
        here = left.pop(0)
        chain = [here]
        while left:
            with np.errstate(all="ignore"):
                far = ((p[left] - p[here]) ** 2).sum(axis=1)
            here = left.pop(int(np.argmin(np.where(np.isnan(far), np.inf, far))))
            chain.append(here)
        group, n = [], 0
        for g in chain:
            if group and n + bounds.count[d][g] > most:
                out.append((d, group, n))
                group, n = [], 0
            group.append(g)
            n += int(bounds.count[d][g])
        out.append((d, group, n))
    return out


def top_k(data: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS, part: int = PART, told: Callable[[dict], None] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products with other rows of data.

    data and queries are tables of ``vectors`` (id, v). Only vectors of a query's own dimension are its
    candidates, and rows of its own id are not. A query with fewer candidates gets them all; ties go to
    the smaller id; repeated rows of data all count; of queries that share an id the least vector
    is asked; without queries or data the result is empty. ``told`` gets the figures of the plan: rows,
    groups, and rows sent to groups, whose share is small where data have clusters, and 1 where
    all vectors are about equally far from each other.
    """
    spark = data.sparkSession
    empty = "query_id long, rank int, vec_id long, score long"
    data, queries = saved(data.withColumn("dim", F.size("v")), "knn-data"), saved(queries.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")), "knn-queries")
    n_data = data.count()
    centres = pivots_of(data, n_data, pivots)
    sent = spark.sparkContext.broadcast(centres)  # at most SAMPLE_BYTES

    def cell_of(batches):
        for batch in batches:
            for d, at in by_dim(batch, 2):
                v = matrix(batch.column(1).take(pa.array(at)))
                with np.errstate(all="ignore"):
                    cell, e = nearest_pivot(v, sent.value.get(d, np.zeros((1, d))))
                    e = np.where(np.isnan(e), np.inf, e * (1 + SLACK) + 1e-300)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.full(len(at), d), pa.int32()), pa.array(cell, pa.int32()), pa.array(e)], ["id", "v", "dim", "cell", "e"])

    kind = "id long, v array<double>, dim int, cell int, e double"
    placed, asked = saved(data.mapInArrow(cell_of, kind), "knn-cells"), saved(queries.mapInArrow(cell_of, kind), "knn-asked")
    for old in (data, queries):
        drop_path(spark, old)
    # a row for each pivot and dimension
    cells = [tuple(r) for r in asked.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("e").alias("e")).collect()]
    if not cells or not n_data:
        return spark.createDataFrame([], empty)
    bounds = Bounds(centres, cells, k)
    known = spark.sparkContext.broadcast(bounds)

    def each_dim(batch):
        for d, at in by_dim(batch, 2):
            if d in known.value.cells:
                cell, e = (batch.column(i).to_numpy()[at] for i in (3, 4))
                yield d, at, matrix(batch.column(1).take(pa.array(at))), cell, e, batch.column(0).to_numpy()[at]

    def lower(batches):
        held: dict = {}
        for batch in batches:
            for d, _, v, cell, e, ids in each_dim(batch):
                with np.errstate(all="ignore"):
                    known.value.lower(d, v, cell, e, ids, held)
        rows = [(d, g, c, float(x), int(i)) for (d, g, c), (xs, ids) in held.items() for x, i in zip(xs, ids)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64()))], ["dim", "g", "c", "part", "id"])

    # at most k + 1 rows for each query cell and each of its NEAREST data cells
    per_id = placed.mapInArrow(lower, "dim int, g int, c int, part double, id long").groupBy("dim", "g", "c", "id").agg(F.max("part").alias("part"))
    rank = F.row_number().over(Window.partitionBy("dim", "g", "c").orderBy(F.col("part").desc(), "id"))
    best = per_id.withColumn("n", rank).where(F.col("n") <= k + 1).select("dim", "g", "c", "part", "id").toArrow()
    for d in bounds.cells:
        at = np.flatnonzero(best.column("dim").to_numpy() == d)
        bounds.sure[d] = tuple(best.column(c).to_numpy()[at] for c in ("g", "c", "part", "id"))
    known = spark.sparkContext.broadcast(bounds)

    def needs(batches):
        held: dict = {}
        for batch in batches:
            for d, _, q, cell, _, ids in each_dim(batch):
                for c in np.unique(cell).tolist():
                    at, g = np.flatnonzero(cell == c), int(np.searchsorted(known.value.cells[d], c))
                    with np.errstate(all="ignore"):
                        need = known.value.needs(d, q[at], g, ids[at])
                    held[d, g] = np.minimum(held.get((d, g), need), need)
        for (d, g), need in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(need), d), pa.int32()), pa.array(np.full(len(need), g), pa.int32()), pa.array(np.arange(len(need)), pa.int32()), pa.array(need)], ["dim", "g", "c", "need"])

    least = asked.mapInArrow(needs, "dim int, g int, c int, need double").groupBy("dim", "g", "c").agg(F.min("need").alias("need")).toArrow()
    for d, own in bounds.cells.items():
        at = np.flatnonzero(least.column("dim").to_numpy() == d)
        bounds.need[d] = np.full((len(own), len(bounds.pivots(d))), -np.inf)
        bounds.need[d][least.column("g").to_numpy()[at], least.column("c").to_numpy()[at]] = least.column("need").to_numpy()[at]
    # small groups where they get few rows each, as fewer are compared; else large ones, which copy rows less often
    plans = [near_groups(bounds, QUERIES), near_groups(bounds, max(1, QUERIES // FINER))]
    known = spark.sparkContext.broadcast(bounds)

    def survivors(batch, groups):
        """(group, rows of the batch that are sent to it)."""
        for d, at, v, cell, e, _ in each_dim(batch):
            with np.errstate(all="ignore"):
                want = known.value.wanted(d, v, cell, e)
            for i, (dim, members, _) in enumerate(groups):
                if dim == d:
                    yield i, at[want[:, members].any(axis=1)]

    def count(batches):
        n = [np.zeros(len(groups), np.int64) for groups in plans]
        for batch in batches:
            for x, groups in zip(n, plans):
                for i, at in survivors(batch, groups):
                    x[i] += len(at)
        for plan, x in enumerate(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), plan), pa.int32()), pa.array(np.arange(len(x)), pa.int32()), pa.array(x)], ["plan", "grp", "n"])

    sizes = {(r.plan, r.grp): r.n for r in placed.mapInArrow(count, "plan int, grp int, n long").groupBy("plan", "grp").agg(F.sum("n").alias("n")).collect()}
    cost = [sum(sizes.get((x, i), 0) * (n + COPY) for i, (_, _, n) in enumerate(groups)) for x, groups in enumerate(plans)]
    chosen = int(cost[1] < cost[0])
    groups, left = plans[chosen], {g: n for (plan, g), n in sizes.items() if plan == chosen}
    if told:
        told({"rows": n_data, "groups": len(groups), "sent": sum(left.values()), "share": sum(left.values()) / (n_data * len(groups))})
    subs = [max(1, -(-n // QUERIES)) for _, _, n in groups]
    salts = [max(1, -(-left.get(i, 0) // part)) for i in range(len(groups))]
    where = {(d, int(bounds.cells[d][g])): i for i, (d, members, _) in enumerate(groups) for g in members}
    names, rows = ["grp", "sub", "salt", "query", "id", "v"], "grp int, sub int, salt int, query boolean, id long, v array<double>"

    def packed(batch, at, grp, sub, salt, query):
        one = lambda x, t: pa.array(np.broadcast_to(np.asarray(x), (len(at),)), t)
        at = pa.array(at)
        return pa.RecordBatch.from_arrays([one(grp, pa.int32()), one(sub, pa.int32()), one(salt, pa.int32()), one(query, pa.bool_()), batch.column(0).take(at), batch.column(1).take(at)], names)

    def deal(ids: np.ndarray, n: int, seed: int) -> np.ndarray:
        return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) >> np.uint64(33)).astype(np.int64) % n

    def replicate(batches):
        for batch in batches:
            for i, at in survivors(batch, groups):
                salt = deal(batch.column(0).to_numpy()[at] + at, salts[i], 1)
                for sub in range(subs[i] if len(at) else 0):
                    yield packed(batch, at, i, sub, salt, False)

    def ask(batches):
        for batch in batches:
            g = np.array([where[x] for x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], int)
            for i in np.unique(g).tolist():
                at = np.flatnonzero(g == i)
                for salt in range(salts[i]):
                    yield packed(batch, at, i, deal(batch.column(0).to_numpy()[at], subs[i], 7), salt, True)

    def solve(batches):
        from .near_dedup import runs

        state = None  # (query ids, queries, the best so far of each 256 of them)

        def finished(state):
            for q_ids, _, held in state or ():
                r, i, s = held
                if len(r):
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[r]), pa.array(i), pa.array(s)], ["query_id", "vec_id", "score"])

        none = np.zeros(0, np.int64)
        for first, part_ in runs(batches, ("grp", "sub", "salt")):
            if first:
                yield from finished(state)
                state = []
            asks = part_.column("query").to_numpy(zero_copy_only=False)
            at = np.flatnonzero(asks)
            for a in range(0, len(at), 256):
                rows_ = part_.take(pa.array(at[a : a + 256]))
                state.append((rows_.column("id").to_numpy(), matrix(rows_.column("v")), (none, none, none)))
            block = part_.filter(pa.array(~asks))
            if block.num_rows:
                ids, v = block.column("id").to_numpy(), matrix(block.column("v"))
                state = [(q_ids, q, merge_best(scores(q, v), ids, q_ids, k, held)) for q_ids, q, held in state]
        yield from finished(state)

    order = ("grp", "sub", "salt")
    dealt = asked.mapInArrow(ask, rows).unionByName(placed.mapInArrow(replicate, rows)).repartition(*order).sortWithinPartitions(*order, F.col("query").desc())
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return dealt.mapInArrow(solve, "query_id long, vec_id long, score long").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
