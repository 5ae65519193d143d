import math

import numpy as np
import pytest

from textloom.llm import knn_join, neighbour_graph

SCHEMA = "vec_id long, embedding array<float>, id string, v int"


def rows_of(n, dim, seed, centres=12):
    r = np.random.default_rng(seed)
    mid = r.normal(size=(centres, dim))
    vs = (mid[r.integers(0, centres, n)] + 0.3 * r.normal(size=(n, dim))).astype(np.float32)
    vs[n // 3 : n // 2] = vs[0]  # a third or so are one vector
    return [(i, v.tolist()) for i, v in enumerate(vs)]


ODD = [(9001, None), (9002, [1.0, None] + [0.0] * 6), (9003, [float("nan")] * 8), (9004, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (9005, []), (9020, [0.0] * 8), (9040, [0.5, 0.25])]


def exact(rows, every, k):
    live = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in live:
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in live if i != q and len(a) == len(b))[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("seed,part,queries", [(1, 50_000, 2048), (2, 40, 4)])
def test_top_k_is_exact(spark, monkeypatch, seed, part, queries):
    monkeypatch.setattr(knn_join, "QUERIES", queries)
    rows = rows_of(240, 8, seed) + ODD
    data = knn_join.vectors(frame(spark, rows), "vec_id", "embedding", 64)
    got = knn_join.top_k(data, data.where("id % 20 = 0"), 20, part=part)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == exact(rows, 20, 20)


@pytest.mark.parametrize("noise", [0.1, 0.3])
def test_bounds_keep_most_rows_of_clustered_vectors_away(spark, noise):
    r = np.random.default_rng(1)
    v = r.normal(size=(100, 64))[r.integers(0, 100, 8000)] + noise * r.normal(size=(8000, 64))
    data = knn_join.vectors(spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>"), "vec_id", "embedding", 64)
    said = []
    got = knn_join.top_k(data, data.where("id % 5 = 0"), 10, told=said.append).collect()
    assert said[0]["groups"] > 2 and said[0]["share"] < 0.5
    whole = np.floor(64 * v).astype(np.int64)
    for q in range(0, 8000, 400):
        score = whole @ whole[q]
        score[q] = -(2**62)
        want = sorted(range(8000), key=lambda i: (-score[i], i))[:10]
        assert [(g.vec_id, g.score) for g in sorted((g for g in got if g.query_id == q), key=lambda g: g["rank"])] == [(i, score[i]) for i in want]


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e6, 1e200])
def test_bounds_hold_for_any_magnitude(spark, scale):
    rows = [(i, [scale * x for x in v]) for i, v in rows_of(200, 4, 8) if v]
    rows = [(i, np.array(v, np.float64).tolist()) for i, v in rows]
    data = knn_join.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), "vec_id", "embedding", 64)
    got = knn_join.top_k(data, data.where("id % 20 = 0"), 5, pivots=16).collect()
    clamp = lambda x: max(-(2**63), min(2**63 - 1, x))
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    want = []
    for q in whole:
        if q % 20 == 0:
            near = sorted((-clamp(sum(x * y for x, y in zip(whole[q], w))), i) for i, w in whole.items() if i != q)[:5]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(near, 1)]
    assert sorted(tuple(g) for g in got) == sorted(want)


def test_few_or_no_rows(spark):
    rows = [(0, [0.1, 0.2]), (20, [0.3, -0.2]), (3, [1.0, 1.0])]
    data = knn_join.vectors(frame(spark, rows), "vec_id", "embedding", 64)
    got = knn_join.top_k(data, data.where("id % 20 = 0"), 20)
    assert sorted(tuple(r) for r in got.collect()) == exact(rows, 20, 20)
    none = data.where("id < 0")
    assert knn_join.top_k(none, none, 5).collect() == [] and knn_join.top_k(data, none, 5).collect() == []
    flat = knn_join.vectors(frame(spark, rows), "vec_id", "embedding", None, nonzero=True)
    near = neighbour_graph.search(neighbour_graph.build(flat), flat.where("id % 20 = 0"), 10).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in near) == [(0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)]
    assert neighbour_graph.search(neighbour_graph.build(none), none, 3).collect() == []


def test_huge_components_keep_exact_order():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**22, 1.0], [2.0**22, 2.0]])
    assert knn_join.scores(a, b).tolist() == [[2**62 + 3, 2**62 + 6]]
    assert knn_join.scores(a, 4 * b).tolist() == [[2**63 - 1, 2**63 - 1]]  # a score is a long


def test_graph_search_recall(spark):
    rows = rows_of(1500, 8, 4) + ODD
    data = knn_join.vectors(frame(spark, rows), "vec_id", "embedding", None, nonzero=True)
    got = neighbour_graph.search(neighbour_graph.build(data, shard=600), data.where("id % 100 = 0"), 10).collect()
    live = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    hit = total = 0
    for q in (i for i in live if i % 100 == 0):
        want = sorted((float(np.linalg.norm(live[i] - live[q])), i) for i in live if i != q)[:10]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 11)) and [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        assert all(math.isclose(s, float(np.linalg.norm(live[i] - live[q])), rel_tol=1e-12, abs_tol=1e-12) for _, i, s in mine)
        hit += sum(s <= want[-1][0] + 1e-12 for _, _, s in mine)
        total += 10
    assert hit >= 0.9 * total


def test_routing_loses_nothing_and_keeps_shards_away(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(20, 16))[r.integers(0, 20, 6000)] * 8 + 0.3 * r.normal(size=(6000, 16))
    data = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")
    index = neighbour_graph.build(data, shard=500)
    shards = index.places.shards[16]
    assert len(shards) >= 12 and {s for s, _ in shards} == {t.shard for t in index.nodes.select("shard").distinct().collect()}
    where = {}
    for t in index.nodes.collect():
        where.update(dict.fromkeys(t.ids, t.shard))
    q = x[:200]
    far = np.sort(((q[:, None] - x[None]) ** 2).sum(axis=2), axis=1)[:, 10] ** 0.5
    asked = {i: set() for i in range(200)}
    for found in (index.places.home(16, q), index.places.others(16, q, far)):
        for shard, at in found:
            for i in at.tolist():
                assert shard not in asked[i]
                asked[i].add(shard)
    for i in range(200):
        d = ((x - x[i]) ** 2).sum(axis=1)
        assert {where[j] for j in np.argsort(d)[:11].tolist()} <= asked[i]
    assert sum(map(len, asked.values())) < 0.35 * 200 * len(shards)
    got = neighbour_graph.search(index, data.where("id < 100"), 10).collect()
    hits = sum(len({g.vec_id for g in got if g.query_id == i} & {j for j in np.argsort(((x - x[i]) ** 2).sum(axis=1))[:11].tolist() if j != i}) for i in range(100))
    assert hits >= 0.95 * 1000


def test_search_visits_few_of_25000_nodes():
    r = np.random.default_rng(8)
    v = (r.normal(size=(150, 64))[r.integers(0, 150, 25_000)] + 0.3 * r.normal(size=(25_000, 64))).astype(np.float32)
    near = []
    for a in range(0, len(v), 1000):
        far = (v * v).sum(axis=1) - 2 * v[a : a + 1000] @ v.T
        far[np.arange(len(far)), a + np.arange(len(far))] = np.inf
        near.append(np.argpartition(far, 24, axis=1)[:, :24])
    u, w = np.repeat(np.arange(len(v)), 24), np.concatenate(near).ravel()
    both = np.unique(np.concatenate([u * len(v) + w, w * len(v) + u]))
    links, bounds = (both % len(v)).astype(np.int32), np.searchsorted(both // len(v), np.arange(len(v) + 1))
    entries = neighbour_graph.entry_nodes(links, bounds)
    hits, visited = 0, []
    for i in range(0, 25_000, 250):
        q = v[i] + np.float32(0.1) * r.normal(size=64).astype(np.float32)  # no node of the graph
        pool = neighbour_graph.greedy(v, links, bounds, q, entries, neighbour_graph.BEAM, neighbour_graph.STEP, visited)
        hits += len(set(pool[:10].tolist()) & set(np.argsort(((v - q) ** 2).sum(axis=1))[:10].tolist()))
    assert hits >= 0.9 * 1000 and np.mean(visited) < 0.2 * 25_000


def test_vectors_far_from_the_origin_and_huge_ones(spark):
    r = np.random.default_rng(5)
    for x in (1e9 + r.normal(size=(400, 6)), 1e150 * r.normal(size=(400, 6))):
        data = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")
        got = neighbour_graph.search(neighbour_graph.build(data, shard=300), data.where("id < 20"), 5).collect()
        for i in range(20):
            d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
            assert {g.vec_id for g in got if g.query_id == i} == {j for j in np.argsort(d)[:6].tolist() if j != i}


def test_greedy_search_finds_the_nearest():
    r = np.random.default_rng(2)
    v = r.normal(size=(300, 5)).astype(np.float32)
    far = ((v[:, None] - v[None]) ** 2).sum(axis=2)
    near = np.argsort(far, axis=1)[:, 1:9]
    q = r.normal(size=5).astype(np.float32)
    pool = neighbour_graph.greedy(v, near.ravel(), np.arange(301) * 8, q, np.arange(0, 300, 30), 60, 8)
    assert pool[0] == ((v - q) ** 2).sum(axis=1).argmin()


def test_graph_search_reaches_groups_of_near_copies(spark):
    """One shard, far larger than the beam, of groups of 40 that have no links between them."""
    r = np.random.default_rng(11)
    centre = r.normal(size=(150, 32)) * 10
    x = (np.repeat(centre, 40, axis=0) + r.normal(size=(6000, 32)) * 0.01)
    data = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")
    asked = range(0, 6000, 60)
    got = neighbour_graph.search(neighbour_graph.build(data), data.where("id % 60 = 0"), 10).collect()
    hits = 0
    for i in asked:
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & {g.vec_id for g in got if g.query_id == i})
    assert hits / (10 * len(asked)) > 0.9
