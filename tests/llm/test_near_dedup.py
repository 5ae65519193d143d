import random
from collections import defaultdict

import numpy as np
import pytest

from textloom.llm import near_dedup


def shingles(text, size):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or {tuple(words)}


def plain(rows, size, percent):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    sets, up = [shingles(t, size) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return sorted(((d, len(s), rows[root(i)][0], d == rows[root(i)][0]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, n, edits):
    r = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(300)]
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randrange(1, 90))]
        if rows and r.random() < 0.6:
            words = (r.choice(rows)[1] or "x").split() or ["x"]
            for _ in range(r.randrange(edits)):
                words[r.randrange(len(words))] = r.choice(vocabulary).lower()
        text = r.choice(["", None, " \t ", "a", "a b", "A b"]) if r.random() < 0.1 else r.choice(" \n").join(words)
        rows.append((i * 2, text))
    return rows


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"bucket": 4, "cluster": 4}), (3, {"errors": 0}), (4, {"errors": 2})])
def test_against_all_pairs(spark, seed, options):
    rows = corpus(seed, 200, 4)
    df = spark.createDataFrame([(t, d, 5, "x") for d, t in rows], "text string, doc_id long, key long, bucket string")
    assert got(near_dedup.near_duplicates(df, 3, 85, **options)) == plain(rows, 3, 85)


def test_repeated_null_and_empty(spark):
    rows = [(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (1, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_dedup.near_duplicates(df, 3, 85)) == plain(rows, 3, 85)
    assert near_dedup.near_duplicates(df.limit(0)).collect() == []


def test_all_pairs_within_the_distance_meet():
    r = np.random.default_rng(4)
    for errors in (0, 1, 2):
        base = r.integers(0, 1 << 16, 60).astype(np.uint16)
        for _ in range(200):
            other = base.copy()
            at = r.choice(60, 12, replace=False)
            other[at] = r.integers(0, 1 << 16, 12)
            keys = near_dedup.chunk_keys(np.stack([base, other]), 12, errors)
            assert (keys[0] == keys[1]).any()


def joined(n, links, group):
    """Which rows links and groups join."""
    sets = near_dedup.Sets(n)
    for a, b in links:
        sets.join(int(a), int(b))
    return sets


def test_bucket_links_join_all_pairs_within_the_threshold_and_sizes():
    r = np.random.default_rng(5)
    for _ in range(20):
        sigs = r.integers(0, 3, (40, 30)).astype(np.uint16)
        group, sizes = r.integers(0, 4, 40), r.integers(80, 120, 40)
        want = [(i, j) for i in range(40) for j in range(i + 1, 40) if group[i] != group[j] and (sigs[i] != sigs[j]).sum() <= 15 and 100 * min(sizes[i], sizes[j]) >= 85 * max(sizes[i], sizes[j])]
        links = near_dedup.bucket_links(sigs, group, sizes, 15, 85)
        mine = joined(40, links, group)
        assert set(links) <= set(want) and all(mine.root(a) == mine.root(b) for a, b in want)


def test_set_links_join_all_similar_sets_of_different_groups():
    r = random.Random(7)
    for _ in range(20):
        base = [r.sample(range(60), 20) for _ in range(4)]
        sets = [sorted(set(r.choice(base)) ^ set(r.sample(range(60), r.randrange(4)))) for _ in range(30)]
        group = np.array([r.randrange(6) for _ in sets])
        like = lambda a, b: 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b))
        want = [(i, j) for i in range(30) for j in range(i) if group[i] != group[j] and like(sets[i], sets[j])]
        flat, off = np.array([x for s in sets for x in s], np.uint64), np.cumsum([0] + [len(s) for s in sets])
        links = near_dedup.set_links(flat, off, group, 80)
        mine = joined(30, links, group)
        assert all(like(sets[a], sets[b]) for a, b in links) and all(mine.root(a) == mine.root(b) for a, b in want)


def family(n, words, edits, seed):
    """Copies of one page, of which each has words of its own at some places."""
    r = random.Random(seed)
    page = [f"w{r.randrange(500)}" for _ in range(words)]
    out = [(0, " ".join(page))]
    for i in range(1, n):
        own = list(page)
        for at in r.sample(range(words), edits):
            own[at] = f"own{i}x{at}"
        out.append((i, " ".join(own)))
    return out


def test_copies_of_a_page_that_are_similar_to_it_alone(spark):
    """Pairs of copies are below the threshold, and the page isn't the smallest id: its leadership must be found."""
    rows = [(5000 if i == 0 else i, t) for i, t in family(400, 200, 4, 3)]
    sets = {d: shingles(t, 3) for d, t in rows}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert like(1, 2) < 0.85 <= like(1, 5000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(near_dedup.near_duplicates(df, 3, 85)) == plain(rows, 3, 85)


def test_rows_dealt_grow_with_the_copies_and_not_with_their_pairs(spark, monkeypatch):
    compared = []
    meet = near_dedup.meet

    def counted(pairs, things, test, parts):
        compared.append(pairs.count())
        return meet(pairs, things, test, parts)

    clustered = []
    blocks = near_dedup._blocks

    def dealt(df, count):
        clustered.append(df.count())
        return blocks(df, count)

    monkeypatch.setattr(near_dedup, "meet", counted)
    monkeypatch.setattr(near_dedup, "_blocks", dealt)
    took = []
    for n in (500, 2000):
        compared.clear(), clustered.clear()
        rows = family(n, 150, 2, 9)
        got_ = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 85).collect()
        assert {r.component_id for r in got_} == {0} and len(got_) == n
        took.append(sum(compared) + sum(clustered))
    assert took[1] < 6 * took[0] and took[1] < 40 * 2000


def test_long_text_and_clashing_columns(spark):
    r = random.Random(6)
    long = " ".join(f"v{r.randrange(10**6)}" for _ in range(700_000))  # over 4 MB
    rows = [(3, long), (1, long + " one more"), (2, "short text of five words"), (4, None)]
    names = "n_shingles string, text string, component string, `set` string, `u` string, `a.b` string, doc_id long, bucket string, _salt string, data string"
    df = spark.createDataFrame([("n", t, "c", "s", "u", "ab", d, "b", "z", "d") for d, t in rows], names)
    assert [(x[0], x[2], x[3]) for x in got(near_dedup.near_duplicates(df, 3, 85))] == [(1, 1, True), (2, 2, True), (3, 1, False), (4, 4, True)]


def test_salted_join_keeps_all_rows_of_a_hot_key(spark):
    from textloom.llm.common import salted_join

    many = spark.range(5000).selectExpr("case when id < 4000 then 7 else id end as k", "id")
    one = spark.range(0, 5000, 7).selectExpr("id as k", "id * 2 as x")
    want = sorted(tuple(r) for r in many.join(one, "k").collect())
    assert sorted(tuple(r) for r in salted_join(many, one, "k", "id", each=100).select("k", "id", "x").collect()) == want


def test_components(spark):
    from textloom.llm.components import components

    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(40)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    want, seen = {}, set()
    for s in sorted(near):
        if s not in seen:
            stack = [s]
            while stack:
                x = stack.pop()
                if x not in seen:
                    seen.add(x)
                    want[x] = s
                    stack += near[x]
    rows = components(spark.createDataFrame(edges, "u long, v long")).collect()
    loops = {a for a, b in edges if a == b and near[a] == {a}}
    assert {r.node: r.component for r in rows} == {k: v for k, v in want.items() if k not in loops} and len(rows) == len(want) - len(loops)
