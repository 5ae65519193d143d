import hashlib
import random
from collections import defaultdict

import pytest

from textloom.llm import automata_dedup, suffix_dedup, winnow


def plain_bytes(rows, window):
    """Brute force: rows (doc_id, text) in document order."""
    seen, out = set(), []
    for doc_id, text in rows:
        body = (text or "").encode()
        hit = [False] * len(body)
        for s in range(len(body) - window + 1):
            w = body[s : s + window]
            if w in seen:
                hit[s : s + window] = [True] * window
            seen.add(w)
        kept = bytes(b for b, h in zip(body, hit) if not h)
        n_spans = sum(h and not p for h, p in zip(hit, [False] + hit))
        out.append((doc_id, len(body), sum(hit), n_spans, hashlib.sha256(kept).hexdigest()))
    return out


def plain_words(rows, window):
    first, out = {}, []
    for i, (_, text) in enumerate(rows):
        words = (text or "").encode().split()
        for s in range(len(words) - window + 1):
            first.setdefault(tuple(words[s : s + window]), i)
    for i, (doc_id, text) in enumerate(rows):
        words = (text or "").encode().split()
        hit = [False] * len(words)
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < i:
                hit[s : s + window] = [True] * window
        kept = [w for w, h in zip(words, hit) if not h]
        out.append((doc_id, len(words), sum(hit), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randrange(1, 6))) for _ in range(40)]
    prose = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared = [prose(70) for _ in range(3)]
    rows = []
    for i in range(n):
        kind = r.randrange(6)
        text = prose(r.randrange(0, 120))
        if kind == 0:
            text = prose(20) + " " + r.choice(shared) + " " + prose(15)
        elif kind == 1 and rows:
            text = r.choice(rows)[1]
        elif kind == 2 and rows and rows[-1][1]:
            old = rows[-1][1].split()
            old[r.randrange(len(old))] = "x"
            text = "\n".join(old)
        elif kind == 3:
            text = r.choice(["", None, "a", "ab " * 90, shared[0] + "\x0b" + shared[0], "🔥" * 60])
        rows.append((i * 3, text))
    return rows


def got(df, columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


BYTES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
WORDS = ["doc_id", "n_words", "n_removed", "kept_sha256"]


@pytest.mark.parametrize("seed,most", [(1, winnow.MOST), (2, 1)])
def test_bytes_against_brute_force(spark, seed, most):
    rows = corpus(seed)
    df = spark.createDataFrame([(t, i, "z", 1) for i, t in rows], "text string, doc_id long, key string, cuts int").repartition(5)
    assert got(suffix_dedup.dedup(df, most=most), BYTES) == sorted(plain_bytes(rows, 100))


@pytest.mark.parametrize("seed,most", [(3, winnow.MOST), (4, 1)])
def test_words_against_brute_force(spark, seed, most):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(automata_dedup.dedup(df, most=most), WORDS) == sorted(plain_words(rows, 50))


def hot_corpus(seed, n=90):
    """A passage in very many documents, between words that are all different, or that some documents share."""
    r = random.Random(seed)
    own = lambda k: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(k))
    passage, sides = own(70), [own(30) for _ in range(4)]
    rows = []
    for i in range(n):
        left = r.choice(sides) if r.random() < 0.4 else own(30)
        right = r.choice(sides) if r.random() < 0.4 else own(30)
        middle = passage.split()[r.choice([0, 0, 0, 3]) :]
        rows.append((i, " ".join([*left.split()[r.randrange(3) :], *middle, *right.split()])))
    return rows + [(n, rows[5][1] + " " + rows[7][1]), (n + 1, passage + " " + passage)]


@pytest.mark.parametrize("seed,most", [(5, 4), (6, 16)])
def test_hot_passages_against_brute_force(spark, monkeypatch, seed, most):
    rows = hot_corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    split, dealt = winnow.split, []

    def counted(pieces, unit, width):
        dealt.append((unit.kind, width, pieces.count()))
        return split(pieces, unit, width)

    monkeypatch.setattr(winnow, "split", counted)
    assert got(suffix_dedup.dedup(df, most=most), BYTES) == sorted(plain_bytes(rows, 100))
    assert got(automata_dedup.dedup(df, most=most), WORDS) == sorted(plain_words(rows, 50))
    assert {(k, w) for k, w, n in dealt} == {(k, w) for k in ("bytes", "words") for w in winnow.WIDTHS} and all(n for _, w, n in dealt if w == winnow.WIDTHS[0])
    monkeypatch.setattr(automata_dedup, "hot_first", lambda pieces, window: pieces.selectExpr("*", "cast(null as binary) as cuts"))
    assert got(automata_dedup.dedup(df, most=most), WORDS) == sorted(plain_words(rows, 50))


def test_hot_first_cuts_what_the_first_piece_holds(spark):
    w = [f"w{i}" for i in range(80)]
    other = ["x", "y", *w[2:60], "z", *w[61:]]
    rows = [(9, 1, 10, 30, " ".join(w).encode()), (9, 4, 20, 30, " ".join(other).encode()), (9, 1, 300, 30, " ".join(w).encode()), (8, 5, 0, 3, b" ".join([b"q"] * 50))]
    out = automata_dedup.hot_first(spark.createDataFrame(rows, "h long, key long, lo long, a long, piece binary"), most=1).collect()
    cuts = [(r.key, list(memoryview(r.cuts).cast("I"))) for r in out if r.cuts]
    left = sorted((r.h, r.key, r.lo, r.a, bytes(r.piece).decode()) for r in out if r.piece)
    assert cuts == [(4, [22, 80])]  # windows 2 to 10: words 2 to 59
    assert left == sorted([(8, 5, 0, 3, " ".join(["q"] * 50)), (9, 1, 10, 30, " ".join(w)), (9, 1, 300, 30, " ".join(w)), (9, 4, 20, 30, " ".join(other[:51])), (9, 4, 31, 19, " ".join(other[11:]))])


def test_long_texts_and_clashing_columns(spark):
    """Over 4 MB of words that are all different, and parts of it elsewhere."""
    words = [f"{i * 2654435761 % 2**32:08x}" for i in range(520_000)]
    long, part = " ".join(words), " ".join(words[300_000:330_000])
    rows = [(2, "before " + part + " after", "p", "c", "b"), (1, long, "p", "c", "b"), (3, part, "p", "c", "b"), (4, None, "p", "c", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string, cuts string, `n.b` string")
    n = len(part)
    assert [r[:4] for r in got(suffix_dedup.dedup(df), BYTES)] == [(1, len(long), 0, 0), (2, n + 13, n + 2, 1), (3, n, n, 1), (4, 0, 0, 0)]
    assert [r[:3] for r in got(automata_dedup.dedup(df), WORDS)] == [(1, 520_000, 0), (2, 30_002, 30_000), (3, 30_000, 30_000), (4, 0, 0)]


def test_repeated_and_null_ids(spark):
    text = "one two three four five six seven eight nine ten " * 6
    rows = [(None, text), (7, text), (7, text + "x"), (7, text), (1, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    none_last = lambda x: sorted(x, key=str)
    assert none_last(tuple(r[c] for c in BYTES) for r in suffix_dedup.dedup(df).collect()) == none_last(plain_bytes(order, 100))
    assert none_last(tuple(r[c] for c in WORDS) for r in automata_dedup.dedup(df).collect()) == none_last(plain_words(order, 50))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.dedup(df).collect() == [] and automata_dedup.dedup(df).collect() == []


def test_kept_text(spark):
    text = "é" * 40 + "".join(chr(97 + i % 26) + chr(98 + i % 7) for i in range(80))
    df = spark.createDataFrame([(1, text), (2, "start " + text + " end")], "doc_id long, text string")
    kept = {r.doc_id: r.kept_text for r in suffix_dedup.dedup(df, texts=True).collect()}
    assert kept == {1: text[:0] + plain_kept(text), 2: "start  end"}


def plain_kept(text):
    body, seen, hit = text.encode(), set(), [False] * len(text.encode())
    for s in range(len(body) - 99):
        if body[s : s + 100] in seen:
            hit[s : s + 100] = [True] * 100
        seen.add(body[s : s + 100])
    return bytes(b for b, h in zip(body, hit) if not h).decode("utf-8", "ignore")


def test_against_reference(spark):
    ref = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(80))), (2, None)], "doc_id long, text string")
    docs = spark.createDataFrame([(5, "a b " + " ".join(f"w{i}" for i in range(10, 70)) + " c"), (6, " ".join(f"w{i}" for i in range(49))), (7, None)], "doc_id long, text string")
    rows = {r.doc_id: (r.n_words, r.spans) for r in automata_dedup.against(docs, ref).collect()}
    assert rows == {5: (63, [[2, 62]]), 6: (49, []), 7: (0, [])}


def test_automaton_statistics():
    r = random.Random(5)
    for _ in range(200):
        texts = ["".join(r.choice("ab") for _ in range(r.randrange(0, 12))) for _ in range(3)]
        a = automata_dedup.Automaton()
        for t in texts:
            a.add(t)
        q = "".join(r.choice("abc") for _ in range(15))
        want = [max(k for k in range(i + 2) if any(q[i + 1 - k : i + 1] in t for t in texts)) for i in range(len(q))]
        assert a.statistics(q) == want


def test_suffix_array_and_prefixes():
    import numpy as np

    r = random.Random(6)
    for _ in range(200):
        t = np.array([r.choice([1, 2, 3]) for _ in range(r.randrange(0, 50))], np.uint8)
        order = suffix_dedup.suffix_array(t)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: bytes(t)[i:])


def test_each_window_has_one_anchor_of_its_content():
    import numpy as np

    r = random.Random(7)
    for _ in range(100):
        docs = [bytes(r.choice(b"ab") for _ in range(r.randrange(0, 70))) for _ in range(4)]
        data, off = np.frombuffer(b"".join(docs), np.uint8), np.cumsum([0] + [len(d) for d in docs])
        owner, by = {}, defaultdict(set)
        for _, place, lo, hi, h, _ in zip(*winnow.anchors(winnow.TABLE[data], off, 12, 5)):
            for s in range(lo, hi + 1):
                assert s not in owner
                owner[s] = (int(place - s), int(h))
                by[bytes(data[s : s + 12])].add(owner[s])
        assert set(owner) == {s for i in range(4) for s in range(off[i], off[i + 1] - 11)}
        assert all(len(v) == 1 for v in by.values())
