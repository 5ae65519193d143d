import random

import pytest
from pyspark.sql import functions as F

from textloom import Corpus, GramIndex
from textloom.operators import grams
from textloom.operators.grams import _numbers, _squeezed

_random = random.Random(7)
WORDS = ["tara", "kokako", "ß😀", "\0é", "enenen", "the", "a", ""]


def corpus(spark, n, words, start=0):
    rows = [(start + 7 * i, " ".join(_random.choice(WORDS) for _ in range(words))) for i in range(n)]
    return rows, Corpus(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_numbers_of_variable_length():
    import numpy as np

    values = np.array([0, 1, 127, 128, 1 << 14, (1 << 21) - 1, 1 << 35, (1 << 64) - 1], np.uint64)
    rows = _squeezed(values, np.array([0, 3, 7])).to_pylist()
    assert [list(map(int, _numbers(r))) for r in rows] == [[0, 1, 127], [128, 1 << 14, (1 << 21) - 1, 1 << 35], [(1 << 64) - 1]]


def test_build_shuffles_nothing_and_packs(spark, tmp_path):
    """Before, each character was 8 bytes of a shuffle, and each gram of a document a row."""
    rows, docs = corpus(spark, 300, 200)
    held = docs.documents.persist()
    held.count()
    shuffles = spark._jsc.sc().newShuffleId
    began = shuffles()
    index = GramIndex.build(Corpus(held), str(tmp_path / "i"))
    assert shuffles() - began == 1
    n_chars = sum(len(t) for _, t in rows)
    packed = index.grams.agg(F.sum(F.octet_length("docs") + F.octet_length("counts") + F.octet_length("places")), F.count("*")).first()
    assert packed[0] < 2.5 * n_chars and packed[1] < n_chars / 50
    files = index.grams.select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"), "gram").orderBy("i").collect()
    for f in {r.f for r in files}:
        own = [r.gram for r in files if r.f == f]
        assert own == sorted(own)
    held.unpersist()


@pytest.mark.parametrize("size,start", [(1, -500), (300, 0), (1 << 20, (1 << 62))])
def test_searches_over_chunks(spark, tmp_path, monkeypatch, size, start):
    monkeypatch.setattr(grams, "CHUNK", size)
    rows, docs = corpus(spark, 60, 30, start)
    index = GramIndex.build(docs, str(tmp_path / "i"), partitions=2)
    for p in ("a", "ta", "tar", "enen", "ara ko", "ß😀", "\0é \0é", "kokako the", "zzz"):
        want = {d: h for d, t in rows if (h := [i for i in range(len(t)) if t.startswith(p, i)])}
        assert {r.doc_id: r.positions for r in index.found(p).collect()} == want
        one = next(iter(want), start)
        assert [(r.doc_id, r.positions) for r in index.found(p, one).collect()] == [(d, h) for d, h in want.items() if d == one]
