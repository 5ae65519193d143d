import pytest

from textloom.operators import suffixes

SHORT = ["kokokoko", "", "kokokoko", "o😀﻿o", "kk\n", "\n", "\0", "a\0b", "é\U0010ffff￿"]


def ordered(texts):
    return sorted(((d, p) for d, t in enumerate(texts) for p in range(len(t) + 1)), key=lambda x: (texts[x[0]][x[1] :], x[0]))


@pytest.mark.parametrize("texts,sorts", [(SHORT, 1), ([*SHORT, "kokokokokokokokokoko\n" * 4, "x😀" * 30, "kokokokokokokokokoko\n" * 4, "m" * 16], None)])
def test_order_transform_and_back(spark, monkeypatch, texts, sorts):
    """Short texts are in order after one sort of all suffixes, where doubling took a sort, an aggregate and two joins in each of several rounds."""
    calls, plain = [], suffixes.numbered
    monkeypatch.setattr(suffixes, "numbered", lambda df, order, name: calls.append(name) or plain(df, order, name))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = ordered(texts)
    found = suffixes.suffix_array(docs)
    assert sorts is None or len(calls) == sorts
    rows = sorted(map(tuple, found.collect()))
    assert rows == [(i, d, p, ord(texts[d][p]) + 1 if p < len(texts[d]) else 0) for i, (d, p) in enumerate(want)]
    transform = suffixes.transform(docs)
    assert transform.schema.simpleString() == suffixes.bwt(found).schema.simpleString()
    assert sorted(map(tuple, transform.collect())) == sorted(map(tuple, suffixes.bwt(found).collect()))
    assert sorted(map(tuple, suffixes.inverse(transform).collect())) == list(enumerate(texts))
