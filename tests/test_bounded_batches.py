import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.functions import positions, text
from textloom.operators import search
from textloom.operators.grams import postings

KEYS = [f"spark.sql.execution.arrow.{k}" for k in ("maxBytesPerBatch", "maxRecordsPerBatch")]


@pytest.mark.parametrize("search_of", [lambda d: search.locate(d, "the"), lambda d: search.locate_in_chunks(d, "the", 1000), lambda d: d.select(positions("text", "the")), postings])
def test_batches_are_bounded_in_bytes(spark, search_of):
    """Before, a worker held 10,000 texts at once, whatever their length."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    def held(t: pd.Series) -> pd.Series:
        return pd.Series([int(t.str.len().sum())] * len(t))

    for key in KEYS:
        spark.conf.unset(key)
    docs = spark.range(0, 600, 1, 1).selectExpr("id as doc_id", "repeat('the cat ', 2500) as text")
    search_of(docs)
    assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 2 * text.BATCH_BYTES
    assert max(r[0] for r in docs.select(F.pandas_udf(held, "long")("text")).collect()) < 2 * text.BATCH_BYTES


def test_hits_are_handed_on(monkeypatch):
    """Before, all hits of a batch were lists of Python numbers at once."""
    monkeypatch.setattr(search, "FOUND_ROWS", 1000)
    texts = ["a" * 2500, "", "ba", "a" * 999]
    batch = pa.RecordBatch.from_pydict({"doc_id": ["p", "q", "r", "s"], "text": texts})
    out = list(search._located("a")([batch]))
    assert [b.num_rows for b in out] == [1000, 1000, 1000, 500]
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [(k, i) for k, t in zip("pqrs", texts) for i, c in enumerate(t) if c == "a"]
