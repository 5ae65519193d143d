"""Byte-level BPE with tiktoken and a local rank file: encode whole texts, decode to raw bytes."""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_and_text

_loaded: dict = {}
#: Characters of a long text that go to the library at once.
SPAN = 100_000
_SAFE = regex.compile(r"(?<=\S)\s")


def encoding(path: str, pattern: str):
    """The encoding of a rank file, one for each worker."""
    if (path, pattern) not in _loaded:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _loaded[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path, pattern]


def spans(text: str, most: int = SPAN):
    """Cut a long text before white space that follows other text.

    With the split pattern of byte-level BPE every match ends there, as only a match's first
    character, or all of it, is white space; what follows doesn't depend on what stands before.
    """
    at = 0
    while len(text) - at > most:
        cut = _SAFE.search(text, at + most)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(enc, text: str) -> list[int]:
    if len(text) <= SPAN:
        return enc.encode_ordinary(text)
    return [i for part in spans(text) for i in enc.encode_ordinary(part)]


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; a null text is empty and gives no ids.

    Rows stay as they are, repeated ones and null doc_ids too; other columns play no part.
    There is no shuffle, and a batch of rows is all that a worker holds.
    """

    def run(batches):
        enc = encoding(ranks, pattern)
        for batch in batches:
            ids = [encode_text(enc, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, bytes binary): the raw bytes of ids, whether or not they are whole characters; null ids give none."""

    def run(batches):
        enc = encoding(ranks, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([enc.decode_bytes(i or []) for i in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256 (digests only, not ids, leave the worker)."""

    def run(batches):
        enc = encoding(ranks, pattern)
        for batch in batches:
            n, ids_sha, out_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = encode_text(enc, text)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(str(ids)[1:-1].replace(",", "").encode()).hexdigest())
                out_sha.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(out_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
