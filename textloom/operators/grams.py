"""A persisted index of character 3-grams, so that a search reads the posting lists of its pattern, not the corpus.

A posting list is (gram, doc_id, last, docs, counts, places): gram packs three code points (plus one, 0 beyond the end)
into 63 bits, so a shorter pattern is a range of grams. A list is of one chunk: documents doc_id to last that a task read
one after another, CHUNK characters together or one longer text. Gaps of ids, positions a document and gaps of positions are numbers of
variable length, about 2 bytes a character in all. Lists stay in the task that read the text, so no character is
shuffled; each file is sorted by (gram, doc_id), and Parquet's statistics skip the row groups and pages of other grams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bounded_batches
from ..sources.corpus import Corpus
from ..sources.store import read_note, write_note

Q, _BITS = 3, 21
#: Characters of the documents whose lists are packed together.
CHUNK = 1 << 20
_LISTS = "gram bigint, doc_id bigint, last bigint, docs binary, counts binary, places binary"


def pack(points: list[int]) -> int:
    """Three symbols as one number; missing ones count as 0."""
    out = 0
    for i in range(Q):
        out = out << _BITS | (points[i] if i < len(points) else 0)
    return out


def _squeezed(values: np.ndarray, heads: np.ndarray) -> pa.Array:
    """Rows of numbers (of 64 bits, unsigned) as binaries, a row from each head to the next: 7 bits a byte, lowest first."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(7, 64, 7):
        more = values >= np.uint64(1 << k)
        if not more.any():
            break
        size += more
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(at[-1], np.uint8)
    for k in range(size.max()):
        own = np.flatnonzero(size > k)
        low = (values[own] >> np.uint64(7 * k)).astype(np.uint8) & 127
        out[at[own] + k] = low | (size[own] > k + 1).astype(np.uint8) << 7
    offsets = at[np.append(heads, len(values))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _numbers(data: bytes) -> np.ndarray:
    """The numbers of one such row."""
    parts = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(parts < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    shift = 7 * (np.arange(len(parts)) - np.repeat(first, last - first + 1))
    return np.add.reduceat((parts & 127).astype(np.uint64) << shift.astype(np.uint64), first)


def _lists(chunk: list[tuple[int, str]]) -> pa.RecordBatch:
    """The lists of some documents, which must not all be empty."""
    chunk.sort(key=lambda x: x[0])
    ids = np.array([key for key, _ in chunk], np.int64)
    grams = []
    for _, text in chunk:
        s = np.concatenate([np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1, np.zeros(Q - 1, np.int64)])
        grams.append(s[:-2] << 2 * _BITS | s[1:-1] << _BITS | s[2:])
    sizes = np.array([len(g) for g in grams])
    gram, doc = np.concatenate(grams), np.repeat(np.arange(len(ids)), sizes)
    place = np.arange(len(gram)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.argsort(gram, kind="stable")
    gram, doc, place = gram[order], doc[order], place[order]
    new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
    new_doc = new_gram | np.concatenate([[True], doc[1:] != doc[:-1]])
    heads, of_doc = np.flatnonzero(new_gram), np.flatnonzero(new_doc)
    firsts = np.flatnonzero(new_gram[of_doc])
    # ids as unsigned, so that any gap has 64 bits
    own = ids[doc[of_doc]].view(np.uint64)
    before = np.concatenate([own[:1], own[:-1]])
    before[firsts] = ids[:1].view(np.uint64)
    gaps = np.where(new_doc, place, place - np.concatenate([[0], place[:-1]]))
    counts = np.diff(np.append(of_doc, len(gram)))
    of_all = [pa.array(np.full(len(heads), x), pa.int64()) for x in (ids[0], ids[-1])]
    return pa.RecordBatch.from_arrays([pa.array(gram[heads]), *of_all, _squeezed(own - before, firsts), _squeezed(counts, firsts), _squeezed(gaps, heads)], ["gram", "doc_id", "last", "docs", "counts", "places"])


def postings(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """The lists of all documents; built where a document is read, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = [], 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                if chunk and held + len(text) > size:
                    yield _lists(chunk)
                    chunk, held = [], 0
                chunk.append((key.as_py(), text))
                held += len(text)
        if chunk:
            yield _lists(chunk)

    bounded_batches(docs.sparkSession)
    return docs.where(F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(run, _LISTS)


def _unpacked(first: int, row: dict) -> tuple[np.ndarray, np.ndarray]:
    """doc_id and position of each place in a list."""
    n, gaps = _numbers(row["counts"]).astype(np.int64), _numbers(row["places"]).astype(np.int64)
    ids = np.cumsum(_numbers(row["docs"])).view(np.int64) + first
    start, total = np.cumsum(n) - n, np.cumsum(gaps)
    return np.repeat(ids, n), total - np.repeat(total[start] - gaps[start], n)


def _occurrences(offsets: dict[int, list[int]] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (doc_id, each), the lists of a chunk: what all of them share, each moved back by its gram's offsets; without offsets, what any has."""

    def shared(first: int, each: Iterable[dict]) -> pa.RecordBatch | None:
        found = []
        for row in each:
            ids, places = _unpacked(first, row)
            for o in [0] if offsets is None else offsets[row["gram"]]:
                fits = places >= o
                found.append((ids[fits], places[fits] - o))
        docs = np.unique(np.concatenate([ids for ids, _ in found]))
        keys = [np.searchsorted(docs, ids) << 32 | places for ids, places in found]
        if offsets is None:
            key = np.sort(np.concatenate(keys))
        else:
            keys.sort(key=len)  # the shortest first, so that what meets the others stays short
            key = keys[0]
            for other in keys[1:]:
                key = np.intersect1d(key, other, assume_unique=True)
        if not len(key):
            return None
        doc = key >> 32
        heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(key)), pa.int32()), pa.array(key & 0xFFFFFFFF, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(docs[doc[heads]], pa.int64()), lists], ["doc_id", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, each in zip(batch.column(0), batch.column(1)):
                if (out := shared(first.as_py(), each.as_py())) is not None:
                    yield out

    return run


class GramIndex:
    """Searches on a postings table and (doc_id, n_chars); all results are rows, as in ``operators.search``."""

    def __init__(self, grams: DataFrame, sizes: DataFrame) -> None:
        self.grams, self.sizes = grams, sizes

    @classmethod
    def build(cls, corpus: Corpus, path: str, partitions: int | None = None) -> "GramIndex":
        """Write the index under path, a file for each task that reads documents; partitions deals them out first, where tasks are too few or uneven."""
        spark, docs = corpus.spark, corpus.documents.select("doc_id", "text")
        rows = postings(docs.repartition(partitions, "doc_id") if partitions else docs, CHUNK)
        # small row groups, as a search needs few of a file
        rows.sortWithinPartitions("gram", "doc_id").write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(f"{path}/grams")
        corpus.documents.select("doc_id", F.length("text").cast("bigint").alias("n_chars")).write.parquet(f"{path}/sizes")
        write_note(spark, f"{path}/note", {"kind": "grams", "q": Q, "version": 2})
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "GramIndex":
        note = read_note(spark, f"{path}/note")
        if note.get("kind") != "grams" or note.get("q") != Q or note.get("version") != 2:
            raise ValueError(f"{path} holds no index of {Q}-grams")
        return cls(spark.read.parquet(f"{path}/grams"), spark.read.parquet(f"{path}/sizes"))

    def found(self, pattern: str, doc_id: int | None = None) -> DataFrame:
        """(doc_id, positions) of documents that hold a non-empty pattern.

        Grams at offsets 0, 3, 6, ... and the last three characters cover the pattern, so starts that all of
        their lists share are occurrences and no text is read. The only shuffle brings the packed lists of one
        chunk together.
        """
        bounded_batches(self.grams.sparkSession)
        points = [ord(c) + 1 for c in pattern]
        rows = self.grams if doc_id is None else self.grams.where((F.col("doc_id") <= doc_id) & (F.col("last") >= doc_id))
        each, by_gram = F.struct("gram", "docs", "counts", "places"), None
        if len(points) < Q:
            low = pack(points)
            high = low + (1 << _BITS * (Q - len(points)))
            held = rows.where((F.col("gram") >= low) & (F.col("gram") < high))
        else:
            by_gram = {}
            for o in sorted({*range(0, len(points) - Q + 1, Q), len(points) - Q}):
                by_gram.setdefault(pack(points[o : o + Q]), []).append(o)
            held = rows.where(F.col("gram").isin(list(by_gram)))
        if by_gram is not None and len(by_gram) == 1:
            lists = held.select("doc_id", F.array(each).alias("each"))
        else:
            lists = held.groupBy("doc_id").agg(F.collect_list(each).alias("each"))
            lists = lists if by_gram is None else lists.where(F.size("each") == len(by_gram))
        found = lists.mapInArrow(_occurrences(by_gram), "doc_id bigint, positions array<bigint>")
        return found if doc_id is None else found.where(F.col("doc_id") == doc_id)

    def locate(self, pattern: str, doc_id: int | None = None) -> DataFrame:
        if pattern == "":
            rows = self.sizes if doc_id is None else self.sizes.where(F.col("doc_id") == doc_id)
            return rows.select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), "n_chars")).alias("pos"))
        return self.found(pattern, doc_id).select("doc_id", F.explode("positions").alias("pos"))

    def counts(self, pattern: str, doc_id: int | None = None) -> DataFrame:
        if pattern == "":
            rows = self.sizes if doc_id is None else self.sizes.where(F.col("doc_id") == doc_id)
            return rows.select("doc_id", (F.col("n_chars") + 1).alias("n"))
        return self.found(pattern, doc_id).select("doc_id", F.size("positions").cast("bigint").alias("n"))

    def count_all(self, pattern: str) -> DataFrame:
        return self.counts(pattern).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))

    def top_k(self, pattern: str, k: int) -> DataFrame:
        if k <= 0:
            raise ValueError("k must be greater than 0") if k == 0 else OverflowError("k can't be negative")
        return self.counts(pattern).orderBy(F.col("n").desc(), "doc_id").limit(k)

    def containing(self, pattern: str) -> DataFrame:
        return self.counts(pattern).select("doc_id")

    def starting_with(self, prefix: str) -> DataFrame:
        if prefix == "":
            return self.sizes.select("doc_id")
        return self.found(prefix).where(F.array_min("positions") == 0).select("doc_id")

    def ending_with(self, suffix: str) -> DataFrame:
        if suffix == "":
            return self.sizes.select("doc_id")
        last = self.found(suffix).select("doc_id", (F.array_max("positions") + len(suffix)).alias("end"))
        return last.join(self.sizes, "doc_id").where(F.col("end") == F.col("n_chars")).select("doc_id")

    def equal_to(self, text: str) -> DataFrame:
        if text == "":
            return self.sizes.where("n_chars = 0").select("doc_id")
        return self.starting_with(text).join(self.sizes.where(F.col("n_chars") == len(text)), "doc_id").select("doc_id")
