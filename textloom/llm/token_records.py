"""Length-delimited binary records of token ids, with a separate offset index.

A file is a run of frames, in ascending doc_id order over all files of a data set::

    u64 length | u32 masked crc of those 8 bytes | payload | u32 masked crc of the payload | 0x0A
    payload: u8 flags (1: doc_id is null) | u8 bytes per id (2 or 4) | i64 doc_id | ids, little-endian

A checksum is CRC-32 rotated right by 15 bits plus 0xA282EAD8, so that a checksum stored within
checksummed data does no harm. The files go through Spark's own text sink, a run of frames as a line
(its line end is the last frame's last byte), so any Hadoop file system holds them and a task that is
lost is written again. A file has RUNS runs of about RUN_BYTES at most, as a reader holds it whole; a longer
frame is a run of its own.
The index has a row for each frame: file, byte offset and length, document, count of ids and ids
before it in the file. With it a reader fetches records in any order.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binary_array, id_and_text, saved, slices, text_buffer, workspace
from .wordbpe import SLICE, loaded

#: Bytes of a run of frames, about, and runs of a file at most: 32 MB, unless documents of more than a run are among them.
RUN_BYTES, RUNS = 1 << 20, 32
#: Rows of an index that a worker gives at a time.
ROWS = 20_000
_HEAD, _PAYLOAD, _END = struct.Struct("<QI"), struct.Struct("<BBq"), struct.Struct("<I")


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record; ids are uint16 where all fit, else uint32."""
    kind = "<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4"
    payload = _PAYLOAD.pack(doc_id is None, int(kind[-1]), doc_id or 0) + ids.astype(kind).tobytes()
    size = struct.pack("<Q", len(payload))
    return size + _END.pack(masked(zlib.crc32(size))) + payload + _END.pack(masked(zlib.crc32(payload))) + b"\n"


def frames(data: bytes | memoryview) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, length, doc_id, ids) of each frame of a file; ValueError on damage."""
    at, data = 0, memoryview(data)
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError(f"record at byte {at} is cut short")
        n, crc = _HEAD.unpack_from(data, at)
        if crc != masked(zlib.crc32(data[at : at + 8])):
            raise ValueError(f"length of the record at byte {at} is damaged")
        end = at + 12 + n
        if end + 5 > len(data):
            raise ValueError(f"record at byte {at} is cut short")
        if _END.unpack_from(data, end)[0] != masked(zlib.crc32(data[at + 12 : end])):
            raise ValueError(f"record at byte {at} is damaged")
        null, width, doc_id = _PAYLOAD.unpack_from(data, at + 12)
        yield at, end + 5 - at, None if null else doc_id, np.frombuffer(data[at + 12 + _PAYLOAD.size : end], f"<u{width}")
        at = end + 5


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the records under path, in ascending doc_id order.

    A null text counts as empty; an empty text still gets a record with its end id; a null doc_id
    sorts first; rows that share a doc_id all stay, in the order of their texts; an empty table
    gives no frames. Other columns play no part. The only shuffle deals documents by doc_id ranges.
    """

    def encode(batches):
        bpe = loaded(tokenizer)
        waiting, size = [], 0

        def run():
            # the sink ends the line with the last frame's last byte
            data = b"".join(waiting)[:-1]
            return pa.RecordBatch.from_arrays([binary_array(data, np.array([0, len(data)]))], ["run"])

        for batch in batches:
            _, off = text_buffer(batch.column(1))
            for a, b in slices(off, SLICE):
                ids, bounds = bpe.encode(batch.column(1).slice(a, b - a))
                keys = batch.column(0).slice(a, b - a).to_pylist()
                tail = np.array([] if end_id is None else [end_id], ids.dtype)
                for i, key in enumerate(keys):
                    made = frame(key, np.concatenate([ids[bounds[i] : bounds[i + 1]], tail]).astype(np.uint32))
                    if waiting and size + len(made) > RUN_BYTES:
                        yield run()
                        waiting, size = [], 0
                    waiting.append(made)
                    size += len(made)
        if waiting:
            yield run()

    rows = id_and_text(docs, id_col, text_col).repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(encode, "run binary").select(F.col("run").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", RUNS).text(path)


INDEX = "file string, shard long, offset long, n_bytes long, doc_id long, n_tokens long, ids_before long, ids_crc32 long"


def index_of(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back, check every checksum, and give the offset index (columns INDEX)."""

    def read(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                part, piece = re.search(r"part-(\d+).*?(?:-c(\d+))?(?:\.\w+)*$", name).groups()
                shard, rows, before = int(part) << 20 | int(piece or 0), [], 0
                for at, n, doc_id, ids in frames(data.as_buffer()):
                    rows.append((at, n, doc_id, len(ids), before, zlib.crc32(ids.astype("<u4").tobytes())))
                    before += len(ids)
                    if len(rows) == ROWS:
                        yield index_rows(name, shard, rows)
                        rows = []
                if rows:
                    yield index_rows(name, shard, rows)

    def index_rows(name, shard, rows):
        cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([shard] * len(rows), pa.int64()), *cols], [x.split()[0] for x in INDEX.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, INDEX)


def with_start(index: DataFrame) -> DataFrame:
    """Add start: ids of all documents before. What is summed at one place is a row for each file."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return index.join(files, "shard").withColumn("start", F.col("base") + F.col("ids_before")).drop("base")


def read_ids(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """(doc_id, ids) of the records in index, in whatever order and choice its rows have; rows that repeat are read again.

    A null doc_id stays null, a document without ids (written without an end id) has an empty list, and an empty index gives no rows.
    """

    def fetch(batches):
        for batch in batches:
            for data, want in zip(batch.column(0), batch.column(1).to_pylist()):
                body = data.as_buffer()
                for a in range(0, len(want), 1000):
                    got = [next(frames(memoryview(body)[w["offset"] : w["offset"] + w["n_bytes"]])) for w in want[a : a + 1000]]
                    yield pa.RecordBatch.from_arrays([pa.array([g[2] for g in got], pa.int64()), pa.array([g[3].tolist() for g in got], pa.list_(pa.int32()))], ["doc_id", "ids"])

    wanted = index.groupBy("file").agg(F.collect_list(F.struct("offset", "n_bytes")).alias("want"))  # of one file each
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    return files.join(wanted, "file").select("content", "want").mapInArrow(fetch, "doc_id long, ids array<int>")


def token_records(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int | None = 1) -> DataFrame:
    """Write records and index under path, and return the index with start, read from the files."""
    spark = docs.sparkSession
    path = path or workspace(spark, "records")
    write_records(docs, f"{path}/data", tokenizer, end_id)
    return with_start(saved(index_of(spark, f"{path}/data"), "record-index"))
