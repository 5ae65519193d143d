"""Shared plumbing: shared-folder tables, defined inputs, bounded Arrow batches."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# freed batches go back to the system at once; Arrow's own pool would keep the most that a worker ever held
pa.set_memory_pool(pa.system_memory_pool())

#: Bytes of text that an Arrow batch should hold at most (a single longer row still travels whole).
BATCH_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session may go without, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Share of the driver's largest heap from which it is collected whole.
DRIVER_HEAP = 0.5


def trim_driver(spark: SparkSession) -> str:
    """What the C library keeps of the JVM's freed memory goes back to the system; what the JVM says to that, empty where it has no such command."""
    jvm, named = spark._jvm, spark._jvm.java.lang.Class.forName

    def array(kind, *items):
        out = spark.sparkContext._gateway.new_array(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    try:
        # the server's class is closed to py4j, its interface isn't
        kinds = map(named, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"))
        invoke = named("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, *kinds))
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        return invoke.invoke(server, array(jvm.java.lang.Object, commands, "systemTrimNativeHeap", None, None))
    except Py4JError:  # another JVM or C library
        return ""


def relieve(spark: SparkSession) -> None:
    """The driver gives back what many short queries leave behind: garbage that would grow its heap to the limit, and memory that planning and compiling freed."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > DRIVER_HEAP * runtime.maxMemory():
        spark._jvm.java.lang.System.gc()
    trim_driver(spark)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends at a table that outlives executors."""
    path = workspace(df.sparkSession, name)
    # small row groups and pages: what a task holds of a table is bounded by them, in writing and in reading
    df.write.option("parquet.block.size", 8 << 20).option("parquet.page.size", 128 << 10).parquet(path)
    relieve(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._textloom_path = path
    return out


def drop_path(spark: SparkSession, path: str | DataFrame) -> None:
    """Remove a folder of the shared store that no later plan reads."""
    path = getattr(path, "_textloom_path", path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_bounds(spark: SparkSession) -> None:
    """Keep Arrow batches small in bytes, whatever the length of the texts, where Spark has the setting."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)), ("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")):
        try:
            spark.conf.set(key, value)
        except Exception:  # noqa: BLE001  an older Spark: the row bound alone holds
            pass


#: What a worker keeps from task to task, such as a tokenizer and its tables; a task of an operator without use for it drops it.
KEPT: dict = {}


def give_back() -> None:
    """Freed memory goes back to the system, where the C library can do that (glibc); else it stays with the process."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def drop_kept() -> None:
    if KEPT:
        KEPT.clear()
        give_back()


def in_batches(df: DataFrame, run: Callable, schema: str | StructType, keeps: bool = False) -> DataFrame:
    """mapInArrow for a pipeline, in which workers outlive their operators: what run doesn't need (KEPT, unless keeps) is dropped first, and what it freed is given back in the end."""

    def task(batches):
        if not keeps:
            drop_kept()
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def local(spark: SparkSession, table: pa.Table, schema: str) -> DataFrame:
    """A small table of the driver, by Arrow: a list of rows would go through an RDD, for which each executor starts a Python daemon and workers of another kind and keeps them."""
    return spark.createDataFrame(table, schema)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): other columns go, null text is the empty text."""
    arrow_bounds(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the n+1 offsets of its rows (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if off is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        if (np.diff(offsets)[~valid] != 0).any():
            import pyarrow.compute as pc

            return text_buffer(pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b""))
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) with about ``most`` bytes each; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ..., of each range, end to end."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def binary_array(data: np.ndarray | bytes, offsets: np.ndarray) -> pa.Array:
    """A binary column from end-to-end bytes and n+1 offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(data if isinstance(data, bytes) else np.ascontiguousarray(data))])


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key long, doc_id long, text): key is unique and ordered as doc_id.

    It is doc_id itself where that has no nulls or repeats. Otherwise rows are sorted by doc_id
    (null last), then text, and numbered in a table of the shared folder, so that rows that share a
    doc_id count as documents one after another.
    """
    rows = id_and_text(docs, id_col, text_col)
    odd = rows.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count()
    if not odd:
        return rows.select(F.col("doc_id").alias("key"), "doc_id", "text")
    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    ranked = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    return saved(ranked, "keyed")


def merged(cuts: np.ndarray) -> np.ndarray:
    """Union of half-open ranges, as sorted ranges that neither overlap nor touch (n x 2)."""
    if not len(cuts):
        return np.zeros((0, 2), np.int64)
    cuts = cuts[np.argsort(cuts[:, 0], kind="stable")].astype(np.int64)
    reach = np.maximum.accumulate(cuts[:, 1])
    head = np.concatenate([[True], cuts[1:, 0] > reach[:-1]])
    at = np.flatnonzero(head)
    return np.stack([cuts[at, 0], np.append(reach[at[1:] - 1], reach[-1])], axis=1)


def keyed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, row struct, text): key is unique and ordered as doc_id, as in ``keyed``; row holds all columns but text, clear of other names."""
    others = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c.lower() != text_col.lower()]
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.struct(*others).alias("row"), F.col(text_col).cast("string").alias("text"))
    odd = rows.groupBy("key").count().where("key is null or count > 1").limit(1).count()
    if not odd:
        return rows
    order = [F.col("key").asc_nulls_last(), F.coalesce("text", F.lit(""))]
    return saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("key", F.monotonically_increasing_id()), "keyed")


#: Rows of one key that may stand in a task, and keys that are salted at most: any other key holds less than 1/HEAVY_KEYS of all rows.
EACH, HEAVY_KEYS = 128, 10_000


def heavy(df: DataFrame, key: str, each: int = EACH) -> DataFrame | None:
    """(key, _salts) of the keys with most rows, and how many parts of about ``each`` rows to split them into; None without any."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > each)
    rows = counts.orderBy(F.col("_n").desc()).limit(HEAVY_KEYS).select(key, F.ceil(F.col("_n") / each).cast("int").alias("_salts")).toArrow()
    return local(df.sparkSession, rows, f"{key} {df.schema[key].dataType.simpleString()}, _salts int") if rows.num_rows else None


def salted(df: DataFrame, key: str, hot: DataFrame | None, by: str) -> DataFrame:
    """Add _salt, which deals the rows of hot keys by a hash of the column ``by``."""
    if hot is None:
        return df.withColumn("_salt", F.lit(0))
    salt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("_salts"))).cast("int")
    return df.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_salts")


def salted_join(many: DataFrame, one: DataFrame, key: str, by: str, each: int = EACH) -> DataFrame:
    """Inner join of many rows a key with one row a key; a key with very many rows is dealt to many tasks by a hash of ``by``."""
    hot = heavy(many, key, each)
    if hot is None:
        return many.join(one, key)
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)).alias("_salt")
    sent = one.join(F.broadcast(hot), key, "left").select(*one.columns, copies)
    return salted(many, key, hot, by).join(sent, [key, "_salt"]).drop("_salt")


#: Keys that are broadcast at most (about 32 bytes each in an executor).
BROADCAST_KEYS = 2_000_000


def only(rows: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose key is in a saved table of keys (left_anti: is not): by broadcast of the keys while they are few, so that texts aren't shuffled, else by shuffle."""
    keys = keys.select("key")
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "key", how)
