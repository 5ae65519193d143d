"""Global row numbers and running sums without a global window, and joins on keys that may be hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import saved

_ROWS = (1 << 33) - 1
#: A key of more rows than EACH is hot; at most HOT_KEYS are broadcast, so any other has less than EACH rows or 1/HOT_KEYS of them.
EACH, HOT_KEYS = 4096, 10_000


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Add name: 0-based place of each row in the order, which must not leave ties.

    Rows are dealt by ranges of the order, sorted and numbered within a partition, and written; a row for
    each partition, not for each key, is then summed at one place and sent to all.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    table = saved(dealt, "numbered")
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = table.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return table.withColumn("_part", part).join(F.broadcast(sizes), "_part").withColumn(name, F.col("_base") + F.col("_at").bitwiseAND(F.lit(_ROWS))).drop("_part", "_base", "_at")


def running_sum(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Add name: the sum of value over rows with a smaller key, which must not repeat. Dealt as in ``numbered``."""
    table = numbered(df, [key], "_place").withColumn("_b", F.shiftright("_place", 16))
    earlier = lambda spec, of: F.coalesce(F.sum(of).over(spec.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = table.groupBy("_b").agg(F.sum(value).alias("_sum")).select("_b", earlier(Window.orderBy("_b"), "_sum").alias("_base"))
    own = table.withColumn("_own", earlier(Window.partitionBy("_b").orderBy("_place"), value))
    return own.join(blocks, "_b").withColumn(name, F.col("_base") + F.col("_own")).drop("_b", "_base", "_own", "_place")


def lookup(many: DataFrame, one: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join of many rows a key with a saved table of a row a key, whose column n counts those many.

    Hot keys meet by broadcast where their rows stand, and only the others are shuffled. n goes.
    """
    bare = one.drop(n)
    rows = one.where(F.col(n) > EACH).orderBy(F.col(n).desc(), key).limit(HOT_KEYS).drop(n).collect()
    if not rows:
        return many.join(bare, key)
    hot = F.broadcast(one.sparkSession.createDataFrame(rows, bare.schema))
    many = saved(many, "many")
    return many.join(hot, key).unionByName(many.join(hot, key, "left_anti").join(bare, key))
