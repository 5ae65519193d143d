"""Suffix order of a corpus, its Burrows-Wheeler transform, and the way back, as tables.

Each document has a suffix at every place and at its end, whose symbol is 0; other symbols are code
point + 1. Equal suffixes of different documents are ordered by doc_id. These tables verify and
teach; searches don't need them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import saved
from .numbering import lookup, numbered, running_sum
from .sequences import run_starts


#: Characters of a suffix that its first key holds.
FIRST = 16


def _starting(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, key, symbol, before) of every place and end: key is the text from there on, FIRST characters at most, and before the symbol ahead of it, 0 at the start."""
    keys = F.regexp_extract_all("text", F.lit(rf"(?s)(?=(.{{0,{FIRST}}}))(?:.|\z)"), F.lit(1))
    both = F.arrays_zip(keys.alias("key"), F.concat(F.array(F.lit("")), keys).alias("ahead"))
    symbol = lambda c: F.when(c == "", 0).otherwise(F.ascii(c) + 1)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(both).alias("pos", "at")).where("at.key is not null")
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("at.key").alias("key"), symbol(F.col("at.key")).alias("symbol"), symbol(F.col("at.ahead")).alias("before"))


def _ordered(docs: DataFrame) -> DataFrame:
    """(sa_rank, doc_id, pos, symbol, before): suffixes of all documents in order, from 0.

    The first order is by the first FIRST characters, which decide all where no suffix has more: bytes of UTF-8 have the
    order of code points, and a text that ends comes before those that go on. Then prefix doubling: after a round, ranks order
    suffixes by twice as many symbols, as the rank of a suffix is followed by that of the suffix as many places on. It ends
    once all ranks of suffixes of one document differ, after log2 of the longest repeat. A rank that many suffixes share is
    no hot key: rows are dealt by rank and place, and the least place of such a rank is broadcast to them.
    """
    placed = numbered(_starting(docs), ["key", "doc_id", "pos"], "place")
    rows = placed.select("doc_id", "pos", "symbol", "before")
    if not placed.where(F.length("key") == FIRST).limit(1).count():
        return placed.select(F.col("place").alias("sa_rank"), "doc_id", "pos", "symbol", "before")
    placed, step, groups = placed.select("doc_id", "pos", "key", "place"), FIRST, -1
    while True:
        # the least place of equal keys is their rank
        least = saved(placed.groupBy("key").agg(F.min("place").alias("rank"), F.count("*").alias("n")), "least")
        ranked = saved(lookup(placed, least, "key", "n").select("doc_id", "pos", "rank", "place"), "ranks")
        found = least.count()
        if found == groups:
            return ranked.join(rows, ["doc_id", "pos"]).select(F.col("place").alias("sa_rank"), "doc_id", "pos", "symbol", "before")
        groups = found
        ahead = ranked.select("doc_id", (F.col("pos") - step).alias("pos"), (F.col("rank") + 1).alias("b"))
        now = ranked.select("doc_id", "pos", "rank").join(ahead, ["doc_id", "pos"], "left").select("doc_id", "pos", F.struct(F.col("rank").alias("a"), F.coalesce("b", F.lit(0).cast("bigint")).alias("b")).alias("key"))
        placed = numbered(now, ["key", "doc_id", "pos"], "place")
        step *= 2


def suffix_array(docs: DataFrame) -> DataFrame:
    """(sa_rank, doc_id, pos, symbol): suffixes of all documents in order, from 0."""
    return _ordered(docs).drop("before")


def transform(docs: DataFrame) -> DataFrame:
    """The rows of ``bwt(suffix_array(docs))``; the symbols ahead come along in the sort, without a join."""
    return _ordered(docs).select("sa_rank", "doc_id", "pos", F.col("before").alias("symbol"))


def document_starts(docs: DataFrame) -> DataFrame:
    """(doc_id, start): place of each document's first symbol where all stand one after another by doc_id, each with its end's symbol."""
    lengths = docs.where(F.col("text").isNotNull()).select("doc_id", (F.length("text") + 1).cast("bigint").alias("n"))
    return running_sum(lengths, "doc_id", "n", "start").select("doc_id", "start")


def bwt(suffixes: DataFrame) -> DataFrame:
    """(sa_rank, doc_id, pos, symbol): of each suffix the symbol before it, 0 where it is the whole document."""
    before = suffixes.select("doc_id", (F.col("pos") + 1).alias("pos"), F.col("symbol").alias("before"))
    return suffixes.select("sa_rank", "doc_id", "pos").join(before, ["doc_id", "pos"], "left").select("sa_rank", "doc_id", "pos", F.coalesce("before", F.lit(0)).alias("symbol"))


def c_table(transform: DataFrame) -> DataFrame:
    """(symbol, n, less): how often each symbol stands in the transform, and all smaller ones."""
    return run_starts(transform.select(F.col("symbol").cast("bigint").alias("value"))).select(F.col("value").cast("int").alias("symbol"), "n", "less")


def lf_mapping(transform: DataFrame) -> DataFrame:
    """(sa_rank, lf): rank of the suffix one place longer; a whole document leads to its end's suffix, which ranks by doc_id.

    That is the place of a row in the order by symbol, then rank.
    """
    return _mapped(transform).select("sa_rank", "lf")


def _mapped(transform: DataFrame) -> DataFrame:
    """(sa_rank, symbol, lf), read from a saved table."""
    tie = F.when(F.col("symbol") == 0, F.col("doc_id")).otherwise(F.col("sa_rank"))
    return numbered(transform.select("sa_rank", "symbol", tie.alias("tie")), ["symbol", "tie"], "lf").drop("tie")


def inverse(transform: DataFrame) -> DataFrame:
    """(doc, text) from (sa_rank, symbol) and the mapping alone; doc is the place of a document by doc_id.

    Pointers jump twice as far in each round until they reach the whole document, as many steps away as
    a suffix has places before it. Rows that are there point to the document's number and wait aside, so no two others
    share a target; a text is put together from blocks of its characters.
    """
    end = F.col("symbol") == 0
    # what leads on from a whole document is its end's suffix, and those come first, by doc_id
    now = _mapped(transform).select("sa_rank", "symbol", F.col("lf").alias("to"), F.when(end, 0).otherwise(1).cast("bigint").alias("steps"), end.alias("there"))
    while True:
        now = saved(now, "jumps")
        going = now.where(~F.col("there"))
        if not going.limit(1).count():
            break
        other = now.select(F.col("sa_rank").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("there").alias("_there"))
        jumped = going.join(other, "to").select("sa_rank", "symbol", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("_there").alias("there"))
        now = now.where("there").unionByName(jumped)
    each = now.select(F.col("to").alias("doc"), F.shiftright("steps", 12).alias("block"), "steps", (F.col("symbol") - 1).alias("code"))
    ordered = lambda key, of: F.array_sort(F.collect_list(F.struct(key, of)))
    coded = F.transform(ordered("steps", "code"), lambda x: F.when(x.code >= 0, F.lpad(F.hex(x.code), 8, "0")).otherwise(""))
    blocks = each.groupBy("doc", "block").agg(F.array_join(coded, "").alias("codes"))
    # a byte order mark in front, or a text's own would go
    blocks = blocks.select("doc", "block", F.expr("decode(unhex(concat('0000FEFF', codes)), 'UTF-32')").alias("part"))
    return blocks.groupBy("doc").agg(F.array_join(F.transform(ordered("block", "part"), lambda x: x.part), "").alias("text"))
