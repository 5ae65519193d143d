"""Vector best-fit packing of token pieces into sequences.

Capacities are a vector: tokens, documents and attention cost (the sum of squared piece lengths) of
a sequence. All three have a weight in the choice of a bin. A piece's demand, (length, 1, length squared),
depends on its length alone, so the packing is planned over the histogram of lengths, which has at
most ``capacity`` rows for any corpus: pieces in decreasing length, each group of equal pieces into
the open bins with room under every capacity that have the best score, else into new bins. Bins with
the same residual vector are planned as one class. The plan maps ranges of ranks within a length to
ranges of sequences, and pieces find their place by a join on length and block of ranks; no piece
ever comes to the driver.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, in_batches, local, saved, slices, text_buffer
from .wordbpe import SLICE, loaded

#: Plan rows that may be broadcast (about 50 bytes each); a larger plan is joined by shuffle.
BROADCAST_ROWS = 500_000
#: Ranks of a length that meet the plan in one place.
BLOCK = 1024


@dataclass(frozen=True)
class Capacity:
    """Limits of a sequence, and the weights of their residuals in the score.

    rule "norm" takes the bins of least weighted residual norm after the piece is in; "dot" those of
    greatest weighted dot product of residual and demand. Without a limit of documents or attention
    cost, their capacity is what as many tokens can need at most: each piece has a token, and one
    piece alone costs the square of all tokens.
    """

    tokens: int = 4096
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.25, 0.25)
    rule: str = "norm"

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)


def pieces(docs: DataFrame, tokenizer: str, most: int = 4096, end_id: int | None = 1, with_ids: bool = False) -> DataFrame:
    """Encode whole texts and cut those of more than ``most`` ids: doc_id, piece, start, length, ids_crc32 (and ids).

    A null text is empty: it has its end id alone (without end_id, no piece). Repeated rows and
    null doc_ids stay; other columns play no part.
    """

    def run(batches):
        bpe = loaded(tokenizer)
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        for batch in batches:
            _, off = text_buffer(batch.column(1))
            for a, b in slices(off, SLICE):
                ids, bounds = bpe.encode(batch.column(1).slice(a, b - a))
                rows = []
                for i, key in enumerate(batch.column(0).slice(a, b - a).to_pylist()):
                    own = np.concatenate([ids[bounds[i] : bounds[i + 1]], tail]).astype("<u4")
                    for at in range(0, len(own), most):
                        part = own[at : at + most]
                        rows.append((key, at // most, at, len(part), zlib.crc32(part.tobytes()), part.tobytes() if with_ids else None))
                if rows:
                    cols = list(zip(*rows))
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return in_batches(id_and_text(docs), run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids, keeps=True)


def plan(counts: dict[int, int], capacity: Capacity = Capacity()) -> list[tuple[int, int, int, int, int]]:
    """Place counts[length] pieces of each length: rows (length, from_rank, to_rank, sequence, offset).

    Piece r of a length, from_rank <= r < to_rank, goes to sequence + r - from_rank, at offset.
    """
    cap = capacity.vector()
    weights = np.array(capacity.weights, float)
    room = np.zeros((64, 3), np.int64)  # residual vectors of the classes of open bins
    bins: list[list[tuple[int, int]]] = []  # of each class: ranges (first sequence, how many)
    index: dict[tuple[int, ...], int] = {}
    out: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(residual: np.ndarray, first: int, n: int) -> None:
        nonlocal room
        key = tuple(residual.tolist())
        if residual.min() <= 0:
            return  # closed: no piece fits
        if (at := index.get(key)) is None:
            at = index[key] = len(bins)
            bins.append([])
            if at == len(room):
                room = np.concatenate([room, np.zeros_like(room)])
            room[at] = residual
        if not bins[at]:
            room[at] = residual
        bins[at].append((first, n))

    def fill(length: int, rank: int, residual: np.ndarray, first: int, n: int, each: int) -> int:
        """Each of n bins takes ``each`` pieces; the next rank."""
        for j in range(each):
            out.append((length, rank, rank + n, first, int(cap[0] - residual[0]) + j * length))
            rank += n
        put(residual - each * np.array([length, 1, length * length]), first, n)
        return rank

    for length in sorted(counts, reverse=True):
        demand = np.array([length, 1, length * length], np.int64)
        if length > cap[0] or (demand > cap).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        left, rank = counts[length], 0
        while left:
            fits = np.flatnonzero((room[: len(bins)] >= demand).all(axis=1))
            if not len(fits):
                each = int((cap // demand).min())
                n = left // each
                if n:
                    rank = fill(length, rank, cap, opened, n, each)
                    opened += n
                    left -= n * each
                if left:
                    rank = fill(length, rank, cap, opened, 1, left)
                    opened += 1
                    left = 0
                continue
            share = room[fits] / cap
            if capacity.rule == "dot":
                best = fits[np.argmax((weights * share * (demand / cap)).sum(axis=1))]
            else:
                best = fits[np.argmin((weights * (share - demand / cap) ** 2).sum(axis=1))]
            residual = room[best].copy()
            each = int((residual // demand).min())
            first, n = bins[best].pop()
            use = min(n, left // each)
            if not use:
                use, each = 1, left
            if use < n:
                bins[best].append((first + use, n - use))
            if not bins[best]:
                room[best] = -1
            rank = fill(length, rank, residual, first, use, each)
            left -= use * each
    return out


def pack(found: DataFrame, capacity: Capacity = Capacity(), order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add sequence_id and offset to a table of pieces, which needs a column ``length`` and the order columns.

    Other columns stay, but for columns named sequence_id or offset, which the new ones replace. Pieces
    of no length, or of null length, aren't allowed (ValueError), nor longer ones than a capacity; an empty table gives an empty result. Rows
    that tie in order take each other's places, never the same one.
    """
    spark = found.sparkSession
    stay = [c for c in found.columns if c.lower() not in ("sequence_id", "offset")]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = found.select(F.struct(*map(quoted, stay)).alias("row"), quoted("length").cast("long").alias("length"), *(quoted(c).alias(f"o{i}") for i, c in enumerate(order)))
    order = tuple(f"o{i}" for i in range(len(order)))
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    counts = saved(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "length-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity.tokens rows
    if any(length is None or length < 1 for length in histogram):
        raise ValueError("a piece has no length")
    planned = plan(histogram, capacity)
    columns = [F.col("row").getField(c).alias(c) for c in stay]
    if not planned:
        return rows.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy(*order)
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(bases, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    names = ["length", "from", "to", "sequence", "offset"]
    places = local(spark, pa.table([pa.array(c, pa.int64()) for c in zip(*planned)], names), ", ".join(f"{c} long" for c in names))
    places = places.withColumn("block", F.explode(F.expr(f"sequence(from div {BLOCK}, (to - 1) div {BLOCK})")))
    if sum((to - 1) // BLOCK - first // BLOCK + 1 for _, first, to, _, _ in planned) <= BROADCAST_ROWS:
        places = F.broadcast(places)
    ranked = ranked.withColumn("block", F.expr(f"rank div {BLOCK}"))
    at = (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to"))
    met = ranked.join(places, ["length", "block"]).where(at)
    return met.select(*columns, (F.col("sequence") + F.col("rank") - F.col("from")).alias("sequence_id"), F.col("offset").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids array<int>) of packed pieces that carry ids; a group is one sequence, of bounded length.

    Pieces whose ids are null add none; an empty table gives an empty result; other columns play no part.
    """

    def run(key, rows):
        import pandas as pd

        ids = np.concatenate([np.frombuffer(x, "<u4") for x in rows.sort_values("offset")["ids"] if x is not None] or [np.zeros(0, "<u4")]).astype(np.int32)
        return pd.DataFrame({"sequence_id": [key[0]], "ids": [ids]})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(run, "sequence_id long, ids array<int>")
