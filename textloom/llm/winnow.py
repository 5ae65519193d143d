"""Windows that repeat across a corpus, found through content-defined anchors.

A window of L symbols has w = L-k+1 runs of k symbols; its anchor is the run with the least hash (the
leftmost of ties). Equal windows have equal anchors at the same place, so windows need only be
compared where their anchors are equal. Consecutive windows with the same anchor form a piece: the
anchor's own range of window starts. There are about 2/(w+1) pieces a symbol, and each window
belongs to exactly one.

Steps, for documents with unique ordered keys:

1. Each batch finds its pieces and sends (anchor hash, piece hash, key, place) to the anchor's bucket
   in packed arrays; of pieces that are equal within the batch only the first is compared further.
2. Buckets are sorted one after another in their tasks. A piece that equals an earlier one (by both
   64-bit hashes) is cut whole. Where an anchor has several different pieces, the first of each is asked for.
3. Documents meet what was found for them; those asked for give the symbols of their pieces.
4. Pieces of one anchor meet again and a solver (suffix array, suffix automaton) finds windows that
   they share.
5. An anchor with more than MOST different pieces (the edge of a passage that very many documents hold) is
   split by what stands around it: windows with the anchor at about the same offset, and with equal
   symbols in all that such windows have in common, make a part. Parts of at most MOST different pieces
   go to the solver, others are split finer, down to single windows; equal pieces are cut on the way, by their symbols.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_array, in_batches, keyed, merged, ranges, salted_join, saved, slices, text_buffer

#: Different pieces of one anchor that are solved together at most, and offsets of the anchor that a part of more has, coarse to fine.
MOST, WIDTHS = 512, (16, 4, 1)
#: Buckets of a task, each sorted on its own.
BUCKETS = 4
#: Pieces that a worker gathers before it gives them.
PIECES = 5000
_rng = np.random.default_rng(20240607)
TABLE = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^0 .. P^n and their inverses modulo 2^64."""
    if len(_powers[0]) <= n:
        for at, base in enumerate((_P, _INV)):
            steps = np.full(n + 1 + (n >> 2), base, np.uint64)
            steps[0] = 1
            _powers[at] = np.multiply.accumulate(steps)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix(symbols: np.ndarray) -> np.ndarray:
    """Sums of symbol j times P^j up to each place: the base of hashes of any range."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(len(symbols))[0][:-1], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[start]) * powers(len(sums) - 1)[1][start]


def slide(a: np.ndarray, w: int, op) -> np.ndarray:
    """op over each w consecutive values."""
    n, span, out = len(a) - w + 1, 1, a
    while span * 2 <= w:
        out = op(out[:-span], out[span:])
        span *= 2
    return op(out[:n], out[w - span : w - span + n]) if span < w else out[:n]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (white space: 0x20, 0x09-0x0D), and each document's first word (n+1)."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~space
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a word ends with its document
    before = inside[:-1].astype(bool)
    here = inside[1:].astype(bool)
    starts = np.flatnonzero(here & (~before | first))
    ends = np.flatnonzero(before & (~here | first))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(range_hash(prefix(TABLE[data]), starts, ends) + (ends - starts).astype(np.uint64)) | np.uint64(1)


def anchors(symbols: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """Pieces of documents laid end to end: document, anchor place, first and last window start, two hashes."""
    n, w = len(symbols), length - k + 1
    nothing = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    windows = n - length + 1
    if windows < 1:
        return nothing
    sums = prefix(symbols)
    at = np.arange(n - k + 1)
    h = mix(range_hash(sums, at, at + k)) | np.uint64(1)
    least = slide(h, w, np.minimum)
    change = np.zeros(n + 1, np.int32)
    full = np.diff(offsets) >= length
    np.add.at(change, offsets[:-1][full], 1)
    np.add.at(change, offsets[1:][full] - length + 1, -1)
    least[np.cumsum(change[:windows]) == 0] = 0
    around = np.zeros(windows + 2 * (w - 1), np.uint64)
    around[w - 1 : w - 1 + windows] = least
    place = np.flatnonzero(h == slide(around, w, np.maximum))
    if not len(place):
        return nothing
    run = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    run_end = np.append(run[1:], windows) - 1
    mine = np.searchsorted(run, np.minimum(place, windows - 1), side="right") - 1
    value = h[place]
    while len(off := np.flatnonzero(least[run[mine]] != value)):
        mine[off] -= 1
    lo = np.maximum(run[mine], place - w + 1)
    same = np.flatnonzero(mine[1:] == mine[:-1]) + 1
    lo[same] = np.maximum(lo[same], place[same - 1] + 1)
    hi = np.minimum(run_end[mine], place)
    keep = lo <= hi
    place, lo, hi, value = place[keep], lo[keep], hi[keep], value[keep]
    whole = mix(range_hash(sums, lo, hi + length) * np.uint64(0xD6E8FEB86659FD93) + ((place - lo) * 4096 + hi - lo).astype(np.uint64))
    return np.searchsorted(offsets, place, side="right") - 1, place, lo, hi, value, whole


class Unit:
    """What documents are sequences of: bytes or words."""

    def __init__(self, kind: str, length: int, k: int, earlier_document: bool) -> None:
        self.kind, self.length, self.k = kind, length, k
        #: True: a window is cut if an earlier document has it; False: if it starts anywhere earlier.
        self.earlier_document = earlier_document

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "bytes":
            return TABLE[data], offsets
        starts, ends, bounds = words_of(data, offsets)
        return word_hashes(data, starts, ends), bounds

    def sequence(self, text: bytes):
        return text if self.kind == "bytes" else text.split()

    def joined(self, seq) -> bytes:
        return bytes(seq) if self.kind == "bytes" else b" ".join(seq)


_COLUMNS = (("h", "<u8"), ("ph", "<u8"), ("key", "<i8"), ("lo", "<u4"), ("a", "u1"), ("n", "<u2"), ("cut", "u1"))


def _packed(cols: dict[str, np.ndarray]) -> bytes:
    return b"".join(cols[c].astype(t).tobytes() for c, t in _COLUMNS)


def _unpacked(data: memoryview) -> dict[str, np.ndarray]:
    size = sum(np.dtype(t).itemsize for _, t in _COLUMNS)
    n, at, out = len(data) // size, 0, {}
    for c, t in _COLUMNS:
        out[c] = np.frombuffer(data, t, n, at)
        at += n * np.dtype(t).itemsize
    return out


def repeats_earlier(h, ph, key, lo, by_document: bool) -> tuple[np.ndarray, np.ndarray]:
    """Order by (h, ph, key, lo); in that order, whether a piece is cut whole as an equal one comes earlier."""
    order = np.lexsort((lo, key, ph, h))
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (ph[order][1:] != ph[order][:-1])]) if len(order) else np.zeros(0, bool)
    if not by_document:
        return order, ~new
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order, key[order] > key[order][first]


def find(docs: DataFrame, unit: Unit, buckets: int) -> DataFrame:
    """(bucket, data): packed pieces of every document."""

    def run(batches):
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            got = []
            for a, b in slices(off, 1 << 20):
                symbols, bounds = unit.symbols(data[off[a] : off[b]], off[a : b + 1] - off[a])
                doc, place, lo, hi, h, ph = anchors(symbols, bounds, unit.length, unit.k)
                got.append((h, ph, keys[a:b][doc], lo - bounds[doc], place - lo, hi - lo + 1))
            h, ph, key, lo, a, n = (np.concatenate(x) for x in zip(*got)) if got else [np.zeros(0, np.uint64)] * 6
            if not len(h):
                continue
            order, cut = repeats_earlier(h, ph, key, lo, unit.earlier_document)
            cols = {"h": h, "ph": ph, "key": key, "lo": lo, "a": a, "n": n}
            cols = {c: v[order] for c, v in cols.items()} | {"cut": cut}
            bucket = (np.where(cut, mix(cols["key"].astype(np.uint64)), cols["h"] >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((cols["lo"], cols["key"], bucket))
            cols, bucket = {c: v[order] for c, v in cols.items()}, bucket[order]
            heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            blobs = [_packed({c: v[s:e] for c, v in cols.items()}) for s, e in zip(heads, np.append(heads[1:], len(bucket)))]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[heads], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "data"])

    return in_batches(docs.select("key", "text"), run, "bucket long, data binary")


def matched(found: DataFrame, unit: Unit, buckets: int, most: int) -> DataFrame:
    """(key, cuts, needs): ranges to cut, and pieces asked for, of each document that has any."""
    need_type = _NEED

    def run(batches):
        held, last = [], None
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if held and bucket != last:
                    yield from one(held)
                    held = []
                held.append(data.as_buffer())
                last = bucket
        if held:
            yield from one(held)

    def one(blobs):
        parts = [_unpacked(x) for x in blobs]
        cols = {c: np.concatenate([p[c] for p in parts]) for c, _ in _COLUMNS}
        del parts
        sent = cols["cut"].astype(bool)
        live = {c: v[~sent] for c, v in cols.items()}
        order, cut = repeats_earlier(live["h"], live["ph"], live["key"], live["lo"], unit.earlier_document)
        live = {c: v[order] for c, v in live.items()}
        h, ph = live["h"], live["ph"]
        new_h = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        new_ph = new_h | np.concatenate([[True], ph[1:] != ph[:-1]]) if len(h) else new_h
        group = np.cumsum(new_h) - 1
        kinds = np.bincount(group, new_ph)[group] if len(h) else np.zeros(0)
        want = (kinds > 1) & ~cut
        held = np.bincount(group, want)[group] if len(h) else np.zeros(0)
        needs = np.zeros(int(want.sum()), need_type)
        needs["h"], needs["lo"], needs["n"], needs["a"], needs["big"] = h[want], live["lo"][want], live["n"][want], live["a"][want], held[want] > most
        start = np.concatenate([cols["lo"][sent], live["lo"][cut]]).astype(np.uint32)
        end = start + np.concatenate([cols["n"][sent], live["n"][cut]]) + np.uint32(unit.length - 1)
        cut_key, need_key = np.concatenate([cols["key"][sent], live["key"][cut]]), live["key"][want]
        o = np.argsort(cut_key, kind="stable")
        cut_key, cuts = cut_key[o], np.stack([start[o], end[o]], axis=1).astype("<u4")
        o = np.argsort(need_key, kind="stable")
        need_key, needs = need_key[o], needs[o]
        keys = np.union1d(cut_key, need_key)
        at = lambda k, size: np.append(np.searchsorted(k, keys), len(k)) * size
        for s in range(0, len(keys), 50_000):
            e = min(len(keys), s + 50_000)
            cells = []
            for data, bounds in ((cuts, at(cut_key, 8)[s : e + 1]), (needs, at(need_key, need_type.itemsize)[s : e + 1])):
                cells.append(binary_array(data.tobytes()[bounds[0] : bounds[-1]], bounds - bounds[0]))
            yield pa.RecordBatch.from_arrays([pa.array(keys[s:e], pa.int64()), *cells], ["key", "cuts", "needs"])

    tasks = max(1, buckets // BUCKETS)
    return in_batches(found.repartition(tasks, "bucket").sortWithinPartitions("bucket"), run, "key long, cuts binary, needs binary")


_NEED = np.dtype([("h", "<u8"), ("lo", "<u4"), ("n", "<u2"), ("a", "u1"), ("big", "u1")])


def as_cuts(parts: list[bytes] | None) -> np.ndarray:
    return merged(np.frombuffer(b"".join(parts), "<u4").reshape(-1, 2)) if parts else np.zeros((0, 2), np.int64)


def cut_windows(docs: DataFrame, unit: Unit, solve: Callable, finish: Callable, columns: str, most: int = MOST, ahead: Callable | None = None) -> DataFrame:
    """Cut every window that occurs earlier, and give finish(sequence, cuts) for each document (columns, beside doc_id).

    solve(list of (anchor, key, lo, piece)) gives (key, start, end) to cut, for the pieces of whole anchors. ahead, if given,
    takes the table of pieces of large anchors first and gives (key, cuts, rest): what it cuts, and the pieces left to compare.
    """
    spark = docs.sparkSession
    rows = keyed(docs)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = tasks * BUCKETS
    found = matched(find(rows, unit, buckets), unit, buckets, most)
    by_key = found.groupBy("key").agg(F.collect_list("cuts").alias("cuts"), F.collect_list("needs").alias("needs"))
    names = [c.split()[0] for c in columns.split(", ")]
    schema = "key long, doc_id long, text string, cuts binary, h long, lo long, a long, big boolean, piece binary, " + columns

    def first(batches):
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}

            def put(**row):
                for c, v in out.items():
                    v.append(row.get(c))

            for key, doc_id, text, cuts, needs in zip(*(batch.column(i).to_pylist() if i != 2 else batch.column(i) for i in range(5))):
                if len(out["key"]) >= PIECES:
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)
                    out = {c: [] for c in out}
                body = text.as_buffer().to_pybytes()
                seq = unit.sequence(body)
                cuts = as_cuts(cuts)
                needs = np.frombuffer(b"".join(needs), _NEED) if needs else ()
                if not len(needs):
                    put(key=key, doc_id=doc_id, **dict(zip(names, finish(seq, cuts))))
                    continue
                put(key=key, doc_id=doc_id, text=text.as_py(), cuts=cuts.astype("<u4").tobytes())
                for i, (h, lo, n, a, big) in enumerate(needs.tolist(), 1):
                    if i % PIECES == 0:
                        yield pa.RecordBatch.from_pydict(out, schema=arrow)
                        out = {c: [] for c in out}
                    put(key=key, h=h - (1 << 64) if h >> 63 else h, lo=lo, a=a, big=bool(big), piece=unit.joined(seq[lo : lo + n + unit.length - 1]))
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    arrow = _arrow(schema)
    stage = saved(in_batches(rows.join(by_key, "key", "left").select("key", "doc_id", "text", "cuts", "needs"), first, schema), "windows")
    done = stage.where("piece is null and text is null").select("doc_id", *names)
    pieces = stage.where("piece is not null").select("h", "key", "lo", "a", "big", "piece")
    small, cuts = pieces.where("not big").drop("big"), []
    large = pieces.where("big").drop("big")
    if large.limit(1).count():
        if ahead:
            large = saved(ahead(large), "ahead")
            cuts.append(large.where("cuts is not null").select("key", "cuts"))
            large = large.where("piece is not null").drop("cuts")
        for width in WIDTHS:
            cut, parts = split(large, unit, width)
            cuts.append(cut)
            small, large = small.unionByName(parts.where(F.col("n") <= most).drop("n")), parts.where(F.col("n") > most).drop("n")

    def solved(batches):
        for group in whole_groups(batches, 0, 1 << 18):
            got = solve(list(zip(group["h"], group["key"], group["lo"], group["piece"])))
            if got:
                keys, starts, ends = zip(*got)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([np.array(x, "<u4").tobytes() for x in zip(starts, ends)], pa.binary())], ["key", "cuts"])

    near = in_batches(small.select("h", "key", "lo", "piece").repartition(tasks, "h").sortWithinPartitions("h", "key", "lo"), solved, "key long, cuts binary")
    for cut in cuts:
        near = near.unionByName(cut)
    extra = near.groupBy("key").agg(F.collect_list("cuts").alias("more"))

    def last(batches):
        for batch in batches:
            out = []
            for doc_id, text, cuts, more in zip(*(batch.column(i).to_pylist() if i != 1 else batch.column(i) for i in range(4))):
                out.append((doc_id, *finish(unit.sequence(text.as_buffer().to_pybytes()), as_cuts([cuts, *(more or [])]))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), final.types)], schema=final)

    final = _arrow("doc_id long, " + columns)
    rest = in_batches(stage.where("text is not null").join(extra, "key", "left").select("doc_id", "text", "cuts", "more"), last, "doc_id long, " + columns)
    return done.unionByName(rest)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])


def whole_groups(batches, column: int, most: int) -> Iterator[dict[str, list]]:
    """Rows sorted by a column, as lists: whole groups together, cut where about ``most`` bytes have gathered."""
    held: dict[str, list] = {}
    size = 0
    for batch in batches:
        cols = batch.to_pydict()
        for i in range(batch.num_rows):
            row = {c: v[i] for c, v in cols.items()}
            name = batch.schema.names[column]
            if held and size >= most and held[name][-1] != row[name]:
                yield held
                held, size = {}, 0
            for c, v in row.items():
                held.setdefault(c, []).append(v)
            size += len(row["piece"])
    if held:
        yield held


def _ranges_of(key: str, start, end) -> list:
    """Columns (key, cuts) of one range each; four bytes a number, least first."""
    digits = lambda c: F.lpad(F.hex(c), 8, "0")
    le = lambda c: F.unhex(F.concat(*(F.substring(digits(c), at, 2) for at in (7, 5, 3, 1))))
    return [F.col(key).alias("key"), F.concat(le(start), le(end)).alias("cuts")]


def split(pieces: DataFrame, unit: Unit, width: int) -> tuple[DataFrame, DataFrame]:
    """Pieces (h, key, lo, a, piece) of large anchors in parts: (key, cuts) of parts' pieces that equal an earlier one, and the first of each with n, the different pieces of its part.

    The anchor stands a symbols behind a piece's start, so it is at offset a - i of window i. Windows
    whose offsets fall in one range of ``width`` all hold the same symbols around the anchor, the core, if they
    are equal; a part's name is the hash of anchor, range and core. Cores of width 1 are whole windows.
    """

    def parts(batches):
        for batch in batches:
            out: list[tuple] = []
            for h, key, lo, a, piece in zip(*(c.to_pylist() for c in batch.columns)):
                seq = unit.sequence(piece)
                n = len(seq) - unit.length + 1
                for j in range(max(0, a - n + 1) // width, a // width + 1):
                    first, last = max(0, a - (j + 1) * width + 1), min(n - 1, a - j * width)
                    if first > last:
                        continue
                    core = unit.joined(seq[a - j * width : a - (j + 1) * width + 1 + unit.length])
                    name = hashlib.blake2b(h.to_bytes(8, "little", signed=True) + bytes([width, j]) + core, digest_size=8).digest()
                    own = unit.joined(seq[first : last + unit.length])
                    out.append((name + own, key, lo + first, a - first, len(own) if unit.kind == "bytes" else last + unit.length - first))
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    names, kinds = ["id", "key", "lo", "a", "size"], [pa.binary(), *[pa.int64()] * 4]
    rows = saved(in_batches(pieces.select("h", "key", "lo", "a", "piece"), parts, "id binary, key long, lo long, a long, size long"), "parts")
    first = saved(rows.groupBy("id").agg(F.min(F.struct("key", "lo", "a")).alias("first")), "firsts")
    met = salted_join(rows.select("id", "key", "lo", "size"), first, "id", "lo")
    later = F.col("key") > F.col("first.key") if unit.earlier_document else F.struct("key", "lo") > F.struct("first.key", "first.lo")
    cut = met.where(later).select(*_ranges_of("key", F.col("lo"), F.col("lo") + F.col("size")))
    number = F.conv(F.hex(F.expr("substring(id, 1, 8)")), 16, -10).cast("long")
    kept = first.select(number.alias("h"), "first.key", "first.lo", "first.a", F.expr("substring(id, 9)").alias("piece"))
    sizes = kept.groupBy("h").agg(F.count("*").alias("n"))
    return cut, saved(salted_join(kept, sizes, "h", "lo"), "split")


def spread(cuts: np.ndarray) -> np.ndarray:
    """Places covered by ranges."""
    return ranges(cuts[:, 0], cuts[:, 1] - cuts[:, 0])
