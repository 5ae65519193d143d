"""Substring dedup of words with suffix automata of reference shards.

A document is streamed through the automaton of what comes before it: each word's matching statistic is
the length of the longest run of words ending there that the reference holds, and maximal spans of
at least ``window`` words go. Reference shards are passages that share an anchor (``winnow``). Where one is
hot, as very many documents hold a passage, the first document's automaton is broadcast and all
others stream past it wherever they are (``hot_first``); HOT shards of bounded size are. All shards together are as
large as the corpus, which no broadcast may be, so each other shard's automaton is built in the one
task that its passages are sent to. ``against`` broadcasts the automata of a bounded reference table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, merged
from .winnow import MOST, Unit, cut_windows

WINDOW, ANCHOR = 50, 12
#: Words of a reference that may be broadcast in all, and of one shard.
REFERENCE_WORDS, SHARD_WORDS = 2_000_000, 200_000
#: Hot shards whose automaton is broadcast at most, each of one piece of less than twice a window.
HOT = 2000


class Automaton:
    """Suffix automaton of several sequences; its states' longest lengths and links give matching statistics."""

    def __init__(self) -> None:
        self.length, self.link, self.next = [0], [-1], [{}]

    def add(self, sequence: Iterable) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)

    def _extend(self, last: int, c) -> int:
        length, link, nxt = self.length, self.link, self.next
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = len(length)
        length.append(length[last] + 1)
        link.append(0)
        nxt.append({})
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c, q: int) -> int:
        new = len(self.length)
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.next.append(dict(self.next[q]))
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def statistics(self, sequence: Iterable) -> list[int]:
        """For each place, the length of the longest match that ends there."""
        length, link, nxt = self.length, self.link, self.next
        state, n, out = 0, 0, []
        for c in sequence:
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                n += 1
            out.append(n)
        return out


def spans(statistics: Sequence[int], window: int) -> np.ndarray:
    """Ranges covered by matches of at least window."""
    got = np.asarray(statistics, np.int64)
    ends = np.flatnonzero(got >= window)
    return merged(np.stack([ends + 1 - got[ends], ends + 1], axis=1)) if len(ends) else np.zeros((0, 2), np.int64)


def solve(pieces: list[tuple[int, int, int, bytes]], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(key, start, end) to cut: windows of pieces (anchor, key, first word, words) that a smaller key has too."""
    out, at = [], 0
    while at < len(pieces):
        end = at
        while end < len(pieces) and pieces[end][0] == pieces[at][0]:
            end += 1
        shard, waiting, held = Automaton(), [], None
        for _, key, first, piece in sorted(pieces[at:end], key=lambda p: p[1]):
            if key != held:
                for words in waiting:
                    shard.add(words)
                waiting, held = [], key
            words = piece.split(b" ")
            out += [(key, first + s, first + e) for s, e in spans(shard.statistics(words), window).tolist()]
            waiting.append(words)
        at = end
    return out


def hot_first(pieces: DataFrame, window: int = WINDOW, most: int = HOT) -> DataFrame:
    """(h, key, lo, a, piece, cuts) of pieces of hot anchors: cuts of what the anchor's first piece holds too, by its broadcast automaton, and the pieces left.

    Of the anchors with most pieces, ``most`` have theirs broadcast; pieces of others are left whole.
    """
    spark = pieces.sparkSession
    of = pieces.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("key", "lo", "piece")).alias("first"))
    reference = {r.h: (r.key, bytes(r.piece).split(b" ")) for r in of.orderBy(F.col("n").desc(), "h").limit(most).select("h", "first.key", "first.piece").collect()}
    sent = spark.sparkContext.broadcast(reference)

    def run(batches):
        built: dict[int, Automaton] = {}
        for batch in batches:
            out: list[tuple] = []
            for h, key, lo, a, piece in zip(*(c.to_pylist() for c in batch.columns)):
                first, words = sent.value.get(h, (None, None))
                if first is None or key <= first:
                    out.append((h, key, lo, a, piece, None))
                    continue
                if h not in built:
                    built[h] = Automaton()
                    built[h].add(words)
                own = piece.split(b" ")
                held = np.asarray(built[h].statistics(own)[window - 1 :]) >= window  # windows that the reference has
                edges = np.flatnonzero(np.diff(held.astype(np.int8), prepend=2, append=2))
                for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    if held[s]:
                        out.append((h, key, None, None, None, np.array([lo + s, lo + e - 1 + window], "<u4").tobytes()))
                    else:
                        out.append((h, key, lo + s, a - s, b" ".join(own[s : e - 1 + window]), None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    names, kinds = ["h", "key", "lo", "a", "piece", "cuts"], [*[pa.int64()] * 4, pa.binary(), pa.binary()]
    return pieces.select(*names[:5]).mapInArrow(run, "h long, key long, lo long, a long, piece binary, cuts binary")


def finish(words: list[bytes], cuts: np.ndarray) -> tuple[int, int, str]:
    kept, at = [], 0
    for s, e in cuts.tolist():
        kept += words[at:s]
        at = e
    kept += words[at:]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, most: int = MOST) -> DataFrame:
    """Remove each word of a window of words that also starts in a document of smaller doc_id.

    Gives doc_id, n_words, n_removed, kept_sha256 (of kept words joined by a space). A null text has no
    words; texts shorter than window stay whole; rows that share a doc_id count as documents in the
    order of their texts; null doc_ids come last; an empty table gives an empty result; other
    columns play no part.
    """
    unit = Unit("words", window, min(anchor, window - 1), earlier_document=True)
    return cut_windows(docs, unit, lambda pieces: solve(pieces, window), finish, "n_words long, n_removed long, kept_sha256 string", most, lambda pieces: hot_first(pieces, window))


def against(docs: DataFrame, reference: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, spans array<array<long>>): spans of documents that a small reference table holds.

    The reference (doc_id, text) may have REFERENCE_WORDS words, or ValueError is raised: its size is
    counted before it is fetched. Shards of whole texts get an automaton each, built once in a worker.
    A null text has no words and no spans; null doc_ids and repeated rows stay; an empty reference
    gives no spans, an empty table no rows; other columns play no part.
    """
    spark = docs.sparkSession
    texts = id_and_text(reference).select("text")
    n = texts.select(F.sum(F.size(F.split("text", r"[ \t-\r]+")))).first()[0] or 0
    if n > REFERENCE_WORDS:
        raise ValueError(f"the reference has {n} words; {REFERENCE_WORDS} may be broadcast. Use dedup on the union")
    shards: list[list[list[bytes]]] = [[]]
    size = 0
    for (text,) in texts.collect():  # bounded above
        words = text.encode().split()
        if size + len(words) > SHARD_WORDS and shards[-1]:
            shards.append([])
            size = 0
        shards[-1].append(words)
        size += len(words)
    sent = spark.sparkContext.broadcast(shards)

    def run(batches):
        built = []
        for shard in sent.value:
            built.append(Automaton())
            for words in shard:
                built[-1].add(words)
        for batch in batches:
            counts, found = [], []
            for text in batch.column(1).to_pylist():
                words = text.encode().split()
                counts.append(len(words))
                found.append(merged(np.concatenate([np.zeros((0, 2), np.int64), *(spans(a.statistics(words), window) for a in built)])).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(pa.list_(pa.int64())))], ["doc_id", "n_words", "spans"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_words long, spans array<array<long>>")
