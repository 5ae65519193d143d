"""Substring dedup of bytes with suffix arrays built by two-stage sorting.

A suffix smaller than its successor is sorted directly; every other one is induced by a scan of the
buckets of first symbols in ascending order. Adjacent common prefixes, capped at the window length,
then show the windows that repeat. ``winnow`` brings together the passages in which windows can be
equal, so that arrays stay small and no window is missed.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .winnow import MOST, Unit, cut_windows

#: Bytes of an n-gram and of the anchors within it.
WINDOW, ANCHOR = 100, 32


def _prefixes(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Fixed-width keys of suffixes; beyond the end there are zeros, which sort first."""
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, depth)
    return np.ascontiguousarray(view[at]).view(f"S{depth}").ravel()


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Places of a text (symbols 1 to 255) in the order of their suffixes; with depth, of their first depth symbols at least.

    The end counts as smaller than any symbol. Suffixes that are equal to that depth come in any order.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    depth = n if depth is None else min(depth, n)
    # smaller than its successor? a run of one symbol shares the answer of its last place
    step = np.sign(np.append(text[1:].astype(np.int16), -1) - text)
    last = np.flatnonzero(step)
    direct = step[last][np.searchsorted(last, np.arange(n))] > 0
    at = np.flatnonzero(direct)
    at = at[np.argsort(_prefixes(text, at, depth), kind="stable")] if len(at) else at
    first = text[at]
    bounds = np.searchsorted(first, np.arange(258))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]

    def scan(found: np.ndarray, symbol: int) -> np.ndarray:
        """Induce the predecessors of suffixes in order; those of the same symbol come back."""
        before = found[found > 0] - 1
        before = before[~direct[before]]
        head = text[before]
        own = before[head == symbol]
        before, head = before[head > symbol], head[head > symbol]
        order = np.argsort(head, kind="stable")
        before, head = before[order], head[order]
        cut = np.flatnonzero(head[1:] != head[:-1]) + 1
        for part in np.split(before, cut) if len(before) else ():
            induced[text[part[0]]].append(part)
        return own

    out = []
    induced[text[-1]].append(np.array([n - 1], np.int64))  # the suffix before the end
    for symbol in range(256):
        wave = np.concatenate(induced[symbol]) if induced[symbol] else np.zeros(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = scan(wave, symbol)
        mine = at[bounds[symbol] : bounds[symbol + 1]]
        if len(mine):
            out.append(mine)
            scan(mine, symbol)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length, up to most, of what each suffix in order shares with the one before (0 for the first)."""
    padded = np.concatenate([text, np.zeros(most + 8, np.uint8)])
    wide = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    limit = len(text) - np.maximum(order[1:], order[:-1]) if len(order) else np.zeros(0, np.int64)
    depth = 0
    while len(live) and depth < most:
        same = wide[order[live] + depth] == wide[order[live - 1] + depth]
        whole = same.all(axis=1)
        out[live] = depth + np.where(whole, 8, np.argmin(same, axis=1))
        live = live[whole]
        depth += 8
    out[1:] = np.minimum(np.minimum(out[1:], limit), most)
    return out


def solve(pieces: list[tuple[int, int, int, bytes]], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(key, start, end) to cut: windows of pieces (anchor, key, start, bytes) that also start earlier in another."""
    sizes = np.array([len(p[3]) for p in pieces])
    text = np.empty(int(sizes.sum()) + len(pieces), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    body = np.frombuffer(b"\0".join(p[3] for p in pieces) + b"\0", np.uint8)
    text[:] = body
    text += 2  # UTF-8 has no bytes over 0xF4
    text[starts + sizes] = 1
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)
    room = starts[owner] + sizes[owner] - np.arange(len(text))
    order = suffix_array(text, window)
    order = order[room[order] >= window]
    if not len(order):
        return []
    shared = common_prefixes(text, order, window) >= window
    group = np.cumsum(~shared) - 1
    key = np.array([p[1] for p in pieces], np.int64)[owner[order]]
    at = np.array([p[2] for p in pieces], np.int64)[owner[order]] + order - starts[owner[order]]
    by = np.lexsort((at, key, group))
    later = by[1:][group[by][1:] == group[by][:-1]]
    # of those, neighbours in one piece make one range
    where = np.sort(order[later])
    if not len(where):
        return []
    head = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1] + 1) | (owner[where[1:]] != owner[where[:-1]])]))
    tail = np.append(head[1:], len(where)) - 1
    out = []
    for s, e in zip(where[head], where[tail]):
        p = pieces[owner[s]]
        start = int(p[2] + s - starts[owner[s]])
        out.append((p[1], start, start + int(e - s) + window))
    return out


def finish(text: bytes, cuts: np.ndarray) -> tuple[int, int, int, str]:
    sha, at = hashlib.sha256(), 0
    for s, e in cuts.tolist():
        sha.update(text[at:s])
        at = e
    sha.update(text[at:])
    return len(text), int((cuts[:, 1] - cuts[:, 0]).sum()), len(cuts), sha.hexdigest()


def kept_text(text: bytes, cuts: np.ndarray) -> tuple[str]:
    """What is left; a character of which a byte is cut goes whole."""
    out, at = [], 0
    for s, e in cuts.tolist():
        out.append(text[at:s])
        at = e
    return (b"".join([*out, text[at:]]).decode("utf-8", "ignore"),)


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, most: int = MOST, texts: bool = False) -> DataFrame:
    """Remove each byte of a window-byte string that also starts earlier, in a smaller doc_id or further up.

    Gives doc_id, n_bytes, n_removed, n_spans, kept_sha256; with texts, doc_id and kept_text instead.
    A null text is empty; texts shorter than window stay whole; of equal documents the one of
    smallest doc_id stays; rows that share a doc_id count as documents in the order of their texts;
    null doc_ids come last; an empty table gives an empty result; other columns play no part.
    """
    unit = Unit("bytes", window, min(anchor, window - 1), earlier_document=False)
    columns = "kept_text string" if texts else "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return cut_windows(docs, unit, lambda pieces: solve(pieces, window), kept_text if texts else finish, columns, most)
