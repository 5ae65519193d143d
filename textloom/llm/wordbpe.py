"""Whole-text ids of a ``tokenizers`` file, with the work of the library done once for each distinct word.

A text falls into chunks at ASCII white space, which no match of the split pattern spans. Chunks of
printable Latin-1 fall further into the pattern's matches, whose ids the file's own BPE model gives;
any other chunk goes through the whole tokenizer. A file whose normalizer or pre-tokenizer is not of
that shape is used as it is, text by text.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import KEPT, give_back, ranges

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct pieces and chunks that a worker keeps; with either table full, later ones are encoded batch by batch.
MOST_PIECES = 300_000
MOST_CHUNKS = 400_000
#: Bytes of text that are encoded at once.
SLICE = 4 << 20
_LATIN = r"[\x21-\x7e\xa1-\xff\n]*"


def loaded(path: str) -> "WordBpe":
    """One instance for each worker and file, while the worker encodes."""
    if path not in KEPT:
        KEPT[path] = WordBpe(path)
        give_back()
    return KEPT[path]


class WordBpe:
    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        spec = json.loads(self.full.to_str())
        self.width = np.uint16 if self.full.get_vocab_size() <= 1 << 16 else np.uint32
        self.fast = self._known_shape(spec)
        self.pieces: dict[str, int] = {"\n": 0}
        self.ids = np.zeros(0, np.uint32)
        self.bounds = np.zeros(2, np.int64)
        self.chunks: dict[str, int] = {}
        self.chunk_ids = np.zeros(0, np.uint32)
        self.chunk_bounds = np.zeros(1, np.int64)
        if self.fast:
            pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
            self.split = regex.compile(f"{pattern}|\n")
            self.latin = regex.compile(_LATIN)
            self.special = [x["content"] for x in spec["added_tokens"]]
            self.bare = Tokenizer.from_str(self.full.to_str())
            self.bare.normalizer = None
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.last = np.zeros(max(self.full.get_vocab().values()) + 1, bool)
            for token, i in self.full.get_vocab().items():
                self.last[i] = token.endswith(spec["model"]["end_of_word_suffix"])

    @staticmethod
    def _known_shape(spec: dict) -> bool:
        try:
            norm = [x["type"] for x in spec["normalizer"]["normalizers"]]
            pre = spec["pre_tokenizer"]["pretokenizers"]
            split = pre[0]
            return (
                norm == ["NFC", "Replace", "Lowercase"]
                and spec["normalizer"]["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
                and spec["normalizer"]["normalizers"][1]["content"] == " "
                and [x["type"] for x in pre] == ["Split", "ByteLevel"]
                and split["behavior"] == "Removed"
                and split["invert"]
                and split["pattern"]["Regex"] == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
                and not pre[1]["use_regex"]
                and not pre[1]["add_prefix_space"]
                and spec["model"]["type"] == "BPE"
                and bool(spec["model"]["end_of_word_suffix"])
                and spec["post_processor"] is None
            )
        except (KeyError, TypeError, IndexError):
            return False

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (uint32), and n+1 offsets."""
        if not self.fast:
            return self._plain(texts.to_pylist())
        words = pc.ascii_split_whitespace(texts)
        word_off = words.offsets.to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False)
        known = self.chunks
        at = np.fromiter((known.get(c, -1) for c in chunks), np.int64, len(chunks))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = chunks[new].tolist()
            ids, bounds = self._chunks(fresh)
            at[new] = np.arange(len(known), len(known) + len(new))
            chunk_bounds = np.concatenate([self.chunk_bounds, bounds[1:] + len(self.chunk_ids)])
            chunk_ids = np.concatenate([self.chunk_ids, ids])
            if len(known) < MOST_CHUNKS:
                known.update(zip(fresh, at[new].tolist()))
                self.chunk_ids, self.chunk_bounds = chunk_ids, chunk_bounds
        else:
            chunk_ids, chunk_bounds = self.chunk_ids, self.chunk_bounds
        which = at[coded.indices.to_numpy()]
        starts = chunk_bounds[which]
        sizes = chunk_bounds[which + 1] - starts
        out = chunk_ids[ranges(starts, sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return out, ends[word_off - word_off[0]]

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [x.ids for x in self.full.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for x in got for i in x), np.uint32, int(sizes.sum())), np.concatenate([[0], np.cumsum(sizes)])

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks end to end, and offsets."""
        joined = "\n".join(chunks)
        odd: list[int] = []
        if not self.latin.fullmatch(joined) or any(s in joined for s in self.special):
            one = self.latin.fullmatch
            odd = [i for i, c in enumerate(chunks) if not one(c) or any(s in c for s in self.special)]
            chunks = list(chunks)
            odd_texts = [chunks[i] for i in odd]
            for i in odd:
                chunks[i] = ""
            joined = "\n".join(chunks)
        found = self.split.findall(joined.lower())
        known = self.pieces
        new = list({p for p in found if p not in known})
        piece_ids, piece_bounds = self.ids, self.bounds
        if new:
            got = np.concatenate([np.array(self.bare.encode("\n".join(new[i : i + 10_000]), add_special_tokens=False).ids, np.uint32) for i in range(0, len(new), 10_000)])
            ends = np.flatnonzero(self.last[got]) + 1
            if len(ends) != len(new):
                raise AssertionError("a piece did not end in exactly one word end")
            piece_bounds = np.concatenate([piece_bounds, len(piece_ids) + ends])
            piece_ids = np.concatenate([piece_ids, got])
            fresh = dict(zip(new, range(len(known), len(known) + len(new))))
            if len(known) < MOST_PIECES:
                known.update(fresh)
                self.ids, self.bounds, fresh = piece_ids, piece_bounds, {}
            which = np.fromiter((known[p] if p in known else fresh[p] for p in found), np.int64, len(found))
        else:
            which = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
        starts = piece_bounds[which]
        sizes = piece_bounds[which + 1] - starts
        ids = piece_ids[ranges(starts, sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bounds = np.concatenate([[0], ends[np.flatnonzero(which == 0)], ends[-1:]])
        if not chunks:
            return ids, np.zeros(1, np.int64)
        if odd:
            extra, extra_off = self._plain(odd_texts)
            sizes = np.diff(bounds)
            sizes[odd] = np.diff(extra_off)
            out_off = np.concatenate([[0], np.cumsum(sizes)])
            out = np.empty(int(out_off[-1]), np.uint32)
            mask = np.ones(len(out), bool)
            mask[ranges(out_off[odd], sizes[odd])] = False
            out[mask] = ids
            out[~mask] = extra
            return out, out_off
        return ids, bounds
