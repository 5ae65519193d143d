import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from textloom.llm import bytebpe, packing, token_records, wordbpe

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", None, "a", "Hello, World's 123 can't", "é́ ÀÉ ß ſ K İ", "tab\tnew\x0bline\x1c\x85　x", "<|endoftext|> <|startoftext|>x", "😀 👨‍👩‍👧 \0 \n\n", "abc " * 3000, "x" * 5000, " " * 3000, "日本語のテキスト 検索", "!!!???...''' 's't're've'm'll'd", " nbsp­soft", "Å x﻿y", "ﬁ ǅ"]


def full(texts):
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(WORDS).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def some(n, seed=1):
    r = random.Random(seed)
    alphabet = "abcXYZ 0'9.,!éßÀ́ \n\t日😀<|>ſ"
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 60))) for _ in range(n)]


def test_ids_are_those_of_the_library():
    texts = [t or "" for t in ODD] + some(400)
    bpe = wordbpe.WordBpe(WORDS)
    assert bpe.fast
    for _ in range(2):  # the second time from its tables
        ids, off = bpe.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == full(texts)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(t, i * 3, "x", 1) for i, t in enumerate(ODD + some(40, 2))]
    return spark.createDataFrame(rows, "text string, doc_id long, ids string, start int").repartition(3)


def test_records(spark, docs, tmp_path):
    got = sorted(token_records.token_records(docs, WORDS, str(tmp_path / "r")).collect(), key=lambda r: r.doc_id)
    texts, start = ODD + some(40, 2), 0
    assert len(got) == len(texts)
    for r, ids in zip(got, full(texts)):
        ids = [*ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    index = token_records.index_of(spark, str(tmp_path / "r/data"))
    back = {r.doc_id: r.ids for r in token_records.read_ids(spark, str(tmp_path / "r/data"), index).collect()}
    assert [back[i * 3] for i in range(len(texts))] == [[*x, 1] for x in full(texts)]


def test_records_of_odd_tables(spark, tmp_path):
    rows = [(None, "b"), (None, "a"), (2, "x"), (2, "x")]
    got = token_records.token_records(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, str(tmp_path / "a")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 2, 2] and [r.start for r in got] == [0, 2, 4, 6]
    assert token_records.token_records(spark.createDataFrame([], "doc_id long, text string"), WORDS, str(tmp_path / "b")).collect() == []


def test_records_in_many_files(spark, tmp_path, monkeypatch):
    """Runs and files of a few frames, one frame longer than a run, and one document of over 4 MB."""
    monkeypatch.setattr(token_records, "RUN_BYTES", 200)
    monkeypatch.setattr(token_records, "RUNS", 2)
    monkeypatch.setattr(token_records, "ROWS", 3)
    texts = [t or "" for t in ODD] + some(60, 4) + ["long word " * 500_000]
    docs = spark.createDataFrame([(i, t, "f", 0) for i, t in enumerate(texts)], "doc_id long, text string, file string, `off.set` int").repartition(3)
    got = sorted(token_records.token_records(docs, WORDS, str(tmp_path / "r")).collect(), key=lambda r: r.doc_id)
    assert len({r.file for r in got}) > 10
    start = 0
    for r, ids in zip(got, full(texts)):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes()))
        start += r.n_tokens
    index = spark.createDataFrame([r for r in got if r.doc_id % 7 == 0])
    back = {r.doc_id: r.ids for r in token_records.read_ids(spark, str(tmp_path / "r/data"), index).collect()}
    assert {d: x[:-1] for d, x in back.items()} == {i: x for i, x in enumerate(full(texts)) if i % 7 == 0}


def test_damage_is_seen():
    data = token_records.frame(5, np.array([1, 2, 70_000])) + token_records.frame(None, np.array([], int))
    (_, n, a, x), (at, _, b, y) = token_records.frames(data)
    assert (a, x.tolist(), b, y.tolist(), n) == (5, [1, 2, 70_000], None, [], at)
    for i in range(len(data)):
        bad = bytearray(data)
        bad[i] ^= 1
        if data[i] != 10 or i not in (n - 1, len(data) - 1):  # the line ends hold nothing
            with pytest.raises(ValueError):
                list(token_records.frames(bytes(bad)))
    with pytest.raises(ValueError):
        list(token_records.frames(data[:-7]))


def checked(rows, texts):
    """Pieces are whole, and sequences gapless within 4096 tokens."""
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for own in by_seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    for i, ids in enumerate(full(texts)):
        ids = np.array([*ids, 1], "<u4")
        own = sorted(by_doc[i * 3], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == [(k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    return len(by_seq)


def test_packing(spark, docs):
    texts = ODD + some(40, 2)
    n = checked(packing.pack(packing.pieces(docs, WORDS)).collect(), texts)
    total = sum(len(x) + 1 for x in full(texts))
    assert n <= -(-total // 4096) + 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(empty, WORDS)).collect() == []
    odd = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    rows = packing.pack(packing.pieces(odd, WORDS)).collect()
    assert sorted((r.offset, r.length) for r in rows) == [(0, 2), (2, 2), (4, 2), (6, 1)] and len({r.sequence_id for r in rows}) == 1


def test_packing_of_long_documents(spark):
    """Documents of one, two and very many pieces, one of over 4 MB."""
    texts = ["word " * 4094, "word " * 4095, "word " * 4096, "word " * 9000, "longer word " * 400_000, None, "", "a"]
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = packing.pieces(docs, WORDS).collect()
    assert {d: sum(r.doc_id == 3 * d for r in found) for d in range(5)} == {0: 1, 1: 1, 2: 2, 3: 3, 4: 196}
    n = checked(packing.pack(packing.pieces(docs, WORDS)).collect(), texts)
    assert n <= -(-sum(r.length for r in found) // 4096) + 1


def test_packing_keeps_other_columns(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 2)
    names = "offset string, `a.b` int, salt int, rank int, block int, length long, doc_id long, piece int, `row` string, `from` int, sequence_id string"
    rows = [("o", i, 1, 2, 3, 1 + i % 7, i // 2, i % 2, "r", 4, "s") for i in range(60)]
    found = spark.createDataFrame(rows, names)
    for limit in (10**6, 0):  # the plan by broadcast, and by shuffle
        monkeypatch.setattr(packing, "BROADCAST_ROWS", limit)
        packed = packing.pack(found, packing.Capacity(10))
        assert packed.columns == ["a.b", "salt", "rank", "block", "length", "doc_id", "piece", "row", "from", "sequence_id", "offset"]
        got = packed.collect()
        assert sorted(r["a.b"] for r in got) == list(range(60)) and all(r.length == 1 + r["a.b"] % 7 for r in got)
        held = defaultdict(list)
        for r in got:
            held[r.sequence_id].append((r.offset, r.length))
        for own in held.values():
            own.sort()
            assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 10
    for length in (None, 0):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(1, 0, length)], "doc_id long, piece int, length long"))


def test_weights_on_all_residuals_take_no_more_sequences():
    r = random.Random(12)
    for _ in range(5):
        counts = defaultdict(int)
        for _ in range(3000):
            counts[min(4096, int(r.lognormvariate(6, 1.2)) + 1)] += 1
        n = [max(seq + b - a for _, a, b, seq, _ in packing.plan(counts, packing.Capacity(4096, 4096, 4096**2, w))) for w in ((1.0, 0, 0), (1.0, 0.25, 0.25))]
        assert n[1] <= n[0] + 1


def test_sequences_of_ids(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    packed = packing.pack(packing.pieces(docs, WORDS, with_ids=True))
    rows, whole = packed.collect(), {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in rows:
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == np.frombuffer(r.ids, "<u4").tolist()
    assert sum(map(len, whole.values())) == sum(r.length for r in rows)
    assert packing.sequences(packed.limit(0)).collect() == []


@pytest.mark.parametrize("capacity", [packing.Capacity(100), packing.Capacity(100, documents=4), packing.Capacity(100, attention=3000, weights=(1, 0.2, 0.5)), packing.Capacity(100, 5, 4000, (1, 0.3, 0.3), "dot")])
def test_plan_keeps_every_capacity(capacity):
    r = random.Random(3)
    counts = {n: r.randrange(0, 30) for n in range(1, 50)}
    held, seen = defaultdict(list), defaultdict(set)
    for length, a, b, seq, offset in packing.plan(counts, capacity):
        for k in range(a, b):
            assert k not in seen[length]
            seen[length].add(k)
            held[seq + k - a].append((offset, length))
    assert {n: len(s) for n, s in seen.items()} == {n: c for n, c in counts.items() if c}
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert (np.array([at, len(own), sum(n * n for _, n in own)]) <= capacity.vector()).all()
    if capacity == packing.Capacity(100):
        assert len(held) <= 1.02 * sum(n * c for n, c in counts.items()) / 100 + 1


def library():
    import tiktoken

    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.encoding(BYTES, public_tokenizers.PATTERN)._mergeable_ranks, special_tokens={})


def test_byte_bpe(spark, docs, monkeypatch):
    enc = library()
    rows = {r.doc_id: r for r in bytebpe.round_trip(docs, BYTES, public_tokenizers.PATTERN).collect()}
    encoded = bytebpe.encode(docs, BYTES, public_tokenizers.PATTERN)
    ids_of = {r.doc_id: r.ids for r in encoded.collect()}
    bytes_of = {r.doc_id: bytes(r.bytes) for r in bytebpe.decode(encoded, BYTES, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(ODD + some(40, 2)):
        ids, r = enc.encode_ordinary(t or ""), rows[i * 3]
        assert ids_of[i * 3] == ids and bytes_of[i * 3] == (t or "").encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bytebpe.round_trip(empty, BYTES, public_tokenizers.PATTERN).collect() == []
    monkeypatch.setattr(bytebpe, "SPAN", 7)
    for t in some(300, 5) + ["a  b", "a \n b", "x'll  's", "   lead", "trail   "]:
        assert bytebpe.encode_text(enc, t) == enc.encode_ordinary(t)


@pytest.mark.parametrize("text", ["a" * 300_000, " " * 300_000, "ab" * 200_000 + " " * 200_000 + "!" * 200_000])
def test_byte_bpe_of_long_runs(text):
    enc = library()
    ids = bytebpe.encode_text(enc, text)
    assert ids == enc.encode_ordinary(text) and enc.decode_bytes(ids) == text.encode()
