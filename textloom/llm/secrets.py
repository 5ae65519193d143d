"""Secret scans: base patterns, and multipart credentials whose parts stand close together.

A part is an access identifier, an endpoint, or a weak secret: a bare run of key characters with
letters, digits and high entropy, which alone says little. An interval join within a scope (a
document, WINDOW characters around the part) pairs weak secrets with identifiers and endpoints; a
weak secret is reported, as kind ``linked``, only where such a complementary part co-occurs.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, in_batches, saved

KINDS = ("assign", "access", "hex", "linked")
#: Characters between parts of a credential at most.
WINDOW = 200
_WORD = "".join


def _either(word: str) -> str:
    return _WORD(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile(rf"(?:{_either('password')}|{_either('passwd')}|{_either('secret')}|{_either('token')}|{_either('api')}_?{_either('key')})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
ENDPOINT = re.compile(r"(?:https?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+")
WEAK = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{16,}(?![A-Za-z0-9+/=_-])")
# what a text with any match has, for a fast scan of all texts
_MAY_ASSIGN, _MAY_HEX = r"(?i)(?:password|passwd|secret|token|api_?key)", r"[0-9a-f]{32}"


def entropy(text: str) -> float:
    """Bits a character."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def weak_secret(text: str) -> bool:
    return any(c.isdigit() for c in text) and any(c.isalpha() for c in text) and not text.startswith("AKIA") and entropy(text) >= 3.0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each base match, in code points, by start and then kind as listed."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def other_parts(text: str, base: list[tuple[str, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans of weak secrets clear of base spans and endpoints, and of complementary parts."""
    ends = [m.span() for m in ENDPOINT.finditer(text)]
    complements = sorted(ends + [(s, e) for k, s, e in base if k == "access"])
    if not complements:
        return [], []
    taken, weak, at = sorted([(s, e) for _, s, e in base] + ends), [], 0
    for m in WEAK.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if not (at < len(taken) and taken[at][0] < m.end()) and weak_secret(m[0]):
            weak.append(m.span())
    return weak, complements


_PARTS = "doc_id long, base array<struct<kind:string,start:long,end:long>>, weak array<struct<start:long,end:long>>, near array<struct<start:long,end:long>>"
_SPAN = [("start", pa.int64()), ("end", pa.int64())]


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document with the spans of all its parts; no text leaves the worker."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            may = pc.or_(pc.or_(pc.match_substring(texts, "AKIA"), pc.match_substring(texts, "://")), pc.or_(pc.match_substring_regex(texts, _MAY_ASSIGN), pc.match_substring_regex(texts, _MAY_HEX)))
            base, weak, near = [], [], []
            for hit, text in zip(may.to_pylist(), texts):
                found = base_spans(text := text.as_py()) if hit else []
                w, c = other_parts(text, found) if hit else ([], [])
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
                weak.append([{"start": s, "end": e} for s, e in w])
                near.append([{"start": s, "end": e} for s, e in c] if w else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, pa.list_(pa.struct([("kind", pa.string()), *_SPAN]))), pa.array(weak, pa.list_(pa.struct(_SPAN))), pa.array(near, pa.list_(pa.struct(_SPAN)))],
                ["doc_id", "base", "weak", "near"],
            )

    return in_batches(id_and_text(docs, id_col, text_col), run, _PARTS)


def linked(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, start, end) of weak secrets within window characters of a complementary part of their document.

    Interval join by cells of ``window`` characters: a part lies in the cells that its span, widened
    by window, touches; pairs meet on (row, cell). Parts don't overlap their kind, so a cell holds
    few of them however many a document has.
    """
    weak = found.select("row", F.explode("weak").alias("w")).select("row", "w.start", "w.end", F.explode(F.expr(f"sequence(w.start div {window}, (w.end - 1) div {window})")).alias("cell"))
    near = found.select("row", F.explode("near").alias("n")).select("row", F.col("n.start").alias("s"), F.col("n.end").alias("e"), F.explode(F.expr(f"sequence(greatest(0, n.start - {window}) div {window}, (n.end + {window}) div {window})")).alias("cell"))
    close = (F.col("start") <= F.col("e") + window) & (F.col("s") <= F.col("end") + window)
    return weak.join(near, [weak.row == near.row, weak.cell == near.cell, close], "left_semi").select("row", "start", "end").distinct()


def scan(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end>>) of every whole text: base spans and linked ones.

    A null or empty text has none; each of repeated rows gets its own; null doc_ids stay; an empty
    table gives an empty result; other columns play no part. Spans are ordered by start, then kind.
    """
    found = saved(parts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "parts")
    extra = linked(found.where(F.size("weak") > 0), window).groupBy("row").agg(F.collect_list(F.struct(F.lit("linked").alias("kind"), "start", "end")).alias("extra"))
    order = F.array(*map(F.lit, KINDS))
    key = lambda x: F.struct(x["start"], F.array_position(order, x["kind"]).alias("k"), x["end"], x["kind"])
    spans = F.array_sort(F.transform(F.concat("base", F.coalesce("extra", F.expr("array()"))), key))
    return found.join(extra, "row", "left").select("doc_id", F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))


def joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def base_digest(text: str | None) -> str:
    """The digest of a text's base spans, the plain way; tests hold the query against it."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(text or "")).encode()).hexdigest()
