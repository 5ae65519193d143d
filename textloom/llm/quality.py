"""Quality classifier by co-training of two views of a document.

The text view is hashed words, word pairs and ends of words; the page view is metadata alone: language,
source and number of characters, as the table has them. So the views share no evidence. Each view has
a logistic model, fitted on a bounded sample of labelled rows. In each round both models score every
unlabelled document, in Spark; those of all of them that a model is most sure of, by class, go to the
other with its label, and the other learns from them. Both are then calibrated (Platt) on held-out
labels, and their log odds, weighted by how much they tell there, score every document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import arrow_bounds, drop_path, in_batches, local, only, saved, slices, text_buffer
from .minhash import LOWER
from .winnow import mix, word_hashes, words_of

#: Bounds of the labelled sample, in documents and in bytes of their features; unlabelled documents have none.
LABELLED, FIT_BYTES = 5000, 16 << 20
#: Hashed features of the text view, rounds, and documents that a model hands over in a round, in the classes' known proportion.
FEATURES, ROUNDS, SHARE = 1 << 16, 3, 250  # features travel as 16 bits
#: Log odds from which a model is sure of a document.
SURE = 3.0
#: Probability of good quality from which a document is kept.
THRESHOLD = 0.4
_PAIR, _NEXT = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, weight, offsets) of each document: hashed lower-case words, pairs of neighbouring words and ends of words, L2-normalised counts."""
    starts, ends, bounds = words_of(data, offsets)
    low = word_hashes(LOWER[data], starts, ends)
    # how a word ends: its last two bytes, letters as one kind
    kind = np.where((data >= 128) | ((data | 32) >= 97) & ((data | 32) <= 122), 255, data).astype(np.uint64)
    tail = mix(kind[ends - 1] * np.uint64(257) + kind[np.maximum(ends - 2, starts)] + _PAIR) if len(starts) else low
    pair = mix(low[:-1] * _NEXT + low[1:])
    feats, weights, sizes = [], [], []
    for s, e in zip(bounds[:-1], bounds[1:]):
        f, n = np.unique(np.concatenate([low[s:e], tail[s:e], pair[s : max(s, e - 1)]]) % np.uint64(FEATURES), return_counts=True)
        w = np.sqrt(n)
        feats.append(f.astype(np.int64))
        weights.append(w / max(1e-9, math.sqrt(float((w * w).sum()))))
        sizes.append(len(f))
    none = [np.zeros(0, np.int64)]
    return np.concatenate(feats or none), np.concatenate(weights or none).astype(float), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


#: Features of the page view: bias, unknown length, length, and hashed places for length classes, languages, sources and pairs of them.
PAGE = 128


def page_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Dense features of each document's metadata; any of it may be null. The text plays no part."""
    out = np.zeros((len(lang), PAGE))
    out[:, 0] = 1
    for i, (a, b, n) in enumerate(zip(lang, source, n_chars)):
        size = -1 if n is None else min(15, int(math.log2(max(0, n) + 1)))
        out[i, 1], out[i, 2] = n is None, 0 if n is None else math.log1p(max(0, n)) / 10
        out[i, 3 + size + 1] += 0.5
        out[i, 20 + hash_of(a) % 12] += 0.5
        out[i, 32 + hash_of(b) % 32] += 0.5
        out[i, 64 + hash_of((a, size)) % 32] += 0.5
        out[i, 96 + hash_of((a, b)) % 32] += 0.5
    return out


def hash_of(x) -> int:
    import zlib

    return zlib.crc32(str(x).encode())


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Sparse:
    """Rows of (feature, weight), for logistic models."""

    def __init__(self, feature: np.ndarray, weight: np.ndarray, offsets: np.ndarray) -> None:
        self.f, self.w, self.o, self.rows = feature, weight, offsets, len(offsets) - 1
        self.row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))

    def parts(self):
        """(row, feature, weight) in parts, so that what is made of them stays small beside the rows."""
        for s in range(0, len(self.f), 1 << 19):
            yield self.row[s : s + (1 << 19)], self.f[s : s + (1 << 19)], self.w[s : s + (1 << 19)]

    def dot(self, model: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.o) - 1)
        for row, f, w in self.parts():
            out += np.bincount(row, w * model[f], minlength=len(out))
        return out + model[-1]

    def grad(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(FEATURES)
        for row, f, w in self.parts():
            out += np.bincount(f, w * r[row], minlength=FEATURES)
        return np.append(out, r.sum())

    size = FEATURES + 1


class Joined:
    """Rows of one view after those of another; nothing is copied."""

    def __init__(self, first, second) -> None:
        self.first, self.second, self.size, self.rows = first, second, first.size, first.rows + second.rows

    def dot(self, model: np.ndarray) -> np.ndarray:
        return np.concatenate([self.first.dot(model), self.second.dot(model)])

    def grad(self, r: np.ndarray) -> np.ndarray:
        return self.first.grad(r[: self.first.rows]) + self.second.grad(r[self.first.rows :])


class Dense:
    def __init__(self, x: np.ndarray) -> None:
        self.x, self.rows, self.size = x, *x.shape

    def dot(self, model: np.ndarray) -> np.ndarray:
        return self.x @ model

    def grad(self, r: np.ndarray) -> np.ndarray:
        return r @ self.x


def fit(x: Sparse | Dense | Joined, y: np.ndarray, weight: np.ndarray, l2: float, steps: int = 70) -> np.ndarray:
    """Logistic regression by Adam on all rows; rows of weight 0 play no part."""
    model, m, v = np.zeros(x.size), np.zeros(x.size), np.zeros(x.size)
    total = max(weight.sum(), 1e-9)
    for t in range(1, steps + 1):
        g = x.grad((sigmoid(x.dot(model)) - y) * weight / total) + l2 * model
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        model -= 0.3 / math.sqrt(1 + t / 30) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return model


@dataclass
class Model:
    """What scoring needs; small and of fixed size, whatever the corpus."""

    text: np.ndarray = field(repr=False)
    page: np.ndarray = field(repr=False)
    scales: tuple[tuple[float, float], tuple[float, float]] = ((1.0, 0.0), (1.0, 0.0))
    weights: tuple[float, float] = (0.5, 0.5)
    #: Log odds of a document when nothing was there to learn from.
    prior: float = 10.0
    learned: bool = True

    def score(self, text: Sparse, page: Dense) -> np.ndarray:
        """Probability of good quality."""
        if not self.learned:
            return np.full(len(text.o) - 1, float(sigmoid(self.prior)))
        z = [a * x.dot(m) + b for x, m, (a, b) in zip((text, page), (self.text, self.page), self.scales)]
        return sigmoid(sum(w * s for w, s in zip(self.weights, z)))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that calibrate scores; softened targets keep them finite."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t = np.where(y == 1, hi, lo)
    a, b = 1.0, 0.0
    for _ in range(200):
        p = sigmoid(a * z + b)
        g = np.array([((p - t) * z).mean(), (p - t).mean()])
        w = p * (1 - p) + 1e-6
        h = np.array([[(w * z * z).mean(), (w * z).mean()], [(w * z).mean(), w.mean()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return (float(a), float(b)) if a > 0 else (0.0, float(np.log((y.sum() + 1) / ((1 - y).sum() + 1))))


def cotrain(text: Sparse, page: Dense, label: np.ndarray, rounds: int = ROUNDS, share: int = SHARE, surest=None) -> Model:
    """label: 1 good, 0 bad, -1 not known. Every fourth labelled row is held out for calibration.

    The unlabelled are the rows of label -1, or else what ``surest(models, sizes)`` knows of: it gives,
    of all that a view hasn't got yet, the sizes = (bad, good) that the other's model is most sure of,
    as (text, page, classes), with the class for each view in two rows, -1 for none.
    """
    known = np.flatnonzero(label >= 0)
    held = known[3::4]
    train = np.setdiff1d(known, held)
    if len(np.unique(label[train])) < 2 or len(np.unique(label[held])) < 2:
        return Model(np.zeros(text.size), np.zeros(page.size), learned=False)
    ys, ws = [], []
    for _ in range(2):
        y, w = np.where(label == 1, 1.0, 0.0), np.zeros(len(label))
        w[train] = 1
        ys.append(y), ws.append(w)
    base = label[train].mean()
    models = []
    for r in range(rounds + 1):
        models = [fit(x, y, w, l2) for x, y, w, l2 in zip((text, page), ys, ws, (1e-5, 1e-4))]
        if r == rounds:
            break
        sizes = max(1, round(share * (1 - base))), max(1, round(share * base))
        if surest:
            more = surest(models, sizes)
            text, page = Joined(text, more[0]), Joined(page, more[1])
            for v in (0, 1):
                ys[v] = np.append(ys[v], np.maximum(more[2][v], 0))
                ws[v] = np.append(ws[v], np.where(more[2][v] >= 0, 0.5, 0))
            continue
        for me, x in ((0, text), (1, page)):
            other = 1 - me
            z = x.dot(models[me])
            free = np.flatnonzero((label < 0) & (ws[other] == 0))
            # both classes in their known proportion, and only where the model is sure
            for good, n in ((1, sizes[1]), (0, sizes[0])):
                s = z[free] if good else -z[free]
                take = free[np.argsort(-s, kind="stable")[:n]]
                take = take[(z[take] if good else -z[take]) > SURE]
                ys[other][take], ws[other][take] = good, 0.5
                free = np.setdiff1d(free, take)
    zs = [x.dot(m)[held] for x, m in zip((text, page), models)]
    scales = tuple(_platt(z, label[held]) for z in zs)
    loss = [-np.log(np.clip(np.where(label[held] == 1, p, 1 - p), 1e-6, 1)).mean() for p in (sigmoid(a * z + b) for z, (a, b) in zip(zs, scales))]
    # a view that does no better than the share of each class tells nothing
    none = -np.log(np.where(label[held] == 1, label[held].mean(), 1 - label[held].mean())).mean()
    sure = np.array([max(none - x, 0) / (x + 0.01) for x in loss]) + 1e-6
    return Model(models[0], models[1], scales, tuple((sure / sure.sum()).tolist()))


_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _view(docs: DataFrame, name: str):
    """A column that the views read; null if it is missing, and a null text is empty."""
    if name == "text":
        return F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    kind = "long" if name == "n_chars" else "string"
    return (F.col(name) if name in {c.lower() for c in docs.columns} else F.lit(None)).cast(kind).alias(name)


def _described(batch: pa.RecordBatch):
    """(rows from, to, text view, page view) of parts of a batch of (any, text, lang, source, n_chars)."""
    data, off = text_buffer(batch.column(1))
    lang, source, n_chars = (batch.column(i).to_pylist() for i in (2, 3, 4))
    for a, b in slices(off, 1 << 20):
        part, cut = data[off[a] : off[b]], off[a : b + 1] - off[a]
        yield a, b, Sparse(*text_features(part, cut)), Dense(page_features(lang[a:b], source[a:b], n_chars[a:b]))


def _features(rows: DataFrame) -> tuple[list, Sparse, Dense]:
    """Ids and both views of a bounded table (id long, text, lang, source, n_chars), by id; beyond FIT_BYTES of features the rest is left out."""

    def describe(batches):
        for batch in batches:
            for s, e, text, page in _described(batch):
                f, w, o = text.f.astype("<u2"), text.w.astype("<f4"), text.o
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s, e - s), *(pa.array([x[a:b].tobytes() for a, b in zip(o[:-1], o[1:])], pa.binary()) for x in (f, w)), pa.array([x.astype("<f4").tobytes() for x in page.x], pa.binary())],
                    ["id", "f", "w", "p"],
                )

    # by Arrow, as rows of Python objects take a multiple of the driver's memory; of a bounded sample, in order of a hash
    table = saved(in_batches(rows, describe, "id long, f binary, w binary, p binary"), "quality-sample")
    so_far = F.sum(F.length("f") + F.length("w") + F.length("p")).over(Window.orderBy(F.xxhash64("id"), "id", "p").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = table.withColumn("n", so_far).where(F.col("n") <= FIT_BYTES).orderBy("id", "p").select("id", "f", "w", "p").toArrow()
    drop_path(rows.sparkSession, table)
    (f, o), (w, _), (p, _) = (text_buffer(found.column(c)) for c in ("f", "w", "p"))
    # small types: the fit takes them as they are
    text, page = Sparse(f.view("<u2"), w.view("<f4"), o // 2), Dense(p.view("<f4").reshape(found.num_rows, PAGE))
    return found.column("id").to_pylist(), text, page


class Unlabelled:
    """The documents without a known label, whatever their number; equal ones count once."""

    def __init__(self, views: DataFrame, known: DataFrame) -> None:
        named = (F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("lang", "source", "n_chars"))  # as hash_of has them
        self.views = views.withColumn("id", F.xxhash64("text", *named))
        self.known = saved(known.select(F.col("doc_id").alias("key")), "quality-known")
        self.given: tuple[set, set] = set(), set()

    def scored(self, models: list) -> DataFrame:
        """(id, z0, z1): both models' log odds of each document that one of them is sure of."""
        spark = self.views.sparkSession
        sent = spark.sparkContext.broadcast(models)

        def run(batches):
            m = sent.value
            for batch in batches:
                zs = [(text.dot(m[0]), page.dot(m[1])) for _, _, text, page in _described(batch)]
                z = [np.concatenate([x[v] for x in zs]) if zs else np.zeros(0) for v in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).field(0), batch.column(0).field(1), *map(pa.array, z)], ["doc_id", "id", "z0", "z1"])

        z = in_batches(self.views.select(F.struct("doc_id", "id"), *_COLUMNS[1:]), run, "doc_id long, id long, z0 double, z1 double")
        sure = only(z.where((F.abs("z0") > SURE) | (F.abs("z1") > SURE)).withColumnRenamed("doc_id", "key"), self.known, "left_anti")
        out = saved(sure.groupBy("id").agg(F.max("z0").alias("z0"), F.max("z1").alias("z1")), "quality-sure")
        sent.destroy()
        return out

    def surest(self, models: list, sizes: tuple[int, int]) -> tuple[Sparse, Dense, np.ndarray]:
        """What ``cotrain`` asks for."""
        spark = self.views.sparkSession
        z = self.scored(models)
        chosen: tuple[dict, dict] = {}, {}
        for me in (0, 1):
            other = 1 - me
            free = z.where(~F.col("id").isin(list(self.given[other]))) if self.given[other] else z
            for good in (1, 0):
                s = F.col(f"z{me}") if good else -F.col(f"z{me}")
                for r in free.where(s > SURE).orderBy(s.desc(), "id").limit(sizes[good]).select("id").collect():
                    chosen[other][r.id] = good
            self.given[other].update(chosen[other])
        drop_path(spark, z)
        ids = local(spark, pa.table({"id": pa.array(sorted({*chosen[0], *chosen[1]}), pa.int64())}), "id long")
        rows = self.views.join(F.broadcast(ids), "id").dropDuplicates(["id"])
        found, text, page = _features(rows.select("id", *_COLUMNS[1:]))
        return text, page, np.array([[c.get(x, -1) for x in found] for c in chosen]).reshape(2, len(found))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", labelled: int = LABELLED) -> Model:
    """Fit on at most ``labelled`` labelled documents, chosen by a hash of doc_id, and on every unlabelled one.

    Each round reads docs twice: to score all, and for the texts of the few that are handed over. Labels
    other than 0 and 1 and null ids among labels drop out; a document with both labels or a null id
    counts as unlabelled. With fewer than two classes there is nothing to learn, and the model keeps
    every document.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label_col).alias("_lo"), F.max(label_col).alias("_hi"))
    known = known.where("_lo = _hi").select("doc_id", F.col("_lo").cast("int").alias("label"))
    # ids first: only the sample's texts are read for good
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().join(known, "doc_id").withColumn("mark", F.xxhash64("doc_id", F.lit("quality")))
    label_of = {r.doc_id: r.label for r in ids.orderBy("mark").limit(labelled).collect()}
    sample = local(docs.sparkSession, pa.table({"doc_id": pa.array(list(label_of), pa.int64())}), "doc_id long")
    arrow_bounds(docs.sparkSession)
    views = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(_view(docs, c) for c in _COLUMNS[1:]))
    found, text, page = _features(views.join(F.broadcast(sample), "doc_id").select(F.col("doc_id").alias("id"), *_COLUMNS[1:]))
    if not found:
        return Model(np.zeros(FEATURES + 1), np.zeros(PAGE), learned=False)
    return cotrain(text, page, np.array([label_of[x] for x in found]), surest=Unlabelled(views, known.select("doc_id")).surest)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(row struct, text, quality): every row of docs, its text apart and as it is, and its probability of good quality."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    arrow_bounds(docs.sparkSession)
    quoted = ("`" + c.replace("`", "``") + "`" for c in docs.columns if c.lower() != "text")
    # the columns that stay go through as one struct, clear of the views' own names; a text goes once
    rows = docs.select(F.struct(*map(F.col, quoted)).alias("row"), F.col("text").cast("string").alias("text"), *(_view(docs, c) for c in _COLUMNS[2:]))

    def run(batches):
        m = sent.value
        for batch in batches:
            out = [m.score(text, page) for _, _, text, page in _described(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(out) if out else np.zeros(0))], ["row", "text", "quality"])

    return in_batches(rows, run, StructType([rows.schema["row"], rows.schema["text"], StructField("quality", DoubleType())]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, quality, kept): probability of good quality of every document; whole texts are read.

    A null text counts as empty, a missing or null column of metadata as unknown. Every row is scored
    alone: repeated rows alike, null doc_ids too; an empty table gives an empty result; other columns play no part.
    """
    found = scored(docs.select("doc_id", *(c for c in docs.columns if c.lower() in _COLUMNS[1:])), model)
    return found.select(F.col("row.doc_id").alias("doc_id"), "quality", (F.col("quality") >= threshold).alias("kept"))
