"""Quality scores: random-indexing word vectors pooled by document, and a two-layer network with calibrated probabilities.

Random indexing: each word bucket has a sparse random index vector; a bucket's context vector is the sum of the index
vectors of the words around it over the whole corpus.  Each task keeps one small table of sums, whose size doesn't
depend on the input; the tables are added up by bucket.  A document is the mean of its words' context and index vectors.
The network is fitted with numpy on a bounded sample of labelled rows; a temperature is fitted on a part it hasn't seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import dropped, hash_sample
from .textscan import mix64, scan_words

#: Word buckets, entries of context vectors, of index vectors pooled by themselves, words to each side.
BUCKETS, CONTEXT, OWN, REACH = 1 << 13, 32, 128, 2
#: Labelled rows fetched to fit on, at most.
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 3e-3, 1e-4


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 13)).astype(np.int64)


def index_vectors(dim: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the two nonzero entries of each bucket's random index vector."""
    x = mix64(np.arange(2 * BUCKETS, dtype=np.uint64) + np.uint64(salt)).reshape(BUCKETS, 2)
    return (x % np.uint64(dim)).astype(np.int64), ((x >> np.uint64(40)) & np.uint64(1)).astype(np.int64) * 2 - 1


def context_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x CONTEXT unit vectors from all of docs (text)."""

    def scan(batches):
        place, sign = index_vectors(CONTEXT, 1)
        sums = np.zeros(BUCKETS * CONTEXT, np.int64)
        for b in batches:
            for w in scan_words(b.column(0), lower=True, marks=True):
                at, left = buckets(w.hashes()), w.left()
                for reach in range(1, REACH + 1):
                    i = np.flatnonzero(left > reach)
                    x, y = at[i], at[i + reach]
                    for word, near in ((x, y), (y, x)):
                        for k in (0, 1):
                            np.add.at(sums, word * CONTEXT + place[near, k], sign[near, k])
        sums = sums.reshape(BUCKETS, CONTEXT)
        used = np.flatnonzero(sums.any(1))
        yield pa.record_batch([pa.array(used), *[pa.array(sums[used, i]) for i in range(CONTEXT)]], names=["bucket", *[f"c{i}" for i in range(CONTEXT)]])

    cols = [f"c{i}" for i in range(CONTEXT)]
    got = docs.mapInArrow(scan, "bucket long, " + ", ".join(f"{c} long" for c in cols)).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in cols]).toArrow()
    out = np.zeros((BUCKETS, CONTEXT))
    out[got["bucket"].to_numpy()] = np.stack([got[c].to_numpy() for c in cols], 1) if len(got) else 0
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1)).astype(np.float32)


def pooled(column: pa.Array, context: np.ndarray):
    """Yields (lo, hi, vectors) of the texts of a column: means of context and index vectors, and log length."""
    place, sign = index_vectors(OWN, 2)
    for w in scan_words(column, lower=True, marks=True):
        n, at, doc, counts = w.hi - w.lo, buckets(w.hashes()), w.doc, w.counts
        out = np.zeros((n, CONTEXT + OWN + 1), np.float32)
        own = np.zeros(n * OWN)
        for k in (0, 1):
            own += np.bincount(doc * OWN + place[at, k], sign[at, k], n * OWN)
        out[:, CONTEXT : CONTEXT + OWN] = own.reshape(n, OWN)
        some = np.flatnonzero(counts)
        if len(some):
            out[some, :CONTEXT] = np.add.reduceat(context[at], w.first[some], axis=0)
        out[:, :-1] /= np.maximum(counts, 1)[:, None]
        out[:, -1] = np.log1p(counts)
        yield w.lo, w.hi, out


@dataclass
class Network:
    """Standardised input, a hidden layer of rectifiers, a logit divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Adam on logistic loss over four fifths of the rows; the temperature on the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, rows = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[rows].mean(0), x[rows].std(0) + 1e-3
    net = Network(mean, scale, rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), float(np.log((y[rows].mean() + 1e-3) / (1 - y[rows].mean() + 1e-3))))
    params, z = [net.w1, net.b1, net.w2, np.array([net.b2])], (x - mean) / scale
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        rng.shuffle(rows)
        for a in range(0, len(rows), BATCH):
            part, t = rows[a : a + BATCH], t + 1
            pre = z[part] @ params[0] + params[1]
            h = np.maximum(pre, 0)
            err = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30))) - y[part]) / len(part)
            back = np.outer(err, params[2]) * (pre > 0)
            grads = [z[part].T @ back + DECAY * params[0], back.sum(0), h.T @ err + DECAY * params[2], np.array([err.sum()])]
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                params[i] -= RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = *params[:3], float(params[3][0])
    if len(held) >= 20:
        logit = net.logit(x[held])
        losses = {t: np.logaddexp(0, np.where(y[held] > 0, -logit, logit) / t).mean() for t in np.exp(np.linspace(np.log(0.5), np.log(10), 60))}
        net.temperature = float(min(losses, key=losses.get))
    return net


def held_out(id_col: str) -> Column:
    """Rows that take no part in learning: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, held_out, score, predicted) of every row of docs.

    The sample to learn from are labelled ids below a hash limit, about `sample` at most, with one text each: ids with several
    labels take the largest, ids with several texts the one with the smallest hash, so reruns agree.  Without labels of both kinds every score is the share of label 1 (0.5 if there is none).  Null and empty texts get
    the score of an empty text; repeated rows stay.  The texts are read three times and never shuffled.
    """
    context = context_vectors(docs.select(text_col))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    known = hash_sample(known, sample, id_col)
    vectors = docs.sparkSession.sparkContext.broadcast(context)

    def train_rows(batches):
        for b in batches:
            for lo, hi, x in pooled(b.column(1), vectors.value):
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary()), b.column(2).slice(lo, hi - lo)], names=["id", "x", "y"])

    kind = dict(docs.dtypes)[id_col]
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known.select(F.col(id_col).alias("id"), "y")), "id")
    one = named.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y"))  # repeated rows meet before anything is fetched
    got = one.mapInArrow(train_rows, f"id {kind}, x binary, y int").toArrow()
    dropped(known)
    got = got.sort_by("id") if len(got) else got
    y = got["y"].to_numpy().astype(float)
    net = None
    if 0 < y.sum() < len(y):
        net = fit_network(np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(len(y), -1).astype(float), y)
    model, flat = docs.sparkSession.sparkContext.broadcast(net), float(y.mean()) if len(y) else 0.5

    def score(batches):
        for b in batches:
            for lo, hi, x in pooled(b.column(1), vectors.value):
                p = model.value.score(x.astype(float)) if model.value is not None else np.full(hi - lo, flat)
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    return docs.select(id_col, text_col, held_out(id_col).alias("held_out")).mapInArrow(score, f"{id_col} {kind}, held_out boolean, score double, predicted int")
