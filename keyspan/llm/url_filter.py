"""URL filters: rules by host and path, else gradient-boosted trees on lexical features.

The trees are fitted on URLs that the rules label (a bounded sample of distinct ones by hash) with numpy histograms, shipped
as a few arrays, and applied to all other URLs in Arrow batches.  Statistics of a host's suffix are made from all urls.  A
suffix with labels of one kind, or none, says only which rule it is under, so its statistics are replaced by the mean, and
each row is also learnt from with the mean, as the trees judge urls whose suffix no rule covers.  The block rate of a path's first segment is taken
across hosts: a training row's from other hosts than its own.  Both classes weigh the same, and the cut is chosen on hosts
that the trees haven't seen.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import dropped, hash_sample
from .textscan import slices, text_buffers

#: (rule string, verdict).  Text up to the first slash is the host, the rest the path.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: At most so many labelled URLs are fetched to fit on.
SAMPLE = 20_000
BINS = 32
#: Buckets of suffixes and of path segments by hash, parts that hosts are dealt to, rows of the mean that a segment's rate is drawn to.
BUCKETS, FOLDS, PRIOR = 1 << 12, 5, 10.0


def split_url(url):
    """(host, path) columns: host after the first :// up to / ? # or end with A-Z lower-cased, path up to ? # or end; empty without ://."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: str, path: str, rules):
    """The longest rule that fits as struct (rule, verdict), null if none does."""
    out = None
    for text, verdict in sorted(rules, key=lambda r: len(r[0])):
        h, _, p = text.partition("/")
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith("/" + p)
        hit = F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else F.when(fits, hit).otherwise(out)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def byte_counts(column: pa.Array) -> np.ndarray:
    """How often each byte stands in each text, a row a text; nulls as empty ones."""
    data, offsets = text_buffers(column)
    n, size = len(column), np.diff(offsets)
    return np.bincount(np.repeat(np.arange(n), size) * 256 + data[offsets[0] : offsets[-1]], minlength=256 * n).reshape(n, 256)


def entropy(counts: np.ndarray) -> np.ndarray:
    """Bits a byte of each row of counts."""
    p = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(1)


def features(url: pa.Array, host: pa.Array, path: pa.Array, suffix: np.ndarray, statistics: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Lexical features, a row a url: lengths, depth, digit ratios, entropies, parameters, signs, statistics of the suffix (share, depth, parameters), rate of the first segment."""
    u, h, p = byte_counts(url), byte_counts(host), byte_counts(path)
    sign = lambda counts, c: counts[:, ord(c)]
    digits = lambda counts: counts[:, 48:58].sum(1) / np.maximum(counts.sum(1), 1)
    size = [x.sum(1) for x in (u, h, p)]
    columns = [
        *size, size[0] - size[1] - size[2], sign(p, "/"), digits(u), digits(h), entropy(u), entropy(h), sign(u, "=") + sign(u, "&"),
        sign(h, "."), sign(h, "-"), sign(p, "-"), sign(p, "."), sign(u, "#"), *statistics[suffix].T, rate,
    ]
    return np.stack(columns, 1).astype(float)


def suffix_statistics(urls: DataFrame) -> np.ndarray:
    """BUCKETS x 3: share of all urls, mean depth of paths and mean number of parameters of each bucket of suffixes; urls has url, path, suffix."""
    depth = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    params = F.coalesce(F.length("url") - F.length(F.translate("url", "=&", "")), F.lit(0))
    rows = urls.groupBy("suffix").agg(F.count("*").alias("n"), F.avg(depth).alias("depth"), F.avg(params).alias("params")).toArrow()
    out = np.zeros((BUCKETS, 3))
    if len(rows):
        n = rows["n"].to_numpy()
        out[rows["suffix"].to_numpy()] = np.stack([n / n.sum(), rows["depth"].to_numpy(), rows["params"].to_numpy()], 1)
    return out


def segment_rates(segment: np.ndarray, blocked: np.ndarray) -> np.ndarray:
    """Block rate of each bucket of segments, drawn to the mean by PRIOR rows."""
    mean = blocked.mean() if len(blocked) else 0.5
    return (np.bincount(segment, blocked, BUCKETS) + PRIOR * mean) / (np.bincount(segment, minlength=BUCKETS) + PRIOR)


@dataclass
class Boosted:
    """Boosted trees of fixed depth; node i's children are 2i+1 and 2i+2."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
            z += leaf[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-z))


def fit_boosted(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 40, depth: int = 3, rate: float = 0.2, least: int = 20, l2: float = 1.0) -> Boosted:
    """Second-order boosting on logistic loss over quantile bins."""
    weight = np.ones(len(y)) if weight is None else weight
    p = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], 1)
    z, inner, model = np.full(len(y), start), 2**depth - 1, Boosted(start, [], [], [], depth)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-z))
        grad, hess, at = weight * (y - q), weight * q * (1 - q), np.zeros(len(y), int)
        feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
        for node in range(inner):
            rows, best = np.flatnonzero(at == node), 1e-6
            found = None
            if len(rows) >= 2 * least:
                g, h = grad[rows].sum(), hess[rows].sum()
                for j, c in enumerate(cuts):
                    b = binned[rows, j]
                    gl = np.cumsum(np.bincount(b, grad[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, hess[rows], len(c) + 1))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                    gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
                    gain[(nl < least) | (len(rows) - nl < least)] = 0
                    if len(gain) and gain.max() > best:
                        best, found = gain.max(), (j, int(gain.argmax()))
            right = np.zeros(len(rows), int)
            if found:
                feature[node], cut[node] = found[0], cuts[found[0]][found[1]]
                right = binned[rows, found[0]] > found[1]
            at[rows] = 2 * node + 1 + right
        place = at - inner
        leaf = rate * np.bincount(place, grad, inner + 1) / (np.bincount(place, hess, inner + 1) + l2)
        z += leaf[place]
        model.feature.append(feature), model.cut.append(cut), model.leaf.append(leaf)
    return model


@dataclass
class UrlModel:
    """Trees, suffix statistics, segment rates, and the score from which a url is blocked."""

    trees: Boosted
    statistics: np.ndarray
    rates: np.ndarray
    cut: float

    def score(self, url: pa.Array, host: pa.Array, path: pa.Array, suffix: np.ndarray, segment: np.ndarray) -> np.ndarray:
        return self.trees.score(features(url, host, path, suffix, self.statistics, self.rates[segment]))


def best_cut(score: np.ndarray, blocked: np.ndarray) -> float:
    """The score between two neighbours that gives the best mean of both classes' accuracies, nearest to a half among equals; a half without both classes."""
    if not 0 < blocked.sum() < len(blocked):
        return 0.5
    found = np.unique(score)
    cuts = np.r_[0.5, (found[1:] + found[:-1]) / 2]
    right = [((score >= c)[blocked].mean() + (score < c)[~blocked].mean(), -abs(c - 0.5), c) for c in cuts]
    return float(max(right)[2])


def fit_filter(rows: pa.Table, blocked: np.ndarray, statistics: np.ndarray) -> UrlModel:
    """A model from labelled urls (url, host, path, suffix, segment)."""
    column = lambda c: rows[c].combine_chunks()
    segment, suffix = rows["segment"].to_numpy(), rows["suffix"].to_numpy()
    fold = np.array([zlib.crc32(h.encode()) % FOLDS for h in rows["host"].to_pylist()])
    seen = fold > 0 if 0 < blocked[fold > 0].sum() < (fold > 0).sum() else fold >= 0
    rate = np.zeros(len(blocked))
    for k in range(FOLDS):
        others = seen & (fold != k)
        rate[fold == k] = segment_rates(segment[others], blocked[others])[segment[fold == k]]
    mean = statistics[suffix[seen]].mean(0)
    both = (np.bincount(suffix[seen], blocked[seen], BUCKETS) > 0) & (np.bincount(suffix[seen], ~blocked[seen], BUCKETS) > 0)
    statistics = np.where(both[:, None], statistics, mean)
    forms = [features(column("url"), column("host"), column("path"), suffix, x, rate) for x in (statistics, np.broadcast_to(mean, statistics.shape))]
    share = blocked[seen].mean()
    weight = np.where(blocked[seen], 0.25 / share, 0.25 / (1 - share))
    trees = fit_boosted(np.concatenate([x[seen] for x in forms]), np.tile(blocked[seen].astype(float), 2), np.tile(weight, 2))
    cut = best_cut(np.concatenate([trees.score(x[~seen]) for x in forms]), np.tile(blocked[~seen], 2))
    return UrlModel(trees, statistics, segment_rates(segment[seen], blocked[seen]), cut)


def filter_urls(pages: DataFrame, rules=RULES, sample: int = SAMPLE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, block_score) of every row; block_score is null where a rule decides.

    Null, empty and scheme-less urls have an empty host and path and are judged by the trees like others;
    without labelled urls of both kinds everything unruled gets the commoner label, or allow.  Repeated rows stay.
    The sample to fit on are distinct ruled urls below a hash limit, about `sample` at most.
    """
    host, path = split_url("url")
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", "url", host.alias("host"), path.alias("path"))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
    suffix, segment = F.substring_index("host", ".", -2), F.regexp_extract("path", "^/([^/]*)", 1)
    judged = base.withColumn("hit", ruled("host", "path", rules)).select("id", "url", "host", "path", "hit.rule", "hit.verdict", bucket(suffix).alias("suffix"), bucket(segment).alias("segment"))
    chosen = hash_sample(judged.where("rule is not null").select("url", "host", "path", "suffix", "segment", "verdict"), sample, "url")
    got = chosen.toArrow().sort_by("url")
    dropped(chosen)
    blocked = np.array([v == "block" for v in got["verdict"].to_pylist()], bool)
    model = fit_filter(got, blocked, suffix_statistics(judged)) if 0 < blocked.sum() < len(blocked) else None
    default = "block" if len(blocked) and blocked.all() else "allow"

    def judge(batches):
        for b in slices(batches, 4096):
            verdict, score = b.column("verdict"), pa.nulls(b.num_rows, pa.float64())
            open_ = np.flatnonzero(verdict.is_null().to_numpy(zero_copy_only=False))
            own = np.array(verdict.to_pylist(), object)
            if len(open_):
                own[open_] = default
                if model is not None:
                    part = b.take(pa.array(open_))
                    p = model.score(part.column("url"), part.column("host"), part.column("path"), part.column("suffix").to_numpy(), part.column("segment").to_numpy())
                    own[open_] = np.where(p >= model.cut, "block", "allow")
                    scores = np.full(b.num_rows, np.nan)
                    scores[open_] = p
                    score = pa.array(scores, from_pandas=True)
            yield pa.record_batch([b.column("id"), b.column("host"), b.column("path"), b.column("rule"), pa.array(own.tolist(), pa.string()), score], names=[id_col, "host", "path", "rule", "verdict", "block_score"])

    return judged.mapInArrow(judge, f"`{id_col}` {dict(pages.dtypes)[id_col]}, host string, path string, rule string, verdict string, block_score double")
