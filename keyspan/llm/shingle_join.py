"""Near-duplicate documents by an exact Jaccard join of word shingles with signature trees.

A document's set are its distinct 5-word shingles.  Documents with equal sets are one node.  Two nodes can only link
if they share a token of their prefixes (the part of a set that a partner of similarity 0.75 can't miss wholly), tokens
ordered frequent last.  So blocks are tokens with two or more nodes, and

1. each node of a block is compared with the block's smallest node, which joins most copies in linear work;
2. where a block still holds more than one component, a signature tree over its nodes (bitmaps combined by OR, size
   ranges) is traversed against itself and node pairs are pruned by the largest overlap they can have; pairs of
   leaves left over are compared exactly.

No pair that could link and isn't joined otherwise is left out, and no block's pairs are listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Filter, components, dropped, hot_keys, rows_of, spread_join, tidied, written
from .textscan import Words, grams, mix64, scan_words, signed, slices

K = 5
#: Similarity as a ratio of integers.
NUM, DEN = 75, 100
#: Bits of the bitmaps that trees combine, and of a node's own at most; own bitmaps have 8 bits or more for each shingle below that.
TREE_BITS, OWN_BITS = 2048, 1 << 16
#: A token in more prefixes than this counts as frequent; at most FREQUENT_MOST (the most frequent) are broadcast.
FREQUENT, FREQUENT_MOST = 50, 1_000_000
#: Nodes of a block in one tree; a larger block is cut and its parts are traversed against each other.
BLOCK = 2048
FAN = 8
_SEED = np.uint64(0xC2B2AE3D27D4EB4F)


def chunk_sets(w: Words, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(text number in the chunk, shingle hash), distinct and sorted by both."""
    h, counts = w.hashes(), w.counts
    g = grams(h, k)
    held = np.where(counts < k, counts > 0, counts - k + 1)
    docs, end = np.repeat(np.arange(len(counts)), held), np.cumsum(held)
    values = np.empty(len(docs), np.uint64)
    values[(counts >= k)[docs]] = g[w.left()[: len(g)] >= k]
    for m in range(1, k):  # fewer words: the whole sequence is the only shingle
        d = np.flatnonzero(counts == m)
        v = np.full(len(d), m, np.uint64)
        for j in range(m):
            v = v * _SEED + h[w.first[d] + j]
        values[end[d] - 1] = mix64(v)
    for d in np.flatnonzero(held > 1):  # text by text in place: far quicker than one sort by two keys
        values[end[d] - held[d] : end[d]].sort()
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
    return docs[new], values[new]


def set_ids(docs: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, id, second id) of n sets: sums of two mixes, the same for equal sets."""
    size = np.bincount(docs, minlength=n)
    first = np.r_[0, np.cumsum(size)[:-1]]
    out = [size]
    for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47):
        sums = np.r_[np.uint64(0), np.cumsum(mix64(values ^ np.uint64(salt)))]
        out.append(mix64(sums[first + size] - sums[first] + size.astype(np.uint64)))
    return tuple(out)


def node_ids(docs: np.ndarray, values: np.ndarray, n: int, renamed: dict) -> tuple[np.ndarray, np.ndarray]:
    """(size, id) of n sets: the first id, or the one that `renamed` gives to both ids where unequal sets met in the first."""
    size, s1, s2 = set_ids(docs, values, n)
    if renamed:
        for d in np.flatnonzero(np.isin(signed(s1), np.array([a for a, _ in renamed], np.int64))):
            s1[d] = np.uint64(renamed.get((int(signed(s1)[d]), int(signed(s2)[d])), int(signed(s1)[d])) & (2**64 - 1))
    return size, s1


def prefix_length(size: np.ndarray) -> np.ndarray:
    """Tokens of a set of which a partner must have one: size - ceil(size * NUM / DEN) + 1."""
    return size - -(-size * NUM // DEN) + 1


def is_in(values: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    """Whether each value is one of a sorted array."""
    if known is None or not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def prefix_places(size: np.ndarray, late: np.ndarray) -> np.ndarray:
    """The place of each value in its set, of sets of `size` values one after another, where late ones come after all others in unchanged order."""
    end = np.cumsum(size)
    before = np.r_[0, np.cumsum(late)]
    lates = np.repeat(before[end] - before[end - size], size)
    own = before[:-1] - np.repeat(before[end - size], size)
    place = np.arange(len(late)) - np.repeat(end - size, size)
    return np.where(late, np.repeat(size, size) - lates + own, place - own)


def signatures(docs: np.ndarray, values: np.ndarray, n: int) -> list[bytes]:
    """Bitmaps with a bit for each shingle's hash; a longer one folds to a shorter by OR of its parts."""
    size = np.bincount(docs, minlength=n)
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(8 * size, 2))).astype(int), TREE_BITS, OWN_BITS)
    place = ((values >> np.uint64(17)) & (bits[docs] - 1).astype(np.uint64)).astype(np.int64)
    end = np.cumsum(size)
    out = []
    for d in range(n):
        marks = np.zeros(bits[d], np.uint8)
        marks[place[end[d] - size[d] : end[d]]] = 1
        out.append(np.packbits(marks, bitorder="little").tobytes())
    return out


def folded(raws: list[bytes], bits: int) -> np.ndarray:
    """Bitmaps of `bits` bits or more, folded to that many, as rows of words."""
    words = bits // 64
    return np.stack([np.bitwise_or.reduce(np.frombuffer(r, np.uint64).reshape(-1, words), axis=0) for r in raws]) if raws else np.zeros((0, words), np.uint64)


def may_link(size: np.ndarray, raws: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether pairs can reach the similarity, by sizes and by the bits that one bitmap has and the other lacks."""
    ok = DEN * np.minimum(size[i], size[j]) >= NUM * np.maximum(size[i], size[j])
    width = np.array([8 * len(r) for r in raws], np.int64)
    common = np.minimum(width[i], width[j])
    for w in np.unique(common[ok]):
        at = np.flatnonzero(ok & (common == w))
        for a in range(0, len(at), max(1, (1 << 24) // int(w))):
            part = at[a : a + max(1, (1 << 24) // int(w))]
            used, place = np.unique(np.r_[i[part], j[part]], return_inverse=True)
            rows = folded([raws[k] for k in used], int(w))
            ones = np.bitwise_count(rows).sum(1).astype(np.int64)
            x, y = place[: len(part)], place[len(part) :]
            both = np.bitwise_count(rows[x] & rows[y]).sum(1).astype(np.int64)
            most = np.minimum(size[i[part]] - (ones[x] - both), size[j[part]] - (ones[y] - both))
            ok[part] = (NUM + DEN) * most >= NUM * (size[i[part]] + size[j[part]])
    return ok


def forest(label: np.ndarray, i: np.ndarray, j: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Places of edges (i, j) that join all labels the edges can join, none twice: each label takes its first edge by `order`, again and again."""
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    _, label = np.unique(label, return_inverse=True)
    left, chosen = np.arange(len(i)), []
    while True:
        a, b = label[i[left]], label[j[left]]
        left, a, b = left[a != b], a[a != b], b[a != b]
        if not len(left):
            return np.unique(np.concatenate(chosen)) if chosen else left
        n = int(label.max()) + 1
        first = np.full(n, len(rank), np.int64)
        np.minimum.at(first, a, rank[left])
        np.minimum.at(first, b, rank[left])
        has = np.flatnonzero(first < len(rank))
        edge = order[first[has]]
        chosen.append(np.unique(edge))
        x, y = label[i[edge]], label[j[edge]]
        parent = np.arange(n)
        parent[has] = np.where(x == has, y, x)
        both = parent[parent] == np.arange(n)  # two labels that took the same edge
        parent[both & (np.arange(n) < parent)] = np.flatnonzero(both & (np.arange(n) < parent))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


class SignatureTree:
    """Nodes of FAN children over sets sorted by size: combined bitmap, size range, component if there is only one."""

    def __init__(self, size: np.ndarray, bits: np.ndarray, component: np.ndarray):
        self.order = np.lexsort((bits[:, 0], size))
        size, bits, component = size[self.order], bits[self.order], component[self.order]
        slack = size - np.bitwise_count(bits).sum(1).astype(np.int64)  # shingles that share a bit with another
        self.levels = [(bits, size, size, slack, component, np.ones(len(size), bool))]
        while len(self.levels[-1][1]) > FAN:
            bits, low, high, slack, component, single = self.levels[-1]
            cut = np.arange(0, len(low), FAN)
            same = (np.minimum.reduceat(component, cut) == np.maximum.reduceat(component, cut)) & np.logical_and.reduceat(single, cut)
            self.levels.append((np.bitwise_or.reduceat(bits, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(slack, cut), component[cut], same))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether two nodes can hold a linked pair that isn't in one component."""
        bits, low, high, slack, component, single = self.levels[level]
        ok = (DEN * high[i] >= NUM * low[j]) & (DEN * high[j] >= NUM * low[i])
        ok &= ~(single[i] & single[j] & (component[i] == component[j]))
        at = np.flatnonzero(ok)
        for a in range(0, len(at), 1 << 15):
            part = at[a : a + (1 << 15)]
            x, y = i[part], j[part]
            both = np.bitwise_count(bits[x] & bits[y]).sum(1).astype(np.int64)
            most = np.minimum(np.minimum(high[x], high[y]), both + np.minimum(slack[x], slack[y]))
            ok[part] = (NUM + DEN) * most >= NUM * (low[x] + low[y])
        return ok

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of sets that may link, by traversing the tree against itself."""
        top = len(self.levels) - 1
        i, j = np.triu_indices(len(self.levels[top][1]))
        for level in range(top, -1, -1):
            if level == 0:
                i, j = i[i != j], j[i != j]
            keep = self.possible(level, i, j)
            i, j = i[keep], j[keep]
            if level:
                n, step = len(self.levels[level - 1][1]), np.arange(FAN)
                x = np.broadcast_to((i * FAN)[:, None, None] + step[None, :, None], (len(i), FAN, FAN)).ravel()
                y = np.broadcast_to((j * FAN)[:, None, None] + step[None, None, :], (len(i), FAN, FAN)).ravel()
                inside = (x <= y) & (y < n)
                i, j = x[inside], y[inside]
        return self.order[i], self.order[j]


def sets_table(docs: DataFrame) -> DataFrame:
    """(doc, th, n, s1, s2, bits, small) of each row of docs (doc, text, th); small is bits folded for trees."""

    def scan(batches):
        for b in batches:
            for w in scan_words(b.column(1), lower=True):
                n = w.hi - w.lo
                d, v = chunk_sets(w)
                size, s1, s2 = set_ids(d, v, n)
                raws = signatures(d, v, n)
                small = [r.tobytes() for r in folded(raws, TREE_BITS)]
                yield pa.record_batch(
                    [b.column(0).slice(w.lo, n), b.column(2).slice(w.lo, n), pa.array(size), pa.array(signed(s1)), pa.array(signed(s2)), pa.array(raws, pa.binary()), pa.array(small, pa.binary())],
                    names=["doc", "th", "n", "s1", "s2", "bits", "small"],
                )

    return docs.mapInArrow(scan, "doc long, th long, n long, s1 long, s2 long, bits binary, small binary")


def nodes_of(table: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    """(table, nodes, renamed): a node is a set with its smallest document; ids of unequal sets that meet in s1 are told apart by s2.

    Among N sets about N * N / 2 ** 65 meet: none among a billion, a few among 1e10.  All but the one with the smallest
    s2 are renamed, here and wherever sets are made again.
    """
    renamed: dict = {}
    while True:
        nodes = written(
            table.where("n > 0").groupBy("s1").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("small").alias("small"), F.min("s2").alias("s2"), F.max("s2").alias("s2_high")),
            "nodes",
        )
        met = nodes.where("s2 < s2_high").select("s1", F.col("s2").alias("stays"))
        more = table.where("n > 0").join(F.broadcast(met), "s1").where("s2 > stays").select("s1", "s2").distinct().collect() if met.take(1) else []
        if not more:
            return table, nodes, renamed
        dropped(nodes)
        for a, b in more:
            key = np.array([a, b], np.int64).view(np.uint64)
            renamed[a, b] = int(signed(mix64(key[:1] ^ mix64(key[1:] + np.uint64(len(renamed)))))[0])
        new = table.sparkSession.createDataFrame([(a, b, x) for (a, b), x in renamed.items()], "s1 long, s2 long, new long")
        table = table.join(F.broadcast(new), ["s1", "s2"], "left").withColumn("s1", F.coalesce("new", "s1")).drop("new")


def prefix_tokens(docs: DataFrame, renamed: dict, frequent=None) -> DataFrame:
    """(token, s1): the prefix of each set, frequent tokens last if they are given, equal sets of a chunk once."""

    def scan(batches):
        for b in batches:
            for w in scan_words(b.column(1), lower=True):
                n = w.hi - w.lo
                d, v = chunk_sets(w)
                size, s1 = node_ids(d, v, n, renamed)
                first_row = np.zeros(n, bool)
                first_row[np.unique(s1, return_index=True)[1]] = True
                keep = (prefix_places(size, is_in(v, frequent.value if frequent else None)) < prefix_length(size)[d]) & first_row[d]
                yield pa.record_batch({"token": signed(v[keep]), "s1": signed(s1[d[keep]])})

    return docs.mapInArrow(scan, "token long, s1 long")


def frequent_tokens(docs: DataFrame, renamed: dict):
    """A broadcast sorted array of the tokens in more than FREQUENT prefixes, the FREQUENT_MOST commonest at most.  Only the order of tokens depends on it."""
    counts = written(prefix_tokens(docs, renamed).groupBy("token").count().where(F.col("count") > FREQUENT), "frequent")
    least = FREQUENT
    if rows_of(counts) > FREQUENT_MOST:
        held = 0
        for c, n in counts.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count")).toLocalIterator():
            held += n
            if held > FREQUENT_MOST:
                least = c
                break
    tokens = counts.where(F.col("count") > least).select("token").toArrow()["token"].to_numpy().astype(np.int64).view(np.uint64)
    dropped(counts)
    return docs.sparkSession.sparkContext.broadcast(np.sort(tokens))


def verified(docs: DataFrame, pairs: DataFrame, hot: DataFrame | None, nodes: DataFrame, renamed: dict) -> DataFrame:
    """The pairs (a, b) of set ids that link, written: both sets are made again from the node's document and intersected.

    Sets are made in one pass and only of texts whose document is one of those; they are written as they come, and only
    if a count shows that one stands twice (rows that repeat id and text) brought down to one.
    """
    ids = pairs.select(F.col("a").alias("s1")).unionByName(pairs.select(F.col("b").alias("s1"))).distinct().join(nodes.select("s1", "doc"), "s1")
    doc = F.coalesce("doc", F.lit(0))
    wanted = Filter.over(ids.select(F.explode(F.array(doc, doc.bitwiseXOR(F.col("s1")))).alias("k")), "k")

    def scan(batches):
        for b in batches:
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            likely = wanted.value.has(ids)
            ids, texts = ids[likely], b.column(1).filter(pa.array(likely))
            for w in scan_words(texts, lower=True):
                n = w.hi - w.lo
                d, v = chunk_sets(w)
                size, s1 = node_ids(d, v, n, renamed)
                at = np.flatnonzero((size > 0) & wanted.value.has(ids[w.lo : w.hi] ^ signed(s1)))
                if len(at):
                    end = np.cumsum(size)
                    yield pa.record_batch([pa.array(signed(s1[at])), pa.array([v[end[x] - size[x] : end[x]].tobytes() for x in at], pa.binary())], names=["s1", "tokens"])

    def compare(batches):
        for b in batches:
            hit = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int((large[at] == small).sum())
                hit.append(DEN * common >= NUM * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

    made = written(docs.select("doc", "text").mapInArrow(scan, "s1 long, tokens binary"), "made")
    wanted.destroy()
    sets = made.dropDuplicates(["s1"]) if made.select("s1").distinct().count() < rows_of(made) else made
    one = pairs.join(sets.toDF("a", "x"), "a")
    two = spread_join(one, sets.toDF("b", "y"), ["b"], hot).select("a", "b", "x", "y")
    out = written(two.mapInArrow(compare, "a long, b long"), "links")
    dropped(made)
    return out


def plausible(pairs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(the written pairs (a, b) that sizes and bitmaps don't rule out, the hot ones of b).  Bitmaps of a hot b are read by several tasks."""
    own, hot = nodes.select("s1", "n", "bits"), hot_keys(pairs, ["b"])
    a, b = own.toDF("a", "na", "xa"), own.toDF("b", "nb", "xb")
    fits = (DEN * F.least("na", "nb")) >= (NUM * F.greatest("na", "nb"))
    sized = spread_join(pairs.join(a.drop("xa"), "a"), b.drop("xb"), ["b"], hot).where(fits).select("a", "b")

    def check(batches):
        for t in slices(batches):
            size = np.r_[t.column(2).to_numpy(), t.column(4).to_numpy()]
            at = np.arange(t.num_rows)
            ok = may_link(size, t.column(3).to_pylist() + t.column(5).to_pylist(), at, at + t.num_rows)
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(ok))

    both = spread_join(sized.join(a, "a"), b, ["b"], hot).select("a", "b", "na", "xa", "nb", "xb")
    return written(both.mapInArrow(check, "a long, b long"), "plausible"), hot


def tree_candidates(members: DataFrame, joined: DataFrame, nodes: DataFrame, every: bool) -> DataFrame:
    """Pairs (a, b) of nodes in different components that the signature trees of the blocks (token, s1) leave over.

    Not every: only as many pairs of a block as can join its components, the likeliest first, so what a block gives is linear in it.
    """
    rows = members.join(joined.select(F.col("node").alias("s1"), "component"), "s1", "left").select("token", "s1", F.coalesce("component", "s1").alias("component"))
    blocks = rows.groupBy("token").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"), F.bit_xor(F.xxhash64("s1")).alias("x"), F.bit_xor(F.xxhash64("s1", F.lit(1))).alias("y"))
    # blocks of two were compared already; blocks with the same nodes are one block
    blocks = blocks.where("size > 2 and low < high").groupBy("size", "x", "y").agg(F.min("token").alias("token"))
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.join(blocks.select("token", parts.alias("parts")), "token").withColumn("part", F.pmod(F.xxhash64("s1"), F.col("parts")).cast("int"))
    rows = rows.join(nodes.select("s1", "n", "small"), "s1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("token", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "s1", "component", "n", "small")

    def search(batches):
        def block(t: pa.Table):
            part, s1, size, component = t["part"].to_numpy(), t["s1"].to_numpy(), t["n"].to_numpy(), t["component"].to_numpy()
            bits = folded(t["small"].to_pylist(), TREE_BITS)
            i, j = SignatureTree(size, bits, component).pairs()
            if t["p"][0].as_py() != t["q"][0].as_py():
                i, j = i[part[i] != part[j]], j[part[i] != part[j]]
            if not every and len(i):
                ones = np.bitwise_count(bits).sum(1).astype(np.int64)
                both = np.concatenate([np.bitwise_count(bits[i[a : a + 32768]] & bits[j[a : a + 32768]]).sum(1) for a in range(0, len(i), 32768)]).astype(np.int64)
                alike = (64 * both / np.maximum(ones[i] + ones[j] - both, 1)).astype(np.int64)
                keep = forest(component, i, j, np.lexsort((np.maximum(s1[i], s1[j]), np.minimum(s1[i], s1[j]), -alike)))
                i, j = i[keep], j[keep]
            return pa.record_batch({"a": np.maximum(s1[i], s1[j]), "b": np.minimum(s1[i], s1[j])})

        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            keys = [held[c].to_numpy() for c in ("token", "p", "q")]
            cut = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            for a, z in zip(np.r_[0, cut[:-1]], cut, strict=False):
                yield block(held.slice(a, z - a).combine_chunks())
            held = held.slice(cut[-1]) if len(cut) else held
        if held is not None and len(held):
            yield block(held.combine_chunks())

    return rows.repartition("token", "p", "q").sortWithinPartitions("token", "p", "q").mapInArrow(search, "a long, b long").distinct()


def merged_groups(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups (node, component), written anew after links (a, b): only the components that the links touch are walked through."""
    up = groups.select("node", "component")
    lifted = links.join(up.toDF("a", "ca"), "a", "left").join(up.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = written(components(lifted), "merged")
    old = groups.join(merged.toDF("component", "low"), "component", "left").select("node", F.coalesce("low", "component").alias("component"))
    new = merged.join(groups.select("node"), "node", "left_anti").select("node", "component")
    out = written(old.unionByName(new), "groups")
    dropped(merged, groups)
    return out


def grouped(docs: DataFrame) -> DataFrame:
    """(doc, th, n, group, component_id) of every row of docs (doc, text, th); group is a number shared by a component's sets, null without words."""
    table = made = written(sets_table(docs), "sets")
    table, nodes, renamed = nodes_of(table)
    frequent = frequent_tokens(docs, renamed)
    tokens = written(prefix_tokens(docs, renamed, frequent), "tokens")
    frequent.destroy()
    tidied(docs.sparkSession)
    shared = Filter.over(tokens.groupBy("token").count().where("count > 1"), "token")

    def passing(batches):
        for b in batches:
            yield b.filter(pa.array(shared.value.has(b.column(0).to_numpy())))

    rows = written(tokens.mapInArrow(passing, "token long, s1 long"), "shared")
    shared.destroy()
    dropped(tokens)
    blocks = rows.groupBy("token").agg(F.min("s1").alias("low"), F.max("s1").alias("high")).where("low < high")
    members = written(rows.join(blocks.select("token", "low"), "token").distinct(), "members")
    dropped(rows)
    first = written(members.where("s1 <> low").select(F.col("s1").alias("a"), F.col("low").alias("b")).distinct(), "pairs")
    pairs, hot = plausible(first, nodes)
    links = verified(docs, pairs, hot, nodes, renamed)
    tidied(docs.sparkSession)
    groups, tried = written(components(links), "groups"), [pairs]
    dropped(first, links)
    for every in (False, True):  # the likeliest pairs join nearly all; then whatever pair is left between components
        more = tree_candidates(members.select("token", "s1"), groups, nodes, every)
        for t in tried:
            more = more.join(t, ["a", "b"], "left_anti")
        more = written(more, "pairs")
        tidied(docs.sparkSession)
        if rows_of(more):
            pairs, hot = plausible(more, nodes)
            tried.append(pairs)
            if rows_of(pairs):
                links = verified(docs, pairs, hot, nodes, renamed)
                groups = merged_groups(groups, links)
                dropped(links)
        dropped(more)
    dropped(members, *tried)
    low = groups.join(nodes.select("s1", "doc"), groups.node == F.col("s1")).groupBy("component").agg(F.min("doc").alias("component_id"))
    named = groups.join(low, "component").select(F.col("node").alias("s1"), "component", "component_id")
    label = nodes.select("s1", "doc").join(named, "s1", "left").select("s1", F.coalesce("component", "s1").alias("group"), F.coalesce("component_id", "doc").alias("component_id"))
    label = written(label, "labels")
    own = spread_join(table.select("doc", "th", "n", "s1"), label, ["s1"], hot_keys(made, ["s1"]) if table is made else None, "left")
    some = F.col("n") > 0
    out = written(own.select("doc", "th", "n", F.when(some, F.col("group")).alias("group"), F.when(some, F.col("component_id")).otherwise(F.col("doc")).alias("component_id")), "grouped")
    dropped(made, nodes, groups, label)
    return out


def jaccard_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: the size of its set and the smallest id reachable by links, itself included.

    Texts without words have no set and are linked with nothing.  Rows with equal ids are judged by their own texts; rows
    with a null id link like others, and have a null component if no row of it has an id.
    Ids must be integers.  An empty table gives no rows.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    return grouped(docs).select(F.col("doc").cast(dict(documents.dtypes)[id_col]).alias(id_col), F.col("n").alias("n_shingles"), "component_id")
