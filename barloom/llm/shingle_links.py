"""Links between texts whose word shingles are alike (exact Jaccard at or above a threshold).

A node is a distinct text, named by its hash. Candidates come from MinHash bands: nodes
that agree in all rows of a band. Bands of groups of near copies are hot, so pairs are not
taken from them directly:

1. Bands are counted, and only those that two nodes share go on.
2. Every node points to the smallest node that leads two of its shared bands; where the pointers
   end is its pivot. Nodes with one pivot form a group; all pairs inside a group are
   candidates. A group is cut into blocks,
   and a task holds a pair of blocks, so a group of any size is many bounded tasks. A task
   hands on a count of links and a local root per node, never the pairs.
3. Bands whose nodes have different pivots give the remaining candidates, again by pairs of
   blocks; a pair is taken in the first band that both share, so once.

Pruning is Bayesian: MinHash values are compared some at a time; with m of n equal, the
posterior of the similarity under a uniform prior is Beta(m + 1, n - m + 1), and the pair is
dropped as soon as the probability of reaching the threshold is below the tolerance. What
is left is verified on the exact sets of shingle hashes (64 bits).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import small_side, stored
from barloom.llm.components import followed

BLOCK_NODES = 256
#: Band keys (one number each) that may be sent to every executor.
BROADCAST_KEYS = 2_000_000
_STEP = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PAIRS_AT_ONCE = 500_000
_CACHED_SHINGLES = 65_536


def text_node(text: Column) -> Column:
    """The name of a text: 16 bytes; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _mixed(g: np.ndarray) -> np.ndarray:
    g = (g ^ (g >> np.uint64(32))) * _MIX
    return g ^ (g >> np.uint64(29))


def shingle_hashes(words: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words per text; a shorter text is one shingle of all its words."""
    words = words.view(np.uint64)
    starts = np.cumsum(sizes) - sizes
    counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    ends = np.cumsum(counts)
    at = np.arange(int(counts.sum())) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)
    left = np.repeat(np.minimum(sizes, n), counts)
    g = np.zeros(len(at), np.uint64)
    last = len(words) - 1
    short = bool((left < n).any())
    for k in range(n):
        step = _mixed(g) + words[np.minimum(at + k, last)] if len(at) else g
        g = np.where(k < left, step, g) if short else step
    return _mixed(g), counts


def _family(k: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(20240229)
    return (r.randint(0, 2**31, k, np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1),
            r.randint(0, 2**32, k, np.int64).astype(np.uint32))


def minhashes(shingles: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """One row of k values per text; every text must have a shingle."""
    a, b = _family(k)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(counts), k), np.uint32)
    ends = np.cumsum(counts)
    first = 0
    while first < len(counts):
        base = ends[first] - counts[first]
        upto = max(first + 1, int(np.searchsorted(ends, base + _CACHED_SHINGLES, side="right")))
        part = x[base:ends[upto - 1]]
        starts = (ends[first:upto] - counts[first:upto] - base).astype(np.intp)
        for i in range(k):
            v = part * a[i] + b[i]
            v ^= v >> np.uint32(15)
            out[first:upto, i] = np.minimum.reduceat(v, starts)
        first = upto
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands): hashes of a band's rows; the lowest 6 bits are the band's number."""
    g = np.zeros((len(signatures), bands), np.uint64)
    for i in range(rows):
        g = _mixed(g + np.uint64(1)) + signatures[:, i:bands * rows:rows].astype(np.uint64)
    return (_mixed(g) & ~np.uint64(63) | np.arange(bands, dtype=np.uint64)).view(np.int64)


def matches_needed(k: int, threshold: float, tolerance: float, step: int = _STEP) -> dict[int, int]:
    """After n values, the fewest matches with which a pair is kept.

    The posterior probability of a similarity >= t is that of at most m successes in n + 1
    trials of probability t.
    """
    needed = {}
    for n in [*range(step, k, step), k]:
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m)
                              + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
        needed[n] = m
    return needed


def pruned(sig: np.ndarray, i: np.ndarray, j: np.ndarray, needed: dict[int, int]) -> np.ndarray:
    """Which of the pairs (i, j) are still possible after comparing MinHash values."""
    alive = np.arange(len(i))
    matches = np.zeros(len(i), np.int32)
    done = 0
    for n, least in needed.items():
        matches[alive] += (sig[i[alive], done:n] == sig[j[alive], done:n]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
        done = n
    return alive


def _index_pairs(first: int, second: int):
    """All pairs inside one block (second = 0) or between two, some at a time."""
    if not second:
        rows = np.arange(first)
        at = 0
        while at < first:
            upto = at + 1
            while upto < first and (upto - at) * first < _PAIRS_AT_ONCE:
                upto += 1
            own = rows[at:upto]
            i, j = np.repeat(own, first), np.tile(rows, len(own))
            yield i[i < j], j[i < j]
            at = upto
    else:
        step = max(1, _PAIRS_AT_ONCE // second)
        for at in range(0, first, step):
            own = np.arange(at, min(first, at + step))
            yield np.repeat(own, second), np.tile(np.arange(first, first + second), len(own))


def shared_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """|sets[i] & sets[j]| of every pair."""
    involved = np.unique(np.concatenate([i, j]))
    if len(i) <= 4 * len(involved):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    # Many pairs of few texts: count through a 0/1 matrix of texts and shared shingles.
    place = np.full(int(involved.max()) + 1, -1)
    place[involved] = np.arange(len(involved))
    flat = np.concatenate([sets[a] for a in involved])
    owner = np.repeat(np.arange(len(involved)), [len(sets[a]) for a in involved])
    _, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    common = n[at] > 1
    at, owner = np.unique(at[common], return_inverse=True)[1], owner[common]
    total = np.zeros((len(involved), len(involved)), np.float32)
    width = max(1, 8_000_000 // len(involved))
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for start in range(0, int(at.max(initial=-1)) + 1, width):
        lo, hi = np.searchsorted(at, [start, start + width])
        x = np.zeros((len(involved), width), np.float32)
        x[owner[lo:hi], at[lo:hi] - start] = 1
        total += x @ x.T
    return np.rint(total[place[i], place[j]]).astype(np.int64)


def alike(shared: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """shared / (a + b - shared) >= p / q, in whole numbers."""
    p, q = threshold
    return q * shared >= p * (a + b - shared)


def _local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def _sets_of(column, n: int):
    """Shingle sets, and their hashes in one array with sizes, of a column of word-hash lists."""
    words = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat, counts = shingle_hashes(words, sizes, n)
    sets = [np.unique(x) for x in np.split(flat, np.cumsum(counts)[:-1])] if len(counts) else []
    return sets, flat, counts


class ShingleLinks:
    """The steps, with their parameters.

    `shingle` words make a shingle; a link needs a similarity of `threshold` (p, q) = p / q;
    `bands` x `rows` MinHash values name candidates, `values` of them are compared at most.
    """

    def __init__(self, shingle: int = 5, threshold: tuple[int, int] = (4, 5), bands: int = 24, rows: int = 4,
                 values: int = 128, tolerance: float = 1e-6):
        if values < bands * rows or bands > 64:
            raise ValueError("bands x rows values are needed at least, and 64 bands at most")
        self.n, self.threshold, self.bands, self.rows, self.k = shingle, threshold, bands, rows, values
        self.needed = matches_needed(values, threshold[0] / threshold[1], tolerance)

    def sketches(self, texts: DataFrame) -> DataFrame:
        """(kept columns, n, sig) of rows (kept columns, words), rows without words left out."""
        kept = [c for c in texts.columns if c != "words"]
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name in kept)
        return texts.where(F.size("words") > 0).mapInArrow(
            lambda batches: self.sketched(batches, kept), f"{fields}, n long, sig binary")

    def sketched(self, batches, kept: list[str]):
        """Batches (kept columns, n, sig) of batches (kept columns, words), all with words."""
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                sizes = part.column("words").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                flat, counts = shingle_hashes(
                    part.column("words").flatten().to_numpy(zero_copy_only=False), sizes, self.n)
                sig = minhashes(flat, counts, self.k)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], pa.array(sizes),
                     pa.array([s.tobytes() for s in sig], pa.binary())], names=[*kept, "n", "sig"])

    def band_rows(self, sketched: DataFrame) -> DataFrame:
        """(key, node), one row per band."""
        k, bands, rows = self.k, self.bands, self.rows

        def keys(batches):
            for batch in batches:
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, k)
                key = band_keys(sig, bands, rows).reshape(-1)
                nodes = batch.column("node").take(pa.array(np.repeat(np.arange(len(sig)), bands)))
                yield pa.RecordBatch.from_arrays([pa.array(key), nodes], names=["key", "node"])

        return sketched.select("node", "sig").mapInArrow(keys, "key long, node binary")

    def shared_bands(self, sketched: DataFrame) -> DataFrame:
        """(key, node) of the bands that different nodes share, each once; stored."""
        rows = self.band_rows(sketched)
        told = F.xxhash64("node")
        keys = stored(rows.groupBy("key").agg(F.min(told).alias("lo"), F.max(told).alias("hi"))
                      .where("lo != hi").select("key"))
        return stored(rows.join(small_side(keys, BROADCAST_KEYS), "key").distinct())

    @staticmethod
    def pivots(shared: DataFrame) -> DataFrame:
        """(node, pivot): where a node's pointers end; stored.

        A node points to the smallest node that is the least of two of its shared bands or
        more; one band in common is often chance. Pointers lead to smaller nodes only.
        """
        smallest = shared.groupBy("key").agg(F.min("node").alias("pivot"))
        votes = shared.join(smallest, "key").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("votes"))
        pointers = votes.groupBy("node").agg(F.min(F.when(F.col("votes") > 1, F.col("pivot"))).alias("p"))
        pointers = pointers.select("node", F.coalesce("p", "node").alias("parent"))
        near = followed(pointers).withColumnRenamed("parent", "pivot")
        # Groups that the pointers of single nodes left apart: a group follows another if a
        # quarter of its nodes, by two bands or more, meet that one.
        placed = stored(shared.join(near, "node"))
        leads = placed.groupBy("key").agg(F.min("pivot").alias("lead"))
        met = (placed.join(leads, "key").where("lead != pivot").groupBy("pivot", "lead", "node")
               .agg(F.count(F.lit(1)).alias("bands"))
               .groupBy("pivot", "lead").agg(F.count(F.lit(1)).alias("nodes"), F.sum("bands").alias("bands")))
        sizes = near.groupBy("pivot").agg(F.count(F.lit(1)).alias("size"))
        up = (met.join(sizes, "pivot").where("bands > 1 and 4 * nodes >= size")
              .groupBy("pivot").agg(F.min("lead").alias("lead")))
        groups = followed(sizes.join(up, "pivot", "left").select(
            F.col("pivot").alias("node"), F.coalesce("lead", "pivot").alias("parent")))
        ends = groups.select(F.col("node").alias("pivot"), F.col("parent").alias("_end"))
        return stored(near.join(ends, "pivot").select("node", F.col("_end").alias("pivot")))

    @staticmethod
    def block_pairs(rows: DataFrame, group: str, payload: list[str]) -> DataFrame:
        """Rows of `group` dealt to pairs of blocks: (group, x, y, members), bounded lists.

        `x` = `y` holds one block, else the rows of both with their block in `block`. Pairs are
        dealt by all three columns: a join by `group` alone would leave a hot group in one task.
        """
        sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_m")).where("_m > 1")
        dealt = (rows.join(sizes, group).withColumn("_n", F.ceil(F.col("_m") / BLOCK_NODES).cast("int"))
                 .withColumn("block", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
                 .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
                 .withColumn("x", F.least("block", "_o")).withColumn("y", F.greatest("block", "_o")))
        return (dealt.repartition(group, "x", "y").groupBy(group, "x", "y")
                .agg(F.collect_list(F.struct("block", "node", *payload)).alias("members")))

    def group_links(self, members: DataFrame) -> DataFrame:
        """(node, links, root): inside groups; rows (node, pivot, words)."""
        n, k, needed, threshold = self.n, self.k, self.needed, self.threshold

        def link(batches):
            for batch in batches:
                out = ([], [], [])
                for x, y, rows in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(),
                                      batch.column("members")):
                    rows = rows.values
                    block = rows.field("block").to_numpy(zero_copy_only=False)
                    nodes = rows.field("node").to_pylist()
                    # A row can stand here twice; its second copy is left out. First block first.
                    order = [i for b in sorted({x, y}) for i in np.flatnonzero(block == b)]
                    order = list({nodes[i]: i for i in reversed(order)}.values())[::-1]
                    first = sum(block[i] == x for i in order)
                    second = len(order) - first if x != y else 0
                    if len(order) < 2 or x != y and not (first and second):
                        continue
                    nodes = [nodes[i] for i in order]
                    sets, flat, counts = _sets_of(rows.field("words").take(pa.array(order)), n)
                    sig = minhashes(flat, counts, k)
                    size = np.array([len(s) for s in sets])
                    ii, jj = [], []
                    for i, j in _index_pairs(first, second):
                        alive = pruned(sig, i, j, needed)
                        i, j = i[alive], j[alive]
                        if len(i):
                            ok = alike(shared_counts(sets, i, j), size[i], size[j], threshold)
                            ii.append(i[ok])
                            jj.append(j[ok])
                    if not ii:
                        continue
                    i, j = np.concatenate(ii), np.concatenate(jj)
                    links = np.bincount(np.concatenate([i, j]), minlength=len(nodes))
                    root = _local_roots(len(nodes), i, j)
                    for a in np.flatnonzero(links):
                        for column, value in zip(out, (nodes[a], int(links[a]), nodes[root[a]])):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())],
                    names=["node", "links", "root"])

        return self.block_pairs(members, "pivot", ["words"]).select("x", "y", "members").mapInArrow(
            link, "node binary, links long, root binary")

    def cross_candidates(self, shared: DataFrame, pivots: DataFrame, sketched: DataFrame) -> DataFrame:
        """(a, b): candidates with different pivots that pruning leaves, each once; stored."""
        k, bands, rows, needed = self.k, self.bands, self.rows, self.needed
        placed = shared.join(pivots, "node")
        told = F.xxhash64("pivot")
        mixed = stored(placed.groupBy("key").agg(F.min(told).alias("lo"), F.max(told).alias("hi"))
                       .where("lo != hi").select("key"))
        told = stored(placed.join(small_side(mixed, BROADCAST_KEYS), "key"))
        sig = (sketched.select("node", "sig").join(small_side(stored(told.select("node").distinct())), "node")
               .groupBy("node").agg(F.first("sig").alias("sig")))

        def pair(batches):
            for batch in batches:
                a_out, b_out = [], []
                for key, x, y, members in zip(batch.column("key").to_pylist(), batch.column("x").to_pylist(),
                                              batch.column("y").to_pylist(), batch.column("members")):
                    members = members.values
                    block = members.field("block").to_numpy(zero_copy_only=False)
                    order = np.argsort(block, kind="stable")
                    first = int((block == x).sum())
                    second = len(order) - first if x != y else 0
                    if x != y and not (first and second):
                        continue
                    nodes = members.field("node").take(pa.array(order)).to_pylist()
                    pivot = np.unique(np.array(members.field("pivot").take(pa.array(order)).to_pylist(), "S16"),
                                      return_inverse=True)[1]
                    s = np.frombuffer(b"".join(members.field("sig").take(pa.array(order)).to_pylist()),
                                      np.uint32).reshape(-1, k)
                    for i, j in _index_pairs(first, second):
                        apart = pivot[i] != pivot[j]
                        i, j = i[apart], j[apart]
                        alive = pruned(s, i, j, needed)
                        i, j = i[alive], j[alive]
                        same = (s[i, :bands * rows] == s[j, :bands * rows]).reshape(-1, bands, rows).all(axis=2)
                        here = same.argmax(axis=1) == key & 63
                        a_out += [nodes[p] for p in i[here]]
                        b_out += [nodes[p] for p in j[here]]
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.binary()), pa.array(b_out, pa.binary())],
                                                 names=["a", "b"])

        dealt = self.block_pairs(told.join(sig, "node"), "key", ["pivot", "sig"])
        return stored(dealt.select("key", "x", "y", "members").mapInArrow(pair, "a binary, b binary"),
                      batch_rows=256)

    def verified(self, pairs: DataFrame, members: DataFrame) -> DataFrame:
        """The pairs (a, b) that reach the threshold; stored. `members` has (node, words)."""
        n, threshold = self.n, self.threshold
        words = members.select("node", "words")
        both = (pairs.join(words.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a")
                .join(words.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b"))

        def verify(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 1_000):
                    part = batch.slice(at, 1_000)
                    sa, sb = _sets_of(part.column("wa"), n)[0], _sets_of(part.column("wb"), n)[0]
                    shared = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(sa, sb)])
                    ok = alike(shared, np.array([len(s) for s in sa]), np.array([len(s) for s in sb]), threshold)
                    keep = pa.array(np.flatnonzero(ok))
                    yield pa.RecordBatch.from_arrays([part.column("a").take(keep), part.column("b").take(keep)],
                                                     names=["a", "b"])

        return stored(both.select("a", "b", "wa", "wb").mapInArrow(verify, "a binary, b binary").distinct())

    def run(self, sketched: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
        """(links per node, edges): (node, links) and (a, b), whose components are the classes.

        `sketched` is a stored table of `sketches` with a `node` (copies may repeat it);
        `fetch` gives (node, words) for the nodes of a stored frame.
        """
        shared = self.shared_bands(sketched)
        pivots = self.pivots(shared)
        members = stored(fetch(pivots.select("node")).join(small_side(pivots), "node"))
        inside = stored(self.group_links(members), batch_rows=32)
        across = self.verified(self.cross_candidates(shared, pivots, sketched), members)
        ends = across.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("long").alias("links"))
        links = inside.select("node", "links").union(ends).groupBy("node").agg(F.sum("links").alias("links"))
        return links, inside.select(F.col("node").alias("a"), F.col("root").alias("b")).union(across)
