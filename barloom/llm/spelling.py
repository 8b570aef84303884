"""Spelling variants: the vocabulary's acceptor composed with one edit and itself.

The vocabulary is dealt to partitions of initial states. A pair one edit apart has equal
beginnings or equal ends of half the shorter word's length: with s the shorter length, both
words reach the same state after their first s // 2 code points, or after their last ones read
backwards. So a word goes to a partition per direction and shorter length (its own, and one
less), named by the code points read so far, and what the machines read there is the rest. A
partition holds words of length s and s + 1; pairs of two longer words belong to the partition
of s + 1, and pairs that share both halves to the forward one: each pair is made once.

In a partition, the words' rests make a minimal acceptor whose states number the words they
accept. Composed with the transducer that changes one code point it is enumerated from the
initial state: both readers walk together (no edit yet), then one substitutes or inserts, and
from there both must read the same to a final state. An insertion into a row of equal code
points is made behind the last one, so it is made once. Composed states are evaluated from the
final states back, so nothing recurses and long words do no harm.

Partitions above `block_words` words are cut into blocks of that size by a hash, and tasks
compose pairs of blocks: two acceptors, the same enumeration.
"""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import small_side, stored
from barloom.llm.components import followed

#: Words of one partition that one task composes; larger ones are cut.
BLOCK_WORDS = 20_000


class Acceptor:
    """The minimal acceptor of sorted distinct words.

    States are numbered from the final ones back, so arcs lead to smaller numbers. `arcs[q]`
    maps a symbol to (state, skipped): how many words of q come before those of this arc.
    A word's number is the sum of what its arcs skip: its place in the sorted list.
    """

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.arcs: list[dict] = []
        self.accepted: list[int] = []
        self._known: dict = {}
        path: list[list] = [[False, []]]  # the last word's states: final, arcs (symbol, state)
        last = ""
        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            self._close(path, last, same)
            path += [[False, []] for _ in word[same:]]
            path[-1][0] = True
            last = word
        self._close(path, last, 0)
        self.start = self._state(*path[0])

    def _close(self, path, word, down_to):
        for at in range(len(word), down_to, -1):
            state = self._state(*path.pop())
            path[-1][1].append((word[at - 1], state))

    def _state(self, final, arcs):
        key = (final, *arcs)
        if key not in self._known:
            self._known[key] = len(self.final)
            n, out = int(final), {}
            for symbol, to in arcs:
                out[symbol] = (to, n)
                n += self.accepted[to]
            self.final.append(final)
            self.arcs.append(out)
            self.accepted.append(n)
        return self._known[key]


def _closure(seeds, left: Acceptor, right: Acceptor) -> dict:
    """Composed states that read the same on from the seeds, with their common arcs."""
    known: dict = {}
    todo = list(seeds)
    while todo:
        p, q = pair = todo.pop()
        if pair in known:
            continue
        a, b = left.arcs[p], right.arcs[q]
        known[pair] = common = [(*a[c], *b[c]) for c in a if c in b]
        todo += [(x, y) for x, _, y, _ in common]
    return known


def composed(left: Acceptor, right: Acceptor) -> list[tuple[int, int]]:
    """(i, j): word i of `left` and word j of `right` are one edit apart.

    If both are one acceptor, a pair comes once, in one order or the other.
    """
    one = left is right
    walk = _closure([(left.start, right.start)], left, right)
    edits, seeds = {}, set()
    for p, q in walk:
        a, b = left.arcs[p], right.arcs[q]
        here = [(x, i, y, j) for c, (x, i) in a.items() for d, (y, j) in b.items() if (c < d if one else c != d)]
        ends = []
        for d, (y, j) in b.items():  # the right word has d more
            ends += [(0, j)] if left.final[p] and right.final[y] else []
            here += [(a[e][0], a[e][1], z, j + k) for e, (z, k) in right.arcs[y].items() if e != d and e in a]
        if not one:
            for c, (x, i) in a.items():
                ends += [(i, 0)] if left.final[x] and right.final[q] else []
                here += [(z, i + k, b[e][0], b[e][1]) for e, (z, k) in left.arcs[x].items() if e != c and e in b]
        edits[p, q] = here, ends
        seeds.update((x, y) for x, _, y, _ in here)
    same: dict = {}
    closed = _closure(seeds, left, right)
    for p, q in sorted(closed, key=sum):
        out = [(0, 0)] if left.final[p] and right.final[q] else []
        for x, i, y, j in closed[p, q]:
            out += [(i + s, j + t) for s, t in same[x, y]]
        same[p, q] = out
    pairs: dict = {}
    for p, q in sorted(walk, key=sum):
        here, out = edits[p, q]
        for x, i, y, j in here:
            out += [(i + s, j + t) for s, t in same[x, y]]
        for x, i, y, j in walk[p, q]:
            out += [(i + s, j + t) for s, t in pairs[x, y]]
        pairs[p, q] = out
    return pairs[left.start, right.start]


def _partition_pairs(backward: bool, shorter: int, affix: str, left: list, right: list | None):
    """(word, n, word, n) of one partition; `left` and `right` are sorted (rest, n)."""
    half = len(affix)
    machine = Acceptor([w for w, _ in left])
    other = machine if right is None else Acceptor([w for w, _ in right])
    right = left if right is None else right
    for i, j in composed(machine, other):
        (x, n), (y, m) = left[i], right[j]
        if len(x) + half > shorter and len(y) + half > shorter:
            continue
        x, y = affix + x, affix + y
        if backward:
            x, y = x[::-1], y[::-1]
            if x[:half] == y[:half]:
                continue
        yield x, n, y, m


def near_words(vocabulary: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, near, near_n), both directions of every pair one edit apart.

    `vocabulary` is a stored table (word, n) of distinct words of two code points or more.
    """
    size = F.char_length("word")
    shortest = vocabulary.agg(F.min(size)).first()[0] or 0
    dealt = (vocabulary.select("word", "n", F.explode(F.array(size - 1, size)).alias("shorter"))
             .where(F.col("shorter") >= shortest)
             .select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("backward")))
    half = F.floor(F.col("shorter") / 2).cast("int")
    read = F.when(F.col("backward"), F.reverse("word")).otherwise(F.col("word"))
    dealt = dealt.select("backward", "shorter", F.substr(read, F.lit(1), half).alias("affix"),
                         F.substr(read, half + 1).alias("rest"), "n")
    key = ["backward", "shorter", "affix"]
    large = stored(dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > block_words))
    blocks = F.coalesce(F.ceil(F.col("_m") / block_words), F.lit(1)).cast("int")
    dealt = (dealt.join(small_side(large), key, "left").withColumn("_b", blocks)
             .withColumn("block", F.pmod(F.xxhash64("rest"), "_b").cast("int"))
             .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
             .select(*key, F.least("block", "_o").alias("x"), F.greatest("block", "_o").alias("y"),
                     "block", "rest", "n"))
    fields = [*key, "x", "y", "block", "rest", "n"]

    def compose(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in fields))

        out: tuple = ([], [], [])

        def batch():
            made = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int64()))],
                names=["word", "near", "near_n"])
            for column in out:
                column.clear()
            return made

        for (backward, shorter, affix, x, y), group in itertools.groupby(rows(), lambda r: r[:5]):
            sides: dict = {x: [], y: []}
            for r in group:
                sides[r[5]].append(r[6:])
            left, right = sides[x], sides[y] if y != x else None
            if len(left) < 2 and right is None or right is not None and not (left and right):
                continue
            for a, n, b, m in _partition_pairs(backward, shorter, affix, left, right):
                for column, pair in zip(out, ((a, b), (b, a), (m, n))):
                    column += pair
            if len(out[0]) > 50_000:
                yield batch()
        yield batch()

    deal = [*key, "x", "y"]
    return (dealt.repartition(*deal).sortWithinPartitions(*deal, "block", "rest")
            .mapInArrow(compose, "word string, near string, near_n long"))


def spelling_variants(occurrences: DataFrame, word: str = "word", min_chars: int = 5, min_count: int = 3,
                      ratio: int = 2, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of `min_chars` code points or more that
    stands in `min_count` rows or more.

    Two words are near if one inserted, deleted or replaced code point makes them equal. A word's
    form is its near word of largest n (ties: the first in code-point order) if that is `ratio`
    times its own n or more, else null; its root is the end of its forms, or itself.

    Null and empty words are left out; a word of any length is taken whole; repeated rows are
    occurrences; an empty table gives an empty one; other columns of `occurrences`, whatever
    their names, stay outside.
    """
    if min_chars < 2:
        raise ValueError("words have two code points at least")
    if ratio < 2:
        raise ValueError("forms must be more frequent, or they could go in circles")
    vocabulary = stored(occurrences.select(F.col(word).alias("word")).where(F.char_length("word") >= min_chars)
                        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))
    near = near_words(vocabulary, block_words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    more = -F.col("best.minus") >= ratio * F.col("n")
    judged = stored(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(more, F.col("best.near")).alias("form"), F.when(more, -F.col("best.minus")).alias("form_n")))
    ends = followed(judged.where(F.col("form").isNotNull()).select(
        F.col("word").alias("node"), F.col("form").alias("parent")))
    ends = ends.select(F.col("node").alias("word"), F.col("parent").alias("root"))
    return (judged.join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
