"""Periodic runs of words: squares caught over dyadic blocks, merged into maximal runs.

Each level holds the text's completed blocks of B = 1, 2, 4, .. words, and a catcher per block.
The catcher of the block at b compares every suffix of B words that appending a word gives,
while its distance from b is 2B to 4B - 1 (1 to 3 at B = 1): so a word advances two comparisons
a level, and a suffix of B words is one hash made of two of B / 2. A hit at distance p says that
the words b .. b+B-1 come again p words on. Every stretch of 2B words holds a whole block, so no
square of period p escapes its level. Hits of neighbouring blocks at one distance are squares
of one run: they are merged, fewer than B words on either side are compared one by one, and the
whole stretch is compared again word by word, so hashes decide nothing. The comparisons of all
appended words of a text are made together, level by level, as arrays; memory is a few numbers
a word, time O(n log n).

A stretch with several periods (a period's multiples) is reported with its smallest one: such
runs have the same ends. Hits inside a known run of period B or less are its multiples and need
no comparison.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = "struct<start:long,length:long,period:long>"
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_numbers(words: list[bytes]) -> np.ndarray:
    """A number per word; equal words have equal numbers, others have others."""
    number = dict(zip(dict.fromkeys(words), itertools.count()))
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def _caught(h: np.ndarray, block: int, distance: int):
    """Hits `distance` blocks and c < `block` words after their block, merged over neighbours.

    `h` has the hash of each suffix of `block` words, by its first word. Returns the first word
    of the first block, the end of the last one, and the period.
    """
    rows = -(-len(h) // block)
    if rows <= distance:
        return None
    grid = np.zeros((rows, block), h.dtype)
    grid.reshape(-1)[:len(h)] = h
    hit = np.zeros((rows - distance + 1, block), bool)  # the last row ends every stretch
    np.equal(grid[distance:], grid[:-distance, :1], out=hit[:-1])
    hit.reshape(-1)[len(h) - distance * block:] = False
    if not hit.any():
        return None
    edges = np.flatnonzero(np.diff(hit.T.ravel().view(np.int8), prepend=0))
    column, first = np.divmod(edges[::2], len(hit))
    return first * block, first * block + (edges[1::2] - edges[::2]) * block, distance * block + column


def _stretches(same: np.ndarray):
    edges = np.flatnonzero(np.diff(same.view(np.int8), prepend=0, append=0))
    return zip(edges[::2].tolist(), edges[1::2].tolist())


def runs_of(ids: np.ndarray, min_length: int = 6, min_periods: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of `min_length` words and `min_periods` periods
    or more, by start and period; a run has its smallest period. `min_periods` is 2 at least.
    """
    n, block = len(ids), 1
    found: dict[tuple[int, int], int] = {}
    h = ids.astype(np.uint64) * _MIX
    while min_periods * (1 if block == 1 else 2 * block) <= n and n >= min_length:
        caught = [x for d in ((1, 2, 3) if block == 1 else (2, 3)) if (x := _caught(h, block, d)) is not None]
        for begin, end, period in caught:
            enough = np.maximum((min_periods - 1) * period, min_length - period)
            ok = end - begin + 2 * (block - 1) >= enough
            for (start, length), p in found.items():
                if p <= block and ok.any():
                    ok &= (begin < start) | (end + period > start + length)
            for b, e, p, least in zip(*(x[ok].tolist() for x in (begin, end, period, enough))):
                low, high = max(0, b - block), min(n - p, e + block)
                for s, t in _stretches(ids[low:high] == ids[low + p:high + p]):
                    if t - s >= least:
                        key = (low + s, t - s + p)
                        found[key] = min(p, found.get(key, p))
        h = (h[:-block] ^ (h[:-block] >> np.uint64(29))) * _MIX + (h[block:] ^ (h[block:] >> np.uint64(31))) * _STEP
        block *= 2
    return sorted(((s, length, p) for (s, length), p in found.items()), key=lambda r: (r[0], r[2]))


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside the runs, and the first period of each run where no other run drops it."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return list(itertools.compress(words, keep.tolist()))


def periodic_runs(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text",
                  min_length: int = 6, min_periods: int = 4) -> DataFrame:
    """One row per row of `docs`: its `keys`, n_words, runs and the collapsed text.

    `runs` are (start, length, period) in words from 0, by start and period; `collapsed` is the
    words that stay (a run's first period does), joined by a space. Every row is on its own, so
    nothing is shuffled.

    Null, empty and blank texts have no words, no runs and an empty collapsed text. Long texts
    are taken whole. Repeated rows and null keys are rows like others; an empty table gives an
    empty one; other columns of `docs`, whatever their names, stay outside.
    """
    if min_periods < 2:
        raise ValueError("a run has two periods at least")
    names = [*[f"_k{i}" for i in range(len(keys))], "n_words", "runs", "collapsed"]

    def scan(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, ends, flat, texts = [], [0], [], []
                for t in part.column("_text").to_pylist():
                    # On bytes, split() parts at exactly space, tab, LF, VT, FF and CR.
                    words = (t or "").encode().split()
                    runs = runs_of(word_numbers(words), min_length, min_periods)
                    sizes.append(len(words))
                    flat += runs
                    ends.append(len(flat))
                    texts.append(b" ".join(without_repeats(words, runs)).decode())
                columns = np.array(flat, np.int64).reshape(-1, 3).T
                runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(c) for c in columns], names=["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in names[:-3]], pa.array(sizes, pa.int64()), runs,
                     pa.array(texts, pa.string())], names=names)

    taken = docs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(text).alias("_text"))
    types = [f"_k{i} {f.dataType.simpleString()}" for i, f in enumerate(taken.schema[:-1])]
    out = taken.mapInArrow(scan, ", ".join([*types, "n_words long", f"runs array<{RUN}>", "collapsed string"]))
    return out.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *names[-3:])
