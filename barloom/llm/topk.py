"""Exact top-k inner-product search, a block of vectors at a time.

Vectors are integers; a term is a component. The rows are brought into an order in which
neighbours are alike (by the nearest of a few pivot rows, then by the product with it),
cut into blocks of consecutive rows, and each block keeps its largest and smallest value
per term. For a query, the sum over terms of what the block could add at most bounds all
its scores. Blocks are visited from the highest bound down; a block's own rows (its
forward index) are scored together; a query stops when the next bound is below its k-th
score. The pivots only shape the blocks: whatever they are, results are exact.

Queries go in blocks as well. A task holds one chunk of rows and one block of queries, and
hands on at most k rows per query, so nothing but the result grows with rows x queries.

Defined results: vectors that are null, empty or hold a null or non-finite component take
no part, nor do rows without an id; of rows that share an id the smallest vector counts;
vectors of different length count as padded with zeros; equal scores go to the smaller id;
an empty table gives an empty result. Scores must fit a 64-bit integer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import small_side, stored

PIVOTS = 64
BLOCK_ROWS = 64
CHUNK_ROWS = 8_192
QUERY_BLOCK = 1_024
#: Query blocks that may be sent to every executor.
BROADCAST_BLOCKS = 64
_EXACT = 2.0**53


def integer_vectors(rows: DataFrame, id_column: str, vector: str, factor: float = 256.0) -> DataFrame:
    """(id, v): floor(factor * component) as whole doubles, one row per id."""
    x = F.col(vector).cast("array<double>")
    usable = (F.col(id_column).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)
              & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))))
    floored = F.transform(x, lambda e: F.floor(e * F.lit(factor)).cast("double"))
    return (rows.where(usable).select(F.col(id_column).cast("long").alias("id"), floored.alias("v"))
            .groupBy("id").agg(F.min("v").alias("v")))


def _matrix(column) -> np.ndarray:
    """A column of number lists as one matrix, short rows padded with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if len(flat) == width * len(sizes):
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _same_width(a: np.ndarray, b: np.ndarray):
    width = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))
                 for x in (a, b))


def _packed(batches, size: int, name: str):
    """Rows of (ids, values, width) with up to `size` vectors each, numbered within the task."""
    held: list = []
    n = 0

    def out():
        ids = np.concatenate([i for i, _ in held])
        width = max(m.shape[1] for _, m in held)
        values = np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for _, m in held])
        while len(ids):
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[:size].astype("<i8").tobytes()]),
                 pa.array([values[:size].astype("<f8").tobytes()]), pa.array([width], pa.int32())],
                names=[f"{name}_ids", f"{name}_values", "width"])
            ids, values = ids[size:], values[size:]

    for batch in batches:
        held.append((batch.column("id").to_numpy(), _matrix(batch.column("v"))))
        n += batch.num_rows
        while n >= size:
            ids, values = np.concatenate([i for i, _ in held]), None
            width = max(m.shape[1] for _, m in held)
            values = np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for _, m in held])
            held = [(ids[:size], values[:size])]
            yield from out()
            held, n = [(ids[size:], values[size:])], n - size
    if n:
        yield from out()


def search_chunk(q_ids, q, c_ids, c, k, floor, block_rows=BLOCK_ROWS):
    """Top k of chunk `c` for every query: (scores, ids), -inf where there is no row.

    `floor` has a score per query that a row must reach to matter. Returns also how many
    (query, block) pairs were scored.
    """
    q, c = _same_width(q, c)
    n, nq = len(c_ids), len(q_ids)
    blocks = -(-n // block_rows)
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, q.shape[1]) >= _EXACT:
        q, c = np.vectorize(int, otypes=[object])(q), np.vectorize(int, otypes=[object])(c)
    pad = blocks * block_rows - n
    rows = np.concatenate([c, np.repeat(c[-1:], pad, axis=0)]).reshape(blocks, block_rows, -1)
    ids = np.concatenate([c_ids, np.full(pad, np.iinfo(np.int64).max)]).reshape(blocks, block_rows)
    real = np.arange(blocks * block_rows).reshape(blocks, block_rows) < n
    bound = np.maximum(q, 0) @ rows.max(axis=1).T + np.minimum(q, 0) @ rows.min(axis=1).T
    visit = np.argsort(-bound, axis=1, kind="stable")
    best = np.full((nq, k), -np.inf, object if q.dtype == object else float)
    best_ids = np.full((nq, k), np.iinfo(np.int64).max)
    active, scored = np.arange(nq), 0
    for turn in range(blocks):
        at = visit[active, turn]
        go = bound[active, at] >= np.maximum(best[active, k - 1], floor[active])
        active, at = active[go], at[go]
        if not len(active):
            break
        scored += len(active)
        for part in range(0, len(active), 256):
            a, b = active[part:part + 256], at[part:part + 256]
            s = (rows[b] @ q[a][:, :, None])[:, :, 0]
            i = ids[b]
            s = np.where(real[b] & (i != q_ids[a][:, None]), s, -np.inf)
            s, i = np.concatenate([best[a], s], axis=1), np.concatenate([best_ids[a], i], axis=1)
            top = np.lexsort((i, -s), axis=1)[:, :k] if s.dtype != object else np.array(
                [sorted(range(len(x)), key=lambda j, x=x, y=y: (-x[j], y[j]))[:k] for x, y in zip(s, i)])
            best[a], best_ids[a] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
    return best, best_ids, scored


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k rows with the highest inner product for every query, its own id excepted.

    Both sides are (id, v) as `integer_vectors` gives them, stored tables. Returns
    query_id, rank, vec_id, score.
    """
    spark = candidates.sparkSession
    n = candidates.count()
    pivots = [r["v"] for r in candidates.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()]
    width = max(map(len, pivots), default=0)
    pivots = np.array([p + [0.0] * (width - len(p)) for p in pivots]).reshape(len(pivots), width)

    def near(batches):
        for batch in batches:
            p, c = _same_width(pivots, _matrix(batch.column("v")))
            product = c @ p.T
            own = product.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own.astype("int32")), pa.array(product.max(axis=1))],
                names=["id", "v", "pivot", "near"])

    tasks = max(1, -(-n // CHUNK_ROWS), min(spark.sparkContext.defaultParallelism, n // 1024))
    chunks = (candidates.mapInArrow(near, "id long, v array<double>, pivot int, near double")
              .repartitionByRange(tasks, "pivot", "near", "id").sortWithinPartitions("pivot", "near", "id")
              .select("id", "v")
              .mapInArrow(lambda b: _packed(b, CHUNK_ROWS, "c"), "c_ids binary, c_values binary, width int"))
    blocks = stored(queries.mapInArrow(lambda b: _packed(b, QUERY_BLOCK, "q"),
                                       "q_ids binary, q_values binary, width int")
                    .withColumn("block", F.monotonically_increasing_id()))
    # Every chunk meets every block of queries: the stated query set against all rows.
    numbers = small_side(blocks.groupBy(F.lit(0).alias("_all")).agg(F.collect_list("block").alias("block")), 1)
    pairs = (chunks.withColumnRenamed("width", "c_width").withColumn("_all", F.lit(0))
             .join(numbers, "_all").withColumn("block", F.explode("block"))
             .join(small_side(blocks, BROADCAST_BLOCKS), "block").drop("_all", "block"))

    def search(batches):
        found: dict[bytes, tuple] = {}
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, c_ids = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["c_ids"], "<i8")
                q = np.frombuffer(r["q_values"], "<f8").reshape(len(q_ids), r["width"])
                c = np.frombuffer(r["c_values"], "<f8").reshape(len(c_ids), r["c_width"])
                held = found.get(r["q_ids"])
                floor = held[0][:, k - 1] if held else np.full(len(q_ids), -np.inf)
                s, i, _ = search_chunk(q_ids, q, c_ids, c, k, floor)
                if held:  # what this task has found before bounds what is still worth scoring
                    s, i = np.concatenate([held[0], s], axis=1), np.concatenate([held[1], i], axis=1)
                    top = np.array([sorted(range(2 * k), key=lambda j, x=x, y=y: (-x[j], y[j]))[:k]
                                    for x, y in zip(s, i)])
                    s, i = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
                found[r["q_ids"]] = (s, i)
        for key, (s, i) in found.items():
            q_ids = np.repeat(np.frombuffer(key, "<i8"), k).reshape(s.shape)
            there = s > -np.inf
            yield pa.RecordBatch.from_arrays(
                [pa.array(q_ids[there]), pa.array(i[there].astype("int64")),
                 pa.array([int(x) for x in s[there]], pa.int64())], names=["query_id", "vec_id", "score"])

    part = pairs.mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (part.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def top_k_search(rows: DataFrame, id_column: str, vector: str, every: int = 50, k: int = 5,
                 factor: float = 256.0) -> DataFrame:
    """`top_k` with the rows whose id is divisible by `every` as queries against all rows."""
    vectors = stored(integer_vectors(rows, id_column, vector, factor))
    return top_k(vectors, vectors.where(F.pmod("id", F.lit(every)) == 0), k)
