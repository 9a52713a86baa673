"""Exact top-k by inner product with a pivot table.

Every candidate keeps its distances to a set of pivots. For a query, the largest difference
between its own pivot distances and a candidate's is a lower bound of their distance, so

    2 * score = |q|^2 + |x|^2 - d(q, x)^2 <= |q|^2 + |x|^2 - bound^2

and candidates are evaluated in the order of that upper bound until the k-th best score
beats the next bound. The table is computed once. Blocks of queries meet slices of candidates
in a shuffle; each pair keeps k rows a query, and these are merged.

Bounds are floating-point numbers with room for their rounding; scores are integers.

Defined results: vectors null or with null or non-finite components take no part, nor do
rows with a null id; components beyond 64 bits count as the nearest 64-bit integer; only
vectors of the same length meet, so a query without a partner has no rows; rows that share
the query's id are its own. Rows of candidates that share an id each count, and queries that
share one are merged. Ties go to the smaller id. Ranks follow the exact products, and a
product beyond 64 bits is given as the nearest 64-bit integer. A table without queries gives
no rows; extra columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import saved

PIVOTS = 32
BLOCK = 32_768
LEAST_SLICE = 2_048
SCALE = 1024
LARGEST = 2**63 - 1
ROUNDING = 1e-6
RESULT = "query_id bigint, vec_id bigint, score bigint, high bigint, middle bigint, low bigint"
LIMB = 40


def integers(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """key and v: floor(scale * x) of each component, for rows that take part."""
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col(key).isNotNull() & F.col(column).isNotNull()).filter(good).select(F.col(key).cast("bigint").alias(key), F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"))


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (rows * rows).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2.0 * rows @ pivots.T
    return np.sqrt(np.maximum(square, 0.0))


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The integer inner products, in a number type that holds them."""
    most = len(query) * float(np.abs(rows.astype(np.float64)).max(initial=0.0)) * float(np.abs(query.astype(np.float64)).max(initial=0.0))
    if most < 2**52:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return rows @ query
    return np.array([sum(a * b for a, b in zip(row, query.tolist())) for row in rows.tolist()], dtype=object)


def search(ids: np.ndarray, rows: np.ndarray, norms: np.ndarray, table: np.ndarray, query_id: int, query: np.ndarray, reach: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (id, score) among rows: bounds from the pivot table, evaluation in bound order, exact stop."""
    own = float((query.astype(np.float64) ** 2).sum())
    bound = np.abs(table - reach).max(1) if table.shape[1] else np.zeros(len(rows))
    slack = ROUNDING * (1.0 + bound + np.sqrt(own + norms))
    most = (own + norms - np.maximum(bound - slack, 0.0) ** 2) / 2 * (1 + 1e-12) + 1e-9 * (own + norms) + 0.5
    most[ids == query_id] = -np.inf
    # the best candidates by bound first; the rest is only ordered where they do not suffice
    first = min(len(most), max(16 * k, 256))
    order = np.argpartition(-most, first - 1)[:first] if first < len(most) else np.arange(len(most))
    order = order[np.argsort(-most[order], kind="stable")]
    best: list[tuple[int, int]] = []
    step, at = max(4 * k, 64), 0
    while True:
        if at >= len(order):
            if len(order) == len(most):
                break
            order = np.argsort(-most, kind="stable")
        if most[order[at]] == -np.inf or (len(best) == k and most[order[at]] < -best[-1][0]):
            break
        take = order[at : at + step]
        at += len(take)
        step *= 2
        take = take[most[take] > -np.inf]
        scores, names = products(rows[take], query), ids[take]
        if scores.dtype != object:
            top = np.lexsort((names, -scores))[:k]
            scores, names = scores[top], names[top]
        best = sorted(best + [(-s, i) for s, i in zip(scores.tolist(), names.tolist())])[:k]
    return [(i, -s) for s, i in best]


def with_reach(vectors: DataFrame, pivots: list) -> DataFrame:
    """vec_id, v, and reach: the distances to the pivots of the vector's length."""

    def work(batches):
        for batch in batches:
            for length, (ids, rows) in _by_length(pa.Table.from_batches([batch])).items():
                near = [p for p in pivots if len(p) == length]
                points = np.array(near, dtype=np.float64).reshape(len(near), length)
                table = distances(rows.astype(np.float64), points)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids), lists(rows), lists(table)], names=["vec_id", "v", "reach"])

    return vectors.select("vec_id", "v").mapInArrow(work, "vec_id bigint, v array<bigint>, reach array<double>")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for queries and candidates of (vec_id, v).

    The driver holds the pivots and two counts. Queries are dealt into blocks and candidates
    into slices of about `block` rows (smaller slices where there are few, so that all cores
    work); every block meets every slice in one group of a shuffle.
    """
    spark = candidates.sparkSession
    chosen = [r.v for r in candidates.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(pivots).collect()]
    table = saved(with_reach(candidates, chosen))
    rows = table.count()
    blocks = max(1, -(-queries.count() // block))
    slices = max(1, -(-rows // block), min(spark.sparkContext.defaultParallelism, rows // LEAST_SLICE))
    deal = lambda n: F.pmod(F.xxhash64(F.lit("deal"), "vec_id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = with_reach(queries, chosen).select("vec_id", "v", "reach", deal(blocks).alias("b"), every(slices).alias("s"))
    held = table.select("vec_id", "v", "reach", deal(slices).alias("s"), every(blocks).alias("b"))
    found = asked.groupBy("b", "s").cogroup(held.groupBy("b", "s")).applyInArrow(_task(k), RESULT)
    # the exact product comes in three parts, as it may need more than 64 bits
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("middle"), F.desc("low"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_length(rows: pa.Table) -> dict[int, tuple]:
    """length -> ids, vectors, and where rows have it, reach, of that length."""
    held: dict[int, list] = {}
    for batch in rows.combine_chunks().to_batches():
        ids, columns = np.asarray(batch.column("vec_id")), [batch.column(c) for c in ("v", "reach") if c in batch.schema.names]
        sizes = np.diff(np.asarray(columns[0].offsets))
        for length in np.unique(sizes):
            of = np.flatnonzero(sizes == length)
            parts = [np.asarray(c.take(pa.array(of)).flatten()) for c in columns]
            held.setdefault(int(length), []).append((ids[of], *(x.reshape(len(of), len(x) // len(of)) for x in parts)))
    return {length: tuple(np.concatenate(x) for x in zip(*parts)) for length, parts in held.items()}


def _task(k: int):
    mask = (1 << LIMB) - 1

    def work(asked: pa.Table, held: pa.Table) -> pa.Table:
        out, wanted = [], _by_length(asked)
        for length, (ids, rows, table) in _by_length(held).items():
            if length in wanted:
                norms = (rows.astype(np.float64) ** 2).sum(1)
                for query_id, query, reach in zip(wanted[length][0].tolist(), *wanted[length][1:]):
                    out += [(query_id, i, max(-LARGEST - 1, min(LARGEST, s)), s >> 2 * LIMB, s >> LIMB & mask, s & mask) for i, s in search(ids, rows, norms, table, query_id, query, reach, k)]
        return pa.table({name: pa.array([x[i] for x in out], pa.int64()) for i, name in enumerate(("query_id", "vec_id", "score", "high", "middle", "low"))})

    return work
