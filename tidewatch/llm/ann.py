"""Exact nearest neighbours by a block matrix join of quantised vectors.

Queries and candidates are dealt into blocks; each pair of blocks is one tile. In a tile the vectors are rounded to 8 bits,
the product of the two matrices gives every inner product up to a known error, and only the pairs that the error could
bring among the best k are computed again from the original values in double precision. Heaps of k merge the tiles.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a tile's two sides, about: what bounds a task's memory.
QUERY_ROWS, CANDIDATE_ROWS = 4096, 32768
K = 20
#: Query rows of one slice of a tile.
SLICE = 256


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as float64."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit codes, each row's step, and the norm of what rounding left out."""
    step = np.abs(x).max(axis=1, keepdims=True) / 127.0
    step[step == 0] = 1.0
    codes = np.rint(x / step).astype(np.int8)
    return codes, step, np.linalg.norm(x - codes * step, axis=1)


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of each query's best k in the tile, ties to the smaller id; its own id takes no part."""
    # of equal vectors, only the k + 1 smallest ids can matter
    order = np.lexsort((ids, *vectors.T[::-1]))
    same = np.r_[False, (vectors[order][1:] == vectors[order][:-1]).all(axis=1)]
    starts = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    order = np.sort(order[np.arange(len(order)) - starts <= k])
    ids, vectors = ids[order], vectors[order]
    # by a power of two for each side, which changes no digit, so that huge components don't overflow
    small_q, small_x = (np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) for x in (queries, vectors))
    qc, qs, qe = quantise(small_q)
    xc, xs, xe = quantise(small_x)
    q_norm, x_norm = np.linalg.norm(small_q, axis=1), np.linalg.norm(small_x, axis=1)
    # products of 8-bit codes are whole numbers; float32 holds their sums exactly below 2**24, that is to 1,040 dimensions
    exact = np.float32 if queries.shape[1] <= 1040 else np.float64
    right, out = np.ascontiguousarray(xc.T.astype(exact)), []
    for at in range(0, len(queries), SLICE):
        part = slice(at, at + SLICE)
        near = (qc[part].astype(exact) @ right) * (qs[part] * xs.T)
        # <q,x> - <q',x'> = <q-q',x> + <q',x-x'>
        bound = qe[part, None] * x_norm[None, :] + (q_norm[part, None] + qe[part, None]) * xe[None, :]
        bound += 1e-6 * q_norm[part, None] * x_norm[None, :]
        own = query_ids[part, None] == ids[None, :]
        low = np.where(own, -np.inf, near - bound)
        n = min(k, low.shape[1])
        floor = np.partition(low, low.shape[1] - n, axis=1)[:, low.shape[1] - n] if n else np.full(len(low), np.inf)
        row, col = np.nonzero((near + bound >= floor[:, None]) & ~own)
        for begin in range(0, len(row), 1 << 18):  # survivors, computed again in bounded pieces
            r, c = row[begin : begin + (1 << 18)], col[begin : begin + (1 << 18)]
            score = np.einsum("ij,ij->i", queries[part][r], vectors[c])
            out.append((r + at, c, score))
    if not out:
        return query_ids[:0], ids[:0], np.empty(0)
    r, c, score = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((ids[c], -score, r))
    r, c, score = r[order], c[order], score[order]
    first = np.searchsorted(r, r)
    best = np.arange(len(r)) - first < k
    return query_ids[r[best]], ids[c[best]], score[best]


def nearest(vectors: DataFrame, query_every: int = 20, k: int = K, query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest by inner product, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``query_every``; every row but the query's own is a candidate. Null
    ids, and vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors are compared
    with those of their own length. Rows repeated under one vec_id count once. With fewer than ``k`` candidates all are
    returned; a query without any has no row; an empty table gives none. Other columns are ignored. The search is exact.
    """
    whole = "size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    # floats are widened in the tile, not before the exchange
    numbers = F.col("embedding") if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else F.col("embedding").cast("array<double>")
    rows = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("embedding")).filter(whole)
    n = rows.count()
    q_blocks, x_blocks = max(1, -(-n // (query_every * query_rows))), max(1, -(-n // candidate_rows))
    rows = rows.withColumn("dim", F.size("embedding")).withColumn("h", F.xxhash64("vec_id"))
    # a block of queries goes to every block of candidates and the other way round: one group a tile
    asked = rows.filter(F.col("vec_id") % query_every == 0).withColumn("qb", F.pmod("h", F.lit(q_blocks)).cast("int")).withColumn("xb", F.explode(F.sequence(F.lit(0), F.lit(x_blocks - 1))))
    sought = rows.withColumn("xb", F.pmod("h", F.lit(x_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    sides = asked.withColumn("asks", F.lit(True)).unionByName(sought.withColumn("asks", F.lit(False))).drop("h")

    def work(group: pa.Table) -> pa.Table:
        both = []
        for asks in (True, False):
            side = group.filter(pa.compute.equal(group.column("asks"), asks))
            ids, first = np.unique(side.column("vec_id").to_numpy(), return_index=True)
            both += [ids, matrix(side.column("embedding"))[first]] if len(ids) else [ids, np.empty((0, 1))]
        query, found, score = tile(*both, k) if len(both[0]) and len(both[2]) else (both[0][:0], both[0][:0], np.empty(0))
        return pa.table({"query_id": query, "vec_id": found, "score": score})

    best = sides.groupBy("dim", "qb", "xb").applyInArrow(work, "query_id long, vec_id long, score double")

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heap: list[tuple[float, int]] = []
        for frame in frames:
            heap = heapq.nsmallest(k, [*heap, *zip(-frame["score"], frame["vec_id"], strict=True)])
        yield pd.DataFrame({"rank": range(1, len(heap) + 1), "vec_id": [v for _, v in heap], "score": [-s for s, _ in heap]})

    def merged(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in merge(frames):
            yield frame.assign(query_id=key[0])[["query_id", "rank", "vec_id", "score"]]

    return best.groupBy("query_id").applyInPandas(merged, "query_id long, rank int, vec_id long, score double")
