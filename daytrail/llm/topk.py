"""Exact search for the highest inner products, term at a time.

Rows and queries are dealt into blocks, and each pair of a query block and a row block is one group of bounded size.
A group keeps the rows as postings, one list of (row, weight) a component. A query's non-zero components add
their weighted postings, one after another, into a dense array of scores; partition selection takes the best of
the array, and the best of all blocks are merged. Every row is scored against every query; no pair of rows is a Spark row.

Rules: vectors that are null or hold null or non-finite components, and rows without id, take no part. A shorter vector's
missing components are zero. An id that is queried by several rows is one query, by its least vector; rows with the
query's id are its own. Equal rows of another id are candidates each. No vectors give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daytrail.llm.common import stored

ROW_BLOCK = 8192
QUERY_BLOCK = 4096
TILE = 64


def whole_numbers(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component of the vectors that take part."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(~odd)
    return known.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


def _matrix(lists: pa.Array) -> np.ndarray:
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), max(sizes.max(initial=0), 1)), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten()
    return out


def best_in_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[np.ndarray]:
    """(query id, row id, score) of each query's `k` best rows of other ids; of equal scores the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, rows, n = ids[order], rows[order], len(ids)
    terms = min(queries.shape[1], rows.shape[1])
    queries, rows = queries[:, :terms], rows[:, :terms]
    largest = int(np.abs(rows).max(initial=0)) * int(np.abs(queries).max(initial=0)) * terms
    kind = np.int32 if largest < 1 << 31 else np.int64
    postings = []
    for t in range(terms):
        at = np.flatnonzero(rows[:, t])
        postings.append((at, rows[at, t].astype(kind)) if 4 * len(at) < n else (None, rows[:, t].astype(kind)))
    out: list[list[np.ndarray]] = [[], [], []]
    for first in range(0, len(query_ids), TILE):
        own, tile = query_ids[first:first + TILE], queries[first:first + TILE].astype(kind)
        scores = np.zeros((len(own), n), kind)
        for t, (at, weights) in enumerate(postings):
            has = np.flatnonzero(tile[:, t])
            if not len(has) or not len(weights):
                continue
            if at is not None:
                scores[np.ix_(has, at)] += np.multiply.outer(tile[has, t], weights)
            elif len(has) == len(own):
                scores += np.multiply.outer(tile[:, t], weights)
            else:
                scores[has] += np.multiply.outer(tile[has, t], weights)
        for q, line in zip(own.tolist(), scores.astype(np.int64), strict=True):
            low, high = np.searchsorted(ids, q, "left"), np.searchsorted(ids, q, "right")
            at = np.arange(n) if low == high else np.concatenate((np.arange(low), np.arange(high, n)))
            line = line[at]
            if len(at) > k:
                edge = np.partition(line, len(at) - k)[len(at) - k]
                above, equal = np.flatnonzero(line > edge), np.flatnonzero(line == edge)
                pick = np.concatenate((above, equal[:k - len(above)]))
                at, line = at[pick], line[pick]
            out[0].append(np.full(len(at), q)), out[1].append(ids[at]), out[2].append(line)
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of stored (vec_id, v) frames."""
    n_rows, n_queries = -(-rows.count() // ROW_BLOCK) or 1, -(-queries.count() // QUERY_BLOCK) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, *salt: F.pmod(F.xxhash64("vec_id", *salt), F.lit(n)).cast("int")
    left = rows.select("vec_id", "v", F.lit(False).alias("asks"), dealt(n_rows, "v").alias("rb"), every(n_queries).alias("qb"))
    right = queries.select("vec_id", "v", F.lit(True).alias("asks"), every(n_rows).alias("rb"), dealt(n_queries).alias("qb"))

    def search(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        ids, values = table["vec_id"].to_numpy(), _matrix(table["v"])
        found = best_in_block(ids[asks], values[asks], ids[~asks], values[~asks], k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found), strict=True)))

    best = left.unionByName(right).groupBy("rb", "qb").applyInArrow(search, "query_id LONG, vec_id LONG, score LONG")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_every(vectors: DataFrame, step: int = 20, k: int = 20) -> DataFrame:
    """The best of all rows for each row whose id is divisible by `step`."""
    rows = stored(whole_numbers(vectors), "vectors")
    queries = rows.filter(F.col("vec_id") % step == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    return top_k(rows, stored(queries, "vector-queries"), k)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(q.v, r.v) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM k WHERE rank <= 20
"""
