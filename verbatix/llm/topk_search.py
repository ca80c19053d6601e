"""Exact top-k inner product search, columnar branch and bound.

Vectors are quantised once. Queries and candidates are dealt to blocks; a task takes
one block of each, so its memory has a bound and no task needs all queries or all
vectors. Within a task candidates lie in vertical layout, a row per dimension,
dimensions by falling mass. Scores are accumulated block of dimensions by block, for a
group of queries at once. The candidates that lead after the first block are scored in
full, which gives each query its k-th best score so far. After each block a pair stays
only if its partial score plus the product of the remaining norms (Cauchy-Schwarz) can
still reach that; columns without any such pair are compacted away, and once few pairs
are left they are carried on one by one. The k best of every block pair are merged.

The work is queries times vectors, as an exact search over a query set asks for.

Edge cases: vectors that are null, empty or hold null or non-finite components take
no part; vectors of different lengths are not compared; repeated ids: a query counts
once (with its smallest vector), candidates with the query's id are its own row and
skipped; fewer than k candidates give all; equal scores go to the smaller id; a score
beyond 64 bits raises; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Rows of a block at most, and of a candidates' block at least if there are tasks to share the work.
QUERY_BLOCK, VECTOR_BLOCK, LEAST_BLOCK = 4096, 1 << 16, 2048
#: Dimensions of a block, queries of a group, and the share of pairs from which on they are kept one by one.
DIMS, GROUP, SPARSE = 8, 64, 0.03


def quantise(vectors: DataFrame, factor: float = 64.0) -> DataFrame:
    """(vec_id, code): floor(factor * x) of each component, without unusable vectors."""
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    code = F.transform(x, lambda v: F.floor(v * factor).cast("long"))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad
    return vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), code.alias("code"))


def _search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best (ids, scores) among the rows of x, ties to smaller ids."""
    at = np.argsort(x_ids, kind="stable")
    x, x_ids = x[at], x_ids[at]
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * q.shape[1]
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object
    dims = np.argsort(-np.square(x.astype(np.float64)).sum(0), kind="stable")
    columns, q = np.ascontiguousarray(x[:, dims].T).astype(kind), q[:, dims].astype(kind)
    cuts = list(range(0, len(dims), DIMS)) + [len(dims)]
    norm = lambda a: np.sqrt(a.astype(np.float64))
    x_left = [norm(np.square(columns[c:].astype(np.float64)).sum(0)) for c in cuts]
    q_left = [norm(np.square(q[:, c:].astype(np.float64)).sum(1)) for c in cuts]
    exact = kind is not object

    def can(reach: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Scores are integers, so half of one is room enough for the rounding of norms."""
        return reach + np.abs(reach) * 1e-9 >= low - 0.5

    for a in range(0, len(q), GROUP):
        some, ids = q[a : a + GROUP], q_ids[a : a + GROUP]
        alive, part = np.arange(x.shape[0]), some[:, : cuts[1]] @ columns[: cuts[1]]
        own = ids[:, None] == x_ids[None, :]
        low = np.full(len(some), -np.inf)
        if exact and x.shape[0] > k:
            guess = np.where(own, -np.inf, part)
            lead = np.argpartition(-guess, k, axis=1)[:, : k + 1]
            full = np.einsum("qd,dqk->qk", some, columns[:, lead]).astype(np.float64)
            full[np.take_along_axis(own, lead, 1)] = -np.inf
            low = np.partition(full, 1, axis=1)[:, 1]  # the k-th of k + 1
        row = col = None
        for b in range(1, len(cuts)):
            if b > 1:
                block = slice(cuts[b - 1], cuts[b])
                if row is None:
                    part = part + some[:, block] @ columns[block][:, alive]
                else:
                    part = part + (some[row, block] * columns[block, col].T).sum(1)
            if not exact:
                continue
            if row is None:
                stay = can(part + q_left[b][a : a + len(some), None] * x_left[b][None, alive], low[:, None])
                used = stay.any(0)
                if stay.sum() < SPARSE * stay.size:
                    row, at = np.nonzero(stay)
                    part, col = part[row, at], alive[at]
                elif used.mean() < 0.7:
                    alive, part = alive[used], part[:, used]
            else:
                stay = can(part + q_left[b][a + row] * x_left[b][col], low[row])
                row, col, part = row[stay], col[stay], part[stay]
        if row is None:
            row, at = np.nonzero(part >= low[:, None]) if exact else np.nonzero(np.ones(part.shape, bool))
            part, col = part[row, at], alive[at]
        keep = x_ids[col] != ids[row]
        row, col, part = row[keep], col[keep], part[keep].astype(np.int64)
        order = np.lexsort((x_ids[col], -part, row))
        row, col, part = row[order], col[order], part[order]
        ends = np.searchsorted(row, np.arange(len(some) + 1))
        for i in range(len(some)):
            take = slice(ends[i], min(ends[i + 1], ends[i] + k))
            yield int(ids[i]), x_ids[col[take]], part[take]


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, factor: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each query, a row whose ``vec_id`` is divisible by ``every``."""
    codes = common.materialize(quantise(vectors, factor))
    asked = codes.where(f"vec_id % {every} = 0").groupBy("vec_id").agg(F.min("code").alias("code"))
    queries, n, tasks = asked.count(), codes.count(), 2 * vectors.sparkSession.sparkContext.defaultParallelism
    q_blocks = max(1, -(-queries // QUERY_BLOCK))
    x_blocks = max(1, -(-n // VECTOR_BLOCK), min(-(-n // LEAST_BLOCK), -(-tasks // q_blocks)))
    # Rows of one id go to different blocks; the table is written, so its rows keep their numbers.
    codes = codes.withColumn("row", F.monotonically_increasing_id())
    deal = lambda what, blocks: F.pmod(F.xxhash64(what), F.lit(blocks)).cast("int")
    span = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = asked.select("vec_id", "code", F.lit(True).alias("query"), deal("vec_id", q_blocks).alias("qb"), span(x_blocks).alias("xb"))
    right = codes.select("vec_id", "code", F.lit(False).alias("query"), deal("row", x_blocks).alias("xb"), span(q_blocks).alias("qb"))
    both = left.unionByName(right).withColumn("dim", F.size("code"))

    def search(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        ids = group.column("vec_id").to_numpy()
        rows = group.column("code").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        is_query = group.column("query").to_numpy(zero_copy_only=False).astype(bool)
        out = [(np.full(len(i), a), i, s) for a, i, s in _search(rows[is_query], ids[is_query], rows[~is_query], ids[~is_query], k)] if is_query.any() and not is_query.all() else []
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.int64())})

    found = both.groupBy("dim", "qb", "xb").applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"))


ORACLE = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS c FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.c, v.c)::BIGINT AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
 r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
 SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
