"""Exact top-k search by columnar branch-and-bound.

Vectors become integers, floor(scale * x). Candidates are packed into blocks of a
fixed number of rows in vertical layout, one run of values per dimension, largest
dimensions first. A block of queries meets a block of candidates: scores are
accumulated dimension block by dimension block, and after each block the
candidates whose partial score plus the most that the remaining mass can add
(product of the remaining norms) stays below the k-th best are compacted away.
The k best of every pair of blocks are merged per query.

Scale. Work is (query blocks x candidate blocks), each pair a task-sized piece of
bounded memory; only k rows per query and block leave it. Nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landloom.llm.common import saved

K = 20
SCALE = 64
CANDIDATE_ROWS = 8192
QUERY_ROWS = 512
STEP = 16
EXACT = float(1 << 53)


def pack(vectors: list[list[int]]) -> tuple[int, int, bytes]:
    """Dimensions, bytes per value, and values in vertical layout; short vectors end in zeros."""
    wide = max(map(len, vectors), default=0)
    out = np.zeros((wide, len(vectors)), dtype=np.int64)
    for j, v in enumerate(vectors):
        out[: len(v), j] = v
    top = int(np.abs(out).max(initial=0)) if out.size and out.min() > -(1 << 63) else 1 << 63
    width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return wide, width, out.astype(f"<i{width}").tobytes()


def unpack(wide: int, width: int, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<i{width}").reshape(wide, n).astype(np.int64)


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value, or minus infinity if there are fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int, step: int = STEP) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(query, ids, scores)`` of the k best candidates of the block for each query.

    Both matrices are vertical (dimension first). Equal scores go to the smaller id.
    """
    wide = max(len(queries), len(candidates))
    grow = lambda m: np.vstack([m, np.zeros((wide - len(m), m.shape[1]), dtype=m.dtype)])
    queries, candidates = grow(queries), grow(candidates)
    mass = lambda m: (m.astype(np.float64) ** 2).sum(axis=1)
    order = np.argsort(-(mass(queries) * mass(candidates)), kind="stable")
    queries, candidates = queries[order], candidates[order]
    reach = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * max(1, wide)
    kind = np.float64 if reach < EXACT else np.int64
    q, c = queries.astype(kind), candidates.astype(kind)
    bounds = list(range(0, wide, step)) + [wide]
    rest = lambda m: [np.sqrt((m[b:].astype(np.float64) ** 2).sum(axis=0)) for b in bounds]
    q_rest, c_rest = rest(queries), rest(candidates)
    slack = 1 + 1e-9
    first = bounds[1] if len(bounds) > 1 else wide
    opening = q[:first].T @ c[:first] if wide else np.zeros((queries.shape[1], candidates.shape[1]))
    for i in range(q.shape[1]):
        alive = np.flatnonzero(ids != query_ids[i])
        part = opening[i, alive]
        floor = -np.inf
        for b in range(1, len(bounds)):
            more = q_rest[b][i] * c_rest[b][alive] * slack
            if len(alive) > k:
                if b == 1:  # exact scores of the most promising give a first bound
                    seeds = np.argpartition(-part, k - 1)[:k]
                    floor = _kth(part[seeds] + q[first:, i] @ c[first:, alive[seeds]], k)
                floor = max(floor, _kth(part - more, k))
                stay = part + more >= floor - 1e-6 * abs(floor)
                alive, part = alive[stay], part[stay]
            if b + 1 < len(bounds):
                low, high = bounds[b], bounds[b + 1]
                part = part + q[low:high, i] @ c[low:high, alive]
        top = np.lexsort((ids[alive], -part))[:k]
        yield i, ids[alive[top]], part[top].astype(np.int64)


def top_k(vectors: DataFrame, k: int = K, every: int = 20, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best by integer inner product.

    Queries are the rows whose id is divisible by ``every``, candidates all rows
    but those with the query's own id. Vectors that are null or hold a null or
    non-finite component take no part, nor do rows with a null id. Vectors of
    unequal length meet over their common dimensions. Repeated rows are
    candidates of their own; repeated queries (same id and vector) count once,
    and several vectors of one query id compete for the same k places.
    """
    x = F.col(vec_col)
    whole = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    ints = F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("long"))
    rows = vectors.where(F.coalesce(whole, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), ints.alias("v"))
    rows = saved(rows.withColumn("n", F.xxhash64(F.monotonically_increasing_id())), "vectors")
    asked = rows.where(F.col("id") % every == 0).select("id", "v").distinct().withColumn("n", F.xxhash64("id", "v"))
    n_rows, n_asked = rows.count(), asked.count()

    def blocks(source: DataFrame, n: int) -> DataFrame:
        keyed = source.withColumn("block", F.pmod("n", F.lit(max(1, n))).cast("int"))

        def run(key: tuple[pa.Scalar, ...], batch: pa.Table) -> pa.Table:
            wide, width, data = pack(batch.column("v").to_pylist())
            ids = np.array(batch.column("id").to_pylist(), dtype="<i8")
            return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "n": [len(ids)], "wide": [wide], "width": [width], "ids": [ids.tobytes()], "data": [data]})

        return keyed.select("block", "id", "v").groupBy("block").applyInArrow(run, "block int, n long, wide long, width long, ids binary, data binary")

    asks = -(-n_asked // QUERY_ROWS)
    left = saved(blocks(rows, -(-n_rows // CANDIDATE_ROWS)), "candidates")
    right = saved(blocks(asked, asks), "queries").select(*[F.col(c).alias(f"q_{c}") for c in ("block", "n", "wide", "width", "ids", "data")])
    meets = left.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(max(0, asks - 1)))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, own = (np.frombuffer(row[c], dtype="<i8") for c in ("ids", "q_ids"))
                c = unpack(row["wide"], row["width"], row["data"], row["n"])
                q = unpack(row["q_wide"], row["q_width"], row["q_data"], row["q_n"])
                found = [(own[i], ids_, s) for i, ids_, s in best_of_block(q, own, c, ids, k)]
                columns = [np.repeat([f[0] for f in found], [len(f[1]) for f in found])]
                columns += [np.concatenate([f[j] for f in found]) if found else np.array([], dtype=np.int64) for j in (1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in columns], ["query_id", "vec_id", "score"])

    # A pair of blocks is much work for few bytes: dealt out one by one.
    joined = meets.join(right, "q_block").repartition(max(1, min(20_000, asks * max(1, -(-n_rows // CANDIDATE_ROWS)))), "q_block", "block")
    found = joined.mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
