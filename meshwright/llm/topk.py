"""Exact top-k inner-product search by block-at-a-time pruning.

Vectors are quantised to integers.  The rows of a document range are put in an order in which near vectors
are neighbours (halves by the component that varies most, again and again) and cut into blocks.  A block is a forward index (its rows' ids and components) and, for
each component, the largest and smallest value.  For a query the largest score that a
block can hold is the sum of the component maxima (minima where the query is negative);
blocks are taken in falling order of that bound and scored until the next bound falls
below the k-th score.  Equal bounds are still scored, as ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Rows of one forward-index block.
BLOCK_ROWS = 64
#: Rows of candidates, and queries, that meet in one task.
GROUP_ROWS = 1 << 14
QUERY_ROWS = 1 << 11
SCALE = 256


def quantised(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: components as floor(256 * x) with x as double.

    Null vectors, and vectors with a null or non-finite component, take no part; neither do rows
    without an id.
    """
    x = F.col("embedding").cast("array<double>")
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
        .filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
        .filter(F.forall("x", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))), F.lit(False))))
        .select("vec_id", F.transform("x", lambda e: F.floor(e * SCALE)).alias("v"))
    )


class Block:
    """Forward index of some rows, sorted by id, with component bounds."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        self.most, self.least = rows.max(0), rows.min(0)


def neighbours(rows: np.ndarray, mine: np.ndarray, most: int = BLOCK_ROWS) -> list[np.ndarray]:
    """Places ``mine`` in blocks of at most ``most`` near rows."""
    parts, blocks = [mine], []
    while parts:
        part = parts.pop()
        if len(part) <= most:
            blocks.append(np.sort(part))
            continue
        x = rows[part]
        order = part[np.argsort(x[:, x.var(0).argmax()], kind="stable")] if x.shape[1] else part
        parts += [order[len(part) // 2 :], order[: len(part) // 2]]
    return blocks


def _matrix(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.asarray(x, np.int64) for x in column.to_pylist()]


def search_blocks(blocks: list[Block], query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids of the k best rows, and how many blocks were scored."""
    bounds = np.stack([b.most for b in blocks]) @ np.maximum(query, 0) + np.stack([b.least for b in blocks]) @ np.minimum(query, 0)
    return _search(blocks, bounds, query, own, k)


def _search(blocks, bounds, query, own, k):
    scores, ids, kth, scored = np.zeros(0, np.int64), np.zeros(0, np.int64), None, 0
    for j in np.argsort(-bounds, kind="stable"):
        if kth is not None and bounds[j] < kth:
            break
        b = blocks[j]
        s = b.rows @ query
        scored += 1
        keep = b.ids != own
        if kth is not None:
            keep &= s >= kth
        scores, ids = np.concatenate([scores, s[keep]]), np.concatenate([ids, b.ids[keep]])
        if len(ids) > k:
            best = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[best], ids[best]
        if len(ids) == k:
            kth = scores.min()
    best = np.lexsort((ids, -scores))[:k]
    return scores[best], ids[best], scored


def _group_search(k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            ids, rows = np.array(left.column("vec_id").to_pylist(), np.int64), _matrix(left.column("v"))
            order = np.argsort(ids, kind="stable")
            by_width: dict[int, tuple[list[Block], list[Block]]] = {}
            for width in {len(r) for r in rows}:
                mine = [i for i in order if len(rows[i]) == width]
                flat = np.stack([rows[i] for i in mine])
                blocks = [(ids[mine][part], flat[part]) for part in neighbours(flat.astype(float), np.arange(len(mine)))]
                # Twice: float products are much faster, and integer ones are there for values where those aren't exact.
                by_width[width] = [Block(i, r) for i, r in blocks], [Block(i, r.astype(float)) for i, r in blocks]
            largest = {width: max(int(np.abs(b.rows).max(initial=0)) for b in blocks) for width, (blocks, _) in by_width.items()}
            for q_id, q in zip(right.column("query_id").to_pylist(), _matrix(right.column("query")), strict=True):
                blocks, floats = by_width.get(len(q), ((), ()))
                if not blocks:
                    continue
                if largest[len(q)] * max(1, int(np.abs(q).sum())) < 1 << 52:
                    q, blocks = q.astype(np.float64), floats
                scores, found, _ = search_blocks(blocks, q, q_id, k)
                out["query_id"] += [q_id] * len(found)
                out["vec_id"] += found.tolist()
                out["score"] += [int(s) for s in scores]
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    return run


def search(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of every query, its own id left out.

    Both sides hold ``vec_id, v`` (integers). Vectors of another length than the query's have no
    inner product with it and take no part. Repeated candidate rows count each; of query rows
    that share an id the smallest vector is asked. Scores are exact while they fit 64 bits. Candidates meet queries by (candidate group, query group), so a task holds
    bounded numbers of both; every task's k best are merged by a grouped sort.
    """
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    n, m = candidates.count(), queries.count()
    groups, query_groups = max(1, -(-n // GROUP_ROWS)), max(1, -(-m // QUERY_ROWS))
    # A document range each; rows of one id may fill several.
    ranged = candidates.repartitionByRange(groups, "vec_id", F.xxhash64("v"))
    ranged = staged(ranged.select("vec_id", "v", F.spark_partition_id().alias("g")), "ranges")
    groups = 1 + (ranged.agg(F.max("g")).first()[0] or 0)
    left = ranged.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_groups - 1))))
    # Fresh column names, as queries are often rows of the candidates.
    right = queries.select(
        F.col("vec_id").alias("query_id"),
        F.col("v").alias("query"),
        F.pmod(F.xxhash64("vec_id"), F.lit(query_groups)).cast("int").alias("qq"),
    ).withColumn("qg", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = (
        left.groupBy("g", "q")
        .cogroup(right.groupBy("qg", "qq"))
        .applyInArrow(_group_search(k), "query_id long, vec_id long, score long")
    )
    best = F.slice(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k
    )
    return (
        found.groupBy("query_id")
        .agg(best.alias("best"))
        .select("query_id", F.posexplode("best").alias("at", "hit"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score"))
    )


def op9_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = staged(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    return search(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
asked AS (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM asked q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""
