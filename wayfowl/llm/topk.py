"""Exact top-k inner-product search: ball-tree branch and bound in shards.

Candidates are dealt into shards of bounded size by a hash; each shard builds a ball tree over its vectors. A ball with centre
c and radius r holds no inner product above q.c + |q| r, so a query visits nodes in the order of that bound and stops where it
falls below the score of its current k-th candidate. That score is shared: a first pass over one pilot shard gives every query
a k-th score that it really reaches, all other shards start from it, and a worker carries what its later shards have reached on
to the next (FLOOR_BLOCKS blocks of queries at most). Shards are dealt by a hash, which keeps them even; each is pruned from
within, never as a whole.

Vectors are integers: floor(scale * x) of each component. Products are summed exactly, in double precision where all partial
sums stay below 2**53 and in 64-bit integers beyond; vectors whose products need not fit a long raise an OverflowError.

Queries are dealt in blocks, so that a (shard, block) pair is a unit of bounded memory however many queries there are.

Defined cases: vectors that are null or hold null or non-finite components, and rows with a null id, take no part, neither as
queries nor as candidates; vectors of another length than a query's are no candidates of it; ties go to the smaller id;
repeated rows are candidates of their own, but ask once, with the
least of their vectors; with fewer candidates than k all are returned; other columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import short_batches, table, written

K = 5
SCALE = 256
EVERY = 50
#: Vectors in a shard and queries in a block, on average.
SHARD_ROWS = 8192
BLOCK_QUERIES = 2048
LEAF_ROWS = 256
#: Blocks of queries whose k-th scores a worker carries from shard to shard.
FLOOR_BLOCKS = 32
#: Room for the rounding of bounds in double precision.
SLACK = 1e-9


def usable(vector: str = "embedding") -> Column:
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(False))


class BallTree:
    """Balls over the rows of x, halved along their widest dimension; node i has the rows order[lo[i]:hi[i]]."""

    def __init__(self, x: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(x))
        lo, hi, kids, centres, radii = [], [], [], [], []
        todo = [(0, len(x), -1)]
        while todo:
            a, b, parent = todo.pop()
            rows = x[self.order[a:b]]
            centre = rows.mean(axis=0)
            if parent >= 0:
                kids[parent].append(len(lo))
            lo.append(a)
            hi.append(b)
            kids.append([])
            centres.append(centre)
            radii.append(np.sqrt(((rows - centre) ** 2).sum(axis=1).max()))
            if b - a > leaf_rows and radii[-1] > 0:
                d = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
                self.order[a:b] = self.order[a:b][np.argpartition(rows[:, d], (b - a) // 2)]
                todo += [((a + b) // 2, b, len(lo) - 1), (a, (a + b) // 2, len(lo) - 1)]
        self.lo, self.hi, self.kids = lo, hi, kids
        self.centres, self.radii = np.array(centres), np.array(radii)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of inner products: queries x nodes."""
        reach = np.sqrt((queries**2).sum(axis=1))[:, None] * self.radii[None]
        along = queries @ self.centres.T
        return along + reach + SLACK * (np.abs(along) + reach + 1)


def search(queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int = K, leaf_rows: int = LEAF_ROWS) -> Iterator[tuple[int, int, int]]:
    """(query's row, candidate's id, score) of the best k candidates with a score of at least floors. A query's own id is none."""
    if not len(x) or not len(queries):
        return
    small = float(np.abs(queries).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < 2**53
    longest = [float((m.astype(np.float64) ** 2).sum(axis=1).max()) for m in (queries, x)]
    if not small and longest[0] * longest[1] >= 2.0**126:
        raise OverflowError("inner products of these vectors do not fit a long")
    exact = np.float64 if small else np.int64
    tree = BallTree(x.astype(np.float64), leaf_rows)
    rows, ids, q = x[tree.order].astype(exact), ids[tree.order], queries.astype(exact)
    bounds = tree.bounds(queries.astype(np.float64))
    for i in range(len(queries)):
        best: list[tuple[int, int]] = []  # (score, -id), the worst of the kept first
        floor, bound = int(floors[i]), bounds[i]
        heap = [(-bound[0], 0)]
        while heap:
            top, node = heapq.heappop(heap)
            if -top < floor:
                break
            if tree.kids[node]:
                for kid in tree.kids[node]:
                    if bound[kid] >= floor:
                        heapq.heappush(heap, (-bound[kid], kid))
                continue
            a, b = tree.lo[node], tree.hi[node]
            scores = rows[a:b] @ q[i]
            for j in np.flatnonzero(scores >= floor).tolist():
                if ids[a + j] != query_ids[i] and (item := (int(scores[j]), -int(ids[a + j]))) and (len(best) < k or item > best[0]):
                    (heapq.heappush if len(best) < k else heapq.heapreplace)(best, item)
                    if len(best) == k:
                        floor = max(floor, best[0][0])  # an equal score may still win by its id
        for score, neg in best:
            yield i, -neg, score


_HITS = "query_id long, vec_id long, score long"


#: Of this worker: for each search and block the k-th scores that its queries have reached.
_REACHED: dict[tuple[str, int], dict[int, int]] = {}


def _carried(name: str, block: int) -> dict[int, int]:
    found = _REACHED.pop((name, block), {})
    while len(_REACHED) >= FLOOR_BLOCKS:
        del _REACHED[next(iter(_REACHED))]
    _REACHED[name, block] = found
    return found


def _search_group(k: int, leaf_rows: int):
    name = uuid.uuid4().hex

    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        reached = _carried(name, int(queries.block.iloc[0])) if len(queries) else {}
        for size, own in queries.groupby(queries.v.map(len)):  # vectors of one length only meet their like
            some = candidates[candidates.v.map(len) == size]
            if size and len(some):
                qids = own.query_id.to_numpy()
                floors = np.array([max(f, reached.get(q, f)) for q, f in zip(qids.tolist(), own.floor.tolist(), strict=True)], np.int64)
                hits: dict[int, list[int]] = {}
                for i, c, s in search(np.stack(own.v), qids, floors, np.stack(some.v), some.vec_id.to_numpy(), k, leaf_rows):
                    out.append((int(qids[i]), c, s))
                    hits.setdefault(int(qids[i]), []).append(s)
                reached.update({q: max(min(s), reached.get(q, min(s))) for q, s in hits.items() if len(s) == k})
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")

    return run


def best_hits(hits: DataFrame, k: int, *order: Column) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: float = SCALE, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) over (vec_id, embedding)."""
    whole = vectors.where(usable() & F.col("vec_id").isNotNull())
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    x = written(whole.select(F.col("vec_id").cast("long").alias("vec_id"), is_query.alias("is_query"), ints.alias("v")))
    counts = x.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    shards, blocks = max(1, -(-counts.n // shard_rows)), max(1, -(-counts.q // block_queries))
    # A row number keeps copies of one id apart; x is a written table, whose rows a repeated task numbers alike.
    x = x.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    once = x.where("is_query").groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = once.select(F.col("vec_id").alias("query_id"), "v", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(blocks)).cast("int").alias("block"))
    short_batches(vectors.sparkSession, 4096)

    def meet(first: int, last: int, asked: DataFrame) -> DataFrame:
        """Each block of queries meets each of these shards."""
        own = x.where(F.col("shard").between(first, last)).select("vec_id", "v", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        dealt = asked.withColumn("shard", F.explode(F.sequence(F.lit(first), F.lit(last))))
        return own.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInPandas(_search_group(k, leaf_rows), _HITS)

    lowest = F.lit(-(2**62)).cast("long")
    pilot = written(meet(0, 0, queries.withColumn("floor", lowest)))
    hits = pilot
    if shards > 1:
        reached = pilot.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n")).where(F.col("n") >= k).select("query_id", "low")
        asked = queries.join(reached, "query_id", "left").withColumn("floor", F.coalesce("low", lowest)).drop("low")
        hits = pilot.unionByName(meet(1, shards - 1, asked))
    ranked = best_hits(hits, k, F.desc("score"), F.asc("vec_id"))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(c.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
