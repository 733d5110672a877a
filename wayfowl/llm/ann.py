"""Approximate nearest neighbours: inverted lists scanned with adaptive dimension sampling.

Largest inner product becomes smallest distance by one more component, sqrt(M**2 - |x|**2), which queries have as zero; M is
the largest norm. Vectors are then turned by a random rotation, so that the first d of D components are a fair sample of a
distance, and are kept in blocks of columns. While a probed list is scanned, a candidate whose partial distance after d
components fails the test "its whole distance is within the k-th best" (its partial distance exceeds
d / D * (1 + EPSILON / sqrt(d)) ** 2, or the whole, of that) is abandoned; what survives gets its exact inner product. Queries
and candidates meet in tiles: a column block is one matrix product for a whole tile as long as many of its pairs are alive.

k-means centres come from a sample of at most SAMPLE rows and SAMPLE_BYTES, and so does the number of lists to probe: the smallest with which a sample of
queries finds TARGET of its true neighbours in the sample. Every vector is indexed. The nearest list is scanned first, and
the k-th score found there is where the scan of the other lists starts.

Lists of any size are cut into chunks of bounded size, and queries into blocks, so that one frequent vector neither fills a
task nor is shortened.

Vectors only meet vectors of their length. The FITTED_LENGTHS commonest lengths have an index each; vectors of a rarer length
are one list, which is scanned whole.

Defined cases: vectors that are null, zero or hold null or non-finite components and rows with a null id take no part; ties go
to the smaller id; repeated rows are candidates of their own, but ask once, with the shortest and then least of their vectors;
with fewer candidates than k all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches, table, written
from .topk import best_hits, usable

K = 20
EVERY = 20
EPSILON = 2.1
TARGET = 0.97
COLUMNS = 16  # of a block
ROWS = 2048  # of a block
TILE_QUERIES = 256  # that meet a block of rows at once
DENSE = 0.2  # share of a tile's pairs below which single pairs are followed
PAIRS = 1 << 15  # whose rows are gathered at once
SAMPLE = 8192
SAMPLE_BYTES = 64 << 20
FITTED_LENGTHS = 4
SAMPLE_QUERIES = 256
MAX_LISTS = 1024
LIST_ROWS = 1024
CHUNK_ROWS = 8192
BLOCK_QUERIES = 4096


@dataclass
class ListIndex:
    norm: float  # M
    centres: np.ndarray
    rotation: np.ndarray
    probes: int

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.norm**2 - (x**2).sum(axis=1), 0.0))])

    def distances(self, points: np.ndarray) -> np.ndarray:
        return (points**2).sum(axis=1)[:, None] - 2 * points @ self.centres.T + (self.centres**2).sum(axis=1)[None]

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        return self.distances(self.lift(x)).argmin(axis=1)

    def probed(self, q: np.ndarray) -> np.ndarray:
        """For each query its lists, the nearest first."""
        return np.argsort(self.distances(np.column_stack([q, np.zeros(len(q))])), axis=1, kind="stable")[:, : self.probes]


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 4) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[np.sort(rng.choice(len(points), k, replace=False))]
    for _ in range(rounds):
        near = ((centres**2).sum(axis=1)[None] - 2 * points @ centres.T).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def fit(sample: np.ndarray, norm: float, rows: int, k: int = K, target: float = TARGET) -> ListIndex:
    lists = int(np.clip(rows // LIST_ROWS, 1, min(MAX_LISTS, max(1, len(sample) // 8))))
    d = sample.shape[1] + 1
    rotation = np.linalg.qr(np.random.default_rng(8).normal(size=(d, d)))[0]
    index = ListIndex(norm, np.zeros((1, d)), rotation, lists)
    index.centres = kmeans(index.lift(sample), lists)
    own, asked = index.lists_of(sample), np.arange(0, len(sample), max(1, len(sample) // SAMPLE_QUERIES))
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-scores, axis=1)[:, : min(k, max(1, len(sample) - 1))]
    place = np.argsort(index.probed(sample[asked]), axis=1)  # of each list in a query's order
    needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
    index.probes = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1
    return index


def _pair_sums(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows a[i] and b[j], in bounded memory."""
    out = np.empty(len(i))
    for lo in range(0, len(i), PAIRS):
        out[lo : lo + PAIRS] = (a[i[lo : lo + PAIRS]] * b[j[lo : lo + PAIRS]]).sum(axis=1)
    return out


def _survivors(asked: list[np.ndarray], asked_norms: list[np.ndarray], rows: list[np.ndarray], row_norms: list[np.ndarray], limit: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs of a tile that no test abandons. Column blocks are matrix products over the tile while many pairs are
    alive, and products of pairs afterwards."""
    d, share, i, j = sum(c.shape[1] for c in rows), 0, None, None
    partial = np.zeros((len(limit), len(rows[0])))
    for c in range(len(rows)):
        share += rows[c].shape[1]
        most = limit * min(1.0, share / d * (1 + EPSILON / np.sqrt(share)) ** 2) + slack
        if i is None:
            partial += asked_norms[c][:, None] + row_norms[c][None] - 2 * asked[c] @ rows[c].T
            alive = partial <= most[:, None]
            if alive.sum() < DENSE * alive.size or c == len(rows) - 1:
                i, j = np.nonzero(alive)
                partial = partial[i, j]
        else:
            partial = partial + asked_norms[c][i] + row_norms[c][j] - 2 * _pair_sums(asked[c], i, rows[c], j)
            kept = partial <= most[i]
            i, j, partial = i[kept], j[kept], partial[kept]
        if i is not None and not len(i):
            break
    return i, j


def scan(queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, x: np.ndarray, ids: np.ndarray, index: ListIndex, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, candidate's id, score): each query's best k among x, given that a score below floors is of no use."""
    turned, asked = index.lift(x) @ index.rotation, np.column_stack([queries, np.zeros(len(queries))]) @ index.rotation
    d = turned.shape[1]
    edges = [*range(0, d, COLUMNS), d]
    cut = lambda m: [np.ascontiguousarray(m[:, a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    squares = lambda blocks: [(c**2).sum(axis=1) for c in blocks]
    blocks = [(lo, cut(turned[lo : lo + ROWS])) for lo in range(0, len(x), ROWS)]
    norms = [squares(columns) for _, columns in blocks]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), TILE_QUERIES):
        q, own_ids, floor = queries[at : at + TILE_QUERIES], query_ids[at : at + TILE_QUERIES], floors[at : at + TILE_QUERIES].copy()
        parts = cut(asked[at : at + TILE_QUERIES])
        part_norms, reach = squares(parts), (q**2).sum(axis=1) + index.norm**2
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # query, id, score
        for (lo, columns), own in zip(blocks, norms, strict=True):
            stop = lo + len(columns[0])
            if np.isfinite(floor).all():
                i, j = _survivors(parts, part_norms, columns, own, reach - 2 * floor, 1e-9 * reach)
            else:  # some have no k-th score yet: whole products give one
                whole = q @ x[lo:stop].T
                whole[own_ids[:, None] == ids[None, lo:stop]] = -np.inf
                least = np.partition(whole, -k, axis=1)[:, -k] if whole.shape[1] > k else np.full(len(q), -np.inf)
                i, j = np.nonzero(whole >= np.maximum(least - 1e-9 * reach, floor - 1e-9 * reach)[:, None])
            j = j + lo
            other = ids[j] != own_ids[i]
            i, j = i[other], j[other]
            scores = _pair_sums(x, j, q, i)
            some = scores >= floor[i]
            i, hit_ids, scores = (np.concatenate(c) for c in zip(best, (i[some], ids[j[some]], scores[some]), strict=True))
            order = np.lexsort((hit_ids, -scores, i))
            i, hit_ids, scores = i[order], hit_ids[order], scores[order]
            n = np.bincount(i, minlength=len(q))
            top = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) < k
            best = i[top], hit_ids[top], scores[top]
            last = np.flatnonzero(n >= k)
            ends = np.cumsum(np.minimum(n, k)) - 1
            floor[last] = np.maximum(floor[last], best[2][ends[last]])
        found.append((best[0] + at, best[1], best[2]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


_HITS = "query_id long, vec_id long, score double"


def _scan_group(indexes: dict[int, ListIndex], k: int):
    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        i, hits, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        qids = queries.query_id.to_numpy()
        if len(candidates) and len(queries):
            x = np.stack(candidates.v)
            index = indexes.get(x.shape[1]) or whole_index(x)
            i, hits, scores = scan(np.stack(queries.v), qids, queries.floor.to_numpy(), x, candidates.vec_id.to_numpy(), index, k)
        return pd.DataFrame({"query_id": qids[i], "vec_id": hits, "score": scores}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def whole_index(x: np.ndarray) -> ListIndex:
    """Of vectors whose length is rare: one list, which is scanned whole."""
    return ListIndex(float(np.sqrt((x**2).sum(axis=1).max())) * (1 + 1e-12), np.zeros((1, x.shape[1] + 1)), np.eye(x.shape[1] + 1), 1)


def nearest(vectors: DataFrame, is_query: Column, k: int = K, target: float = TARGET, chunk_rows: int = CHUNK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) over (vec_id, embedding)."""
    spark = vectors.sparkSession
    doubles = F.transform("embedding", lambda v: v.cast("double"))
    whole = vectors.where(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), is_query.alias("is_query"), doubles.alias("v"))
    size = F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b)
    x = written(whole.withColumn("size", size).where(F.col("size") > 0))
    dims = x.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max("size").alias("m"), F.count_if("is_query").alias("q")).orderBy(F.desc("n"), "d").limit(FITTED_LENGTHS).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    indexes: dict[int, ListIndex] = {}
    for r in dims:
        rows = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * r.d)))
        sample = x.where(F.size("v") == r.d).orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(rows).select("v").toArrow()
        indexes[r.d] = fit(sample.column("v").combine_chunks().flatten().to_numpy().reshape(-1, r.d), float(np.sqrt(r.m)) * (1 + 1e-12), r.n, k, target)
    queries = x.where("is_query").count()
    first_list = {d: i * MAX_LISTS for i, d in enumerate(indexes)}  # other lengths have the list -length

    short_batches(spark, 4096)

    def by_length(pdf: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
        return pdf.groupby(pdf.v.map(len)) if len(pdf) else iter(())

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, own in by_length(pdf):
                yield own.assign(list=indexes[d].lists_of(np.stack(own.v)) + first_list[d] if d in indexes else -d)

    listed = written(x.select("vec_id", "is_query", "v").mapInPandas(assign, "vec_id long, is_query boolean, v array<double>, list int"))
    # One row a list: how many chunks it is cut into. Lists are FITTED_LENGTHS * MAX_LISTS and one for each rare length.
    chunks = listed.groupBy("list").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks"))
    blocks = max(1, -(-queries // block_queries))
    own = listed.join(chunks, "list").select(
        "vec_id", "v", "list",
        F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("chunks")).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, own in by_length(pdf):
                yield own.assign(lists=list(indexes[d].probed(np.stack(own.v)).astype(np.int32) + first_list[d]) if d in indexes else [[-d]] * len(own))

    once = listed.where("is_query").groupBy("vec_id", F.size("v").alias("d")).agg(F.min("v").alias("v"))
    once = once.groupBy("vec_id").agg(F.min_by("v", "d").alias("v")).withColumnRenamed("vec_id", "query_id")
    asked = written(once.mapInPandas(probe, "query_id long, v array<double>, lists array<int>"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(5)), F.lit(blocks)).cast("int"))

    def meet(queries: DataFrame) -> DataFrame:
        """Queries, each with one list, meet all chunks of that list."""
        dealt = queries.join(chunks, "list").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        return own.groupBy("list", "chunk", "block").cogroup(dealt.groupBy("list", "chunk", "block")).applyInPandas(_scan_group(indexes, k), _HITS)

    lowest = F.lit(float("-inf"))
    first = best_hits(meet(asked.select("query_id", "v", "block", F.col("lists")[0].alias("list"), lowest.alias("floor"))), k, F.desc("score"), F.asc("vec_id"))
    hits = first = written(first.select("query_id", "vec_id", "score"))
    if max(i.probes for i in indexes.values()) > 1:
        reached = first.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n")).where(F.col("n") >= k).select("query_id", "low")
        rest = asked.join(reached, "query_id", "left").where(F.size("lists") > 1).select("query_id", "v", "block", F.explode(F.slice("lists", F.lit(2), F.size("lists") - 1)).alias("list"), F.coalesce("low", lowest).alias("floor"))
        hits = first.unionByName(meet(rest))
    ranked = best_hits(hits, k, F.desc("score"), F.asc("vec_id"))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
