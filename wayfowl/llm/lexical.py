"""Ranked lexical search: exact inner products of sparse vectors by branch and bound over ball trees.

A document's vector has for each term w * ((10**9 * tf) div (1000 * tf + 8 * m)), an integer: w = floor(1000 * ln((2 * N + 2) /
(2 * df + 1))) is the term's weight, m = 100 - 90 + ((90 * n * N) div L) grows with the document's length. An item's vector has
a one for each of its terms, so a score is an inner product.

Documents are read once: of each text only the terms that some item has are kept, with their counts, and the number of all its
terms; N, L and df are counts over all of these rows. Each task then reads its part of them in shards of bounded size, builds a
ball tree over a shard, and carries the k best of each item on from shard to shard, so that nothing but k rows an item and task
is shuffled.

The tree halves a shard between two far documents. A node has a centre c and radii: for each group g of terms the largest distance
r_g of its documents to c in the terms of g, so no inner product with an item q is above q.c + sum of |q_g| r_g (one group would
be the plain ball; groups make it smaller, as a document without an item's terms is not far in the dimensions of those). Terms
that one item has alone are that item's group; terms of several items form groups of GROUP_TERMS. Bounds are rounded up: SLACK of
all magnitudes that were added, more than the error of adding four million doubles. Nodes are visited in the order of their bounds
until these fall below the item's k-th score; an equal score may still win by its id. Leaves are scored in 64-bit integers.

Items are taken in blocks of BLOCK_TERMS terms on average, which bounds what is sent to the workers; each block reads the documents
once.

Defined cases: null texts have no terms; documents without terms count nowhere; those with a null doc_id count in N, L and df, but
are not returned; rows of one doc_id are documents of their own; items of one item_id are one item with the terms of all its rows,
those with a null item_id or without terms have no result; equal scores go by doc_id; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import per_text, short_batches, table, written

K = 10
#: On bytes: A-Z are made small before, and all bytes of characters beyond ASCII are from 0x80 on.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Of a shard: documents, and terms of documents, at most; documents of a leaf.
SHARD_ROWS = 8192
SHARD_ENTRIES = 1 << 21
LEAF_ROWS = 128
GROUP_TERMS = 4
BLOCK_TERMS = 200_000
SLACK = 1e-9
#: Keys over which an item's hits are spread before the last choice.
SALTS = 64


def terms(text: bytes) -> list[bytes]:
    return _TERM.findall(text.lower())


class Items:
    """A block of items: their terms, numbered so that those of a group stand together."""

    def __init__(self, asked: list[tuple[int, bytes]], group_terms: int = GROUP_TERMS):
        self.ids = sorted({i for i, _ in asked})
        place, of_term = {x: i for i, x in enumerate(self.ids)}, {}
        for i, t in asked:
            of_term.setdefault(t, []).append(place[i])
        own = sorted((x[0], t) for t, x in of_term.items() if len(x) == 1)
        shared = sorted((min(x), t) for t, x in of_term.items() if len(x) > 1)
        groups = [("own", i) for i, _ in own] + [("shared", k // group_terms) for k in range(len(shared))]
        self.number = {t: k for k, (_, t) in enumerate(own + shared)}
        names = {g: k for k, g in enumerate(dict.fromkeys(groups))}
        self.group = np.array([names[g] for g in groups], np.int64)
        self.n_groups = len(names)
        pairs = sorted((i, self.number[t]) for t, x in of_term.items() for i in x)
        self.item, self.term = np.array(pairs, np.int64).reshape(-1, 2).T
        self.starts = np.searchsorted(self.item, np.arange(len(self.ids) + 1))
        keys, counts = np.unique(np.stack([self.item, self.group[self.term]]), axis=1, return_counts=True)
        self.item_of_part, self.group_of_part, self.length_of_part = keys[0], keys[1], np.sqrt(counts)

    def terms_of(self, item: int) -> np.ndarray:
        return self.term[self.starts[item] : self.starts[item + 1]]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class SparseBalls:
    """A ball tree over sparse rows: row r has values[start[r]:start[r + 1]] in columns, which ascend. bounds holds for each node what
    an item's inner product with its rows can't exceed."""

    def __init__(self, start: np.ndarray, columns: np.ndarray, values: np.ndarray, items: Items, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(start) - 1)
        self.lo, self.hi, self.kids, bounds = [], [], [], []
        self._start, self._columns, self._values, self._items = start, columns, values.astype(np.float64), items
        todo = [(0, len(self.order), -1)]
        while todo:
            a, b, parent = todo.pop()
            if parent >= 0:
                self.kids[parent].append(len(self.lo))
            self.lo.append(a)
            self.hi.append(b)
            self.kids.append([])
            bound, halves = self._node(a, b, b - a > leaf_rows)
            bounds.append(bound)
            if halves is not None:
                self.order[a:b] = self.order[a:b][halves]
                todo += [((a + b) // 2, b, len(self.lo) - 1), (a, (a + b) // 2, len(self.lo) - 1)]
        self.bounds = np.array(bounds)

    def _node(self, a: int, b: int, split: bool) -> tuple[np.ndarray, np.ndarray | None]:
        items, rows = self._items, self.order[a:b]
        sizes = self._start[rows + 1] - self._start[rows]
        at = _ranges(self._start[rows], sizes)
        columns, values, row = self._columns[at], self._values[at], np.repeat(np.arange(b - a), sizes)
        centre = np.bincount(columns, values, len(items.group)) / (b - a)
        mean, group = centre[columns], items.group[columns]
        # Squares of a row's distance to the centre in each group; a row without terms of a group is as far as the centre is long.
        centre_squares = np.bincount(items.group, centre**2, items.n_groups)
        cuts = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (group[1:] != group[:-1]))))
        here = group[cuts]
        squares = np.add.reduceat((values - mean) ** 2 - mean**2, cuts) + centre_squares[here]
        squares += SLACK * (np.add.reduceat(values**2 + 3 * mean**2, cuts) + centre_squares[here])
        largest = np.where(np.bincount(here, minlength=items.n_groups) < b - a, centre_squares * (1 + SLACK), 0)
        np.maximum.at(largest, here, squares)
        radius = np.sqrt(np.maximum(largest, 0))
        along = np.bincount(items.item, centre[items.term], len(items.ids))
        reach = np.bincount(items.item_of_part, items.length_of_part * radius[items.group_of_part], len(items.ids))
        bound = (along + reach) * (1 + SLACK) + 1
        if not split:
            return bound, None
        starts = np.cumsum(sizes) - sizes
        dot = lambda v: np.add.reduceat(values * v[columns], starts)
        length = np.add.reduceat(values**2, starts)
        one = self._dense(rows[np.argmax(length - 2 * dot(centre))])
        to_one = dot(one)
        other = self._dense(rows[np.argmax(length - 2 * to_one)])
        side = to_one - dot(other)
        if side.min() == side.max():
            return bound, None  # all alike
        return bound, np.argpartition(side, (b - a) // 2)

    def _dense(self, row: int) -> np.ndarray:
        out = np.zeros(len(self._items.group))
        out[self._columns[self._start[row] : self._start[row + 1]]] = self._values[self._start[row] : self._start[row + 1]]
        return out


class Leaf:
    """A leaf's values by term, for scores."""

    def __init__(self, start: np.ndarray, columns: np.ndarray, values: np.ndarray, rows: np.ndarray):
        sizes = start[rows + 1] - start[rows]
        at = _ranges(start[rows], sizes)
        order = np.argsort(columns[at], kind="stable")
        self.columns, self.values, self.rows, self.n = columns[at][order], values[at][order], np.repeat(np.arange(len(rows)), sizes)[order], len(rows)

    def scores(self, asked: np.ndarray) -> np.ndarray:
        first, last = np.searchsorted(self.columns, asked), np.searchsorted(self.columns, asked, "right")
        at = _ranges(first, last - first)
        out = np.zeros(self.n, np.int64)
        np.add.at(out, self.rows[at], self.values[at])
        return out


class Best:
    """Of each item the k best (score, -doc_id) so far, the worst first, and the score that must be reached."""

    def __init__(self, n: int, k: int):
        self.k, self.found, self.floor = k, [[] for _ in range(n)], np.ones(n, np.int64)

    def offer(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        best = self.found[item]
        for j in np.flatnonzero(scores >= self.floor[item]).tolist():
            new = int(scores[j]), -int(ids[j])
            if len(best) < self.k:
                heapq.heappush(best, new)
            elif new > best[0]:
                heapq.heapreplace(best, new)
        if len(best) == self.k:
            self.floor[item] = best[0][0]


def search(ids: np.ndarray, start: np.ndarray, columns: np.ndarray, values: np.ndarray, items: Items, best: Best, leaf_rows: int = LEAF_ROWS) -> int:
    """Offers best all rows of a shard that can matter, and returns how many leaves were scored."""
    tree, leaves, scored = SparseBalls(start, columns, values, items, leaf_rows), {}, 0
    for i in np.flatnonzero(tree.bounds[0] >= best.floor).tolist():
        bound = tree.bounds[:, i]
        heap = [(-bound[0], 0)]
        while heap:
            top, node = heapq.heappop(heap)
            if -top < best.floor[i]:
                break
            if tree.kids[node]:
                for kid in tree.kids[node]:
                    if bound[kid] >= best.floor[i]:
                        heapq.heappush(heap, (-bound[kid], kid))
                continue
            rows = tree.order[tree.lo[node] : tree.hi[node]]
            if node not in leaves:
                leaves[node] = Leaf(start, columns, values, rows)
            best.offer(i, leaves[node].scores(items.terms_of(i)), ids[rows])
            scored += 1
    return scored


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def lengths(n: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """m of documents with n terms."""
    if 90 * int(n.max(initial=0)) * documents < 2**63:
        return 100 - 90 + 90 * n * documents // all_terms
    return np.array([100 - 90 + 90 * int(x) * documents // all_terms for x in n], np.int64)


_HITS = "item_id long, doc_id long, score long"


def _search_rows(items: Items, weights: np.ndarray, documents: int, all_terms: int, k: int, shard_rows: int, leaf_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, rows, entries = Best(len(items.ids), k), [], 0, 0

        def shard() -> None:
            whole = pa.Table.from_batches(held).combine_chunks()
            ids, n = whole.column("doc_id").to_numpy(), whole.column("n").to_numpy()
            lists = whole.column("terms").chunk(0)
            start = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))
            columns = lists.flatten().to_numpy().astype(np.int64)
            tf = whole.column("counts").chunk(0).flatten().to_numpy().astype(np.int64)
            m = np.repeat(lengths(n, documents, all_terms), np.diff(start))
            search(ids, start, columns, weights[columns] * (10**9 * tf // (1000 * tf + 8 * m)), items, best, leaf_rows)

        for batch in batches:
            if batch.num_rows:
                size = len(batch.column("terms").flatten())
                if held and (rows + batch.num_rows > shard_rows or entries + size > SHARD_ENTRIES):
                    shard()
                    held, rows, entries = [], 0, 0
                held.append(batch)
                rows, entries = rows + batch.num_rows, entries + size
        if held:
            shard()
        out = [(items.ids[i], -neg, score) for i, found in enumerate(best.found) for score, neg in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], names=["item_id", "doc_id", "score"])

    return run


_COUNTED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])


def _counted(number: dict[bytes, int]):
    def make():
        def count(text: bytes) -> tuple:
            found = terms(text)
            kept = sorted((i, c) for t, c in Counter(found).items() if (i := number.get(t)) is not None)
            return len(found), [i for i, _ in kept], [c for _, c in kept]

        return count

    return make


def asked_terms(queries: DataFrame) -> DataFrame:
    """(item_id, term) of each item's terms, once each."""
    schema = pa.schema([("item_id", pa.int64()), ("terms", pa.list_(pa.binary()))])
    own = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL")
    found = own.mapInArrow(per_text(lambda: lambda text: (list(set(terms(text))),), schema, ("item_id",)), "item_id long, terms array<binary>")
    return found.select("item_id", F.explode("terms").alias("term")).distinct()


def _rank_block(docs: DataFrame, items: Items, k: int, shard_rows: int, leaf_rows: int) -> DataFrame:
    spark = docs.sparkSession
    short_batches(spark)
    counted = written(docs.mapInArrow(per_text(_counted(items.number), _COUNTED), "doc_id long, n long, terms array<int>, counts array<int>").where("n > 0"))
    whole = counted.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    holding = {r.term: r["count"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    weights = np.array([weight(whole.documents, holding.get(t, 0)) for t in range(len(items.group))], np.int64)
    short_batches(spark, min(2048, shard_rows))
    some = counted.where("doc_id IS NOT NULL AND size(terms) > 0")
    return some.mapInArrow(_search_rows(items, weights, whole.documents, whole.terms or 1, k, shard_rows, leaf_rows), _HITS)


def rank(documents: DataFrame, queries: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of queries (item_id, text) the k best of documents (doc_id, text)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = written(asked_terms(queries))
    blocks = max(1, -(-asked.count() // block_terms))
    hits = None
    for block in range(blocks):
        items = Items([(r.item_id, bytes(r.term)) for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()])
        found = _rank_block(docs, items, k, shard_rows, leaf_rows).withColumn("salt", F.spark_partition_id() % SALTS)
        hits = found if hits is None else hits.unionByName(found)
    order = F.desc("score"), F.asc("doc_id")
    for keys in (("item_id", "salt"), ("item_id",)):
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return hits.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL
),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
a AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
m AS (SELECT r, doc_id, 100 - 90 + ((90 * CAST(len(terms) AS BIGINT) * n_docs) // n_terms) AS m FROM d, a WHERE len(terms) > 0),
f AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, a GROUP BY term, n_docs),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id
),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
