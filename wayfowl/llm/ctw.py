"""Language-model scores by context-tree weighting over bytes.

A text is its lower-cased words, each followed by one space, and a newline as its end. Each byte is decomposed into eight binary
decisions, each with a tree of contexts: the last 0 to MAX_DEPTH bytes before it, across words (spaces stand before the text).
Every node holds a Krichevsky-Trofimov estimate of its decisions, and context-tree weighting mixes the estimates of all depths
along a context's path with the weights that the training data give: the node's own estimate against what its children make of
the same data. A context that was never seen ends the path at its deepest known suffix. A text's score is the sum over all its
bytes; code length per byte follows from it.

The model has every pair of context and byte that occurs, however many there are:

* Each task sums up the pairs and words of its texts and hands them on in blocks, dealt out by the last TOP_DEPTH bytes of the
  context (words by their hash). All deeper contexts that end in those bytes are below one node, so a bucket holds whole subtrees.
* From the deepest level up, each bucket weighs its subtrees; the few levels above TOP_DEPTH are aggregations. From the root down,
  those levels are joins, and each bucket goes on to the logarithm of every pair.
* A text looks its pairs and words up: the most frequent ones (HOT_PAIRS and HOT_WORDS at most, a fixed bound) are sent to every
  task, all others are joined with the same table by a shuffle.

Words are told apart by 64-bit hashes; two of a billion distinct words share one with a probability of three in a hundred.

Defined cases: null text counts as empty (its only token is the end); rows with a null doc_id fall in the training part and are
scored like any other; repeated rows count as often as they occur; texts of any length are worked through in slices; without
training rows N and V are zero and every decision has a chance of one half; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_bucket, short_batches, table, text_bytes, written

MAX_DEPTH = 6
TOP_DEPTH = 3
HOT_PAIRS = 3 << 19
HOT_WORDS = 1 << 19
HELD_OUT = (7, 2)  # crc32(doc_id as text) modulo 7 is 2: nothing is learnt from these rows
#: Bytes of texts that are worked on at once, also of one long text.
GROUP_BYTES = 512 << 10
#: Keys that a task gathers before it sums them up, and that one row of a block holds.
GATHER_KEYS = 2 << 20
BLOCK_KEYS = 4096
WORDS, PAIRS = 0, 1
END = xxhash.xxh64_intdigest(b"")  # no word is empty
_MIX = np.uint64(0x9E3779B97F4A7C15)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5: by Stirling's series, after shifting small arguments up."""
    shift, y = np.zeros_like(x), x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift - np.log(y), shift)
        y = np.where(low, y + 1, y)
    r = 1 / (y * y)
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y


_HALVES, _WHOLES = log_gamma(np.arange(1 << 14) + 0.5), log_gamma(np.arange(1 << 14) + 1.0)


def own_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    out, both = np.empty(len(zeros)), zeros + ones
    small = both < len(_WHOLES)
    a, b = zeros[small].astype(np.int64), ones[small].astype(np.int64)
    out[small] = _HALVES[a] + _HALVES[b] - _WHOLES[a + b]
    a, b = zeros[~small], ones[~small]
    out[~small] = log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1)
    return out - math.log(math.pi)


def weighted(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(logarithm of the mixture, weight of a node's own estimate); below is the sum of the children's mixtures."""
    own = own_log(zeros, ones) + math.log(0.5)
    mixed = np.logaddexp(own, below + math.log(0.5))
    return mixed, np.exp(np.minimum(own - mixed, 0.0))


# --- texts to keys -------------------------------------------------------------------------------------------------------


def stream(words: list[bytes]) -> bytes:
    return b" ".join([*words, b"\n"])


def slices(data: bytes, depth: int, size: int) -> Iterator[bytes]:
    """A stream in slices, each with the bytes before it that are contexts."""
    padded = b" " * depth + data
    for at in range(0, len(data), size):
        yield padded[at : at + size + depth]


def context_keys(parts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, part's number) of every byte of the parts behind their first `depth` bytes: a key has the context, the latest byte
    lowest, and below it the byte itself."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) - depth
    data = np.frombuffer(b"".join(parts), np.uint8)
    keys = data[depth:].astype(np.uint64)
    for back in range(1, depth + 1):
        keys |= data[depth - back : len(data) - back].astype(np.uint64) << np.uint64(8 * back)
    of = np.repeat(np.arange(len(parts)), lengths)
    return keys[np.arange(len(of)) + depth * of], of


def word_keys(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(key, text's number) of every token, the end included."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    keys = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, int(n.sum()))
    rows = np.arange(len(words))
    return np.concatenate([keys, np.full(len(words), END, np.uint64)]), np.concatenate([np.repeat(rows, n), rows])


def groups(texts: list[bytes]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(number of the first, words of each): consecutive texts of bounded size together."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= GROUP_BYTES):
            size += len(texts[stop])
            stop += 1
        yield at, [t.lower().split() for t in texts[at:stop]]  # on bytes both touch ASCII only: A-Z, and x20 x09-x0D
        at = stop


def pair_keys(words: list[list[bytes]], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, text's number) of every byte of the texts' streams; a long text comes in several slices."""
    parts, of, size = [], [], 0
    for i, own in enumerate(words):
        for part in slices(stream(own), depth, GROUP_BYTES):
            if size + len(part) > 2 * GROUP_BYTES:
                keys, place = context_keys(parts, depth)
                yield keys, np.array(of)[place]
                parts, of, size = [], [], 0
            parts.append(part)
            of.append(i)
            size += len(part)
    keys, place = context_keys(parts, depth)
    yield keys, np.array(of)[place]


# --- counting ------------------------------------------------------------------------------------------------------------


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n[order], first) if len(keys) else n.astype(np.int64)


class _Gathered:
    """Keys and how often they came; summed up whenever many have come."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> bool:
        """Whether it is time to hand them on."""
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > GATHER_KEYS:
            self.parts = [self.sums()]
            self.size = len(self.parts[0][0])
        return self.size > GATHER_KEYS // 2 and len(self.parts) == 1

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        return summed(*(np.concatenate(c) for c in zip(*self.parts, strict=True)))


def bucket_of(kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    own = keys if kind == WORDS else keys >> np.uint64(8) & np.uint64((1 << 8 * TOP_DEPTH) - 1)
    return ((own * _MIX) >> np.uint64(40)).astype(np.int64) % buckets


def _blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values of eight-byte numbers, cut at these places (the first 0, the last the end)."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((8 * cuts).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


_BLOCK = "kind int, bucket int, held boolean, keys binary, n binary"
_BLOCK_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("held", pa.bool_()), ("keys", pa.binary()), ("n", pa.binary())])


def _blocks(kind: int, held: bool, keys: np.ndarray, n: np.ndarray, buckets: int) -> pa.RecordBatch:
    bucket = bucket_of(kind, keys, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    sizes = np.diff(np.append(first, len(bucket)))
    pieces = -(-sizes // BLOCK_KEYS)
    starts = np.repeat(first, pieces) + BLOCK_KEYS * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    cuts = np.append(starts, len(bucket))
    rows = len(starts)
    return pa.RecordBatch.from_arrays([pa.array(np.full(rows, kind, np.int32)), pa.array(bucket[starts].astype(np.int32)), pa.array(np.full(rows, held)), _blobs(keys[order], cuts), _blobs(n[order], cuts)], schema=_BLOCK_SCHEMA)


def _count(depth: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = {(kind, held): _Gathered() for kind in (WORDS, PAIRS) for held in (False, True)}
        for batch in batches:
            held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            for at, words in groups(text_bytes(batch, "text")):
                mine = held[at : at + len(words)]
                for kind, found in ((WORDS, [word_keys(words)]), (PAIRS, pair_keys(words, depth))):
                    for keys, of in found:
                        for side in (False, True):
                            some = mine[of] == side
                            if some.any() and gathered[kind, side].add(keys if some.all() else keys[some]):
                                yield _blocks(kind, side, *gathered[kind, side].sums(), buckets)
                                gathered[kind, side] = _Gathered()
        for (kind, side), g in gathered.items():
            if g.parts:
                yield _blocks(kind, side, *g.sums(), buckets)

    return run


_SUMS = "kind int, bucket int, keys binary, n binary, m binary"
_SUM_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("n", pa.binary()), ("m", pa.binary())])


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by kind and bucket: one row a bucket, with each key's number in the training part (n) and elsewhere (m)."""

    def row(at: tuple[int, int], parts: list[tuple[bool, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys = np.concatenate([p[1] for p in parts])
        n, m = (np.concatenate([p[2] if p[0] == side else np.zeros(len(p[2]), np.int64) for p in parts]) for side in (False, True))
        (distinct, n), (_, m) = summed(keys, n), summed(keys, m)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*at, distinct.tobytes(), n.tobytes(), m.tobytes()), _SUM_SCHEMA.types, strict=True)], schema=_SUM_SCHEMA)

    last, parts = None, []
    for batch in batches:
        for kind, bucket, held, keys, n in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "held", "keys", "n")), strict=True):
            if (kind, bucket) != last:
                if parts:
                    yield row(last, parts)
                last, parts = (kind, bucket), []
            parts.append((held, np.frombuffer(keys, np.uint64), np.frombuffer(n, np.int64)))
    if parts:
        yield row(last, parts)


def key_counts(docs: DataFrame, depth: int, buckets: int) -> DataFrame:
    """(kind, bucket, keys, n, m) over (held, text): all words and all pairs, in buckets."""
    short_batches(docs.sparkSession)
    blocks = docs.mapInArrow(_count(depth, buckets), _BLOCK)
    return written(blocks.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(_sum_blocks, _SUMS))


# --- the tree ------------------------------------------------------------------------------------------------------------


@dataclass
class _Level:
    nodes: np.ndarray  # sorted: context's bytes, then the decided bits behind a leading one
    zeros: np.ndarray
    ones: np.ndarray
    up: np.ndarray  # place of a node's parent in the level above
    mixed: np.ndarray
    stop: np.ndarray


def shorter(nodes: np.ndarray, d: int) -> np.ndarray:
    """The nodes' keys with only the last d bytes of their contexts."""
    return (nodes >> np.uint64(8) & np.uint64((1 << 8 * d) - 1)) << np.uint64(8) | nodes & np.uint64(255)


def subtrees(pairs: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[list[_Level], np.ndarray, np.ndarray]:
    """(levels, the deepest first and `top` last; place, bit): the subtrees below the depth `top`, weighed from the deepest level
    up, and for each pair the deepest nodes and the bits of its eight decisions. Pairs that were not trained on have n = 0; their
    nodes change no mixture."""
    byte, context = pairs & np.uint64(255), pairs >> np.uint64(8) << np.uint64(8)
    nodes = np.concatenate([context | np.uint64(1 << i) | byte >> np.uint64(8 - i) for i in range(8)])
    bit = np.concatenate([byte >> np.uint64(7 - i) & np.uint64(1) for i in range(8)]).astype(bool)
    nodes, place = np.unique(nodes, return_inverse=True)
    times = np.tile(n.astype(np.float64), 8)
    ones, all_ = np.bincount(place, times * bit, len(nodes)), np.bincount(place, times, len(nodes))
    zeros, mixed, stop = all_ - ones, own_log(all_ - ones, ones), np.ones(len(nodes))
    levels = []
    for d in range(depth, top, -1):
        parents, up = np.unique(shorter(nodes, d - 1), return_inverse=True)
        levels.append(_Level(nodes, zeros, ones, up, mixed, stop))
        nodes, zeros, ones = parents, *(np.bincount(up, x, len(parents)) for x in (zeros, ones))
        mixed, stop = weighted(zeros, ones, np.bincount(up, mixed, len(parents)))
    levels.append(_Level(nodes, zeros, ones, np.zeros(0, np.int64), mixed, stop))
    return levels, place.reshape(8, -1), bit.reshape(8, -1)


def pair_logs(levels: list[_Level], place: np.ndarray, bit: np.ndarray, fixed: np.ndarray, share: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Natural logarithm of each pair's byte in its context. At the level `top`, the mixture's chance of a one is fixed + share *
    (what this node says), or `above` where the node was never trained on."""
    for level in levels[::-1]:
        estimate, known = (level.ones + 0.5) / (level.ones + level.zeros + 1), level.ones + level.zeros > 0
        chance = np.where(known, fixed + share * estimate, above)
        if level is not levels[0]:
            down = levels[next(i for i, x in enumerate(levels) if x is level) - 1].up
            fixed = np.where(known, fixed + share * level.stop * estimate, chance)[down]
            share = np.where(known, share * (1 - level.stop), 0.0)[down]
            above = chance[down]
    chance = np.clip(chance, 1e-15, 1 - 1e-15)
    return np.where(bit, np.log(chance)[place], np.log1p(-chance)[place]).sum(axis=0)


def _numbers(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, n, m = (batch.column(c)[row].as_py() for c in ("keys", "n", "m"))
    return np.frombuffer(keys, np.uint64), np.frombuffer(n, np.int64), np.frombuffer(m, np.int64)


_TOPS = "bucket int, node long, zeros double, ones double, mixed double, stop double"


def _bottom_up(depth: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, bucket in enumerate(batch.column("bucket").to_pylist()):
                pairs, n, _ = _numbers(batch, i)
                t = subtrees(pairs, n, depth, top)[0][-1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t.nodes), bucket, np.int32)), *(pa.array(x) for x in (t.nodes.view(np.int64), t.zeros, t.ones, t.mixed, t.stop))], names=["bucket", "node", "zeros", "ones", "mixed", "stop"])

    return run


def _weigh_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        zeros, ones, below = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("zeros", "ones", "below"))
        mixed, stop = weighted(zeros, ones, below)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(zeros), pa.array(ones), pa.array(mixed), pa.array(stop)], names=["node", "zeros", "ones", "mixed", "stop"])


def _shorter(node: Column, d: int) -> Column:
    context = F.shiftrightunsigned(node, 8).bitwiseAND(F.lit((1 << 8 * d) - 1))
    return F.shiftleft(context, 8).bitwiseOR(node.bitwiseAND(F.lit(255)))


def top_nodes(sums: DataFrame, depth: int, top: int) -> DataFrame:
    """(bucket, node, fixed, share, above) of all nodes of the depth `top`: what the levels above leave to them."""
    tops = level = written(sums.where(F.col("kind") == PAIRS).mapInArrow(_bottom_up(depth, top), _TOPS))
    levels = []
    for d in range(top - 1, -1, -1):
        level = level.groupBy(_shorter(F.col("node"), d).alias("node")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("mixed").alias("below"))
        level = written(level.mapInArrow(_weigh_nodes, "node long, zeros double, ones double, mixed double, stop double"))
        levels.append(level)
    known, estimate = F.col("ones") + F.col("zeros") > 0, (F.col("ones") + 0.5) / (F.col("ones") + F.col("zeros") + 1)
    chance = F.when(known, F.col("fixed") + F.col("share") * estimate).otherwise(F.col("above"))
    over = None
    for d, level in enumerate([*levels[::-1], tops]):
        if over is None:
            placed = level.select("*", F.lit(0.0).alias("fixed"), F.lit(1.0).alias("share"), F.lit(0.5).alias("above"))
        else:
            placed = level.withColumn("up", _shorter(F.col("node"), d - 1)).join(over, "up")
        if d == top:
            return placed.select("bucket", "node", "fixed", "share", "above")
        over = written(placed.select(
            F.col("node").alias("up"), F.when(known, F.col("fixed") + F.col("share") * F.col("stop") * estimate).otherwise(chance).alias("fixed"),
            F.when(known, F.col("share") * (1 - F.col("stop"))).otherwise(0.0).alias("share"), chance.alias("above"),
        ))


_VALUES = "kind int, key long, times long, known int, base double, score double"


def _values_of_words(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, n, m = _numbers(batch, i)
                yield _value_rows(WORDS, keys, n + m, n > 0, np.log10((n + 1) / total), np.zeros(len(keys)))

    return run


def _value_rows(kind: int, keys: np.ndarray, times: np.ndarray, known: np.ndarray, base: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(times), pa.array(known.astype(np.int32)), pa.array(base), pa.array(score)], names=["kind", "key", "times", "known", "base", "score"])


def _values_of_pairs(depth: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pairs, n, m = _numbers(batch, i)
                tops = batch.column("tops")[i].values
                node, *above = (tops.field(c).to_numpy(zero_copy_only=False) for c in ("node", "fixed", "share", "above"))
                order = np.argsort(node.view(np.uint64))  # as subtrees() sorts them
                logs = pair_logs(*subtrees(pairs, n, depth, top), *(x[order] for x in above))
                yield _value_rows(PAIRS, pairs, n + m, np.zeros(len(pairs)), np.zeros(len(pairs)), logs / math.log(10))

    return run


def key_values(sums: DataFrame, total: int, depth: int, top: int = TOP_DEPTH) -> DataFrame:
    """(kind, key, times, known, base, score) of every word and every pair: what one occurrence adds to a text's sums."""
    short_batches(sums.sparkSession, 16)  # a row is a bucket
    below = top_nodes(sums, depth, top).groupBy("bucket").agg(F.collect_list(F.struct("node", "fixed", "share", "above")).alias("tops"))  # a bucket's own
    pairs = sums.where(F.col("kind") == PAIRS).join(below, "bucket").select("keys", "n", "m", "tops").mapInArrow(_values_of_pairs(depth, top), _VALUES)
    words = sums.where(F.col("kind") == WORDS).select("keys", "n", "m").mapInArrow(_values_of_words(total), _VALUES)
    return written(words.unionByName(pairs))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            _, n, _ = _numbers(batch, i)
            yield pa.RecordBatch.from_arrays([pa.array([int(n.sum())]), pa.array([int((n > 0).sum())])], names=["n", "v"])


# --- scoring -------------------------------------------------------------------------------------------------------------


#: What a word and a pair add to a text's sums: the sum's name, and the value's.
ADDS = {WORDS: {"n_known": "known", "base": "base"}, PAIRS: {"score": "score"}}


def frequent(values: DataFrame, kind: int, most: int) -> tuple[int, tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """(least, (keys, levels, values)) of the keys of a kind whose class of frequency is `least` or more, at most `most` of them."""
    own = values.where(F.col("kind") == kind)
    level = F.floor(4 * F.log2("times"))
    sizes = np.zeros(256, np.int64)
    for r in own.groupBy(level.cast("int").alias("k")).agg(F.count("*").alias("m")).collect():  # 256 rows at most
        sizes[r.k] += r.m
    first = int(np.argmax(np.cumsum(sizes[::-1])[::-1] <= most))
    rows = own.where(level >= first).select("key", level.cast("short").alias("level"), *ADDS[kind].values()).toArrow()
    found = rows.column("key").to_numpy().view(np.uint64), rows.column("level").to_numpy(), {c: rows.column(c).to_numpy() for c in ADDS[kind].values()}
    del rows
    pa.default_memory_pool().release_unused()
    return first, found


class Lookup:
    """A hash table in arrays: of the keys that share a slot the first one stays, the others go on to a smaller table, and the last
    few are sorted. The most frequent keys are placed first, so nearly all that are asked for are found at once."""

    def __init__(self, keys: np.ndarray, levels: np.ndarray, values: dict[str, np.ndarray], tables: int = 3):
        order = np.argsort(-levels, kind="stable")
        keys = keys[order]
        self.keys, self.values, self.slots = keys, {c: v[order] for c, v in values.items()}, []
        left = np.arange(len(keys))
        for level in range(tables):
            slots = np.full(1 << max(4, (2 * len(left)).bit_length()), -1, np.int32)
            _, first = np.unique(self._slot(keys[left], level, len(slots)), return_index=True)
            slots[self._slot(keys[left[first]], level, len(slots))] = left[first]
            self.slots.append(slots)
            left = np.delete(left, first)
        self.rest = left[np.argsort(keys[left])]

    @staticmethod
    def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return ((keys + np.uint64(level)) * _MIX) >> np.uint64(65 - size.bit_length())

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        place = np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return place
        todo = np.arange(len(keys))
        for level, slots in enumerate(self.slots):
            at = slots[self._slot(keys, level, len(slots))]
            found = self.keys[at] == keys
            found &= at >= 0
            place[todo[found]] = at[found]
            todo, keys = todo[~found], keys[~found]
        if len(self.rest):
            at = self.rest[np.minimum(np.searchsorted(self.keys[self.rest], keys), len(self.rest) - 1)]
            place[todo] = np.where(self.keys[at] == keys, at, -1)
        return place


_ROWS = "row long, doc_id long, n_tokens long, n_bytes long, n_known long, base double, score double, kind int, key long, times long"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
_ROW_SCHEMA = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in _ROWS.split(", ")])


_LOOKUPS: dict[str, tuple[Lookup, ...]] = {}  # a Python worker serves many tasks


def _score_rows(shared, depth: int):
    """For each text a row with what its frequent words and pairs give, and a row for each other distinct word and pair."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _LOOKUPS:
            _LOOKUPS.clear()
            _LOOKUPS[name] = tuple(Lookup(*x) for x in shared.value)
        words_at, pairs_at = _LOOKUPS[name]
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column("doc_id")
            for at, words in groups(text_bytes(batch, "text")):
                size = len(words)
                sums = {c: np.zeros(size) for c in ("n_tokens", "n_bytes", "n_known", "base", "score")}
                rest = []
                for kind, lookup, found in ((WORDS, words_at, [word_keys(words)]), (PAIRS, pairs_at, pair_keys(words, depth))):
                    for keys, of in found:
                        place = lookup.find(keys)
                        missed = place < 0
                        sums["n_tokens" if kind == WORDS else "n_bytes"] += np.bincount(of, minlength=size)
                        if not missed.all():
                            for to, c in ADDS[kind].items():
                                sums[to] += np.bincount(of, np.where(missed, 0, lookup.values[c][place]), size)
                        if missed.any():
                            k, t = keys[missed], of[missed]
                            order = np.lexsort((k, t))
                            k, t = k[order], t[order]
                            first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (t[1:] != t[:-1]))))
                            rest.append((kind, row + t[first], k[first], np.diff(np.append(first, len(k)))))
                whole = [pa.array(np.arange(row, row + size)), ids.slice(at, size), *(pa.array(sums[c].astype(np.int64)) for c in ("n_tokens", "n_bytes", "n_known")), pa.array(sums["base"]), pa.array(sums["score"])]
                yield pa.RecordBatch.from_arrays([*whole, *(pa.nulls(size, t) for t in _ROW_SCHEMA.types[7:])], schema=_ROW_SCHEMA)
                for kind, rows, keys, times in rest:
                    yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.nulls(len(rows), t) for t in _ROW_SCHEMA.types[1:7]), pa.array(np.full(len(rows), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(times)], schema=_ROW_SCHEMA)
                row += size

    return run


def score_documents(docs: DataFrame, held_out: tuple[int, int] = HELD_OUT, max_depth: int = MAX_DEPTH, hot_words: int = HOT_WORDS, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row; scores are log10
    probabilities, n_bytes counts the coded bytes and bits_per_byte is their code length."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = (id_bucket("doc_id", held_out[0]) == held_out[1]) & F.col("doc_id").isNotNull()
    buckets = max(64, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    sums = key_counts(own.select(held.alias("held"), "text"), max_depth, buckets)
    size = sums.where(F.col("kind") == WORDS).mapInArrow(_sizes, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    values = key_values(sums, size.n + size.v + 1, max_depth, min(TOP_DEPTH, max_depth))
    (least_words, words), (least_pairs, pairs) = frequent(values, WORDS, hot_words), frequent(values, PAIRS, hot_pairs)
    shared = spark.sparkContext.broadcast((words, pairs))
    del words, pairs
    short_batches(spark)
    rows = written(own.mapInArrow(_score_rows(shared, max_depth), _ROWS))
    shared.destroy()  # the written rows need it no more
    # The other words and pairs are looked up by a shuffle and summed up by row.
    others = values.where(F.floor(4 * F.log2("times")) < F.when(F.col("kind") == WORDS, least_words).otherwise(least_pairs)).select("kind", "key", "known", "base", "score")
    rest = rows.where("key IS NOT NULL").select("row", "kind", "key", F.col("times").alias("n")).join(others, ["kind", "key"])
    rest = rest.select("row", (F.col("n") * F.col("known")).alias("n_known"), (F.col("n") * F.col("base")).alias("base"), (F.col("n") * F.col("score")).alias("score"))
    whole = rows.where("key IS NULL").select("row", "doc_id", "n_tokens", "n_bytes", "n_known", "base", "score")
    both = whole.unionByName(rest, allowMissingColumns=True)
    total = both.groupBy("row").agg(*(F.max(c).alias(c) for c in ("doc_id", "n_tokens", "n_bytes")), *(F.sum(c).alias(c) for c in ("n_known", "base", "score")))
    bits = -F.col("score") * math.log2(10) / F.col("n_bytes")
    return total.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(size.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score", "n_bytes", bits.alias("bits_per_byte"))


def op5_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
