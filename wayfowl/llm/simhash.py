"""SimHash near-duplicate detection with pivot distance tables.

Each text gets a 64-bit fingerprint, and each distinct fingerprint a row of a table: its Hamming distances to reference
fingerprints (pivots). Since |d(x, p) - d(y, p)| <= d(x, y), a candidate pair is discarded as soon as one of its coordinates
differs by more than the limit of bits; survivors are verified. There are two rules:

* near_duplicates() links fingerprints that differ in few bits. Candidates come from blocks of bits by an exact pigeonhole rule,
  so no link is lost.
* similar_groups() links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Fingerprints of such
  texts differ in ten bits on average, for which blocks of bits would need thousands of keys a text. Candidates share one of
  BANDS keys of BAND_ROWS minimum hashes instead; the pivot table and the fingerprints, with a limit of SIMILAR_BITS, discard
  most of them, and survivors are verified by their exact sets (of 64-bit hashes). A link is never wrong; a pair of similarity 0.8
  exactly is missed with a probability of 7e-5 by the keys and of 1e-5 by the limit, and less above.

The connected components of the links are the groups. Of a large block only what joins groups comes out, never all pairs.

Defined cases: null text counts as empty; texts without words are linked with each other (near_duplicates(): with any other
fingerprint near zero); rows with a null doc_id are kept and never name a group (their group may have a null id if nobody else is
in it); repeated rows stay, but keep_one() keeps one row of a group, the first of its smallest doc_id; an empty table gives an
empty result; other columns are ignored (keep_one(): kept).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import per_text, short_batches, table, written

SHINGLE_WORDS = 4
MAX_BITS = 4
PIVOTS = 24
#: Members of a block that one task compares; larger blocks are cut into chunks, and pairs of chunks are dealt out.
BLOCK_ROWS = 4096
#: Groups up to this size are compared by vectorised shifts, larger ones by a search that only emits a spanning forest.
SMALL_GROUP = 8
#: Keys over which the nodes of one component are spread where they are joined.
SALTS = 16
#: The rule on word shingles: words, similarity, and the bits in which fingerprints of candidates may differ.
SIMILAR_WORDS = 5
SIMILARITY = 0.8
SIMILAR_BITS = 24
BANDS = 24
BAND_ROWS = 5
#: Bytes of shingle hashes that one block takes on average, and hashes that are mixed at once.
BLOCK_BYTES = 32 << 20
HASHES_AT_ONCE = 4096

# A byte's bits, each in a byte of its own, so that up to 255 bytes can be added without overflow.
_LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that more than half of the 64-bit hashes have set."""
    n = len(hashes)
    rows = np.zeros((-(-n // 255) * 255, 8), np.uint64)
    rows[:n] = _LANES[hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)]
    counts = rows.reshape(-1, 255, 8).sum(axis=1).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * counts > n))


def shingle_hashes(text: bytes, shingle_words: int) -> np.ndarray:
    """Of all shingles in their order, repeats included; a shorter text is one shingle, one without words has none."""
    words = text.lower().split()  # on bytes both touch ASCII only: A-Z, and x20 x09-x0D
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - shingle_words].tolist()]
    stops = (ends[shingle_words - 1 :] - 1).tolist()
    return np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, starts, stops)), repeat(42)), np.uint64, len(starts))


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    return majority_bits(shingle_hashes(text, shingle_words))


def signed(x: int) -> int:
    return x - (x >> 63 << 64)


_FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def _signed(shingle_words: int):
    return lambda text: (signed(fingerprint(text, shingle_words)),)


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(per_text(partial(_signed, shingle_words), _FINGERPRINTS), "doc_id long, fp long")


def pivot_fingerprints(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(20).integers(0, 2**64, n, np.uint64)


def pivot_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each pivot."""
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)


def _verified(fps: np.ndarray, tab: np.ndarray, i: np.ndarray, j: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    near = np.abs(tab[i, 0] - tab[j, 0]) <= max_bits  # one coordinate first: it discards most pairs
    i, j = i[near], j[near]
    near = np.abs(tab[i] - tab[j]).max(axis=1, initial=0) <= max_bits
    i, j = i[near], j[near]
    near = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
    return i[near], j[near]


def _spanning(fps: np.ndarray, tab: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect what is linked among fps: a breadth-first search whose every step reads the pivot table."""
    order = np.argsort(tab[:, 0], kind="stable")
    fps, tab = fps[order], tab[order]
    open_, out = np.arange(len(fps)), []
    while len(open_) > 1:
        queue, open_ = [open_[0]], open_[1:]
        while queue and len(open_):
            x = queue.pop()
            a, b = np.searchsorted(tab[open_, 0], (tab[x, 0] - max_bits, tab[x, 0] + max_bits + 1))
            some = open_[a:b]
            some = some[np.abs(tab[some] - tab[x]).max(axis=1, initial=0) <= max_bits]
            some = some[np.bitwise_count(fps[some] ^ fps[x]) <= max_bits]
            if len(some):
                out += [(int(order[x]), int(order[y])) for y in some]
                queue += some.tolist()
                open_ = open_[~np.isin(open_, some, assume_unique=True)]
    return out


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(keys: np.ndarray, fps: np.ndarray, pivots: np.ndarray, max_bits: int) -> pa.RecordBatch:
    """Links within runs of equal keys."""
    fps = fps.view(np.uint64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(first, len(keys)))
    kept = np.repeat(sizes > 1, sizes)  # who is alone in a block has no candidates
    keys, fps, sizes = keys[kept], fps[kept], sizes[sizes > 1]
    found: list[np.ndarray] = []
    if len(keys):
        tab = pivot_table(fps, pivots)  # of those that have candidates; made here, as it is larger than what is shuffled without it
        small = np.flatnonzero(np.repeat(sizes <= SMALL_GROUP, sizes))
        for shift in range(1, SMALL_GROUP):
            i, j = small[:-shift], small[shift:]
            same = keys[i] == keys[j]
            if not same.any():
                break
            found.append(np.stack(_verified(fps, tab, i[same], j[same], max_bits)))
        starts = np.cumsum(sizes) - sizes
        for at, n in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP], strict=True):
            if pairs := _spanning(fps[at : at + n], tab[at : at + n], max_bits):
                found.append(np.array(pairs).T + at)
    i, j = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    a, b = fps[i].view(np.int64), fps[j].view(np.int64)
    pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
    pairs = pairs[:, pairs[0] != pairs[1]]
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=_LINKS)


def _tables(column: pa.Array) -> np.ndarray:
    """The pivot table's rows of a column."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(column), -1)


def _link_runs(max_bits: int, n_pivots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, keys, fps = pivot_fingerprints(n_pivots), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column("block").to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column("fp").to_numpy(zero_copy_only=False)])
            if len(keys) and (cut := int(np.searchsorted(keys == keys[-1], True))):  # the last run may go on in the next batch
                yield _links(keys[:cut], fps[:cut], pivots, max_bits)
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield _links(keys, fps, pivots, max_bits)

    return run


def block_scheme(n: int, max_bits: int) -> tuple[int, int]:
    """(blocks, of which so many agree) for n fingerprints: with b blocks, two within max_bits bits agree in b - max_bits.
    More blocks that must agree make longer keys, so that blocks stay short as the input grows."""
    for agree in range(1, 5):
        if 64 * agree / (max_bits + agree) >= np.log2(max(n, 2)) + 1:
            break
    return max_bits + agree, agree


def block_keys(fp: Column, blocks: int, agree: int) -> Column:
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    keys = []
    for c, chosen in enumerate(combinations(range(blocks), agree)):
        key = F.lit(c).cast("long")
        for i in chosen:
            key = F.shiftleft(key, cuts[i + 1] - cuts[i]).bitwiseOR(parts[i])
        keys.append(key)
    assert len(keys) == comb(blocks, agree)
    return F.array(*keys)


def links(distinct: DataFrame, max_bits: int = MAX_BITS, n_pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, n: int | None = None) -> DataFrame:
    """Links (a, b), a > b, between the distinct fingerprints in column fp. Of a large group only a spanning forest comes
    out, never all its pairs; its connected components are those of all links."""
    spark = distinct.sparkSession
    blocks, agree = block_scheme(distinct.count() if n is None else n, max_bits)
    keyed = distinct.select("fp", F.explode(block_keys(F.col("fp"), blocks, agree)).alias("key"))
    hot = keyed.groupBy("key").count().where(F.col("count") > block_rows).select("key", F.ceil(F.col("count") / block_rows).alias("chunks"))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks"))
    dealt = keyed.join(hot, "key", "left").select(
        "fp", "key", own.alias("own"),
        F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).alias("other"),
    )
    block = F.when(F.col("own").isNull(), F.xxhash64("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    short_batches(spark, 65536)
    # A collision of two block hashes only adds candidates, which are verified like all.
    found = dealt.select("fp", block.alias("block")).repartition("block").sortWithinPartitions("block", "fp").mapInArrow(_link_runs(max_bits, n_pivots), "a long, b long")
    return found.distinct()


def connected_components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of pairs (a, b), a > b; root is the component's smallest node. Alternates large-star and
    small-star steps, each a join and an aggregation, until a round changes no edge: then only stars are left. Every round is one
    job, whose edges are written to shared storage and counted and summed up on the way."""
    edges, last = pairs.select("a", "b").distinct(), None
    for _ in range(max_rounds):
        state = Observation()
        edges = written(edges.observe(state, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("sum")))
        now = state.get
        if now == last or not now["n"]:
            break
        last = now
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = small.select("e.a", "e.b").where("a != b").distinct()
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _named(nodes: DataFrame, labelled: DataFrame) -> DataFrame:
    """(node, component_id) of nodes (node, first_id): the smallest first_id of each component. Nodes of one large component are
    spread over SALTS keys."""
    member = written(nodes.join(labelled, "node", "left").select("node", "first_id", "root"))
    linked = member.where("root IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    alone = member.where("root IS NULL").select("node", F.col("first_id").alias("component_id"))
    return alone.unionByName(linked.join(smallest, ["root", "salt"]).select("node", "component_id"))


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, n_pivots: int = PIVOTS) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id of the group."""
    fps = written(fingerprints(docs, shingle_words))
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    labelled = connected_components(links(distinct, max_bits, n_pivots))
    named = _named(distinct.withColumnRenamed("fp", "node"), labelled).withColumnRenamed("node", "fp")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


# --- texts that are similar by their word shingles ---------------------------------------------------------------------------


_KEYED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("node", pa.int64()), ("bands", pa.list_(pa.int64()))])
_SHINGLED = pa.schema([("node", pa.int64()), ("fp", pa.int64()), ("tab", pa.binary()), ("hashes", pa.binary())])


def _band_keys(shingle_words: int):
    """For a text: its node (texts with equal sets of shingles are one) and its keys of minimum hashes."""

    def make():
        rng = np.random.default_rng(5)
        # Odd factors and a shift: the upper half of the product is a fresh order of the hashes.
        factor, add = rng.integers(0, 2**64, (BANDS * BAND_ROWS, 1), np.uint64) | np.uint64(1), rng.integers(0, 2**64, (BANDS * BAND_ROWS, 1), np.uint64)

        def keys(text: bytes) -> tuple:
            hashes = np.unique(shingle_hashes(text, shingle_words))
            least = np.full(BANDS * BAND_ROWS, 2**32 - 1, np.uint32)
            for at in range(0, len(hashes), HASHES_AT_ONCE):
                mixed = hashes[None, at : at + HASHES_AT_ONCE] ^ add
                mixed *= factor
                least = np.minimum(least, (mixed >> np.uint64(32)).min(axis=1).astype(np.uint32))
            bands = [xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, BAND_ROWS))]
            return signed(xxhash.xxh64_intdigest(hashes.tobytes(), 7)), np.array(bands, np.uint64).view(np.int64)

        return keys

    return make


def _shingled(shingle_words: int, n_pivots: int):
    """For a text: fingerprint, the pivot table's row, and the sorted set of hashes."""

    def make():
        pivots = pivot_fingerprints(n_pivots)

        def sets(text: bytes) -> tuple:
            hashes = np.unique(shingle_hashes(text, shingle_words))
            fp = majority_bits(hashes)
            return signed(fp), pivot_table(np.array([fp], np.uint64), pivots).tobytes(), hashes.tobytes()

        return sets

    return make


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def _verify(max_bits: int, similarity: float):
    """Of candidate pairs those that the pivot table, the fingerprints and the sets let pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fps = np.concatenate([batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("fp_a", "fp_b")])
            tab = np.concatenate([_tables(batch.column(c)) for c in ("tab_a", "tab_b")])
            i, j = _verified(fps, tab, np.arange(batch.num_rows), np.arange(batch.num_rows) + batch.num_rows, max_bits)
            sets = [batch.column(c) for c in ("hashes_a", "hashes_b")]
            kept = [k for k in i.tolist() if _similar(*(np.frombuffer(c[k].as_py(), np.uint64) for c in sets), similarity)]
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return run


def _block_links(max_bits: int, similarity: float):
    """Within a block: links between nodes of different roots, as far as no other path joins them."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        node, root, own = (rows.column(c).to_numpy() for c in ("node", "root", "own"))
        fps, tab = rows.column("fp").to_numpy().view(np.uint64), _tables(rows.column("tab"))
        sets = [np.frombuffer(h, np.uint64) for h in rows.column("hashes").to_pylist()]
        across = own.min() != own.max()  # two chunks of one key: each was compared within itself elsewhere
        found: list[tuple[int, int]] = []
        for x in range(len(node) - 1):
            y = np.flatnonzero((root[x + 1 :] != root[x]) & ((own[x + 1 :] != own[x]) | (not across))) + x + 1
            if len(y):
                _, y = _verified(fps, tab, np.full(len(y), x), y, max_bits)
            for z in y.tolist():
                if root[z] != root[x] and _similar(sets[x], sets[z], similarity):
                    found.append((max(node[x], node[z]), min(node[x], node[z])))
                    root = np.where(root == root[z], root[x], root)
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=_LINKS)

    return run


def similar_groups(rows: DataFrame, shingle_words: int = SIMILAR_WORDS, similarity: float = SIMILARITY, max_bits: int = SIMILAR_BITS, n_pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """Over (row, doc_id, text): the node of each row, (row, doc_id, node), and the group of each node, (node, component); component
    is the group's smallest node. Copies of a text share a node, and are not joined with anything here."""
    spark = rows.sparkSession
    short_batches(spark)
    keyed = written(rows.select("row", "doc_id", "text").mapInArrow(per_text(_band_keys(shingle_words), _KEYED, ("row", "doc_id")), "row long, doc_id long, node long, bands array<long>"))
    nodes = written(keyed.groupBy("node").agg(F.min("row").alias("row"), F.min_by("bands", "row").alias("bands")))
    member = nodes.select("node", F.explode("bands").alias("key"))
    least = member.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    member = written(member.join(least, "key"))
    # Only texts that have candidates are turned into sets.
    used = nodes.select("node", "row").join(member.select("node").distinct(), "node", "left_semi")
    texts = rows.select("row", "text").join(used, "row")
    sets = written(texts.mapInArrow(per_text(_shingled(shingle_words, n_pivots), _SHINGLED, ("node",)), "node long, fp long, tab binary, hashes binary"))
    # First each node meets the smallest one of each of its keys.
    stars = member.where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    for side in ("a", "b"):
        stars = stars.join(sets.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("fp", "tab", "hashes"))), side)
    stars = written(stars.mapInArrow(_verify(max_bits, similarity), "a long, b long"))
    root = connected_components(stars)
    # Then those of one key that are not in one group yet meet in blocks; large keys are cut into chunks, and pairs of chunks dealt out.
    placed = member.select("node", "key").join(root, "node", "left").select("node", "key", F.coalesce("root", "node").alias("root"))
    split = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("key")
    placed = placed.join(split, "key", "left_semi").join(sets, "node")
    placed = written(placed)
    sizes = placed.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("hashes")).alias("bytes"))
    chunks = sizes.select("key", F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("long").alias("chunks"))
    dealt = placed.join(chunks, "key").withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    dealt = dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("chunks", "other")
    joins = written(dealt.groupBy("key", "lo", "hi").applyInArrow(_block_links(max_bits, similarity), "a long, b long"))
    labelled = connected_components(stars.unionByName(joins))
    names = nodes.select("node").join(labelled, "node", "left").select("node", F.coalesce("root", "node").alias("component"))
    return keyed.select("row", "doc_id", "node"), names


def near_copies(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, component_id) of every row by the rule on shingles; component_id is the smallest doc_id of the group."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    members, names = similar_groups(rows, **params)
    first = members.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    named = _named(first, names.select("node", F.col("component").alias("root")))
    return members.join(named, "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs without near copies by the rule on shingles: of each group one row stays, the first of its smallest doc_id.
    Rows without a doc_id stay. Groups are found, and their rows chosen, on numbers of rows; texts are shuffled once, by that number."""
    number = next(f"row{i or ''}" for i in range(len(docs.columns) + 1) if f"row{i or ''}" not in docs.columns)
    numbered = written(docs.withColumn(number, F.monotonically_increasing_id()))
    rows = numbered.select(F.col(number).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    members, names = similar_groups(rows, **params)
    best = members.where("doc_id IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("best"))
    chosen = best.join(names, "node").groupBy("component").agg(F.min("best").alias("best")).select(F.col("best.row").alias(number))
    kept = chosen.unionByName(members.where("doc_id IS NULL").select(F.col("row").alias(number)))
    return numbered.join(kept, number, "left_semi").select(*docs.columns)


def op2_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
