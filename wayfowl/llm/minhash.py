"""MinHash near-duplicate detection with fast similarity sketches.

A text's set are its distinct shingles of three words, as 64-bit hashes. Its sketch has COORDINATES places, filled in rounds: in
each of the first COORDINATES rounds every hash goes to a place and brings a value, both drawn from the hash and the round; in
each round after those all hashes go to one place, the next in turn. A place keeps the least value of the first round that
reached it, and rounds end when no place is empty, so every coordinate is filled after twice COORDINATES rounds at most (a text of
a thousand words needs one or two). Two sets agree in a coordinate with a probability that is their Jaccard similarity, and the
number of agreeing coordinates is at least as concentrated as for independent hash functions.

Texts with equal sets are one node. Nodes are candidates if they agree in all BAND_ROWS coordinates of one of BANDS bands.

1. Each node meets the smallest node of each of its bands' keys. What differs too much in size, or agrees in fewer than LEAST_SHARE
   of the coordinates, is discarded; full sets verify the rest.
2. Where a key still holds nodes of several groups, these meet in blocks of bounded size: pairs of different groups that pass the
   same two tests are verified by full sets, or, where a block has more such pairs than DENSE times its nodes, these nodes' sets
   meet in blocks, which give only links that join groups. Nothing is dropped, and no group's pairs are all written out.

The connected components of the links are the groups. A link is never wrong; a pair of similarity 0.85 exactly is missed with a
probability of 8e-7 by the bands and of 3e-10 by LEAST_SHARE, and less above.

Keys that hold many rows (copies of one text, a node that thousands are compared with) are spread over SALTS keys where they are
joined; which keys these are is broadcast, HOT_KEYS rows at most by their definition.

Only texts that have candidates are shuffled: documents are read again and pass a bitmap of the wanted ones, of FILTER_BITS bits at
most, which is broadcast. It lets some others pass, which a join drops; where it gets full it only saves less.

Defined cases: null text counts as empty; a text without words has no shingles, and is linked with nothing; one of fewer words than
a shingle has its whole sequence as its only shingle; rows with a null doc_id can be linked, never name a group (a group of such
rows alone has a null component_id), and are not kept; repeated rows stay; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_text, short_batches, table, written
from .simhash import _named, connected_components, shingle_hashes

SHINGLE_WORDS = 3
#: The similarity in hundredths.
PERCENT = 85
BANDS = 24
BAND_ROWS = 5
COORDINATES = BANDS * BAND_ROWS
#: Candidates agree in this share of the coordinates at least.
LEAST_SHARE = 0.6
#: Values that are placed at once.
AT_ONCE = 4096
#: Nodes of a block, and bytes of their sets.
BLOCK_ROWS = 4096
BLOCK_BYTES = 32 << 20
#: A block's candidate pairs are written out if they are no more than so many times its nodes.
DENSE = 4
#: A key is hot if it holds more than HOT_LEAST rows and more than one in HOT_KEYS of all, so there are fewer than HOT_KEYS.
HOT_LEAST = 5000
HOT_KEYS = 1000
SALTS = 64
#: Bits of the filter of texts for each wanted one, and in all (16 MB).
BITS_EACH = 16
FILTER_BITS = 1 << 27

_EMPTY = np.uint64(2**64 - 1)
_HALF = np.uint64(32)
_LOW = np.uint64(2**32 - 1)


def _drawn(hashes: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """64 random bits for each round and hash."""
    x = hashes[None, :] + (rounds[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sketch(hashes: np.ndarray, size: int = COORDINATES) -> np.ndarray:
    """The fast similarity sketch of a set of 64-bit hashes; (round, value) of each place as one number."""
    out = np.full(size, _EMPTY, np.uint64)
    done = 0
    while len(hashes) and done < 2 * size and out.max() == _EMPTY:
        # Several rounds at once for few hashes: a later round brings larger numbers, so it fills empty places only.
        last = min(done + max(1, AT_ONCE // len(hashes)), size if done < size else 2 * size)
        rounds = np.arange(done, last, dtype=np.uint64)
        for at in range(0, len(hashes), AT_ONCE):
            x = _drawn(hashes[at : at + AT_ONCE], rounds)
            values = (rounds[:, None] << _HALF) | (x >> _HALF)
            if done < size:
                np.minimum.at(out, (((x & _LOW) * np.uint64(size)) >> _HALF).astype(np.int64).ravel(), values.ravel())
            else:
                places = slice(done - size, last - size)
                out[places] = np.minimum(out[places], values.min(axis=1))
        done = last
    return out


def band_keys(places: np.ndarray) -> np.ndarray:
    rows = places.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(rows)], np.uint64).view(np.int64)


_KEYED = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])
_KEYED_SQL = "doc_id long, place long, digest binary, n long, bands array<long>, sketch binary"


def _digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _keyed(shingle_words: int):
    """For a text: digest of its set, size, band keys, and a byte of each coordinate."""

    def make():
        def keys(text: bytes) -> tuple:
            hashes = np.unique(shingle_hashes(text, shingle_words))
            if not len(hashes):
                return b"", 0, [], b""
            places = sketch(hashes)
            return _digest(hashes), len(hashes), band_keys(places), (places & np.uint64(255)).astype(np.uint8).tobytes()

        return keys

    return make


def _hot(many: DataFrame, key: str, counts: DataFrame | None = None) -> DataFrame:
    """(key, salts) of the hot keys of many, broadcast. counts: (key, rows) of many, if known."""
    counts = many.groupBy(key).agg(F.count("*").alias("rows")) if counts is None else counts
    return F.broadcast(counts.where((F.col("rows") > HOT_LEAST) & (F.col("rows") * HOT_KEYS > many.count())).select(key, F.lit(SALTS).alias("salts")))


def _spread(many: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    return many.join(hot, key, "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.floor(F.rand(7) * SALTS).cast("int"))).drop("salts")


def _copied(one: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    return one.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")


def spread_join(many: DataFrame, one: DataFrame, key: str, counts: DataFrame | None = None) -> DataFrame:
    """many.join(one, key) with hot keys of many spread over SALTS keys; one has each key once. many is read twice, so it should be a
    written table."""
    hot = _hot(many, key, counts)
    return _spread(many, hot, key).join(_copied(one, hot, key), [key, "salt"]).drop("salt")


# --- verification -----------------------------------------------------------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _may_link(n_a, n_b, sketch_a: np.ndarray, sketch_b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs sizes and sketches let pass."""
    passed = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    at = np.flatnonzero(passed)
    if len(at):
        a = sketch_a if sketch_a.ndim == 1 else sketch_a[at]
        passed[at] = (a == sketch_b[at]).sum(axis=1) >= LEAST_SHARE * sketch_b.shape[1]
    return passed


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _passing(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
                kept = _may_link(n_a, n_b, _matrix(batch.column("sketch_a")), _matrix(batch.column("sketch_b")), percent)
                yield batch.select(["a", "b"]).filter(pa.array(kept))

    return run


def _both_sides(pairs: DataFrame, one: DataFrame, *columns: str) -> DataFrame:
    """pairs (a, b) with columns of one (node, ...) for either side; b may be hot."""
    side = lambda s: one.select(F.col("node").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in columns))
    return spread_join(pairs, side("b"), "b").join(side("a"), "a")


def _bit(place: Column, bits: int) -> Column:
    return F.pmod(place, F.lit(bits)) + 1


def _wanted_texts(docs: DataFrame, wanted: DataFrame, shingle_words: int) -> DataFrame:
    """(node, text) of wanted (node, digest, place), a written table: once each."""
    bits = FILTER_BITS
    count = wanted.count()
    while bits > 1 << 15 and bits // 2 >= BITS_EACH * count:
        bits //= 2
    marks = wanted.select(_bit(F.col("place"), bits).alias("bit"))
    filters = marks.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))
    own = docs.withColumn("bit", _bit(F.col("place"), bits)).withColumn("bucket", F.bitmap_bucket_number("bit")).withColumn("at", F.bitmap_bit_position("bit"))
    byte = F.conv(F.hex(F.expr("substring(bitmap, CAST(at DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    some = own.join(F.broadcast(filters), "bucket").where(F.pmod(F.floor(byte / F.pow(F.lit(2), F.col("at") % 8)), F.lit(2)) == 1)

    def digests():
        return lambda text: (_digest(np.unique(shingle_hashes(text, shingle_words))),)

    schema = pa.schema([("text", pa.string()), ("digest", pa.binary())])
    texts = some.select("text").mapInArrow(per_text(digests, schema, ("text",)), "text string, digest binary")
    return wanted.select("node", "digest").join(texts.groupBy("digest").agg(F.first("text").alias("text")), "digest").select("node", "text")


def _meetings(shingle_words: int, percent: int):
    """Rows (meet, salt, node, text), a meeting's own node first: which of the others are linked with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for batch in batches:
            found = []
            for meet, salt, node, text in zip(*(batch.column(c).to_pylist() for c in ("meet", "salt", "node", "text")), strict=True):
                hashes = np.unique(shingle_hashes(text.encode(), shingle_words))
                if (meet, salt) != now:
                    now, own = (meet, salt), hashes
                if node != meet and linked(own, hashes, percent):
                    found.append((node, meet))
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _confirm(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Of the written pairs (a, b) those whose full sets are similar: each a goes to its b, whose set is made once."""
    hot = _hot(pairs, "b")
    others = _spread(pairs, hot, "b").select(F.col("a").alias("node"), F.col("b").alias("meet"), "salt")
    need = written(others.unionByName(_copied(pairs.select("b").distinct(), hot, "b").select(F.col("b").alias("node"), F.col("b").alias("meet"), "salt")))
    wanted = written(nodes.select("node", "digest", "place").join(need.select("node").distinct(), "node", "left_semi"))
    met = need.join(_wanted_texts(docs, wanted, shingle_words), "node")
    short_batches(docs.sparkSession)
    ordered = met.repartition("meet", "salt").sortWithinPartitions("meet", "salt", F.col("node") != F.col("meet"))
    return written(ordered.select("meet", "salt", "node", "text").mapInArrow(_meetings(shingle_words, percent), "a long, b long"))


def _sets_of(docs: DataFrame, nodes: DataFrame, chosen: DataFrame, shingle_words: int) -> DataFrame:
    """(node, hashes) of the chosen nodes."""
    wanted = written(nodes.select("node", "digest", "place").join(chosen, "node", "left_semi"))

    def sets():
        return lambda text: (np.unique(shingle_hashes(text, shingle_words)).tobytes(),)

    return _wanted_texts(docs, wanted, shingle_words).mapInArrow(per_text(sets, pa.schema([("node", pa.int64()), ("hashes", pa.binary())]), ("node",)), "node long, hashes binary")


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])


def _group_candidates(node: np.ndarray, root: np.ndarray, n: np.ndarray, sketches: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Places (i, j) of pairs of different roots that may be linked. Who is of the most frequent root is only looked for by others."""
    order = np.argsort(n, kind="stable")
    names, counts = np.unique(root, return_counts=True)
    common, sizes = names[np.argmax(counts)], n[order]
    for i in np.flatnonzero(root != common).tolist():
        lo, hi = np.searchsorted(100 * sizes, percent * n[i]), np.searchsorted(percent * sizes, 100 * n[i], "right")
        near = order[lo:hi]
        near = near[(root[near] != root[i]) & ((near > i) | (root[near] == common))]
        if len(near):
            for j in near[_may_link(np.full(len(near), n[i]), n[near], sketches[i], sketches[near], percent)].tolist():
                yield i, j


def _candidates(percent: int):
    """In runs of one block: candidate pairs (a, b), or the block's nodes that have any, with their key and no b, where pairs are many."""

    def run_of(block: pa.Table) -> pa.RecordBatch:
        block = block.combine_chunks()
        node, root, n, key, name = (block.column(c).to_numpy() for c in ("node", "root", "n", "key", "block"))
        sketches = _matrix(block.column("sketch"))
        first = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (key[1:] != key[:-1]))))
        out: list[tuple] = []
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(node)], strict=True):
            pairs, some = [], set()
            for i, j in _group_candidates(node[lo:hi], root[lo:hi], n[lo:hi], sketches[lo:hi], percent):
                some |= {i, j}
                if len(pairs) <= DENSE * (hi - lo):
                    pairs.append((max(node[lo + i], node[lo + j]), min(node[lo + i], node[lo + j]), None))
            out += pairs if len(pairs) <= DENSE * (hi - lo) else [(node[lo + i], None, key[lo]) for i in sorted(some)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            name = batch.column("block").to_numpy()
            cut = int(np.searchsorted(name == name[-1], True)) if name[0] != name[-1] else 0
            if cut or (held and held[-1].column("block")[0].as_py() != name[0]):  # the last block may go on in the next batch
                done = [*held, batch.slice(0, cut)] if cut else held
                yield run_of(pa.Table.from_batches(done))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield run_of(pa.Table.from_batches(held))

    return run


def _block_links(percent: int):
    """Within a block: links between nodes of different roots, as far as no other path joins them."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        node, root, own, n = (rows.column(c).to_numpy() for c in ("node", "root", "own", "n"))
        sketches, sets = _matrix(rows.column("sketch")), [np.frombuffer(h, np.uint64) for h in rows.column("hashes").to_pylist()]
        across = own.min() != own.max()  # two chunks of one key: each was compared within itself elsewhere
        found: list[tuple[int, int]] = []
        for x in range(len(node) - 1):
            y = np.flatnonzero((root[x + 1 :] != root[x]) & ((own[x + 1 :] != own[x]) | (not across))) + x + 1
            if len(y):
                y = y[_may_link(np.full(len(y), n[x]), n[y], sketches[x], sketches[y], percent)]
            for z in y.tolist():
                if root[z] != root[x] and linked(sets[x], sets[z], percent):
                    found.append((max(node[x], node[z]), min(node[x], node[z])))
                    root = np.where(root == root[z], root[x], root)
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _dealt(placed: DataFrame, chunks: DataFrame) -> DataFrame:
    """placed (key, node, ...) in pairs of chunks of each key: lo, hi, and the node's own chunk."""
    dealt = placed.join(chunks, "key").withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    return dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("chunks", "other")


def links(docs: DataFrame, nodes: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Links (a, b), a > b, whose components are those of all links between nodes."""
    spark = docs.sparkSession
    member = nodes.select("node", F.explode("bands").alias("key"))
    least = member.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("size")).where("size > 1").select("key", "least")
    member = written(member.join(least, "key"))
    stars = written(member.where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    short_batches(spark, 4096)
    stars = written(_both_sides(stars, nodes, "n", "sketch").mapInArrow(_passing(percent), "a long, b long"))
    short_batches(spark)
    stars = _confirm(stars, docs, nodes, shingle_words, percent)
    root = connected_components(stars)
    # Keys that hold nodes of several groups.
    placed = written(member.select("node", "key").join(root, "node", "left").select("node", "key", F.coalesce("root", "node").alias("root")))
    sizes = placed.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1")
    chunks = sizes.select("key", F.ceil(F.col("size") / BLOCK_ROWS).cast("long").alias("chunks"))
    sketched = placed.join(chunks.select("key"), "key", "left_semi").join(nodes.select("node", "n", "sketch"), "node")
    dealt = _dealt(sketched, chunks).withColumn("block", F.xxhash64("key", "lo", "hi"))
    short_batches(spark, 4096)
    found = written(dealt.select("block", "key", "node", "root", "n", "sketch").repartition("block").sortWithinPartitions("block", "key").mapInArrow(_candidates(percent), "a long, b long, key long"))
    short_batches(spark)
    pairs = _confirm(written(found.where("b IS NOT NULL").select("a", "b").distinct()), docs, nodes, shingle_words, percent)
    # Dense blocks: full sets meet.
    dense = written(found.where("b IS NULL").select("key", F.col("a").alias("node")).distinct())
    if dense.isEmpty():
        return stars.unionByName(pairs)
    sets = written(_sets_of(docs, nodes, dense.select("node").distinct(), shingle_words))
    whole = written(dense.join(placed, ["key", "node"]).join(nodes.select("node", "n", "sketch"), "node").join(sets, "node"))
    chunks = whole.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(F.octet_length("hashes")) / BLOCK_BYTES)).cast("long").alias("chunks"))
    joins = written(_dealt(whole, chunks).groupBy("key", "lo", "hi").applyInArrow(_block_links(percent), "a long, b long"))
    return stars.unionByName(pairs).unionByName(joins)


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest doc_id of the group."""
    short_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("place", F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))))  # where its text is found again
    keyed = own.mapInArrow(per_text(_keyed(shingle_words), _KEYED, ("doc_id", "place")), _KEYED_SQL)
    rows = written(keyed.withColumn("row", F.monotonically_increasing_id()))
    # A node is named by the number of its first row.
    first = [F.min_by(c, "row").alias(c) for c in ("place", "bands", "sketch")]
    nodes = written(rows.where("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_id"), F.count("*").alias("rows"), F.max("n").alias("n"), *first))
    labelled = connected_components(links(own, nodes, shingle_words, percent))
    named = nodes.select("node", "digest").join(_named(nodes.select("node", "first_id"), labelled), "node").select("digest", "component_id")
    grouped = spread_join(rows.where("n > 0").select("doc_id", "n", "digest"), named, "digest", nodes.select("digest", "rows")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return grouped.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op12_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingles FROM w
),
one AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM one a JOIN one b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
near AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT reach.doc_id, near.y FROM reach JOIN near ON near.x = reach.other),
least_id AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN least_id ON s.doc_id = least_id.doc_id
"""
