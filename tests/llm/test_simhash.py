import itertools

import corpus_pipeline
import numpy as np
import xxhash

from wayfowl.llm import simhash


def slow_fingerprint(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    hs = [xxhash.xxh64(" ".join(words[i : i + k]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(ids, fps, limit=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprints_match_the_definition():
    for text in ["", "  ", "a", "A b", "a b c d", "a b c d a b c d a b c d", "É x y\tz\x0bq w " * 9, "the " * 700 + "End"]:
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_query_matches_brute_force(spark, sf):
    got = {r.doc_id: r for r in simhash.op2_simhash_near_duplicates(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = [slow_fingerprint(r.text) for r in docs]
    comps = slow_components([r.doc_id for r in docs], fps)
    assert len(got) == len(docs)
    for r, fp, c in zip(docs, fps, comps, strict=True):
        assert (got[r.doc_id].fingerprint, got[r.doc_id].component_id) == (f"{fp:016x}", c)


def test_no_link_is_lost_in_large_groups(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**64, 6, np.uint64)]
    fps = {0, 2**64 - 1}
    for b in base:
        for _ in range(120):
            x = b
            for bit in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    rows = spark.createDataFrame([(x - (x >> 63 << 64),) for x in fps], "fp long")
    for rows_in_block in (4096, 16):
        pairs = simhash.links(rows, block_rows=rows_in_block)
        comp = {r.node % 2**64: r.root for r in simhash.connected_components(pairs).collect()}
        want = slow_components(list(range(len(fps))), fps)
        groups = {}
        for x, c in zip(fps, want, strict=True):
            groups.setdefault(c, set()).add(comp.get(x, x))
        assert all(len(v) == 1 for v in groups.values())
        assert len({next(iter(v)) for v in groups.values()}) == len(groups)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b c d e f", "y"), (7, "a b c d e f", "y"), (7, "a b c d e f", "y"), (9, "w " * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 7), (1, 1), (2, 1), (7, 7), (7, 7), (9, 9)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 7, 9]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


# --- the rule on shingles ------------------------------------------------------------------------------------------------

WORDS = [f"w{i}" for i in range(5000)]


def slow_shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def slow_groups(texts):
    """Of each key the smallest key that can be reached."""
    sets, group = {i: slow_shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for i, j in itertools.combinations(sorted(texts), 2):
        both = len(sets[i] & sets[j])
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            a, b = group[i], group[j]
            group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    return group


def near_copies_of(rng):
    """Texts of 60 to 200 words, each with a copy in which every 60th word is another: similar by 0.8 to 0.9."""
    texts = {}
    for i in range(40):
        own = rng.choice(WORDS, int(rng.integers(60, 200))).tolist()
        other = [("x" + w) if k % 60 == 30 else w for k, w in enumerate(own)]
        texts[2 * i], texts[2 * i + 1] = " ".join(own), " ".join(other)
    return texts


def test_stage_drops_what_is_similar_by_shingles(spark):
    texts = near_copies_of(np.random.default_rng(3))
    far = [i for i in range(40) if (simhash.fingerprint(texts[2 * i].encode()) ^ simhash.fingerprint(texts[2 * i + 1].encode())).bit_count() > simhash.MAX_BITS]
    assert far  # pairs that a limit of four bits misses
    texts |= {100: "", 101: None, 102: "a b", 103: "A  b", 104: "a c"}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, lang string")
    want = slow_groups(texts)
    assert {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()} == want
    step = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert step.columns == docs.columns and sorted(r.doc_id for r in step.collect()) == sorted(set(want.values()))


def test_a_chain_in_one_key_and_rows_without_id(spark):
    words = WORDS[:60]
    texts = {k: " ".join(words[2 * k :] + WORDS[1000 : 1000 + 2 * k]) for k in range(12)}  # neighbours are similar, the ends are not
    docs = spark.createDataFrame([*texts.items(), (None, texts[0]), (3, texts[3])], "doc_id long, text string")
    want = slow_groups(texts)
    step = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert sorted(x for x in step if x is not None) == sorted(set(want.values())) and step.count(None) == 1


def test_many_alike_texts_in_chunks_of_a_key(spark, monkeypatch):
    """Texts that share most of a passage, below and above the limit, so that keys are large and groups are split."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 4)
    rng, passage = np.random.default_rng(4), WORDS[:80]
    texts = {}
    for i in range(60):
        own = list(passage)
        for at in rng.choice(np.arange(2, 78), int(rng.integers(1, 5)), replace=False):
            own[at] = f"v{int(rng.integers(3))}"
        texts[i] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got, want = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}, slow_groups(texts)
    assert got == want and 1 < len(set(want.values())) < 60


def test_two_texts_under_one_id_do_not_hide_each_other(spark):
    a, b = " ".join(WORDS[:50]), " ".join(WORDS[50:100])
    docs = spark.createDataFrame([(5, a, 1), (5, b, 2), (6, a, 3), (5, a, 4)], "doc_id long, text string, row int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(5, a), (5, b)])


def test_shingle_rule_recall_on_documents(spark):
    """All groups of sf0.01 equal those of brute force over pairs that share a shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()} == slow_groups(texts)
