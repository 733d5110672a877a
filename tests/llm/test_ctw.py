import math
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pytest

from wayfowl.llm import ctw

SF = "/root/testdata/sf0.001"


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def stream(text):
    return b" ".join([*(text or "").encode().lower().split(), b"\n"])


class SlowTree:
    """Context-tree weighting written out node by node: counts by (context, bits so far)."""

    def __init__(self, texts, depth):
        self.depth, self.nodes, self.kids, self.memo = depth, {}, {}, {}
        for text in texts:
            data = b" " * depth + stream(text)
            for at in range(depth, len(data)):
                for d in range(depth + 1):
                    for i in range(8):
                        key = (data[at - d : at], data[at] >> (8 - i) | 1 << i)
                        self.nodes.setdefault(key, [0, 0])[data[at] >> (7 - i) & 1] += 1
        for ctx, bits in self.nodes:
            if ctx:
                self.kids.setdefault((ctx[1:], bits), []).append((ctx, bits))

    @staticmethod
    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, key):
        if key not in self.memo:
            own = self.kt(*self.nodes[key])
            self.memo[key] = np.logaddexp(own, sum(map(self.weighted, self.kids[key]))) - math.log(2) if key in self.kids else own
        return self.memo[key]

    def chance(self, past, bits):
        """Of a one: from the deepest known node up."""
        p = None
        for d in range(self.depth, -1, -1):
            key = (past[len(past) - d :], bits)
            if key in self.nodes:
                own = (self.nodes[key][1] + 0.5) / (sum(self.nodes[key]) + 1)
                stay = math.exp(self.kt(*self.nodes[key]) - math.log(2) - self.weighted(key)) if key in self.kids else 1.0
                p = own if p is None else stay * own + (1 - stay) * p
        return 0.5 if p is None else p

    def log10(self, text):
        data, out = b" " * self.depth + stream(text), 0.0
        for at in range(self.depth, len(data)):
            for i in range(8):
                p = self.chance(data[at - self.depth : at], data[at] >> (8 - i) | 1 << i)
                out += math.log10(p if data[at] >> (7 - i) & 1 else 1 - p)
        return out


TEXTS = ["the other then", "The  bathe\nthe other", "é the é", None, "", "a the a the", "then bathe", "the the the the the"]


def test_slices_give_the_same_keys(monkeypatch):
    words = [(t or "").encode().lower().split() for t in TEXTS]
    want = sorted(chain.from_iterable(zip(o.tolist(), k.tolist(), strict=True) for k, o in ctw.pair_keys(words, 4)))
    assert len(want) == sum(len(stream(t)) for t in TEXTS)
    for size in (1, 5, 16):
        monkeypatch.setattr(ctw, "GROUP_BYTES", size)
        parts = list(ctw.pair_keys(words, 4))
        assert len(parts) > 1 and sorted(chain.from_iterable(zip(o.tolist(), k.tolist(), strict=True) for k, o in parts)) == want


@pytest.mark.parametrize(("depth", "hot"), [(0, 100), (2, 0), (3, 5), (5, 0), (6, 1000)])
def test_scores_equal_the_slow_tree(spark, depth, hot):
    """Also with all words and pairs looked up by the shuffle."""
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(24)] + [(60, "zebra theother, the ñé then"), (61, "bath " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(held(i) for i, _ in rows) > 2
    tree = SlowTree([t for i, t in rows if not held(i)], depth)
    got = {r.doc_id: r for r in ctw.score_documents(docs, max_depth=depth, hot_words=hot, hot_pairs=hot).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        assert got[i].score == pytest.approx(tree.log10(text), rel=1e-9)
        assert got[i].n_bytes == len(stream(text)) and got[i].bits_per_byte == pytest.approx(-got[i].score / math.log10(2) / len(stream(text)))


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    pairs, n = ctw.summed(rng.integers(97, 101, 4000).astype(np.uint64) << np.uint64(8) | rng.integers(97, 103, 4000).astype(np.uint64), np.ones(4000, np.int64))
    for ctx in (97, 99, 122):
        every = np.arange(256, dtype=np.uint64) | np.uint64(ctx << 8)
        both = np.union1d(pairs, every)
        times = np.where(np.isin(both, pairs), n[np.minimum(np.searchsorted(pairs, both), len(pairs) - 1)], 0)
        levels, place, bit = ctw.subtrees(both, times, 1, 0)
        logs = ctw.pair_logs(levels, place, bit, np.zeros(len(levels[-1].nodes)), np.ones(len(levels[-1].nodes)), np.full(len(levels[-1].nodes), 0.5))
        assert np.exp(logs[np.searchsorted(both, every)]).sum() == pytest.approx(1, rel=1e-9)


def test_lookup_finds_what_is_there():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000, np.uint64))
    rng.shuffle(keys)
    keys = np.concatenate([[0], keys]).astype(np.uint64)
    for tables in (1, 3):
        table = ctw.Lookup(keys, rng.integers(0, 9, len(keys)).astype(np.int16), {"v": np.arange(len(keys))}, tables)
        asked = np.concatenate([keys, rng.integers(0, 2**63, 3000, np.uint64)])
        known = {k: i for i, k in enumerate(keys.tolist())}
        assert [-1 if i < 0 else table.values["v"][i] for i in table.find(asked)] == [known.get(k, -1) for k in asked.tolist()]
    assert (ctw.Lookup(keys[:0], np.zeros(0, np.int16), {}).find(keys) == -1).all()


def test_large_counts_meet_small_ones():
    a, b = np.array([0.0, 3.0, 5e3, 2e4, 1e7]), np.array([0.0, 9.0, 16e3, 1.0, 3e6])
    assert ctw.own_log(a, b) == pytest.approx([SlowTree.kt(x, y) for x, y in zip(a, b, strict=True)], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("hot", [50, 1 << 19])
def test_query_against_brute_force(spark, hot):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    tokens = {r.doc_id: r.text.encode().lower().split() for r in docs}
    counts = Counter()
    for i, words in tokens.items():
        if not held(i):
            counts.update([*words, b""])
    n, v = sum(counts.values()), len(counts)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in (ctw.op5_context_tree_scores(spark, SF) if hot > 50 else ctw.score_documents(table, hot_words=hot, hot_pairs=hot)).collect()}
    assert len(got) == len(docs)
    for i, words in tokens.items():
        r, own = got[i], [*words, b""]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
        assert r.score < 0


def test_the_model_beats_its_base_on_held_out_texts(spark):
    got = ctw.op5_context_tree_scores(spark, "/root/testdata/sf0.1").where("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"] + 0.2 * got["sum(n_tokens)"]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "a b", 5), (2, "", 5), (2, "", 5), (3, "zz " * 60_000 + "y" * 9000, None)], "doc_id long, text string, score int")
    got = sorted(((r.doc_id or 0), r.n_tokens) for r in ctw.score_documents(docs).collect())
    assert got == [(0, 3), (1, 1), (2, 1), (2, 1), (3, 60_002)]
    assert ctw.score_documents(docs.limit(0)).count() == 0
    only = ctw.score_documents(spark.createDataFrame([(i, "a") for i in range(60) if held(i)], "doc_id long, text string")).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 and r.score == pytest.approx(24 * math.log10(0.5)) for r in only)
