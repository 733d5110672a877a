import math
import re
from collections import Counter

import duckdb
import numpy as np

from wayfowl.llm import lexical

SF = "/root/testdata/sf0.01"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def slow_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow_rank(docs, queries, k=10):
    own = [(d, Counter(t)) for d, text in docs if (t := slow_terms(text))]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    holding = Counter(t for _, c in own for t in c)
    items = {}
    for i, text in queries:
        if i is not None:
            items.setdefault(i, set()).update(slow_terms(text))
    out = {}
    for i, asked in items.items():
        scores = []
        for d, c in own:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            if score > 0 and d is not None:
                scores.append((-score, d))
        if scores:
            out[i] = [(r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def by_item(df):
    out = {}
    for r in df.orderBy("item_id", "rank").collect():
        out.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
    return out


def test_query_equals_sql_and_brute_force(spark):
    got = by_item(lexical.op11_lexical_search(spark, SF))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = {}
    for item, *rest in con.execute(lexical.ORACLE_SQL + " ORDER BY item_id, rank").fetchall():
        want.setdefault(item, []).append(tuple(rest))
    assert got == want
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*c).collect()]
    assert got == slow_rank(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))


def random_rows(rng, n, words=300, longest=40):
    chosen = 1 / np.arange(1, words + 1)
    chosen /= chosen.sum()
    return [(i, " ".join(f"T{w}" for w in rng.choice(words, int(rng.integers(0, longest)), p=chosen))) for i in range(n)]


def test_small_shards_leaves_and_blocks(spark):
    rng = np.random.default_rng(5)
    docs, queries = random_rows(rng, 700), random_rows(rng, 30, longest=12)
    docs += [(1000 + i, docs[3][1]) for i in range(60)]
    want = slow_rank(docs, queries, 7)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    for shard, leaf, block in ((50, 4, 40), (8192, 128, 10**6)):
        assert by_item(lexical.rank(d, q, 7, block, shard, leaf)) == want


def sparse(rng, n_docs, items):
    rows = [np.sort(rng.choice(len(items.group), int(rng.integers(1, 12)), replace=False)) for _ in range(n_docs)]
    start = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    return start, np.concatenate(rows), rng.integers(1, 10**9, start[-1])


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(0)
    items = lexical.Items([(i, f"{i // 5}-{t}".encode()) for i in range(20) for t in rng.choice(30, 6, replace=False)])
    start, columns, values = sparse(rng, 500, items)
    tree = lexical.SparseBalls(start, columns, values, items, 16)
    dense = np.zeros((500, len(items.group)), np.int64)
    dense[np.repeat(np.arange(500), np.diff(start)), columns] = values
    exact = np.array([dense[:, items.terms_of(i)].sum(axis=1) for i in range(20)]).T
    for node in range(len(tree.lo)):
        rows = tree.order[tree.lo[node] : tree.hi[node]]
        assert (exact[rows].max(axis=0) <= tree.bounds[node]).all()
    best = lexical.Best(20, 3)
    scored = lexical.search(np.arange(500), start, columns, values, items, best, 16)
    assert scored < 20 * sum(not k for k in tree.kids)
    for i in range(20):
        want = sorted(((int(s), -d) for d, s in enumerate(exact[:, i]) if s > 0), reverse=True)[:3]
        assert sorted(best.found[i], reverse=True) == want


def test_huge_numbers_stay_exact():
    n = np.array([10**9, 7], np.int64)
    assert lexical.lengths(n, 10**12, 10**15).tolist() == [10 + 90 * int(x) * 10**12 // 10**15 for x in n]


def test_odd_rows(spark):
    docs = [(1, None, 0), (2, "", 0), (3, " -- ", 0), (4, "Ünder_score É 7a", 0), (None, "É é under", 0), (6, "under under É", 0), (6, "under under É", 0), (7, "É " * 60_000 + "z", 0), (8, "\x00zz\x7fZZ", 0)]
    queries = [(1, "É", 5), (1, "zz", 5), (2, None, 5), (3, "", 5), (None, "zz", 5), (4, "Ünder UNDER Z z", 5), (5, "nowhere", 5)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string, n int"), spark.createDataFrame(queries, "item_id long, text string, terms int")
    assert by_item(lexical.rank(d, q)) == slow_rank([r[:2] for r in docs], [r[:2] for r in queries])
    assert lexical.rank(d.limit(0), q).count() == 0 and lexical.rank(d, q.limit(0)).count() == 0
