import duckdb
import numpy as np

from wayfowl.llm import minhash
from wayfowl.llm.simhash import shingle_hashes

SF = "/root/testdata/sf0.01"


def shingles(text, n=3):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def slow_groups(rows):
    """(doc_id, size, component) of each row, by all pairs."""
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group, strict=True):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return [(d, len(s), least.get(g) if s else d) for (d, _), s, g in zip(rows, sets, group, strict=True)]


def found(spark, rows, **params):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, minhash.near_duplicates(df, **params).collect()), key=str)


def test_every_coordinate_is_filled_and_estimates_similarity():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 100, 5000):
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        assert (minhash.sketch(x) < 2**63).all() and (minhash.sketch(rng.permutation(x)) == minhash.sketch(x)).all()
    assert (minhash.sketch(np.zeros(0, np.uint64)) == 2**64 - 1).all()
    for n, shared in ((20, 17), (200, 150), (3000, 1000)):
        agree = []
        for _ in range(200):
            x = rng.integers(0, 2**63, 2 * n - shared).astype(np.uint64)
            agree.append((minhash.sketch(x[:n]) == minhash.sketch(x[n - shared :])).mean())
        share = shared / (2 * n - shared)
        assert abs(np.mean(agree) - share) < 0.012 and np.std(agree) < 1.15 * np.sqrt(share * (1 - share) / minhash.COORDINATES)


def test_rounds_one_by_one_give_the_same(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 3, 50, 900, 9000)]
    want = [minhash.sketch(x) for x in sets]
    monkeypatch.setattr(minhash, "AT_ONCE", 500)
    assert all((minhash.sketch(x) == w).all() for x, w in zip(sets, want, strict=True))


def test_query_equals_sql_and_brute_force(spark):
    got = sorted(map(tuple, minhash.op12_minhash_near_duplicates(spark, SF).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == sorted(con.execute(minhash.ORACLE_SQL).fetchall())
    assert len({r[2] for r in got}) < len(got)
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert found(spark, [tuple(r) for r in small.collect()]) == sorted(slow_groups([tuple(r) for r in small.collect()]), key=str)


WORDS = [f"w{i}" for i in range(5000)]


def chains(rng, groups=8, steps=25, words=160):
    """Texts in which each differs a little from the one before, so that ends of a chain are far apart."""
    rows = []
    for g in range(groups):
        own = rng.choice(WORDS, words).tolist()
        for _ in range(steps):
            for at in rng.choice(words, 3, replace=False):
                own[at] = str(rng.choice(WORDS))
            rows.append((len(rows), " ".join(own)))
    return rows


def test_chains_are_one_group(spark):
    rows = chains(np.random.default_rng(2))
    assert found(spark, rows) == sorted(slow_groups(rows), key=str)


def test_dense_keys_in_small_blocks(spark, monkeypatch):
    """One passage in all texts, so that they share keys above and below the limit; blocks are cut and sets meet in them."""
    for name, value in (("BLOCK_ROWS", 16), ("DENSE", 0), ("HOT_LEAST", 5), ("HOT_KEYS", 50)):
        monkeypatch.setattr(minhash, name, value)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(90):
        own = WORDS[:100]
        for at in rng.choice(np.arange(2, 98), int(rng.integers(1, 5)), replace=False):
            own[at] = f"v{int(rng.integers(4))}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, rows[i % 3][1].upper()) for i in range(60)]
    want = sorted(slow_groups(rows), key=str)
    assert found(spark, rows) == want and 1 < len({r[2] for r in want}) < 60


def test_the_limit_itself(spark):
    """17 of 20 shingles shared is a link, 16 of 19 is none; sizes at the limit are compared too."""
    base = WORDS[:19]  # 17 shingles
    rows = [(5, " ".join(base)), (3, " ".join([*base, "x", "y", "z"])), (9, " ".join(WORDS[100:118])), (7, " ".join([*WORDS[100:118], "x", "y", "z"]))]
    want = slow_groups(rows)
    assert [w[2] for w in want] == [3, 3, 9, 7] and found(spark, rows) == sorted(want, key=str)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "A b"), (5, "a  B"), (6, "a"), (None, "a b"), (None, "lone row without id"), (8, "x y z"), (8, "x y z"), (8, "other words here"), (7, "X y z"), (10, "long " * 40_000), (11, "Long " * 50_000)]
    assert found(spark, rows) == sorted(slow_groups(rows), key=str)
    df = spark.createDataFrame(rows[:6], "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS node", "3 AS n")
    assert minhash.near_duplicates(df).count() == 6 and minhash.near_duplicates(df.limit(0)).count() == 0


def test_shingles_are_those_of_the_contract():
    assert len(shingle_hashes("É\x0bx a".encode(), 3)) == 1 and len(shingle_hashes(b"a b", 3)) == 1 and not len(shingle_hashes(b" \r\n", 3))
