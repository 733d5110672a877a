import math
import zlib

import numpy as np

from wayfowl.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def test_toxicity_held_out_accuracy(spark):
    got = toxicity.op9_toxicity(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    both = got[got.held_out].merge(labels, on="doc_id")
    assert (both.predicted == both.toxic).mean() >= 0.93


def test_toxicity_reads_unseen_spellings():
    rng = np.random.default_rng(0)
    plain = ["river", "stone", "walking", "house", "green", "letter", "winter", "paper", "garden", "music"]
    texts, y = [], []
    for i in range(300):
        words = list(rng.choice(plain, 60))
        if i % 3 == 0:
            words[int(rng.integers(60))] = ["grumbold", "grumbolds", "Grumbold!"][i % 9 // 3]
        texts.append(" ".join(words).encode())
        y.append(int(i % 3 == 0))
    model = toxicity.fit(texts, np.array(y), np.ones(300), 1 / 3)
    assert model.score(b"river stone grumbolt house " + b"paper " * 500) > 0.5 > model.score(b"river stone house " + b"paper " * 500)


def test_quality_held_out_accuracy(spark):
    got = quality.op7_quality(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    both = got[got.held_out].merge(labels, on="doc_id")
    assert (both.predicted == both.quality).mean() >= 0.95


def test_quality_learns_without_negatives():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (3000, len(quality.FEATURES))), rng.normal(4, 1, (700, len(quality.FEATURES)))
    model = quality.fit(good[:800], np.concatenate([good[800:2800], bad[:500]]), 0.8)
    assert (model.predict(good[2800:]) > 0.5).mean() > 0.97 and (model.predict(bad[500:]) < 0.5).mean() > 0.97


def slow_quality_step(positive, unlabelled, prior):
    """Features, knots and one step of the non-negative risk, number by number."""
    n, rows = len(quality.FEATURES), np.concatenate([positive, unlabelled])
    knots = [[float(np.quantile(rows[:, f], q)) for q in quality.KNOTS] for f in range(n)]
    expand = lambda x: list(x) + [max(0.0, x[f] - k) for f in range(n) for k in knots[f]]
    wide = [expand(x) for x in rows]
    scale = [max(abs(r[c]) for r in wide) or 1.0 for c in range(len(wide[0]))]
    p, u = ([[a / b for a, b in zip(expand(x), scale)] for x in part] for part in (positive, unlabelled))
    # At weights of zero every probability is a half, and both losses are log 2.
    assert (1 - prior) * math.log(2) >= 0
    grad = []
    for c in range(len(scale) + 1):
        mean = lambda part: sum(1.0 if c == len(scale) else r[c] for r in part) / len(part)
        grad.append(-0.5 * prior * mean(p) + 0.5 * mean(u) - 0.5 * prior * mean(p))
    step = [0.2 * (1 - 1 / 2) * g / (abs(g) + 1e-12) for g in grad]  # Adam's first step
    return knots, scale, [-x for x in step[:-1]], -step[-1]


def test_quality_equals_the_formulas_written_out():
    rng = np.random.default_rng(3)
    pos, unl = rng.normal(1, 1, (9, len(quality.FEATURES))), rng.normal(0, 2, (14, len(quality.FEATURES)))
    model = quality.fit(pos, unl, 0.3, epochs=1)
    knots, scale, weights, bias = slow_quality_step(pos, unl, 0.3)
    assert np.allclose(model.knots, knots) and np.allclose(model.scale, scale) and np.allclose(model.weights, weights) and np.isclose(model.bias, bias)
    text = "A Title | x\n\nSome words, some words. 123 !!\nSome words, some words. 123 !!\nÉnd"
    words, raw = text.split(), text.encode()
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda f: sum(f(b) for b in raw) / len(raw)
    of_words = lambda f: sum(map(f, words)) / len(words)
    want = {
        "log_bytes": math.log(1 + len(raw)), "upper": share(lambda b: 65 <= b <= 90), "pipes": share(lambda b: b == 124), "shouts": share(lambda b: b == 33), "digits": share(lambda b: 48 <= b <= 57), "stops": share(lambda b: chr(b) in ".,;:?'\"-()"), "high": share(lambda b: b > 127),
        "symbols": share(lambda b: 33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:?'\"-()|!"), "distinct_words": len(set(words)) / len(words), "same_neighbour": sum(a == b for a, b in zip(words, words[1:])) / len(words), "commonest_word": max(map(words.count, words)) / len(words),
        "mean_word": of_words(lambda w: len(w.encode())), "long_words": of_words(lambda w: len(w) > 20), "words_per_line": len(words) / len(lines), "distinct_lines": len(set(lines)) / len(lines), "ends_with_stop": 0.0, "log_words": math.log(1 + len(words)), "upper_words": of_words(lambda w: w.encode().isupper()),
        "short_words": of_words(lambda w: len(w.encode()) < 3), "capital_starts": of_words(lambda w: w.encode().istitle()),
    }
    x = quality.features(raw)
    assert np.allclose(x, [want[f] for f in quality.FEATURES])
    wide = x + [max(0.0, x[f] - k) for f in range(len(x)) for k in knots[f]]
    assert np.isclose(model.score(raw), 1 / (1 + math.exp(-max(-30, min(30, sum(a / b * c for a, b, c in zip(wide, scale, weights)) + bias)))))


def slow_bag(word):
    """Numbers of a word's n-grams and of the word, in any order."""
    text = word.strip("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())).lower()
    if not text:
        return []
    text, out = f"<{text}>", []
    for n in (3, 4, 5):
        for i in range(len(text) - n + 1):
            h = 0
            for c in text[i : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
            out.append((h * 0xD6E8FEB86659FD93 % 2**64 >> 32) % toxicity.BUCKETS)
    return sorted([*out, zlib.crc32(text.encode(), 1) % toxicity.BUCKETS])


def test_toxicity_equals_the_formulas_written_out():
    words = ["Hello", "x", "...", "(naïve)", "a-b", "日本語", "İzmir!", "w" * 90]
    ids, sizes = toxicity.bags([w.encode() for w in words])
    assert [sorted(p.tolist()) for p in np.split(ids, np.cumsum(sizes)[:-1])] == [slow_bag(w) for w in words]
    rng = np.random.default_rng(2)
    model = toxicity.ToxicityModel(rng.normal(size=toxicity.BUCKETS), rng.normal(size=toxicity.BUCKETS), -1.5, 0.2)

    def mean(values, word):
        return sum(values[i] for i in slow_bag(word)) / len(slow_bag(word))

    def score(words):
        found = [w for w in words if slow_bag(w)]
        total = sum(math.exp(mean(model.gates, w)) for w in found)
        z = sum(math.exp(mean(model.gates, w)) * mean(model.logits, w) for w in found) / total - 1.5
        return 1 / (1 + math.exp(-z))

    for text in ["Hello x ...", " ".join(words * 3), "(naïve)"]:
        assert np.isclose(model.score(text.encode()), score(text.split()))
    many = [words[i] for i in rng.integers(len(words), size=toxicity.WINDOW + 1)]
    assert np.isclose(model.score(" ".join(many).encode()), max(score(many[: toxicity.WINDOW // 2]), score(many[toxicity.WINDOW // 2 :])))
    assert all(np.diff(np.append(toxicity.windows(n), n)).max() <= toxicity.WINDOW for n in (1, 511, 512, 513, 5000))
    assert model.score(b"") == model.score(b"... !!") == 0


def test_first_steps_of_toxicity_equal_the_formulas_written_out():
    """Adam's first step has the size of the rate, against the sign of the gradient, which is taken by differences here."""
    texts, y = ["bad word here", "good word there", "word word ...", ""], [1, 0, 0, 1]
    encoded = [t.encode() for t in texts]
    models = [toxicity.fit(encoded, np.array(y), np.ones(4), 0.3, epochs=1, fill=0)]
    rng = np.random.default_rng(9)
    emb, soft = rng.normal(0, 0.1, (toxicity.BUCKETS, toxicity.DIM)), rng.normal(0, 0.5, (2, toxicity.DIM))
    gates, bias, across = np.zeros(toxicity.BUCKETS), math.log(0.3 / 0.7), soft[1] - soft[0]

    def loss(v, gates, bias):
        out = 0.0
        for text, label in zip(texts[:3], y):
            bags = [b for b in map(slow_bag, text.split()) if b]
            of = [math.exp(sum(gates[i] for i in b) / len(b)) for b in bags]
            z = sum(a * sum(v[i] for i in b) / len(b) for a, b in zip(of, bags)) / sum(of) + bias
            out += (math.log(1 + math.exp(z)) - label * z) / 4
        return out

    v, h, d_v = emb @ across, 1e-5, {}
    start = loss(v, gates, bias)
    assert np.isclose(models[0].bias, bias - toxicity.RATE / 2 * np.sign(loss(v, gates, bias + h) - start))
    for i in {i for t in texts for w in t.split() for i in slow_bag(w)}:
        up = np.zeros(toxicity.BUCKETS)
        up[i] = h
        d_v[i] = (loss(v + up, gates, bias) - loss(v - up, gates, bias)) / (2 * h)
        d_gate = (loss(v, gates + up, bias) - loss(v, gates - up, bias)) / (2 * h)
        if abs(d_gate) > 1e-7:
            assert np.isclose(models[0].gates[i], -toxicity.GATE_RATE / 2 * np.sign(d_gate), rtol=1e-3)
    d_across = sum(emb[i] * d for i, d in d_v.items())
    after = soft - toxicity.RATE / 2 * np.sign(np.stack([-d_across, d_across]) + 1e-6 * soft)
    for i, d in d_v.items():
        assert np.isclose(models[0].logits[i], (emb[i] - toxicity.RATE / 2 * np.sign(d * across + toxicity.DECAY * emb[i])) @ (after[1] - after[0]), atol=1e-6)


def test_filled_texts():
    texts = [b"a b", b"", b"c d e", b"x " * 9]
    got, of = toxicity.filled(texts, np.array([1, 0, 0, 0]), 6)
    assert of.tolist() == [0, 2] and [len(t.split()) for t in got] == [6, 6]
    assert got[0].startswith(b"a b ") and got[1].startswith(b"c d e ") and not set(got[0].split()[2:]) & {b"a", b"b"}
    assert toxicity.filled([b"a"], np.array([1]))[0] == []


def test_toxicity_does_not_depend_on_length(spark):
    """Held-out texts among 30 harmless ones are found, and those alone flag nearly none."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = docs.join(labels, "doc_id").where("pmod(crc32(CAST(doc_id AS STRING)), 5) = 0 AND toxic IS NOT NULL").orderBy("doc_id").collect()
    bad, good = ([(r.text or "").encode() for r in rows if r.toxic == y] for y in (1, 0))
    rng = np.random.default_rng(3)
    crowd = [[good[i] for i in rng.integers(len(good), size=30)] for _ in bad]
    calm = [[t for t in c if model.score(t) < 0.5] for c in crowd]
    assert (model.scores(bad) >= 0.5).mean() > 0.88 and (model.scores(good) >= 0.5).mean() < 0.01
    assert (model.scores([b"\n".join([*c[:15], t, *c[15:]]) for t, c in zip(bad, calm)]) >= 0.5).mean() > 0.8
    assert (model.scores([b"\n".join(c) for c in calm]) >= 0.5).mean() < 0.03


def test_toxicity_of_labelled_texts_without_words():
    model = toxicity.fit([b"", b"..."], np.array([0, 1]), np.ones(2), 0.5)
    assert model.scores([b"", b"some words"]).tolist()[0] == 0


def test_a_labelled_text_that_is_too_long_teaches_nothing_but_hides_no_other(spark):
    docs = spark.createDataFrame([(i, ("vile scum " if i % 2 else "kind words ") * 20) for i in range(40)] + [(1000 + i, "vile " * 200_000) for i in range(3)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic").where("doc_id < 1000").unionByName(spark.createDataFrame([(1000 + i, 1) for i in range(3)], "doc_id long, toxic int"))
    texts, y, _ = toxicity.labelled_sample(docs, labels, "toxic", max_bytes=20_000)
    assert len(set(y.tolist())) == 2 and max(map(len, texts)) < 20_000 // 16


def test_quality_reaches_the_least_risk_of_all_rows_whatever_the_start(spark):
    rng = np.random.default_rng(6)
    n = len(quality.FEATURES)
    x = np.concatenate([rng.normal(0, 1, (900, n)), rng.normal(1.5, 1, (300, n))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, x array<double>")
    trusted = spark.createDataFrame([(i,) for i in range(0, 900, 3)], "doc_id long")
    models = [quality.fit_rows(rows, trusted, 0.6, start, 40) for start in (600, 1200)]
    for m in models:
        p, u = m.expand(x[:900:3]), m.expand(x)
        g = u.T @ (1 / (1 + np.exp(-(u @ m.weights + m.bias)))) / 1200 - 0.6 * p.mean(axis=0) + quality.DECAY * m.weights
        assert np.abs(g).max() < 5e-3
    a, b = (m.predict(x) for m in models)
    assert np.abs(a - b).mean() < 0.02 and ((a > 0.5) == (b > 0.5)).mean() > 0.97


def test_repeated_ids_come_to_the_driver_once(spark):
    docs = spark.createDataFrame([(i % 3, f"some text {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    assert quality.scores(docs, quality.train(docs, labels, held_out=(5, 9))).count() == 300


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "a b", 5), (2, "", 5), (2, "", 5), (3, "Z " * 60_000, None)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labelled in (labels, labels.limit(0)):
        for module, filtered in ((toxicity, toxicity.without_toxic), (quality, quality.only_good)):
            model = module.train(docs, labelled)
            found = module.scores(docs, model).collect()
            assert sorted((r.doc_id or 0) for r in found) == [0, 1, 2, 2, 3] and all(0 <= r.score <= 1 for r in found)
            assert module.scores(docs.limit(0), model).count() == 0
            assert filtered(docs, labelled).columns == docs.columns
