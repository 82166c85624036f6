from __future__ import annotations

import zlib

import duckdb
import numpy as np

from factloom.llm import catalog, quality, shingles

SMALL = "/root/testdata/sf0.01"


def bag(text: str) -> quality.Bag:
    return quality.bag_of(np.frombuffer(text.encode(), np.uint8))


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)

    def made(passages, words):
        first = np.sort(rng.integers(0, words + 1, passages)).astype(np.int32) if words else np.zeros(passages, np.int32)
        first[0] = 0
        return quality.Bag(rng.normal(size=(passages, quality.N_FEATURES)), rng.integers(0, 5, words).astype(np.uint16), first)

    batch = quality._Batch.of([made(1, 0), made(3, 40), made(5, 90)], np.zeros(quality.N_FEATURES), np.ones(quality.N_FEATURES))
    labels, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    shapes = {"E": (quality.BUCKETS, 16), "W": (quality.N_FEATURES, 16), "b": (16,), "V": (16, 8), "U": (16, 8), "w": (8,), "c": (16,), "d": (1,)}
    p = {k: rng.normal(0, 0.3, s) for k, s in shapes.items()}

    def loss():
        s = quality._forward(p, batch)["score"]
        return float((-(labels * np.log(s) + (1 - labels) * np.log(1 - s)) * weight).mean())

    grads = quality._gradients(p, batch, labels, weight)
    for k in p:
        at = tuple(int(rng.integers(5 if k == "E" and j == 0 else n)) for j, n in enumerate(p[k].shape))
        old = p[k][at]
        p[k][at] = old + 1e-5
        up = loss()
        p[k][at] = old - 1e-5
        down = loss()
        p[k][at] = old
        assert abs((up - down) / 2e-5 - grads[k][at]) < 1e-6, k


def test_features_of_odd_texts(monkeypatch):
    texts = ("", " \n ", "a", "word " * 1000, "é" * 500, "x" * 5000, "A! B# C$ |", "no end", "some words here " * 100 + "y" * 300 + " and more" * 40)
    whole = [bag(t) for t in texts]
    for out in whole:
        assert out.features.shape[1] == quality.N_FEATURES and np.isfinite(out.features).all() and len(out) == len(out.first) >= 1
    # a text that is hashed piece by piece is described as a whole
    monkeypatch.setattr(shingles, "STEP", 100)
    for t, w in zip(texts, whole, strict=True):
        out = bag(t)
        assert np.array_equal(out.features, w.features) and np.array_equal(out.words, w.words) and np.array_equal(out.first, w.first)
        again = quality.Bag.unpack(out.pack())
        assert all(np.array_equal(getattr(again, n), getattr(out, n)) for n in ("features", "words", "first"))


def test_mean_vectors_equal_a_loop():
    rng = np.random.default_rng(4)
    bags = [bag(" ".join(f"w{int(x)}" for x in rng.integers(0, 50, n))) for n in (0, 3, 64, 500)]
    vectors = rng.normal(size=(quality.BUCKETS, 4))
    got = quality._Batch.of(bags, np.zeros(quality.N_FEATURES), np.ones(quality.N_FEATURES)).mean_of(vectors)
    want = []
    for b in bags:
        for lo, hi in zip(b.first, np.append(b.first[1:], len(b.words)), strict=True):
            want.append(vectors[b.words[lo:hi]].mean(axis=0) if hi > lo else np.zeros(4))
    assert np.allclose(got, want)


def test_words_alone_decide():
    """Passages that only differ by their words are told apart."""
    rng = np.random.default_rng(3)
    text = lambda k: " ".join(f"w{k}{int(x):03d}" for x in rng.integers(0, 60, 200))
    bags = [bag(text(k)) for k in (0, 1) for _ in range(80)]
    model = quality.MilModel.fit(bags, np.repeat([1.0, 0.0], 80))
    scores = model.score([bag(text(0)) for _ in range(20)] + [bag(text(1)) for _ in range(20)])
    assert (scores[:20] > 0.5).mean() > 0.9 and (scores[20:] < 0.5).mean() > 0.9


def test_attention_sums_to_one_and_finds_the_bad_passage():
    rng = np.random.default_rng(1)
    good = " ".join(f"w{int(x)}" for x in rng.integers(0, 500, 300))
    bad = "same " * 64
    texts = [" ".join(f"w{int(x)}" for x in rng.integers(0, 500, 300)) for _ in range(60)]
    bags = [bag(t) for t in texts] + [bag(t + " " + bad) for t in texts]
    model = quality.MilModel.fit(bags, np.array([1.0] * 60 + [0.0] * 60))
    a = model.attention(bag(good + " " + bad))
    assert abs(a.sum() - 1) < 1e-9
    assert model.score([bag(good)])[0] > 0.5 > model.score([bag(good + " " + bad)])[0]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (2, "", 0.2), (None, "x y z", 0.3), (5, "w " * 70_000, 0.4)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (99, 1), (5, None)], "doc_id long, quality int")
    assert quality.fit(docs, labels) is None
    assert [r.score for r in quality.score(docs, None).collect()] == [0.5] * 5
    labels = spark.createDataFrame([(2, 1), (5, 0)], "doc_id long, quality int")
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert quality.score(docs.limit(0), None).count() == 0


def test_fitting_sees_every_passage(spark, monkeypatch):
    """A long text is learned with all its passages, so the one that decides is in its bag."""
    text = " ".join(f"w{k * k % 997}" for k in range(20_000)) + " bad" * 64
    docs = spark.createDataFrame([(1, "a short text"), (7, text)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (7, 0)], "doc_id long, quality int")
    seen = {}
    monkeypatch.setattr(quality.MilModel, "fit", lambda bags, target: seen.update(zip(target.tolist(), bags, strict=True)))
    quality.fit(docs, labels)
    want = bag(text)
    assert len(want) > 300 and np.array_equal(seen[0.0].features, want.features) and np.array_equal(seen[0.0].words, want.words)


def test_held_out_accuracy(spark):
    """Labels of the third fold are never learned; balanced accuracy on them is high."""
    labels = dict(duckdb.connect().execute("select doc_id, quality from '/root/testdata/sf0.1/labels.parquet'").fetchall())
    rows = catalog.op2_quality(spark, "/root/testdata/sf0.1").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    test = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    right = [np.mean([p == q for q, p in test if q == kind]) for kind in (0, 1)]
    assert len(test) > 500 and min(right) > 0.95, right


def score_by_loops(model: quality.MilModel, text: str) -> float:
    """The score of a text, passage by passage and word by word."""
    p, sigmoid = model.weights, lambda x: 1 / (1 + np.exp(-x))
    b = bag(text)
    encoded, weights = [], []
    for k in range(len(b)):
        stop = b.first[k + 1] if k + 1 < len(b) else len(b.words)
        words = [p["E"][w].astype(float) for w in b.words[b.first[k] : stop]]
        mean = sum(words) / len(words) if words else np.zeros(quality.HIDDEN)
        x = np.clip((b.features[k] - model.mean) / model.scale, -6, 6)
        h = np.tanh(x @ p["W"] + mean + p["b"])
        encoded.append(h)
        weights.append(np.exp(sum(w * np.tanh(v) * sigmoid(u) for w, v, u in zip(p["w"], h @ p["V"], h @ p["U"], strict=True))))
    z = sum(w * h for w, h in zip(weights, encoded, strict=True)) / sum(weights)
    return float(sigmoid(z @ p["c"] + p["d"][0]))


def test_scores_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = quality.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert abs(r.score - score_by_loops(model, texts[r.doc_id])) < 1e-5


def test_long_texts_do_not_fill_the_driver(spark, monkeypatch):
    """Texts are drawn until the bytes are spent, so the bags gathered stay small; each is whole."""
    monkeypatch.setattr(quality, "TRAIN_BYTES", 200_000)
    gathered = []
    monkeypatch.setattr(quality.MilModel, "fit", classmethod(lambda cls, bags, labels: gathered.append(bags)))
    docs = spark.range(600).selectExpr("id", "concat(repeat(concat('good words ', id, ' '), 400), id % 2) as text")
    labels = spark.range(600).selectExpr("id", "cast(id % 2 as int) as quality")
    quality.fit(docs, labels, "id")
    sizes = [len(b.words) for b in gathered[0]]
    assert 5 < len(sizes) < 60 and min(sizes) > 1_000


def test_of_rows_with_one_id_the_same_text_is_learned_from(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.MilModel, "fit", classmethod(lambda cls, bags, labels: seen.append([b.words.tobytes() for b in bags])))
    rows = [(i, f"text {i} {k}") for i in range(40) for k in range(5)]
    for order in (rows, rows[::-1]):
        quality.fit(spark.createDataFrame(order, "id int, text string").repartition(3), spark.createDataFrame([(i, i % 2) for i in range(40)], "id int, quality int"), "id")
    assert seen[0] == seen[1] and len(seen[0]) > 20


def test_fitting_holds_word_vectors_of_few_passages_at_once(monkeypatch):
    import tracemalloc

    rng, bags = np.random.default_rng(1), []
    for n in rng.integers(0, 6000, 256):
        first = np.arange(0, max(n, 1), quality.PASSAGE).astype(np.int32)
        bags.append(quality.Bag(rng.random((len(first), quality.N_FEATURES)).astype(np.float32), rng.integers(0, quality.BUCKETS, n).astype(np.uint16), first))
    monkeypatch.setattr(quality, "EPOCHS", 1)
    tracemalloc.start()
    quality.MilModel.fit(bags, np.arange(256) % 2.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # a vector of 16 numbers for each word would be 128 bytes; what is held for a word is its passage and its share of one number
    assert peak < 64 * sum(len(b.words) for b in bags)
