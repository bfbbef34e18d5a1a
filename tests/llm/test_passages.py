"""The passage classifier: gradients, held-out accuracy, odd rows."""

import math
import random
import zlib

import numpy as np

from palisade.llm.passages import WIDTH, Attention, bags, encode, quality_scores, train


def test_gradients():
    rng = np.random.default_rng(0)
    model = Attention(7, rng)
    x, first, y = rng.normal(size=(12, 7)), np.array([0, 3, 4, 9]), np.array([0.0, 1, 1, 0])
    weight = np.array([1.0, 2, 1, 3])

    def loss():
        s = model.score(x, first)
        return float(-(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / weight.sum())

    got = model._gradients(model._forward(x, first), y, weight)
    for k, p in model.p.items():
        for at in np.ndindex(p.shape):
            keep = p[at]
            p[at] = keep + 1e-6
            up = loss()
            p[at] = keep - 1e-6
            down = loss()
            p[at] = keep
            assert abs((up - down) / 2e-6 - got[k][at]) < 1e-5, (k, at)


def test_encode():
    assert encode(b"").shape == encode(b" \n").shape == encode(b"one").shape
    assert len(encode(b"w " * 129)) == 3
    assert np.isfinite(encode("é日本 \x00 ".encode() * 500)).all()


def corpus(n=500):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("abcdeilnorstu", k=rng.randrange(2, 9))) for _ in range(rng.randrange(20, 300))]
        bad = rng.random() < 0.3
        if bad:  # only a part of the document is junk
            a = rng.randrange(len(words) // 2 + 1)
            words[a : a + len(words) // 2 + 8] = [w.upper() + "!!" for w in words[a : a + len(words) // 2 + 8]]
        docs.append((i, " ".join(words)))
        labels.append((i, int(not bad)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    truth = dict(labels)
    taught = [(d, q if zlib.crc32(str(d).encode()) % 3 != 1 else 1 - q) for d, q in labels]  # lies in the held-out fold teach nothing
    d = spark.createDataFrame([(*r, "en") for r in docs], "doc_id long, text string, label string")
    got = quality_scores(d, spark.createDataFrame(taught, "doc_id long, quality int")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    again = quality_scores(d.repartition(3), spark.createDataFrame(taught, "doc_id long, quality int")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "x" * 200_000), (3, "x" * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 5)], "doc_id long, quality int")
    got = quality_scores(docs, labels).collect()
    assert len(got) == 5 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    assert quality_scores(docs.limit(0), labels).count() == 0


def test_score_by_single_passages(spark):
    """The score from the formulas, one passage and one unit at a time."""
    docs, labels = corpus(60)
    model = train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    p = model.p
    for _, text in docs[:12]:
        x = encode(text.encode())
        hidden, weight = [], []
        for row in x:
            h = [math.tanh(sum((float(row[i]) - float(model.mean[i])) / float(model.scale[i]) * p["E"][i, j] for i in range(WIDTH)) + p["e"][j]) for j in range(len(p["e"]))]
            gate = [math.tanh(sum(h[j] * p["V"][j, k] for j in range(len(h)))) / (1 + math.exp(-sum(h[j] * p["U"][j, k] for j in range(len(h))))) for k in range(len(p["w"]))]
            hidden.append(h)
            weight.append(math.exp(sum(g * w for g, w in zip(gate, p["w"], strict=True))))
        z = [sum(w * h[j] for w, h in zip(weight, hidden, strict=True)) / sum(weight) for j in range(len(p["c"]))]
        want = 1 / (1 + math.exp(-sum(a * c for a, c in zip(z, p["c"], strict=True)) - p["b"][0]))
        assert abs(model.score(x, np.zeros(1, np.int64))[0] - want) < 1e-5


def test_sample_is_whole_documents(spark):
    docs, labels = corpus(200)
    docs.append((1000, "long " * 6400))
    labels.append((1000, 1))
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    size = dict((i, len(encode(t.encode()))) for i, t in docs)
    every = bags(d, q, 10_000, 3)
    assert set(every["id"]) == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 != 1}
    assert all(len(b) == size[i] * WIDTH * 4 for i, b in zip(every["id"], every["bag"], strict=True))
    few = bags(d, q, 10_000, 3, passages=50)
    assert all(few[few["label"] == k]["id"].map(size).sum() <= 50 for k in (0, 1)) and set(few["id"]) < set(every["id"])
