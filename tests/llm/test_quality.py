"""Attention-based quality scores: gradients, held-out accuracy, defined scores for every row."""

import random
import zlib

import numpy as np

from stormrail.llm import quality as q


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    width = q.KINDS + 6
    m = {"encode": rng.normal(0, .3, (width, q.HIDDEN)), "encode0": rng.normal(0, .3, q.HIDDEN),
         "value": rng.normal(0, .3, (q.HIDDEN, q.ATTENTION)), "gate": rng.normal(0, .3, (q.HIDDEN, q.ATTENTION)),
         "weigh": rng.normal(0, .3, q.ATTENTION), "out": rng.normal(0, .3, q.HIDDEN), "out0": np.zeros(1)}
    x, first, y = rng.normal(size=(9, width)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])

    def loss(m):
        p = q._forward(m, x, first)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, g in q._gradients(m, x, first, y).items():
        at = tuple(rng.integers(0, s) for s in m[k].shape)
        up, down = ({**m, k: m[k].copy()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - g[at]) < 1e-6, k


def corpus(n=500):
    rng = random.Random(2)
    good = ["the", "river", "was", "cold", "and", "she", "walked", "home,", "slowly."]
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = [rng.choice(good) for _ in range(rng.randint(5, 300))]
        if bad:
            words = rng.choice([[w.upper() + "!!" for w in words], [words[0]] * len(words), [w + "$$$" for w in words]])
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad)))
    return rows, labels


def test_held_out_accuracy(spark, make_docs):
    rows, labels = corpus()
    docs, marks = make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int")
    model = q.train(docs, marks)
    got = q.scored(docs, model).collect()
    truth = dict(labels)
    out = [r for r in got if r.held_out]
    assert {r.doc for r in out} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([(r.score >= 0.5) == truth[r.doc] for r in out]) > 0.97
    again = q.scored(make_docs(rows, 5), q.train(make_docs(rows, 5), marks)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    kept = q.accepted(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc for r in got if r.score >= 0.5}


def test_held_out_labels_are_never_used(spark, make_docs):
    rows, labels = corpus(200)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    a, b = (q.scored(make_docs(rows), q.train(make_docs(rows), spark.createDataFrame(x, "doc_id long, quality int")))
            for x in (labels, flipped))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_edges(spark, make_docs):
    rows, labels = corpus(60)
    rows += [(900, None), (901, ""), (902, " \n"), (None, "no id"), (903, "x" * 200_000), (904, "y " * 50_000), (5, rows[5][1])]
    marks = spark.createDataFrame(labels + [(5, None), (7, 0), (7, 1), (None, 1)], "doc_id long, quality int")
    got = q.scored(make_docs(rows), q.train(make_docs(rows), marks)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc in (900, 901, 902)}) == 1
    none = q.train(make_docs(rows), marks.limit(0))
    assert {r.score for r in q.scored(make_docs(rows), none).collect()} == {0.5}
    ones = q.train(make_docs(rows), marks.filter("quality = 1"))
    assert all(r.score > 0.9 for r in q.scored(make_docs(rows), ones).collect())
    assert q.scored(make_docs([]), none).count() == 0


def test_the_fit_sees_a_bounded_number_of_passages_of_a_long_text(spark, monkeypatch):
    """Passages spread over the whole of each text come to the driver, and no more than the bound."""
    seen = []
    monkeypatch.setattr(q, "fit", lambda bags, labels: seen.extend(bags))
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(n))) for i, n in ((3, 64 * 1000), (4, 100), (6, 0))],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (4, 0), (6, 0)], "doc_id long, quality int")
    q.train(docs, labels)
    trained = [i for i in (3, 4, 6) if zlib.crc32(str(i).encode()) % 3 != 1]
    want = {3: q.TRAINING_PASSAGES, 4: 2, 6: 1}
    assert sorted(len(b) for b in seen) == sorted(want[i] for i in trained)
