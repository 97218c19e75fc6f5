"""Decontamination: alignment against the plain recurrence, planted copies found, clean documents left alone."""

import random

import numpy as np
import pytest

from stormrail.llm import decontaminate as d


def plain_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (d.MATCH if a[i - 1] == b[j - 1] else -d.MISMATCH),
                          h[i - 1][j] - d.GAP, h[i][j - 1] - d.GAP)
    return max(max(r) for r in h) / (d.MATCH * len(a))


def test_alignment_equals_the_recurrence():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randint(0, 4) for _ in range(rng.randint(1, 12))]
        b = [rng.randint(0, 4) for _ in range(rng.randint(1, 20))]
        got = d.align(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64))[0]
        assert got == pytest.approx(plain_alignment(a, b))


def planted(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(800)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.randint(12, 50))) for i in range(30)]
    rows, truth = [], set()
    for k in range(200):
        body = text(rng.randint(0, 200))
        if k % 2:
            i, words = rng.choice(items)
            copy = list(words)
            if k % 4 == 1:  # edited: some words changed, one lost, one added
                for _ in range(max(1, len(copy) // 10)):
                    copy[rng.randrange(len(copy))] = "changed"
                copy.pop(len(copy) // 2)
                copy.insert(3, "added")
            at = rng.randint(0, len(body))
            body[at:at] = [copy[0].upper() + ","] + copy[1:]
            truth.add((k, i))
        rows.append((k, " ".join(body)))
    return rows, [(i, " ".join(w).capitalize() + ".") for i, w in items], truth


def test_planted_copies(spark, make_docs):
    rows, items, truth = planted()
    rows += [(1000, None), (1001, ""), (None, items[0][1]), (1002, items[0][1]), (1002, items[0][1]),
             (1003, "z " * 30_000 + items[1][1])]
    bench = spark.createDataFrame(items + [(900, None), (901, ""), (902, "w1"), (None, items[2][1])], "item_id long, text string")
    got = d.contaminated(make_docs(rows), bench).collect()
    pairs = {(r.doc, r.item) for r in got}
    assert truth <= pairs
    extra = {p for p in pairs if p[0] is not None and p[0] < 1000} - truth
    assert all(p[1] is None for p in extra)  # the item without an id is a copy of another
    assert sum(r.doc == 1002 and r.item == 0 for r in got) == 2 and (1003, 1) in pairs and (None, 0) in pairs
    left = d.clean(make_docs(rows), bench)
    assert left.columns == make_docs(rows).columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(
        [k for k, _ in rows if k is not None and k < 1000 and k not in {t for t, _ in truth}] + [1000, 1001])


def test_item_in_most_documents_is_found(spark, make_docs):
    rows, items, _ = planted(5)
    rows = [(k, t + " " + items[7][1]) for k, t in rows]
    got = d.contaminated(make_docs(rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc for r in got.filter("item = 7").collect()} == {k for k, _ in rows}


def test_blocks_and_empty_tables(spark, make_docs, monkeypatch):
    rows, items, truth = planted(6)
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(str, d.contaminated(make_docs(rows), bench).collect()))
    monkeypatch.setattr(d, "BLOCK_BYTES", 3000)
    assert sorted(map(str, d.contaminated(make_docs(rows), bench).collect())) == one
    assert d.contaminated(make_docs([]), bench).count() == 0
    assert d.contaminated(make_docs(rows), bench.limit(0)).count() == 0
    assert d.clean(make_docs(rows), bench.limit(0)).count() == len(rows)
