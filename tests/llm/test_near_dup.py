"""Near-duplicates against brute force: all pairs of whole shingle sets."""

import random
import re

import numpy as np
import pytest

from stormrail.llm import near_dup
from stormrail.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def shingles(t):
    w = WORD.findall(lower(t))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                inter = len(sets[i] & sets[j])
                if 100 * inter >= 75 * (len(sets[i]) + len(sets[j]) - inter):
                    root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((str(r[0]), len(sets[i]), str(least.get(find(i)))) for i, r in enumerate(rows))


def ours(df):
    return sorted((str(r.doc), r.n, str(r.component)) for r in near_dup.near_duplicates(df).collect())


def edited(words, rate, rng, vocabulary):
    return [rng.choice(vocabulary) if rng.random() < rate else w for w in words]


def corpus(seed, groups=14, size=12, passage=0):
    """Groups of copies with more and fewer edits, all with one long passage in common if asked for."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    common = [rng.choice(vocabulary) for _ in range(passage)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 150))]
        for _ in range(size):
            text = edited(base, rng.choice([0, 0.01, 0.03, 0.05, 0.08]), rng, vocabulary) + common
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, passage", [(1, 0), (2, 0), (3, 60), (4, 200)])
def test_equals_brute_force(make_docs, monkeypatch, seed, passage):
    monkeypatch.setattr(near_dup, "HOT", 6)  # every list is hot in so small a corpus otherwise never
    rows = corpus(seed, passage=passage)
    assert ours(make_docs(rows)) == brute(rows)


def test_one_large_group_of_edited_copies(make_docs):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = [(i, " ".join(edited(base, rng.choice([0.0, 0.01, 0.02, 0.04]), rng, vocabulary))) for i in range(250)]
    assert ours(make_docs(rows)) == brute(rows)


def test_edges(make_docs):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(5, None), (6, ""), (7, " \n\t "), (3, "a b"), (4, "A  B"), (9, "a b c"), (1, text), (1, text),
            (2, text.upper()), (None, text), (None, "alone in the world it is"), (8, "Ä ö ü x y"), (10, "ä ö ü x y"),
            (11, "x" * 200_000), (12, "x" * 200_000), (13, "y " * 60_000)]
    got = {(r.doc, r.n, r.component, r.kept) for r in near_dup.near_duplicates(make_docs(rows)).collect()}
    assert {(5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (3, 1, 3, True), (4, 1, 3, False), (9, 1, 9, True),
            (1, 36, 1, True), (2, 36, 1, False), (8, 1, 8, True), (10, 1, 10, True), (11, 1, 11, True),
            (12, 1, 11, False), (13, 1, 13, True)} <= got
    kept = near_dup.without_near_duplicates(make_docs(rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        str(x) for x in (5, 6, 7, 3, 9, 1, 1, None, 8, 10, 11, 13))
    assert kept.columns == make_docs(rows).columns


def test_rows_without_ids(make_docs):
    """They are linked by their texts, and one row of a component of such rows stays."""
    base = [f"t{i}" for i in range(60)]
    near, other = " ".join(base[:-2] + ["x", "y"]), [f"u{i}" for i in range(50)]
    rows = [(None, " ".join(base))] * 3 + [(None, near), (9, " ".join(other)), (None, " ".join(other + ["z"])),
                                           (None, None), (None, ""), (None, "")]
    assert ours(make_docs(rows)) == brute(rows)
    kept = sorted(str(r.text) for r in near_dup.without_near_duplicates(make_docs(rows)).collect())
    assert len(kept) == 5 and kept[:2] == ["", ""] and " ".join(other) in kept
    assert (" ".join(base) in kept) + (near in kept) == 1


def test_parity_never_says_more_than_the_difference(spark):
    rng = random.Random(3)
    for n in (1, 5, 100, 128, 129, 300, 900, 20_000):
        universe = [rng.getrandbits(64) for _ in range(int(1.5 * n) + 2)]
        for _ in range(4):
            a = set(rng.sample(universe, n))
            b = set(rng.sample(universe, max(1, int(n * rng.uniform(0.76, 1.0)))))
            pa_, pb = (near_dup._parity(np.array(sorted(s), dtype=np.uint64)) for s in (a, b))
            df = spark.createDataFrame([([int(x) for x in pa_.view(np.int64)], [int(x) for x in pb.view(np.int64)])],
                                       "x array<long>, y array<long>")
            least = df.selectExpr(near_dup._differing("x", "y") + " as d").first().d
            assert 0 <= least <= len(a ^ b) and (least > 0 or len(a ^ b) < 0.05 * n + 1)


def test_candidates_of_a_group_of_heavily_edited_copies(spark, make_docs, monkeypatch):
    """Copies of one text, many of them edited past the limit: links as by brute force, and no squares of pairs."""
    made, was = [], near_dup._candidates

    def counted(left, right):
        pairs = was(left, right)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(near_dup, "_candidates", counted)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = [(i, " ".join(edited(base, rng.uniform(0, 0.1), rng, vocabulary))) for i in range(500)]
    assert ours(make_docs(rows)) == brute(rows)
    assert sum(made) < 20 * len(rows)


def test_empty_table(make_docs):
    assert near_dup.near_duplicates(make_docs([])).count() == 0
    assert near_dup.near_duplicates(make_docs([(1, None)])).count() == 1


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {(r.node, r.root) for r in components(links).collect()}
    assert got == {(i, 0) for i in range(201)} | {(500, 500), (501, 500)}
    assert components(links.filter("a > 1000")).count() == 0


def test_test_data(spark, tables):
    rows = [(d["doc_id"], d["text"]) for d in tables["documents"]]
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert ours(df) == brute(rows)
