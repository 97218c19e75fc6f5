"""Counts against plain Python, the binomial bound against exact sums, and the limit on false rejections."""

import random
import re
from fractions import Fraction
from math import comb

import numpy as np
import pytest

from stormrail.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    hit = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit),
            len(words) < 20 or 100 * len(hit) > 30 * len(words))


def corpus(n=1500, seed=3):
    rng = random.Random(seed)
    plain = ["der", "Fluß", "war", "cold", "and", "she", "walked", "home,", "slowly.", "été", "日本", "river"]
    rows, labels = [], []
    for i in range(n):
        lang, bad = rng.choice(["de", "en", "en", "en", None]), rng.random() < 0.3
        words = [rng.choice(plain) + rng.choice(["", "", "s", "\n"]) for _ in range(rng.randint(1, 200))]
        if bad:
            words = rng.choice([[w + "$$$" for w in words], [w.upper() + "!!" for w in words], words[:9] * 12])
        rows.append((i, rng.choice([" ", "\t", "  "]).join(words), lang))
        if i % 4:
            labels.append((i, 0 if bad else 1))
    return rows, labels


@pytest.fixture(scope="module")
def judged(spark):
    rows, labels = corpus()
    rows += [(5000, None, "en"), (5001, "", "xx"), (5002, " \n\t", None), (None, "a b c", "en"), (7, rows[7][1], rows[7][2])]
    docs = spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, lang string, rules string, half int")
    marks = labels + [(1, None), (2, 1 - dict(labels)[2]), (None, 1), (99999, 0)]
    out = q.quality_rules(docs.repartition(4), spark.createDataFrame(marks, "doc_id long, quality int")).collect()
    return rows, labels, out


def test_counts_equal_brute_force(judged):
    rows, _, out = judged
    want = sorted(((r[0], *brute(r[1])) for r in rows), key=str)
    got = sorted(((r.doc, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in out), key=str)
    assert got == want


def test_verdicts(judged):
    rows, labels, out = judged
    mark, by = dict(labels), {r.doc: r for r in out}
    good = [by[d] for d, m in mark.items() if m == 1 and not by[d].base_failed]
    bad = [by[d] for d, m in mark.items() if m == 0 and not by[d].base_failed]
    assert not any(r.kept for r in out if r.base_failed)
    assert np.mean([r.kept for r in good]) > 0.98
    english = [r for r in bad if r.stratum == "en"]
    assert english and np.mean([r.kept for r in english]) < 0.1
    assert all(bool(r.rules) == (not r.kept) for r in out if not r.base_failed)


def test_whole_test_data(spark, tables):
    docs, labels = tables["documents"], tables["labels"]
    out = q.quality_rules(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
                          spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    got = {r.doc: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out}
    assert got == {d["doc_id"]: brute(d["text"]) for d in docs}


def test_very_long_and_repeated_text(spark):
    rng = random.Random(1)
    long = " ".join(f"w{rng.randint(0, 10 ** 9)}" for _ in range(400_000)) + "\nx\nx"
    docs = spark.createDataFrame([(1, long, "a"), (2, "x " * 100_000, "a"), (3, "same line here\n" * 5_000, "b")],
                                 "doc_id long, text string, lang string")
    out = {r.doc: r for r in q.quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert (out[1].n_words, out[1].n_dup_lines, out[1].kept, out[1].level) == (400_002, 1, True, 0)
    assert (out[2].n_repeat_words, out[2].kept) == (100_000, False)
    assert (out[3].n_dup_lines, out[3].n_repeat_words) == (4_999, 15_000)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert q.quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int")).collect() == []


def test_binomial_tail_and_bound_are_exact():
    for n, k, p in [(10, 0, 0.1), (50, 3, 0.05), (200, 9, 0.03), (5, 5, 0.4), (1, 0, 0.5)]:
        f = Fraction(p)
        exact = sum(comb(n, j) * f ** j * (1 - f) ** (n - j) for j in range(k + 1))
        assert q.tail(k, n, p) == pytest.approx(float(exact), rel=1e-12)
        if k < n:
            assert q.tail(k, n, q.upper_bound(k, n, 0.05)) == pytest.approx(0.05, rel=1e-9)
    assert q.upper_bound(3, 3, 0.05) == 1.0


def test_limit_holds_over_many_holdouts():
    """With good documents that differ from the design half's, few holdouts let a stratum pass the limit."""
    rng, over = np.random.default_rng(0), 0
    for _ in range(200):
        x = np.abs(rng.normal(size=(2400, 3)))
        holdout, stratum = np.arange(2400) % 2 == 1, ["a" if i % 3 else "b" for i in range(2400)]
        shifted = np.array([s == "b" for s in stratum])
        x[shifted] *= 1.25  # this stratum is worse than the cutoffs of the whole
        good = rng.random(2400) < 0.8
        x[~good] += rng.exponential(2.0, size=(int((~good).sum()), 3))
        c = q.fit(x, good, holdout, stratum, alpha=0.05, delta=0.1)
        fresh = np.abs(rng.normal(size=(20_000, 3)))
        over += any((fresh * f > c.levels[c.chosen[s]]).any(axis=1).mean() > 0.05 for s, f in (("a", 1), ("b", 1.25)))
    assert over <= 0.1 * 200


def test_levels_only_tighten_and_few_labels_reject_nothing():
    x = np.random.default_rng(1).normal(size=(40, 4))
    c = q.fit(x, np.ones(40, bool), np.arange(40) % 2 == 0, [None] * 20 + ["a"] * 20)
    assert (np.diff(c.levels[1:], axis=0) <= 0).all() and np.isinf(c.levels[0]).all()
    assert c.chosen == {None: 0, "a": 0}
    assert q.fit(x[:0], np.zeros(0, bool), np.zeros(0, bool), []).chosen == {}


def test_fit_counts_every_labelled_document(spark):
    """More labelled documents than the fit once saw at most: levels and tests are those of all of them."""
    from pyspark.sql import functions as F

    n = 60_000
    draw = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m))
    bad = draw(0, 10) < 2
    counts = [(draw(k, 40) + (100 if c == "n_words" else 0) + F.when(bad & (draw(20, 2) == 0), 60).otherwise(0)).alias(c)
              for k, c in enumerate(q.COUNTS, 1)]
    stratum = F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("stratum")
    rows = spark.range(0, n, 1, 4).select(F.col("id").alias("doc"), stratum, draw(30, 2).cast("int").alias("half"),
                                          F.lit(False).alias("base_failed"), *counts)
    labels = spark.range(0, n, 1, 4).select(F.col("id").alias("doc_id"), (~bad).cast("int").alias("quality"))
    levels, chosen = q.train(rows, labels)
    t = rows.join(labels, F.col("doc") == F.col("doc_id")).toPandas()
    want = q.fit(q.measures({c: t[c].to_numpy() for c in q.COUNTS}), t["quality"].to_numpy() == 1,
                 t["half"].to_numpy() == 1, [None if s != s else s for s in t["stratum"]])
    got = chosen.collect()
    assert levels == pytest.approx(want.levels)
    assert {r.stratum: r.level for r in got} == want.chosen and max(want.chosen.values()) > 0
    assert sorted(((r.stratum or "", x.level, x.good, x.rejected) for r in got for x in r.tests)) == sorted(
        (s or "", *x) for s, *x, _ in want.tests)
    assert sum(r.tests[0].good for r in got) == ((t["half"] == 1) & (t["quality"] == 1)).sum()


def test_tail_of_many_draws_is_quick_and_right():
    assert q.tail(500_000, 10 ** 6, 0.5) == pytest.approx(0.5, abs=1e-3)
    assert q.tail(30_000_000, 10 ** 9, 0.03) == pytest.approx(0.5, abs=1e-3)
    assert 0.03 < q.upper_bound(3_000_000, 10 ** 8, 0.01) < 0.0301
