"""I-Match fingerprints: edited texts, order of documents and document frequencies against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from stormrail.llm import fingerprint as f
from stormrail.llm.words import words_of


def following(rows):
    """{(id, text): edited text} by plain sorting (ids are distinct)."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    out = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        out[i] = (t[:len(t) - cut] + nxt[:cut], order[(k + 1) % len(order)][0])
    return out


def test_edited_texts_and_likeness(spark, tables):
    rows = [(d["doc_id"], d["text"]) for d in tables["documents"]]
    got = {r.doc: r for r in f.fingerprints(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    want = following(rows)
    texts = dict(rows)
    for i, (edited, nxt) in want.items():
        r = got[i]
        assert r.n_chars == len(texts[i]) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_next == f.likeness(r.fingerprint, got[nxt].fingerprint)
        assert r.near_edited == f.likeness(r.fingerprint, r.edited_fingerprint)
    same = {}
    for i, t in rows:
        assert same.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    long = [got[i] for i, t in rows if len(t) > 400]
    assert np.mean([r.near_edited for r in long]) > 0.3 > 0.05 > np.mean([r.near_next for r in long])


def test_lexicon_counts_all_documents(spark, make_docs):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary[:rng.randint(1, 300)]) for _ in range(40))) for i in range(300)] + [(900, None)]
    df = {}
    for _, t in rows:
        for w in set(re.findall(r"[a-z0-9]+", t or "")):
            df[w] = df.get(w, 0) + 1
    want = {w for w, n in df.items() if n >= max(2, 0.03 * 300) and n <= 0.1 * 300}
    got = f.lexicon(make_docs(rows), least=0.03, most=0.1)
    hashes = {int(words_of(pa.array([w])).hash[0]): w for w in df}
    assert {hashes[int(h)] for h in got} == want


def test_edges(make_docs):
    rows = [(1, None), (2, ""), (3, "a"), (4, "one two three four"), (5, "one two three four"), (5, "one two three four"),
            (None, "é😀 " * 30), (7, "w " * 50_000), (8, "...")]
    got = f.fingerprints(make_docs(rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint == by[8].fingerprint == "-"
    assert by[4].fingerprint == by[5].fingerprint and by[4].near_next == 1.0
    assert by[None].n_chars == 90 and by[7].n_chars == 100_000
    plain = [(i, t) for i, t in rows if i != 5] + [(5, "one two three four")]
    for i, (edited, _) in following(plain).items():
        assert by[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
    assert f.fingerprints(make_docs([])).count() == 0
    alone = f.fingerprints(make_docs([(1, "abcdefgh")])).collect()[0]
    assert alone.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and alone.near_next == 1.0
