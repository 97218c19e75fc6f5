"""The trie of conversation prefixes against a plain construction of every node."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from stormrail.llm import prefix_trie as p

SCHEMA = "conv_id long, turn long, role string, text string, name string, depth int"
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        made[c] = tuple(own.get(donor, [])[:h] + own[c][h:])
    members = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    children = {n: 0 for n in members}
    saved = {n: (len(m) - 1) * words(n[-1][1]) if n else 0 for n, m in members.items()}
    for n in members:
        if n:
            children[n[:-1]] += 1
    leaves = {n: int(not k) for n, k in children.items()}
    for n in sorted(members, key=len, reverse=True):
        if n:
            saved[n[:-1]] += saved[n]
            leaves[n[:-1]] += leaves[n]
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if made[c] == n))).encode()).hexdigest())
                  for n, m in members.items())


def trie(spark, rows, parts=3):
    full = [(*r[:4], "x", 9) for r in rows]
    out = p.prefix_trie(spark.createDataFrame(full, SCHEMA).repartition(parts))
    assert out.columns == OUT and all(t == "bigint" for _, t in out.dtypes[:-1])
    return sorted(tuple(r) for r in out.collect())


def corpus(seed, n, longest, kinds):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 6 * n), n):
        base = rng.randint(0, 3)
        for t in range(rng.randint(1, longest)):
            same = rng.random() < 0.85
            rows.append((c, t, "user" if t % 2 == 0 else "assistant",
                         f"say {base} {t} " * (t % 3) if same else f"own {rng.randint(0, kinds)}"))
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    rows = corpus(1, 120, 14, 2)
    assert trie(spark, rows) == brute(rows)


def test_long_paths_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(p, "PIECE", 3)
    monkeypatch.setattr(p, "PACK", 4)
    rows = [(c, t, "user", f"turn {t}" if t != 37 + c % 5 else f"fork {c % 3}")
            for c in range(40, 75) for t in range(60 + c % 4)]
    assert trie(spark, rows) == brute(rows)


def test_hot_conversation_and_copies(spark):
    rows = [(1000 + i, t, "user", f"same {t}") for i in range(300) for t in range(5)]
    rows += [(7, t, "user", f"long {t}") for t in range(600)]
    assert trie(spark, rows, 6) == brute(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, "b", ""), (1, 0, "b", ""), (1, 3, "user", "end"),
            (20, 1, "user", "a b"), (20, 1, "user", "a b"), (23, 0, "user", ""), (39, None, None, " \t "),
            (None, 0, "user", "lost"), (21, -5, "ab", "c"), (22, -5, "a", "bc")]
    assert trie(spark, rows) == brute(rows)


def test_only_turnless_and_empty(spark):
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 1)
    rows = [(lone, 0, "user", "gone")]
    assert trie(spark, rows) == brute(rows) and len(brute(rows)) == 1
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "user", "x")]) == []


def test_groups_are_fewer_than_turns(spark):
    rows = [(20 * i, t, "user", f"same {t}") for i in range(50) for t in range(8)]
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA)
    found, _ = p.rebuilt(p.turns(df))
    groups = p._groups(p._blocks(found))
    assert groups.agg(F.sum("n")).first()[0] == 100 and groups.count() == 2
