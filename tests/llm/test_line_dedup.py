"""Line dedup against a plain count of distinct sites."""

import random

from stormrail.llm import line_dedup


def brute(rows, sites):
    spread = {}
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if line.strip(" ") and s is not None:
                spread.setdefault(line, set()).add(s)
    bad = {x for x, s in spread.items() if len(s) >= sites}
    out = []
    for i, t, s in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for x in lines if x not in bad]
        if len(kept) < len(lines) and any(x.strip(" ") for x in kept):
            out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
        else:
            out.append((i, t, len(lines), 0))
    return sorted(out, key=str)


def ours(df, sites):
    return sorted(((r.doc_id, r.text, r.lines, r.removed) for r in line_dedup.dedup_lines(df, sites=sites).collect()),
                  key=str)


def test_equals_brute_force(make_docs):
    rng = random.Random(3)
    common = [f"common line {i}" for i in range(30)]
    rows = []
    for i in range(400):
        lines = [f"own {i} {j} " + "x" * rng.randint(0, 60) for j in range(rng.randint(0, 5))]
        lines += [rng.choice(common[:rng.randint(1, 30)]) for _ in range(rng.randint(0, 4))] + [""] * rng.randint(0, 2)
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), f"s{int(rng.random() ** 2 * 25)}"))
    for sites in (2, 8, 14):
        assert ours(make_docs(rows), sites) == brute(rows, sites)


def test_edges(make_docs):
    rows = [(1, None, "a"), (2, "", "a"), (3, "k\nlong own line", "a"), (4, "k\nanother own line", "b"),
            (5, "k\nown line of null", None), (6, "k", "c"), (6, "k", "c"), (None, "k\nno id at all", "d"),
            (7, "\n\n \n", "a"), (8, "k\r\nyet another line", "a"), (9, "k\n" + "z" * 100_000, "e")]
    assert ours(make_docs(rows), 3) == brute(rows, 3)
    assert ours(make_docs([]), 3) == []
    assert line_dedup.dedup_lines(make_docs(rows)).columns == make_docs(rows).columns + ["lines", "removed"]


def test_no_python_in_the_plan(spark, make_docs):
    plan = line_dedup.dedup_lines(make_docs([(1, "a\nb")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline_leaves_boilerplate_only_where_nothing_else_is(make_docs):
    from corpus_pipeline import without_boilerplate
    head, foot = "h" * 80, "f" * 80
    rows = [(i, f"{head}\nown {i}\n\n{foot}", f"s{i % 12}") for i in range(24)]
    rows += [(100 + i, f"{head}\n\n{foot}", f"s{i}") for i in range(12)]
    df = make_docs(rows).withColumnRenamed("n", "n_chars")
    got = {r.doc_id: (r.text, r.n_chars) for r in without_boilerplate(df.sparkSession, df, "").collect()}
    assert all(got[i] == (f"own {i}\n", len(f"own {i}\n")) for i in range(24))
    assert all(got[100 + i] == (f"{head}\n\n{foot}", 7) for i in range(12))


def test_sites_that_share_registers_are_counted(spark):
    n = 60_000
    lines = spark.range(n).selectExpr("id as key", "explode(sequence(0, 9)) as j").selectExpr("key", "key || '-' || j as site")
    assert line_dedup.boilerplate(lines, 10).distinct().count() == n
