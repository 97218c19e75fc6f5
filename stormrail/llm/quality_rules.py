"""Quality rules whose cutoffs carry a proven limit on false rejections.

Each document gets a few plain measures (symbols per word, shares of repeated lines and words, capitals, ...), turned
so that more is worse. A row of cutoffs, one for each measure, is a *level*; levels go from one that rejects nothing to
stricter and stricter ones, and are laid out on one half of the labelled documents, the design half. On the other half,
the holdout, each stratum tests its levels in that fixed order. Level ``l`` passes if so few of the stratum's good
documents are rejected that, were its true rate of false rejection over ``ALPHA``, a holdout like this would have a
chance of at most ``DELTA`` / (number of strata): an exact binomial tail. The first level that fails ends the
sequence, so no correction is due inside it, and Bonferroni's covers the strata. With probability 1 - ``DELTA`` no
stratum therefore uses a level that rejects over ``ALPHA`` of its good documents, whichever of the passed levels it
picks; it picks the one that rejects most bad documents less ``PRICE`` times the share of good ones. A stratum with
too few labels passes only the level that rejects nothing.

The two halves are split by a hash of the text, so copies of one text stay on one side. Cutoffs are exact quantiles
over all labelled documents of the design half, tests count all of the holdout. Both are Spark aggregations; the
driver gets the levels (some numbers for each rule) and the number of strata.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormrail.llm.common import slices, written
from stormrail.llm.words import mix, shingles, text_buffer, words_of
from stormrail.operators.quantiles import exact_quantiles
from stormrail.operators.sampling import null_safe_join

#: Largest rate of falsely rejected good documents of a stratum, and the chance that any stratum exceeds it.
ALPHA = 0.03
DELTA = 0.05
#: Share of bad documents that one share of good ones is worth when a stratum picks among the levels it passed.
PRICE = 20.0
#: Words of a window of the measure of repeated words, least words, largest hundredths of repeated words.
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
#: Levels behind the one that rejects nothing: cutoffs beyond the worst good document of the design half, by these
#: parts of its distance from the median, then cutoffs that this share of its good documents exceeds in all.
SLACK = (1.0, 0.5, 0.25, 0.1, 0.0)
RATES = (0.0025, 0.005, 0.01, 0.02, 0.03, 0.05)

#: Measures, more being worse, as functions of the counts.
RULES = {
    "symbols": lambda c: _share(c["n_symbols"], c["n_words"]),
    "long_words": lambda c: _share(c["word_chars"], c["n_words"]),
    "short_words": lambda c: -_share(c["word_chars"], c["n_words"]),
    "dup_lines": lambda c: _share(c["n_dup_lines"], c["n_lines"]),
    "repeats": lambda c: _share(c["n_repeat_words"], c["n_words"]),
    "capitals": lambda c: _share(c["n_capitals"], c["n_letters"]),
    "shouts": lambda c: _share(c["n_shouts"], c["n_words"]),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters",
          "n_shouts")


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _bytes_in(chars: str) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    found[list(chars.encode())] = True
    return found


_SYMBOLS, _SHOUTS = _bytes_in("#*$%&|<>"), _bytes_in("!")
_CAPITALS = _bytes_in("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTERS = _CAPITALS | _bytes_in("abcdefghijklmnopqrstuvwxyz")
_FIRST = np.ones(256, dtype=bool)
_FIRST[0x80:0xC0] = False  # bytes that go on with a code point


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    return len(lines), len(lines) - len(set(lines))


def count(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text; a null one counts as empty.

    A word in a repeated window is one that belongs to any run of ``WINDOW`` words found twice or more in its text.
    Windows are equal if their 64-bit hashes are.
    """
    w = words_of(texts, lower=False)
    n = len(w.hash)
    row = np.repeat(np.arange(w.n_rows), w.counts())
    repeated = np.zeros(n + 1, dtype=np.int64)
    if n >= WINDOW:
        at = np.flatnonzero(row[:n - WINDOW + 1] == row[WINDOW - 1:])
        with np.errstate(over="ignore"):
            key = mix(shingles(w.hash, WINDOW)[at] + row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        np.add.at(repeated, at[twice], 1)
        np.add.at(repeated, at[twice] + WINDOW, -1)
    covered = _sums(np.cumsum(repeated[:n]) > 0)
    chars = _sums(_FIRST[w.buf])
    word_chars = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(chars[w.end] - chars[w.start], out=word_chars[1:])
    in_row = lambda table: np.diff(_sums(table[w.buf])[w.offsets])
    lines = np.array([_lines(t or "") for t in texts.to_pylist()], dtype=np.int64).reshape(-1, 2)
    return {"n_words": w.counts(), "word_chars": np.diff(word_chars[w.first]), "n_symbols": in_row(_SYMBOLS),
            "n_dup_lines": lines[:, 1], "n_repeat_words": np.diff(covered[w.first]), "n_lines": lines[:, 0],
            "n_capitals": in_row(_CAPITALS), "n_letters": in_row(_LETTERS), "n_shouts": in_row(_SHOUTS)}


def measures(counts: dict[str, np.ndarray]) -> np.ndarray:
    """One row for each document, one column for each rule."""
    return np.stack([f(counts) for f in RULES.values()], axis=1).astype(np.float64)


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < LEAST_WORDS) | (
        100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            stratum_col: str | None = "lang") -> DataFrame:
    """(doc, stratum, half, base_failed, counts ...) for each row of ``docs``; half: 0 design, 1 holdout."""

    def run(batches):
        for batch in slices(batches, "text"):
            c = count(batch.column("text"))
            own = [batch.column(k) for k in ("doc", "stratum", "half")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(base_failed(c)), *[pa.array(c[k], pa.int64()) for k in COUNTS]],
                names=["doc", "stratum", "half", "base_failed", *COUNTS])

    kind = docs.schema[id_col].dataType.simpleString()
    stratum = F.col(stratum_col).cast("string") if stratum_col else F.lit(None).cast("string")
    half = F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(2)).cast("int")
    rows = docs.select(F.col(id_col).alias("doc"), stratum.alias("stratum"), half.alias("half"),
                       F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc {kind}, stratum string, half int, base_failed boolean, "
                           + ", ".join(f"{k} long" for k in COUNTS))


def tail(k: int, n: int, p: float) -> float:
    """Chance of at most ``k`` hits in ``n`` draws with chance ``p`` each.

    Summed are the terms near the largest one; by Chernoff's bound, those more than 12 roots of n p + 200 away from it
    are under e^-70 of the sum.
    """
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1:
        return 0.0
    top, far = min(int(k), int((n + 1) * p)), int(12 * math.sqrt(n * p)) + 200
    j = np.arange(max(0, top - far), min(int(k), top + far) + 1)
    logs = np.zeros(len(j))
    np.cumsum(np.log((n - j[:-1]) / j[1:]) + (math.log(p) - math.log1p(-p)), out=logs[1:])
    logs -= logs[top - j[0]]
    largest = (math.lgamma(n + 1) - math.lgamma(top + 1) - math.lgamma(n - top + 1) + top * math.log(p)
               + (n - top) * math.log1p(-p))
    return min(1.0, math.exp(largest) * math.fsum(np.exp(logs)))


def upper_bound(k: int, n: int, delta: float) -> float:
    """The exact (Clopper-Pearson) upper bound of a chance that made ``k`` hits in ``n`` draws."""
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(k, n, mid) > delta else (low, mid)
    return high


@dataclass
class Cutoffs:
    """Levels (rows) by rules (columns), and the level and the tests of each stratum."""

    levels: np.ndarray
    chosen: dict
    #: (stratum, level, good documents, rejected ones, upper bound of the rate) of all tests made
    tests: list


def _laid_out(worst: np.ndarray, mid: np.ndarray, high: list[np.ndarray]) -> np.ndarray:
    """Levels from each rule's largest measure, its median and its quantiles for ``RATES``."""
    levels = [np.full(len(worst), np.inf), *[worst + s * (worst - mid) for s in SLACK], *high]
    return np.minimum.accumulate(np.array(levels), axis=0)


def _quantile_of(rate: float, rules: int) -> float:
    return 1 - rate / rules


def design_levels(good: np.ndarray) -> np.ndarray:
    """Levels from the measures of the design half's good documents, from lenient to strict."""
    rules = good.shape[1]
    if not len(good):
        return np.full((1, rules), np.inf)
    return _laid_out(good.max(axis=0), np.median(good, axis=0), [
        np.quantile(good, _quantile_of(r, rules), axis=0, method="higher") for r in RATES])


def first_rejecting(x: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The first level that rejects a document, the number of levels if none does. Later ones reject it too."""
    first = np.zeros(len(x), dtype=np.int64)
    for cut in levels:
        first += (x <= cut).all(axis=1)
    return first


#: What a labelled document counts as in the tally of its stratum.
BAD, DESIGN, HOLDOUT = 0, 1, 2


def choose(tally: np.ndarray, strata: int, alpha: float = ALPHA, delta: float = DELTA) -> tuple[int, list]:
    """The level of a stratum and the tests (level, good documents, rejected ones, upper bound of the rate) made, from
    its labelled documents counted by (``BAD``, ``DESIGN`` or ``HOLDOUT``, first level that rejects them)."""
    rejected = np.cumsum(tally, axis=1)
    total = rejected[:, -1]
    n, good, bad = int(total[HOLDOUT]), max(int(total[DESIGN] + total[HOLDOUT]), 1), max(int(total[BAD]), 1)
    best, tests = (0.0, 0), []
    for level in range(1, tally.shape[1] - 1):
        k = int(rejected[HOLDOUT, level])
        tests.append((level, n, k, upper_bound(k, n, delta / strata)))
        if tail(k, n, alpha) > delta / strata:
            break
        gain = rejected[BAD, level] / bad - PRICE * (rejected[DESIGN, level] + rejected[HOLDOUT, level]) / good
        best = max(best, (float(gain), -level))
    return -best[1], tests


def fit(x: np.ndarray, good: np.ndarray, holdout: np.ndarray, stratum: list, alpha: float = ALPHA,
        delta: float = DELTA) -> Cutoffs:
    """Cutoffs from measures (rows of labelled documents that pass the base rules), their labels, halves and strata:
    what :func:`train` does with tables, for arrays."""
    levels = design_levels(x[good & ~holdout])
    strata = sorted(set(stratum), key=lambda s: (s is not None, s or ""))
    number = {s: j for j, s in enumerate(strata)}
    tally = np.zeros((len(strata), 3, len(levels) + 1), dtype=np.int64)
    np.add.at(tally, (np.array([number[s] for s in stratum], dtype=np.int64),
                      np.where(good, np.where(holdout, HOLDOUT, DESIGN), BAD), first_rejecting(x, levels)), 1)
    chosen, tests = {}, []
    for s, own in zip(strata, tally):
        chosen[s], made = choose(own, len(strata), alpha, delta)
        tests += [(s, *t) for t in made]
    return Cutoffs(levels, chosen, tests)


def _counts_in(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {k: batch.column(k).to_numpy(zero_copy_only=False) for k in COUNTS}


def _trained_levels(good: DataFrame) -> np.ndarray:
    """:func:`design_levels` of a table of counts; equal measures of a batch leave it as one row."""
    rules = len(RULES)

    def run(batches):
        for batch in batches:
            for rule, v in enumerate(measures(_counts_in(batch)).T):
                value, n = np.unique(v, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), rule), pa.int32()), pa.array(value),
                                                  pa.array(n, pa.int64())], names=["rule", "v", "n"])

    high = [_quantile_of(r, rules) for r in RATES]
    long = good.select(*COUNTS).mapInArrow(run, "rule int, v double, n long")
    found = exact_quantiles(long, "v", [0.5, 1.0, *high], ["rule"], weight="n", higher=high).orderBy("rule").collect()
    if not found:
        return np.full((1, rules), np.inf)
    mid, worst, *rest = np.array([tuple(r)[1:] for r in found]).T
    return _laid_out(worst, mid, rest)


def _tallied(known: DataFrame, levels: np.ndarray) -> DataFrame:
    """(stratum, tally): how many labelled documents have each mark and first rejecting level, as one array."""
    width = len(levels) + 1

    def run(batches):
        for batch in batches:
            mark = np.where(batch.column("good").to_numpy(zero_copy_only=False),
                            np.where(batch.column("half").to_numpy(zero_copy_only=False) == 1, HOLDOUT, DESIGN), BAD)
            cell = mark * width + first_rejecting(measures(_counts_in(batch)), levels)
            t = pa.table({"stratum": batch.column("stratum"), "cell": pa.array(cell, pa.int32())})
            t = t.group_by(["stratum", "cell"]).aggregate([([], "count_all")])
            yield from t.select(["stratum", "cell", "count_all"]).rename_columns(["stratum", "cell", "n"]).to_batches()

    cells = known.mapInArrow(run, "stratum string, cell int, n long").groupBy("stratum", "cell").agg(F.sum("n").alias("n"))
    return cells.groupBy("stratum").agg(F.array(*[
        F.coalesce(F.sum(F.when(F.col("cell") == i, F.col("n"))), F.lit(0)) for i in range(3 * width)]).alias("tally"))


def train(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality"
          ) -> tuple[np.ndarray, DataFrame]:
    """Levels, and the table (stratum, level, tests) of the strata, from the result of :func:`counted` and a table of
    labels (1 good, 0 bad). All labelled rows count; ids without a label, with a null one or with contradicting ones
    are left out."""
    marks = (labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id"))
             .agg(F.min(label_col).alias("__least"), F.max(label_col).alias("__most"))
             .filter("__least = __most and __least in (0, 1)"))
    known = written(rows.filter("not base_failed").join(marks, F.col("doc") == F.col("__id"))
                    .select("stratum", "half", (F.col("__least") == 1).alias("good"), *COUNTS), "labelled")
    levels = _trained_levels(known.filter("good and half = 0"))
    tallied = written(_tallied(known, levels), "tallies")
    strata = tallied.count()

    def run(batches):
        for batch in batches:
            out = [choose(np.array(t, dtype=np.int64).reshape(3, -1), strata)
                   for t in batch.column("tally").to_pylist()]
            tests = [[dict(zip(("level", "good", "rejected", "bound"), x)) for x in made] for _, made in out]
            kind = pa.list_(pa.struct([("level", pa.int32()), ("good", pa.int64()), ("rejected", pa.int64()),
                                       ("bound", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("stratum"), pa.array([lv for lv, _ in out], pa.int32()),
                                              pa.array(tests, kind)], names=["stratum", "level", "tests"])

    return levels, written(tallied.mapInArrow(
        run, "stratum string, level int, tests array<struct<level: int, good: long, rejected: long, bound: double>>"),
        "levels")


def judged(rows: DataFrame, levels: np.ndarray, chosen: DataFrame) -> DataFrame:
    """``rows`` of :func:`counted` with ``kept``, the ``level`` of their stratum (from ``chosen``) and the ``rules`` that
    they break. Strata without labels have level 0."""
    names = list(RULES)

    def run(batches):
        for batch in batches:
            c = _counts_in(batch)
            broken = measures(c) > levels[batch.column("level").to_numpy(zero_copy_only=False)]
            kept = ~broken.any(axis=1) & ~base_failed(c)
            said = [",".join(n for n, b in zip(names, r) if b) for r in broken]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept), pa.array(said, pa.string())],
                                             names=[*batch.schema.names, "kept", "rules"])

    with_level = null_safe_join(rows, chosen.select("stratum", "level"), ["stratum"], "left").select(
        *rows.columns, F.coalesce("level", F.lit(0)).alias("level"))
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in with_level.schema)
    return with_level.mapInArrow(run, f"{head}, kept boolean, rules string").select(
        *rows.columns, "kept", "level", "rules")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  stratum_col: str | None = "lang", label_col: str = "quality") -> DataFrame:
    """(doc, stratum, half, base_failed, the counts, kept, level, rules), one row for each row of ``docs``.

    Null, empty and blank texts have no words and fail the base rules. Equal texts of one stratum have equal verdicts;
    a null stratum is a stratum; rows that repeat are judged alike. An empty table of documents gives no rows, an
    empty table of labels rejects by the base rules alone. Other columns are not read. Texts are read once: the
    counts are written as a slim table, from which the fit and the verdicts come.
    """
    rows = written(counted(docs, id_col, text_col, stratum_col), "counts")
    return judged(rows, *train(rows, labels, id_col, label_col))
