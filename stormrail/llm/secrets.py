"""Secret scan by character Markov models. DataFrame functions only.

Fixed patterns give the base spans: assignments to telling names, access keys, long hexadecimal runs. Beyond them every
run of ``LEAST`` or more token characters is scored by two first-order Markov models of its characters, one of random
strings and one of ordinary identifiers; the log-likelihood ratio for each character says which it is. The models are
trained from labelled samples: runs inside base spans are random, runs in the rest of the text ordinary. The latter hold
the very secrets that no pattern finds, so they count as unlabelled: the threshold is set where held-out random runs score,
and the models are fitted once more without the ordinary runs above it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormrail.llm.common import written
from stormrail.llm.spans import apart, as_spans, matches

# Fixed patterns of the base kinds; possessive quantifiers and look-behinds only save time, the matches are the same.
ASSIGN = (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+")
ASSIGN_VALUE = r"^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
KINDS = ("assign", "access", "hex")
ADDED = "random"

#: A run of token characters that the models judge, and its least length.
LEAST = 16
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{" + str(LEAST) + ",}+"
#: Labelled runs that the models learn from at most, of each class: those with the smallest hashes.
TRAINING_RUNS = 20000


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of (start, end, match) of each base kind."""
    assign = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN_VALUE, 1)) >= 8)
    access = F.filter(matches(text, ACCESS), lambda m: F.length(m["match"]) >= 16)
    return {"assign": assign, "access": access, "hex": matches(text, HEX)}


def _pairs(run: Column) -> Column:
    """Neighbouring characters of a run: array of (a, b)."""
    chars = F.split(run, "")
    return F.arrays_zip(F.slice(chars, 1, F.length(run) - 1).alias("a"), F.slice(chars, 2, F.length(run) - 1).alias("b"))


@dataclass
class Ratio:
    """Log-likelihood ratios of character pairs, row by row of ``ALPHABET``, and the threshold for each character."""

    table: list[float]
    threshold: float

    def score(self, run: Column) -> Column:
        """Mean log-likelihood ratio of a run: above 0 rather random, below rather ordinary."""
        table = F.split(F.lit(",".join(f"{x:.6f}" for x in self.table)), ",").cast("array<double>")
        place = lambda c: F.instr(F.lit(ALPHABET), c) - 1
        ratios = F.transform(_pairs(run), lambda p: F.get(table, place(p["a"]) * len(ALPHABET) + place(p["b"])))
        total = F.aggregate(ratios, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
        return total / (F.length(run) - 1)


def _fit(sample: DataFrame) -> list[float] | None:
    """Log-likelihood ratios from rows (run, random). None if either class is missing."""
    pairs = sample.select("random", F.explode(_pairs(F.col("run"))).alias("p")).select("random", "p.a", "p.b")
    counts = {(r.random, r.a, r.b): r["count"] for r in pairs.groupBy("random", "a", "b").count().collect()}
    if len({c for c, _, _ in counts}) < 2:
        return None
    table = []
    for a in ALPHABET:
        row = {c: [counts.get((c, a, b), 0) + 0.5 for b in ALPHABET] for c in (True, False)}
        sums = {c: sum(x) for c, x in row.items()}
        table += [math.log(row[True][k] / sums[True]) - math.log(row[False][k] / sums[False])
                  for k in range(len(ALPHABET))]
    return table


def _threshold(steps: list[tuple[bool, int, int]]) -> float:
    """Least score of a random run, from (random, score in hundredths, runs) of held-out runs.

    The score above which the share of random runs exceeds that of ordinary ones most is the same whether or not either
    class holds runs of the other, so secrets among the ordinary runs do not lift it (Menon et al., 2015). The threshold
    lies halfway between it and the next lower score of any run, and never below 0.
    """
    total = {c: sum(n for r, _, n in steps if r == c) for c in (True, False)}
    share, best, split, below = {True: 0.0, False: 0.0}, 0.0, None, None
    for s in sorted({s for _, s, _ in steps}, reverse=True):
        if below is None and split is not None:
            below = s
        for r, at, n in steps:
            share[r] += n / total[r] if at == s else 0
        if share[True] - share[False] > best + 1e-9:
            best, split, below = share[True] - share[False], s, None
    if split is None:
        return math.inf
    return max(0.0, (split + (split if below is None else below)) / 200)


def train(runs: DataFrame) -> Ratio | None:
    """Fit the two models from rows (run, random). None if either class is missing. Only the counts of character
    pairs and the scores' histogram come to the driver."""
    runs = runs.filter("run is not null").distinct()
    parts = [runs.filter("random" if c else "not random").orderBy(F.xxhash64("run"), "run").limit(TRAINING_RUNS)
             for c in (True, False)]
    sample = written(parts[0].union(parts[1]).withColumn("test", F.pmod(F.xxhash64("run", F.lit(1)), F.lit(4)) == 0),
                     "runs")
    ratio, learn = None, sample.filter("not test")
    for _ in range(2):
        table = _fit(learn)
        if table is None:
            break
        ratio = Ratio(table, 0.0)
        # means over few characters vary most, so what LEAST characters reach holds for longer runs too
        short = F.left(F.col("run"), F.lit(LEAST))
        scored = sample.filter("test").select("random", F.floor(ratio.score(short) * 100).alias("s"))
        ratio.threshold = _threshold([(r.random, r.s, r["count"]) for r in scored.groupBy("random", "s").count().collect()])
        learn = sample.filter("not test").filter(F.col("random") | (ratio.score(F.col("run")) < ratio.threshold))
    return ratio


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, assign, access, hex, added) for each row of ``docs``: arrays of spans (start, order, end, kind).

    ``added`` holds runs that the models take for random and that overlap no base span. A null text is an empty one;
    without both classes in the text nothing is added. Rows that repeat have equal spans. Other columns are not read.
    """
    text = F.col(text_col)
    base = base_spans(text)
    found = docs.select(F.col(id_col).alias("doc"), *[as_spans(base[k], k, i).alias(k) for i, k in enumerate(KINDS)],
                        matches(text, RUN).alias("runs"))
    found = written(found.withColumn("base", F.concat(*KINDS)), "secrets")
    labelled = found.select(F.explode(F.transform("runs", lambda m: F.struct(
        m["match"].alias("run"), F.exists("base", lambda s: (m["start"] < s["end"]) & (s["start"] < m["end"]))
        .alias("random")))).alias("x")).select("x.*")
    ratio = train(labelled)
    rest = apart(F.col("runs"), F.col("base"))
    rest = F.filter(rest, lambda m: ratio.score(m["match"]) >= ratio.threshold) if ratio else F.slice(rest, 1, 0)
    return found.select("doc", *KINDS, as_spans(rest, ADDED, len(KINDS)).alias("added"))
