"""Personal data by candidate generation and gradient boosting. DataFrame functions and Spark ML only.

Fixed patterns with their checks give the base spans. Beyond them generators of high recall propose looser, overlapping
spans: e-mail addresses with a spelled-out @, numbers with other separators or none. Boosted trees judge each candidate
by its format (digits, groups, separators, check digits) and context (neighbouring characters, telling words before it).
They learn from the candidates themselves. Right are those that are base spans, as they stand and respelled as people
do to hide them; wrong are those that fail their kind's own check (a domain without a dot, parts above 255, check digits,
numbers of digits) and touch no base span. All others are unlabelled: they are what the method may add. The threshold
of each kind is calibrated on candidates that training did not see. The trees become nested conditions, so scoring is
one projection over the documents, without a shuffle.

Each training candidate also counts in a plain place and behind a telling word. Base spans of a corpus may all stand
behind such words, and nothing else; the trees would then learn the words and not the format.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormrail.llm.common import written
from stormrail.llm.spans import apart, as_spans, matches

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns of the base kinds; possessive quantifiers and look-arounds only save time, the matches are the same.
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"
# Generators of candidates, by kind.
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|[(\[]at[)\]])\x20?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9])[0-9]{1,4}+(?:\x20?[(\[]?\.[)\]]?\x20?[0-9]{1,4}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]{0,3}[0-9]){11,20}+",
    "phone": r"(?:\+|\(|(?<![0-9]))[0-9](?:[\x20()./-]{0,3}[0-9]){6,17}+",
}
#: A sign, respelled or not, and a domain of two labels behind it.
DOMAIN = r"(?:@|[(\[]at[)\]])\x20?[A-Za-z0-9-]+\.[A-Za-z0-9-]*[A-Za-z]"
#: Words before a span that tell of personal data.
TELLING = r"(?i)mail|contact|phone|tel|call|fax|mobil|card|visa|credit|account|host|address|\bip\b"
#: Code points of context that are looked at on each side.
CONTEXT = 24
FEATURES = ("kind", "digits", "length", "dots", "spaces", "dashes", "plus", "parens", "groups", "longest", "luhn",
            "bytes", "at", "domain", "before", "after", "telling", "context_digits")
#: How the items of each kind are respelled: a pattern and its replacements.
RESPELLED = {
    "email": ("@", (" (at) ", "(at)", "[at]")),
    "ip": (r"\.", ("[.]", "(.)", " . ")),
    "card": (r"(?<=[0-9])[\x20-]?(?=(?:[0-9][\x20-]?){4}(?:(?:[0-9][\x20-]?){4})*$)", (".", "/", " - ")),
    "phone": (r"^\+", ("00", "(", "0")),
}
#: An item as its base pattern has it.
PLAIN = {"email": "@", "ip": r"^[0-9]+(?:\.[0-9]+){3}$", "card": r"^[0-9](?:[\x20-]?[0-9])+$", "phone": r"^\+"}
TREES, DEPTH = 16, 4
#: Share of the accepted held-out candidates that must be right.
PRECISION = 0.99


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether the digits of ``s`` pass the Luhn check."""
    d = F.reverse(_digits(s))

    def add(total, i):
        x = F.substring(d, i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)
    return F.when(F.length(d) > 0, total % 10 == 0).otherwise(F.lit(False))


def _bytes(s: Column) -> Column:
    return F.forall(F.split(s, "[^0-9]+"), lambda p: (p == "") | p.rlike(BYTE))


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of (start, end, match) of each base kind."""
    n = lambda m: F.length(_digits(m["match"]))
    has = lambda sign, found: F.when(F.contains(text, F.lit(sign)), found).otherwise(F.slice(found, 1, 0))
    return {"email": has("@", matches(text, EMAIL)),
            "ip": F.filter(matches(text, IP), lambda m: _bytes(m["match"])),
            "card": F.filter(matches(text, CARD), lambda m: luhn(m["match"])),
            "phone": has("+", F.filter(matches(text, PHONE), lambda m: (n(m) >= 10) & (n(m) <= 15)))}


def _side(c: Column) -> Column:
    """Kind of a neighbouring character: none or blank, letter, digit, other."""
    return (F.when((c == "") | c.rlike(r"^\s"), 0).when(c.rlike("^[A-Za-z]"), 1).when(c.rlike("^[0-9]"), 2)
            .otherwise(3).cast("double"))


def _fails(kind: str, s: Column) -> Column:
    """Whether an item cannot be what its kind's own check asks for."""
    n = F.length(_digits(s))
    if kind == "email":
        return ~s.rlike(DOMAIN)
    if kind == "ip":
        return ~_bytes(s)
    if kind == "card":
        return ~luhn(s) | (n < 14) | (n > 19)
    # a bare run of digits without a plus is any number
    return (n < 10) | (n > 15) | s.rlike("^[0-9]+$")


def _respelled(kind: str, s: Column) -> Column:
    """``s`` in each other way of writing it; none where it is not written as the base pattern has it."""
    pattern, ways = RESPELLED[kind]
    every = F.array(*[F.regexp_replace(s, pattern, way) for way in ways])
    return F.when(s.rlike(PLAIN[kind]), every).otherwise(F.array().cast("array<string>"))


def _features(kind: int, s: Column, left: Column, right: Column) -> Column:
    count = lambda chars: F.length(s) - F.length(F.regexp_replace(s, f"[{chars}]", ""))
    groups = F.filter(F.split(s, "[^0-9]+"), lambda g: g != "")
    values = {
        "kind": F.lit(kind), "digits": F.length(_digits(s)), "length": F.length(s), "dots": count("."),
        "spaces": count(r"\x20"), "dashes": count("-"), "plus": count("+"), "parens": count("()"),
        "groups": F.size(groups), "longest": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)),
        "luhn": luhn(s).cast("int"), "bytes": _bytes(s).cast("int"), "at": F.contains(s, F.lit("@")).cast("int"),
        "domain": s.rlike(DOMAIN).cast("int"),
        "before": _side(F.right(left, F.lit(1))), "after": _side(F.substring(right, 1, 1)),
        "telling": left.rlike(TELLING).cast("int"), "context_digits": F.length(_digits(left)) + F.length(_digits(right)),
    }
    return F.struct(*[values[f].cast("double").alias(f) for f in FEATURES])


def _candidate(kind: int, m: Column) -> Column:
    name, s = KINDS[kind], m["match"]
    other = F.transform(_respelled(name, s), lambda r: _features(kind, r, m["before"], m["after"]))
    return F.struct(m["start"].alias("start"), F.lit(kind).alias("order"), m["end"].alias("end"),
                    F.lit(name).alias("kind"), _features(kind, s, m["before"], m["after"]).alias("x"),
                    other.alias("respelled"), _fails(name, s).alias("fails"))


def candidates(text: Column) -> Column:
    """All proposed spans: array of (start, order, end, kind, x, respelled, fails); ``x``: the features; ``respelled``:
    those of the item written in other ways, none where it is not written as its base pattern has it."""
    each = [F.transform(matches(text, GENERATORS[k], CONTEXT), partial(_candidate, i)) for i, k in enumerate(KINDS)]
    return F.concat(*each)


def _tree(node, x: Column) -> Column:
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    left, right = _tree(node.leftChild(), x), _tree(node.rightChild(), x)
    return F.when(x[FEATURES[split.featureIndex()]] <= float(split.threshold()), left).otherwise(right)


@dataclass
class Trees:
    """Boosted trees and the least score of each kind (above 1: none is accepted)."""

    model: object
    least: dict[int, float]

    def score(self, x: Column) -> Column:
        """Probability that a candidate with features ``x`` is personal data."""
        total = F.lit(0.0)
        for tree, weight in zip(self.model.trees, self.model.treeWeights):
            total = total + F.lit(float(weight)) * _tree(tree._call_java("rootNode"), x)
        return 1 / (1 + F.exp(-2 * total))

    def accepts(self, c: Column) -> Column:
        least = F.lit(2.0)
        for kind, value in self.least.items():
            least = F.when(c["order"] == kind, value).otherwise(least)
        return self.score(c["x"]) >= least


def train(found: DataFrame) -> Trees | None:
    """Fit on all rows (c, label) of candidates (order, x). None without both labels. Equal rows are one of their
    number's weight, so the trees see each format and context once. Only the trees and a histogram of scores come to
    the driver."""
    sample = written(found.groupBy("c", "label").agg(F.count(F.lit(1)).alias("n"))
                     .withColumn("test", F.pmod(F.xxhash64("c"), F.lit(4)) == 0), "sample")
    if sample.filter("not test").select("label").distinct().count() < 2:
        return None
    flat = sample.select("test", "label", "c", "n", *[F.col(f"c.x.{f}").alias(f) for f in FEATURES])
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(flat)
    gbt = GBTClassifier(labelCol="label", weightCol="n", maxIter=TREES, maxDepth=DEPTH, seed=5, stepSize=0.3)
    trees = Trees(gbt.fit(rows.filter("not test").select("features", F.col("label").cast("double"),
                                                         F.col("n").cast("double"))), {})
    scored = sample.filter("test").select(F.col("c.order").alias("kind"), "label", "n",
                                          F.floor(trees.score(F.col("c.x")) * 1000).alias("s"))
    steps = scored.groupBy("kind", "s").agg(F.sum(F.col("label") * F.col("n")).alias("right"),
                                            F.sum("n").alias("all")).collect()
    for kind in range(len(KINDS)):
        right = total = 0
        for r in sorted((r for r in steps if r.kind == kind), key=lambda r: -r.s):
            right, total = right + r.right, total + r["all"]
            if right < PRECISION * total:
                # all scores above the first that is too often wrong are accepted, if there was any right one
                trees.least[kind] = max(0.5, (r.s + 1) / 1000) if kind in trees.least else 2.0
                break
            trees.least[kind] = 0.5
    return trees


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, email, ip, card, phone, added) for each row of ``docs``: arrays of spans (start, order, end, kind).

    ``added`` holds accepted candidates that overlap no base span and do not fail their kind's check, and of candidates
    of different kinds over the same text the first kind's. A null text is an empty one; a corpus whose candidates are all of one label adds nothing.
    Rows that repeat have equal spans. Other columns are not read.
    """
    text = F.col(text_col)
    base = base_spans(text)
    found = docs.select(F.col(id_col).alias("doc"), *[as_spans(base[k], k, i).alias(k) for i, k in enumerate(KINDS)],
                        candidates(text).alias("proposed"))
    found = written(found.withColumn("base", F.concat(*KINDS)), "candidates")
    each = found.select("base", F.explode("proposed").alias("c"))
    same = F.exists("base", lambda s: (s["start"] == F.col("c.start")) & (s["end"] == F.col("c.end"))
                    & (s["order"] == F.col("c.order")))
    touched = F.exists("base", lambda s: (s["start"] < F.col("c.end")) & (F.col("c.start") < s["end"]))
    def settings(x: Column) -> Column:
        """The features as they are, in a plain place and behind a telling word: places that happen to go with one label
        in this corpus then decide nothing by themselves."""
        plain = {"before": 0.0, "after": 0.0, "context_digits": 0.0}
        moved = [F.struct(*[F.lit(({**plain, "telling": t})[f]).alias(f) if f in plain or f == "telling" else x[f].alias(f)
                            for f in FEATURES]) for t in (0.0, 1.0)]
        return F.array(x, *moved)

    judged = each.withColumns({"same": same, "touched": touched}).filter("same or (c.fails and not touched)")
    seen = judged.select("c.order", "c.x", F.col("same").cast("int").alias("label")).union(
        judged.filter("same").select("c.order", F.explode("c.respelled"), F.lit(1)))
    trees = train(seen.select("order", "label", F.explode(settings(F.col("x"))).alias("x")).select(
        F.struct("order", "x").alias("c"), "label"))
    rest = apart(F.col("proposed"), F.col("base"))
    rest = F.filter(rest, lambda c: ~c["fails"] & trees.accepts(c)) if trees else F.slice(rest, 1, 0)
    slim = F.transform(rest, lambda c: F.struct(c["start"].alias("start"), c["order"].alias("order"),
                                                c["end"].alias("end"), c["kind"].alias("kind")))
    out = found.select("doc", *KINDS, slim.alias("more"))
    first = F.filter("more", lambda s: ~F.exists("more", lambda o: (o["order"] < s["order"]) & (o["start"] < s["end"])
                                                 & (s["start"] < o["end"])))
    return out.select("doc", *KINDS, first.alias("added"))
