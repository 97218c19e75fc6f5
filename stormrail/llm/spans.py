"""Spans of pattern matches in whole texts, as DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def folded(items: Column, zero: Column, after, emit) -> Column:
    """The array of ``emit(state, item)`` as the state goes from ``zero`` to ``after(state, item)`` along the items.

    Appending to an array copies it, so the items are folded in blocks of the square root of their number: of n items
    about n * sqrt(n) / 2 are copied in all, not their square.
    """
    def walk(all_items: Column) -> Column:
        block = F.ceil(F.sqrt(F.size(all_items))).cast("int")
        last = F.greatest(F.lit(0), F.ceil(F.size(all_items) / F.greatest(F.lit(1), block)).cast("int") - 1)
        none = F.slice(F.transform(F.slice(all_items, 1, 1), lambda x: emit(zero, x)), 1, 0)

        def inner(state: Column, part: Column) -> Column:
            return F.aggregate(part, F.struct(state.alias("state"), none.alias("out")), lambda a, x: F.struct(
                after(a["state"], x).alias("state"), F.concat(a["out"], F.array(emit(a["state"], x))).alias("out")))

        start = F.array(F.struct(zero.alias("state"), none.alias("out")))
        every = F.aggregate(F.sequence(F.lit(0), last), start, lambda acc, k: F.concat(acc, F.array(inner(
            F.element_at(acc, -1)["state"], F.slice(all_items, k * block + 1, block)))))
        return F.flatten(F.transform(every, lambda b: b["out"]))

    return bound(items, walk)


def matches(text: Column, pattern: str, context: int = 0) -> Column:
    """All leftmost non-overlapping matches of ``pattern`` in ``text`` (null: none), in order, as an array of
    (start, end, match, before, after); positions count code points from 0, ``end`` is exclusive. ``before`` and
    ``after`` are up to ``context`` code points beside the match, as far as the neighbouring matches.

    The text between the matches, from a split by the same pattern, gives their positions, so no part of the text is
    looked up by its position.
    """
    text = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.lit([]).cast("array<struct<start:int,end:int,match:string,before:string,after:string>>")
    parts = F.arrays_zip(found.alias("match"), F.slice(gaps, 1, F.size(found)).alias("gap"),
                         F.slice(gaps, 2, F.size(found)).alias("next"))

    def end(at, x):
        return at + F.length(x["gap"]) + F.length(x["match"])

    def span(at, x):
        return F.struct((at + F.length(x["gap"])).alias("start"), end(at, x).alias("end"), x["match"].alias("match"),
                        F.right(x["gap"], F.lit(context)).alias("before"),
                        F.left(x["next"], F.lit(context)).alias("after"))

    return F.when(F.size(found) > 0, folded(parts, F.lit(0), end, span)).otherwise(none)


def as_spans(found: Column, kind: str, order: int) -> Column:
    """Array of (start, order, end, kind) from an array with ``start`` and ``end``."""
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"),
                                                 m["end"].alias("end"), F.lit(kind).alias("kind")))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, by start and then order, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def apart(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that overlap none of ``others``, by start: one walk over both along the text, which knows how
    far the others have reached, and one against it, which knows where the next of them begins."""
    def marks(found, other):
        return F.transform(found, lambda s: F.struct(s["start"].alias("at"), F.lit(0 if other else 1).alias("turn"),
                                                     s["end"].alias("end"), F.when(F.lit(not other), s).alias("span")))

    shape = F.transform(F.slice(spans, 1, 1), lambda s: s)[0]
    both = F.array_sort(F.concat(F.transform(others, lambda o: F.struct(
        o["start"].alias("at"), F.lit(0).alias("turn"), o["end"].alias("end"), F.when(F.lit(False), shape).alias("span"))),
        marks(spans, False)))
    along = folded(both, F.lit(0), lambda reach, x: F.when(x["turn"] == 0, F.greatest(reach, x["end"])).otherwise(reach),
                   lambda reach, x: F.struct(*[x[k].alias(k) for k in ("at", "turn", "end", "span")],
                                             (reach <= x["at"]).alias("free")))
    far = F.lit((1 << 31) - 1)
    against = folded(F.reverse(along), far, lambda first, x: F.when(x["turn"] == 0, x["at"]).otherwise(first),
                     lambda first, x: F.struct(x["span"].alias("span"), ((x["turn"] == 1) & x["free"] & (
                         first >= x["end"])).alias("free")))
    alone = F.transform(F.filter(F.reverse(against), lambda x: x["free"]), lambda x: x["span"])
    return F.when(F.size(spans) == 0, spans).when(F.size(others) == 0, F.array_sort(spans)).otherwise(alone)


def report(found: DataFrame, kinds: tuple) -> DataFrame:
    """doc, the number of base spans of each kind, base_sha256 and spans, from a table of doc, a column of base spans for
    each kind, and ``added``."""
    base = F.concat(*kinds)
    return found.select("doc", *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds],
                        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                        listed(F.concat(base, "added")).alias("spans"))
