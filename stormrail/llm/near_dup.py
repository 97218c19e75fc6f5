"""Near-duplicate documents from bottom-k sketches of one hash function.

Every document is its set of distinct word shingles, hashed once. Its sketch is the ``K`` smallest hash values. Equal
sets become one node first, so exact copies never meet in pairs. Then

1. inverted lists of the retained values say which nodes share one;
2. within a list each node is compared with a few leaders only (a star), not with all others. Leaders are the node
   with the most common values, which stands in the middle of a group of edited copies, and nodes drawn at random;
   only nodes of a list that still belong to different clusters afterwards are compared pair by pair;
3. the sketch of the union, made from both sketches, estimates the likeness and drops clear misses;
4. the full shingle sets decide;
5. links become connected components.

A value retained by more than ``HOT`` nodes (a passage that a great many documents share) would give a list whose
pairs grow with its square. Nodes at least half of whose sketch is rarer than that are found by those rarer values
alone: two sets with a likeness of 0.75 differ in a quarter of their union at most, so they share most of the rarer half
as well. Nodes made up mostly of hot values (large groups of copies, pages that are little but boilerplate) give
their whole sets instead, of which the rarest quarter and one more generate candidates: of two sets with a likeness
of 0.75 or more each holds at least one of those of the other. Boilerplate then generates nothing in documents of
which it is less than three quarters, and stars collapse the groups of copies. Two such nodes meet at a value only if
enough of both sets is left from there on, which keeps copies edited too much from meeting all others. Each whole
set also has a row of bits, the parity of its members by their hash; two sets differ in at least as many members as their
rows differ in bits, so pairs whose rows are too different are proved apart without either set and never leave the list.

Chance enters in two places: the estimate (with 64 values a true pair falls under ``LEAST_ESTIMATE`` about once in ten
million times), and the ``GENERATE`` values of nodes that are not made up mostly of hot ones (a true pair shares none of
them about once in 10**14 times). Parity and prefixes are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormrail.llm.common import WORD, slices, written
from stormrail.llm.components import components
from stormrail.llm.words import mix, shingle_sets, words_of

#: Words of a shingle and the least likeness (in hundredths) of near-duplicates.
SHINGLE = 5
PERCENT = 75
#: Retained values of a sketch, and of those the ones that generate candidates.
K = 64
GENERATE = 24
#: Leaders of a list in each round of stars, and the most rounds before what is left is compared pair by pair.
LEADERS = 4
ROUNDS = 6
#: Pairs that comparing all of them may take for each row of the lists without another round of stars.
FEW = 100
#: A value is hot when more nodes than this retain it.
HOT = 50
#: Bits of parity of a set of up to 128 members; they double with each doubling of the set, DOUBLINGS times at most.
BITS = 512
DOUBLINGS = 6
#: A pair whose union sketch estimates less than this is dropped before the exact comparison.
LEAST_ESTIMATE = 0.45


def _set_hash(s: np.ndarray) -> int:
    """One number for a set of hashes, independent of order."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        x = np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s + np.uint64(0x632BE59BD9B4E019))),
                      np.uint64(len(s))], dtype=np.uint64)
        x = mix(x * np.array([3, 5, 7], dtype=np.uint64))
        return int(mix(x[:1] + (x[1:2] << np.uint64(1)) + x[2:3]).view(np.int64)[0])


def _parity(s: np.ndarray) -> np.ndarray:
    """One bit for each value of the low bits of a hash: whether an odd number of members has it."""
    doublings = min(DOUBLINGS, max(0, int(len(s) - 1).bit_length() - 7))
    size = BITS << doublings
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64) ^ np.uint64(1 << 63)


def _arrays(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(sets) + 1, dtype=np.int32)
    np.cumsum([len(s) for s in sets], out=offsets[1:])
    # the sign bit is flipped, so that the numbers order in Spark as they do here
    flat = (np.concatenate(sets) ^ np.uint64(1 << 63)).view(np.int64) if sets else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, mark, n, node, sketch): a hash of the text, the size of its shingle set, a number for the set, and its
    ``K`` smallest hashes."""

    def run(batches):
        for batch in slices(batches, "text"):
            sets = shingle_sets(words_of(batch.column("text")), SHINGLE)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("mark"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_set_hash(s) for s in sets], pa.int64()), _arrays([s[:K] for s in sets])],
                names=["doc", "mark", "n", "node", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("mark"),
                       F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc long, mark long, n long, node long, sketch array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, members, bits): whole shingle sets of the nodes in ``wanted`` (columns rep, node) and their parities, from
    the texts of their representative documents."""

    def run(batches):
        for batch in slices(batches, "text"):
            sets = shingle_sets(words_of(batch.column("text")), SHINGLE)
            found = [_set_hash(s) for s in sets]
            ok = np.array(found, dtype=np.int64) == batch.column("node").to_numpy()
            keep = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays(
                [pa.array([found[i] for i in keep], pa.int64()), _arrays([sets[i] for i in keep]),
                 _arrays([_parity(sets[i]) for i in keep])],
                names=["node", "members", "bits"])

    # texts without an id are found by a hash of the text, each text once
    text = F.col(text_col).alias("text")
    named = docs.filter(F.col(id_col).isNotNull()).select(
        F.struct(F.col(id_col).cast("long").alias("doc"), F.lit(None).cast("long").alias("mark")).alias("rep"), text)
    nameless = docs.filter(F.col(id_col).isNull()).groupBy(F.xxhash64(text_col).alias("mark")).agg(
        F.first(text_col).alias("text")).select(F.struct(F.lit(None).cast("long").alias("doc"), "mark").alias("rep"),
                                                "text")
    # a sort-merge join at every size: the wanted nodes grow with the corpus
    rows = named.union(nameless)
    return rows.join(wanted.hint("merge"), rows.rep.eqNullSafe(wanted.rep)).select("node", "text").mapInArrow(
        run, "node long, members array<long>, bits array<long>")


class _Confirm:
    """Decides candidate pairs: estimate from the sketches first, then the whole shingle sets, each of which is made
    from its text once."""

    def __init__(self, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str):
        self.nodes, self.docs, self.id_col, self.text_col, self.sets = nodes, docs, id_col, text_col, None

    def sets_of(self, wanted: DataFrame) -> DataFrame:
        """(node, members, bits) of the wanted nodes at least."""
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("node"), "node", "left_anti")
        wanted = written(wanted.join(self.nodes.select("node", "rep"), "node"), "wanted", slim=True)
        new = written(full_sets(self.docs, wanted, self.id_col, self.text_col).dropDuplicates(["node"]), "sets")
        self.sets = new if self.sets is None else self.sets.union(new)
        return self.sets

    def __call__(self, pairs: DataFrame) -> DataFrame:
        sk = self.nodes.select("node", "sketch")
        both = (pairs.join(sk.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a")
                .join(sk.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b"))
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
        likely = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union)) >= LEAST_ESTIMATE * F.size(union)
        near = written(both.filter(likely).select("a", "b", "na", "nb"), "pairs")
        sets = self.sets_of(near.select(F.col("a").alias("node")).union(near.select("b")).distinct())
        joined = (near.join(sets.select(F.col("node").alias("a"), F.col("members").alias("ma")), "a")
                  .join(sets.select(F.col("node").alias("b"), F.col("members").alias("mb")), "b"))
        inter = F.size(F.array_intersect("ma", "mb"))
        return joined.select("a", "b", "na", "nb", inter.alias("inter")).filter(
            f"100 * inter >= {PERCENT} * (na + nb - inter)").select("a", "b")


def _lists(nodes: DataFrame, confirm: _Confirm) -> DataFrame:
    """(value, node, n, heat, rest, bits): the values that generate candidates. heat: over 50 for nodes made up mostly
    of hot values, else 0. rest: null for values of the sketch; for those of the rarest-first order of a whole set, how
    many members come from there on, and bits then is the parity of the set."""
    values = nodes.select("node", "n", F.size("sketch").alias("size"), F.posexplode("sketch").alias("pos", "value"))
    count = values.groupBy("value").agg(F.count("*").alias("count")).filter("count > 1")
    shared = values.join(count, "value").withColumn("hot", F.expr(f"count > {HOT}"))
    heat = shared.filter("hot").groupBy("node").agg(F.count("*").alias("n_hot"))
    shared = written(shared.join(heat, "node", "left").withColumn("n_hot", F.coalesce("n_hot", F.lit(0))), "shared")
    grade = F.expr("if(2 * n_hot > size, 51 + int(49 * n_hot / size), 0)").alias("heat")
    rare = shared.filter(f"not hot and pos < {GENERATE} + n_hot").select("value", "node", "n", grade)
    mostly = written(shared.filter("2 * n_hot > size").select("node", "n", grade).distinct(), "mostly", slim=True)
    whole = mostly.join(confirm.sets_of(mostly.select("node")), "node")
    own = whole.select("node", "n", "heat", F.explode("members").alias("value"))
    ranked = own.join(own.groupBy("value").agg(F.count("*").alias("count")), "value").groupBy("node", "n", "heat").agg(
        F.array_sort(F.collect_list(F.struct("count", "value"))).alias("ranked"))
    prefix = F.expr(f"slice(ranked, 1, int(n - ceil({PERCENT} * n / 100) + 1))")
    first = ranked.select("node", "n", "heat", F.posexplode(prefix).alias("pos", "e")).filter("e.count > 1")
    first = first.join(whole.select("node", "bits"), "node")
    return rare.withColumns({"rest": F.lit(None).cast("long"), "bits": F.lit(None).cast("array<long>")}).union(
        first.select("e.value", "node", "n", "heat", F.expr("n - pos"), "bits"))


def _differing(a: str, b: str) -> str:
    """SQL for a lower bound of the members that two sets do not share, from their parities; the longer is folded."""
    fold = lambda x: f"transform(slice({x}, 1, size({x}) div 2), (v, i) -> v ^ {x}[i + size({x}) div 2])"
    bits = lambda x, y: f"aggregate(zip_with({x}, {y}, (v, w) -> bit_count(v ^ w)), 0, (s, c) -> s + c)"
    return (f"case when size({a}) = size({b}) then {bits(a, b)} when size({a}) = 2 * size({b}) then {bits(fold(a), b)} "
            f"when size({b}) = 2 * size({a}) then {bits(a, fold(b))} else 0 end")


def _candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct pairs of nodes near in size from rows (value, node, n, root) of two clusters each."""
    r = right.select(F.col("value").alias("v"), F.col("node").alias("b"), F.col("n").alias("nb"),
                     F.col("root").alias("rb"), F.col("heat").alias("hb"), F.col("rest").alias("eb"),
                     F.col("bits").alias("bb"))
    near = F.expr(f"100 * least(n, nb) >= {PERCENT} * greatest(n, nb)")
    whole = F.expr(f"{100 + PERCENT} * rest >= {PERCENT} * (n + nb) and {100 + PERCENT} * eb >= {PERCENT} * (n + nb)")
    whole = whole & F.expr(f"{100 + PERCENT} * {_differing('bits', 'bb')} <= {200 - 2 * PERCENT} * (n + nb) / 2")
    meet = F.when(F.expr("heat > 50 and hb > 50"), F.coalesce(whole, F.lit(False))).otherwise(
        F.expr("rest is null and eb is null"))
    pairs = left.join(r, (F.col("value") == F.col("v")) & (F.col("root") != F.col("rb")) & near & meet)
    swap = F.col("node") > F.col("b")
    return pairs.select(
        F.when(swap, F.col("b")).otherwise(F.col("node")).alias("a"),
        F.when(swap, F.col("node")).otherwise(F.col("b")).alias("b"),
        F.when(swap, F.col("nb")).otherwise(F.col("n")).alias("na"),
        F.when(swap, F.col("n")).otherwise(F.col("nb")).alias("nb")).distinct()


def _leaders(lists: DataFrame, turn: int) -> DataFrame:
    """For each value its leaders of this round, as rows like those of ``lists``. One partial aggregate."""
    row = F.struct("node", "n", "heat", "rest", "bits", "root")
    draws = [F.max(F.struct("heat", F.xxhash64("node", F.lit(turn)).alias("draw"), row.alias("row")))]
    draws += [F.min(F.struct(F.xxhash64("node", F.lit(1000 * turn + j)).alias("draw"), row.alias("row")))
              for j in range(1, LEADERS)]
    picked = F.array_distinct(F.array(*[F.col(f"d{j}.row") for j in range(LEADERS)]))
    return (lists.groupBy("value").agg(*[d.alias(f"d{j}") for j, d in enumerate(draws)])
            .select("value", F.explode(picked).alias("row")).select("value", "row.*"))


def _mixed(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the lists whose nodes belong to more than one cluster, with the cluster of each."""
    rows = lists.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    many = rows.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    return rows.join(many.select("value"), "value")


def _work_left(lists: DataFrame) -> float:
    """Pairs that comparing all clusters with each other within the lists would take, for each row."""
    parts = lists.groupBy("value", "root").agg(F.count("*").alias("k"))
    sums = parts.groupBy("value").agg(F.sum("k").alias("c"), F.sum(F.col("k") * F.col("k")).alias("q"))
    pairs, rows = sums.agg(F.sum((F.col("c") * F.col("c") - F.col("q")) / 2), F.sum("c")).first()
    return (pairs or 0) / (rows or 1)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, mark, n, component, kept), one row for each row of ``docs``; ``mark`` is a hash of the text.

    ``component`` is the smallest id among the documents that a chain of links reaches, the document itself included;
    ``kept`` is true for that document. Texts that are null, empty or blank have no shingles (n = 0) and stand alone.
    Rows that repeat an id belong to the components of their own texts. A row whose id is null takes part by its
    text: a component of such rows only has a null ``component``, and its rows with the smallest mark are kept. Other
    columns are not read.
    """
    rows = written(sketches(docs, id_col, text_col), "sketches")
    rep = F.struct("doc", F.when(F.col("doc").isNull(), F.col("mark")).alias("mark"))
    order = F.struct(F.col("doc").isNull(), rep)
    nodes = written(rows.filter("n > 0").groupBy("node", "n").agg(
        F.min_by(rep, order).alias("rep"), F.min_by("sketch", order).alias("sketch")), "nodes")
    confirm = _Confirm(nodes, docs, id_col, text_col)
    lists = written(_lists(nodes, confirm).withColumn("root", F.col("node")), "lists", slim=True)
    links, roots, left = None, None, float("inf")
    for turn in range(ROUNDS + 1):
        if turn:
            lists = written(_mixed(lists, roots), "lists", slim=True)
        was, left = left, _work_left(lists)
        last = turn > 0 and (left < FEW or left > 0.5 * was or turn == ROUNDS)
        pairs = _candidates(lists, lists if last else _leaders(lists, turn))
        found = written(confirm(written(pairs, "candidates", slim=True)), "links")
        links = found if links is None else links.union(found)
        roots = written(components(links), "roots", slim=True)
        if last:
            break
    reps = nodes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = reps.groupBy("root").agg(F.min("rep.doc").alias("component"), F.min("rep.mark").alias("least"))
    label = reps.join(best, "root").select("node", "component", "least")
    blank = F.col("n") == 0
    component = F.when(blank, F.col("doc")).otherwise(F.col("component"))
    out = rows.select("doc", "mark", "n", "node").join(label, "node", "left")
    nameless = component.isNull() & F.coalesce(blank | (F.col("mark") == F.col("least")), F.lit(True))
    return out.select("doc", "mark", "n", component.alias("component"),
                      F.coalesce(F.col("doc") == component, nameless).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`near_duplicates` does not keep; all columns as they are. Rows that repeat
    both id and text are one document, and stay or go together; of rows without an id that repeat a text with words, one
    stays. Columns of ``docs`` may have any names."""
    gone = written(near_duplicates(docs, id_col, text_col).filter("not kept").select("doc", "mark").distinct(), "gone")
    id_of, mark_of = docs[id_col].cast("long"), F.xxhash64(docs[text_col])
    left = docs.join(gone, id_of.eqNullSafe(gone.doc) & (mark_of == gone.mark), "left_anti")
    worded = F.col(id_col).isNull() & F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    return left.filter(~worded).union(left.filter(worded).dropDuplicates([text_col]))
