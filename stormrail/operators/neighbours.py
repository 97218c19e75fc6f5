"""Exact k-nearest-neighbour join (JOIN15, SMP4).

Space is cut into leaves by a tree over a bounded sample of the sites, always
at the median of the widest side, so a crowded place gets many small leaves.
The tree and the leaves' bounding boxes are all that goes to every task: their
number is bounded, and they only say where to look. A query first meets the
sites of its own leaf; the k-th best distance found there tells which other
leaves can hold a nearer site, and it visits just those. Partial lists merge by
aggregation. No side is compared with all of the other, and nothing is missed:
a leaf is left out only if its box lies farther than k sites already found.

Leaves that many queries meet are dealt out: their queries go to tasks in chunks
and each chunk gets a copy of the leaf's sites. Sites at one and the same place
cannot be cut apart; only the first ``k`` of them by id can ever be among the k
nearest, and the others are dropped before (at most k of a place leave a task).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormrail.session import cut_lineage

#: Sites of a leaf aimed at, most leaves, sample rows for each leaf, queries of a leaf that meet its sites in one task.
LEAF_SITES = 512
MOST_LEAVES = 4096
SAMPLE_PER_LEAF = 40
CHUNK = 8192


@dataclass
class Tree:
    """Inner nodes as rows (side, cut, left, right); a negative child c is leaf -c - 1."""

    nodes: np.ndarray
    cuts: np.ndarray
    leaves: int

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``x``."""
        at = np.zeros(len(x), dtype=np.int64) if len(self.nodes) else np.full(len(x), -1, dtype=np.int64)
        while (at >= 0).any():
            inner = np.flatnonzero(at >= 0)
            node = self.nodes[at[inner]]
            right = x[inner, node[:, 0]] > self.cuts[at[inner]]
            at[inner] = np.where(right, node[:, 2], node[:, 1])
        return -at - 1


def build_tree(sample: np.ndarray, leaves: int) -> Tree:
    """A tree of at most ``leaves`` leaves: the fullest part is cut next, at the median of its widest side."""
    import heapq
    nodes, cuts, made = [], [], 1
    owner = {0: None}  # part -> (node, child) that points to it
    parts = {0: sample}
    heap = [(-len(sample), 0)]
    while heap and made < leaves:
        _, p = heapq.heappop(heap)
        x = parts[p]
        if len(x) < 2:
            continue
        side = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
        values = np.sort(x[:, side])
        if values[0] == values[-1]:
            continue
        cut = values[(len(values) - 1) // 2]
        if cut == values[-1]:
            cut = values[np.searchsorted(values, cut) - 1]
        low = x[:, side] <= cut
        if owner[p] is not None:
            nodes[owner[p][0]][owner[p][1]] = len(nodes)
        new = max(parts) + 1
        nodes.append([side, 0, 0])
        cuts.append(cut)
        for child, rows, name in ((1, low, p), (2, ~low, new)):
            owner[name], parts[name] = (len(nodes) - 1, child), x[rows]
            heapq.heappush(heap, (-len(parts[name]), name))
        made += 1
    for number, p in enumerate(sorted(parts)):
        if owner[p] is not None:
            nodes[owner[p][0]][owner[p][1]] = -number - 1
    return Tree(np.array(nodes, dtype=np.int64).reshape(-1, 3), np.array(cuts, dtype=np.float64), len(parts))


def _matrix(column: pd.Series, d: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), d)


def _near(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Squared distances, summed side by side (the same number whichever of two rows is the query)."""
    out = np.zeros((len(q), len(s)))
    for j in range(q.shape[1]):
        out += (q[:, j, None] - s[None, :, j]) ** 2
    return out


def _best(q: pd.DataFrame, s: pd.DataFrame, k: int, d: int, slack: float, own: bool) -> pd.DataFrame:
    """For each query its ``k`` nearest of the sites, and others no farther than the k-th by the factor 1 + slack."""
    qid, sid = q["qid"].to_numpy(), s["sid"].to_numpy()
    sites, order = _matrix(s["x"], d), np.argsort(sid, kind="stable")
    sites, sid = sites[order], sid[order]
    out = []
    step = max(1, 4_000_000 // max(len(sid), 1))
    for i in range(0, len(q), step):
        d2 = _near(_matrix(q["x"].iloc[i:i + step], d), sites)
        if own:
            d2[qid[i:i + step, None] == sid[None, :]] = np.inf
        d2[d2 > q["limit"].to_numpy()[i:i + step, None]] = np.inf
        kth = np.partition(d2, min(k, d2.shape[1]) - 1, axis=1)[:, min(k, d2.shape[1]) - 1]
        row, col = np.nonzero((d2 <= kth[:, None] * (1 + slack)) & np.isfinite(d2))
        out.append(pd.DataFrame({"qid": qid[i:i + step][row], "sid": sid[col], "d2": d2[row, col]}))
    return pd.concat(out) if out else pd.DataFrame({"qid": [], "sid": [], "d2": []})


def _met(visits: DataFrame, sites: DataFrame, k: int, d: int, slack: float, own: bool, kinds: str) -> DataFrame:
    """(qid, sid, d2) from visits (qid, x, limit, leaf) and sites (sid, x, leaf), chunk by chunk of a leaf's visits."""
    per = visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    dealt = visits.join(F.broadcast(per), "leaf").withColumn(  # one row for each leaf
        "chunk", F.pmod(F.xxhash64("qid"), F.col("chunks")).cast("int")).drop("chunks")
    copies = sites.join(F.broadcast(per), "leaf").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def meet(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(s):
            return pd.DataFrame({"qid": [], "sid": [], "d2": []}).astype({"d2": "float64"})
        return _best(q, s, k, d, slack, own)

    return dealt.groupBy("leaf", "chunk").cogroup(copies.groupBy("leaf", "chunk")).applyInPandas(meet, kinds)


def _low(sites: DataFrame, n: int, m: int) -> DataFrame:
    """About ``m`` of the ``n`` sites, those with the smallest hashes. Sorted with a limit, each task sends as many rows
    as the limit to the driver; out of these few all tasks together send no more than there are."""
    top = -(1 << 63) + (1 << 64) * m // max(n, 1)
    return sites if m >= n else sites.where(F.xxhash64("sid") < top)


def k_nearest(queries: DataFrame, sites: DataFrame, k: int, coords: Sequence[str], qid: str = "qid", sid: str = "sid",
              radius: float | None = None, slack: float = 0.0, own: bool = False) -> DataFrame:
    """(qid, sid, d2, rank): the ``k`` nearest sites of each query by Euclidean distance, ties by id.

    ``qid`` and ``sid`` are unique ids of one type; rows with a null id or a null or NaN coordinate take no part.
    ``radius``: only sites within it. ``slack`` > 0 also returns sites whose squared distance is within that factor of
    the k-th (their rank goes on), for callers that measure by another formula. ``own``: a query that is a site itself
    is not its own neighbour. Queries with fewer than ``k`` sites in reach have what there is.
    """
    d, coords = len(coords), list(coords)
    x = F.array(*[F.col(c).cast("double") for c in coords])
    fine = lambda i: F.col(i).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v))
    kind = sites.schema[sid].dataType.simpleString()
    kinds = f"qid {kind}, sid {kind}, d2 double"
    place = Window.partitionBy("x").orderBy("sid")
    s = sites.where(fine(sid)).select(F.col(sid).alias("sid"), x.alias("x"))
    s = s.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k + int(own)).drop("_n")
    q = queries.where(fine(qid)).select(F.col(qid).cast(kind).alias("qid"), x.alias("x"))

    n = s.count()
    leaves = min(MOST_LEAVES, max(1, -(-n // LEAF_SITES)))
    wanted = leaves * SAMPLE_PER_LEAF
    sample = _low(s, n, 2 * wanted).orderBy(F.xxhash64("sid"), "sid").limit(wanted).select("x").toPandas()
    tree = build_tree(_matrix(sample["x"], d), leaves)

    @F.pandas_udf("int")
    def leaf(column: pd.Series) -> pd.Series:
        return pd.Series(tree.leaf(_matrix(column, d)))

    s = cut_lineage(s.withColumn("leaf", leaf("x")))
    boxes = s.groupBy("leaf").agg(*[f(F.col("x")[j]).alias(f"{n}{j}") for j in range(d)
                                    for n, f in (("lo", F.min), ("hi", F.max))]).orderBy("leaf").toPandas()
    lo, hi = (boxes[[f"{n}{j}" for j in range(d)]].to_numpy(dtype=np.float64) for n in ("lo", "hi"))
    names = boxes["leaf"].to_numpy()

    def gaps(x: np.ndarray) -> np.ndarray:
        """Squared distances to the boxes."""
        out = np.zeros((len(x), len(lo)))
        for j in range(d):
            out += np.maximum(0.0, np.maximum(lo[None, :, j] - x[:, j, None], x[:, j, None] - hi[None, :, j])) ** 2
        return out

    far = np.inf if radius is None else radius ** 2 * (1 + 1e-9)
    if not len(names):
        return q.sparkSession.createDataFrame([], f"{kinds}, rank int")

    @F.pandas_udf("int")
    def home(column: pd.Series) -> pd.Series:
        """The leaf with the nearest box: the query's own where it lies in one."""
        x = _matrix(column, d)
        return pd.Series(np.concatenate([names[gaps(x[i:i + 512]).argmin(axis=1)] for i in range(0, len(x), 512)]))

    @F.pandas_udf("array<int>")
    def others(column: pd.Series, limit: pd.Series, at: pd.Series) -> pd.Series:
        """Leaves besides the first one that hold anything within the limit."""
        x, lim, first, out = _matrix(column, d), limit.to_numpy(), at.to_numpy(), []
        for i in range(0, len(x), 512):
            hit = (gaps(x[i:i + 512]) <= lim[i:i + 512, None]) & (names[None, :] != first[i:i + 512, None])
            out += [names[h] for h in hit]
        return pd.Series(out)

    q = cut_lineage(q.withColumn("leaf", home("x")))
    limit = F.lit(float(far))
    mine = cut_lineage(_met(q.withColumn("limit", limit), s, k, d, slack, own, kinds))
    # a query that has found fewer than k sites looks as far as it may
    kth = F.when(F.count(F.lit(1)) >= k, F.array_sort(F.collect_list("d2"))[k - 1] * (1 + slack))
    reach = mine.groupBy("qid").agg(kth.alias("kth"))
    rest = q.join(reach, "qid", "left").select("qid", "x", F.col("leaf").alias("first"),
                                               F.least(F.coalesce("kth", limit), limit).alias("limit"))
    rest = rest.withColumn("leaf", F.explode(others("x", "limit", "first"))).drop("first")
    found = mine.union(_met(rest, s, k, d, slack, own, kinds))
    by = Window.partitionBy("qid").orderBy("d2", "sid")
    ranked = found.withColumn("rank", F.row_number().over(by))
    if not slack:
        return ranked.where(F.col("rank") <= k)
    last = F.max(F.when(F.col("rank") <= k, F.col("d2"))).over(Window.partitionBy("qid"))
    return ranked.withColumn("_last", last).where((F.col("rank") <= k) | (F.col("d2") <= F.col("_last") * (1 + slack))) \
                 .drop("_last")
