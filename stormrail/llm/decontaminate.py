"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items are short and few beside the corpus. They are dealt into blocks of a bounded number of bytes; each block is
sent to all tasks and compared with every document where it lies, so documents are never shuffled.

1. n-grams of ``SEED`` bare words (lower-case, without ASCII punctuation) of the items are counted over the corpus.
   Of each item those up to ``COMMON`` times its median count are its seeds: common phrases go, while an item that
   leaked into a great many documents keeps its seeds, for all of its n-grams are frequent then. An item of fewer words is too short to tell
   a copy from chance and matches nothing.
2. A document that holds a seed is aligned with its item around the seed: word by word, with a gain for equal words and
   a loss for changed, missing and extra ones. Paraphrased and edited copies score high, chance hits low.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormrail.llm.common import slices
from stormrail.llm.words import Words, shingles, words_of

#: Words of a seed, and how many times the item's median count makes an n-gram too common for one.
SEED, COMMON = 3, 4
#: Gain of an equal word, loss of a changed word, loss of a missing or extra word.
MATCH, MISMATCH, GAP = 2, 1, 1
#: Least share of the full score of an item that makes a document contaminated.
LEAST_SCORE = 0.5
#: Bytes of item texts in a block. Its words and n-grams, which every task holds, take about twenty times as much.
BLOCK_BYTES = 4 << 20


@dataclass
class Block:
    """Items of a block: ids, word hashes, sorted seed hashes and for each seed the (item, position) pairs."""

    ids: list[int | None]
    words: list[np.ndarray]
    seeds: np.ndarray
    postings: list[list[tuple[int, int]]]
    bloom: np.ndarray

    BITS = 18

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``w`` where a seed begins, and which seed."""
        if not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        runs = shingles(w.hash, SEED)
        at = np.flatnonzero(self.bloom[runs & np.uint64((1 << self.BITS) - 1)])
        seed = np.minimum(np.searchsorted(self.seeds, runs[at]), len(self.seeds) - 1)
        row = np.searchsorted(w.first, at, side="right") - 1
        ok = (self.seeds[seed] == runs[at]) & (at + SEED <= w.first[row + 1])
        return at[ok], seed[ok]


def _block(rows: list, rare: np.ndarray | None = None) -> Block:
    """``rows``: (id, text) of the items. ``rare``: hashes of the seeds to use (all n-grams if None)."""
    w = words_of(pa.array([t for _, t in rows], pa.string()), bare=True)
    words = [w.hash[a:b] for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist())]
    found: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for item, x in enumerate(words):
        for pos, h in enumerate(shingles(x, SEED).tolist()):
            found[h].append((item, pos))
    seeds = np.array(sorted(found), dtype=np.uint64)
    if rare is not None:
        seeds = seeds[np.isin(seeds, rare)]
    bloom = np.zeros(1 << Block.BITS, dtype=bool)
    bloom[seeds & np.uint64((1 << Block.BITS) - 1)] = True
    return Block([i for i, _ in rows], words, seeds, [found[h] for h in seeds.tolist()], bloom)


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int]:
    """Best local alignment of two word sequences (Smith-Waterman with linear gaps): its share of the full score of
    ``item``, and where it ends in ``text``."""
    if not len(item) or not len(text):
        return 0.0, 0
    step = GAP * np.arange(1, len(text) + 1)
    row, best, end = np.zeros(len(text) + 1), 0.0, 0
    for word in item:
        gain = np.where(text == word, MATCH, -MISMATCH)
        now = np.maximum(np.maximum(row[:-1] + gain, row[1:] - GAP), 0)
        # a run of extra words: the best cell to the left, less the gaps up to here
        now = np.maximum.accumulate(now + step) - step
        row[1:] = now
        k = int(now.argmax())
        if now[k] > best:
            best, end = float(now[k]), k + 1
    return best / (MATCH * len(item)), end


def _matches(block: Block, w: Words) -> list[tuple[int, int, float, int]]:
    """(row, item, score, end) of each text and item that share a seed; end: words of the text up to where the best
    alignment ends."""
    at, which = block.hits(w)
    rows = np.searchsorted(w.first, at, side="right") - 1
    met: dict[tuple[int, int], list[int]] = defaultdict(list)
    for row, p, s in zip(rows.tolist(), at.tolist(), which.tolist()):
        for item, pos in block.postings[s]:
            met[row, item].append(p - pos)
    out = []
    for (row, item), starts in met.items():
        words, lo, hi = block.words[item], int(w.first[row]), int(w.first[row + 1])
        slack = len(words) // 2 + 2
        starts.sort()
        best, end, k = -1.0, 0, 0
        while k < len(starts):  # seeds of one copy lie on nearby diagonals
            first = last = starts[k]
            while k < len(starts) and starts[k] - last <= slack:
                last = starts[k]
                k += 1
            a, b = max(lo, first - slack), min(hi, last + len(words) + slack)
            score, e = align(words, w.hash[a:b])
            if score > best:
                best, end = score, a + e - lo
        out.append((row, item, best, end))
    return out


def _blocks(items: DataFrame, id_col: str, text_col: str) -> list[list]:
    """Rows of the items in blocks of about ``BLOCK_BYTES``, each of which goes through the driver by itself."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    spread = F.pmod(F.xxhash64("id", "text"), F.lit(max(1, n)))
    for k in range(n):
        yield sorted(((r.id, r.text) for r in rows.filter(spread == k).collect()), key=lambda r: (r[0] is None, r))


def rare_seeds(docs: DataFrame, rows: list, text_col: str) -> np.ndarray:
    """Hashes of those n-grams of each item whose number of documents is at most ``COMMON`` times the item's median
   ."""
    sent = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches):
        block = _block(sent.value)
        total = np.zeros(len(block.seeds), dtype=np.int64)
        for batch in slices(batches, "text"):
            w = words_of(batch.column("text"), bare=True)
            at, which = block.hits(w)
            row = np.searchsorted(w.first, at, side="right") - 1
            pairs = np.unique(row * np.int64(max(1, len(block.seeds))) + which)
            total += np.bincount(pairs % max(1, len(block.seeds)), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())],
                                         names=["seed", "docs"])

    block = _block(rows)
    counted = (docs.select(F.col(text_col).alias("text")).mapInArrow(run, "seed long, docs long")
               .groupBy("seed").agg(F.sum("docs").alias("docs")))
    count = np.zeros(len(block.seeds), dtype=np.int64)
    for r in counted.collect():  # one row for each n-gram of the block at most
        count[r.seed] = r.docs
    of_item: dict[int, list[int]] = defaultdict(list)
    for seed, where in enumerate(block.postings):
        for item, _ in where:
            of_item[item].append(seed)
    keep = {s for seeds in of_item.values() for s in seeds
            if count[s] <= COMMON * np.median(np.maximum(1, count[seeds]))}
    return block.seeds[sorted(keep)]


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc, item, score, end): documents that hold a copy of a test item, one row for each document row and item.

    ``score`` is the share of the item's full alignment score (``LEAST_SCORE`` to 1), ``end`` the number of bare words
    of the text up to the end of the copy. Null and blank texts and items match nothing; items that repeat are found
    each; rows that repeat are reported each; null ids are carried as they are.
    """
    out = docs.sparkSession.createDataFrame([], "doc long, item long, score double, end long")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    for rows in _blocks(items, item_id, item_text):
        sent = docs.sparkSession.sparkContext.broadcast((rows, rare_seeds(docs, rows, text_col)))

        def run(batches, sent=sent):
            block = _block(*sent.value)
            for batch in slices(batches, "text"):
                found = [m for m in _matches(block, words_of(batch.column("text"), bare=True)) if m[2] >= LEAST_SCORE]
                ids = batch.column("doc").take(pa.array([m[0] for m in found], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([block.ids[m[1]] for m in found], pa.int64()),
                     pa.array([m[2] for m in found], pa.float64()), pa.array([m[3] for m in found], pa.int64())],
                    names=["doc", "item", "score", "end"])

        out = out.union(narrow.mapInArrow(run, out.schema))
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
          item_text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a copy of a test item, all columns as they are. Rows with a null or blank
    text stay."""
    for rows in _blocks(items, item_id, item_text):
        sent = docs.sparkSession.sparkContext.broadcast((rows, rare_seeds(docs, rows, text_col)))

        def run(batches, sent=sent):
            block = _block(*sent.value)
            for batch in slices(batches, text_col):
                keep = np.ones(batch.num_rows, dtype=bool)
                for row, _, score, _ in _matches(block, words_of(batch.column(text_col), bare=True)):
                    keep[row] &= score < LEAST_SCORE
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
