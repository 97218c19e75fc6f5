"""I-Match fingerprints with randomised lexicons.

The lexicon keeps terms within a band of inverse document frequency: neither the words that every text has nor those of a
few texts only. Several random subsets of it each give one hash of a document's distinct terms in that subset. A subset
whose terms an edit leaves alone keeps its hash, so the share of equal hashes tells how alike two texts are.

A subset should hold one or two terms of a document, however long it is, so subsets are nested: at level l each keeps one
in 2**l terms of the lexicon, and a fingerprint has the three levels that suit its number of terms. Documents whose
numbers of terms are within a factor of four have a level in common.

The lower end of the band is a share of the documents, so the lexicon has at most (mean distinct terms of a document) /
(that share) terms: its size does not grow with the corpus, and it is sent to every task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormrail.llm.common import numbered, slices, written
from stormrail.llm.words import mix, words_of

#: Band of the lexicon: least and largest share of the documents that a term occurs in (at least two documents).
LEAST_SHARE, MOST_SHARE = 0.001, 0.1
#: Random subsets of the lexicon at each level.
SUBSETS = 24
#: Distinct terms that a task counts before it passes them on.
TERMS_HELD = 1 << 21

_SEEDS = mix(np.arange(1, SUBSETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _terms(w) -> list[np.ndarray]:
    """Sorted distinct term hashes of each text."""
    return [np.unique(w.hash[a:b]) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist())]


def lexicon(docs: DataFrame, text_col: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> np.ndarray:
    """Sorted hashes of the terms in the band. Document frequencies are counted over all documents."""

    def run(batches):
        held, size, docs_seen = [], 0, 0

        def counted():
            terms, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64),) * 2
            return pa.RecordBatch.from_arrays(
                [pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64)), pa.nulls(len(terms), pa.int64())],
                names=["term", "n", "docs"])

        for batch in slices(batches, "text"):
            for terms in _terms(words_of(batch.column("text"), bare=True)):
                if len(terms):
                    held.append(terms)
                    size += len(terms)
                    docs_seen += 1
            if size > TERMS_HELD:
                yield counted()
                held, size = [], 0
        yield counted()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                                          pa.array([docs_seen], pa.int64())], names=["term", "n", "docs"])

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term long, n long, docs long")
    counts = written(parts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
                     .filter("n > 1 or term is null"), "terms")
    total = counts.agg(F.sum("docs")).first()[0] or 0
    band = counts.filter((F.col("n") >= max(2, int(np.ceil(least * total)))) & (F.col("n") <= max(2, most * total)))
    return np.sort(np.array([r.term for r in band.filter("term is not null").select("term").collect()],
                            dtype=np.int64).view(np.uint64))


def fingerprint(terms: np.ndarray, band: np.ndarray) -> str:
    """Fingerprint of a text from its sorted distinct terms. A text without terms in the band uses all of its terms,
    one without terms has the fingerprint ``-``."""
    if not len(terms):
        return "-"
    if len(band):
        inside = terms[band[np.minimum(np.searchsorted(band, terms), len(band) - 1)] == terms]
        terms = inside if len(inside) else terms
    level = len(terms).bit_length() - 1
    with np.errstate(over="ignore"):
        draws = mix(terms[None, :] ^ _SEEDS[:, None])
        marks = mix(draws + np.uint64(0x5851F42D4C957F2D))
    out = []
    for k in (level, level + 1, level + 2):
        kept = (draws >> np.uint64(64 - k)) == 0 if k else np.ones(draws.shape, dtype=bool)
        sums = np.where(kept, marks, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        some = kept.any(axis=1)
        out.append(f"{k}:" + ".".join(f"{int(h) >> 32:08x}" if s else "-" for h, s in zip(sums, some)))
    return "|".join(out)


def likeness(a: str, b: str) -> float:
    """Share of equal subset hashes, of those with terms in either text, over the levels that both have."""
    if a == b:
        return 1.0
    if "-" in (a, b):
        return 0.0
    x, y = (dict(part.split(":") for part in s.split("|")) for s in (a, b))
    same = seen = 0
    for level in x.keys() & y.keys():
        for p, q in zip(x[level].split("."), y[level].split(".")):
            if p != "-" or q != "-":
                seen += 1
                same += p == q
    return same / seen if seen else 0.0


def _following(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(mark, n, next_mark): each document, without repeated rows, and the one after it in ascending id (null ids last;
    after the last comes the first). ``mark`` stands for id and text."""
    slim = docs.select(F.col(id_col).alias("doc"), _mark(id_col, text_col).alias("mark"),
                       F.length(F.coalesce(text_col, F.lit(""))).cast("long").alias("n")).distinct()
    rows = written(numbered(slim, [F.col("doc").isNull(), F.col("doc"), F.col("mark")], "nth", "order"), "order")
    last = rows.agg(F.max("nth")).first()[0] or 0
    after = rows.select(F.when(F.col("nth") == 0, F.lit(last)).otherwise(F.col("nth") - 1).alias("nth"),
                        F.col("mark").alias("next_mark"))
    return rows.select("nth", "mark", "n").join(after, "nth").drop("nth")


def _mark(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit(3), id_col, F.lit(5), text_col)


_RESULT = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
           "near_next double")


def _edited(text: str, following: str) -> str:
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


def _prints(texts: list[str], band: np.ndarray) -> list[str]:
    return [fingerprint(x, band) for x in _terms(words_of(pa.array(texts, pa.string()), bare=True))]


def _rows(ids: list[pa.Array], names: list[str], texts: list[str], own: list[str], after: list[str],
          after_own: list[str], band: np.ndarray) -> pa.RecordBatch:
    """Results for ``texts`` with fingerprints ``own``, each followed by a text that begins with ``after`` and has the
    fingerprint ``after_own``."""
    edited = [_edited(t, p) for t, p in zip(texts, after)]
    new = _prints(edited, band)
    return pa.RecordBatch.from_arrays(
        [*ids, pa.array([len(t) for t in texts], pa.int64()),
         pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
         pa.array(own, pa.string()), pa.array(new, pa.string()),
         pa.array([likeness(a, b) for a, b in zip(own, new)], pa.float64()),
         pa.array([likeness(a, b) for a, b in zip(own, after_own)], pa.float64())],
        names=[*names, *[c.split()[0] for c in _RESULT.split(", ")]])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of ``docs``.

    The edited text is the text with its last quarter of code points (rounded down) replaced by as many from the
    beginning of the next document in ascending id, or all it has; after the last document comes the first. Rows that
    repeat id and text are one document in that order and get equal results. A null text is an empty one; a null id
    comes last. A single document is its own next. Other columns are not read.

    Tables are mostly stored in the order of their ids, so each row is first taken together with the row that is
    stored behind it, where the texts lie. The order of the ids, a table of three numbers for each document, tells
    which of these pairs are right; for the others the texts are joined with their true successors.
    """
    band = lexicon(docs, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(band)
    order = written(_following(docs, id_col, text_col), "following")

    def along(batches):
        band, held = sent.value, None  # held: the last row so far, which still lacks its successor
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            own, ids, marks = _prints(texts, band), batch.column("doc"), batch.column("mark").to_pylist()
            if held is not None:
                ids = pa.concat_arrays([held[0], ids])
                marks, texts, own = [held[1], *marks], [held[2], *texts], [held[3], *own]
            held = ids.slice(len(ids) - 1), marks[-1], texts[-1], own[-1]
            if len(marks) > 1:
                yield _rows([ids.slice(0, len(ids) - 1), pa.array(marks[:-1], pa.int64()), pa.array(marks[1:], pa.int64())],
                            ["doc", "mark", "behind"], texts[:-1], own[:-1], texts[1:], own[1:], band)
        if held is not None:
            yield _rows([held[0], pa.array([held[1]], pa.int64()), pa.nulls(1, pa.int64())], ["doc", "mark", "behind"],
                        [held[2]], [held[3]], [""], ["-"], band)

    def again(batches):
        band = sent.value
        for batch in slices(batches, "text"):
            texts, starts = ([t or "" for t in batch.column(c).to_pylist()] for c in ("text", "start"))
            yield _rows([batch.column("doc")], ["doc"], texts, _prints(texts, band), starts,
                        batch.column("next").to_pylist(), band)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc"), _mark(id_col, text_col).alias("mark"), F.col(text_col).alias("text"))
    stored = written(rows.mapInArrow(along, f"doc {kind}, mark long, behind long, {_RESULT}"), "fingerprints")
    # of repeated rows all are right or none
    open_ = stored.select("mark", "behind").join(order, "mark").filter("not (behind <=> next_mark)").select(
        "mark", "next_mark", F.floor(F.col("n") / 4).cast("int").alias("need")).distinct()
    open_ = written(open_, "unsettled", slim=True)
    asked = open_.select(F.col("next_mark").alias("mark"), F.col("mark").alias("to"), "need")
    starts = (rows.join(asked, "mark").select("to", F.expr("substring(text, 1, need)").alias("start"))
              .groupBy("to").agg(F.first("start").alias("start")))
    prints = (stored.select("mark", "fingerprint").join(asked.select("mark", "to"), "mark")
              .groupBy(F.col("to").alias("of")).agg(F.first("fingerprint").alias("next")))
    behind = written(starts.join(prints, F.col("to") == F.col("of")).select(F.col("to").alias("mark"), "start", "next"),
                     "successors")
    rest = rows.join(behind, "mark").select("doc", "text", "start", "next").mapInArrow(again, f"doc {kind}, {_RESULT}")
    return stored.join(open_.select("mark"), "mark", "left_anti").drop("mark", "behind").unionByName(rest)
