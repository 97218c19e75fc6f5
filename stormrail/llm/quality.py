"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded by its make-up (shares of kinds of
characters, lengths and repetition of words), a small network learns a representation of passages and gated attention
weights from the labels of whole documents, and the score is that of the attention-weighted mean representation
(Ilse, Tomczak and Welling, 2018). Training sees a bounded sample of labelled documents; scoring is a map over all
texts, where they lie.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormrail.llm.common import slices
from stormrail.llm.words import Words, words_of

#: Words of a passage.
PASSAGE = 64
#: Labelled documents that a model is fitted on at most: those with the smallest hashes of their ids.
TRAINING_DOCUMENTS = 6000
#: Passages of a document that the fit sees at most, spread evenly over the whole text; scores use all of them. With the
#: number of documents this bounds what comes to the driver to some 50 MB, however long the texts are.
TRAINING_PASSAGES = 64
#: Sizes of the passage representation and of the attention layer, passes over the sample, documents of a step.
HIDDEN, ATTENTION, EPOCHS, STEP = 16, 8, 40, 128
#: Kinds of bytes that are counted apart: a-z, A-Z, 0-9, blanks other than newlines, newlines, parts of characters
#: beyond ASCII, . and , and other prose punctuation, and each other printable ASCII sign by itself in 16 groups.
KINDS = 24


def _kinds() -> np.ndarray:
    kind = np.full(256, 7, dtype=np.int64)
    kind[ord("a"):ord("z") + 1] = 0
    kind[ord("A"):ord("Z") + 1] = 1
    kind[ord("0"):ord("9") + 1] = 2
    kind[[9, 11, 12, 32]] = 3
    kind[[10, 13]] = 4
    kind[128:] = 5
    kind[[ord(c) for c in ".,;:?'\"()-"]] = 6
    for i, c in enumerate("!#$%&*+/<=>@[\\]^_`{|}~"):
        kind[ord(c)] = 8 + i % 16
    return kind


_KIND = _kinds()


def passages(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature vectors of all passages, and for each text where its passages begin (one more entry at the end). A
    text without words is one passage of zeros."""
    count = w.counts()
    parts = np.maximum(1, -(-count // PASSAGE))
    first = np.concatenate([[0], np.cumsum(parts)])
    n = int(first[-1])
    row = np.repeat(np.arange(w.n_rows), parts)
    nth = np.arange(n) - first[row]
    lo = w.first[row] + nth * PASSAGE
    hi = np.minimum(lo + PASSAGE, w.first[row + 1])
    size = np.maximum(hi - lo, 0)
    x = np.zeros((n, KINDS + 6), dtype=np.float64)
    full = np.flatnonzero(size)
    if len(full):
        a, b = w.start[lo[full]], w.end[hi[full] - 1]
        length = b - a
        inside = np.repeat(a - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        kinds = np.bincount(np.repeat(np.arange(len(full)), length) * KINDS + _KIND[w.buf[inside]],
                            minlength=len(full) * KINDS).reshape(len(full), KINDS)
        x[full, :KINDS] = np.sqrt(kinds / length[:, None])
        of = np.repeat(np.arange(len(full)), size[full])
        k = size[full]
        chars = (w.end - w.start).astype(np.float64)
        mean = np.bincount(of, chars, len(full)) / k
        x[full, KINDS] = np.log1p(mean)
        x[full, KINDS + 1] = np.sqrt(np.bincount(of, chars * chars, len(full)) / k - mean * mean + 1e-9) / 8
        order = np.lexsort((w.hash, of))
        h, o = w.hash[order], of[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        x[full, KINDS + 2] = np.bincount(o[new], minlength=len(full)) / k
        again = np.zeros(len(w.hash), dtype=bool)
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (of[1:] == of[:-1])
        x[full, KINDS + 3] = np.bincount(of, again, len(full)) / k
        x[full, KINDS + 4] = np.log1p(k) / 4
        x[full, KINDS + 5] = np.log1p(length) / 8
    return x, first


@dataclass
class Attention:
    """Standardisation and weights of the network."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return _forward(self.weights, (x - self.mean) / self.scale, first)["p"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(m: dict, x: np.ndarray, first: np.ndarray) -> dict:
    """Scores of bags; bag i is x[first[i]:first[i + 1]] and has one row at least."""
    bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
    h = np.tanh(x @ m["encode"] + m["encode0"])
    t, g = np.tanh(h @ m["value"]), _sigmoid(h @ m["gate"])
    e = (t * g) @ m["weigh"]
    e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
    a = e / np.add.reduceat(e, first[:-1])[bag]
    z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
    return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ m["out"] + m["out0"])}


def _gradients(m: dict, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
    f = _forward(m, x, first)
    bag, h, t, g, a, z = (f[k] for k in ("bag", "h", "t", "g", "a", "z"))
    d = (f["p"] - y) / len(y)
    dz = d[:, None] * m["out"]
    da = (dz[bag] * h).sum(1)
    de = a * (da - np.add.reduceat(a * da, first[:-1])[bag])
    dt, dg = de[:, None] * m["weigh"] * g * (1 - t * t), de[:, None] * m["weigh"] * t * g * (1 - g)
    dh = (a[:, None] * dz[bag] + dt @ m["value"].T + dg @ m["gate"].T) * (1 - h * h)
    return {"out": z.T @ d, "out0": d.sum(keepdims=True), "weigh": (t * g).T @ de, "value": h.T @ dt, "gate": h.T @ dg,
            "encode": x.T @ dh, "encode0": dh.sum(0)}


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> Attention:
    """Fit by Adam on the log loss. Reruns on the same bags agree. Without two classes the score is the share of
    label 1 (a half without labels)."""
    width = KINDS + 6
    rng = np.random.default_rng(seed)
    m = {"encode": rng.normal(0, 0.3, (width, HIDDEN)), "encode0": np.zeros(HIDDEN),
         "value": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "gate": rng.normal(0, 0.3, (HIDDEN, ATTENTION)),
         "weigh": rng.normal(0, 0.3, ATTENTION), "out": rng.normal(0, 0.3, HIDDEN), "out0": np.zeros(1)}
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        m["out"][:] = 0
        m["out0"][:] = 4 * (2 * share - 1)
        return Attention(np.zeros(width), np.ones(width), m)
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 1e-3
    bags = [(b - mean) / scale for b in bags]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.items()}
    step = 0
    for epoch in range(EPOCHS):
        rate = 0.01 * (1 - epoch / EPOCHS) + 0.0005
        order = rng.permutation(len(bags))
        for i in range(0, len(order), STEP):
            some = order[i:i + STEP]
            first = np.concatenate([[0], np.cumsum([len(bags[k]) for k in some])])
            step += 1
            for k, v in _gradients(m, np.concatenate([bags[j] for j in some]), first, labels[some]).items():
                v = v + 1e-4 * m[k]
                a, b = moment[k]
                a += 0.1 * (v - a)
                b += 0.01 * (v * v - b)
                m[k] = m[k] - rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-8)
    return Attention(mean, scale, m)


def held_out(id_col: str = "doc_id"):
    """Rows that training never sees: crc32 of the id as text is 1 modulo 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> Attention:
    """Fit on at most ``TRAINING_DOCUMENTS`` labelled rows that are not held out. Ids without a label, with a null
    label or with contradicting ones are left out. The passages of the sample, ``TRAINING_PASSAGES`` short
    vectors of each document at most, are all that comes to the driver."""

    def spread(x: np.ndarray) -> np.ndarray:
        if len(x) <= TRAINING_PASSAGES:
            return x
        return x[np.arange(TRAINING_PASSAGES) * len(x) // TRAINING_PASSAGES]


    def run(batches):
        for batch in slices(batches, "text"):
            x, first = passages(words_of(batch.column("text")))
            rows = pa.array([spread(x[a:b]).astype(np.float32).tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("label"), rows],
                                             names=["doc", "label", "bag"])

    marks = (labels.filter(~held_out(id_col)).filter(F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).cast("long").alias("doc"))
             .agg(F.min(label_col).alias("label"), F.max(label_col).alias("other"))
             .filter("label = other").select("doc", F.col("label").cast("double").alias("label")))
    sample = marks.orderBy(F.xxhash64("doc"), "doc").limit(TRAINING_DOCUMENTS)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    rows = (texts.join(F.broadcast(sample), "doc").select("doc", "label", "text")
            .mapInArrow(run, "doc long, label double, bag binary").collect())
    rows.sort(key=lambda r: (r.doc, bytes(r.bag)))
    bags = [np.frombuffer(r.bag, dtype=np.float32).reshape(-1, KINDS + 6).astype(np.float64) for r in rows]
    return fit(bags, np.array([r.label for r in rows]))


def _sent(docs: DataFrame, model: Attention):
    """The weights, some kilobytes, for the tasks."""
    return docs.sparkSession.sparkContext.broadcast((model.mean, model.scale, model.weights))


def scored(docs: DataFrame, model: Attention, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, held_out, score) for each row of ``docs``. Null, empty and blank texts have the score of a bag with one
    empty passage; equal texts have equal scores."""
    sent = _sent(docs, model)

    def run(batches):
        net = Attention(*sent.value)
        for batch in slices(batches, "text"):
            p = np.round(net.scores(*passages(words_of(batch.column("text")))), 9)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("held_out"), pa.array(p, pa.float64())],
                                             names=["doc", "held_out", "score"])

    rows = docs.select(F.col(id_col).alias("doc"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, held_out boolean, score double")


def accepted(docs: DataFrame, model: Attention, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text scores less than ``least``; all columns as they are."""
    sent = _sent(docs, model)

    def run(batches):
        net = Attention(*sent.value)
        for batch in slices(batches, text_col):
            yield batch.filter(pa.array(net.scores(*passages(words_of(batch.column(text_col)))) >= least))

    return docs.mapInArrow(run, docs.schema)
