"""Whitening of embeddings by Jacobi-Davidson with distributed centred products.

Entries become integers, so counts and sums over all rows are exact. The covariance of the rows is never formed: all that
is asked of the data is V q for a few vectors q at once, one pass over packed rows in which every task centres its
rows, multiplies them with the block of vectors, and hands on one sum per vector entry. On top of that product the
driver works with matrices of (dimensions x subspace) only:

1. Rayleigh-Ritz on the search space gives the leading Ritz pairs and their residuals;
2. leading pairs whose residual has come down to rounding error are locked and taken out of the search;
3. the others get a correction each from (I - Q Q')(V - theta I)(I - Q Q') t = -r, Q holding the locked vectors and the
   pair's own, solved by some steps of MINRES. All pairs step together, so a step is one pass for all of them;
4. the corrections widen the search space, which is thick-restarted when it gets wide.

It ends when all wanted pairs are locked and none that is left in the search space lies above them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormrail.llm.common import written

#: Components; entries c count as floor(SCALE * c) + SHIFT, within plus and minus LARGEST.
COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = 1 << 40
#: Bytes of a pack of rows.
PACK_BYTES = 4 << 20
#: Pairs searched for beyond the wanted ones, most steps of MINRES for a correction, the part of its residual at which
#: it stops before, widest search space in blocks of pairs.
GUARD = 8
INNER = 6
NEARER = 0.3
WIDEST = 8
#: A residual counts as rounding error below this part of the largest eigenvalue.
TOLERANCE = 2e-14
#: Eigenvalues up to this part of the largest are zero: the rows do not vary along their component.
RANK = 1e-12


def _orthonormal(x: np.ndarray, against: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of the columns of ``x`` off the spans of ``against``; dependent columns are dropped."""
    out = np.zeros((x.shape[0], 0))
    for c in x.T:
        size = np.linalg.norm(c)
        if not size or not np.isfinite(size):
            continue
        c = c / size
        for _ in range(3):
            for b in [*against, out]:
                c = c - b @ (b.T @ c)
            rest = np.linalg.norm(c)
            if rest < 1e-8:
                break
            c = c / rest
        else:
            out = np.column_stack([out, c])
    return out


def minres(product: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, part: float) -> np.ndarray:
    """Columns t with product(t) close to ``b``, each by MINRES from zero and all in step. A column stops when its
    residual is ``part`` of where it began; the whole after ``steps`` products."""
    n, m = b.shape
    x, w, w_old = (np.zeros((n, m)) for _ in range(3))
    beta = np.linalg.norm(b, axis=0)
    start = np.where(beta > 0, beta, 1.0)
    v, v_old = b / start, np.zeros((n, m))
    eta, beta_in = beta.copy(), np.zeros(m)
    c, c_old, s, s_old = np.ones(m), np.ones(m), np.zeros(m), np.zeros(m)
    going = beta > 0
    for _ in range(steps):
        if not going.any():
            break
        p = np.zeros((n, m))
        p[:, going] = product(v[:, going], going)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta_in * v_old
        beta_out = np.linalg.norm(p, axis=0)
        # the new column of the tridiagonal matrix, turned by the two last rotations
        delta = c * alpha - c_old * s * beta_in
        r2 = s * alpha + c_old * c * beta_in
        r3 = s_old * beta_in
        r1 = np.hypot(delta, beta_out)
        safe = np.where(r1 > 0, r1, 1.0)
        c_old, s_old = c, s
        c, s = np.where(r1 > 0, delta / safe, 1.0), np.where(r1 > 0, beta_out / safe, 0.0)
        w_new = (v - r3 * w_old - r2 * w) / safe
        step = going & (r1 > 0)
        x = x + np.where(step, c * eta, 0.0) * w_new
        eta = -s * eta
        w_old, w = w, w_new
        v_old, v = v, p / np.where(beta_out > 0, beta_out, 1.0)
        beta_in = beta_out
        going = step & (beta_out > 1e-14 * np.abs(alpha)) & (np.abs(eta) > part * start)
    return x


@dataclass
class Pairs:
    values: np.ndarray
    vectors: np.ndarray
    #: Largest residual over the largest eigenvalue, products made, and vectors multiplied in all of them.
    residual: float
    products: int
    columns: int


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, seed: int = 7) -> Pairs:
    """The ``wanted`` largest eigenpairs of a symmetric positive semidefinite matrix known by its product with a block
    of vectors. Signs: the largest entry of a vector is positive."""
    made = [0, 0]

    def times(x: np.ndarray) -> np.ndarray:
        made[0] += 1
        made[1] += x.shape[1]
        return product(x)

    wanted = min(wanted, size)
    if wanted == 0:
        return Pairs(np.zeros(0), np.zeros((size, 0)), 0.0, 0, 0)
    block = min(size, wanted + GUARD)
    rng = np.random.default_rng(seed)
    space = _orthonormal(rng.normal(size=(size, block)), [])
    image = times(space)
    locked, images, values = np.zeros((size, 0)), np.zeros((size, 0)), []
    best, stale, largest = np.inf, 0, 0.0
    while True:
        inside = space.T @ image
        ritz, turn = np.linalg.eigh((inside + inside.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        largest = max([largest, *ritz[:1], *values])
        error = image - space * ritz
        error -= locked @ (locked.T @ error)
        size_of = np.linalg.norm(error, axis=0)
        full = locked.shape[1] + space.shape[1] == size
        limit = TOLERANCE * largest
        # rounding error has been reached as well where several rounds bring no better residual
        open_pairs = min(wanted - len(values), space.shape[1])
        worst = size_of[:open_pairs].max(initial=0.0)
        stale = 0 if worst < 0.5 * best else stale + 1
        best = min(best, worst)
        if stale >= 4 and worst <= 50 * limit:
            limit = worst
        done = 0
        while done < open_pairs and (full or size_of[done] <= limit):
            done += 1
        if done:
            locked = np.column_stack([locked, space[:, :done]])
            images = np.column_stack([images, image[:, :done]])
            values += ritz[:done].tolist()
            space, image, error, ritz = space[:, done:], image[:, done:], error[:, done:], ritz[done:]
            best, stale = np.inf, 0
        if len(values) >= wanted:
            over = [x for x in ritz[:1] if x > min(values) + limit]
            if full or not over:
                break
            # a pair of the search space lies above a locked one: the smallest goes back
            last = int(np.argmin(values))
            space = np.column_stack([space, locked[:, last]])
            image = np.column_stack([image, images[:, last]])
            locked, images = np.delete(locked, last, axis=1), np.delete(images, last, axis=1)
            values.pop(last)
            continue
        if space.shape[1] > WIDEST * block:
            space, image = space[:, :2 * block], image[:, :2 * block]
        now = min(wanted + GUARD - len(values), space.shape[1])
        theta, pair = ritz[:now], space[:, :now]

        def projected(t: np.ndarray, which: np.ndarray) -> np.ndarray:
            own = pair[:, which]
            off = lambda y: y - locked @ (locked.T @ y) - own * (own * y).sum(axis=0)
            t = off(t)
            return off(times(t) - t * theta[which])

        right = -(error[:, :now] - pair * (pair * error[:, :now]).sum(axis=0))
        fresh = _orthonormal(minres(projected, right, min(INNER, size), NEARER), [locked, space])
        if not fresh.shape[1] and not full:
            fresh = _orthonormal(rng.normal(size=(size, 1)), [locked, space])
        space, image = np.column_stack([space, fresh]), np.column_stack([image, times(fresh)])
    # one last Rayleigh-Ritz among the locked vectors
    locked = _orthonormal(locked, [])
    image = times(locked)
    inside = locked.T @ image
    ritz, turn = np.linalg.eigh((inside + inside.T) / 2)
    ritz, vectors, image = ritz[::-1], locked @ turn[:, ::-1], image @ turn[:, ::-1]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    rest = np.linalg.norm(image - vectors * ritz, axis=0).max(initial=0.0)
    return Pairs(ritz, vectors * np.where(sign == 0, 1, sign), rest / largest if largest > 0 else 0.0, *made)


def _rows(vectors: pa.Array, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of an Arrow list column take part, and the integers of those (shorter ones filled up with zeros)."""
    lists = vectors.cast(pa.large_list(pa.float64()))
    values = lists.flatten().to_numpy(zero_copy_only=False)  # nulls inside a vector become NaN
    lengths = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    bad = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(~np.isfinite(values), out=bad[1:])
    ok = vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - lengths])
    keep = np.flatnonzero(ok)
    width = int(lengths[keep].max(initial=0)) if size is None else size
    x = np.zeros((len(keep), width))
    inner = np.arange(width) < lengths[keep][:, None]
    x[inner] = values[np.repeat(ok, lengths)]
    return ok, np.clip(np.floor(SCALE * x), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def packed(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """(rows, width, x): the remaining vectors as packs of at most ``PACK_BYTES`` of 64-bit integers, row by row."""

    def run(batches):
        for batch in batches:
            _, x = _rows(batch.column("vector"))
            step = max(1, PACK_BYTES // max(8 * x.shape[1], 1))
            for i in range(0, len(x), step):
                part = x[i:i + step]
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int64()), pa.array([x.shape[1]], pa.int64()),
                                                  pa.array([part.tobytes()], pa.binary())], names=["rows", "width", "x"])

    return written(vectors.select(F.col(vector_col).alias("vector")).mapInArrow(
        run, "rows long, width long, x binary"), "vectors", slim=True)


def _unpacked(batch: pa.RecordBatch, size: int):
    """The packs of a batch as integer matrices of ``size`` columns."""
    for n, width, x in zip(*(batch.column(k) for k in ("rows", "width", "x"))):
        part = np.frombuffer(x.as_buffer(), dtype=np.int64).reshape(n.as_py(), width.as_py())
        if part.shape[1] < size:
            part = np.column_stack([part, np.full((len(part), size - part.shape[1]), SHIFT, dtype=np.int64)])
        yield part


def _summed(packs: DataFrame, of: Callable, size: int, entries: int) -> np.ndarray:
    """Sum over all packs of ``of(matrix)``, an array of ``entries`` numbers. Every task sums its packs; the sums meet
    entry by entry in a partial aggregate."""

    def run(batches):
        total = None
        for batch in batches:
            for part in _unpacked(batch, size):
                one = of(part)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(entries), pa.int32()), pa.array(total.ravel())],
                                             names=["at", "value"])

    kind = "long" if np.issubdtype(of(np.zeros((1, size), dtype=np.int64)).dtype, np.integer) else "double"
    sums = packs.mapInArrow(run, f"at int, value {kind}").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(entries, dtype=np.int64 if kind == "long" else np.float64)
    out[sums.column("at").to_numpy()] = sums.column("value").to_numpy()
    return out


@dataclass
class Whitening:
    """What whitens a vector: all arrays have one entry for each dimension, or for each component, or for both."""

    n: int
    size: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float
    residual: float
    passes: int


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n with one rounding: n*x - S is exact."""
    return (n * x - sums) / float(n)


def fit(packs: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of all packed vectors. Components along which the rows do not vary are left out."""
    head = packs.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("width"), F.lit(0))).first()
    n, size = int(head[0]), int(head[1])
    if n == 0 or size == 0:
        none = np.zeros(0)
        return Whitening(n, size, np.zeros(size, dtype=np.int64), none, np.zeros((size, 0)), none, 0.0, 0.0, 0)
    sums = _summed(packs, lambda x: x.sum(axis=0), size, size)

    def product(q: np.ndarray) -> np.ndarray:
        def of(x):
            y = _centred(x, n, sums)
            return y.T @ (y @ q)
        return _summed(packs, of, size, q.size).reshape(q.shape) / n

    trace = _summed(packs, lambda x: (_centred(x, n, sums) ** 2).sum(keepdims=True).ravel(), size, 1)[0] / n
    pairs = leading_pairs(product, size, components)
    keep = pairs.values > RANK * pairs.values.max(initial=0.0)
    values, vectors = pairs.values[keep], pairs.vectors[:, keep]
    k = len(values)
    white = lambda x: (_centred(x, n, sums) @ vectors) / np.sqrt(values)
    error = 0.0
    if k:
        mean = _summed(packs, lambda x: white(x).sum(axis=0), size, k) / n

        def cross(x):
            z = white(x) - mean
            return z.T @ z
        error = float(np.abs(_summed(packs, cross, size, k * k).reshape(k, k) / n - np.eye(k)).max())
    return Whitening(n, size, sums, values, vectors, values / trace if k else values, error, pairs.residual,
                     pairs.products)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of (n*x - S)**2 by row; null beyond 64 bits."""
    y = n * x - sums
    if np.abs(y.astype(np.float64)).max(initial=0.0) ** 2 * max(x.shape[1], 1) < 2.0 ** 62:
        return (y * y).sum(axis=1).tolist()
    exact = [sum(v * v for v in row) for row in y.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
             components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row for each remaining row of
    ``vectors`` and component, numbered from 1 by falling eigenvalue.

    Rows whose vector is null or holds a null or non-finite entry are dropped. Shorter vectors are filled up with
    zero entries to the longest one; entries whose integer would pass 2**40 count as 2**40. There are as many
    components as the covariance has rank, eight at most: an empty table, one vector, or copies of one vector give no
    rows. Rows that repeat count as often as they come; a null id stays null. ``deviation`` is null where it needs more
    than 64 bits. Other columns are not read. The model (some kilobytes for each component) is all that goes to tasks.
    """
    model = fit(packed(vectors, vector_col), components)
    k = len(model.values)
    sent = vectors.sparkSession.sparkContext.broadcast(
        (model.n, model.size, model.sums, model.vectors / np.sqrt(model.values), model.explained, model.identity_error))

    def run(batches):
        n, size, sums, turn, explained, error = sent.value
        for batch in batches:
            ok, x = _rows(batch.column("vector"), size)
            if not len(x) or not k:
                continue
            ids = batch.column("vec_id").filter(pa.array(ok))
            rows = np.repeat(np.arange(len(x)), k)
            z = _centred(x, n, sums) @ turn
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                 pa.array(np.full(len(rows), n), pa.int64()),
                 pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(rows)), pa.array(z.ravel()),
                 pa.array(np.tile(explained, len(x))), pa.array(np.full(len(rows), error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).mapInArrow(
        run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
             "identity_error double")
