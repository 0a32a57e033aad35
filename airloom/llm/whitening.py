"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of the centred rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.llm.common import stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
SEED = 23
EXACT = float(2 ** 52)  # scaled entries from here on are no longer whole numbers apart
NO_VARIANCE = 1e-12  # share of the largest variance below which a direction counts as constant
CONVERGED = 1e-15  # residual of a singular pair, as a share of the largest deviation


@dataclass
class Whitening:
    """``axes`` (one unit column per component) and their variances ``values``, over ``n`` rows with sums ``sums``."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    trace: float
    steps: int

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.values]


def whole_rows(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vec_id, x`` in the shared folder: the usable rows, each entry c as ``floor(scale * c) + shift``."""
    entries = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), entries.alias("c"))
    fine = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < EXACT / scale))
    kept = rows.where(F.col("c").isNotNull()).where(fine & (F.size("c") > 0))
    made = stored(kept.select("vec_id", F.transform("c", lambda v: F.floor(v * scale) + shift).alias("x")), "whiten-rows")
    lengths = made.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    return made.where(F.size("x") == (first["size"] if first else 0))


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _summed(rows: DataFrame, add: Callable[[np.ndarray], np.ndarray], size: int, kind: str = "double") -> np.ndarray:
    """Sum of ``add`` over all batches of rows: added per partition, then entry by entry; the entries reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                made = add(_matrix(batch, size)).ravel()
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "s"])

    added = rows.select("x").mapInArrow(run, f"i long, s {kind}").groupBy("i").agg(F.sum("s").alias("s"))
    return np.array([r["s"] for r in sorted(added.collect(), key=lambda r: r["i"])])


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Rows minus the mean, from whole numbers: only the last division rounds."""
    return (n * x - sums) / n


def _clear(vector: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``vector`` without its parts along ``basis``, taken off twice."""
    for _ in range(2 if basis else 0):
        held = np.array(basis)
        vector = vector - held.T @ (held @ vector)
    return vector


def bidiagonal(products: Callable[[np.ndarray], np.ndarray], size: int, wanted: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Largest ``wanted`` deviations of X, their unit right vectors as columns, and the number of steps taken.

    ``products(w)`` is X'(Xw). The left vectors have a row per row of X, so they are never held: each is a combination of
    columns, u = Xw, and ``w`` stands for it. One distributed pass forms u row by row and at once X'u. Both sides are
    reorthogonalised in full: the right vectors directly, the left ones through u_i'u = w_i'(X'u). X V = U B with B
    upper bidiagonal; its small singular decomposition gives deviations and, turned by V, components. Where the
    vectors found span an invariant space, the next one starts anew beside them, so equal deviations are all found.
    """
    draw = np.random.default_rng(SEED)
    rights: list[np.ndarray] = []
    lefts: list[np.ndarray] = []  # w of each left vector
    images: list[np.ndarray] = []  # X'u of each left vector
    alphas: list[float] = []
    betas: list[float] = []
    right, beta, largest = draw.normal(size=size), 0.0, 0.0
    right /= np.linalg.norm(right)
    while True:
        rights.append(right)
        left = right - beta * lefts[-1] if lefts else right
        image = products(left)
        for _ in range(2 if lefts else 0):
            along = np.array(lefts) @ image
            left, image = left - np.array(lefts).T @ along, image - np.array(images).T @ along
        alpha = float(np.sqrt(max(left @ image, 0.0)))
        largest = max(largest, alpha)
        if alpha <= 1e-14 * largest or not alpha:
            alpha, left, image = 0.0, np.zeros(size), np.zeros(size)
        else:
            left, image = left / alpha, image / alpha
        lefts.append(left)
        images.append(image)
        alphas.append(alpha)
        core = np.diag(alphas) + np.diag(betas, 1)
        outer, deviations, inner = np.linalg.svd(core)
        right = _clear(image - alpha * rights[-1], rights)
        beta = float(np.linalg.norm(right))
        steps = len(rights)
        open_ends = beta * np.abs(outer[-1, :wanted])
        # An invariant space tells nothing of what lies beside it: only a start outside it can.
        spent = beta <= 1e-14 * max(largest, 1e-300)
        if steps == size or (steps > wanted and not spent and open_ends.max() <= CONVERGED * deviations[0]):
            return deviations[:wanted], np.array(rights).T @ inner[:wanted].T, steps
        if spent:
            beta, right = 0.0, _clear(draw.normal(size=size), rights)
        right = _clear(right / np.linalg.norm(right), rights)
        right /= np.linalg.norm(right)
        betas.append(beta)


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Components of the covariance of ``rows`` (``x``; all of one length), divisor n; None without rows.

    Directions without variance are no components. Vectors of one entry per dimension, small matrices and the
    counts reach the driver; rows never do.
    """
    first = rows.select(F.size("x").alias("size")).first()
    if first is None:
        return None
    size = first["size"]
    sums = _summed(rows, lambda x: np.append(x.sum(0), len(x)), size, "long")
    n, sums = int(sums[-1]), sums[:-1]
    trace = float(_summed(rows, lambda x: np.square(_centred(x, n, sums)).sum(0), size).sum() / n)
    if not trace:
        return Whitening(n, sums, np.zeros((size, 0)), np.zeros(0), trace, 0)

    def products(w: np.ndarray) -> np.ndarray:
        def add(x: np.ndarray) -> np.ndarray:
            centred = _centred(x, n, sums)
            return centred.T @ (centred @ w)

        return _summed(rows, add, size) / n

    deviations, axes, steps = bidiagonal(products, size, min(components, size))
    values = np.square(deviations)
    real = values > NO_VARIANCE * values[0]
    axes = axes[:, real]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    return Whitening(n, sums, axes, values[real], trace, steps)


def identity_error(rows: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, from all rows; 0 without components."""
    count = len(fitted.values)
    if not count:
        return 0.0
    turn = fitted.axes / np.sqrt(fitted.values)

    def add(x: np.ndarray) -> np.ndarray:
        white = _centred(x, fitted.n, fitted.sums) @ turn
        return np.vstack([white.T @ white, white.sum(0)])

    made = _summed(rows, add, len(fitted.sums)).reshape(count + 1, count) / fitted.n
    return float(np.abs(made[:-1] - np.outer(made[-1], made[-1]) - np.eye(count)).max())


def _deviations(x: np.ndarray, fitted: Whitening) -> list[Decimal]:
    """Sum over dimensions of (n x - S) squared, in whole numbers of any size."""
    away = fitted.n * x - fitted.sums
    if float(np.abs(away).max(initial=0)) ** 2 * away.shape[1] >= 2.0 ** 62:
        away = away.astype(object)
    return [Decimal(int(v)) for v in np.square(away).sum(1)]


def apply_whitening(rows: DataFrame, fitted: Whitening) -> DataFrame:
    """``vec_id, deviation, whitened`` for every row: the centred row along each component over its deviation."""
    size, turn = len(fitted.sums), fitted.axes / np.sqrt(fitted.values)
    count = turn.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, size)
            white = _centred(x, fitted.n, fitted.sums) @ turn
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * count)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(_deviations(x, fitted), pa.decimal128(38, 0)),
                 pa.ListArray.from_arrays(ends, pa.array(white.ravel()))], ["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None, float]:
    """``vec_id, deviation, whitened`` of ``vectors`` (``vec_id``, ``embedding``; others ignored), the fit, its error.

    Rows whose vector is null, empty, or holds null, non-finite or too large entries (64 times the entry is 2**52 or
    more) are left out; so are vectors of another length than the most common one (of equally common ones the
    longest). Every other row gives a row, repeated and null ids too, and counts in the fit. Components are unit
    eigenvectors of the covariance, by falling variance; ``whitened`` has at most ``components`` entries, fewer
    where directions have no variance, none where all rows are equal. No rows give no rows and no fit.
    """
    rows = whole_rows(vectors)
    fitted = fit_whitening(rows, components)
    if fitted is None:
        empty = rows.select("vec_id", F.lit(0).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
        return empty, None, 0.0
    return apply_whitening(rows, fitted), fitted, identity_error(rows, fitted)
