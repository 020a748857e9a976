"""Embedding whitening by a matrix-free Jacobi-Davidson method.

The covariance is never formed.  Its product with a few vectors is one pass over
the blocks of the fit list (each task sums (x - mean)((x - mean) v) of its rows, sums are
added up in a tree).  A search space starts with one vector a component; each
step takes its Ritz pairs, locks the leading ones whose residual is at double
precision, and widens the space by the solutions of the others' correction equations,
projected against all locked and leading Ritz vectors and solved by a few MINRES
steps, in which all equations share each pass.  The space restarts from its leading Ritz
vectors when it is full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.common import materialise, tree_sum

SCALE = 256
COMPONENTS = 4
#: Rows of a packed block, inner steps a correction, widest search space, outer steps.
BLOCK, INNER, SPACE, OUTER = 8192, 8, 40, 200
#: Residual, in units of rounding of the greatest eigenvalue and the square root of the dimensions.
ROUNDINGS = 4
SEED = 13
_LONG = 2 ** 63 - 1


@dataclass
class Whitening:
    """``sums`` of the ``n`` vectors fitted (exact), eigenvalues and unit
    eigenvectors (columns) of their covariance by falling eigenvalue, its trace, and the
    largest absolute entry of the whitened vectors' covariance minus the identity."""

    n: int
    sums: list
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    residuals: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([_quotient(s, self.n) for s in self.sums])


def _quotient(a: int, n: int) -> float:
    return float(int(a) / n)  # of whole numbers: correctly rounded


def cleaned(vectors: DataFrame, vector: str = "embedding", keep: list | None = None, scale: int = SCALE) -> DataFrame:
    """Rows (struct ``row``, of the columns ``keep``) with ``x``, floor(scale * c) of every component
    as long, without those whose vector is null or holds a null or non-finite entry.
    A component beyond a long ends there."""
    v = vectors[vector].cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(v, lambda c: F.floor(c * scale))
    return vectors.where(v.isNotNull() & fine).select(F.struct(*(keep or ["*"])).alias("row"), whole.alias("x"))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of longs; shorter ones end in zeros."""
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    at = np.cumsum(sizes) - sizes
    for i, (a, n) in enumerate(zip(at, sizes, strict=True)):
        out[i, :n] = flat[a:a + n]
    return out


def _fit_list(clean: DataFrame, width: int) -> DataFrame:
    """Each distinct vector once, as blocks (packed longs, row by row)."""
    padded = clean.select(F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))).alias("x"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _rows(b.column(0), width)
            for at in range(0, len(x), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([x[at:at + BLOCK].tobytes()], pa.binary())], names=["block"])

    return materialise(padded.distinct().mapInArrow(blocks, "block binary"))


def _vectors(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for b in batches:
        for block in b.column(0).to_pylist():
            yield np.frombuffer(block, np.int64).reshape(-1, width)


def _moments(blocks: DataFrame, width: int) -> tuple[int, list]:
    """Number of vectors and exact sums."""
    def partial(batches: Iterator[pa.RecordBatch]) -> list | None:
        n, total = 0, np.zeros(width, object)
        for x in _vectors(batches, width):
            n += len(x)
            safe = len(x) * int(np.abs(x.astype(float)).max(initial=0)) < _LONG
            total = total + (x.sum(0) if safe else x.astype(object).sum(0)).astype(object)
        return [np.array([n], object), total] if n else None

    got = tree_sum(blocks, partial)
    return (int(got[0][0]), [int(s) for s in got[1]]) if got else (0, [])


def _product(blocks: DataFrame, width: int, n: int, mean: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The covariance's product with the columns of a matrix: one pass."""
    def times(v: np.ndarray) -> np.ndarray:
        def partial(batches: Iterator[pa.RecordBatch]) -> list | None:
            total = None
            for x in _vectors(batches, width):
                c = x - mean
                own = c.T @ (c @ v)
                total = own if total is None else total + own
            return None if total is None else [total]

        return tree_sum(blocks, partial)[0] / n
    return times


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """The columns of ``new`` made orthonormal to each other and to ``against``;
    those that depend on the others go."""
    kept = []
    for v in new.T:
        size = np.linalg.norm(v)
        for _ in range(3):  # rounding: project again
            for a in against:
                v = v - a @ (a.T @ v)
            for q in kept:
                v = v - q * (q @ v)
        left = np.linalg.norm(v)
        if size and left > 1e-10 * size:
            kept.append(v / left)
    return np.array(kept).T if kept else np.zeros((len(new), 0))


def _corrections(times, theta: np.ndarray, residual: np.ndarray, basis: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions t of (I - QQ')(V - theta I)(I - QQ') t = -r, Q the ``basis``, for each
    column of ``residual`` and its ``theta``, by ``steps`` MINRES steps.  Each step is one
    pass for all columns."""
    off = lambda z: z - basis @ (basis.T @ z)
    r = off(off(-residual))
    beta = np.linalg.norm(r, axis=0)
    beta0 = np.where(beta > 0, beta, 1.0)
    v, before = r / beta0, np.zeros_like(r)
    x = np.zeros_like(r)
    d1, d2 = np.zeros_like(r), np.zeros_like(r)
    cs, sn = -np.ones(len(theta)), np.zeros(len(theta))
    phi, delta_bar, eps_now = beta.copy(), np.zeros(len(theta)), np.zeros(len(theta))
    b, live = np.zeros(len(theta)), beta > 0
    for _ in range(steps):
        y = off(times(v) - theta * v)
        alpha = np.sum(v * y, axis=0)
        y = off(y - alpha * v - b * before)
        b_next = np.linalg.norm(y, axis=0)
        # The rotations of the tridiagonal matrix so far.
        delta = cs * delta_bar + sn * alpha
        gamma_bar = sn * delta_bar - cs * alpha
        eps_old, eps_now = eps_now, sn * b_next
        delta_bar = -cs * b_next
        gamma = np.hypot(gamma_bar, b_next)
        live &= gamma > 1e-300
        gamma = np.where(live, gamma, 1.0)
        cs, sn = gamma_bar / gamma, b_next / gamma
        tau, phi = cs * phi, sn * phi
        w = (v - eps_old * d2 - delta * d1) / gamma
        x += np.where(live, tau, 0.0) * w
        d2, d1 = d1, w
        live &= (b_next > 1e-14 * beta0) & (np.abs(phi) > 1e-3 * beta0)
        if not live.any():
            break
        before, v, b = v, y / np.where(b_next > 0, b_next, 1.0), b_next
    return x


def eigenpairs(times: Callable[[np.ndarray], np.ndarray], width: int, k: int, roundings: float = ROUNDINGS
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues, unit eigenvectors and residual norms of a symmetric
    operator of which only products are known.  Equal eigenvalues get any orthonormal
    vectors of their space."""
    k = min(k, width)
    rng = np.random.default_rng(SEED)
    locked, values, norms = np.zeros((width, 0)), [], []
    space = _orthonormal(rng.normal(size=(width, min(width, k + 2))))
    image = times(space)
    stalled, least = 0, np.inf
    for _ in range(OUTER):
        small = space.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-theta)
        theta, turn = theta[order], turn[:, order]
        ritz, moved = space @ turn, image @ turn
        wanted = k - len(values)
        residual = (moved - theta * ritz)[:, :wanted]
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        great = max([abs(theta[0]), *map(abs, values)])
        limit = roundings * np.finfo(float).eps * np.sqrt(width) * great
        full = space.shape[1] + locked.shape[1] >= width  # nothing to widen by: exact but for rounding
        # Sums of many rows may round by more than the limit: a residual that no
        # longer falls, at the scale of rounding, is as far as doubles go.
        stalled, least = (0, size[0]) if size[0] < least / 2 else (stalled + 1, least)
        ended = full or (stalled >= 3 and size[0] < 1e4 * limit)
        done = 0
        while done < min(wanted, len(size)) and (size[done] <= limit or full or (ended and done == 0)):
            done += 1
        if done:
            locked = np.column_stack([locked, ritz[:, :done]])
            values += theta[:done].tolist()
            norms += size[:done].tolist()
            stalled, least = 0, np.inf
            if len(values) == k:
                falling = np.argsort(-np.array(values), kind="stable")
                return np.array(values)[falling], locked[:, falling], np.array(norms)[falling]
            space, image, theta = ritz[:, done:], moved[:, done:], theta[done:]
            ritz, residual, size = space, residual[:, done:], size[done:]
        elif space.shape[1] + wanted > SPACE:
            space, image = ritz[:, :2 * k], moved[:, :2 * k]
        lead = min(k - len(values), residual.shape[1])
        if lead:
            basis = _orthonormal(np.column_stack([locked, ritz[:, :lead]]))
            new = _corrections(times, theta[:lead], residual[:, :lead], basis, INNER)
        else:
            new = rng.normal(size=(width, 1))
        new = _orthonormal(new, locked, space)
        if not new.shape[1]:
            new = _orthonormal(rng.normal(size=(width, 1)), locked, space)
        if new.shape[1]:
            space, image = np.column_stack([space, new]), np.column_stack([image, times(new)])
    raise RuntimeError(f"no convergence in {OUTER} steps")


def fit(clean: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the distinct vectors of ``cleaned`` rows; None without any.
    Components whose eigenvalue is 0 but for rounding can't be whitened and are left out."""
    width = clean.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return None
    blocks = _fit_list(clean, width)
    n, sums = _moments(blocks, width)
    mean = np.array([_quotient(s, n) for s in sums])
    times = _product(blocks, width, n, mean)
    values, vectors, norms = eigenpairs(times, width, components)

    def spread(batches: Iterator[pa.RecordBatch]) -> list | None:
        total = [0.0, 0.0, 0.0]
        for x in _vectors(batches, width):
            c = x - mean
            w = c @ weights
            total = [t + own for t, own in zip(total, (np.einsum("ij,ij->", c, c), w.T @ w, w.sum(0)), strict=True)]
        return total if np.ndim(total[1]) else None

    real = values > width * np.finfo(float).eps * max(values[0], 0)
    values, vectors, norms = values[real], vectors[:, real], norms[real]
    weights = vectors / np.sqrt(values)
    squares, cross, total = tree_sum(blocks, spread)
    covariance = cross / n - np.outer(total / n, total / n)
    error = np.abs(covariance - np.eye(len(values))).max(initial=0.0)
    return Whitening(n, sums, values, vectors, float(squares / n), float(error), norms)


def whiten(clean: DataFrame, model: Whitening | None) -> DataFrame:
    """For each of the ``cleaned`` rows (struct ``row``) and each component: ``component`` from 1, ``n``,
    ``deviation`` (sum over dimensions of (n x - S)^2, exact; beyond a long it ends there),
    ``whitened``, ``explained`` and ``identity_error``.

    Repeated rows stay; without a model, or an empty table, there are no rows; columns
    of the input can't clash (they are in ``row``)."""
    kind = f"row {clean.schema['row'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return clean.limit(0).mapInArrow(lambda batches: iter(()), kind)
    width, k = len(model.sums), len(model.values)
    weights = model.vectors / np.sqrt(model.values)
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, exact = model.mean, np.array(model.sums, object)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                x = _rows(b.column(1), width)
                m = len(x)
                most = model.n * int(np.abs(x.astype(float)).max(initial=0)) + max(abs(s) for s in model.sums)
                if width * most ** 2 < _LONG:
                    off = model.n * x - exact.astype(np.int64)
                    deviation = np.einsum("ij,ij->i", off, off)
                else:
                    off = model.n * x.astype(object) - exact
                    deviation = np.array([min(_LONG, s) for s in (off * off).sum(1)], np.int64)
                own = (x - mean) @ weights
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, model.n)), pa.array(np.repeat(deviation, k)), pa.array(own.ravel()),
                     pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error))],
                    names=["row", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return clean.mapInArrow(run, kind)
