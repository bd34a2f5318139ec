"""Largest eigenpairs of a symmetric operator that is known by its products only.

Block Jacobi-Davidson: a search space with its image gives Ritz pairs; for those that are
wanted and not exact yet, the correction equation, projected against what is locked and
wanted, is solved by some MINRES steps at once for all of them, and the corrections widen the
space.  Pairs whose residual is at rounding are locked, from the largest on, and leave the
search.  The space starts anew from its best Ritz vectors when it is at its limit.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Product = Callable[[np.ndarray], np.ndarray]

EXTRA = 8  # vectors that search besides the wanted ones
INNER = 6  # MINRES steps of a correction
SPACE = 4  # most vectors of the space, in multiples of the block
ROUNDS = 300


def apart(vectors: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Orthonormal basis of what ``vectors`` have outside the bases; less where they have nothing."""
    norms = np.linalg.norm(vectors, axis=0)
    vectors = vectors[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        for basis in bases:
            vectors = vectors - basis @ (basis.T @ vectors)
    if not vectors.size:
        return vectors
    left, size, _ = np.linalg.svd(vectors, full_matrices=False)
    left = left[:, size > 1e-8]
    for basis in bases:
        left = left - basis @ (basis.T @ left)
    return np.linalg.qr(left)[0]


def minres(apply: Product, target: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions, column by column; one product a step serves all columns."""
    length = lambda x: np.linalg.norm(x, axis=0)
    over = lambda a, b: np.divide(a, b, out=np.zeros(np.broadcast_shapes(np.shape(a), np.shape(b))), where=b > 0)
    beta = length(target)
    eta, zero = beta.copy(), np.zeros_like(beta)
    v, v_old = over(target, beta), np.zeros_like(target)
    w = w_old = x = np.zeros_like(target)
    c = c_old = np.ones_like(beta)
    s, s_old, beta = zero, zero, zero
    for _ in range(steps):
        image = apply(v)
        alpha = (v * image).sum(axis=0)
        image = image - alpha * v - beta * v_old
        following = length(image)
        delta = c * alpha - c_old * s * beta
        first = np.hypot(delta, following)
        second, third = s * alpha + c_old * c * beta, s_old * beta
        c_old, s_old = c, s
        c, s = over(delta, first), over(following, first)
        w, w_old = over(v - third * w_old - second * w, first), w
        x = x + c * eta * w
        eta = -s * eta
        v, v_old, beta = over(image, following), v, following
    return x


def largest(product: Product, dimension: int, wanted: int, inner: int = INNER, extra: int = EXTRA) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of the ``wanted`` largest eigenvalues."""
    eps = np.finfo(float).eps
    block = min(dimension, wanted + extra)
    basis = np.linalg.qr(np.random.default_rng(0).standard_normal((dimension, block)))[0]
    image = product(basis)
    locked = np.zeros((dimension, 0))
    values: list[float] = []
    scale = 0.0
    for _ in range(ROUNDS):
        inside = basis.T @ image
        ritz, turn = np.linalg.eigh((inside + inside.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        left = wanted - len(values)
        rest = image[:, :left] - basis[:, :left] * ritz[:left]
        rest -= locked @ (locked.T @ rest)
        scale = max(scale, abs(ritz).max())
        exact = np.linalg.norm(rest, axis=0) <= 16 * eps * np.sqrt(dimension) * scale
        whole = locked.shape[1] + basis.shape[1] == dimension  # no direction is left to search
        done = left if whole else int(np.argmin(np.append(exact, False)))
        values += ritz[:done].tolist()
        locked = np.concatenate([locked, basis[:, :done]], axis=1)
        basis, image, ritz, rest = basis[:, done:], image[:, done:], ritz[done:], rest[:, done:]
        if len(values) == wanted:
            break
        left -= done
        aside = np.concatenate([locked, basis[:, :left]], axis=1)
        project = lambda x: x - aside @ (aside.T @ x)
        shift = ritz[:left]
        wider = minres(lambda x: project(product(x) - x * shift), project(-rest), inner)
        if basis.shape[1] + left > SPACE * block:
            basis, image = basis[:, :block], image[:, :block]
        wider = apart(wider, locked, basis)
        if not wider.shape[1]:  # corrections within the space: search elsewhere
            wider = apart(np.random.default_rng(len(values)).standard_normal((dimension, min(block, dimension))), locked, basis)
        basis, image = np.concatenate([basis, wider], axis=1), np.concatenate([image, product(wider)], axis=1)
    else:
        raise RuntimeError(f"{len(values)} of {wanted} eigenpairs after {ROUNDS} rounds")
    # the locked vectors once more among themselves, so that none leans on another
    locked = np.linalg.qr(locked)[0]
    inside = locked.T @ product(locked)
    found, turn = np.linalg.eigh((inside + inside.T) / 2)
    return found[::-1], (locked @ turn)[:, ::-1]
