"""Largest eigenpairs of a symmetric matrix that is known only by its products with blocks of vectors.

Jacobi-Davidson: Rayleigh-Ritz on a small subspace gives the nearest pairs; for each, a correction is sought
orthogonal to it and to all pairs found, from the projected equation (I-ZZ')(A-theta I)(I-ZZ') t = -r, which
MINRES solves in part; the corrections widen the subspace. All pairs are corrected in lockstep, so that a
step costs one product of the matrix with one narrow block. What lives here is as large as the vectors are
long, never as large as the data.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Vectors beside the wanted ones, steps of MINRES at a time, vectors of the subspace, turns before giving up.
GUARDS, STEPS, WIDTH, TURNS = 12, 3, 60, 200
#: Turns after the last pair was found, in which a greater one would show.
HUNT = 2

Product = Callable[[np.ndarray], np.ndarray]


def _orthonormal(new: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """The columns of `new`, orthogonal to each other and to the others; those that depend on the rest fall out."""
    kept: list[np.ndarray] = []
    for column in new.T:
        before = np.linalg.norm(column)
        for _ in range(3):
            for basis in others:
                column = column - basis @ (basis.T @ column)
            for basis in kept:
                column = column - basis * (basis @ column)
        size = np.linalg.norm(column)
        if size > 1e-8 * before and size > 0:
            kept.append(column / size)
    return np.array(kept).T.reshape(len(new), len(kept))


def minres(apply: Product, target: np.ndarray, steps: int = STEPS, tolerance: float = 0.0) -> np.ndarray:
    """Solves apply(x) = target, column by column in lockstep, until all residuals have shrunk to `tolerance`."""
    size = np.linalg.norm(target, axis=0)
    x, v_old, w_old, w = (np.zeros_like(target) for _ in range(4))
    open_ = size > 0
    v = np.divide(target, size, out=np.zeros_like(target), where=open_)
    eta, beta = size.copy(), size.copy()
    c_old, c = np.ones_like(size), np.ones_like(size)
    s_old, s = np.zeros_like(size), np.zeros_like(size)
    for _ in range(steps):
        if not open_.any():
            break
        image = apply(v)
        alpha = (v * image).sum(axis=0)
        v_next = image - alpha * v - beta * v_old
        beta_next = np.linalg.norm(v_next, axis=0)
        # A rotation more brings the tridiagonal matrix of the Lanczos process to upper triangular form.
        diagonal = c * alpha - c_old * s * beta
        length = np.hypot(diagonal, beta_next)
        above, above_two = s * alpha + c_old * c * beta, s_old * beta
        open_ &= length > 0
        safe = np.where(open_, length, 1.0)
        w_next = np.where(open_, (v - above_two * w_old - above * w) / safe, 0.0)
        c_old, c, s_old, s = c, diagonal / safe, s, beta_next / safe
        x += np.where(open_, c * eta, 0.0) * w_next
        eta = np.where(open_, -s * eta, eta)
        open_ &= (np.abs(eta) > tolerance * size) & (beta_next > 1e-14 * size)
        v_old, v = v, np.where(open_, v_next / np.where(beta_next > 0, beta_next, 1.0), 0.0)
        w_old, w, beta = w, w_next, beta_next
    return x


def largest_pairs(product: Product, size: int, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the `wanted` largest pairs of a matrix without negative values, falling.

    A pair is locked when the residual of a fresh product is at most size * 2.2e-16 times the largest value,
    which is what rounding leaves; pairs found go out of the subspace. Raises if that is not reached.
    """
    wanted = min(wanted, size)
    narrow = min(size, wanted + GUARDS)
    rounding = size * np.finfo(float).eps
    locked, values = np.zeros((size, 0)), np.zeros(0)
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((size, narrow)))
    image = product(basis)
    scale, hunted = 0.0, 0
    for turn in range(TURNS):
        inner = basis.T @ image
        theta, y = np.linalg.eigh((inner + inner.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        ritz, image = basis @ y, image @ y
        scale = max(scale, *np.abs(theta), *values) if len(theta) else scale
        if len(values) == wanted and len(theta) and theta[0] > values.min() + 2 * rounding * scale:
            # A greater pair than one of those found: back to the subspace with all.
            basis = _orthonormal(np.hstack([locked, ritz]))
            locked, values, image, hunted = np.zeros((size, 0)), np.zeros(0), product(basis), 0
            continue
        if len(values) == wanted and (hunted == HUNT or not len(theta)):
            break
        hunted += len(values) == wanted
        aims = max(1, wanted - len(values))
        residual = image[:, :aims] - ritz[:, :aims] * theta[:aims]
        left = np.linalg.norm(residual, axis=0)
        near = int(np.append(left > rounding * scale, True).argmax())
        if near and len(values) < wanted:
            fresh = product(ritz[:, :near])
            value = (ritz[:, :near] * fresh).sum(axis=0)
            true = np.linalg.norm(fresh - ritz[:, :near] * value, axis=0)
            done = int(np.append(true > rounding * scale, True).argmax())
            locked, values = np.hstack([locked, ritz[:, :done]]), np.append(values, value[:done])
            basis, image = ritz[:, done:], image[:, done:]
            if not done:
                # The images have drifted from the vectors: made anew.
                basis = _orthonormal(ritz[:, :narrow], locked)
                image = product(basis)
            continue
        if ritz.shape[1] > WIDTH:
            ritz, image = ritz[:, :narrow], image[:, :narrow]
        aim, shift = ritz[:, :aims], theta[:aims]
        found = np.hstack([locked, aim])

        def away(t):
            return t - found @ (found.T @ t)  # noqa: B023

        def apply(t):
            return away(product(t) - t * shift)  # noqa: B023

        step = minres(apply, away(-residual), STEPS, max(0.5 ** (turn + 1), 1e-4))
        new = _orthonormal(np.hstack([step, residual]), locked, ritz)
        if not new.shape[1]:
            # Nothing is left outside: the subspace is whole, and only rounding keeps pairs open.
            basis = _orthonormal(ritz, locked)
            image = product(basis)
            continue
        basis, image = np.hstack([ritz, new]), np.hstack([image, product(new)])
    else:
        raise ArithmeticError(f"{len(values)} of {wanted} pairs after {TURNS} turns; residuals {left}, largest value {scale}")
    order = np.argsort(-values, kind="stable")
    return values[order], locked[:, order]
