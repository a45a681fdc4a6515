"""A small dense solver that the distributed fit is compared with."""

import numpy as np
import pandas as pd

from tallymix.models import fit
from tallymix.models.design import Design


def newton(
    x: np.ndarray, y: np.ndarray, w: np.ndarray, k: int, prior_sd: float | None, steps: int = 60
) -> np.ndarray:
    """The penalised objective of ``fit_groups`` in one process."""
    p = x.shape[1]
    ridge = np.zeros(p) if prior_sd is None else np.r_[0.0, np.full(p - 1, 1.0 / prior_sd**2)]
    shift = np.zeros(p)
    shift[1:] = np.average(x[:, 1:], axis=0, weights=w) if p > 1 else 0.0
    shift[[j for j in range(1, p) if set(np.unique(x[:, j])) <= {0.0, 1.0}]] = 0.0
    z = x - shift
    target = np.zeros((len(y), k))
    target[np.arange(len(y)), y] = w

    def objective(b):
        eta = z @ b.T
        top = eta.max(axis=1)
        norm = top + np.log(np.exp(eta - top[:, None]).sum(axis=1))
        return (target * eta).sum() - (w * norm).sum() - 0.5 * (b * b * ridge).sum()

    beta = np.zeros((k, p))
    value = objective(beta)
    for _ in range(steps):
        eta = z @ beta.T
        prob = np.exp(eta - eta.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        grad = (target - w[:, None] * prob).T @ z - beta * ridge
        hess = np.zeros((k, p, k, p))
        for a in range(k):
            for b in range(k):
                v = w * prob[:, a] * ((a == b) - prob[:, b])
                hess[a, :, b, :] = (z * v[:, None]).T @ z
            hess[a, np.arange(p), a, np.arange(p)] += ridge
        step = np.linalg.lstsq(hess.reshape(k * p, k * p), grad.ravel(), rcond=1e-13)[0]
        step = step.reshape(k, p)
        rate = 1.0
        while rate > 1e-6 and objective(beta + rate * step) < value - 1e-12 * abs(value):
            rate /= 2
        beta = beta + rate * step
        new = objective(beta)
        if abs(new - value) <= 1e-13 * max(1.0, abs(new)) and np.abs(step).max() < 1e-9:
            break
        value = new
    beta = fit.contrasts(beta)
    beta[:, 0] -= beta[:, 1:] @ shift[1:]
    return beta


def fit_frame(
    pdf: pd.DataFrame, design: Design, n: str, prior_sd: float | None
) -> pd.DataFrame:
    """Contrasts of one set of cells as a pandas frame (category, term, estimate)."""
    codes = {v: i for i, v in enumerate(design.levels)}
    y = pdf[design.category].map(codes).to_numpy(dtype="int64")
    w = pdf[n].to_numpy(dtype="float64")
    beta = newton(design.matrix(pdf), y, w, len(design.levels), prior_sd)
    return pd.DataFrame(
        {
            "category": np.repeat(list(design.levels)[1:], len(design.terms)),
            "term": design.terms * (len(design.levels) - 1),
            "estimate": beta[1:].ravel(),
        }
    )
