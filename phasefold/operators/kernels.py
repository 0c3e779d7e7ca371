"""Numpy kernels: weighted averages and weighted linear maps over neighbours, and closed-loop states."""

from __future__ import annotations

import numpy as np


def lag_stack(x: np.ndarray, dimensions: int, step: int) -> np.ndarray:
    """Rows of lags grouped by column; NaN where a lag leaves the run."""
    n, v = x.shape
    out = np.full((n, v * dimensions), np.nan)
    for i in range(dimensions):
        at = np.arange(n) + i * step
        ok = (at >= 0) & (at < n)
        out[ok, i::dimensions] = x[at[ok]]
    return out


def simplex_fit(d: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prediction and variance from distances [q, k] and targets [q, k, t]; infinite distances weigh nothing."""
    least = np.maximum(d.min(1, keepdims=True), 1e-6)
    with np.errstate(invalid="ignore", divide="ignore"):
        w = np.where(np.isfinite(d), np.exp(-d / least), 0.0)[..., None]
        y = np.where(w > 0, y, 0.0)
        total = w.sum(1)
        p = (w * y).sum(1) / total
        return p, (w * (y - p[:, None]) ** 2).sum(1) / total


def smap_fit(d: np.ndarray, S: np.ndarray, y: np.ndarray, q: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prediction, variance, coefficients and singular values of one query's weighted linear map, per target."""
    w = np.ones(len(d)) if theta == 0 else np.exp(-theta * d / max(d.mean(), 1e-10))
    m, t = S.shape[1] + 1, y.shape[1]
    pred, var, coef, sv = np.full(t, np.nan), np.full(t, np.nan), np.full((t, m), np.nan), np.full((t, m), np.nan)
    A = np.column_stack([np.ones(len(S)), S])
    for j in range(t):
        ok = np.isfinite(y[:, j])
        if not ok.any():
            continue
        wj = np.where(ok, w, 0.0)
        yj = np.where(ok, y[:, j], 0.0)
        c, _, _, s = np.linalg.lstsq(A * wj[:, None], yj * wj, rcond=None)
        coef[j], pred[j] = c, c[0] + c[1:] @ q
        sv[j, : len(s)] = s
        var[j] = (wj * (yj - pred[j]) ** 2).sum() / wj.sum()
    return pred, var, coef, sv
