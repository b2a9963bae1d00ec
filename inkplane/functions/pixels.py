"""Numbers of page images, on arrays of gray levels."""

from __future__ import annotations

import numpy as np


def laplacian_variance(gray: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian, edges mirrored: low where an image is blurred."""
    g = np.pad(gray.astype(np.float64), 1, mode="reflect")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def blur_tier(variance: float) -> str:
    return "good" if variance >= 100 else "mild" if variance >= 50 else "severe"


def otsu(gray: np.ndarray) -> int:
    """The gray level that parts dark from light with the greatest variance between them."""
    counts = np.bincount(gray.ravel(), minlength=256).astype(np.float64)
    below, mass = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nan_to_num(spread).argmax())


def _row_variance(ys: np.ndarray, xs: np.ndarray, degrees: float) -> float:
    turned = np.round(ys * np.cos(np.radians(degrees)) - xs * np.sin(np.radians(degrees))).astype(int)
    return float(np.bincount(turned - turned.min()).var())


def skew(gray: np.ndarray, most: float = 15.0) -> float:
    """Degrees by which text lines are turned: the angle at which row sums of ink vary most; 0 below 0.3 or with little ink."""
    step = max(1, -(-max(gray.shape) // 900))
    small = gray[::step, ::step]
    ys, xs = np.nonzero(small <= otsu(small))
    if len(ys) < 200:
        return 0.0
    best = max(np.arange(-most, most + 0.5, 1.0), key=lambda a: _row_variance(ys, xs, a))
    fine = max(np.arange(best - 1, best + 1.05, 0.1), key=lambda a: _row_variance(ys, xs, a))
    return 0.0 if abs(fine) < 0.3 else round(float(fine), 2)
