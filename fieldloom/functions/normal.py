"""The normal law on numpy arrays: the error function, and masses of rectangles with and without correlation."""

from __future__ import annotations

import numpy as np

# W. J. Cody's rational approximations of erf (1969), for |x| up to 0.46875, up to 4, and beyond.
_A = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
_B = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
_C = (
    2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2,
    8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3,
)
_D = (
    1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
    3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3,
)
_P = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
_Q = (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def erf(x: np.ndarray) -> np.ndarray:
    """The error function to double precision."""
    x = np.asarray(x, dtype=float)
    a = np.minimum(np.abs(x), 30.0)
    near = x * np.polyval(_A, a * a) / np.polyval(_B, a * a)
    mid = np.exp(-a * a) * np.polyval(_C, a) / np.polyval(_D, a)
    inverse = 1 / np.maximum(a, 1.0) ** 2
    far = np.exp(-a * a) / np.maximum(a, 1.0) * (1 / np.sqrt(np.pi) - inverse * np.polyval(_P, inverse) / np.polyval(_Q, inverse))
    return np.where(a <= 0.46875, near, np.sign(x) * (1 - np.where(a <= 4, mid, far)))


def interval_mass(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Mass of the standard normal law between low and high."""
    return (erf(high / np.sqrt(2)) - erf(low / np.sqrt(2))) / 2


def rectangle_mass(x: np.ndarray, y: np.ndarray, bounds: tuple[float, float, float, float], matrix: np.ndarray, panels: int = 16, order: int = 24) -> np.ndarray:
    """Mass inside a rectangle (x_min, y_min, x_max, y_max) of normal laws with means (x, y) and one covariance matrix: the law of y
    given x, integrated over x by Gauss-Legendre panels on what lies within nine deviations."""
    x0, y0, x1, y1 = bounds
    sx, slope = np.sqrt(matrix[0, 0]), matrix[0, 1] / matrix[0, 0]
    sy = np.sqrt(matrix[1, 1] - matrix[0, 1] * slope)
    low, high = np.clip((x0 - x) / sx, -9, 9), np.clip((x1 - x) / sx, -9, 9)
    nodes, weights = np.polynomial.legendre.leggauss(order)
    total, step = np.zeros(len(x)), (high - low) / panels
    for k in range(panels):
        z = (low + (k + 0.5) * step)[:, None] + step[:, None] / 2 * nodes
        mean = y[:, None] + slope * sx * z
        inner = interval_mass((y0 - mean) / sy, (y1 - mean) / sy)
        total += step / 2 * ((np.exp(-z * z / 2) / np.sqrt(2 * np.pi) * inner) @ weights)
    return total
