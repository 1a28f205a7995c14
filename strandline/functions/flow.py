"""Dense motion between planes by polynomial expansion, and the temporal error built on it.

Every neighbourhood is fitted by a quadratic under a Gaussian weight.  If one plane's quadratic has the
coefficients (A, b) and the other's is the same one moved by d, then b changes by -2 A d; a least-squares
fit of that over a window gives d.  It is iterated around the last guess, from coarse planes to fine ones.
All functions take planes [..., H, W]: the leading axes are pairs that are worked out side by side.
"""

from __future__ import annotations

import numpy as np

POLY_RADIUS, POLY_SIGMA, WINDOW, ROUNDS, LEVELS, LEAST_SIDE = 5, 1.2, 15, 3, 3, 32


def _along(x: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """x under an odd kernel laid along one axis, the border repeated."""
    r = len(kernel) // 2
    pad = [(0, 0)] * x.ndim
    pad[axis] = (r, r)
    p, n = np.pad(x, pad, mode="edge"), x.shape[axis]
    out = np.zeros_like(x)
    for k, v in enumerate(kernel):
        out += v * np.take(p, range(k, k + n), axis=axis)
    return out


def smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    if sigma <= 0:
        return x
    r = max(1, int(round(3 * sigma)))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    return _along(_along(x, k / k.sum(), -1), k / k.sum(), -2)


def expansion(x: np.ndarray, radius: int = POLY_RADIUS, sigma: float = POLY_SIGMA) -> np.ndarray:
    """[5, ..., H, W]: coefficients of u, v, u*u, v*v and u*v (u to the right, v down) of the best quadratic around each pixel."""
    t = np.arange(-radius, radius + 1)
    w = np.exp(-(t**2) / (2 * sigma * sigma))
    w /= w.sum()
    powers = [(0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1)]
    moment = [(w * t**n).sum() for n in range(5)]
    normal = np.array([[moment[a + c] * moment[b + d] for c, d in powers] for a, b in powers])
    across = [_along(x, w * t**n, -1) for n in range(3)]
    seen = np.stack([_along(across[a], w * t**b, -2) for a, b in powers])
    return np.tensordot(np.linalg.inv(normal), seen, (1, 0))[1:]


def _sampled(x: np.ndarray, at_x: np.ndarray, at_y: np.ndarray) -> np.ndarray:
    """x [C, ..., H, W] at places [..., H, W], bilinear, the border repeated."""
    h, w = x.shape[-2:]
    px, py = np.clip(at_x, 0, w - 1), np.clip(at_y, 0, h - 1)
    x0, y0 = np.floor(px).astype(int), np.floor(py).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = px - x0, py - y0
    flat = x.reshape(*x.shape[:-2], h * w)
    pick = lambda y, z: np.take_along_axis(flat, np.broadcast_to((y * w + z).reshape(*at_x.shape[:-2], h * w), flat.shape), -1).reshape(x.shape)
    return (pick(y0, x0) * (1 - fx) + pick(y0, x1) * fx) * (1 - fy) + (pick(y1, x0) * (1 - fx) + pick(y1, x1) * fx) * fy


def refined(a: np.ndarray, b: np.ndarray, dx: np.ndarray, dy: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """One round: the motion between two expansions around a guess of it."""
    h, w = dx.shape[-2:]
    yy, xx = np.mgrid[:h, :w]
    moved = _sampled(b, xx + dx, yy + dy)
    p, q, r = (a[2] + moved[2]) / 2, (a[3] + moved[3]) / 2, (a[4] + moved[4]) / 4  # the matrix [[p, r], [r, q]]
    u = (a[0] - moved[0]) / 2 + p * dx + r * dy
    v = (a[1] - moved[1]) / 2 + r * dx + q * dy
    k = np.full(window, 1.0 / window)
    mean = lambda x: _along(_along(x, k, -1), k, -2)
    g11, g12, g22, h1, h2 = (mean(x) for x in (p * p + r * r, r * (p + q), q * q + r * r, p * u + r * v, r * u + q * v))
    det = g11 * g22 - g12 * g12 + 1e-3
    return (g22 * h1 - g12 * h2) / det, (g11 * h2 - g12 * h1) / det


def _resized(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """x [..., H, W] at another size, bilinear, pixel centres aligned."""
    yy, xx = np.mgrid[:h, :w]
    at_x, at_y = (xx + 0.5) * x.shape[-1] / w - 0.5, (yy + 0.5) * x.shape[-2] / h - 0.5
    px, py = np.clip(at_x, 0, x.shape[-1] - 1), np.clip(at_y, 0, x.shape[-2] - 1)
    x0, y0 = np.floor(px).astype(int), np.floor(py).astype(int)
    x1, y1 = np.minimum(x0 + 1, x.shape[-1] - 1), np.minimum(y0 + 1, x.shape[-2] - 1)
    fx, fy = px - x0, py - y0
    return (x[..., y0, x0] * (1 - fx) + x[..., y0, x1] * fx) * (1 - fy) + (x[..., y1, x0] * (1 - fx) + x[..., y1, x1] * fx) * fy


def dense_flow(a: np.ndarray, b: np.ndarray, levels: int = LEVELS, window: int = WINDOW, rounds: int = ROUNDS, least: int = LEAST_SIDE) -> tuple[np.ndarray, np.ndarray]:
    """dx, dy [..., H, W] such that b at (x + dx, y + dy) looks like a at (x, y).

    Planes are halved at most `levels` times, while their sides stay at `least` or more."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    h, w = a.shape[-2:]
    top = 0
    while top < levels and min(h, w) * 0.5 ** (top + 1) >= least:
        top += 1
    dx = dy = None
    for k in range(top, -1, -1):
        scale = 0.5**k
        size = (max(round(h * scale), 1), max(round(w * scale), 1))
        planes = [_resized(smoothed(x, (1 / scale - 1) * 0.5), *size) if k else x for x in (a, b)]
        if dx is None:
            dx = dy = np.zeros(planes[0].shape)
        else:
            before = dx.shape[-2:]
            dx, dy = _resized(dx, *size) * size[1] / before[1], _resized(dy, *size) * size[0] / before[0]
        own, other = (expansion(x) for x in planes)
        for _ in range(rounds):
            dx, dy = refined(own, other, dx, dy, window)
    return dx, dy


def motion_error(before: np.ndarray, now: np.ndarray, truth_before: np.ndarray, truth_now: np.ndarray) -> np.ndarray:
    """Mean length of the difference between the motion of two planes and that of the true ones, for each pair [...]."""
    dx, dy = dense_flow(before, now)
    tx, ty = dense_flow(truth_before, truth_now)
    return np.hypot(tx - dx, ty - dy).mean((-2, -1))
