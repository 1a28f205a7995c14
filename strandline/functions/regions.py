"""Kernels over windows and regions of planes: summed areas, overlays, non-local means, components of masks, carried grain."""

from __future__ import annotations

import numpy as np

from . import kernels

WHITE, DARK = 235, 20  # levels beyond which a pixel is bright or dark
BOTH = 0.06  # least share of either in a window of lettering
MOVING = {"size": 13, "motion": 0.6, "grow": 9}
STATIC = {"size": 51, "motion": 0.25, "grow": 15}


def window_mean(x: np.ndarray, size: int) -> np.ndarray:
    """Mean over a size x size window around each pixel of [..., H, W], the border mirrored; four reads of a summed-area table, whatever the size."""
    r = size // 2
    h, w = x.shape[-2:]
    pad = [(0, 0)] * (x.ndim - 2) + [(r, size - 1 - r)] * 2
    p = np.pad(np.asarray(x, float), pad, "reflect" if min(h, w) > r else "symmetric")
    s = np.zeros((*p.shape[:-2], p.shape[-2] + 1, p.shape[-1] + 1))
    np.cumsum(np.cumsum(p, -2), -1, out=s[..., 1:, 1:])
    return (s[..., size:, size:] - s[..., :-size, size:] - s[..., size:, :-size] + s[..., :-size, :-size]) / size**2


def lettering(x: np.ndarray, size: int, white: float = WHITE, dark: float = DARK) -> np.ndarray:
    """Of the shares of bright and of dark pixels around each pixel the smaller one: high only where both stand close together."""
    return np.minimum(window_mean(x > white, size), window_mean(x < dark, size))


def overlay(x: np.ndarray, mag: np.ndarray, moving: bool, both: float = BOTH, white: float = WHITE, dark: float = DARK, size: int | None = None, motion: float | None = None, grow: int | None = None) -> np.ndarray:
    """Mask of lettering that moves, or that stands still while a pixel without a vector counts as still, grown by an ellipse.

    mag: length of each pixel's vector, NaN without one."""
    own = (MOVING if moving else STATIC) | {k: v for k, v in (("size", size), ("motion", motion), ("grow", grow)) if v is not None}
    speed = np.nan_to_num(mag)
    found = (lettering(x, own["size"], white, dark) > both) & (speed > own["motion"] if moving else speed < own["motion"])
    return kernels.dilated(found, own["grow"]) if own["grow"] >= 3 else found


def box_of(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """x0, y0, x1, y1 (half open) around the true pixels; None without any."""
    ys, xs = np.nonzero(mask)
    return (int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1) if len(ys) else None


def non_local_means(x: np.ndarray, strength: float = 6.0, patch: int = 5, search: int = 11) -> np.ndarray:
    """Each pixel as the mean of those in a search window, weighted by how alike the patches around both are.

    For each offset the squared differences of all pixels are summed over patches at once."""
    x = np.asarray(x, float)
    r, q, (h, w) = search // 2, patch // 2, x.shape
    m = r + q
    p = np.pad(x, m, "reflect" if min(h, w) > m else "symmetric")
    own = p[r : r + h + 2 * q, r : r + w + 2 * q]
    total, norm = np.zeros_like(x), np.zeros_like(x)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            other = p[r + dy : r + dy + h + 2 * q, r + dx : r + dx + w + 2 * q]
            s = np.zeros((h + 2 * q + 1, w + 2 * q + 1))
            np.cumsum(np.cumsum((own - other) ** 2, 0), 1, out=s[1:, 1:])
            gap = (s[patch:, patch:] - s[:-patch, patch:] - s[patch:, :-patch] + s[:-patch, :-patch]) / patch**2
            k = np.exp(-np.maximum(gap, 0.0) / (strength * strength))
            total += k * other[q : q + h, q : q + w]
            norm += k
    return total / norm


#: Ways to take noise off a plane.
DENOISERS = {
    "gauss": lambda x: kernels.gaussian(x, 0.8, 1),
    "median": kernels.median3,
    "bilateral": lambda x: kernels.bilateral(x, 2, 5.0, 40.0),
    "nlm": non_local_means,
}


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's tree, n nodes with links (u, v): larger roots are hung under smaller ones, then paths shortened, until no link joins two trees."""
    up = np.arange(n)
    while len(u):
        a, b = up[u], up[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
    return up


class Runs:
    """True pixels of masks [N, H, W] as runs along rows, and the region of each run: runs that touch, also by a corner, are in one region.

    All masks are labelled side by side; links join a run to those of the row below that it meets."""

    def __init__(self, masks: np.ndarray, corners: bool = True):
        n, h, w = masks.shape
        edge = np.diff(np.pad(masks.astype(np.int8), ((0, 0), (0, 0), (1, 1))), axis=-1)
        self.frame, self.y, self.x0 = np.nonzero(edge > 0)
        self.x1 = np.nonzero(edge < 0)[2]
        step = w + 4
        line = (self.frame * (h + 1) + self.y) * step
        begin, end, reach = line + self.x0, line + self.x1, int(corners)
        below = step + line
        lo = np.searchsorted(end, below + self.x0 - reach, "right")
        hi = np.searchsorted(begin, below + self.x1 + reach, "left")
        many = np.maximum(hi - lo, 0)
        u = np.repeat(np.arange(len(begin)), many)
        v = np.arange(len(u)) - np.repeat(np.cumsum(many) - many, many) + lo[u]
        self.region = roots(u, v, len(begin))
        self.n = n

    def regions(self) -> dict[str, np.ndarray]:
        """frame, pixels and box (x0, y0, x1, y1, half open) of each region."""
        first, at = np.unique(self.region, return_inverse=True)
        k = len(first)
        least, most = (lambda v: _reduced(np.minimum, at, v, k)), (lambda v: _reduced(np.maximum, at, v, k))
        pixels = np.bincount(at, self.x1 - self.x0, k).astype(np.int64)
        return {"frame": self.frame[first], "pixels": pixels, "x0": least(self.x0), "y0": least(self.y), "x1": most(self.x1), "y1": most(self.y) + 1}

    def by_frame(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each mask: regions, share of the largest one in the true pixels, and true pixels over the area of all boxes; zeros without any."""
        r = self.regions()
        count = np.bincount(r["frame"], minlength=self.n)
        total = np.bincount(r["frame"], r["pixels"], self.n)
        largest = _reduced(np.maximum, r["frame"], r["pixels"], self.n, 0)
        area = np.bincount(r["frame"], (r["x1"] - r["x0"]) * (r["y1"] - r["y0"]), self.n)
        return count, largest / np.maximum(total, 1), total / np.maximum(area, 1)


def _reduced(fn, at: np.ndarray, values: np.ndarray, n: int, empty: int | None = None) -> np.ndarray:
    out = np.full(n, empty if empty is not None else (np.iinfo(np.int64).max if fn is np.minimum else -1), np.int64)
    fn.at(out, at, values)
    return out


def template(h: int, w: int, seed: int = 0, blur: float = 0.8) -> np.ndarray:
    """Grain of unit deviation."""
    unit = kernels.gaussian(np.random.default_rng(seed).standard_normal((h, w)), blur)
    return unit / (unit.std() or 1.0)


def carried(grain: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """Grain of the frame before carried along the motion (NaN: none), of unit deviation again, which interpolation lowers."""
    out = kernels.backward_warp(grain, dx, dy)
    return out / (out.std() or 1.0)


def frozen_grain(fields: list[tuple[np.ndarray, np.ndarray]], sigma: float, seed: int = 0) -> list[np.ndarray]:
    """Grain of the frames of a chunk that moves with what it lies on; fields: dx, dy of each frame, the first one's are not used."""
    h, w = fields[0][0].shape
    out = [template(h, w, seed)]
    for dx, dy in fields[1:]:
        out.append(carried(out[-1], dx, dy))
    return [sigma * g for g in out]
