"""Dense kernels over one plane or image, in numpy: metrics, resampling, filters, grain, components.

Planes are float64 arrays [H, W], images [H, W, 3]; borders mirror without repeating the edge unless a
function says otherwise.
"""

from __future__ import annotations

import numpy as np


def _padded(x: np.ndarray, r: int, mode: str = "reflect") -> np.ndarray:
    return np.pad(x, [(r, r), (r, r)] + [(0, 0)] * (x.ndim - 2), mode if min(x.shape[:2]) > r or mode == "edge" else "symmetric")


def correlate(x: np.ndarray, kernel: np.ndarray, mode: str = "reflect") -> np.ndarray:
    """x with an odd square kernel laid over each pixel."""
    r = kernel.shape[0] // 2
    p = _padded(x, r, mode)
    h, w = x.shape[:2]
    return sum(kernel[i, j] * p[i : i + h, j : j + w] for i in range(kernel.shape[0]) for j in range(kernel.shape[1]))


def gaussian(x: np.ndarray, sigma: float, radius: int | None = None) -> np.ndarray:
    """Separable Gaussian blur."""
    if sigma <= 0:
        return x.astype(float)
    r = radius if radius is not None else max(1, int(round(3 * sigma)))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    p = _padded(x.astype(float), r)
    h, w = x.shape[:2]
    rows = sum(k[i] * p[i : i + h] for i in range(2 * r + 1))
    return sum(k[j] * rows[:, j : j + w] for j in range(2 * r + 1))


def box(x: np.ndarray, size: int) -> np.ndarray:
    return correlate(x.astype(float), np.full((size, size), 1.0 / size**2))


def psnr(a: np.ndarray, b: np.ndarray) -> float:
    mse = float(np.mean((a.astype(float) - b.astype(float)) ** 2))
    return float("inf") if mse <= 1e-12 else float(10 * np.log10(65025.0 / mse))


def ssim(a: np.ndarray, b: np.ndarray, sigma: float = 1.5, radius: int = 5) -> float:
    """Structural similarity of two planes under an 11x11 Gaussian window."""
    a, b = a.astype(float), b.astype(float)
    g = lambda x: gaussian(x, sigma, radius)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    ma, mb = g(a), g(b)
    va, vb, cov = g(a * a) - ma * ma, g(b * b) - mb * mb, g(a * b) - ma * mb
    return float(np.mean((2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))))


def halved(x: np.ndarray) -> np.ndarray:
    h, w = x.shape[0] // 2 * 2, x.shape[1] // 2 * 2
    x = x[:h, :w].astype(float)
    return (x[::2, ::2] + x[1::2, ::2] + x[::2, 1::2] + x[1::2, 1::2]) / 4


def ms_ssim(a: np.ndarray, b: np.ndarray, weights: tuple[float, ...] = (0.0448, 0.2856, 0.3001)) -> float:
    """Product of similarities at halved scales, weights made to sum to one."""
    out = 1.0
    for w in np.array(weights) / sum(weights):
        out *= max(ssim(a, b), 1e-6) ** w
        a, b = halved(a), halved(b)
    return float(out)


NOWHERE = 1e6
SOBEL = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], float)
LAPLACE = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float)
NOISE = np.array([[1, -2, 1], [-2, 4, -2], [1, -2, 1]], float)


def gradient(x: np.ndarray) -> np.ndarray:
    return np.hypot(correlate(x.astype(float), SOBEL), correlate(x.astype(float), SOBEL.T))


def gradient_fidelity(a: np.ndarray, b: np.ndarray) -> float:
    return psnr(gradient(a), gradient(b))


def var_laplacian(x: np.ndarray, mask: np.ndarray | None = None) -> float:
    lap = correlate(x.astype(float), LAPLACE)
    lap = lap[mask] if mask is not None else lap
    return float(lap.var()) if lap.size else float("nan")


def spectrum_share(x: np.ndarray, cutoff: float = 0.25, power: bool = True) -> float:
    """Share of the spectrum (power or amplitude) beyond cutoff times the Nyquist frequency, the mean left out."""
    f = np.abs(np.fft.fft2(x.astype(float) - x.mean()))
    f = f * f if power else f
    r = np.hypot(np.fft.fftfreq(x.shape[0])[:, None], np.fft.fftfreq(x.shape[1])[None]) / 0.5
    total = f.sum()
    return float(f[r > cutoff].sum() / total) if total > 0 else 0.0


def remap(x: np.ndarray, at_x: np.ndarray, at_y: np.ndarray) -> np.ndarray:
    """Bilinear samples; places beyond the border take its value."""
    h, w = x.shape[:2]
    px, py = np.clip(at_x, 0, w - 1), np.clip(at_y, 0, h - 1)
    x0, y0 = np.floor(px).astype(int), np.floor(py).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = px - x0, py - y0
    if x.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    return (x[y0, x0] * (1 - fx) + x[y0, x1] * fx) * (1 - fy) + (x[y1, x0] * (1 - fx) + x[y1, x1] * fx) * fy


def sampled(x: np.ndarray, at_x: np.ndarray, at_y: np.ndarray, constant: float) -> np.ndarray:
    """Bilinear samples of a plane that is `constant` everywhere beyond its border."""
    h, w = x.shape
    p = np.pad(x.astype(float), 1, constant_values=constant)
    return remap(p, np.clip(at_x, -1, w) + 1, np.clip(at_y, -1, h) + 1)


def backward_warp(x: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """x sampled at each pixel plus its vector; a missing vector (NaN) is no motion."""
    h, w = dx.shape
    yy, xx = np.mgrid[:h, :w]
    return remap(x.astype(float), xx + np.nan_to_num(dx), yy + np.nan_to_num(dy))


def splat(value: np.ndarray, dx: np.ndarray, dy: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Softmax forward splat of a plane; pixels without a vector or a weight go nowhere, NaN where nothing lands."""
    h, w = value.shape
    yy, xx = np.mgrid[:h, :w]
    tx, ty = xx + np.nan_to_num(dx), yy + np.nan_to_num(dy)
    goes = np.isfinite(dx) & np.isfinite(dy) & np.isfinite(weight)
    if not goes.any():
        return np.full((h, w), np.nan)
    e = np.where(goes, np.exp(np.where(goes, weight, 0.0) - weight[goes].max()), 0.0)
    x0, y0 = np.floor(tx).astype(int), np.floor(ty).astype(int)
    total, norm = np.zeros(h * w), np.zeros(h * w)
    for ox in (0, 1):
        for oy in (0, 1):
            x, y = x0 + ox, y0 + oy
            share = (1 - np.abs(tx - x)) * (1 - np.abs(ty - y)) * e
            ok = (x >= 0) & (x < w) & (y >= 0) & (y < h) & (share > 0)
            total += np.bincount((y * w + x)[ok], (share * value)[ok], h * w)
            norm += np.bincount((y * w + x)[ok], share[ok], h * w)
    return np.where(norm > 0, total / np.where(norm > 0, norm, 1), np.nan).reshape(h, w)


def painted(records: np.ndarray, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Dense dx, dy of records (w, h, dst_x, dst_y, motion_x, motion_y, scale), later ones over earlier ones; NaN elsewhere."""
    dx, dy = np.full((h, w), np.nan), np.full((h, w), np.nan)
    for bw, bh, cx, cy, mx, my, scale in records.tolist():
        ys, xs = slice(max(cy - bh // 2, 0), max(cy - bh // 2 + bh, 0)), slice(max(cx - bw // 2, 0), max(cx - bw // 2 + bw, 0))
        dx[ys, xs], dy[ys, xs] = mx / (scale or 1), my / (scale or 1)
    return dx, dy


def cubic(t: np.ndarray, a: float = -0.75) -> np.ndarray:
    t = np.abs(t)
    return np.where(t <= 1, (a + 2) * t**3 - (a + 3) * t**2 + 1, np.where(t < 2, a * (t**3 - 5 * t**2 + 8 * t - 4), 0.0))


def _taps(n: int, m: int, kind: str) -> np.ndarray:
    """[m, n] weights of a resampling from n to m samples, pixel centres aligned."""
    at = (np.arange(m) + 0.5) * n / m - 0.5
    out = np.zeros((m, n))
    if kind == "area":
        for k in range(m):
            lo, hi = k * n / m, (k + 1) * n / m
            cover = np.clip(np.minimum(np.arange(n) + 1, hi) - np.maximum(np.arange(n), lo), 0, None)
            out[k] = cover / cover.sum()
        return out
    if kind == "nearest":
        out[np.arange(m), np.minimum((np.arange(m) * n) // m, n - 1)] = 1
        return out
    reach = 2 if kind == "bicubic" else 1
    for o in range(1 - reach, reach + 1):
        k = np.floor(at).astype(int) + o
        weight = cubic(at - k) if kind == "bicubic" else np.clip(1 - np.abs(at - k), 0, None)
        np.add.at(out, (np.arange(m), np.clip(k, 0, n - 1)), weight)
    return out


def resized(x: np.ndarray, h: int, w: int, kind: str = "bicubic") -> np.ndarray:
    """x at another size: bicubic, bilinear, nearest or area."""
    rows = np.tensordot(_taps(x.shape[0], h, kind), x.astype(float), (1, 0))
    return np.moveaxis(np.tensordot(_taps(x.shape[1], w, kind), rows, (1, 1)), 0, 1)


def levels(x: np.ndarray) -> np.ndarray:
    """Whole levels 0..255, fractions cut off."""
    return np.clip(x, 0, 255).astype(np.uint8)


def unsharp(x: np.ndarray, amount: float, sigma: float) -> np.ndarray:
    return x.astype(float) if amount == 0 else np.clip(x + amount * (x - gaussian(x, sigma)), 0, 255)


def dilated(mask: np.ndarray, size: int) -> np.ndarray:
    """True within an ellipse of that size around a true pixel."""
    r = size // 2
    yy, xx = np.mgrid[-r : r + 1, -r : r + 1]
    shape = (yy / max(r, 1)) ** 2 + (xx / max(r, 1)) ** 2 <= 1 + 1e-9
    p = np.pad(mask.astype(bool), r)
    h, w = mask.shape
    out = np.zeros((h, w), bool)
    for i, j in zip(*np.nonzero(shape), strict=True):
        out |= p[i : i + h, j : j + w]
    return out


def occlusion(dx: np.ndarray, dy: np.ndarray, cur: np.ndarray, prev: np.ndarray, tau: float = 16.0, mode: str = "full", adaptive: float = 0.06) -> np.ndarray:
    """Pixels to distrust: without a vector, unlike their warped source (reactive), or inconsistent with the splatted reverse field (full)."""
    hole = ~np.isfinite(dx)
    if mode == "none":
        return hole
    mask = hole | (np.abs(cur.astype(float) - backward_warp(prev, dx, dy)) > tau)
    if mode == "reactive" or (mode == "adaptive" and mask.mean() <= adaptive):
        return mask
    w = -np.abs(cur.astype(float) - backward_warp(prev, dx, dy))
    # where nothing lands, and beyond the border, the reverse vector is far too long to fit
    fit = [np.nan_to_num(splat(-v, dx, dy, w), nan=NOWHERE) for v in (dx, dy)]
    x, y = np.nan_to_num(dx), np.nan_to_num(dy)
    yy, xx = np.mgrid[: x.shape[0], : x.shape[1]]
    fx, fy = (sampled(v, xx + x, yy + y, NOWHERE) for v in fit)
    return mask | ((x + fx) ** 2 + (y + fy) ** 2 > 0.01 * (x * x + y * y + fx * fx + fy * fy) + 0.5)


def grain(h: int, w: int, frame: int, sigma: float, luma: np.ndarray | None = None, blur: float = 0.8) -> np.ndarray:
    """Film grain of a frame: the frame number seeds it, so partitioning does not change it; weaker in shadows and lights."""
    rng = np.random.default_rng(frame * 2654435761 % 2**32)
    unit = gaussian(rng.standard_normal((h, w)), blur)
    unit /= unit.std() or 1.0
    shape = 1.0 if luma is None else np.clip(1 - np.abs(gaussian(luma, 2.0) / 127.5 - 1) ** 2, 0.15, 1)
    return sigma * shape * unit


def half_level(x: np.ndarray, dx: np.ndarray, dy: np.ndarray, other: np.ndarray, cut: float = 0.5) -> np.ndarray:
    """A frame between x and other: both warped by half a vector and averaged, a plain mean where a vector is missing, x where too many are."""
    hole = ~np.isfinite(dx)
    if hole.mean() > cut:
        return x.astype(float)
    a, b = backward_warp(x, dx / 2, dy / 2), backward_warp(other, -dx / 2, -dy / 2)
    return np.where(hole if x.ndim == 2 else hole[..., None], (x.astype(float) + other) / 2, (a + b) / 2)


def deblocked(x: np.ndarray, q: int = 8, strength: float = 0.5, most: float = 12.0) -> np.ndarray:
    """Steps up to `most` across the q-grid are spread over the two pixels beside them."""
    out = x.astype(float).copy()
    for axis in (0, 1):
        v = np.moveaxis(out, axis, 0)
        for k in range(q, v.shape[0], q):
            step = v[k] - v[k - 1]
            move = np.where(np.abs(step) <= most, strength * step / 2, 0.0)
            v[k - 1] += move
            v[k] -= move
    return out


def median3(x: np.ndarray) -> np.ndarray:
    p = _padded(x.astype(float), 1)
    h, w = x.shape[:2]
    return np.median(np.stack([p[i : i + h, j : j + w] for i in range(3) for j in range(3)]), 0)


def bilateral(x: np.ndarray, radius: int = 2, sigma_space: float = 2.0, sigma_level: float = 20.0) -> np.ndarray:
    x = x.astype(float)
    p, h, w = _padded(x, radius), *x.shape[:2]
    total, norm = np.zeros_like(x), np.zeros_like(x)
    for i in range(2 * radius + 1):
        for j in range(2 * radius + 1):
            y = p[i : i + h, j : j + w]
            k = np.exp(-((i - radius) ** 2 + (j - radius) ** 2) / (2 * sigma_space**2) - (y - x) ** 2 / (2 * sigma_level**2))
            total, norm = total + k * y, norm + k
    return total / norm


def signal_battery(x: np.ndarray) -> dict[str, float]:
    """Edge density, sharpness, two noise estimates, spectral share, gradient energy and local contrast of a plane."""
    x = x.astype(float)
    g = gradient(x)
    noise = np.abs(correlate(x, NOISE)).mean() * np.sqrt(np.pi / 2) / 6
    local = np.sqrt(np.maximum(box(x * x, 5) - box(x, 5) ** 2, 0))
    flat = local <= np.quantile(local, 0.25)
    d = x - median3(x)
    return {
        "edge_density": float((g > 100).mean()), "var_laplacian": var_laplacian(x), "noise": float(noise), "noise_flat": float(1.4826 * np.median(np.abs(d[flat] - np.median(d[flat])))),
        "spectrum": spectrum_share(x, power=False), "tenengrad": float((g * g).mean()), "local_std": float(local.mean()),
    }


def distance_to(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each pixel to the nearest true one; infinite without one.  Columns first, then rows."""
    h, w = mask.shape
    rows = np.where(mask, 0.0, np.inf)
    for order in (range(1, h), range(h - 2, -1, -1)):
        step = -1 if order.step == 1 else 1
        for y in order:
            rows[y] = np.minimum(rows[y], rows[y + step] + 1)
    across = np.abs(np.arange(w)[:, None] - np.arange(w)[None])
    return np.sqrt(((rows * rows)[:, None, :] + across[None] ** 2).min(2))


def signed_distance(alpha: np.ndarray) -> np.ndarray:
    """Distance from the contour of one half: positive outside the subject, negative inside."""
    inside = alpha >= 0.5
    return distance_to(inside) - distance_to(~inside)


def seam_ratio(x: np.ndarray, alpha: np.ndarray) -> float:
    """Laplacian variance in the ring just inside the subject over that in the ring just outside; NaN where a ring is flat or empty."""
    lap = correlate(x.astype(float), LAPLACE)
    inner, outer = lap[(alpha > 0.8) & (alpha < 0.98)], lap[(alpha > 0.02) & (alpha < 0.2)]
    return float(inner.var() / outer.var()) if inner.size and outer.size and outer.var() > 1e-6 else float("nan")


def halo_profile(x: np.ndarray, alpha: np.ndarray, most: int = 40, size: int = 9) -> dict[int, float]:
    """Mean local sharpness by whole signed distance from the subject's contour, up to `most` pixels; distances without pixels are absent."""
    sharp = box(np.abs(correlate(x.astype(float), LAPLACE)), size)
    d = signed_distance(alpha)
    near = np.rint(np.clip(d, -most - 1, most + 1)).astype(int)
    return {int(b): float(sharp[near == b].mean()) for b in np.unique(near) if abs(b) <= most}


def halo_width(profile: dict[int, float], most: int = 40, times: float = 1.3, far: int = 10) -> int:
    """Pixels from the contour outwards over which a profile stays `times` above its mean at the far end; gaps are skipped."""
    end = [v for b, v in profile.items() if most - far <= b <= most]
    if not end:
        return 0
    width, limit = 0, times * sum(end) / len(end)
    for b in sorted(b for b in profile if b >= 1):
        if profile[b] < limit:
            break
        width = b
    return width


def feathered(alpha: np.ndarray, sigma: float = 4.0, lift: float = 0.35) -> np.ndarray:
    """A matte with a wider, lifted ramp where its edge is soft; hard edges and the core stay."""
    a = alpha.astype(float)
    slope, edge = gradient(a), (a > 0.02) & (a < 0.98)
    steep = max(float(np.percentile(slope[edge], 90)), 1e-3) if edge.any() else 1e-3
    soft = gaussian(np.clip(1.0 - slope / steep, 0, 1) * edge, 2.0)
    wide = soft * gaussian(a, sigma) + (1 - soft) * a
    raised = np.clip(wide, 0, 1) ** (1.0 / (1.0 + lift)) if lift > 0 else wide
    return np.clip(soft * raised + (1 - soft) * wide, 0, 1)


def ring_restored(plate: np.ndarray, alpha: np.ndarray, strength: float = 0.5, amount: float = 0.6, sigma: float = 2.0) -> np.ndarray:
    """A plate sharpened in the band just outside the subject, by `strength`; 0 changes nothing."""
    p = plate.astype(float)
    if strength <= 0:
        return p
    band = np.where((alpha < 0.015) | (alpha > 0.55), 0.0, np.exp(-(((alpha - 0.22) / 0.18) ** 2)))
    sharp = np.floor(np.clip(p + amount * gaussian(band, 2.0) * (p - gaussian(p, sigma)), 0, 255))
    return np.rint((1.0 - strength) * p + strength * sharp)


def tile_box(mask: np.ndarray, scale: int, halo: int = 12) -> tuple[int, int, int, int] | None:
    """x0, y0, x1, y1 of the small-plane tile around the true pixels of a large mask, with a halo and cut to the plane; None without any."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return None
    h, w = mask.shape[0] // scale, mask.shape[1] // scale
    lo = lambda v: max(int(v.min()) // scale - halo, 0)
    hi = lambda v, most: min(-(-(int(v.max()) + 1) // scale) + halo, most)
    return lo(xs), lo(ys), hi(xs, w), hi(ys, h)


def tile_patched(large: np.ndarray, small: np.ndarray, mask: np.ndarray, scale: int, halo: int = 12) -> np.ndarray:
    """large with the mask's pixels taken from the small plane, of which only the tile around them is upscaled."""
    at = tile_box(mask, scale, halo)
    if at is None:
        return large
    x0, y0, x1, y1 = at
    up = resized(small[y0:y1, x0:x1], (y1 - y0) * scale, (x1 - x0) * scale)
    out, view = large.astype(float).copy(), (slice(y0 * scale, y1 * scale), slice(x0 * scale, x1 * scale))
    out[view] = np.where(mask[view], up, out[view])
    return out


def turned_mean(x: np.ndarray, fn, n: int = 8) -> np.ndarray:
    """Mean of fn over n turned and mirrored views of a plane (1: as it is, 2: mirrored too, 4: mirrored both ways, 8: all), turned back."""
    total = np.zeros(1)
    views = [(0, False), (0, True), (2, False), (2, True), (1, False), (1, True), (3, False), (3, True)][:n]
    for turn, flip in views:
        v = fn(np.rot90(x[:, ::-1] if flip else x, turn))
        back = np.rot90(v, -turn)
        total = total + (back[:, ::-1] if flip else back)
    return levels(np.rint(total / len(views)))


def between(before: np.ndarray, after: np.ndarray, forward: tuple[np.ndarray, np.ndarray], backward: tuple[np.ndarray, np.ndarray], share: float = 0.5, distrust: tuple[np.ndarray | None, np.ndarray | None] = (None, None)) -> dict[str, np.ndarray]:
    """Guesses of a left-out frame: the one before, a mean, both warps, and their blend.

    The blend takes the mean of both warps, the other one where a side has no vector or is distrusted, and the plain mean where both are out.
    """
    mean = (1 - share) * before + share * after
    warps = [backward_warp(v, *field) for v, field in ((before, forward), (after, backward))]
    dead = [~np.isfinite(field[0]) | (False if d is None else d) for field, d in zip((forward, backward), distrust, strict=True)]
    blend = np.where(dead[0], np.where(dead[1], mean, warps[1]), np.where(dead[1], warps[0], (1 - share) * warps[0] + share * warps[1]))
    return {"before": before.astype(float), "mean": mean, "forward": warps[0], "backward": warps[1], "blend": blend}


def degraded(x: np.ndarray, mode: str, frame: int = 0) -> np.ndarray:
    """A plane at half size: `clean` (area means), or `real` (blurred first, blocked and noisy after; the frame number seeds the noise)."""
    h, w = x.shape[0] // 2, x.shape[1] // 2
    if mode == "clean":
        return levels(resized(x, h, w, "area")).astype(float)
    if mode != "real":
        raise ValueError(f"unknown mode {mode!r}")
    small = resized(gaussian(x, 0.8), h, w, "area")
    blocks = resized(resized(small, -(-h // 4), -(-w // 4), "area"), h, w, "nearest")
    return levels(blocks + np.rint((small - blocks) / 8) * 8 + grain(h, w, frame, 2.0)).astype(float)


#: Upscalers without weights.
RESTORERS = {
    "nearest": lambda x, h, w: resized(x, h, w, "nearest"),
    "bilinear": lambda x, h, w: resized(x, h, w, "bilinear"),
    "bicubic": lambda x, h, w: resized(x, h, w),
    "sharpened": lambda x, h, w: unsharp(resized(x, h, w), 0.6, 1.0),
}
