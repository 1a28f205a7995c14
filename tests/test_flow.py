"""Dense flow: known shifts, a version by loops over pixels, and the query of temporal errors."""

import os

import numpy as np
import pytest

from strandline.functions import flow, kernels
from tests.test_oracles import SF


def texture(h, w, seed=0):
    return kernels.gaussian(np.random.default_rng(seed).random((h, w)), 2.0) * 2550


def moved(dx, dy, h=72, w=96):
    """A plane and the same one moved by (dx, dy), cut from a larger texture."""
    big = texture(h + 40, w + 40)
    yy, xx = np.mgrid[20 : 20 + h, 20 : 20 + w].astype(float)
    return kernels.remap(big, xx, yy), kernels.remap(big, xx - dx, yy - dy)


@pytest.mark.parametrize("shift", [(0.0, 0.0), (1.0, 0.0), (0.0, -2.0), (1.5, 0.5), (-3.25, 2.5), (6.0, -5.0)])
def test_flow_of_a_known_shift(shift):
    dx, dy = flow.dense_flow(*moved(*shift))
    inner = (slice(16, -16), slice(16, -16))
    assert abs(np.median(dx[inner]) - shift[0]) < 0.1 and abs(np.median(dy[inner]) - shift[1]) < 0.1
    off = np.hypot(dx[inner] - shift[0], dy[inner] - shift[1])
    # at 72 x 96 planes are halved once, so the largest shift is not reached everywhere in three rounds
    assert off.mean() < 0.1 if max(map(abs, shift)) < 4 else (off < 0.1).mean() > 0.85


def test_expansion_of_a_quadratic_is_its_coefficients():
    yy, xx = np.mgrid[:30, :40].astype(float)
    x0, y0 = 20, 15
    plane = 3 + 2 * (xx - x0) - (yy - y0) + 0.5 * (xx - x0) ** 2 + 0.25 * (yy - y0) ** 2 - 0.75 * (xx - x0) * (yy - y0)
    assert np.allclose(flow.expansion(plane)[:, y0, x0], [2, -1, 0.5, 0.25, -0.75])


def plain(a, b, window=flow.WINDOW, rounds=flow.ROUNDS):
    """The same on one scale by loops: a weighted fit by lstsq around each pixel, then windows summed pixel by pixel."""
    h, w = a.shape
    r = flow.POLY_RADIUS
    at = [(u, v) for v in range(-r, r + 1) for u in range(-r, r + 1)]
    weight = np.sqrt([np.exp(-(u * u + v * v) / (2 * flow.POLY_SIGMA**2)) for u, v in at])
    basis = np.array([[1, u, v, u * u, v * v, u * v] for u, v in at]) * weight[:, None]

    def fitted(x):
        out = np.zeros((h, w, 5))
        for i in range(h):
            for j in range(w):
                near = np.array([x[min(max(i + v, 0), h - 1), min(max(j + u, 0), w - 1)] for u, v in at])
                out[i, j] = np.linalg.lstsq(basis, near * weight, rcond=None)[0][1:]
        return out

    fa, fb = fitted(a), fitted(b)
    d = np.zeros((h, w, 2))
    for _ in range(rounds):
        g, s = np.zeros((h, w, 2, 2)), np.zeros((h, w, 2))
        for i in range(h):
            for j in range(w):
                px, py = min(max(j + d[i, j, 0], 0), w - 1), min(max(i + d[i, j, 1], 0), h - 1)
                x0, y0 = int(px), int(py)
                x1, y1, fx, fy = min(x0 + 1, w - 1), min(y0 + 1, h - 1), px - x0, py - y0
                c = (fb[y0, x0] * (1 - fx) + fb[y0, x1] * fx) * (1 - fy) + (fb[y1, x0] * (1 - fx) + fb[y1, x1] * fx) * fy
                m = (fa[i, j] + c) / 2
                m = np.array([[m[2], m[4] / 2], [m[4] / 2, m[3]]])
                v = (fa[i, j, :2] - c[:2]) / 2 + m @ d[i, j]
                g[i, j], s[i, j] = m.T @ m, m.T @ v
        new = np.zeros_like(d)
        k = window // 2
        for i in range(h):
            for j in range(w):
                near = [(min(max(i + y, 0), h - 1), min(max(j + x, 0), w - 1)) for y in range(-k, k + 1) for x in range(-k, k + 1)]
                gm, sm = sum(g[p] for p in near) / window**2, sum(s[p] for p in near) / window**2
                det = gm[0, 0] * gm[1, 1] - gm[0, 1] ** 2 + 1e-3
                new[i, j] = (gm[1, 1] * sm[0] - gm[0, 1] * sm[1]) / det, (gm[0, 0] * sm[1] - gm[0, 1] * sm[0]) / det
        d = new
    return d[..., 0], d[..., 1]


def test_flow_equals_the_plain_version_and_pairs_do_not_touch():
    pairs = [(texture(9, 11, s), texture(9, 11, s + 1)) for s in (0, 5)]
    side_by_side = flow.dense_flow(np.stack([p[0] for p in pairs]), np.stack([p[1] for p in pairs]))
    for k, (a, b) in enumerate(pairs):
        dx, dy = plain(a, b, window=5, rounds=2)
        assert np.allclose(flow.dense_flow(a, b, window=5, rounds=2), (dx, dy), atol=1e-8)
        assert np.allclose([v[k] for v in side_by_side], flow.dense_flow(a, b))


def test_motion_error_of_a_steady_and_a_shaken_copy():
    a, b = moved(2.0, 0.0)
    shaken = moved(4.0, 0.0)[1]
    assert flow.motion_error(a, b, a, b) == 0 and 1.5 < flow.motion_error(a, shaken, a, b) < 2.5


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_query_equals_numpy_over_all_tiles(spark):
    from strandline.plans import dense, recon

    rows = recon.planes(spark, SF).select("scene", "frame_idx", "plane").toPandas().sort_values(["scene", "frame_idx"])
    want = {}
    for scene, own in rows.groupby("scene"):
        truth = [np.array(p).reshape(8, 8) for p in own["plane"]]
        up = [kernels.resized(kernels.degraded(p, "clean"), 8, 8) for p in truth]
        errors = []
        for k in range(1, len(truth)):
            d, t = flow.dense_flow(up[k - 1], up[k]), flow.dense_flow(truth[k - 1], truth[k])
            errors.append(np.sqrt((d[0] - t[0]) ** 2 + (d[1] - t[1]) ** 2).mean())
        want[scene] = (len(errors), np.mean(errors))
    got = {r.scene: (r.n, r.tof) for r in dense.tile_tof(spark, SF).where("config = 'bicubic'").collect()}
    assert got.keys() == want.keys() and all(got[s][0] == n and got[s][1] == pytest.approx(v) for s, (n, v) in want.items())
