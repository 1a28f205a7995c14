"""Windows, overlays, denoisers, regions of masks and carried grain against plain loops, and their queries against numpy over all rows."""

import os

import numpy as np
import pytest

from strandline.functions import kernels, regions
from strandline.sources.readers import clip_frame
from tests.test_oracles import SF

needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def mirrored(i, n):
    i = abs(i)
    return i if i < n else 2 * n - 2 - i


@pytest.mark.parametrize("size", [1, 3, 13, 51])
def test_window_means_equal_plain_sums(size):
    x = np.random.default_rng(size).random((60, 55)) * 255
    got, r = regions.window_mean(x, size), size // 2
    for i, j in ((0, 0), (59, 54), (30, 2), (17, 40)):
        near = [x[mirrored(i + a, 60), mirrored(j + b, 55)] for a in range(-r, size - r) for b in range(-r, size - r)]
        assert got[i, j] == pytest.approx(np.mean(near))
    assert np.allclose(regions.window_mean(np.stack([x, 2 * x]), size)[1], 2 * got)


def test_overlays_of_a_clip_with_a_title():
    x = clip_frame("graphics", 3, 12, 72, 128)
    title = (slice(0, 9), slice(0, 64))
    still, moving = np.full((72, 128), np.nan), np.full((72, 128), 2.0)
    own = {"size": 9}
    mask = regions.overlay(x, still, False, **own)
    assert mask[title].mean() > 0.9 and mask[40:].sum() == 0 and not regions.overlay(x, still, True, **own).any()
    assert regions.overlay(x, moving, True, **own)[title].mean() > 0.9 and not regions.overlay(x, moving, False, **own).any()
    x0, y0, x1, y1 = regions.box_of(mask)
    assert (x0, y0) == (0, 0) and 60 <= x1 <= 76 and 8 <= y1 <= 20 and regions.box_of(mask & False) is None
    plain = clip_frame("pan", 3, 12, 72, 128)
    assert not regions.overlay(plain, still, False, **own).any()


def plain_nlm(x, strength, patch, search):
    h, w = x.shape
    r, q = search // 2, patch // 2
    at = lambda i, j: x[mirrored(i, h), mirrored(j, w)]
    out = np.zeros_like(x)
    for i in range(h):
        for j in range(w):
            total = norm = 0.0
            for a in range(-r, r + 1):
                for b in range(-r, r + 1):
                    gap = np.mean([(at(i + u, j + v) - at(i + a + u, j + b + v)) ** 2 for u in range(-q, q + 1) for v in range(-q, q + 1)])
                    k = np.exp(-gap / strength**2)
                    total, norm = total + k * at(i + a, j + b), norm + k
            out[i, j] = total / norm
    return out


def test_denoisers():
    rng = np.random.default_rng(4)
    x = rng.random((14, 15)) * 40
    assert np.allclose(regions.non_local_means(x, 9.0, 3, 5), plain_nlm(x, 9.0, 3, 5))
    b = np.zeros_like(x)
    for i in range(14):
        for j in range(15):
            near = [(a, c, x[mirrored(i + a, 14), mirrored(j + c, 15)]) for a in range(-2, 3) for c in range(-2, 3)]
            k = [np.exp(-(a * a + c * c) / 50 - (v - x[i, j]) ** 2 / 3200) for a, c, v in near]
            b[i, j] = sum(w * v for w, (_, _, v) in zip(k, near)) / sum(k)
    assert np.allclose(regions.DENOISERS["bilateral"](x), b)
    clean = np.kron(rng.integers(0, 2, (6, 6)) * 120.0, np.ones((8, 8)))
    noisy = clean + rng.normal(0, 6, clean.shape)
    score = {m: kernels.psnr(fn(noisy), clean) for m, fn in regions.DENOISERS.items()}
    assert score["nlm"] > kernels.psnr(noisy, clean) + 2 and score["nlm"] > score["gauss"]


def flooded(mask, corners):
    """Regions by walking from pixel to pixel: [(pixels, box area)]."""
    left, out = set(zip(*map(list, np.nonzero(mask)))), []
    while left:
        todo, own = [left.pop()], []
        while todo:
            y, x = todo.pop()
            own.append((y, x))
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    if (corners or not a or not b) and (y + a, x + b) in left:
                        left.remove((y + a, x + b))
                        todo.append((y + a, x + b))
        ys, xs = zip(*own)
        out.append((len(own), (max(ys) - min(ys) + 1) * (max(xs) - min(xs) + 1)))
    return out


def told(own):
    total = sum(n for n, _ in own)
    return (len(own), max(n for n, _ in own) / total, total / sum(a for _, a in own)) if own else (0, 0.0, 0.0)


@pytest.mark.parametrize("corners", [True, False])
def test_regions_equal_flooding(corners):
    rng = np.random.default_rng(6)
    masks = np.stack([rng.random((17, 23)) < p for p in (0.0, 0.1, 0.4, 0.6, 0.9, 1.0)])
    spiral = np.zeros((17, 23), bool)
    spiral[::2], spiral[1::4, -1], spiral[3::4, 0] = True, True, True
    masks = np.concatenate((masks, spiral[None], np.eye(17, 23, dtype=bool)[None]))
    got = regions.Runs(masks, corners).by_frame()
    for k, m in enumerate(masks):
        assert (got[0][k], got[1][k], got[2][k]) == pytest.approx(told(flooded(m, corners)))
    empty = regions.Runs(np.zeros((0, 4, 4), bool), corners).by_frame()
    assert all(len(v) == 0 for v in empty)


def test_frozen_grain_follows_a_block():
    h, w = 40, 60
    none = (np.full((h, w), np.nan), np.full((h, w), np.nan))
    dx, dy = np.full((h, w), np.nan), np.full((h, w), np.nan)
    dx[10:26, 20:36], dy[10:26, 20:36] = -3.0, 2.0  # where the block's content was a frame ago
    grain = regions.frozen_grain([none, (dx, dy), none], 5.0, 3)
    assert all(g.std() == pytest.approx(5.0) for g in grain)
    scale = grain[1][0, 0] / grain[0][0, 0]
    assert np.allclose(grain[1][10:26, 20:36], scale * grain[0][12:28, 17:33]) and np.allclose(grain[1][:10], scale * grain[0][:10])
    assert np.allclose(grain[2], grain[1])


@needs_tables
def test_fast_regions_of_all_frames(spark):
    from strandline import views
    from strandline.plans import motion as plans

    rows = views.mvs(spark, SF).where("source < 0").orderBy("frame_id", "mv_idx").collect()
    fields = {}
    for r in rows:
        field = fields.setdefault(r.frame_id, np.zeros((views.GRID_H, views.GRID_W), bool))
        y, x = r.dst_y - r.h // 2, r.dst_x - r.w // 2
        field[max(y, 0) : max(y + r.h, 0), max(x, 0) : max(x + r.w, 0)] = r.motion_x**2 + r.motion_y**2 >= 9 * r.motion_scale**2
    got = {r.frame_id: (r.regions, r.largest, r.fill) for r in plans.fast_regions(spark, SF).collect()}
    assert got.keys() == fields.keys() and max(v[0] for v in got.values()) > 1
    assert all(got[k] == pytest.approx(told(flooded(m, True))) for k, m in fields.items())


def plain_rows(spark):
    from strandline.plans import recon

    return recon.planes(spark, SF).join(recon.small_motion(spark, SF), "frame_idx", "left").orderBy("scene", "frame_idx").collect()


def field(mvs):
    dx, dy = np.full((8, 8), np.nan), np.full((8, 8), np.nan)
    for m in mvs or []:
        for y in range(m.dst_y - m.h // 2, m.dst_y - m.h // 2 + m.h):
            for x in range(m.dst_x - m.w // 2, m.dst_x - m.w // 2 + m.w):
                if 0 <= y < 8 and 0 <= x < 8:
                    dx[y, x], dy[y, x] = m.motion_x / m.motion_scale, m.motion_y / m.motion_scale
    return dx, dy


@needs_tables
def test_graphic_tiles_of_all_tiles(spark):
    from strandline.plans import dense

    own, want = dense.TILE_OVERLAY, {}
    for r in plain_rows(spark):
        x, (dx, dy) = np.array(r.plane).reshape(8, 8), field(r.mvs)
        found = {k: np.zeros((8, 8), bool) for k in ("moving", "static")}
        for y in range(8):
            for z in range(8):
                near = [x[mirrored(y + a, 8), mirrored(z + b, 8)] for a in (-1, 0, 1) for b in (-1, 0, 1)]
                two = min(sum(v > own["white"] for v in near), sum(v < own["dark"] for v in near)) / 9 > own["both"]
                speed = 0.0 if np.isnan(dx[y, z]) else np.hypot(dx[y, z], dy[y, z])
                for kind, hit in (("moving", speed > own["motion"]), ("static", speed < own["motion"])):
                    if two and hit:  # grown by a cross
                        for a, b in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)):
                            if 0 <= y + a < 8 and 0 <= z + b < 8:
                                found[kind][y + a, z + b] = True
        for kind, mask in found.items():
            ys, xs = np.nonzero(mask)
            want[r.scene, r.frame_idx, kind] = (len(ys), *((xs.min(), ys.min(), xs.max() + 1, ys.max() + 1) if len(ys) else (None,) * 4))
    got = {(r.scene, r.frame_idx, r.kind): (r.area, r.x0, r.y0, r.x1, r.y1) for r in dense.graphic_tiles(spark, SF).collect()}
    assert got == want and any(v[0] for k, v in want.items() if k[2] == "moving") and any(v[0] for k, v in want.items() if k[2] == "static")


@needs_tables
def test_denoised_and_grained_tiles(spark):
    from strandline.plans import dense

    rows = plain_rows(spark)
    sums = {}
    for r in rows:
        x = np.array(r.plane).reshape(8, 8)
        noisy = x + np.random.default_rng([7, r.frame_idx]).normal(0, 8.0, (8, 8))
        for method, v in (("none", noisy), ("median", np.array([[np.median([noisy[mirrored(i + a, 8), mirrored(j + b, 8)] for a in (-1, 0, 1) for b in (-1, 0, 1)]) for j in range(8)] for i in range(8)]))):
            sums.setdefault((r.scene, method), []).append(10 * np.log10(65025 / ((v - x) ** 2).mean()))
    got = {(r.scene, r.method): (r.n, r.psnr) for r in dense.denoised_tiles(spark, SF).collect()}
    assert all(got[k] == (len(v), pytest.approx(np.mean(v))) for k, v in sums.items()) and len(got) == 5 * len({k[0] for k in got})
    grained = {(r.scene, r.frame_idx): r for r in dense.carried_grain(spark, SF).collect()}
    assert len(grained) == len(rows) and all(r.deviation == pytest.approx(5.0) for r in grained.values())
    chunks = {}
    for r in rows:
        chunks.setdefault((r.scene, r.chunk_id), []).append(r)
    for own in list(chunks.values())[:20]:
        grain = regions.template(8, 8, own[0].chunk_id * 1009 + own[0].scene)
        for k, r in enumerate(own):
            if k:
                moved = kernels.backward_warp(grain, *field(r.mvs))
                grain = moved / moved.std()
                assert grained[r.scene, r.frame_idx].follows == pytest.approx(1.0)
            assert grained[r.scene, r.frame_idx].mean == pytest.approx(5.0 * grain.mean())
