"""Queries without an SQL twin against plain Python over all rows of the smallest tables."""

import math
import os
from collections import defaultdict

import numpy as np
import pytest

from strandline.functions import kernels
from strandline.plans import dense, recon
from tests.test_oracles import SF
from tests.test_regions import field, mirrored

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
SIDE = 8


@pytest.fixture(scope="module")
def rows(spark):
    """Frames of each scene in order: dicts with plane, mvs, ptype, chunk_id."""
    out = defaultdict(list)
    got = recon.planes(spark, SF).join(recon.small_motion(spark, SF), "frame_idx", "left").collect()
    for r in sorted(got, key=lambda r: (r.scene, r.frame_idx)):
        out[r.scene].append({"idx": r.frame_idx, "ptype": r.ptype, "chunk": r.chunk_id, "plane": np.array(r.plane).reshape(SIDE, SIDE), "mvs": r.mvs or []})
    return out


def at(x, i, j):
    return x[mirrored(i, x.shape[0]), mirrored(j, x.shape[1])]


def laid(x, kernel):
    """x with an odd kernel laid over each pixel, by loops."""
    r = len(kernel) // 2
    return np.array([[sum(kernel[a][b] * at(x, i + a - r, j + b - r) for a in range(len(kernel)) for b in range(len(kernel))) for j in range(x.shape[1])] for i in range(x.shape[0])])


def gradient(x):
    gx = laid(x, [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    return np.sqrt(gx**2 + laid(x, [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]) ** 2)


def psnr(a, b):
    mse = ((a - b) ** 2).mean()
    return math.inf if mse <= 1e-12 else 10 * math.log10(65025 / mse)


def ssim(a, b):
    k = np.exp(-(np.arange(-5, 6) ** 2) / 4.5)
    k = np.outer(k, k) / k.sum() ** 2
    g = lambda x: laid(x, k.tolist())
    c1, c2 = 2.55**2, 7.65**2
    ma, mb = g(a), g(b)
    va, vb, cov = g(a * a) - ma**2, g(b * b) - mb**2, g(a * b) - ma * mb
    return ((2 * ma * mb + c1) * (2 * cov + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean()


def test_tile_similarity(spark, rows):
    got = {(r.scene, r.frame_idx): r for r in recon.tile_similarity(spark, SF).collect()}
    assert len(got) == sum(len(v) - 1 for v in rows.values())
    for scene, own in rows.items():
        for k in range(1, min(len(own), 15)):
            a, b, r = own[k]["plane"], own[k - 1]["plane"], got[scene, own[k]["idx"]]
            assert r.ssim == pytest.approx(ssim(a, b)) and r.psnr == pytest.approx(psnr(a, b)) and r.gradient == pytest.approx(psnr(gradient(a), gradient(b)))


def test_tile_signals(spark, rows):
    got = {(r.scene, r.frame_idx): r for r in recon.tile_signals(spark, SF).collect()}
    assert len(got) == sum(map(len, rows.values()))
    for scene, own in rows.items():
        for f in own[:10]:
            x, r = f["plane"], got[scene, f["idx"]]
            g = gradient(x)
            lap, noise = laid(x, [[0, 1, 0], [1, -4, 1], [0, 1, 0]]), laid(x, [[1, -2, 1], [-2, 4, -2], [1, -2, 1]])
            near = [[[at(x, i + a, j + b) for a in range(-2, 3) for b in range(-2, 3)] for j in range(SIDE)] for i in range(SIDE)]
            local = np.std(near, axis=2)
            middle = np.array([[np.median([at(x, i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]) for j in range(SIDE)] for i in range(SIDE)])
            flat = (x - middle)[local <= np.quantile(local, 0.25)]
            wave = np.abs(np.fft.fft2(x - x.mean()))
            far = [[math.hypot(*(min(k, SIDE - k) / SIDE for k in (i, j))) / 0.5 > 0.25 for j in range(SIDE)] for i in range(SIDE)]
            want = {
                "edge_density": (g > 100).mean(), "var_laplacian": lap.var(), "noise": np.abs(noise).mean() * math.sqrt(math.pi / 2) / 6, "noise_flat": 1.4826 * np.median(np.abs(flat - np.median(flat))),
                "spectrum": wave[np.array(far)].sum() / wave.sum(), "tenengrad": (g * g).mean(), "local_std": local.mean(),
            }
            assert {c: r[c] for c in want} == {c: pytest.approx(v, rel=1e-6, abs=1e-6) for c, v in want.items()}


def warped(x, dx, dy):
    """x at each pixel plus its vector, bilinear, by loops; no vector is no motion."""
    h, w = x.shape
    out = np.zeros((h, w))
    for i in range(h):
        for j in range(w):
            px = min(max(j + (0 if math.isnan(dx[i, j]) else dx[i, j]), 0), w - 1)
            py = min(max(i + (0 if math.isnan(dy[i, j]) else dy[i, j]), 0), h - 1)
            x0, y0 = int(px), int(py)
            x1, y1, fx, fy = min(x0 + 1, w - 1), min(y0 + 1, h - 1), px - x0, py - y0
            out[i, j] = (x[y0, x0] * (1 - fx) + x[y0, x1] * fx) * (1 - fy) + (x[y1, x0] * (1 - fx) + x[y1, x1] * fx) * fy
    return out


def one_way(ref, ref_small, small, mvs):
    """The warp unit at twice the size: the reference's picture and the residual of the small planes, and the pixels to distrust."""
    dx, dy = field(mvs)
    twice = lambda v: np.repeat(np.repeat(v, 2, 0), 2, 1)
    moved = warped(ref, twice(dx) * 2, twice(dy) * 2)
    lack = small - warped(ref_small, dx, dy)
    hole = np.isnan(dx) | (np.abs(lack) > 16)
    return moved + kernels.resized(lack, 16, 16, "bilinear"), hole, twice(hole)


def rebuilt(frames):
    """PSNR, share of holes, hops and anchors of a chunk."""
    up = [kernels.resized(f["plane"], 16, 16) for f in frames]
    side = lambda f, sign: [m for m in f["mvs"] if m.source * sign > 0]
    done, told, last = {}, {}, None
    for i, f in enumerate(frames):
        if f["ptype"] == "B":
            continue
        if f["ptype"] == "I" or last is None:
            done[i], told[i] = up[i], (True, 0.0, 0)
        else:
            moved, hole, big = one_way(done[last], frames[last]["plane"], f["plane"], side(f, -1))
            done[i], told[i] = np.where(big, up[i], moved), (False, hole.mean(), told[last][2] + 1)
        last = i
    solid = sorted(done)
    for i, f in enumerate(frames):
        if i in told:
            continue
        before, after = max((j for j in solid if j < i), default=None), min((j for j in solid if j > i), default=None)
        total, weight, holes = np.zeros((16, 16)), np.zeros((16, 16)), np.ones((SIDE, SIDE), bool)
        for j, sign, other in ((before, -1, after), (after, 1, before)):
            if j is None:
                continue
            moved, hole, big = one_way(done[j], frames[j]["plane"], f["plane"], side(f, sign))
            w = abs((j if other is None else other) - i) or 1
            total, weight, holes = total + np.where(big, 0, w * moved), weight + np.where(big, 0, w), holes & hole
        picture = up[i].copy()
        picture[weight > 0] = total[weight > 0] / weight[weight > 0]
        done[i], told[i] = picture, (False, holes.mean(), None)
    whole = lambda v: np.floor(np.clip(v, 0, 255))
    return [(*told[i], psnr(whole(done[i].reshape(SIDE, 2, SIDE, 2).mean((1, 3))), whole(f["plane"]))) for i, f in enumerate(frames)]


def test_chunk_reconstruct(spark, rows):
    got = {(r.scene, r.frame_idx): r for r in recon.chunk_reconstruct(spark, SF).collect()}
    assert len(got) == sum(map(len, rows.values()))
    for scene, own in rows.items():
        chunks = defaultdict(list)
        for f in own:
            chunks[f["chunk"]].append(f)
        for frames in chunks.values():
            for f, (anchor, hole, hops, quality) in zip(frames, rebuilt(frames), strict=True):
                r = got[scene, f["idx"]]
                assert (r.is_anchor, r.hops) == (anchor, hops) and r.hole_frac == pytest.approx(hole) and r.psnr == pytest.approx(quality, rel=1e-6)


def test_degrade_restore(spark, rows):
    sums, best = defaultdict(list), defaultdict(list)
    for own in rows.values():
        for f in own:
            for mode in ("clean", "real"):
                small = kernels.degraded(f["plane"], mode, f["idx"])
                if mode == "clean":
                    assert np.array_equal(small, np.floor(np.clip(f["plane"].reshape(4, 2, 4, 2).mean((1, 3)), 0, 255)))
                found = {c: np.rint(np.clip(up(small, SIDE, SIDE), 0, 255)) for c, up in kernels.RESTORERS.items()}
                assert np.array_equal(found["nearest"], np.repeat(np.repeat(small, 2, 0), 2, 1))
                scores = {c: psnr(x, f["plane"]) for c, x in found.items()}
                for c, v in scores.items():
                    sums[mode, c].append(v)
                    best[mode, c].append(v >= max(scores.values()))
    got = {(r.mode, r.config): r for r in dense.degrade_restore(spark, SF).collect()}
    assert got.keys() == sums.keys()
    for k, v in sums.items():
        assert got[k].n == len(v) and got[k].psnr == pytest.approx(np.mean(v)) and got[k].best_share == pytest.approx(np.mean(best[k]))


def test_held_out_scores(spark, rows):
    vectors = {r.frame_id: (r.motion_x / 16.0, r.motion_y / 8.0) for r in recon.views.mvs(spark, SF).where("mv_idx = 0").collect()}
    half = lambda v, sign: tuple(np.where(np.arange(SIDE)[None] < SIDE // 2, sign * c, np.nan) * np.ones((SIDE, 1)) for c in v) if v else (np.full((SIDE, SIDE), np.nan),) * 2
    sums = defaultdict(list)
    for scene, own in rows.items():
        for k in range(1, len(own) - 1):
            truth, before, after = (own[j]["plane"] for j in (k, k - 1, k + 1))
            f, b = half(vectors.get(own[k]["idx"]), 1), half(vectors.get(own[k + 1]["idx"]), -1)
            bad = kernels.occlusion(*f, truth, before), kernels.occlusion(*b, truth, after)
            w1, w2 = warped(before, *f), warped(after, *b)
            mean = (before + after) / 2
            dead = np.isnan(f[0]) | bad[0], np.isnan(b[0]) | bad[1]
            mixed = np.array([[mean[i, j] if dead[0][i, j] and dead[1][i, j] else w2[i, j] if dead[0][i, j] else w1[i, j] if dead[1][i, j] else (w1[i, j] + w2[i, j]) / 2 for j in range(SIDE)] for i in range(SIDE)])
            for method, guess in (("before", before), ("mean", mean), ("forward", w1), ("backward", w2), ("blend", mixed)):
                sums[scene, method].append((psnr(np.floor(np.clip(guess, 0, 255)), truth), bad[0].mean()))
    got = {(r.scene, r.method): r for r in dense.held_out_scores(spark, SF).collect()}
    assert got.keys() == sums.keys()
    for k, v in sums.items():
        want = np.mean(v, axis=0)
        assert got[k].n == len(v) and got[k].psnr == pytest.approx(want[0], rel=1e-6) and got[k].hole_share == pytest.approx(want[1])


def test_seam_metrics(spark, rows):
    alpha = np.array([[min(max((4.5 - math.hypot(x - 3.5, y - 3.5)) / 2.5, 0), 1) for x in range(SIDE)] for y in range(SIDE)])
    inner, outer = (alpha > 0.8) & (alpha < 0.98), (alpha > 0.02) & (alpha < 0.2)
    seams = defaultdict(list)
    for scene, own in rows.items():
        for f in own:
            lap = laid(f["plane"], [[0, 1, 0], [1, -4, 1], [0, 1, 0]])
            ok = inner.any() and outer.any() and lap[outer].var() > 1e-6
            seams[scene].append(lap[inner].var() / lap[outer].var() if ok else math.nan)
    got = {(r.scene, r.variant): r for r in dense.seam_metrics(spark, SF).collect()}
    assert {k[1] for k in got} == {"plain", "feathered"}
    for scene, v in seams.items():
        r = got[scene, "plain"]
        want = np.nanmean(v) if not np.isnan(v).all() else None
        assert r.n == len(v) and r.area == pytest.approx(alpha.sum()) and (r.seam == pytest.approx(want) if want is not None else r.seam is None)


def test_kernels_that_only_queries_use():
    rng = np.random.default_rng(0)
    x = rng.random((16, 16)) * 255
    want = x.copy()
    for k in (4, 8, 12):  # rows, then columns
        step = want[k] - want[k - 1]
        move = np.where(np.abs(step) <= 60, step * 0.25, 0)
        want[k - 1], want[k] = want[k - 1] + move, want[k] - move
    for k in (4, 8, 12):
        step = want[:, k] - want[:, k - 1]
        move = np.where(np.abs(step) <= 60, step * 0.25, 0)
        want[:, k - 1], want[:, k] = want[:, k - 1] + move, want[:, k] - move
    assert np.allclose(kernels.deblocked(x, 4, 0.5, 60), want)
    x = rng.random((24, 24)) * 255
    y = np.clip(x + rng.normal(0, 20, x.shape), 0, 255)
    pool = lambda v: v.reshape(v.shape[0] // 2, 2, v.shape[1] // 2, 2).mean((1, 3))
    weights, total, a, b = np.array([0.0448, 0.2856, 0.3001]), 1.0, x, y
    for w in weights / weights.sum():
        total *= max(ssim(a, b), 1e-6) ** w
        a, b = pool(a), pool(b)
    assert kernels.ms_ssim(x, y) == pytest.approx(total)
    mid = kernels.half_level(x, np.full((24, 24), 4.0), np.full((24, 24), -2.0), y)
    assert np.allclose(mid, (warped(x, np.full((24, 24), 2.0), np.full((24, 24), -1.0)) + warped(y, np.full((24, 24), -2.0), np.full((24, 24), 1.0))) / 2)
