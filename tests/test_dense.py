"""Kernels of seams, tiles, turned means, guesses of left-out frames and occlusion, against plain loops."""

import itertools

import numpy as np
import pytest

from strandline.functions import kernels


def test_samples_beyond_the_border_are_constant():
    x = np.arange(12.0).reshape(3, 4)
    at_y, at_x = np.array([[0.0, -5.0, 1.5], [2.5, 2.0, 9.0]]), np.array([[1.0, 1.0, 2.5], [0.0, 3.5, 0.0]])
    got = kernels.sampled(x, at_x, at_y, 100.0)
    pixel = lambda y, x_: x[int(y), int(x_)] if 0 <= y < 3 and 0 <= x_ < 4 else 100.0
    for k, (yy, xx) in enumerate(zip(at_y.ravel(), at_x.ravel(), strict=True)):
        y0, x0 = np.floor(yy), np.floor(xx)
        want = sum((1 - abs(yy - y)) * (1 - abs(xx - v)) * pixel(y, v) for y in (y0, y0 + 1) for v in (x0, x0 + 1))
        assert abs(got.ravel()[k] - want) < 1e-9


def test_a_disocclusion_is_found():
    """A block of 6x6 moves three to the right over a still ground: what it uncovers has no fitting reverse vector."""
    h, w = 12, 20
    prev = np.full((h, w), 100.0)
    cur = prev.copy()
    prev[3:9, 4:10], cur[3:9, 7:13] = 105.0, 105.0  # differences stay under the reactive limit
    dx, dy = np.zeros((h, w)), np.zeros((h, w))
    dx[3:9, 7:13] = -3.0
    reactive, full = (kernels.occlusion(dx, dy, cur, prev, mode=m) for m in ("reactive", "full"))
    assert not reactive.any()
    # the ground beside the block's new place points to places that the block's vectors also reach
    assert full[3:9, 4:7].any() and not full[:2].any() and not full[:, 15:].any()
    hole = dx.copy()
    hole[0, 0] = np.nan
    assert kernels.occlusion(hole, dy, cur, prev)[0, 0]
    # a vector out of the picture meets nothing that comes back
    out = np.zeros((h, w))
    out[:, -1] = 5.0
    assert kernels.occlusion(out, dy, np.full((h, w), 9.0), np.full((h, w), 9.0))[:, -1].all()


def test_pixels_without_vectors_are_not_splatted():
    x = np.arange(16.0).reshape(4, 4)
    dx = np.full((4, 4), np.nan)
    dx[1, 1] = 2.0
    got = kernels.splat(x, dx, np.where(np.isnan(dx), np.nan, 0.0), np.zeros((4, 4)))
    assert got[1, 3] == x[1, 1] and np.isfinite(got).sum() == 1
    assert np.isnan(kernels.splat(x, np.full((4, 4), np.nan), np.zeros((4, 4)), np.zeros((4, 4)))).all()


def test_distances_equal_all_pairs():
    rng = np.random.default_rng(3)
    mask = rng.random((9, 13)) < 0.08
    ys, xs = np.nonzero(mask)
    got = kernels.distance_to(mask)
    for y, x in itertools.product(range(9), range(13)):
        assert abs(got[y, x] - np.sqrt((ys - y) ** 2 + (xs - x) ** 2).min()) < 1e-9
    assert np.isinf(kernels.distance_to(np.zeros((3, 3), bool))).all()


def test_seams_and_halos():
    yy, xx = np.mgrid[:64, :64]
    alpha = np.clip((16 - np.hypot(xx - 32, yy - 32)) / 6 + 0.5, 0, 1)
    rng = np.random.default_rng(0)
    noise = rng.standard_normal((64, 64)) * 20
    assert kernels.seam_ratio(128 + noise, alpha) == pytest.approx(1, abs=0.6)
    assert kernels.seam_ratio(128 + noise * np.where(alpha > 0.5, 1, 0.2), alpha) > 3
    d = kernels.signed_distance(alpha)
    assert d[32, 32] < 0 < d[0, 0] and abs(d[32, 48]) < 2
    wide = kernels.halo_profile(128 + noise * np.where(d < 8, 1, 0.1), alpha, most=20, size=3)
    tight = kernels.halo_profile(128 + noise * np.where(d < 2, 1, 0.1), alpha, most=20, size=3)
    assert kernels.halo_width({b: 5.0 if b < 7 else 1.0 for b in range(-5, 41) if b != 3}) == 6
    assert kernels.halo_width(wide, 20) > kernels.halo_width(tight, 20) and kernels.halo_width({}) == 0
    soft = kernels.feathered(alpha)
    assert (soft >= 0).all() and (soft <= 1).all() and np.allclose(soft[32, 32], 1) and np.allclose(soft[0], 0, atol=1e-6)
    assert (kernels.ring_restored(np.full((64, 64), 90.0), alpha) == 90).all() and (kernels.ring_restored(128 + noise, alpha, 0) == 128 + noise).all()
    changed = kernels.ring_restored(np.clip(np.rint(128 + noise), 0, 255), alpha) != np.clip(np.rint(128 + noise), 0, 255)
    assert changed.any() and not changed[alpha > 0.99].all()


def test_tiles_are_patched_inside_the_mask_alone():
    rng = np.random.default_rng(1)
    small, large = rng.random((32, 40)) * 255, np.zeros((64, 80))
    mask = np.zeros((64, 80), bool)
    mask[20:26, 30:41] = True
    assert kernels.tile_box(mask, 2, 3) == (12, 7, 24, 16) and kernels.tile_box(mask & False, 2) is None
    out = kernels.tile_patched(large, small, mask, 2, 8)
    assert (out[~mask] == 0).all()
    assert np.allclose(out[mask], kernels.resized(small, 64, 80)[mask])  # the halo hides the tile's border
    assert kernels.tile_patched(large, small, mask & False, 2) is large


def test_turned_means():
    x = np.floor(np.random.default_rng(2).random((6, 6)) * 255)
    for n in (1, 2, 4, 8):
        assert (kernels.turned_mean(x, lambda v: v, n) == x).all()
    right = lambda v: np.roll(v, 1, 1)
    assert np.allclose(kernels.turned_mean(x, right, 2), np.rint((np.roll(x, 1, 1) + np.roll(x, -1, 1)) / 2))
    four = sum(np.roll(x, s, a) for s, a in ((1, 0), (-1, 0), (1, 1), (-1, 1))) / 4
    assert np.abs(kernels.turned_mean(x, right, 8).astype(float) - four).max() <= 0.5


def test_guesses_of_a_left_out_frame():
    rng = np.random.default_rng(4)
    wide = rng.random((10, 24)) * 255
    before, truth, after = wide[:, 0:12], wide[:, 1:13], wide[:, 2:14]  # the picture pans by one
    one, zero = np.ones((10, 12)), np.zeros((10, 12))
    got = kernels.between(before, after, (one, zero), (-one, zero))
    assert np.allclose(got["forward"][:, :-1], truth[:, :-1]) and np.allclose(got["backward"][:, 1:], truth[:, 1:])
    assert kernels.psnr(got["blend"], truth) > kernels.psnr(got["mean"], truth)
    hole = np.full((10, 12), np.nan)
    half = np.where(np.arange(12) < 6, 1.0, np.nan) * one
    mixed = kernels.between(before, after, (half, zero), (hole, zero))["blend"]
    assert np.allclose(mixed[:, :6], got["forward"][:, :6]) and np.allclose(mixed[:, 6:], (before + after)[:, 6:] / 2)
    assert np.allclose(kernels.between(before, after, (one, zero), (-one, zero), distrust=(one > 0, None))["blend"], got["backward"])


def test_degraded_planes():
    x = np.random.default_rng(5).random((16, 16)) * 255
    clean, real = kernels.degraded(x, "clean"), kernels.degraded(x, "real", 3)
    assert clean.shape == real.shape == (8, 8) and (kernels.degraded(x, "real", 3) == real).all() and not (kernels.degraded(x, "real", 4) == real).all()
    assert kernels.psnr(clean, kernels.resized(x, 8, 8, "area")) > kernels.psnr(real, kernels.resized(x, 8, 8, "area"))
    with pytest.raises(ValueError):
        kernels.degraded(x, "other")
    assert all(up(clean, 16, 16).shape == (16, 16) for up in kernels.RESTORERS.values())
