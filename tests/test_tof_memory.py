"""Memory of the temporal error: pairs of planes are worked out in small parts, with the same results."""

import numpy as np
import pandas as pd

from strandline.functions import flow
from strandline.plans import dense


class Given:
    def mapInPandas(self, fn, schema):  # noqa: N802
        return fn


def test_large_batches_are_cut_and_results_stay(monkeypatch):
    rng, n, sizes, whole = np.random.default_rng(1), 1500, [], flow.dense_flow
    rows = pd.DataFrame({"scene": 0, "frame_idx": range(n), "plane": list(rng.uniform(0, 255, (n, 64))), "before": list(rng.uniform(0, 255, (n, 64)))})
    monkeypatch.setattr(flow, "dense_flow", lambda a, b: sizes.append(len(a)) or whole(a, b))
    monkeypatch.setattr(dense.kernels, "RESTORERS", {"nearest": dense.kernels.RESTORERS["nearest"]})
    cut = pd.concat(list(dense.temporal_errors(Given())(iter([rows]))))
    assert max(sizes) <= 1024 and cut["frame_idx"].tolist() == list(range(n))
    monkeypatch.setattr(dense, "BUDGET", 1 << 22)
    at_once = pd.concat(list(dense.temporal_errors(Given())(iter([rows]))))
    assert np.allclose(cut["tof"], at_once["tof"], rtol=1e-9, atol=1e-12)
