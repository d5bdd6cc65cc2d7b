"""Runs of the near-dedup stage that are longer than what is compared at once."""

import numpy as np

from wayfault.llm import near_copies


def test_no_link_of_a_long_run_is_lost(monkeypatch):
    """Near members far from the run's start and from each other in the run are connected."""
    rng = np.random.default_rng(7)
    fps = rng.integers(0, 2**63, (60, 4)).astype(np.uint64)
    fps[50] = fps[20] ^ np.uint64(5)
    fps[35] = fps[50] ^ np.uint64(9)
    monkeypatch.setattr(near_copies, "HELD", 16)
    monkeypatch.setattr(near_copies, "ANCHORS", 4, raising=False)
    edges = {frozenset((int(i), int(j))) for us, vs in near_copies.run_forest(fps, np.arange(60)) for i, j in zip(us, vs, strict=True)}
    assert len(edges) == 2 and frozenset().union(*edges) == {20, 35, 50}
