"""Coarse groups of clusters: one linkage for every cut, with the groups each cut has by itself."""

import numpy as np
import pandas as pd

from quillgraph.operators import clusterpasses as P
from quillgraph.operators import grouping as U


class Local:
    """Centroids whose one group is worked on here."""

    dtypes = [("comm", "bigint"), ("embedding", "array<double>")]

    def __init__(self, x: np.ndarray):
        self.rows = pd.DataFrame({"comm": range(len(x)), "embedding": list(x)})

    def select(self, *_):
        return self

    groupBy = select

    def applyInPandas(self, f, _):
        return f(self.rows)


def by_cut(x: np.ndarray) -> np.ndarray:
    """The groups as they are found by a linkage for each cut."""
    cut, own = P.COARSE_SIM, U.average_linkage(x, P.COARSE_SIM)
    for _ in range(40):
        n = len(set(own))
        step = 0.05 if n < min(P.COARSE_LEAST, len(x)) else -0.05 if n > P.COARSE_MOST else 0.0
        if not step or not -1 < cut + step < 1:
            break
        cut += step
        new = U.average_linkage(x, cut)
        if step > 0 and len(set(new)) > P.COARSE_MOST or step < 0 and len(set(new)) < P.COARSE_LEAST:
            break
        own = new
    return own


def test_clusters_are_linked_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    for x in (rng.normal(size=(120, 64)), rng.normal(size=(90, 8)), rng.normal(size=(60, 16)) + 2, rng.normal(size=(2, 4)), np.ones((1, 4))):
        want, calls, norm = by_cut(x), [], np.linalg.norm
        with monkeypatch.context() as m:
            m.setattr(np.linalg, "norm", lambda *a, **k: calls.append(1) or norm(*a, **k))
            got = P.coarse_groups(Local(x))
        assert (got["grp"].to_numpy() == want).all() and len(calls) == 1


def test_every_cut_is_in_the_merges_of_one_run():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 6))
    x[5], x[9] = 0, np.nan
    pairs, sims = U.linkage_merges(x, -1.0)
    for least in (-0.9, -0.3, 0.0, 0.2, 0.45, 0.8, 0.99):
        assert (U.merged_groups(len(x), pairs, sims, least) == U.chained_linkage(x, least)).all()
