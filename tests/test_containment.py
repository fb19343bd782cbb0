"""Best containment by rounds of prefixes against the full overlap join."""

import random

import pytest

from conftest import write_csv
from lakesift.config import ScoreConfig
from lakesift.operators import containment as ct
from lakesift.plans.labelling import LakeState
from lakesift.sources.lake import Lake


@pytest.mark.parametrize("seed,bounds", [(1, ct.BOUNDS), (2, (0.0,)), (3, (0.95, 0.5, 0.02, 0.0))])
def test_equals_the_full_join(spark, lake_dir, seed, bounds):
    r = random.Random(seed)
    for t in range(7):
        rows = []
        pools = [[f"w{r.randrange(60)}" for _ in range(r.randint(1, 40))] for _ in range(3)]
        for _ in range(r.randint(5, 80)):
            rows.append([r.choice(pools[0]), r.choice(pools[1]), r.choice(pools[2]), str(r.randint(0, 6)), r.choice(["", "yes", "no"])])
        write_csv(lake_dir / f"t{t}.csv", list("abcde"), rows)
    write_csv(lake_dir / "u.csv", ["x", "y"], [["", "alone"], ["", "apart"]])
    st = LakeState(Lake.from_folder(spark, str(lake_dir), fmt="csv"), ScoreConfig())
    want = {(x["q_idx"], x["c_idx"]): x["joinability"] for x in st.joinability.collect() if x["joinability"] > 0}
    best = ct.best_containment(st.profiles, st.cfg, bounds)
    got = {(x["q_idx"], x["c_idx"]): x["joinability"] for x in best.scores.collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)
    full = ct.best_containment(st.profiles, st.cfg, (0.0,)).counted
    assert sum(best.counted) <= sum(full)
    if bounds == ct.BOUNDS:
        assert sum(best.counted) < 0.8 * sum(full)
