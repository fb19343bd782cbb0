"""Joinability and unionability on a small random CSV lake vs plain-Python brute force."""

import itertools
import random

import pandas as pd
import pytest

from conftest import write_csv
from lakesift.config import ScoreConfig
from lakesift.operators import pairs as pr
from lakesift.plans.labelling import LakeState
from lakesift.sources.lake import Lake

def profile(series):
    """One column as a data frame reader types it: by values, not by cell texts."""
    vals = series.dropna()
    if vals.empty:
        return dict(kind="string", card=0.0, set=set(), empty=True)
    try:
        pd.to_numeric(vals, errors="raise")
        kind = "numeric"
    except (ValueError, TypeError):
        kind = "string"
    counts, first = {}, {}
    for i, k in enumerate(vals.astype(str).str.lower().str.strip()):
        counts[k] = counts.get(k, 0) + 1
        first.setdefault(k, i)
    top = sorted(counts, key=lambda k: (-counts[k], first[k]))[:200]
    return dict(kind=kind, card=vals.nunique() / len(vals), set=set(top), empty=False)


def joinability(pq, pc):
    best = 0.0
    for a in pq:
        if (a["kind"] == "numeric" and a["card"] > 0.8) or not a["set"]:
            continue
        for b in pc:
            if (b["kind"] == "numeric" and b["card"] > 0.8) or not b["set"] or a["kind"] != b["kind"]:
                continue
            k = len(a["set"] & b["set"])
            best = max(best, k / len(a["set"]), k / len(b["set"]))
    return best


def unionability(pq, pc):
    def sim(a, b):
        if a["kind"] != b["kind"]:
            return 0.0
        if not a["set"] and not b["set"]:
            jac = 1.0
        elif not a["set"] or not b["set"]:
            jac = 0.0
        else:
            jac = len(a["set"] & b["set"]) / len(a["set"] | b["set"])
        return 0.7 * jac + 0.3 * (1.0 - abs(a["card"] - b["card"]))

    rows, cols = (pq, pc) if len(pq) <= len(pc) else (pc, pq)
    best = max(sum(sim(r, cols[j]) if rows is pq else sim(cols[j], r) for r, j in zip(rows, perm))
               for perm in itertools.permutations(range(len(cols)), len(rows)))
    return best / max(len(pq), len(pc))


@pytest.mark.parametrize("seed", [11, 5, 23])
def test_random_lake_against_brute_force(spark, lake_dir, seed):
    rnd = random.Random(seed)
    words = ["Ant", "bee", "Cat", "dog ", "eel", "fox", "GNU", "hen"]
    tables = {}
    for t in range(4):
        n_cols, n_rows = rnd.randint(1, 4), rnd.randint(5, 40)
        cols = []
        for _ in range(n_cols):
            kind = rnd.choice(["int", "word", "mixed", "key"])
            if kind == "int":
                col = [str(rnd.randint(0, 9)) for _ in range(n_rows)]
            elif kind == "key":
                col = [str(i) for i in range(n_rows)]
            elif kind == "word":
                col = [rnd.choice(words) for _ in range(n_rows)]
            else:
                col = [rnd.choice(words + ["1", "2"]) for _ in range(n_rows)]
            col = [("" if rnd.random() < 0.1 else v) for v in col]
            cols.append(col)
        header = [f"c{i}" for i in range(n_cols)]
        rows = [list(r) for r in zip(*cols)]
        write_csv(lake_dir / f"t{t}.csv", header, rows)
        frame = pd.read_csv(lake_dir / f"t{t}.csv", low_memory=False)
        tables[f"t{t}.csv"] = [profile(frame[c]) for c in frame.columns]
    st = LakeState(Lake.from_folder(spark, str(lake_dir), fmt="csv"), ScoreConfig())
    names = {r.table_idx: r.table_name for r in st.tables.collect()}
    j = {(names[r.q_idx], names[r.c_idx]): r.joinability for r in pr.mirror(st.joinability, st.cfg).collect()}
    u = {(names[r.q_idx], names[r.c_idx]): r.unionability for r in pr.mirror(st.unionability, st.cfg).collect()}
    assert len(j) == len(u) == 16
    for (q, c), v in j.items():
        assert abs(v - joinability(tables[q], tables[c])) < 1e-9, (q, c)
        assert abs(u[(q, c)] - unionability(tables[q], tables[c])) < 1e-9, (q, c)
