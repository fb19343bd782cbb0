"""Write PLANS.md: physical plans of the flagship's stages on a lake.

Usage: python tools/show_plans.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)

from lakesift.config import ScoreConfig  # noqa: E402
from lakesift.operators import joinability as jn, profile as pf, semantic as sm  # noqa: E402
from lakesift.plans import queries as Q  # noqa: E402
from lakesift.plans.labelling import LakeState  # noqa: E402
from lakesift.session import local_session  # noqa: E402
from lakesift.sources.lake import Lake  # noqa: E402


def tree(df) -> str:
    """The operator tree of the executed (adaptive) plan, ids stripped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = re.sub(r"#\d+L?", "", plan)
    out = []
    for line in plan.splitlines():
        line = re.sub(r"(Location: InMemoryFileIndex\(\d+ paths?\))\[[^\]]*\]", r"\1", line)
        out.append(line[:220])
    return "\n".join(out)


def facts(text: str) -> str:
    keys = ["ReusedExchange", "WindowGroupLimit", "BroadcastHashJoin", "SortMergeJoin",
            "ShuffledHashJoin", "FlatMapGroupsInPandas", "Exchange hashpartitioning",
            "BroadcastNestedLoopJoin", "CartesianProduct", "SortAggregate", "HashAggregate"]
    return ", ".join(f"{k}: {text.count(k)}" for k in keys if text.count(k))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    lake = Lake.from_paths(spark, Q.lake_paths(sf))
    st = LakeState(lake, ScoreConfig(), materialize=True)
    raw = pf.raw_value_counts(lake.cells(with_ord=True))
    stages = [
        ("Profile bundle (one scan, one raw shuffle; stats + top-k + samples)",
         pf.bundle(raw, lake.table_rows(), st.cfg, st.n_columns, sample_ranks=sm.sample_ranks(raw, st.cfg))),
        ("Value overlap (inverted-index self-join with hot-value salting)",
         jn.value_overlap(st.profiles, st.n_columns, st.cfg)),
        ("Joinability (J3-J5 from the overlap)", st.joinability),
        ("Table vectors (hashed token bags -> dense)",
         sm.dense(sm.table_bags(st.tables, st.profiles, st.samples, st.cfg), ["table_idx"], st.cfg.embedding_dim)),
        ("Table semantic (pair cosines)",
         sm.table_semantic(st.pairs, st.table_vectors, st.n_tables, st.cfg)),
        ("Pair kernel (grouped alignment + column cosines)", st.pair_scores(True)),
        ("Labels (mirror, names, rounding)", st.labels()),
    ]
    print("# Physical plans of the labelling job\n")
    print(f"Lake: the 13 test tables of `{sf}`, local[8]; generated by `tools/show_plans.py`.")
    print("Stages downstream of the profile read checkpointed outputs (`Scan ExistingRDD`).\n")
    for title, df in stages:
        t = tree(df)
        print(f"## {title}\n\n{facts(t)}\n\n```\n{t}\n```\n")


if __name__ == "__main__":
    main()
