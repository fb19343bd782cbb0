"""Command line: label every ordered table pair of a lake folder.

    python -m lakesift LAKE_DIR OUT_PATH [--format csv|parquet]
        [--num-queries N] [--max-candidates M] [--embedder hashed|none]
        [--sink csv|parquet]

Prints the positive-pair summary (L7) when done.  On a cluster, submit it
with spark-submit; the session's ``spark.checkpoint.dir`` is used for stage
checkpoints.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lakesift.config import ScoreConfig
from lakesift.operators import labels as lb
from lakesift.plans.labelling import LakeState
from lakesift.sources.lake import Lake


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="lakesift")
    ap.add_argument("lake_dir")
    ap.add_argument("out_path")
    ap.add_argument("--format", default="csv", choices=("csv", "parquet"))
    ap.add_argument("--num-queries", type=int, default=None)
    ap.add_argument("--max-candidates", type=int, default=None)
    ap.add_argument("--embedder", default="hashed", choices=("hashed", "none"))
    ap.add_argument("--sink", default="csv", choices=("csv", "parquet"))
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("lakesift").getOrCreate()
    cfg = ScoreConfig(num_queries=a.num_queries, max_candidates=a.max_candidates, embedder=a.embedder)
    lake = Lake.from_folder(spark, a.lake_dir, fmt=a.format)
    for idx, err in sorted(lake.errors.items()):
        print(f"skipping {lake.tables[idx].name}: {err}")
    st = LakeState(lake, cfg, materialize=True)
    labels = st.labels()
    lb.write_labels(labels, a.out_path, fmt=a.sink)
    reader = spark.read.option("header", True) if a.sink == "csv" else spark.read
    out = reader.format(a.sink).load(a.out_path)
    s = lb.summary(out.selectExpr("cast(is_ground_truth as int) as is_ground_truth")).first()
    print(f"similar datasets: {s.positive_pairs}/{s.total_pairs}")


if __name__ == "__main__":
    main()
