"""End to end: the command line on a CSV lake made from test tables."""

import csv
import os
import subprocess
import sys

import pyarrow.csv as pacsv
import pyarrow.parquet as pq

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def test_cli_on_csv_lake(tmp_path):
    lake = tmp_path / "lake"
    lake.mkdir()
    for t in ("nation", "region", "supplier", "customer"):
        pacsv.write_csv(pq.read_table(f"{SF}/{t}.parquet"), str(lake / f"{t}.csv"))
    (lake / "broken.csv").write_text("")
    out = tmp_path / "labels"
    env = dict(os.environ, PYTHONPATH=ROOT + os.pathsep + os.environ.get("PYTHONPATH", ""))
    res = subprocess.run([sys.executable, "-m", "lakesift", str(lake), str(out)],
                         capture_output=True, text=True, env=env, timeout=600, cwd=ROOT)
    assert res.returncode == 0, res.stderr[-2000:]
    assert "skipping broken.csv" in res.stdout
    assert "similar datasets:" in res.stdout and "/16" in res.stdout
    rows = []
    for f in sorted(out.glob("part-*.csv")):
        with open(f) as fh:
            rows += [r for r in csv.reader(fh) if r and r[0] != "query_table"]
    assert len(rows) == 16
    by = {(r[0], r[1]): r for r in rows}
    assert by[("nation.csv", "nation.csv")][4] == "1.0"          # unionability(T, T)
    assert by[("customer.csv", "supplier.csv")][2:8] == by[("supplier.csv", "customer.csv")][2:8]
