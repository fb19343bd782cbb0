import csv
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from lakesift.session import local_session

    s = local_session(cores=4, shuffle_partitions=4, app="lakesift-tests")
    yield s


def write_csv(path, header, rows):
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        if header is not None:
            w.writerow(header)
        w.writerows(rows)


@pytest.fixture
def lake_dir(tmp_path):
    """A folder to build a small hand-made CSV lake in."""
    d = tmp_path / "lake"
    d.mkdir()
    return d
