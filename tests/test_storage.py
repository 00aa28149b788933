"""The shared folder, what passes in it, and folds whose workers have only the shipped package."""

import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from wayfold.operators import storage

ROOT = Path(__file__).resolve().parents[1]


def session(master, base=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: base), sparkContext=SimpleNamespace(master=master, applicationId=f"test-{master}"))


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_base(session("spark://somewhere:7077"))
    assert storage.shared_base(session("spark://somewhere:7077", "s3a://x/y/")) == "s3a://x/y"
    local = storage.shared_base(session("local[2]"))
    assert local.startswith("file://") and storage.shared_base(session("local[2]")) == local


def test_passing_folders_are_deleted(spark):
    kept = storage.stored(spark.range(3).toDF("id"), storage.scratch(spark, "kept"))
    with storage.passing(spark):
        where = storage.scratch(spark, "passing")
        storage.stored(kept, where)
        assert Path(where.removeprefix("file:").replace("//", "/")).exists()
    assert not Path(where.removeprefix("file:").replace("//", "/")).exists()
    assert kept.count() == 3


FOLDS = """
import sys
sys.path.insert(0, {root!r})
from wayfold.session import build_session
from wayfold.plans import catalog
spark = build_session("shipped", cpus=2, shuffle=2)
for name in ("gps_validate", "motion_filter", "stream_outliers"):
    print(name, catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count())
"""


def test_folds_run_where_workers_lack_the_repository(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", FOLDS.format(root=str(ROOT))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert all(int(line.split()[1]) > 0 for line in done.stdout.splitlines() if line.startswith(("gps_", "motion_", "stream_")))
