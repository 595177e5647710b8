"""Where jobs keep their work."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from caseflow.session import work_dir


def session(master, folder):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default=None: folder if name == "spark.checkpoint.dir" else default),
        sparkContext=SimpleNamespace(master=master),
    )


def test_the_clusters_folder_is_used(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = work_dir(spark, "job"), work_dir(spark, "job")
    assert first.startswith(f"{base}/job-") and first != second
    assert work_dir(session("yarn", "hdfs:///shared/"), "job").startswith("hdfs:///shared/job-")


def test_a_cluster_without_a_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_dir(session("yarn", None), "job")


def test_a_local_session_may_use_a_temporary_folder():
    assert "caseflow-" in work_dir(session("local[2]", None), "job")
