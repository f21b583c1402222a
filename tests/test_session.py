"""Where checkpoints go when no folder is named."""

from __future__ import annotations

import os

import pytest

from reportloom.session import _own


def test_one_machine_takes_a_temporary_folder():
    assert os.path.isdir(_own("local[8]", "file:/tmp/w"))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_takes_no_machine_s_own_folder(master):
    assert _own(master, "hdfs://host/warehouse") == "hdfs://host/warehouse/_checkpoint"
    for warehouse in ("file:/tmp/w", "/tmp/w"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            _own(master, warehouse)
