"""The session's share of the package."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def _own(master: str, warehouse: str) -> str:
    """A folder for checkpoints where none is named: on one machine a temporary one, on a cluster one under the warehouse, which must not be a machine's own."""
    if master.startswith("local") and "cluster" not in master:
        return tempfile.mkdtemp(prefix="checkpoint-")
    if warehouse.startswith(("file:", "/")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share; the warehouse at {warehouse} may be each machine's own")
    return f"{warehouse}/_checkpoint"


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of spark.checkpoint.dir or, where it is unset, one under the warehouse (on one machine, a temporary one)."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(given or _own(sc.master, spark.conf.get("spark.sql.warehouse.dir")))
    return given or sc.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared(spark)}/{uuid.uuid4()}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder, its lineage cut."""
    shared(df.sparkSession)
    return df.checkpoint()


def ship(spark: SparkSession | None = None) -> None:
    """Send this package to the executors once a session, so that workers can import it from anywhere."""
    spark = spark or SparkSession.active()
    sc = spark.sparkContext
    if getattr(sc, "_reportloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = Path(tempfile.mkdtemp()) / "reportloom_pkg.zip"
    path.write_bytes(data.getvalue())
    sc.addPyFile(str(path))
    sc._reportloom_shipped = True
