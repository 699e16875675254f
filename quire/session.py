"""Ship this package to Python workers, wherever the driver was started."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once for each application.

    Spark serves the archive from the driver to its executors, so it needs no shared folder.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="quire-code-")) / "quire.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, Path(root.name) / file.relative_to(root))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that all executors share: spark.checkpoint.dir, which a cluster must name."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
        named = sc.getCheckpointDir()
    return f"{named.rstrip('/')}/quire-{name}-{uuid.uuid4().hex}"


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt in turn to as many tasks as a shuffle has, before work that is long for their bytes: a table of a few row groups would leave it to as few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
