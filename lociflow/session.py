"""What a Spark session needs for this package."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that their Python can import it."""
    context = spark.sparkContext
    if getattr(context, "_has_lociflow", False):
        return
    home = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="lociflow-code-")) / f"{home.name}.zip"
    with zipfile.ZipFile(to, "w") as archive:
        for p in sorted(home.rglob("*.py")):
            archive.write(p, p.relative_to(home.parent))
    context.addPyFile(str(to))
    context._has_lociflow = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A session without one gets a temporary folder, which only a local master can share.
    """
    place = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lociflow-"))
        place = spark.sparkContext.getCheckpointDir()
    return place


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder; lineage ends there, and so do the shuffle files that led to it, which else stay until the driver collects garbage."""
    shared_dir(df.sparkSession)
    name, conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", df.sparkSession.conf
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        conf.set(name, before)
