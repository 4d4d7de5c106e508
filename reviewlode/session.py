"""A session with the settings that the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, Arrow; ``conf`` overrides.  On a cluster leave ``master`` to spark-submit."""
    b = SparkSession.builder.appName("reviewlode")
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k: str(v) for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers as a zip, where it is not installed on them."""
    import io
    import pathlib
    import tempfile
    import zipfile

    root = pathlib.Path(__file__).parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in root.rglob("*.py"):
            z.write(f, pathlib.Path("reviewlode") / f.relative_to(root))
    with tempfile.NamedTemporaryFile(prefix="reviewlode", suffix=".zip", delete=False) as f:  # read once by the driver
        f.write(data.getvalue())
    spark.sparkContext.addPyFile(f.name)


def checkpointing(spark: SparkSession, local_default: str | None = None) -> bool:
    """Sets the shared checkpoint folder that the cluster names; ``local_default`` only where it names none, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return True
    folder = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("REVIEWLODE_CHECKPOINTS") or local_default
    if folder:
        sc.setCheckpointDir(folder)
    return bool(folder)
