"""Session settings, and shipping the package to executors."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def session(app: str = "passbook", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; the caller's settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage, in the folder of ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (local tests) a temporary folder is set.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; on a cluster the session must name it."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="passbook-"))
    return context.getCheckpointDir()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, where PYTHONPATH or the working folder doesn't.

    The zip is served by the driver to every executor, once per application.
    """
    app = spark.sparkContext.applicationId
    top = str(ROOT.parent)
    if app in _shipped or top in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == top:
        return
    folder = tempfile.mkdtemp(prefix="passbook-ship-")
    name = f"{folder}/{ROOT.name}.zip"
    with zipfile.ZipFile(name, "w") as z:
        for path in sorted(ROOT.rglob("*.py")):
            z.write(path, path.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)
