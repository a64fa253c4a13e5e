"""Session construction for scripts, tests and the benchmark."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(
    app: str = "corpusmill",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    driver_memory: str | None = None,
) -> SparkSession:
    """A session in UTC with adaptive execution on.

    Nothing here overrides what a cluster sets: master, memory and the number of
    shuffle partitions are only set where the caller names them.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster, once per application.

    Executors that already have it on their path are unaffected; a local master needs nothing where
    its workers find the package by the working folder or the path.
    """
    context = spark.sparkContext
    root = Path(__file__).resolve().parent
    found = {Path.cwd(), *map(Path, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)))}
    at_hand = re.fullmatch(r"local(\[.*\])?", context.master) and root.parent in {p.resolve() for p in found}
    if at_hand or getattr(context, "_corpusmill_shipped", False):
        return
    folder = Path(tempfile.mkdtemp(prefix="corpusmill-ship-"))
    archive = folder / "corpusmill.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent).as_posix())
    context.addPyFile(str(archive))
    context._corpusmill_shipped = True
