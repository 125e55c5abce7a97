"""What queries need of their session, and helpers that keep clear of users' columns."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of every host, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_spanloom_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spanloom-"), "spanloom_package.zip")  # read by the driver alone, which serves it
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(_PACKAGE.rglob("*.py")):
            archive.write(file, Path(_PACKAGE.name) / file.relative_to(_PACKAGE))
    sc.addPyFile(path)
    sc._spanloom_shipped = True


def unused(taken: Iterable[str], *stems: str) -> list[str]:
    """A column name for each stem that none of the taken names equals, whatever their case."""
    held = {name.lower() for name in taken}
    out = []
    for stem in stems:
        name, n = stem, 0
        while name.lower() in held:
            n += 1
            name = f"{stem}_{n}"
        held.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own on local masters, and an error on others."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all hosts share")
        found = tempfile.mkdtemp(prefix="spanloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
