"""The session's surroundings: the package on executors, and a folder that they share with the driver."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir; where that is unset the warehouse on a cluster, a temporary folder on one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        root = spark.conf.get("spark.sql.warehouse.dir")
    if not root:
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        root = _LOCAL[app]
    return root.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip file to the session's Python path, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="larkspur-"), "larkspur.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("larkspur", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)
    _SENT.add(app)
