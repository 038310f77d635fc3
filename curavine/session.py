"""What a Spark session needs to run this package's Python functions."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def find_package(spark: SparkSession) -> None:
    """Let Python workers look for the package where the driver found it.

    A cluster installs the package or ships it as a Python file; this is for workers that see the driver's
    folders, as in local mode, when the driver runs in another folder. It does nothing twice.
    """
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
