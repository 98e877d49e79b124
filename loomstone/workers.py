"""Python workers that find this package where the driver does."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def findable(spark: SparkSession) -> None:
    """Puts the package's folder on the workers' path (on a cluster ship it with --py-files)."""
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (here, env.get("PYTHONPATH")) if x)
