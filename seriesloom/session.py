"""What a session needs before operators with Python parts run."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, wherever the driver was started."""
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        environment["PYTHONPATH"] = f"{root}:{known}" if known else root
    return spark
