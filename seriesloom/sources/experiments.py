"""A log of experiments: metrics and configurations as append-only tables, reports as JSON."""

from __future__ import annotations

import hashlib
import json
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession


def format_duration(seconds: float) -> str:
    """Hours, minutes and seconds, in Russian abbreviations."""
    s = int(seconds)
    return f"{s // 3600}ч {s % 3600 // 60}м {s % 60}с"


class ExperimentManager:
    """Tables under path: metrics (experiment_id, at, name, value), configs (experiment_id, at, key, value), reports."""

    def __init__(self, spark: SparkSession, path: str, config: dict):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        self.experiment_id = hashlib.md5(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:8]
        self.began = time.time()

    def _now(self) -> str:
        return datetime.now(UTC).isoformat(timespec="seconds")

    def log_metrics(self, metrics: dict[str, float]) -> None:
        rows = [(self.experiment_id, self._now(), k, float(v)) for k, v in {**metrics, "duration_seconds": time.time() - self.began}.items()]
        self.spark.createDataFrame(rows, "experiment_id string, at string, name string, value double").coalesce(1).write.mode("append").parquet(f"{self.path}/metrics")

    def log_config(self) -> None:
        rows = [(self.experiment_id, self._now(), str(k), str(v)) for k, v in self.config.items()]
        self.spark.createDataFrame(rows, "experiment_id string, at string, key string, value string").coalesce(1).write.mode("append").parquet(f"{self.path}/configs")

    def log_report(self, report: dict) -> None:
        rows = [(self.experiment_id, self._now(), json.dumps(report, default=str))]
        self.spark.createDataFrame(rows, "experiment_id string, at string, report string").coalesce(1).write.mode("append").json(f"{self.path}/reports")

    def metrics(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/metrics")
