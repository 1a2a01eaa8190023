"""Configuration files and settings."""

from __future__ import annotations

import json
import os

from pyspark.sql import SparkSession


def load(spark: SparkSession, path: str) -> dict:
    """A YAML or JSON configuration, read through Spark so that any store works."""
    content = spark.read.text(path, wholetext=True).first()[0]
    try:
        import yaml
    except ImportError:  # JSON is YAML as well
        return json.loads(content)
    return yaml.safe_load(content)


def setting(spark: SparkSession, names: list[str], default: str | None = None) -> str | None:
    """The first of the names that is set, non-empty, in the session or the driver's environment; never a column."""
    for name in names:
        if value := spark.conf.get(name, None) or os.environ.get(name):
            return value
    return default
