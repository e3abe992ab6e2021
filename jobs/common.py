"""What the jobs share: reading a config, logging, tables that may not be there yet."""

from __future__ import annotations

import argparse
import json
import logging
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def load_config(spark: SparkSession, path: str | None, defaults: dict[str, Any]) -> dict[str, Any]:
    """The defaults, overruled by a JSON file that Spark reads; an unknown key is an error."""
    if path is None:
        return dict(defaults)
    given = json.loads(spark.read.text(path, wholetext=True).first()[0])
    unknown = sorted(set(given) - set(defaults))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return {**defaults, **given}


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A parquet table of a known schema; an empty one where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def command_line(description: str, *paths: str) -> argparse.Namespace:
    """Paths as required options, and --config."""
    parser = argparse.ArgumentParser(description=description)
    for path in paths:
        parser.add_argument(f"--{path}", required=True)
    parser.add_argument("--config", help="a JSON file of settings")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return parser.parse_args()
