"""What the jobs share: their configuration, tables that may not exist yet, and sessions of the command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or no rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def put(df: DataFrame, path: str, *by: str) -> None:
    """Writes the partitions that ``df`` has rows of in place of what they held; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def config(name: str, given: str | None = None) -> dict:
    """The job's own settings, with those of the file ``given`` in their place."""
    found = json.loads((Path(__file__).parent / f"{name}.json").read_text())
    if given:
        more = json.loads(Path(given).read_text())
        if unknown := set(more) - set(found):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        found |= more
    return found


def main(name: str, about: str, paths: dict[str, str], run: Callable[..., dict]) -> None:
    """The command line: a path for each of ``paths``, and a file of settings; starts and stops the session."""
    args = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    for p, what in paths.items():
        args.add_argument(f"--{p}", required=True, help=what)
    args.add_argument("--config", help=f"JSON file of settings that differ from jobs/{name}.json")
    given = vars(args.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    settings = config(name, given.pop("config"))
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        print(json.dumps(run(spark, **given, settings=settings), default=str))
    finally:
        spark.stop()
