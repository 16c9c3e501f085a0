"""What the jobs share: their config file, their log, and the folder that a registered query runs them in."""

from __future__ import annotations

import json
import logging
import sys
import uuid

from pyspark.sql import SparkSession

from sealedspark.layout import shared_dir

log = logging.getLogger("jobs")


def read_config(spark: SparkSession, path: str, known: dict) -> dict:
    """A JSON object from a path that Spark reads, over the defaults in `known`; a name that is not known is an error."""
    found = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # one small file
    if unknown := set(found) - set(known):
        raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
    return known | found


def log_to_stderr() -> None:
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below spark.checkpoint.dir for one call."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
