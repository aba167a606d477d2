"""Command line and log of the jobs."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

log = logging.getLogger("ripplet.jobs")


def main(job: Callable, name: str, doc: str, required: tuple[str, ...], argv: list[str] | None = None) -> int:
    """Read the config file, let arguments of the same names override it, and run the job in a session of its own."""
    parser = argparse.ArgumentParser(prog=name, description=doc.splitlines()[0])
    parser.add_argument("--config", help="JSON file with the parameters")
    for key in required:
        parser.add_argument(f"--{key}", help="path; overrides the config file")
    args = parser.parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config: dict = {}
    if args.config:
        with open(args.config, encoding="utf-8") as f:
            config = json.load(f)
    config |= {k: v for k in required if (v := getattr(args, k))}
    missing = [k for k in required if not config.get(k)]
    if missing:
        parser.error(f"missing: {', '.join(missing)}")
    spark = SparkSession.builder.appName(name).config(map=config.pop("spark", {})).getOrCreate()
    try:
        job(spark, **config)
    finally:
        spark.stop()
    return 0
