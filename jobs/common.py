"""What the jobs share: configuration, logging, the session of a command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import SparkSession


def configured(spark: SparkSession, kind: type, path: str | None):
    """``kind`` with the values of a small JSON file, read by Spark, so that it may lie in any store. Unknown names are errors."""
    if not path:
        return kind()
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    given = json.loads(text)
    unknown = set(given) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings in {path}: {', '.join(sorted(unknown))}")
    return kind(**given)


def main(name: str, arguments: dict[str, str], run: Callable, kind: type, argv: list[str] | None = None) -> None:
    """A command line with one option per path and ``--config``; it alone makes and stops the session."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    for option, text in arguments.items():
        parser.add_argument(f"--{option}", required=True, help=text)
    parser.add_argument("--config", help="JSON file of settings")
    given = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    from lacuna.session import build_session

    spark = build_session(name)
    try:
        settings = configured(spark, kind, given.pop("config"))
        run(spark, **given, settings=settings)
    finally:
        spark.stop()
