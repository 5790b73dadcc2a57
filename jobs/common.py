"""What the jobs share: a config file with command-line overrides, and a session for the command line."""

from __future__ import annotations

import argparse
import logging
from dataclasses import fields
from pathlib import Path

import yaml
from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent


def parse(kind, name: str, description: str, argv=None):
    """A config dataclass from a YAML file and command-line options, which win; lists are comma-separated."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=description)
    parser.add_argument("--config", default=str(HERE / f"{name}.yaml"), help="YAML file with the options below")
    for f in fields(kind):
        parser.add_argument(f"--{f.name.replace('_', '-')}", dest=f.name, default=None)
    given = vars(parser.parse_args(argv))
    values = yaml.safe_load(Path(given.pop("config")).read_text(encoding="utf-8")) or {}
    values |= {k: v for k, v in given.items() if v is not None}
    unknown = sorted(set(values) - {f.name for f in fields(kind)})
    if unknown:
        raise ValueError(f"unknown options: {unknown}")
    typed = {"int": int, "str": str, "tuple": lambda v: tuple(v.split(",")) if isinstance(v, str) else tuple(v)}
    by_name = {f.name: typed[f.type] for f in fields(kind)}
    return kind(**{k: by_name[k](v) for k, v in values.items()})


def command_line(run, config, name: str) -> None:
    """Runs a job in a session of its own."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, config)
    finally:
        spark.stop()
