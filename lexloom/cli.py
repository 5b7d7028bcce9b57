"""python -m lexloom.cli run --config FILE ... | validate-extraction PATH..."""

from __future__ import annotations

import argparse
import json

from pyspark import SparkConf
from pyspark.sql import SparkSession

from lexloom.plans import cleaning, config


def main(args: list[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="lexloom")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run")
    run.add_argument("--config", required=True)
    run.add_argument("--input", action="append")
    for name in ("input-format", "output", "output-format", "log-level", "checkpoint-dir", "stats-output", "stats-format"):
        run.add_argument(f"--{name}")
    run.add_argument("--threads", type=int)
    run.add_argument("--batch-size", type=int)
    run.add_argument("--dry-run", action="store_true")
    check = commands.add_parser("validate-extraction")
    check.add_argument("paths", nargs="+")
    check.add_argument("--report", choices=("text", "json"), default="text")
    a = parser.parse_args(args)
    if a.command == "validate-extraction":
        found = cleaning.validate_extraction(SparkSession.builder.getOrCreate(), a.paths)
        print(json.dumps(found, indent=2) if a.report == "json" else "\n".join(f"{k}: {v}" for k, v in found.items()))
        return found
    given = {"input": {"paths": a.input, "format": a.input_format}, "output": {"path": a.output, "format": a.output_format}, "runtime": {"threads": a.threads, "batch_size": a.batch_size, "log_level": a.log_level, "checkpoint_dir": a.checkpoint_dir}, "stats": {"output_path": a.stats_output, "format": a.stats_format}}
    with open(a.config) as f:
        chosen = config.load(f.read(), {t: {k: v for k, v in x.items() if v is not None} for t, x in given.items()})
    threads = chosen["runtime"]["threads"]
    builder = SparkSession.builder
    if not SparkConf().contains("spark.master"):  # else the cluster that it was submitted to
        builder = builder.master(f"local[{threads or '*'}]")
    spark = builder.config("spark.sql.execution.arrow.maxRecordsPerBatch", chosen["runtime"]["batch_size"]).getOrCreate()
    spark.sparkContext.setLogLevel(chosen["runtime"]["log_level"].upper())
    return cleaning.run(spark, chosen, a.dry_run).report


if __name__ == "__main__":
    main()
