"""Runs a specification of :mod:`cladeworks.plans.pipeline` on files.

    python -m cladeworks.plans.cli analysis.json --input characters=chars.parquet --export splits=out/splits --format parquet

Inputs are Parquet tables, or sequence files with ``--sequences name=path`` (any format that the readers know). Every
``--export`` writes the table of a step, as ``parquet``, ``csv`` or ``json``. ``--methods`` prints the analysis in words.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from cladeworks.plans import pipeline
from cladeworks.sources import read


def _pair(text: str) -> tuple[str, str]:
    name, sep, path = text.partition("=")
    if not (name and sep and path):
        raise argparse.ArgumentTypeError(f"name=path wanted: {text}")
    return name, path


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="cladeworks", description=__doc__.splitlines()[0])
    p.add_argument("spec")
    p.add_argument("--input", type=_pair, action="append", default=[])
    p.add_argument("--sequences", type=_pair, action="append", default=[])
    p.add_argument("--export", type=_pair, action="append", default=[])
    p.add_argument("--format", choices=("parquet", "csv", "json"), default="parquet")
    p.add_argument("--methods", action="store_true")
    a = p.parse_args(argv)
    with open(a.spec, encoding="utf-8") as f:
        spec = f.read()
    if a.methods:
        print(pipeline.methods(spec))
    if not a.export:
        return
    spark = spark or SparkSession.builder.getOrCreate()
    inputs = {n: spark.read.parquet(path) for n, path in a.input}
    inputs |= {n: read.long_characters(read.characters(spark, path)) for n, path in a.sequences}
    made = pipeline.run(spec, inputs)
    for name, path in a.export:
        if name not in made:
            raise pipeline.PipelineError(f"no step {name}")
        made[name].write.mode("overwrite").format(a.format).option("header", True).save(path)


if __name__ == "__main__":
    main()
