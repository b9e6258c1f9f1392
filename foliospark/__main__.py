"""python -m foliospark [paper|book] PATH OUT [--settings FILE] [--glossary FILE] [--backend MODULE:FUNCTION] [--dialect D]

Reads the text files of PATH, runs a pipeline and writes one outline per file, and of papers the structured text."""

from __future__ import annotations

import argparse
from glob import glob
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from foliospark.operators import model
from foliospark.options import load_options
from foliospark.plans import pipelines
from foliospark.sources import files

# The names of the two modes.
MODES = {"paper": "paper", "p": "paper", "1": "paper", "book": "book", "b": "book", "2": "book"}


def backend_of(name: str | None) -> model.Backend:
    """A function by module:function, the stub without one."""
    if not name:
        return model.stub
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(prog="foliospark")
    args.add_argument("mode", type=lambda m: MODES[m.strip().lower()])
    args.add_argument("path", nargs="?")
    args.add_argument("out", nargs="?", default="output")
    args.add_argument("--settings")
    args.add_argument("--glossary")
    args.add_argument("--backend")
    args.add_argument("--dialect", default="python")
    a = args.parse_args(argv)
    a.path = (a.path or input("Path of the text file: ")).strip().strip("\"'")
    if "://" not in a.path and not glob(a.path):
        args.error(f"no such file or folder: {a.path}")
    spark = SparkSession.builder.getOrCreate()
    options, backend = load_options(a.settings, dialect=a.dialect), backend_of(a.backend)
    docs = files.read_documents(spark, a.path, a.dialect)
    glossary = ""
    if a.glossary:
        found = spark.read.text(a.glossary, wholetext=True).select(files.glossary_text(F.col("value")).alias("g")).first()
        glossary = found.g if found else ""
    if a.mode == "book":
        files.write_documents(pipelines.book(docs, backend, options, glossary), a.out, text="outline")
        return
    done = pipelines.paper(docs, backend, options, glossary)
    files.write_documents(done, a.out, text="structured", suffix="_structured_eng.md")
    files.write_documents(done, a.out, text="outline")


if __name__ == "__main__":
    main()
