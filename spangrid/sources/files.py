"""Files of a folder as rows. Names with a leading underscore or dot, which Spark's own readers skip, are kept."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .globs import glob_regex

LIMIT = 4 << 20
# Extensions of source files, and directories that are not entered.
_CODE = ".ts .tsx .mts .cts .js .jsx .mjs .cjs .py .pyi .java .rs .zig .go .c .h .cc .cpp .cxx .hpp .hxx .cs .rb .php .kt .kts .swift .m .mm .scala .sc .dart .lua .ml .mli .ex .exs .erl .hrl .hs .sh .bash .zsh .fish .pl .pm .r .R .sql .vue .svelte .html .css .scss .less"
CODE_EXTENSIONS = tuple(_CODE.split())
EXCLUDED_DIRS = ("node_modules", "vendor", "dist", "build", "target", "zig-out", "__pycache__")


def walk(folder: str, recursive: bool) -> Iterator[str]:
    """Paths below a folder in byte order, without hidden and tool folders."""
    for base, folders, names in os.walk(folder):
        folders[:] = sorted(d for d in folders if not d.startswith(".") and d not in EXCLUDED_DIRS) if recursive else []
        for name in sorted(names):
            yield os.path.join(base, name)


def expand(pattern: str, root: str = ".") -> list[str]:
    """Paths below root that match a shell pattern."""
    regex = re.compile(glob_regex(pattern))
    return [p for p in walk(root, True) if regex.fullmatch(os.path.relpath(p, root))]


def read_paths(spark: SparkSession, paths: list[str], limit: int = LIMIT, contents: bool = True) -> DataFrame:
    """(path, name, n_bytes, content) of files on storage that all executors see; larger files have no content."""
    schema = "path string, name string, n_bytes long, content binary"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                size = os.path.getsize(path)
                data = None
                if contents and size <= limit:
                    with open(path, "rb") as f:
                        data = f.read()
                rows.append((path, os.path.basename(path), size, data))
            yield pd.DataFrame(rows, columns=["path", "name", "n_bytes", "content"])

    n = max(1, min(len(paths), spark.sparkContext.defaultParallelism * 4))
    listed = spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "path string").repartition(n)
    return listed.mapInPandas(read, schema)


def read_directory(spark: SparkSession, folder: str, recursive: bool = True, code_only: bool = True, contents: bool = True) -> DataFrame:
    paths = [p for p in walk(folder, recursive) if not code_only or os.path.splitext(p)[1] in CODE_EXTENSIONS]
    return read_paths(spark, paths, contents=contents)


def read_text(spark: SparkSession, data: bytes) -> DataFrame:
    """One document from bytes, such as standard input."""
    if len(data) > LIMIT:
        raise ValueError("the input is larger than 4 MiB")
    return spark.createDataFrame([(0, data.decode("utf-8"))], "doc_id long, text string")
