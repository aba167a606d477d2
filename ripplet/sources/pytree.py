"""Python source trees as a table.

The driver walks the tree once, pruning directories, and deals the files to
partitions; executors read them. Built-in file sources skip names that begin
with an underscore, so ``__init__.py`` needs a source of its own.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ripplet.plans.schemas import SOURCE_FILES

#: Directories that are never entered, beside those that begin with a dot.
EXCLUDED = frozenset(["__pycache__", "node_modules", "venv", "env"])
FILES_PER_PARTITION = 256


def walk(root: str) -> Iterator[str]:
    """Python files in scan order: those of a directory by name, then its subdirectories by name. Links to directories are not followed."""
    with os.scandir(root) as entries:
        found = sorted(entries, key=lambda e: e.name)
    yield from (e.path for e in found if e.name.endswith(".py") and e.is_file())
    for e in found:
        if e.is_dir(follow_symlinks=False) and e.name not in EXCLUDED and not e.name.startswith("."):
            yield from walk(e.path)


class _Files(InputPartition):
    def __init__(self, files: list[tuple[int, str]]) -> None:
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, path: str, per: int) -> None:
        self.path, self.per = path, per

    def partitions(self) -> list[InputPartition]:
        files = list(enumerate(walk(self.path)))
        return [_Files(files[i : i + self.per]) for i in range(0, len(files), self.per)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for number, path in partition.files:
            with open(path, "rb") as f:
                content = f.read()
            stat = os.stat(path)
            yield number, path, os.path.abspath(path), stat.st_mtime_ns, stat.st_size, content


class PythonTree(DataSource):
    """``spark.read.format("pytree").load(directory)``"""

    @classmethod
    def name(cls) -> str:
        return "pytree"

    def schema(self):  # noqa: ANN201
        return SOURCE_FILES

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["path"], int(self.options.get("filesPerPartition", FILES_PER_PARTITION)))


def source_files(spark: SparkSession, directory: str) -> DataFrame:
    spark.dataSource.register(PythonTree)
    return spark.read.format("pytree").load(directory)
