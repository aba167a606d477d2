"""CSV and JSON tables with declared schemas."""

from __future__ import annotations

import os
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.plans.schemas import EDGES, MODELS, PROJECTS, SESSIONS, VERTICES

MAX_UPLOAD = 100 * 1024 * 1024
#: What an archive may unpack to, in archives of its own size.
MAX_RATIO = 20
_CSV = {"header": True, "quote": '"', "escape": '"'}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quotes are doubled inside quotes, and fields may hold line ends."""
    return spark.read.schema(schema).options(**_CSV, multiLine=True).csv(path)


def vertices_csv(spark: SparkSession, path: str) -> DataFrame:
    """Vertices with row_ord, their place within the file; a folder of several files has no order and is refused."""
    rows = read_csv(spark, path, VERTICES)
    if len(rows.inputFiles()) > 1:
        raise ValueError(f"several files have no order: {path}")
    return rows.withColumn("row_ord", F.monotonically_increasing_id())  # one file is one partition with multiLine


def graph_csv(spark: SparkSession, vertices: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Both tables of a graph; absent vertices are an error, absent edges an empty table."""
    local = vertices.removeprefix("file://")
    if "://" not in local and not os.path.exists(local):
        raise FileNotFoundError(vertices)
    return read_csv(spark, vertices, VERTICES), edges_csv(spark, edges)


def edges_csv(spark: SparkSession, path: str) -> DataFrame:
    """Edges; a missing file is an empty table."""
    local = path.removeprefix("file://")
    if "://" not in local and not os.path.exists(local):
        return spark.createDataFrame([], EDGES)
    return read_csv(spark, path, EDGES)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").options(**_CSV).csv(path)


def write_nested_json(parsed: DataFrame, path: str) -> None:
    """One object a file: file, functions, imports, and error where there is one."""
    parsed.select(F.col("filepath").alias("file"), "functions", "imports", "error").write.mode("overwrite").json(path)


def projects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROJECTS).json(path, multiLine=True)


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """Sessions of a folder, one object a file; corrupt files are skipped."""
    return spark.read.schema(f"{SESSIONS}, _corrupt_record string").json(path, multiLine=True, mode="PERMISSIVE").where("id is not null").drop("_corrupt_record")


def models(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODELS).json(path, multiLine=True)


def unzip(archive: str, target: str, limit: int = MAX_UPLOAD) -> str:
    """Extract a .zip safely: bounded size, packed and unpacked, and no member outside the target."""
    if not archive.endswith(".zip"):
        raise ValueError("only .zip archives")
    if os.path.getsize(archive) > limit:
        raise ValueError("archive too large")
    root = os.path.realpath(target)
    with zipfile.ZipFile(archive) as z:
        if sum(m.file_size for m in z.infolist()) > MAX_RATIO * limit:
            raise ValueError("archive unpacks to too much")
        for member in z.infolist():
            if os.path.commonpath([root, os.path.realpath(os.path.join(root, member.filename))]) != root:
                raise ValueError(f"member outside the target: {member.filename}")
        z.extractall(root)
    return root


def source_text(root: str, path: str) -> str:
    """One source file below ``root``; other paths are refused."""
    base, real = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    if os.path.commonpath([base, real]) != base:
        raise PermissionError(path)
    with open(real, encoding="utf-8", errors="ignore") as f:
        return f.read()
