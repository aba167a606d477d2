"""The engine's commands: parse, analyze, query, load and show."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ripplet.functions.extract import calls_of, functions_of, imports_of
from ripplet.operators import build, load, registry, report, resolve, traverse
from ripplet.operators.cache import ParseCache, parse_directory
from ripplet.operators.components import materialize
from ripplet.operators.store import Store
from ripplet.plans.schemas import ENTRY, PROJECTS, SESSIONS
from ripplet.plans.shipping import ship
from ripplet.sources import tables


class NoSourceFiles(ValueError):
    """A tree without Python files."""


#: Names that an impact lists; the rest is in its table.
PAGE = 1000


@dataclass
class Impact:
    """What a change affects: the whole table ``found(id, name, type)``, its size, and the first ``PAGE`` rows by id."""

    question: str
    target: str
    target_type: str
    found: DataFrame
    total: int
    nodes: list[dict]
    risk: str
    explanation: str


@dataclass
class Parsed:
    files: DataFrame
    functions: DataFrame
    calls: DataFrame
    imports: DataFrame
    rows: DataFrame

    def totals(self) -> DataFrame:
        return report.parse_totals(self.rows)


def parse(spark: SparkSession, directory: str, cache: str | None = None) -> Parsed:
    ship(spark)
    rows = materialize(parse_directory(spark, directory, ParseCache(spark, cache) if cache else None), "parsed")
    if rows.isEmpty():
        raise NoSourceFiles(directory)
    return Parsed(rows.select("file_ord", "filepath", "path_id"), functions_of(rows), calls_of(rows), imports_of(rows), rows)


def build_graph(parsed: Parsed, mode: str = "reference") -> tuple[DataFrame, DataFrame]:
    return build.vertices(parsed.files, parsed.functions), build.edges(parsed.files, parsed.functions, parsed.calls, parsed.imports, mode)


def write_parsed(parsed: Parsed, out: str, kind: str = "csv", mode: str = "reference") -> None:
    """The result of ``parse`` as files: vertices and edges as CSV, or the parsed files as nested JSON."""
    if kind == "json":
        tables.write_nested_json(parsed.rows, f"{out}/dependency_graph")
    elif kind == "csv":
        vertices, edges = build_graph(parsed, mode)
        tables.write_csv(vertices, f"{out}/vertices")
        tables.write_csv(edges, f"{out}/edges")
    else:
        raise ValueError(f"kind must be csv or json, not {kind!r}")


class Engine:
    """One graph at one path; with a folder of registries, projects and sessions are kept there."""

    def __init__(self, spark: SparkSession, path: str, registries: str | None = None) -> None:
        self.spark, self.path = spark, path
        self.projects = Store(spark, f"{registries}/projects", PROJECTS) if registries else None
        self.sessions = Store(spark, f"{registries}/sessions", SESSIONS) if registries else None

    def load_project(self, directory: str, cache: str | None = None, mode: str = "reference", replace: bool = True, name: str | None = None) -> tuple[int, int]:
        parsed = parse(self.spark, directory, cache)
        vertices, edges = build_graph(parsed, mode)
        counts = load.load_graph(self.spark, vertices, edges, self.path, "replace" if replace else "append")
        if self.projects:
            self.projects.replace(registry.register_project(self.projects.load(), directory, name, *counts, parsed.files.count()))
        return counts

    def reload_project(self, key: str, cache: str | None = None) -> tuple[int, int]:
        """Parse a registered project again, by its id."""
        row = registry.lookup(self.projects.load(), key).first()
        if row is None:
            raise KeyError(key)
        return self.load_project(row.path, cache)

    def ingest_zip(self, archive: str, staging: str) -> tuple[int, int]:
        return self.load_project(tables.unzip(archive, staging))

    def graph_data(self) -> tuple[DataFrame, DataFrame]:
        return report.graph_payload(*load.graph(self.spark, self.path))

    def open_session(self, name: str = "") -> str:
        key, row = registry.create_session(name)
        self.sessions.replace(registry.save(self.sessions.load(), self.spark.createDataFrame([row], SESSIONS)))
        return key

    def delete_session(self, key: str) -> None:
        self.sessions.replace(registry.delete(self.sessions.load(), key))

    def delete_sessions(self) -> int:
        found = self.sessions.load().count()
        self.sessions.clear()
        return found

    def query(
        self, question: str, depth: int = 5, direction: str = "out", extractor: Callable[[str], str] | None = None, writer: Callable[[str], str] | None = None, session: str | None = None, candidates: list[str] | None = None
    ) -> Impact:
        """What a change affects. ``candidates``: vertex CSVs to look a target up in that the graph lacks; ``session``: where the answer is recorded."""
        traverse.check_depth(depth, api=True)
        vertices, edges = load.graph(self.spark, self.path)
        named = vertices.withColumn("type", F.when(F.col("type") == "CodeFile", "File").when(F.col("type") == "CodeFunction", "Function").otherwise(F.col("type"))).withColumn("row_ord", F.col("id"))
        target, kind = resolve.extract_target(named, question, extractor)
        if kind == "unknown":
            raise ValueError("no target in the question")
        start = resolve.resolve_in(self.spark, named, target, kind, candidates or []) or target
        found = materialize(report.affected_nodes(traverse.affected(edges, start, kind, depth, direction).join(vertices.select("id"), "id", "left_semi")), "impact")
        total, level = report.risk_levels(found.agg(F.count("*").alias("n_affected"))).first()
        nodes = [r.asDict() for r in found.orderBy("id").limit(PAGE).collect()]
        answer = Impact(question, target, kind, found, total, nodes, level, report.explanation(question, target, [n["name"] for n in nodes], writer, total))
        if session and self.sessions:
            entry = self.spark.createDataFrame([(question, target, kind, [n["id"] for n in nodes], answer.explanation, level, total)], "question string, target string, target_type string, affected array<string>, explanation string, risk string, n_affected bigint")
            self.sessions.replace(registry.add_entry(self.sessions.load(), session, entry.withColumn("timestamp", registry.now()).select(*StructType.fromDDL(ENTRY).names)))
        return answer


def analyze(spark: SparkSession, directory: str, graph_path: str, question: str | None = None, depth: int = 5, registries: str | None = None) -> tuple[tuple[int, int], Impact | None]:
    """Parse, build and load a tree, register it where there are registries, and answer one question if there is one."""
    engine = Engine(spark, graph_path, registries)
    counts = engine.load_project(directory)
    return counts, engine.query(question, depth) if question else None
