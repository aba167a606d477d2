"""Vertices and edges from files, functions, calls and imports.

Inputs: ``files(file_ord, filepath, path_id)``, ``functions(file_ord, func_ord, path_id,
name)``, ``calls(file_ord, func_ord, callee)`` and ``imports(file_ord, module)``. The order of the scan is
explicit in the ``*_ord`` columns; "first" always means the least of these.

The lookup sides are aggregated to one row a key before any join, with partial sums on
the map side; what a common name or module brings together is then on the
other side only, where AQE splits it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplet.functions.scalars import base_name, file_id, func_id

#: Files whose functions of one name are sorted together.
STRETCH = 256


def file_vertices(files: DataFrame) -> DataFrame:
    own = files.select(file_id(F.col("path_id")).alias("id"), "file_ord", "filepath")
    return own.groupBy("id").agg(F.min_by("filepath", "file_ord").alias("filepath")).select("id", F.lit("File").alias("type"), base_name(F.col("filepath")).alias("name"), "filepath")


def function_vertices(functions: DataFrame, files: DataFrame) -> DataFrame:
    """One vertex for each path and simple name; the first definition wins."""
    first = functions.groupBy("path_id", "name").agg(F.min("file_ord").alias("file_ord"))
    return first.join(files.select("file_ord", "filepath"), "file_ord").select(func_id(F.col("path_id"), F.col("name")).alias("id"), F.lit("Function").alias("type"), "name", "filepath")


def vertices(files: DataFrame, functions: DataFrame) -> DataFrame:
    return file_vertices(files).unionByName(function_vertices(functions, files))


def contains_edges(functions: DataFrame) -> DataFrame:
    """One edge for each definition, repeats of a name included."""
    return functions.select(file_id(F.col("path_id")).alias("source"), func_id(F.col("path_id"), F.col("name")).alias("target"), F.lit("CONTAINS").alias("type"))


def name_index(functions: DataFrame) -> DataFrame:
    """Name to all its function ids in scan order.

    Ids are listed for each stretch of ``STRETCH`` files first, so places are sorted in small groups and a task holds only the ids themselves of a common name.
    """
    at = functions.groupBy("name", "path_id").agg(F.min(F.struct("file_ord", "func_ord")).alias("pos"))
    listed = F.sort_array(F.collect_list(F.struct("pos", func_id(F.col("path_id"), F.col("name")).alias("uid"))))
    parts = at.groupBy("name", F.floor(F.col("pos.file_ord") / STRETCH).alias("at")).agg(F.transform(listed, lambda x: x["uid"]).alias("ids"))
    in_order = F.sort_array(F.collect_list(F.struct("at", "ids")))
    return parts.groupBy("name").agg(F.flatten(F.transform(in_order, lambda x: x["ids"])).alias("func_ids"))


def _targets(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls with the path and the place of the first definition of that name in the same file, and anywhere.

    The first one anywhere is the first of those in each file, so functions are aggregated once.
    """
    local = functions.groupBy("file_ord", F.col("name").alias("callee")).agg(F.min_by("path_id", "func_ord").alias("local_path"), F.min("func_ord").alias("local_ord"))
    pos = F.struct("file_ord", F.col("local_ord").alias("func_ord"))
    anywhere = local.groupBy("callee").agg(F.min_by("local_path", pos).alias("global_path"), F.min(pos).alias("global_pos"))
    return calls.join(local, ["file_ord", "callee"], "left").join(anywhere, "callee", "left")


def _with_callers(found: DataFrame, functions: DataFrame) -> DataFrame:
    """The caller of each call; one shuffle of the functions serves to drop repeats and to join."""
    own = functions.select("file_ord", "func_ord", func_id(F.col("path_id"), F.col("name")).alias("caller")).repartition("file_ord", "func_ord").distinct()
    return found.join(own, ["file_ord", "func_ord"])


def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls with caller, local_uid, global_uid, target and the place of the target's first definition.

    A definition of that name in the same file comes first, then the first one anywhere.
    """
    found = _with_callers(_targets(calls, functions), functions)
    uid = lambda kind: func_id(F.col(f"{kind}_path"), F.col("callee"))
    local_pos = F.when(F.col("local_ord").isNotNull(), F.struct("file_ord", F.col("local_ord").alias("func_ord")))
    found = found.withColumns({"local_uid": uid("local"), "global_uid": uid("global"), "local_pos": local_pos})
    found = found.withColumns({"target": F.coalesce("local_uid", "global_uid"), "target_pos": F.coalesce("local_pos", "global_pos")})
    return found.drop("local_path", "local_ord", "global_path")


def call_edges(calls: DataFrame, functions: DataFrame, mode: str = "reference") -> DataFrame:
    """``reference``: only callees defined at or before the caller, in scan order; ``complete``: later ones as well."""
    if mode not in {"reference", "complete"}:
        raise ValueError(f"mode must be reference or complete, not {mode!r}")
    found = _targets(calls, functions).withColumn("path", F.coalesce("local_path", "global_path")).where("path is not null")
    if mode == "reference":  # before the callers are joined, so that what is dropped is not shuffled for them
        here = F.col("local_ord").isNotNull()
        found = found.where(F.when(here, F.col("local_ord") <= F.col("func_ord")).otherwise(F.col("global_pos") <= F.struct("file_ord", "func_ord")))
    kept = _with_callers(found.select("file_ord", "func_ord", "callee", "path"), functions)
    return kept.select(F.col("caller").alias("source"), func_id(F.col("path"), F.col("callee")).alias("target"), F.lit("CALLS").alias("type"))


def unresolved_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    return calls.join(functions.select(F.col("name").alias("callee")).distinct(), "callee", "left_anti")


def module_index(files: DataFrame) -> DataFrame:
    """Every dotted suffix of a path, with the first file that has it."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("path_id", r"\\", "/"), r"\.py$", ""), r"/__init__$", "")
    parts = files.select("file_ord", "path_id", F.split(plain, "/").alias("s"))
    each = parts.select("file_ord", "path_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.array_join(F.slice("s", i, F.size("s")), "."))).alias("module"))
    return each.where("module <> ''").groupBy("module").agg(F.min_by(file_id(F.col("path_id")), "file_ord").alias("file"))


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """One edge for each import statement whose module is a dotted suffix of a file; self-imports included."""
    source = files.select("file_ord", file_id(F.col("path_id")).alias("source"))
    return imports.join(module_index(files), "module").join(source, "file_ord").select("source", F.col("file").alias("target"), F.lit("IMPORTS").alias("type"))


def edges(files: DataFrame, functions: DataFrame, calls: DataFrame, imports: DataFrame, mode: str = "reference") -> DataFrame:
    """The bag of all edges."""
    return contains_edges(functions).unionByName(call_edges(calls, functions, mode)).unionByName(import_edges(imports, files))


def _first_anywhere(functions: DataFrame, files: DataFrame) -> DataFrame:
    """(name, path, place) of the first definition of each name; a place is one number, which is aggregated without sorting."""
    path = files.groupBy("file_ord").agg(F.min("path_id").alias("path"))
    first = functions.groupBy("name").agg(F.min(_place()).alias("place")).withColumn("file_ord", F.shiftright("place", 32).cast("int"))
    return first.join(path, "file_ord").select(F.col("name").alias("other"), "path", "place")


def _place() -> Column:
    return F.shiftleft(F.col("file_ord").cast("bigint"), 32).bitwiseOR(F.col("func_ord").cast("bigint"))


def graph_of_links(links: DataFrame, mode: str = "reference") -> tuple[DataFrame, DataFrame]:
    """Vertices and distinct edges from the rows of ``LINKS`` of ``extract.links_of`` with the same mode.

    These have each function and call of a file once, so only what files of one path hold together is made distinct here.
    """
    of = lambda rows, kind: rows.where(F.col("kind") == kind)
    files = of(links, "file")
    first = _first_anywhere(of(links, "function"), files)
    own = func_id(F.col("path_id"), F.col("name"))

    def edges_of(rows: DataFrame) -> DataFrame:
        far = of(rows, "elsewhere").withColumn("caller", _place()).join(first, "other")
        if mode == "reference":
            far = far.where("place <= caller")
        target = lambda path: func_id(F.col(path), F.col("other")).alias("target")
        near = of(rows, "here").select(own.alias("source"), target("path_id"), F.lit("CALLS").alias("type"))
        return contains_edges(of(rows, "function")).unionByName(near).unionByName(far.select(own.alias("source"), target("path"), F.lit("CALLS").alias("type")))

    def vertices_of(functions: DataFrame) -> DataFrame:
        return functions.select(own.alias("id"), F.lit("Function").alias("type"), "name", "filepath")

    shared = files.groupBy("path_id").agg(F.count("*").alias("n")).where("n > 1").select("path_id")
    if shared.isEmpty():
        edges, named = edges_of(links), vertices_of(of(links, "function"))
    else:
        alone, together = links.join(shared, "path_id", "left_anti"), links.join(shared, "path_id", "left_semi")
        first_of = of(together, "function").groupBy("path_id", "name").agg(F.min_by("filepath", "file_ord").alias("filepath"))
        edges, named = edges_of(alone).unionByName(edges_of(together).distinct()), vertices_of(of(alone, "function")).unionByName(vertices_of(first_of))
    imported = import_edges(of(links, "import").select("file_ord", F.col("other").alias("module")), files.select("file_ord", "path_id")).distinct()
    return file_vertices(files).unionByName(named), edges.unionByName(imported)
