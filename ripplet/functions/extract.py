"""Functions, calls and imports of Python source, as nested rows."""

from __future__ import annotations

import ast
import gc
from collections.abc import Callable, Iterator
from itertools import accumulate, chain, repeat

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema

from ripplet.plans.schemas import LINKS, PARSED


#: Fields that hold no calls, definitions or imports, and nodes without any below them.
_PLAIN = {"arg", "asname", "attr", "ctx", "id", "kind", "lineno", "name", "names", "op", "ops", "type_comment"}
_LEAVES = {ast.Name, ast.Constant, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal, ast.alias}
_FIELDS: dict[type, tuple[str, ...]] = {}
#: Bytes of source whose functions are Python objects at a time.
SLICE = 1 << 20
#: Files that a task parses at most, and at least if there are too few for all cores.
MOST, LEAST = 1024, 16


def _visit(tree: ast.AST) -> tuple[list[str], list[tuple[int, ast.AST, int, int]], list[tuple[int, ast.AST]]]:
    """Every node once, depth first: the names of calls, with repeats; functions with their depth and the stretch of names that is theirs; imports with their depth."""
    called, functions, imports = [], [], []
    stack: list[tuple] = [(tree, 0)]
    push, leaves, fields_of = stack.append, _LEAVES, _FIELDS
    node_type, name_type, call_type, expr_type, function_type = ast.AST, ast.Name, ast.Call, ast.Expr, ast.FunctionDef
    while stack:
        node, depth = stack.pop()
        kind = type(node)
        if kind is expr_type:  # most statements; what is below it is next anyway
            node, depth = node.value, depth + 1
            kind = type(node)
            if kind in leaves:
                continue
        if kind is int:  # all of that function has been seen
            functions[node] = (*functions[node], len(called))
            continue
        if kind is call_type:
            name = node.func
            if type(name) is name_type:
                called.append(name.id)
                if not node.args and not node.keywords:
                    continue
            elif type(name) is ast.Attribute:
                called.append(name.attr)
        elif kind is function_type or kind is ast.AsyncFunctionDef:
            push((len(functions), 0))
            functions.append((depth, node, len(called)))
        elif kind is ast.Import or kind is ast.ImportFrom:
            imports.append((depth, node))
            continue
        fields = fields_of.get(kind)
        if fields is None:
            fields = fields_of[kind] = tuple(f for f in reversed(kind._fields) if f not in _PLAIN)
        depth += 1
        for field in fields:
            below = getattr(node, field, None)
            if not below:
                continue
            if type(below) is list:
                for child in reversed(below):
                    if type(child) not in leaves and isinstance(child, node_type):
                        push((child, depth))
            elif type(below) not in leaves and isinstance(below, node_type):
                push((below, depth))
    return called, functions, imports


def called_names(root: ast.AST) -> list[str]:
    """Names of calls in visiting order, with repeats: ``f()`` and ``a.b.f()`` give f, other callees no name."""
    return _visit(root)[0]


def parse(content: bytes, path: str) -> dict:
    """functions, imports and error of one file. Undecodable bytes are dropped; source that can't be parsed, or nests too deep for it, leaves the lists empty."""
    found, error = _read(content, path, _extracted)
    return {**(found or {"functions": [], "imports": []}), "error": error}


def _read(content: bytes, path: str, take: Callable[[ast.AST, str], dict]) -> tuple[dict | None, str | None]:
    """What ``take`` finds in the tree, or an error."""
    collecting = gc.isenabled()
    gc.disable()  # a tree is many objects and no cycles, and goes with this call
    try:
        return take(ast.parse(content.decode("utf-8", "ignore"), filename=path), path), None
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return None, "SyntaxError" if isinstance(e, SyntaxError) else type(e).__name__
    finally:
        if collecting:
            gc.enable()


def _extracted(tree: ast.AST, path: str) -> dict:
    """Level by level, so that outer definitions come before nested ones."""
    called, defined, imported = _visit(tree)
    level = lambda found: found[0]
    functions = [
        {"name": node.name, "filepath": path, "start_line": node.lineno, "end_line": node.end_lineno, "calls": called[first:last], "docstring": ast.get_docstring(node)} for _, node, first, last in sorted(defined, key=level)
    ]
    imports = []
    for _, node in sorted(imported, key=level):
        if isinstance(node, ast.Import):
            imports += ({"module": a.name, "names": [a.asname or a.name], "filepath": path, "line": node.lineno} for a in node.names)
        else:
            imports.append({"module": node.module or "", "names": [a.name for a in node.names], "filepath": path, "line": node.lineno})
    return {"functions": functions, "imports": imports}


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """Python values as Arrow, lists of dicts field by field, which takes a fraction of the time of value by value."""
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    ends, flat = pa.array(accumulate(map(len, values), initial=0), pa.int32()), list(chain.from_iterable(values))
    if pa.types.is_struct(kind.value_type):
        below = pa.StructArray.from_arrays([_column([v[f.name] for v in flat], f.type) for f in kind.value_type], fields=list(kind.value_type))
    else:
        below = _column(flat, kind.value_type)
    return pa.ListArray.from_arrays(ends, below, type=kind)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_column([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def _parsed_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One file is read and parsed at a time, and what was found is passed on for each ``SLICE`` of source, however many files a batch brings."""
    for batch in batches:
        rows, taken = [], 0
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            content = row.pop("content")
            rows.append({k: row[k] for k in ("file_ord", "filepath", "path_id", "mtime_ns", "size")} | parse(content, row["filepath"]))
            taken += len(content)
            if taken >= SLICE:
                yield _batch(rows, schema)
                rows, taken = [], 0
        if rows:
            yield _batch(rows, schema)


def parsed_files(files: DataFrame) -> DataFrame:
    """One nested row per source file."""
    schema = to_arrow_schema(T.StructType.fromDDL(PARSED))
    return files.mapInArrow(lambda batches: _parsed_batches(batches, schema), PARSED)


def _linked(tree: ast.AST, mode: str) -> dict[str, list[tuple]]:
    """(func_ord, name, other) by kind: each name with its first definition, each call of a name by a name once, each imported module.

    Calls of a name that the file defines are resolved by that, so they need no join; of others ``func_ord`` is the last caller's.
    """
    called, defined, imported = _visit(tree)
    defined.sort(key=lambda found: found[0])
    first: dict[str, int] = {}
    for at, (_, node, _, _) in enumerate(defined):
        first.setdefault(node.name, at)
    here, elsewhere = {}, {}
    for at, (_, node, begin, end) in enumerate(defined):
        if begin == end:
            continue
        name = node.name
        for callee in called[begin:end]:
            place = first.get(callee)
            if place is None:
                elsewhere[name, callee] = at
            elif mode == "complete" or place <= at:
                here[name, callee] = at
    modules = {m: None for _, node in imported for m in ([a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""])}
    return {
        "function": [(at, name, None) for name, at in first.items()],
        "here": [(at, *names) for names, at in here.items()],
        "elsewhere": [(at, *names) for names, at in elsewhere.items()],
        "import": [(None, None, m) for m in modules],
    }


def _link_batches(batches: Iterator[pa.RecordBatch], mode: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """As ``_parsed_batches``, a batch for each kind."""
    for batch in batches:
        files, found, taken = [], {}, 0
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            links, error = _read(row["content"], row["filepath"], lambda tree, _: _linked(tree, mode))
            for kind, rows in {"file": [(None, None, None)], "error": [(None, None, error)] if error else [], **(links or {})}.items():
                mine = found.setdefault(kind, ([], []))
                mine[0].extend(repeat(len(files), len(rows)))
                mine[1].extend(rows)
            files.append((row["file_ord"], row["filepath"], row["path_id"]))
            taken += len(row["content"])
            if taken >= SLICE or at == batch.num_rows - 1:
                yield from _kinds(files, found, schema)
                files, found, taken = [], {}, 0


def _kinds(files: list[tuple], found: dict[str, tuple[list[int], list[tuple]]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    of_files = [pa.array(values, schema.field(name).type) for name, values in zip(("file_ord", "filepath", "path_id"), zip(*files, strict=True), strict=True)]
    for kind, (places, rows) in found.items():
        if rows:
            at = pa.array(places, pa.int64())
            own = [pa.array(values, schema.field(name).type) for name, values in zip(("func_ord", "name", "other"), zip(*rows, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(kind, schema.field("kind").type), len(rows)), *(column.take(at) for column in of_files), *own], schema=schema)


def links_of(files: DataFrame, mode: str = "reference") -> DataFrame:
    """What each file holds as flat rows of ``LINKS``. Files are dealt evenly, however few parts their table has."""
    if mode not in {"reference", "complete"}:
        raise ValueError(f"mode must be reference or complete, not {mode!r}")
    schema = to_arrow_schema(T.StructType.fromDDL(LINKS))
    n = files.count()  # reads no columns
    tasks = max(1, min(n // LEAST, max(3 * files.sparkSession.sparkContext.defaultParallelism, n // MOST)))
    return files.select("file_ord", "filepath", "path_id", "content").repartition(tasks).mapInArrow(lambda batches: _link_batches(batches, mode, schema), LINKS)


def functions_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_ord", "path_id", F.posexplode("functions").alias("func_ord", "f")).select("file_ord", "func_ord", "path_id", "f.*")


def calls_of(parsed: DataFrame) -> DataFrame:
    return functions_of(parsed).select("file_ord", "func_ord", F.posexplode("calls").alias("call_ord", "callee"))


def imports_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_ord", F.posexplode("imports").alias("imp_ord", "i")).select("file_ord", "imp_ord", "i.*")


def errors_of(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNotNull()).select("file_ord", "filepath", "error")


def register_functions(spark: SparkSession) -> None:
    """Make ``functions_of(table(files))`` and ``imports_of(table(files))`` known to SQL: rows of ``SOURCE_FILES`` in, a row for each function or import out.
    Rows go to Python by the hundred, not as Arrow batches, which would hold what thousands of files bring."""
    spark.udtf.register("functions_of", udtf(_FunctionsOf, returnType="file_ord int, func_ord int, name string, start_line int, end_line int, calls array<string>, docstring string", useArrow=False))
    spark.udtf.register("imports_of", udtf(_ImportsOf, returnType="file_ord int, imp_ord int, module string, names array<string>, line int", useArrow=False))


class _FunctionsOf:
    def eval(self, file: Row) -> Iterator[tuple]:
        for at, f in enumerate(parse(file["content"], file["filepath"])["functions"]):
            yield file["file_ord"], at, f["name"], f["start_line"], f["end_line"], f["calls"], f["docstring"]


class _ImportsOf:
    def eval(self, file: Row) -> Iterator[tuple]:
        for at, i in enumerate(parse(file["content"], file["filepath"])["imports"]):
            yield file["file_ord"], at, i["module"], i["names"], i["line"]
