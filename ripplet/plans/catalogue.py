"""Queries over the derived program graph, and the same in SQL."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet import api
from ripplet.functions import extract, scalars
from ripplet.operators import build, cache, components, layout, load, registry, report, resolve, search, target_index, traverse
from ripplet.plans import derived
from ripplet.plans.derived import table
from ripplet.plans.schemas import FUNCTION, IMPORT, VERTICES
from ripplet.sources import tables
from ripplet.streaming import status

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The derived tables in SQL.
BASE = """with recursive files as (
  select s_suppkey as file_ord, r_name || '/' || n_name || '/' || s_name || '.py' as path, s_name, n_name, r_name
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
functions as (
  select distinct l_suppkey as file_ord, l_partkey as func_ord, path, p_name as name, 'func::' || path || '::' || p_name as uid
  from lineitem join part on l_partkey = p_partkey join files on l_suppkey = file_ord),
calls as (
  select a.l_suppkey as file_ord, a.l_partkey as func_ord, p_name as callee
  from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 join part on b.l_partkey = p_partkey),
imports as (
  select file_ord, unnest([n_name, r_name || '.' || n_name, r_name || '.' || n_name || '.' || s_name, s_name, 'missing.' || s_name]) as module from files),
part_graph as (
  select distinct a.l_partkey as source, b.l_partkey as target,
    case a.l_returnflag when 'R' then 'CALLS' when 'A' then 'IMPORTS' else 'CONTAINS' end as type
  from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1),
local_defs as (select file_ord, name, min(func_ord) as func_ord, arg_min(uid, func_ord) as uid from functions group by all),
global_defs as (
  select name, arg_min(uid, (file_ord, func_ord)) as uid, min((file_ord, func_ord)) as pos from functions group by name),
resolved as (
  select c.file_ord, c.func_ord, c.callee, f.uid as caller, l.uid as local_uid, g.uid as global_uid, coalesce(l.uid, g.uid) as target,
    case when l.uid is not null then l.file_ord else g.pos[1] end as target_file, case when l.uid is not null then l.func_ord else g.pos[2] end as target_func
  from calls c join functions f using (file_ord, func_ord)
  left join local_defs l on l.file_ord = c.file_ord and l.name = c.callee left join global_defs g on g.name = c.callee),
segments as (select file_ord, path, string_split(regexp_replace(path, '\\.py$', ''), '/') as s from files),
suffixes as (select file_ord, path, array_to_string(list_slice(s, i, len(s)), '.') as module from (select *, unnest(range(1, len(s) + 1)) as i from segments)),
modules as (select module, 'file::' || arg_min(path, file_ord) as file from suffixes where module <> '' group by module),
vertices as (
  select 'file::' || path as id, 'File' as type, s_name || '.py' as name, path as filepath, file_ord as row_ord from files
  union all select uid, 'Function', name, arg_min(path, file_ord), min(file_ord * 1000000000 + func_ord) from functions group by uid, name),
contains_e as (select 'file::' || path as source, uid as target, 'CONTAINS' as type from functions),
calls_e as (select caller as source, target, 'CALLS' as type from resolved where target is not null and (target_file, target_func) <= (file_ord, func_ord)),
imports_e as (select 'file::' || path as source, file as target, 'IMPORTS' as type from imports join modules using (module) join files using (file_ord)),
edges as (select * from contains_e union all select * from calls_e union all select * from imports_e)
"""


def query(sql: str | None = None, base: bool = True, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = (BASE if base else "") + sql
        return f

    return add


def _cut(rows: DataFrame, name: str) -> DataFrame:
    """What a query reads several times, computed once."""
    return components.materialize(rows, name)


def _all(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return derived.files(spark, d), _cut(derived.functions(spark, d), "functions"), derived.calls(spark, d), derived.imports(spark, d)


def _places(spark: SparkSession, d: str) -> DataFrame:
    """Path, region, nation and name of each file."""
    place = F.split("filepath", "/")
    return derived.files(spark, d).select(F.col("filepath").alias("path"), place[0].alias("r_name"), place[1].alias("n_name"), F.regexp_replace(place[2], r"\.py$", "").alias("s_name"))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The part graph, and the first part that calls another."""
    graph = _cut(derived.part_graph(spark, d), "part_graph")
    return graph, derived.first_caller(graph)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return build.edges(*_all(spark, d))


def _vertices(spark: SparkSession, d: str) -> DataFrame:
    return build.vertices(derived.files(spark, d), derived.functions(spark, d))


# ---- traversal
def _walk_sql(direction: str, depth: int, types: tuple[str, ...], least: int) -> str:
    links = {"out": "select source as src, target as dst from kept", "in": "select target as src, source as dst from kept", "both": "select source as src, target as dst from kept union select target, source from kept"}[direction]
    named = ", ".join(f"'{t}'" for t in types)
    return f""", kept as (select * from part_graph where type in ({named})), links as ({links}),
walk(id, distance) as (select min(source), 0 from part_graph where type = 'CALLS' union select dst, distance + 1 from walk join links on id = src where distance < {depth})
select id, min(distance) as distance from walk group by id having min(distance) >= {least}"""


ALL = ("CALLS", "IMPORTS", "CONTAINS")
for _direction in traverse.DIRECTIONS:
    for _depth in (1, 2, 5):
        query(_walk_sql(_direction, _depth, ALL, 0), name=f"hop_detection_{_direction}_d{_depth}")(lambda s, d, k=_depth, way=_direction: traverse.hop_detection(*_graph(s, d), k, way))
    for _depth in (1, 5):
        query(_walk_sql(_direction, _depth, ("CALLS",), 1), name=f"impact_analysis_{_direction}_d{_depth}")(lambda s, d, k=_depth, way=_direction: traverse.impact_analysis(*_graph(s, d), k, way))
query(_walk_sql("out", 5, ALL, 0), name="hop_detection_recursive_sql")(lambda s, d: traverse.hop_detection(*_graph(s, d), 5, "out", traverse.reach_sql))


def _laid_out(s: SparkSession, d: str, direction: str, depth: int) -> DataFrame:
    """A part with more than 100 edges on a side counts as a hub, so that there are some."""
    graph, first = _graph(s, d)
    laid = layout.EdgeLayout.write(graph, _folder(s, "laid"), int(s.conf.get("spark.sql.shuffle.partitions")), hub=100)
    try:
        return laid.reach(first, depth, direction, list(ALL))
    finally:
        laid.close()


for _direction in traverse.DIRECTIONS:
    query(_walk_sql(_direction, 5, ALL, 0), name=f"hop_laid_out_{_direction}_d5")(lambda s, d, way=_direction: _laid_out(s, d, way, 5))


@query(_walk_sql("out", 5, ("CALLS",), 0).replace("select id, min(distance) as distance from walk group by id having min(distance) >= 0", "select distance, count(*) as n from (select id, min(distance) as distance from walk group by id) group by distance"))
def bfs_distance_histogram(s: SparkSession, d: str) -> DataFrame:
    graph, first = _graph(s, d)
    return traverse.reach(traverse.steps(graph, "out", ["CALLS"]), first, 5).groupBy("distance").agg(F.count("*").alias("n"))


# ---- building
query("select id, type, name, filepath from vertices", name="vertices_build")(_vertices)
query("select * from contains_e", name="contains_edges")(lambda s, d: build.contains_edges(derived.functions(s, d)))
query("select * from calls_e", name="call_edges")(lambda s, d: build.call_edges(derived.calls(s, d), _cut(derived.functions(s, d), "functions")))
query("select caller as source, target, 'CALLS' as type from resolved where target is not null", name="call_edges_complete")(lambda s, d: build.call_edges(derived.calls(s, d), _cut(derived.functions(s, d), "functions"), "complete"))
query("select * from imports_e", name="import_edges")(lambda s, d: build.import_edges(derived.imports(s, d), derived.files(s, d)))
query("select * from edges", name="edges_bag")(_edges)
query("select distinct * from edges", name="edges_set")(lambda s, d: _edges(s, d).distinct())
query("select * from modules", name="module_suffix_index")(lambda s, d: build.module_index(derived.files(s, d)))
query("select file_ord, func_ord, callee, local_uid, global_uid, target from resolved", name="resolve_local_vs_global")(lambda s, d: build.resolve_calls(derived.calls(s, d), _cut(derived.functions(s, d), "functions")).select("file_ord", "func_ord", "callee", "local_uid", "global_uid", "target"))
_RENAMED = ", renamed as (select file_ord, func_ord, case when func_ord > 100 * file_ord then callee || '_x' else callee end as callee from calls)"
query(_RENAMED + " select callee, file_ord, func_ord from renamed c where not exists (select 1 from functions f where f.name = c.callee)", name="unresolved_calls")(
    lambda s, d: build.unresolved_calls(derived.calls(s, d).withColumn("callee", F.when(F.col("func_ord") > 100 * F.col("file_ord"), F.concat("callee", F.lit("_x"))).otherwise(F.col("callee"))), derived.functions(s, d))
)


@query("select name, string_agg(uid, ',' order by file_ord, func_ord) as func_ids from (select name, uid, min((file_ord, func_ord))[1] as file_ord, min((file_ord, func_ord))[2] as func_ord from functions group by name, uid) group by name")
def name_index(s: SparkSession, d: str) -> DataFrame:
    return build.name_index(derived.functions(s, d)).select("name", F.array_join("func_ids", ",").alias("func_ids"))


# ---- extraction from source text
_SOURCE = """with called as (
  select a.l_suppkey as file_ord, a.l_partkey as part, a.l_orderkey, a.l_linenumber, b.l_partkey as next from lineitem a
  left join lineitem b on b.l_orderkey = a.l_orderkey and b.l_linenumber = a.l_linenumber + 1),
defs as (select file_ord, part, count(next) as n_calls from called group by all),
placed as (
  select *, row_number() over w - 1 as func_ord, sum(1 + greatest(1, n_calls)) over w as last from defs window w as (partition by file_ord order by part))
"""


def _parsed(s: SparkSession, d: str) -> DataFrame:
    return extract.parsed_files(derived.source_files(s, d))


query(_SOURCE + "select file_ord::int as file_ord, func_ord::int as func_ord, 'part_' || part as name, (last + 2 - greatest(1, n_calls))::int as start_line, (last + 2)::int as end_line, n_calls::int as n_calls from placed", base=False, name="ast_functions")(
    lambda s, d: extract.functions_of(_parsed(s, d)).select("file_ord", "func_ord", "name", "start_line", "end_line", F.size("calls").alias("n_calls"))
)
query(_SOURCE + "select file_ord::int as file_ord, func_ord::int as func_ord, (row_number() over (partition by file_ord, func_ord order by l_orderkey, l_linenumber, next) - 1)::int as call_ord, 'part_' || next as callee from called join placed using (file_ord, part) where next is not null", base=False, name="ast_calls")(
    lambda s, d: extract.calls_of(_parsed(s, d))
)
query(
    "select s_suppkey::int as file_ord, 0 as imp_ord, 'nation_' || s_nationkey as module, 'nation_' || s_nationkey as names, 1 as line from supplier union all select s_suppkey::int, 1, 'ledger', 's_' || s_suppkey || ',total', 2 from supplier", base=False, name="ast_imports"
)(lambda s, d: extract.imports_of(_parsed(s, d)).select("file_ord", "imp_ord", "module", F.array_join("names", ",").alias("names"), "line"))


def _folder(s: SparkSession, name: str) -> str:
    return os.path.join(components.shared_dir(s), f"{name}-{uuid.uuid4().hex}")


@query("select id, type, name, filepath from vertices")
def vertices_csv_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """The vertices, written as CSV and read again."""
    path = _folder(s, "vertices")
    tables.write_csv(_vertices(s, d), path)
    return tables.read_csv(s, path, VERTICES)


@query(_SOURCE + "select 's_' || s_suppkey || '.py' as file, coalesce(n, 0)::int as n_functions, coalesce(c, 0)::int as n_calls, 2::int as n_imports from supplier left join (select file_ord, count(*) as n, sum(n_calls) as c from defs group by file_ord) on s_suppkey = file_ord", base=False)
def nested_json_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Parsed files, written as nested JSON and read again."""
    path = _folder(s, "parsed")
    tables.write_nested_json(_parsed(s, d), path)
    read = s.read.schema(f"file string, functions array<struct<{FUNCTION}>>, imports array<struct<{IMPORT}>>, error string").json(path)
    n_calls = F.aggregate("functions", F.lit(0), lambda n, f: n + F.size(f["calls"]))
    return read.where("error is null").select("file", F.size("functions").alias("n_functions"), n_calls.alias("n_calls"), F.size("imports").alias("n_imports"))


# ---- target resolution
@query("select name as target, 'function' as type, arg_min(id, row_ord) as id from vertices where type = 'Function' group by name union all select id, 'function', id from vertices where type = 'Function'")
def resolve_function_target(s: SparkSession, d: str) -> DataFrame:
    """Every name and every id, as one batch of targets."""
    own = _ordered(s, d)
    functions = own.where("type = 'Function'")
    return resolve.match_targets(own, functions.select(F.col("name").alias("target")).union(functions.select("id")).withColumn("type", F.lit("function")))


@query("select t.target, 'file' as type, arg_min(v.id, (case when t.target in (v.id, v.name, v.filepath) then 0 else 1 end, v.row_ord)) as id from (select distinct n_name || '/' || s_name || '.py' as target from files union select substr(s_name, length(s_name) - 2) || '.py' from files union select path from files) t join vertices v on v.type = 'File' and (t.target in (v.id, v.name, v.filepath) or ends_with(v.filepath, t.target)) group by t.target")
def resolve_file_target(s: SparkSession, d: str) -> DataFrame:
    """Every path, every two last segments and every three last letters of a name, as one batch of targets."""
    path = F.col("filepath")
    files = derived.files(s, d)
    asked = files.select(path.alias("target")).union(files.select(F.substring_index(path, "/", -2))).union(files.select(F.right(path, F.lit(6))))
    return resolve.match_targets(_ordered(s, d), asked.withColumn("type", F.lit("file")))


def _indexed(s: SparkSession, d: str, asked: DataFrame) -> DataFrame:
    path = _folder(s, "targets")
    target_index.write_index(_ordered(s, d), path)
    return target_index.match_targets(s, path, asked)


@query(ORACLES["resolve_file_target"].removeprefix(BASE))
def resolve_file_index(s: SparkSession, d: str) -> DataFrame:
    """The same targets, looked up in a table of all endings."""
    path = F.col("filepath")
    files = derived.files(s, d)
    asked = files.select(path.alias("target")).union(files.select(F.substring_index(path, "/", -2))).union(files.select(F.right(path, F.lit(6))))
    return _indexed(s, d, asked.withColumn("type", F.lit("file")))


@query(ORACLES["resolve_function_target"].removeprefix(BASE))
def resolve_function_index(s: SparkSession, d: str) -> DataFrame:
    functions = _ordered(s, d).where("type = 'Function'")
    return _indexed(s, d, functions.select(F.col("name").alias("target")).union(functions.select("id")).withColumn("type", F.lit("function")))


def _ordered(s: SparkSession, d: str) -> DataFrame:
    files, functions = derived.files(s, d), _cut(derived.functions(s, d), "functions")
    f = build.file_vertices(files).join(files.select("filepath", F.col("file_ord").alias("row_ord")), "filepath")
    at = functions.groupBy(scalars.func_id(F.col("path_id"), F.col("name")).alias("id")).agg(F.min(F.col("file_ord") * 1000000000 + F.col("func_ord")).alias("row_ord"))
    return _cut(f.unionByName(build.function_vertices(functions, files).join(at, "id")), "vertices")


@query(r"""select target, case when target = 'UNKNOWN' or target = '' then 'unknown' when ends_with(target, '.py') then 'file' else 'function' end as type, raw
from (select raw, case when starts_with(t, '[Error]') then 'UNKNOWN' else t end as target from (select raw, trim(trim(trim(raw, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)), '"'), chr(39)) as t
from (select case event_id % 5 when 0 then ' "' || event_type || '.py" ' when 1 then '[Error] ' || event_type when 2 then ' UNKNOWN ' when 3 then '''' || event_type || '''' else '""' end as raw from events)))""", base=False)
def classify_target(s: SparkSession, d: str) -> DataFrame:
    kind, k = F.col("event_type"), F.col("event_id") % 5
    raw = F.when(k == 0, F.concat(F.lit(' "'), kind, F.lit('.py" '))).when(k == 1, F.concat(F.lit("[Error] "), kind)).when(k == 2, " UNKNOWN ").when(k == 3, F.concat(F.lit("'"), kind, F.lit("'"))).otherwise('""')
    return resolve.classify(table(s, d, "events").select(raw.alias("raw")))


@query("""with asked as (select distinct l_partkey as a, l_suppkey as b from lineitem),
said as (select 'What if fn_' || a || ' or fn_' || b || ' changes?' as question, case when a in (select p_partkey from part) then 'fn_' || a end as x, case when b in (select p_partkey from part) then 'fn_' || b end as y from asked
  union all select 'What if ' || s_name || ' changes?', null, null from supplier)
select question, case when x is null and y is null then 'UNKNOWN' when y is null or length(x) >= length(y) then x else y end as raw from said""", base=False)
def mentioned_targets(s: SparkSession, d: str) -> DataFrame:
    """Which part each question about a line's part and supplier names; questions about suppliers by name mention none."""
    name = lambda c: F.concat(F.lit("fn_"), F.col(c).cast("string"))
    asked = table(s, d, "lineitem").select(F.concat(F.lit("What if "), name("l_partkey"), F.lit(" or "), name("l_suppkey"), F.lit(" changes?")).alias("question"))
    others = table(s, d, "supplier").select(F.concat(F.lit("What if "), "s_name", F.lit(" changes?")).alias("question"))
    return resolve.mentioned_targets(table(s, d, "part").select(name("p_partkey").alias("name")), asked.union(others))


_NAMED = """, dotted as (select distinct replace(replace(path, '.py', ''), '/', '.') as d from files), names as (select r_name as name from files union select n_name from files union select r_name || '/' || n_name from files union select path from files union select d from dotted),
asked as (select distinct 'What if ' || path || ' or ' || n_name || ' changes?' as question, path as best from files
  union all select distinct 'Is (' || r_name || '/' || n_name || ') used by ' || r_name || '?', r_name || '/' || n_name from files
  union all select distinct 'Change ' || d || '.', d from dotted union all select distinct 'x' || r_name || '_' || n_name || 'y ' || s_name, null from files)"""


@query(_NAMED + " select question, coalesce(best, 'UNKNOWN') as raw from asked")
def mentioned_paths(s: SparkSession, d: str) -> DataFrame:
    """Names of several words, paths and dotted ones: the longest that a question holds at whole words."""
    files = _places(s, d)
    join = lambda *parts: F.concat(*(F.col(p) if p in files.columns else F.lit(p) for p in parts))
    dotted = join("r_name", ".", "n_name", ".", "s_name")
    names = reduce(DataFrame.union, (files.select(c.alias("name")) for c in (F.col("r_name"), F.col("n_name"), join("r_name", "/", "n_name"), join("path"), dotted)))
    asked = (join("What if ", "path", " or ", "n_name", " changes?"), join("Is (", "r_name", "/", "n_name", ") used by ", "r_name", "?"), F.concat(F.lit("Change "), dotted, F.lit(".")), join("x", "r_name", "_", "n_name", "y ", "s_name"))
    return resolve.mentioned_targets(names, reduce(DataFrame.union, (files.select(q.alias("question")) for q in asked)))


@query(", kept as (select distinct source as src, target as dst from calls_e), walk(id, distance) as (select min(src), 0 from kept union select dst, distance + 1 from walk join kept on id = src where distance < 5) select id, min(distance) as distance from walk group by id having min(distance) >= 1")
def affected_functions(s: SparkSession, d: str) -> DataFrame:
    """What a change of the first calling function reaches, dispatched by the type of the target."""
    calls = _cut(build.call_edges(derived.calls(s, d), _cut(derived.functions(s, d), "functions")), "calls")
    return traverse.affected(calls, calls.agg(F.min("source").alias("id")), "function", 5)


@query(", kept as (select distinct source as src, target as dst from edges), walk(id, distance) as (select min(source), 0 from edges where type = 'CONTAINS' union select dst, distance + 1 from walk join kept on id = src where distance < 3) select id, min(distance) as distance from walk group by id")
def affected_by_file(s: SparkSession, d: str) -> DataFrame:
    """What a change of the first file reaches in three steps over edges of any type."""
    edges = _cut(_edges(s, d), "edges")
    return traverse.affected(edges, edges.where("type = 'CONTAINS'").agg(F.min("source").alias("id")), "file", 3)


@query("select * from edges")
def edges_csv_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """The edges, written as CSV and read again."""
    path = _folder(s, "edges")
    tables.write_csv(_edges(s, d), path)
    return tables.edges_csv(s, path)


# ---- reports
query("select source, target, type from edges", name="graph_payload_edges")(lambda s, d: report.graph_payload(_vertices(s, d), _edges(s, d))[1])
query("select id, name as label, type, filepath from vertices", name="graph_payload")(lambda s, d: report.graph_payload(_vertices(s, d), _edges(s, d))[0])
@query(", one as (select distinct source as src, target as dst from part_graph where type = 'CALLS'), n as (select src as id, count(*) as n_affected from one where src <> dst group by src) select id, n_affected, case when n_affected = 0 then 'None' when n_affected <= 2 then 'Low' when n_affected <= 5 then 'Medium' else 'High' end as risk from n")
def risk_levels(s: SparkSession, d: str) -> DataFrame:
    """For every part that calls: how many others one step affects."""
    links = traverse.steps(derived.part_graph(s, d), "out", ["CALLS"]).where("src <> dst")
    return report.risk_levels(links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_affected")))


query("select id, string_split(id, '::')[-1] as name, case when starts_with(id, 'func::') then 'Function' else 'File' end as type from vertices", name="display_names")(lambda s, d: report.affected_nodes(_vertices(s, d)))
query("select (select count(*) from vertices) as nodes, (select count(*) from vertices where type = 'File') as files, (select count(*) from vertices where type = 'Function') as functions, (select count(*) from edges) as edges", name="graph_stats")(lambda s, d: report.graph_stats(_vertices(s, d), _edges(s, d)))
query("select t.type, coalesce(n, 0) as n from (values ('CALLS'), ('IMPORTS'), ('CONTAINS'), ('INHERITS')) t(type) left join (select type, count(*) as n from edges group by type) using (type)", name="edge_counts_by_type")(lambda s, d: report.counts_by_type(_edges(s, d), ["CALLS", "IMPORTS", "CONTAINS", "INHERITS"]))
query("select type, count(*) as n from vertices group by type", name="vertex_counts_by_type")(lambda s, d: report.counts_by_type(_vertices(s, d), ["File", "Function"]))
_NEAR = "near as (select source as id, target as neighbour from part_graph union select target, source from part_graph)"


def _parts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


query(
    f", {_NEAR} select p_partkey as id, coalesce(i.n, 0) as in_degree, coalesce(o.n, 0) as out_degree, coalesce(i.t, '') as in_types, coalesce(o.t, '') as out_types, coalesce(c.n, 0) as connections from part "
    "left join (select target, count(*) as n, string_agg(distinct type, ',' order by type) as t from part_graph group by target) i on p_partkey = i.target "
    "left join (select source, count(*) as n, string_agg(distinct type, ',' order by type) as t from part_graph group by source) o on p_partkey = o.source "
    "left join (select id, count(*) as n from near group by id) c on p_partkey = c.id",
    name="node_degrees",
)(lambda s, d: report.degrees(_parts(s, d), derived.part_graph(s, d)))
query(f", {_NEAR} select * from near", name="neighbours")(lambda s, d: report.neighbour_pairs(derived.part_graph(s, d)))
query(f", {_NEAR} select neighbour from near where id = 1", name="neighbours_of_node")(lambda s, d: report.neighbours(derived.part_graph(s, d), 1))
query("select p_partkey as id, p_name as name from part where contains(lower(p_name), 'an')", base=False, name="node_search")(lambda s, d: report.search(_parts(s, d), "AN"))
query("select * from part_graph where type in ('CALLS', 'CONTAINS')", name="edge_filter")(lambda s, d: report.visible_edges(derived.part_graph(s, d), ["CALLS", "CONTAINS"]))
query(_walk_sql("out", 1, ("CALLS",), 1).replace("select id, min(distance) as distance from walk", "select id, p_name as name from (select id, min(distance) as distance from walk").replace("having min(distance) >= 1", "having min(distance) >= 1) join part on id = p_partkey"), name="affected_details")(
    lambda s, d: report.affected_details(traverse.impact_analysis(*_graph(s, d), 1), _parts(s, d))
)
query(_walk_sql("out", 1, ("CALLS",), 1).replace("select id, min(distance) as distance from walk group by id having min(distance) >= 1", "select p_partkey as id, p_name as name, p_partkey in (select id from walk where distance >= 1 and id not in (select id from walk where distance = 0)) as hit from part"), name="highlighted_nodes")(
    lambda s, d: report.highlighted(_parts(s, d), traverse.impact_analysis(*_graph(s, d), 1))
)


@query("select count(*) as files, sum(len(regexp_extract_all(html, '<p>')))::bigint as functions, sum(len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)))::bigint as imports, count(*) filter (where html is null) as errors from pages", base=False)
def parse_totals(s: SparkSession, d: str) -> DataFrame:
    parsed = table(s, d, "pages").select(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0)).alias("functions"), F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)).alias("imports"), F.when(F.col("html").isNull(), "null").alias("error"))
    return report.parse_totals(parsed)


query(_SOURCE + "select (select count(*) from supplier) as files, (select count(*) from defs)::bigint as functions, (select 2 * count(*) from supplier)::bigint as imports, 0::bigint as errors", base=False, name="parsed_totals")(lambda s, d: report.parse_totals(_parsed(s, d)))


# ---- loading
@query("select user_id::varchar as id, arg_max(event_type, event_id) as type, arg_max(value, event_id)::varchar as name, max(event_id) as load_row from events group by user_id", base=False)
def load_repeated_ids(s: SparkSession, d: str) -> DataFrame:
    """Several rows of an id in one load: the later row wins."""
    text = lambda c: F.col(c).cast("string")
    own = table(s, d, "events").select(text("user_id").alias("id"), F.col("event_type").alias("type"), text("value").alias("name"), F.lit("f").alias("filepath"), F.lit(0).cast("bigint").alias("load_seq"), F.col("event_id").alias("load_row"))
    return load.latest(own).select("id", "type", "name", "load_row")


query("select user_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value, max(event_id) as event_id from events group by user_id", base=False, name="upsert_last_writer")(
    lambda s, d: load.upsert(table(s, d, "events").select("user_id", "event_type", "value", "event_id"), "user_id", "event_id")
)
query("select * from (select source, target, case when type = 'CONTAINS' and source % 2 = 0 then 'OTHER' else type end as type from part_graph) where type in ('CALLS', 'IMPORTS', 'CONTAINS')", name="load_allowlist")(
    lambda s, d: load.allowed_edges(derived.part_graph(s, d).withColumn("type", F.when((F.col("type") == "CONTAINS") & (F.col("source") % 2 == 0), "OTHER").otherwise(F.col("type"))))
)
query("select *, case type when 'CALLS' then 'CodeFunction' else 'CodeFile' end as source_type, case type when 'IMPORTS' then 'CodeFile' else 'CodeFunction' end as target_type from edges", name="endpoint_types")(lambda s, d: load.typed_edges(_edges(s, d)))
query("select distinct source, target, type, case type when 'CALLS' then 'CodeFunction' else 'CodeFile' end as source_type, case type when 'IMPORTS' then 'CodeFile' else 'CodeFunction' end as target_type from edges", name="edge_upsert_set")(lambda s, d: load.typed_edges(_edges(s, d).distinct()))
query("select id, case type when 'File' then 'CodeFile' else 'CodeFunction' end as type, name, filepath from vertices", name="vertex_type_map")(lambda s, d: load.map_vertex_types(_vertices(s, d)))
query("select distinct name, filepath from vertices", name="vertex_attributes")(lambda s, d: load.attributes(_vertices(s, d)).distinct())

_STAT = ", stat as (select path as path_id, file_ord, file_ord * 1000 as mtime_ns, length(path) as size from files), cached as (select path_id, case when file_ord % 3 = 0 then mtime_ns + 1 else mtime_ns end as mtime_ns, size from stat where file_ord % 5 <> 0)"


def _stat(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    now = derived.files(s, d).select("path_id", "file_ord", (F.col("file_ord") * 1000).alias("mtime_ns"), F.length("path_id").cast("bigint").alias("size"))
    return now, now.where("file_ord % 5 <> 0").withColumn("mtime_ns", F.when(F.col("file_ord") % 3 == 0, F.col("mtime_ns") + 1).otherwise(F.col("mtime_ns")))


query(_STAT + " select file_ord, path_id, mtime_ns, size from stat join cached using (path_id, mtime_ns, size)", name="cache_hits")(lambda s, d: cache.hits(*_stat(s, d)))
query(_STAT + " select * from stat where not exists (select 1 from cached c where c.path_id = stat.path_id and c.mtime_ns = stat.mtime_ns and c.size = stat.size)", name="cache_misses")(lambda s, d: cache.misses(*_stat(s, d)))
query(_STAT + ", h as (select count(*) as n from stat join cached using (path_id, mtime_ns, size)) select h.n as hits, (select count(*) from stat) - h.n as misses from h", name="cache_counts")(lambda s, d: cache.cache_counts(*_stat(s, d)))


# ---- registries
def _sessions(s: SparkSession, d: str) -> DataFrame:
    turns = table(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    entries = F.transform(F.filter("t", lambda x: x["role"] == "user"), lambda x: F.struct(x["text"].alias("question")))
    return turns.select(F.col("conv_id").cast("string").alias("id"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("name"), F.concat(F.lpad((F.col("conv_id") * 7919 % 1000).cast("string"), 4, "0"), F.lit("T0")).alias("updated_at"), entries.alias("entries"))


_SESSIONS = "select conv_id::varchar as id, 's' || conv_id as name, lpad((conv_id * 7919 % 1000)::varchar, 4, '0') || 'T0' as updated_at, count(*) filter (where role = 'user') as n_queries, arg_max(text, (turn, text)) filter (where role = 'user') as last_question from conversations group by conv_id"
query(f"select id, name, n_queries::int as n_queries, last_question, string_split(updated_at, 'T')[1] as day from ({_SESSIONS})", base=False, name="session_summaries")(lambda s, d: registry.session_summaries(_sessions(s, d)))
query(f"select row_number() over (order by updated_at desc, id) as row, id, name, string_split(updated_at, 'T')[1] as day, case when length(last_question) > 40 then substr(last_question, 1, 40) || '…' else last_question end as last_question from (select * from ({_SESSIONS}) order by updated_at desc, id limit 15)", base=False, name="session_listing")(
    lambda s, d: registry.session_listing(_sessions(s, d))
)
query(f"select id, name, updated_at from ({_SESSIONS}) order by updated_at desc, id limit 15", base=False, name="recent_sessions_topk")(lambda s, d: registry.sessions_by_update(_sessions(s, d).select("id", "name", "updated_at")).limit(15))
query("select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by event_id) as before from events) where before is null or before <> event_type", base=False, name="status_change_points")(
    lambda s, d: registry.status_changes(table(s, d, "events").select("event_id", "user_id", "event_type"), "user_id", "event_type", "event_id")
)
@query("""with lines as (select user_id::varchar as key, event_id as seq, event_type as status, case when event_type = 'view' then regexp_extract(props, '[0-9]+')::bigint end as completed, case when event_type = 'view' then 100::bigint end as total,
  case when event_type = 'error' and value > 100 then props end as error from events where value >= 1),
ends as (select key, min(seq) as seq from lines where error is not null group by key), kept as (select l.* from lines l left join ends e using (key) where e.seq is null or l.seq <= e.seq),
told as (select *, lag(status, 1, '') over (partition by key order by seq) as before from kept where total is null)
select key, seq, 'progress' as kind, status, completed, total, null::varchar as error from kept where total > 0
union all select key, seq, 'status', status, null, null, null from told where status <> before union all select key, seq, 'error', status, null, null, error from kept where error is not null""", base=False)
def status_stream(s: SparkSession, d: str) -> DataFrame:
    """Events as status lines of their users, some cut off in the middle; the later half comes in a second run of the stream."""
    home = _folder(s, "status")
    events = table(s, d, "events")
    kind, number = F.col("event_type"), F.regexp_extract("props", "[0-9]+", 0).cast("bigint")
    fields = (F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), kind.alias("status"), F.when(kind == "view", number).alias("completed"), F.when(kind == "view", 100).alias("total"), F.when((kind == "error") & (F.col("value") > 100), F.col("props")).alias("error"))
    line = F.to_json(F.struct(*fields))
    lines = events.select("event_id", F.when(F.col("value") < 1, F.substring(line, 1, 12)).otherwise(line).alias("value"))
    middle = events.agg(F.median("event_id")).first()[0]
    for half in (lines.where(F.col("event_id") <= middle), lines.where(F.col("event_id") > middle)):
        half.select("value").write.mode("append").text(f"{home}/in")
        status.stream_reports(s, f"{home}/in", f"{home}/out", f"{home}/checkpoint")
    return s.read.schema(status.REPORTS).parquet(f"{home}/out")


def _models(s: SparkSession, d: str) -> DataFrame:
    """Parts as models; those with an a and an e in their name are coder models."""
    low = F.lower("p_name")
    name = F.when(low.contains("a") & low.contains("e"), F.concat(F.lit("Qwen-Coder "), "p_name")).otherwise(F.col("p_name"))
    return table(s, d, "part").select("p_partkey", name.alias("model_name"), F.col("p_partkey").alias("ord"))


query("select arg_min({'p_partkey': p_partkey, 'm': p_name}, (case when contains(lower(p_name), 'a') and contains(lower(p_name), 'e') then 0 else 1 end, p_partkey)).p_partkey as p_partkey from part", base=False, name="preferred_pick")(
    lambda s, d: registry.preferred(_models(s, d)).select("p_partkey")
)
query("select s_suppkey as id, 'renamed' as name from supplier where s_suppkey = 3 union all select s_suppkey, s_name from supplier where s_suppkey not in (3, 5)", base=False, name="registry_rename_delete")(
    lambda s, d: registry.delete(registry.rename(table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), 3, "renamed"), 5)
)
@query("select 'p' || s_suppkey as id, s_name as name, '/src/' || s_suppkey as path, (case s_suppkey when 3 then 30 else 1 end)::bigint as vertices, (case s_suppkey when 3 then 40 else 2 end)::bigint as edges, (case s_suppkey when 3 then 50 else 3 end)::bigint as files from supplier union all select 'new', 'fresh', '/src/fresh', 7, 8, 9", base=False)
def project_upsert(s: SparkSession, d: str) -> DataFrame:
    """One known project analysed again, under a path to be normalised, and one new."""
    key = F.col("s_suppkey").cast("string")
    numbers = [F.lit(k).cast("bigint").alias(n) for k, n in ((1, "vertices"), (2, "edges"), (3, "files"))]
    known = table(s, d, "supplier").select(F.concat(F.lit("p"), key).alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("/src/"), key).alias("path"), F.lit("c").alias("created"), F.lit("t").alias("last_analyzed"), *numbers)
    both = registry.register_project(registry.register_project(known, "/src/x/../3", "other", 30, 40, 50), "/src/fresh", None, 7, 8, 9)
    return both.select(F.when(F.col("path") == "/src/fresh", "new").otherwise(F.col("id")).alias("id"), "name", "path", "vertices", "edges", "files")


query("select s_suppkey as id, s_suppkey = 2 as is_active from supplier", base=False, name="single_active")(lambda s, d: registry.set_active(table(s, d, "supplier").select(F.col("s_suppkey").alias("id")), 2))

query("select row_number() over (order by lpad((s_suppkey * 7919 % 1000)::varchar, 4, '0'), s_suppkey::varchar) as row, s_suppkey::varchar as id, s_name as name, 'd' || s_nationkey as day from supplier", base=False, name="project_listing")(
    lambda s, d: registry.project_listing(
        table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.lit("/p").alias("path"), F.lpad((F.col("s_suppkey") * 7919 % 1000).cast("string"), 4, "0").alias("created"), F.concat(F.lit("d"), F.col("s_nationkey").cast("string"), F.lit("T1")).alias("last_analyzed"), *(F.lit(1).alias(c) for c in ("files", "vertices", "edges")))
    ).select("row", "id", "name", "day")
)


@query("""select row_number() over (order by turn, text)::int as row, text as question, role as target, len(string_split(text, ' '))::int as n_affected,
  case turn % 3 when 0 then 'Low' when 1 then 'Medium' else 'High' end as risk, case turn % 3 when 0 then 'green' when 1 then 'yellow' else 'red' end as colour, 'd' || turn as day
from conversations where conv_id = (select min(conv_id) from conversations)""", base=False)
def session_transcript(s: SparkSession, d: str) -> DataFrame:
    """The first conversation as a session."""
    turns = table(s, d, "conversations")
    level = F.when(F.col("turn") % 3 == 0, "Low").when(F.col("turn") % 3 == 1, "Medium").otherwise("High")
    entry = F.struct("turn", F.col("text").alias("question"), F.col("role").alias("target"), F.split("text", " ").alias("affected"), level.alias("risk"), F.concat(F.lit("d"), F.col("turn").cast("string"), F.lit("T1")).alias("timestamp"), F.lit(None).cast("bigint").alias("n_affected"))
    sessions = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    first = sessions.withColumn("id", F.when(F.col("conv_id") == F.lit(turns.agg(F.min("conv_id")).first()[0]), "first").otherwise("other"))
    return registry.transcript(first, "first").withColumn("n_affected", F.col("n_affected").cast("int"))


@query(", walk(id, distance) as (select min(source), 0 from part_graph where type = 'CALLS' union select dst, distance + 1 from walk join (select source as src, target as dst from part_graph where type = 'CALLS') on id = src where distance < 5), n as (select count(distinct id) - 1 as n from walk) select 1::int as row, 'What breaks if part_' || (select id from walk where distance = 0) || ' changes?' as question, 'part_' || (select id from walk where distance = 0) as target, n as n_affected, case when n = 0 then 'None' when n <= 2 then 'Low' when n <= 5 then 'Medium' else 'High' end as risk, case when n <= 2 then 'green' when n <= 5 then 'yellow' else 'red' end as colour from n")
def engine_session(s: SparkSession, d: str) -> DataFrame:
    """A graph that is loaded, a question about it that is answered and recorded, and the transcript of the session: all through the engine and its stores."""
    home = _folder(s, "engine")
    graph, first = _graph(s, d)
    node = lambda c: F.concat(F.lit("func::parts.py::part_"), F.col(c).cast("string"))
    vertices = table(s, d, "part").select(node("p_partkey").alias("id"), F.lit("Function").alias("type"), F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("name"), F.lit("parts.py").alias("filepath"))
    load.load_graph(s, vertices, graph.select(node("source").alias("source"), node("target").alias("target"), "type"), f"{home}/graph")
    engine = api.Engine(s, f"{home}/graph", f"{home}/registries")
    session = engine.open_session("first")
    engine.query(f"What breaks if part_{first.first().id} changes?", session=session)
    return registry.transcript(engine.sessions.load(), session).drop("day")


@query("select 'm' || s_suppkey as id, s_name as name, false as is_active from supplier union all select 'new', 'p / n', true", base=False)
def model_registration(s: SparkSession, d: str) -> DataFrame:
    """A new active model without a name, beside many of which one was active."""
    shape = lambda rows: rows.select("id", "name", "provider", "model_name", "is_active")
    known = table(s, d, "supplier").select(F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.lit("x").alias("provider"), F.lit("y").alias("model_name"), (F.col("s_suppkey") == 2).alias("is_active"))
    return registry.register_model(shape(known), shape(s.createDataFrame([("new", "", "p", "n", True)], "id string, name string, provider string, model_name string, is_active boolean"))).select("id", "name", "is_active")


# ---- scalar functions
query("select event_id, case when w >= 4096 then 0.3 else 0.2 end::double as temperature, case when w >= 4096 then 64 else 32 end as max_tokens_extraction, case when w >= 32000 then 1024 when w >= 4096 then 512 else 256 end as max_tokens_explanation, case when w >= 32000 then 'detailed' when w >= 4096 then 'standard' else 'compact' end as prompt_style from (select event_id, event_id * 13 as w from events)", base=False, name="settings_tier")(
    lambda s, d: table(s, d, "events").select("event_id", scalars.settings_tier(F.col("event_id") * 13).alias("t")).select("event_id", "t.*")
)
query("select path, array_to_string(list_slice(string_split(path, '/'), greatest(1, len(string_split(path, '/')) - 1), 9), '/') as tail, substr(sha256(path), 1, 12) as key, case when length(path) > 12 then substr(path, 1, 12) || '…' else path end as short from files", name="path_functions")(
    lambda s, d: derived.files(s, d).select(F.col("path_id").alias("path"), scalars.path_tail(F.col("path_id"), 2).alias("tail"), scalars.short_hash(F.col("path_id")).alias("key"), scalars.truncated(F.col("path_id"), 12).alias("short"))
)
query("select event_id, case when value < 1.5 then 'fast' when value < 5 then 'medium' else 'slow' end as speed from events", base=False, name="speed_buckets")(lambda s, d: table(s, d, "events").select("event_id", scalars.speed(F.col("value")).alias("speed")))
query("select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as href from pages", base=False, name="link_extraction")(lambda s, d: table(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")))


query("select event_id, upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) as label, case when event_id % 7 > 0 then least(100, greatest(0, floor(value * 100 / (event_id % 7))))::int else 0 end as percent from events", base=False, name="progress_labels")(
    lambda s, d: table(s, d, "events").select("event_id", scalars.capitalised(F.col("event_type")).alias("label"), scalars.share(F.col("value"), F.col("event_id") % 7).alias("percent"))
)


@query("""select user_id, case k when 1 then event_type when 2 then 'v' || event_id when 3 then 'i' || event_id when 4 then event_id::varchar end as id from (
  select *, case when value < 1 then 9 when event_type = 'view' then 2 when event_type = 'click' then 3 when event_type = 'signup' then 4 else 1 end as k from events) where k < 9
union all select user_id, null from events where value < 1""", base=False)
def raw_results(s: SparkSession, d: str) -> DataFrame:
    """Events as raw JSON results of several shapes; some are cut off in the middle."""
    kind, key = F.col("event_type"), F.col("event_id").cast("string")
    node = F.when(kind == "view", F.concat(F.lit('{"v_id": "v'), key, F.lit('", "id": "x"}'))).when(kind == "click", F.concat(F.lit('{"v_id": "", "id": "i'), key, F.lit('"}'))).when(kind == "signup", key).otherwise(F.concat(F.lit('"'), kind, F.lit('"')))
    whole = F.concat(F.lit('[{"@@affected": [], "@@reachable": ['), node, F.lit(']}, {"other": [1]}]'))
    return traverse.raw_result_ids(table(s, d, "events").select("user_id", F.when(F.col("value") < 1, F.substring(whole, 1, 20)).otherwise(whole).alias("raw")))


@query(_SOURCE + "select file_ord::int as file_ord, func_ord::int as func_ord, 'part_' || part as name, n_calls::int as n_calls from placed", base=False)
def ast_functions_sql(s: SparkSession, d: str) -> DataFrame:
    """Extraction as a table function that SQL calls."""
    extract.register_functions(s)
    return s.sql("select file_ord, func_ord, name, size(calls) as n_calls from functions_of(table({files}))", files=derived.source_files(s, d))


query("select 'an' as term, p_partkey as id, p_name as name from part where contains(lower(p_name), 'an') union all select 'G', p_partkey, p_name from part where contains(lower(p_name), 'g') union all select 'ed wi', p_partkey, p_name from part where contains(lower(p_name), 'ed wi') union all select 'GIZ', p_partkey, p_name from part where contains(lower(p_name), 'giz')", base=False, name="node_search_index")(
    lambda s, d: _searched(s, d, ("an", "G", "ed wi", "GIZ"))
)


def _searched(s: SparkSession, d: str, terms: tuple[str, ...]) -> DataFrame:
    path = _folder(s, "letters")
    search.write_index(_parts(s, d), path)
    return reduce(DataFrame.union, (search.search(s, path, t).select(F.lit(t).alias("term"), "id", "name") for t in terms))


# ---- components: the operator that near duplicates share
@query(", links as (select source as a, target as b from part_graph where type = 'CALLS' union select target, source from part_graph where type = 'CALLS'), walk(node, seen) as (select a, a from links union select b, seen from walk join links on node = a where seen < b) select distinct on (node) node, seen as component from walk order by node, seen")
def call_components(s: SparkSession, d: str) -> DataFrame:
    return components.connected_components(derived.part_graph(s, d).where("type = 'CALLS'").select(F.col("source").alias("src"), F.col("target").alias("dst")))
