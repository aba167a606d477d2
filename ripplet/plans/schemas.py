"""Schemas of every table the engine keeps, as DDL; nothing is inferred."""

from __future__ import annotations

FUNCTION = "name:string,filepath:string,start_line:int,end_line:int,calls:array<string>,docstring:string"
IMPORT = "module:string,names:array<string>,filepath:string,line:int"

SOURCE_FILES = "file_ord int, filepath string, path_id string, mtime_ns bigint, size bigint, content binary"
PARSED = f"file_ord int, filepath string, path_id string, mtime_ns bigint, size bigint, functions array<struct<{FUNCTION}>>, imports array<struct<{IMPORT}>>, error string"
#: What a file holds, a row for each: its kind is file, function, here or elsewhere (a call of that name, defined in the same file or not), import or error.
LINKS = "kind string, file_ord int, filepath string, path_id string, func_ord int, name string, other string"
VERTICES = "id string, type string, name string, filepath string"
EDGES = "source string, target string, type string"
PROJECTS = "id string, name string, path string, created string, last_analyzed string, vertices bigint, edges bigint, files bigint"
ENTRY = "question:string,target:string,target_type:string,affected:array<string>,explanation:string,risk:string,timestamp:string,n_affected:bigint"
SESSIONS = f"id string, name string, created_at string, updated_at string, entries array<struct<{ENTRY}>>"
CAPABILITIES = "context_window:int,supports_streaming:boolean,supports_json_mode:boolean,estimated_speed:string,max_output_tokens:int"
MODELS = (
    f"id string, name string, provider string, base_url string, api_key string, model_name string, is_active boolean, capabilities struct<{CAPABILITIES}>, settings map<string,string>, created_at string, last_used string"
)

#: Vertex types by their short names, and the vertex types at the ends of each edge type.
VERTEX_TYPES = {"File": "CodeFile", "Function": "CodeFunction"}
EDGE_ENDS = {"CALLS": ("CodeFunction", "CodeFunction"), "IMPORTS": ("CodeFile", "CodeFile"), "CONTAINS": ("CodeFile", "CodeFunction")}
