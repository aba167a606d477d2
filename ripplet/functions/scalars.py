"""Column functions of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's notion of white space in ASCII, for trimming.
WHITE = " \t\n\r\x0b\x0c"


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file::"), path)


def func_id(path: Column, name: Column) -> Column:
    return F.concat(F.lit("func::"), path, F.lit("::"), name)


def display_name(node: Column) -> Column:
    return F.element_at(F.split(node, "::"), -1)


def node_type(node: Column) -> Column:
    return F.when(node.startswith("func::"), "Function").otherwise("File")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_tail(path: Column, n: int = 3) -> Column:
    """The last ``n`` segments, whichever separator."""
    parts = F.split(path, r"[\\/]")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - (n - 1)), n), "/")


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def risk(affected: Column) -> Column:
    return F.when(affected == 0, "None").when(affected <= 2, "Low").when(affected <= 5, "Medium").otherwise("High")


def clean_target(raw: Column) -> Column:
    """Trimmed of white space, then of double and of single quotes."""
    out = F.btrim(raw, F.lit(WHITE))
    for quote in ('"', "'"):
        out = F.btrim(out, F.lit(quote))
    return F.when(out.startswith("[Error]"), "UNKNOWN").otherwise(out)


def target_type(target: Column) -> Column:
    return F.when(target.isNull() | (target == "UNKNOWN") | (target == ""), "unknown").when(target.endswith(".py"), "file").otherwise("function")


def speed(seconds: Column) -> Column:
    return F.when(seconds < 1.5, "fast").when(seconds < 5, "medium").otherwise("slow")


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)


def settings_tier(window: F.Column) -> F.Column:
    """Settings by a model's context window: a struct of temperature, tokens for extraction and explanation, and style of the prompt."""
    row = lambda *values: F.struct(*(F.lit(v).alias(n) for v, n in zip(values, ("temperature", "max_tokens_extraction", "max_tokens_explanation", "prompt_style"), strict=True)))
    return F.when(window >= 32_000, row(0.3, 64, 1024, "detailed")).when(window >= 4_096, row(0.3, 64, 512, "standard")).otherwise(row(0.2, 32, 256, "compact"))


def capitalised(text: Column) -> Column:
    """The first letter in upper case, all others in lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def share(part: Column, whole: Column) -> Column:
    """Whole percent of ``whole`` that ``part`` is, rounded down and between 0 and 100; 0 of nothing."""
    return F.when(whole > 0, F.least(F.lit(100), F.greatest(F.lit(0), F.floor(part * 100 / whole)))).otherwise(0).cast("int")
