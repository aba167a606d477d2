"""How risky a change of each file and function of a code base is.

Reads a table of Python source files, extracts functions, calls and imports, resolves them into a graph and writes

- ``<out>/vertices``, partitioned by type and risk: id, name, filepath and n_dependents, the number of other files or functions that call or import it;
- ``<out>/edges``, partitioned by type: distinct source and target;
- ``<out>/errors``: files that can't be parsed.

The output is rewritten whole, so a rerun gives the same result, also after a run that broke off.

    python -m jobs.risk_report --config jobs/risk_report.json --sources /lake/sources --out /lake/risk
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if __package__ in {None, ""}:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from jobs.common import log, main
from ripplet.functions import extract
from ripplet.operators import build, report
from ripplet.operators.components import discard, materialize
from ripplet.plans.schemas import SOURCE_FILES
from ripplet.plans.shipping import ship

NAME = "risk_report"
REQUIRED = ("sources", "out")


def dependents(edges: DataFrame) -> DataFrame:
    """(id, n_dependents) of what others call or import; ``edges`` are distinct, and no two types have the same ends."""
    uses = edges.where(F.col("type").isin("CALLS", "IMPORTS") & (F.col("source") != F.col("target")))
    return uses.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n_dependents"))


def run(spark: SparkSession, sources: str, out: str, mode: str = "complete") -> dict[str, int]:
    """``sources``: Parquet with the columns of ``SOURCE_FILES``; ``mode``: of the call edges. Returns what was read and written.

    Rows are written by the tasks that make them: joins deal them evenly, and a shuffle for the sake of fewer files would be one more of everything.
    """
    ship(spark)
    links = materialize(extract.links_of(spark.read.schema(SOURCE_FILES).parquet(sources), mode), "links", "kind")
    numbers = {"files_read": links.where("kind = 'file'").count()}

    def write(name: str, rows: DataFrame, *by: str) -> DataFrame:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(f"{out}/{name}")
        written = spark.read.schema(rows.schema).parquet(f"{out}/{name}")
        numbers[f"{name}_written"] = written.count()
        return written

    vertices, edges = build.graph_of_links(links, mode)
    used = dependents(write("edges", edges, "type"))
    write("vertices", report.risk_levels(vertices.join(used, "id", "left").na.fill(0, ["n_dependents"]), "n_dependents"), "type", "risk")
    write("errors", links.where("kind = 'error'").select("file_ord", "filepath", F.col("other").alias("error")))
    discard(links)
    log.info("%s read %s: %s files; wrote %s: %s", NAME, sources, numbers["files_read"], out, numbers)
    return numbers


if __name__ == "__main__":
    sys.exit(main(run, NAME, __doc__, REQUIRED))
