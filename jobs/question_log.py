"""What users ask of a code base: each question with its target and the risk of changing it.

Streams conversation turns from a folder and takes only files that it has not taken before. Of every user turn it finds the file or
function that the question names, the vertex that this is, and how many others depend on it, and adds these to ``<out>``, partitioned by batch and by type of the target.

A batch that is replayed after a failure overwrites its own partitions alone, with the same rows. ``history`` reads the log: a turn that
was delivered again in a later file counts once, as first logged.

    python -m jobs.question_log --config jobs/question_log.json --turns /lake/conversations
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if __package__ in {None, ""}:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from jobs.common import log, main
from ripplet.operators import resolve
from ripplet.plans.shipping import ship

NAME = "question_log"
REQUIRED = ("turns", "vertices", "out", "checkpoint")
TURNS = "conv_id bigint, turn bigint, role string, text string"
RISKS = "id string, type string, name string, filepath string, n_dependents bigint, risk string"
ENTRIES = "conv_id bigint, turn bigint, question string, target string, id string, n_dependents bigint, risk string, batch bigint, target_type string"


def entries(turns: DataFrame, risks: DataFrame) -> DataFrame:
    """One entry for each distinct user turn; a null text is an empty question. Equal questions are looked up once."""
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("question"))
    asked = asked.groupBy("conv_id", "turn").agg(F.min("question").alias("question"))
    said = resolve.mentioned_targets(risks, asked)
    kinds = said.join(resolve.classify(said.select("raw").distinct()), "raw")
    targets = kinds.select("target", "type").distinct()
    found = resolve.match_targets(risks.withColumn("row_ord", F.col("id")), targets).join(risks.select("id", "n_dependents", "risk"), "id")
    known = kinds.select("question", "target", F.col("type").alias("target_type")).join(found.withColumnRenamed("type", "target_type"), ["target", "target_type"], "left")
    return asked.join(known, "question").select("conv_id", "turn", "question", "target", "id", "n_dependents", "risk", "target_type")


def run(spark: SparkSession, turns: str, vertices: str, out: str, checkpoint: str, files_per_batch: int = 1000) -> list[dict[str, int]]:
    """Log all new files and end; what was read and written, batch by batch. ``turns``: a folder, or a pattern of files and folders;
    ``vertices``: the table of job ``risk_report``, as it is when a batch runs."""
    ship(spark)
    done: list[dict[str, int]] = []

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = entries(batch, session.read.schema(RISKS).parquet(vertices))
        rows.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "target_type").parquet(out)
        written = session.read.schema(ENTRIES).parquet(out).where(F.col("batch") == number)
        done.append({"batch": number, "turns_read": batch.count(), "entries_written": written.count()})  # counts read no columns
        log.info("%s read %s and wrote %s: %s", NAME, turns, out, done[-1])

    stream = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", files_per_batch).parquet(turns)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if not done:
        log.info("%s found nothing new in %s", NAME, turns)
    return done


def history(spark: SparkSession, out: str) -> DataFrame:
    """The log: one entry for each turn, as first logged."""
    rows = spark.read.schema(ENTRIES).parquet(out)
    others = [c for c in rows.columns if c not in {"conv_id", "turn", "batch"}]
    first = rows.groupBy("conv_id", "turn").agg(F.min_by(F.struct(*others), "batch").alias("e"))
    return first.select("conv_id", "turn", "e.*")


if __name__ == "__main__":
    sys.exit(main(run, NAME, __doc__, REQUIRED))
