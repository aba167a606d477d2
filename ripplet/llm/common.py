"""What the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.operators.components import discard, materialize, shared_dir  # noqa: F401

#: Rows in an Arrow batch: with Spark's own bound of a batch's bytes (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB) this bounds what a Python worker holds at once.
BATCH_ROWS = 256


class Memory(dict):
    """Remembers what ``make`` gives: at most ``most`` keys, then it starts anew, and none longer than ``longest`` characters, so its size is bounded."""

    def __init__(self, make: Callable, most: int, longest: int) -> None:
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key: str):  # noqa: ANN204
        found = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = found
        return found


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and the whole text (null: empty), and the named further columns; clashing extras are left behind."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def fresh(rows: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``rows`` does not have yet."""
    taken, out = {c.lower() for c in rows.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless they are smaller already. The setting stays, as plans read it when they run."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
