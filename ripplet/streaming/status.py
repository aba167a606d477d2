"""Status lines of long-running work, as a stream with state.

Lines are JSON objects, one a line: ``key`` and ``seq`` say whose line it is and which in order; ``status``, ``completed``, ``total`` and ``error`` are
what is reported. Progress (a total above zero) is passed on line by line. A status is passed on only when it differs from the last one of its key, in
whichever micro-batch that came. An error is passed on and ends its key: what follows is ignored. Lines that are no such objects are counted and skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LINE = "key string, seq bigint, status string, completed bigint, total bigint, error string"
REPORTS = "key string, seq bigint, kind string, status string, completed bigint, total bigint, error string"
_Report = Row(*(c.split()[0] for c in REPORTS.split(", ")))
_STATE = "seq bigint, status string, ended boolean"
#: The state stores that stateful processors need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def parsed_lines(lines: DataFrame) -> DataFrame:
    """The fields of each line of ``lines(value)``, and whether it is bad: no JSON object, or without key or seq. Blank lines are left out."""
    own = F.from_json("value", f"{LINE}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    found = lines.where(F.btrim("value") != "").select(own.alias("line"))
    return found.select("line.*", (F.col("line").isNull() | F.col("line._bad").isNotNull() | F.col("line.key").isNull() | F.col("line.seq").isNull()).alias("bad")).drop("_bad")


def reports_of(rows: list[Row], last: str, at: int) -> tuple[list[tuple], str, int, bool]:
    """What ordered lines of one key report, after the status ``last`` and the line ``at``; then the new status and line, and whether the key ended."""
    out = []
    for r in rows:
        if r.seq <= at:
            continue  # delivered again
        at, status, completed, total = r.seq, r.status or "", r.completed or 0, r.total or 0
        if total > 0:
            out.append((r.key, at, "progress", status, completed, total, None))
        elif status != last:
            out.append((r.key, at, "status", status, None, None, None))
            last = status
        if r.error is not None:
            out.append((r.key, at, "error", status, None, None, r.error))
            return out, last, at, True
    return out, last, at, False


class _Changes(StatefulProcessor):
    """Keeps of each key its last line and status, and whether it has ended."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        at, status, ended = self.last.get() or (-(2**63), "", False)  # None at first; each call is a round trip to the state
        if not ended:
            found, status, at, ended = reports_of(sorted(rows, key=lambda r: r.seq), status, at)  # of one key in one micro-batch
            self.last.update((at, status, ended))
            yield from (_Report(*f) for f in found)

    def close(self) -> None:
        pass


def status_reports(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """``REPORTS`` of a stream of lines; the progress of the query shows under ``lines`` how many there were and how many were bad.

    The rows of one key in one micro-batch are sorted in memory, so bound a batch by ``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` of the source. The session needs
    ``PROVIDER`` while the query starts.
    """
    found = parsed_lines(lines).observe("lines", F.count(F.lit(1)).alias("lines"), F.count_if("bad").alias("bad"))
    return found.where("not bad").drop("bad").groupBy("key").transformWithState(_Changes(), REPORTS, "Append", "None")


def stream_reports(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int = 1000) -> dict[str, int]:
    """Report on all files of ``folder`` that have not been taken yet, into Parquet at ``out``, and end. Returns the counts of lines and of bad ones."""
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
        query = status_reports(spark, lines).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)
    counts = [p.observedMetrics["lines"] for p in query.recentProgress if p.observedMetrics.get("lines")]
    return {"lines": sum(c.lines for c in counts), "bad": sum(c.bad for c in counts)}
