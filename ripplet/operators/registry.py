"""Registries of projects, sessions and models: small tables, one row an object."""

from __future__ import annotations

import os
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.functions.scalars import truncated

def now() -> F.Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def new_id() -> F.Column:
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8)


def register_project(projects: DataFrame, path: str, name: str | None, vertices: int, edges: int, files: int) -> DataFrame:
    """Insert, or update by normalised path: id, name and creation stay."""
    spark, path = projects.sparkSession, os.path.abspath(path)
    fresh = spark.createDataFrame([(path, name or os.path.basename(path), vertices, edges, files)], "path string, n string, v bigint, e bigint, f bigint")
    both = projects.join(fresh, "path", "full_outer")
    is_new = F.col("id").isNull()
    return both.select(
        F.when(is_new, new_id()).otherwise(F.col("id")).alias("id"), F.coalesce("name", "n").alias("name"), "path", F.coalesce("created", now()).alias("created"),
        F.when(F.col("n").isNotNull(), now()).otherwise(F.col("last_analyzed")).alias("last_analyzed"),
        F.coalesce("v", "vertices").alias("vertices"), F.coalesce("e", "edges").alias("edges"), F.coalesce("f", "files").alias("files"),
    )


def rename(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.withColumn("name", F.when(F.col("id") == key, F.lit(name)).otherwise(F.col("name")))


def delete(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col("id") != key)


def lookup(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col("id") == key).limit(1)  # ids are keys


def sessions_by_update(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("updated_at"), "id")


def session_listing(sessions: DataFrame, n: int = 15, width: int = 40) -> DataFrame:
    """The ``n`` sessions updated last, numbered from 1, with the last question cut to ``width`` characters."""
    from pyspark.sql import Window

    last = truncated(F.try_element_at("entries", F.lit(-1))["question"], width).alias("last_question")
    top = sessions_by_update(sessions).limit(n)
    number = F.row_number().over(Window.orderBy(F.desc("updated_at"), "id")).cast("bigint")  # over n rows
    return top.select(number.alias("row"), "id", "name", F.split_part("updated_at", F.lit("T"), F.lit(1)).alias("day"), last)


def session_summaries(sessions: DataFrame) -> DataFrame:
    return sessions.select("id", "name", F.size("entries").alias("n_queries"), F.try_element_at("entries", F.lit(-1))["question"].alias("last_question"), F.split_part("updated_at", F.lit("T"), F.lit(1)).alias("day"))


def add_entry(sessions: DataFrame, key: str, entry: DataFrame) -> DataFrame:
    """Append the one row of ``entry`` to a session's entries."""
    more = entry.select(F.lit(key).alias("id"), F.array(F.struct("*")).alias("more"))
    grown = sessions.join(F.broadcast(more), "id", "left")  # one row
    return grown.withColumn("entries", F.when(F.col("more").isNotNull(), F.concat("entries", "more")).otherwise(F.col("entries"))).withColumn("updated_at", F.when(F.col("more").isNotNull(), now()).otherwise(F.col("updated_at"))).drop("more")


def set_active(models: DataFrame, key: str) -> DataFrame:
    """Exactly the named model is active."""
    return models.withColumn("is_active", F.col("id") == key)


def mark_used(models: DataFrame, key: str) -> DataFrame:
    return models.withColumn("last_used", F.when(F.col("id") == key, now()).otherwise(F.col("last_used")))


def preferred(models: DataFrame) -> DataFrame:
    """The first coder model of the qwen family, else the first model, by ord."""
    low = F.lower("model_name")
    return models.agg(F.min_by(F.struct("*"), F.struct(~(low.contains("qwen") & low.contains("coder")), "ord")).alias("m")).select("m.*")


def status_changes(events: DataFrame, key: str, status: str, order: str) -> DataFrame:
    """Events whose status differs from the one before, per key; the first event counts, and a null status is one like any other."""
    from pyspark.sql import Window

    by = Window.partitionBy(key).orderBy(order)
    changed = F.row_number().over(by) == 1
    return events.withColumn("_changed", changed | ~F.col(status).eqNullSafe(F.lag(status).over(by))).where("_changed").drop("_changed")


def create_session(name: str = "") -> tuple[str, dict]:
    """The id and the row of a new, empty session."""
    key, at = uuid.uuid4().hex[:8], datetime.now(UTC).isoformat()
    return key, {"id": key, "name": name, "created_at": at, "updated_at": at, "entries": []}


def save(rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows by id, those of ``fresh`` in place of older ones."""
    return rows.join(fresh.select("id"), "id", "left_anti").select(*rows.columns).unionByName(fresh.select(*rows.columns))


def transcript(sessions: DataFrame, key: str) -> DataFrame:
    """The queries of one session, numbered from 1, with how many things each affects and the colour of its risk.

    Entries list the first of what they affect and count all; older ones, without the count, list all.
    """
    each = sessions.where(F.col("id") == key).select(F.posexplode("entries").alias("at", "e"))
    colour = F.when(F.col("e.risk").isin("Low", "None"), "green").when(F.col("e.risk") == "Medium", "yellow").otherwise("red")
    return each.select((F.col("at") + 1).alias("row"), "e.question", "e.target", F.coalesce("e.n_affected", F.size("e.affected").cast("bigint")).alias("n_affected"), "e.risk", colour.alias("colour"), F.split_part("e.timestamp", F.lit("T"), F.lit(1)).alias("day"))


def project_listing(projects: DataFrame) -> DataFrame:
    """Projects as they are shown: numbered in order of creation, with the day of the last analysis."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.orderBy("created", "id")).cast("bigint")  # a registry is small
    return projects.select(number.alias("row"), "id", "name", "path", "files", "vertices", "edges", F.coalesce(F.split_part("last_analyzed", F.lit("T"), F.lit(1)), F.lit("n/a")).alias("day"))


def register_model(models: DataFrame, model: DataFrame) -> DataFrame:
    """Add the one row of ``model``; what lacks an id, a name or a time gets one, and if it is active, no other is."""
    known = model.select(
        *(F.coalesce(F.when(F.col(c) != "", F.col(c)), default).alias(c) if (default := {"id": new_id(), "created_at": now(), "name": F.concat("provider", F.lit(" / "), "model_name")}.get(c)) is not None else F.col(c) for c in models.columns)
    )
    takes = model.where("is_active").select(F.lit(True).alias("_takes")).limit(1)  # one row at most
    older = models.join(F.broadcast(takes), F.lit(True), "left").withColumn("is_active", F.col("is_active") & F.col("_takes").isNull()).select(*models.columns)
    return older.unionByName(known)


def update_model(models: DataFrame, key: str, **values) -> DataFrame:  # noqa: ANN003
    """The named fields of one model, changed."""
    kinds = dict(models.dtypes)
    return models.withColumns({c: F.when(F.col("id") == key, F.lit(v).cast(kinds[c])).otherwise(F.col(c)) for c, v in values.items()})


def active_model(models: DataFrame) -> DataFrame:
    """The active model, else the preferred one; ``models`` has ord."""
    low = F.lower("model_name")
    order = F.struct(~F.coalesce(F.col("is_active"), F.lit(False)), ~(low.contains("qwen") & low.contains("coder")), F.col("ord"))
    return models.agg(F.min_by(F.struct("*"), order).alias("m")).select("m.*")
