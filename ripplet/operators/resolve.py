"""From a question to a vertex."""

from __future__ import annotations

import glob
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.functions.scalars import clean_target, target_type
from ripplet.operators.components import materialize
from ripplet.sources.tables import vertices_csv


def match_targets(vertices: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, type, id): the vertex that each of ``targets(target, type)`` names.

    ``vertices`` has row_ord, and source_rank where it joins several tables. Within a table an exact match
    comes before a weaker one, earlier rows first; a better ranked table comes before all. Exact matches
    join by key. File targets are held against path endings: both sides join on the ending whose length is the greatest power of two within
    the target's, of which a path has one for each power, and the rest of the target is compared then.
    """
    ranked = vertices if "source_rank" in vertices.columns else vertices.withColumn("source_rank", F.lit(0))
    functions, files = ranked.where("type = 'Function'"), ranked.where("type = 'File'")
    asked = targets.select("target", "type").where("type <> 'unknown' and target <> ''").distinct()
    order = lambda level: F.struct("source_rank", F.lit(level).alias("level"), "row_ord").alias("o")

    def by(rows: DataFrame, kind: str, column: str, level: int) -> DataFrame:
        return rows.withColumn("target", F.col(column)).join(asked.where(F.col("type") == kind).drop("type"), "target").select("target", F.lit(kind).alias("type"), "id", order(level))

    found = by(functions, "function", "id", 0).unionByName(by(functions, "function", "name", 1))
    for column in ("id", "name", "filepath"):
        found = found.unionByName(by(files, "file", column, 0))
    size = lambda column: F.pow(F.lit(2), F.floor(F.log2(F.length(column)))).cast("int")
    endings = asked.where("type = 'file'").select("target", F.right("target", size("target")).alias("ending"))
    powers = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.length("filepath"))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    tails = files.where("filepath <> ''").withColumn("ending", F.explode(F.transform(powers, lambda n: F.right("filepath", n))))
    near = tails.join(endings, "ending").where(F.endswith("filepath", "target"))
    found = found.unionByName(near.select("target", F.lit("file").alias("type"), "id", order(1)))
    return found.groupBy("target", "type").agg(F.min_by("id", "o").alias("id"))


def resolve_target(vertices: DataFrame, target: str, kind: str) -> str | None:
    spark = vertices.sparkSession
    row = match_targets(vertices, spark.createDataFrame([(target.strip(), kind)], "target string, type string")).first()
    return row.id if row else None


def resolve_in(spark: SparkSession, vertices: DataFrame, target: str, kind: str, candidates: list[str]) -> str | None:
    """The vertex of one target: in the graph, else in the first of the candidate vertex CSVs that has one."""
    found = resolve_target(vertices, target, kind)
    if found is None and candidates:
        found = resolve_target(ranked_vertices(spark, [vertices_csv(spark, p) for p in candidates]), target, kind)
    return found


def candidate_tables(preferred: str | None, data_dir: str = "data") -> list[str]:
    """Vertex CSVs to look in: the given one, the environment's, the default one, then nested ones, newest first."""
    nested = sorted(glob.glob(os.path.join(data_dir, "**", "vertices.csv"), recursive=True), key=lambda p: -os.stat(p).st_mtime)
    named = [preferred, os.environ.get("VERTICES_CSV", "").strip(), os.path.join(data_dir, "vertices.csv"), *nested]
    found: dict[str, str] = {}
    for path in named:
        if path and os.path.exists(path):
            found.setdefault(os.path.realpath(path), path)
    return list(found.values())


def ranked_vertices(spark: SparkSession, tables: list[DataFrame]) -> DataFrame:
    """Several vertex tables as one, ranked in the order given."""
    out = None
    for rank, table in enumerate(tables):
        own = table.withColumn("source_rank", F.lit(rank))
        out = own if out is None else out.unionByName(own)
    return out


def classify(answers: DataFrame) -> DataFrame:
    """(target, type, raw) of raw extractor answers."""
    return answers.select(clean_target(F.col("raw")).alias("target"), "raw").select("target", target_type(F.col("target")).alias("type"), "raw")


#: A word, or one character that is none: names and questions are cut alike, so a name is found at whole words only.
WORD = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]"


def _words(column: str) -> F.Column:
    return F.regexp_extract_all(column, F.lit(WORD), F.lit(0))


def mentioned_targets(vertices: DataFrame, questions: DataFrame) -> DataFrame:
    """(question, raw): the longest vertex name that a question mentions, the first by position on a tie; else UNKNOWN.

    A deterministic stand-in for a language model. Names may have several words: paths, dotted names, methods. As in a trie, the first word decides where a name can
    begin and which lengths names with that word have; what stands there is then looked up as a whole. Both steps join by key. The side of the first
    holds a row for each word and length, not for each name, so common first words as ``src`` bring little together. Questions are written with a number each, so words
    carry that and not a digest; the signs and blanks that begin a name are few, so those of the questions are not shuffled.
    """
    names = vertices.select("name").where("name <> ''").distinct().select("name", _words("name").alias("w"))
    begins = names.select(F.element_at("w", 1).alias("word"), F.size("w").alias("n")).distinct()
    asked = materialize(questions.select("question").distinct().select(F.monotonically_increasing_id().alias("key"), "question"), "asked")
    words = asked.select("key", F.size(_words("question")).alias("size"), F.posexplode(_words("question")).alias("at", "word"))
    whole = F.col("word").rlike(r"^[\p{L}\p{N}_]")
    met = words.where(whole).join(begins.where(whole), "word").unionByName(words.where(~whole).join(F.broadcast(begins.where(~whole)), "word"))
    places = met.where("at + n <= size").groupBy("key").agg(F.collect_list(F.struct("at", "n")).alias("places"))  # of one question
    found = asked.join(places, "key").select("key", _words("question").alias("w"), "places")
    found = found.select("key", F.explode(F.transform("places", lambda p: F.struct(p["at"].alias("at"), F.array_join(F.slice("w", p["at"] + 1, p["n"]), "").alias("name")))).alias("p")).select("key", "p.*")
    best = found.join(names.select("name"), "name").groupBy("key").agg(F.max_by("name", F.struct(F.length("name"), -F.col("at"))).alias("raw"))
    return asked.join(best, "key", "left").select("question", F.coalesce("raw", F.lit("UNKNOWN")).alias("raw"))


def extract_target(vertices: DataFrame, question: str, extractor: Callable[[str], str] | None = None) -> tuple[str, str]:
    """(target, type) of one question, by a callable such as a language model or by the names it mentions."""
    spark = vertices.sparkSession
    if extractor:
        raw = spark.createDataFrame([(extractor(question),)], "raw string")
    else:
        raw = mentioned_targets(vertices, spark.createDataFrame([(question,)], "question string"))
    row = classify(raw).first()
    return row.target, row.type
