"""The jobs as queries: each runs its job twice into one new folder and returns the output after the second run; and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import question_log, risk_report
from ripplet.operators import report
from ripplet.operators.components import shared_dir
from ripplet.plans import derived
from ripplet.plans.derived import table


def _home(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_risk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source text of every supplier, into a report of its files and functions."""
    home = _home(spark, "job1")
    derived.source_files(spark, sf_dir).write.parquet(f"{home}/sources")
    for _ in range(2):
        risk_report.run(spark, f"{home}/sources", f"{home}/out")
    return spark.read.schema(question_log.RISKS).parquet(f"{home}/out/vertices").select("id", "type", "name", "n_dependents", "risk")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the benchmark passages as a function of the first passage that has it; the others depend on it."""
    items = table(spark, sf_dir, "benchmark")
    words = items.select("item_id", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}_][\p{L}\p{N}_]*"), F.lit(0))).alias("name")).where(F.length("name") >= 4).distinct()
    own = words.groupBy("name").agg(F.min("item_id").alias("item"), (F.count("*") - 1).alias("n_dependents"))
    path = F.concat(F.lit("item_"), F.col("item").cast("string"), F.lit(".py"))
    rows = own.select(F.concat(F.lit("func::"), path, F.lit("::"), "name").alias("id"), F.lit("Function").alias("type"), "name", path.alias("filepath"), "n_dependents")
    return report.risk_levels(rows, "n_dependents")


def job2_question_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, logged against the words of the benchmark passages; the second run finds nothing new."""
    home = _home(spark, "job2")
    _words(spark, sf_dir).write.partitionBy("type", "risk").parquet(f"{home}/vertices")
    for _ in range(2):  # as a pattern, since a stream takes a folder or a pattern, and the table may be one file
        question_log.run(spark, f"{sf_dir}/conversations.parque[t]", f"{home}/vertices", f"{home}/out", f"{home}/checkpoint", files_per_batch=2)
    return question_log.history(spark, f"{home}/out")


QUERIES = {"job1_risk_report": job1_risk_report, "job2_question_log": job2_question_log}

_RISK = "case when n_dependents = 0 then 'None' when n_dependents <= 2 then 'Low' when n_dependents <= 5 then 'Medium' else 'High' end as risk"
ORACLES = {
    "job1_risk_report": f"""with called as (
  select a.l_suppkey as file, a.l_partkey as part, b.l_partkey as next from lineitem a join lineitem b on b.l_orderkey = a.l_orderkey and b.l_linenumber = a.l_linenumber + 1),
defs as (select distinct l_suppkey as file, l_partkey as part from lineitem), firsts as (select part, min(file) as file from defs group by part),
links as (select distinct c.file, c.part, coalesce(d.file, f.file) as to_file, c.next from called c left join defs d on d.file = c.file and d.part = c.next join firsts f on f.part = c.next),
used as (select to_file as file, next as part, count(*) as n from links where (file, part) <> (to_file, next) group by all),
found as (select 'file::s_' || s_suppkey || '.py' as id, 'File' as type, 's_' || s_suppkey || '.py' as name, 0::bigint as n_dependents from supplier
  union all select 'func::s_' || file || '.py::part_' || part, 'Function', 'part_' || part, coalesce(n, 0)::bigint from defs left join used using (file, part))
select *, {_RISK} from found""",
    "job2_question_log": f"""with words as (select distinct item_id, unnest(regexp_extract_all(text, '[\\p{{L}}_][\\p{{L}}\\p{{N}}_]*')) as name from benchmark),
names as (select name, min(item_id) as item, (count(*) - 1)::bigint as n_dependents from words where length(name) >= 4 group by name),
risks as (select 'func::item_' || item || '.py::' || name as id, name, n_dependents, {_RISK} from names),
asked as (select conv_id, turn, min(coalesce(text, '')) as question from conversations where role = 'user' group by all),
said as (select distinct question, regexp_extract_all(question, '[\\p{{L}}\\p{{N}}_]+') as w from asked),
placed as (select question, unnest(w) as name, unnest(range(1, len(w) + 1)) as pos from said),
best as (select question, arg_max(name, (length(name), -pos)) as target from placed join names using (name) group by question)
select conv_id, turn, question, coalesce(target, 'UNKNOWN') as target, id, n_dependents, risk, case when target is null then 'unknown' else 'function' end as target_type
from asked left join best using (question) left join risks on name = target""",
}
