"""The registered queries and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under a name, with its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


@query(
    "doc_totals_by_lang",
    """SELECT lang, count(*) AS n_docs, sum(len(u)) AS n_units,
              sum(list_sum(list_transform(u, lambda x: len(x)))) AS n_chars,
              sum(list_sum(list_transform(u, lambda x: len(regexp_extract_all(lower(x), '[\\pL\\pN\\pM]+'))))) AS n_tokens
       FROM (SELECT lang, list_filter(string_split(regexp_replace(text, '([.!?…»”])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS u FROM documents)
       GROUP BY lang""",
)
def doc_totals_by_lang(spark, sf_dir):
    units = F.filter(F.split("text", r"(?<=[.!?…»”])\s+"), lambda u: u != "")
    docs = table(spark, sf_dir, "documents").select("lang", units.alias("u"))
    total = lambda f: F.aggregate("u", F.lit(0).cast("long"), lambda a, x: a + f(x))
    return docs.groupBy("lang").agg(
        F.count("*").alias("n_docs"),
        F.sum(F.size("u").cast("long")).alias("n_units"),
        F.sum(total(F.length)).alias("n_chars"),
        F.sum(total(lambda x: F.size(F.regexp_extract_all(F.lower(x), F.lit(r"(?U)[\w&&[^_]]+"), F.lit(0))))).alias("n_tokens"),
    )
