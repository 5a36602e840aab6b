"""The registered queries, the SQL they are held against, and the tables they read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators import index, search

QUERIES: dict = {}
SQL: dict[str, str] = {}
_stores: dict[tuple[str, str], index.IndexStore] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> search.Index:
    """The stored index of all documents, built when a session first asks for it."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _stores:
        _stores[at] = index.write_index(table(spark, sf_dir, "documents"))
    return search.Index.stored(_stores[at])


TOKENS = r"""tok AS MATERIALIZED (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents)),
cnt AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM cnt GROUP BY term),
nd AS (SELECT count(*) AS n FROM documents),
wt AS (SELECT doc_id, term, tf, df, tf * ln(n::DOUBLE / df) AS w FROM cnt JOIN dfs USING (term), nd),
len AS (SELECT doc_id, count(*) AS n_words FROM tok GROUP BY doc_id)"""
