"""Readers and writers of the text formats (SRC-*, SNK-*)."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.ranges import numbered
from lodestone.plans.storage import stored


def text_documents(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, text): one row a file."""
    read = spark.read.option("recursiveFileLookup", recursive).text(path, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def link_file(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst), each once, of lines ``node;out1,out2,``."""
    part = F.split("value", ";")
    rows = spark.read.text(path).select(F.trim(part[0]).alias("src"), F.explode(F.split(part[1], ",")).alias("dst"))
    return rows.select("src", F.trim("dst").alias("dst")).filter("dst <> ''").distinct()


def numbered_links(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((name, node), (src, dst)): names of such lines are numbered from 0 in the order in which they first appear."""
    part = F.split("value", ";")
    rows = stored(spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.trim(part[0]).alias("src"), F.filter(F.transform(F.split(part[1], ","), F.trim), lambda x: x != "").alias("out")))
    seen = rows.select("at", F.posexplode(F.concat(F.array("src"), "out")).alias("place", "name"))
    first = seen.groupBy("name").agg(F.min(F.struct("at", "place")).alias("first"))
    names = stored(numbered(first, "node", F.col("first")).select("name", "node"))
    pairs = rows.select("src", F.explode("out").alias("dst")).distinct()
    links = pairs.join(names.select(F.col("name").alias("src"), F.col("node").alias("a")), "src").join(names.select(F.col("name").alias("dst"), F.col("node").alias("b")), "dst")
    return names, links.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def title_file(spark: SparkSession, path: str) -> DataFrame:
    """(node, title) of lines ``node;title``."""
    return spark.read.csv(path, sep=";", schema="node string, title string")


def score_file(spark: SparkSession, path: str) -> DataFrame:
    """(name, score) of lines ``name;score``."""
    return spark.read.csv(path, sep=";", schema="name string, score double")


def with_scores(docs: DataFrame, scores: DataFrame, key: str = "name") -> DataFrame:
    """docs with their score, 0 where there is none."""
    return docs.join(scores.withColumnRenamed("name", key), key, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def baskets(spark: SparkSession, path: str) -> DataFrame:
    """(basket, item) of lines of numbers; the basket is numbered by file and place, and an item is there once."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("basket"), F.array_distinct(F.split(F.trim("value"), r"\s+")).alias("items"))
    return lines.select("basket", F.explode("items").alias("item")).filter("item <> ''").select("basket", F.col("item").cast("int").alias("item"))


def edge_list(spark: SparkSession, path: str, sep: str = "\t", seed: int | None = None) -> DataFrame:
    """(src, dst) without comments and loops, in random order if a seed is given; further columns are ignored."""
    rows = spark.read.csv(path, sep=sep, comment="#", schema="src long, dst long", mode="PERMISSIVE", ignoreLeadingWhiteSpace=True).filter("src <> dst")
    return rows if seed is None else rows.orderBy(F.xxhash64(F.lit(seed), "src", "dst"))


def metis_graph(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of a METIS file: a header, then line i with the neighbours of node i, from 1; % starts a comment.

    Lines are numbered by their place in the file, in ranges.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.trim("value").alias("line")).filter("NOT startswith(line, '%')")
    placed = numbered(lines, "src", F.col("at")).filter("src > 0")
    return placed.select("src", F.explode(F.split("line", r"\s+")).alias("dst")).filter("dst <> ''").select("src", F.col("dst").cast("long").alias("dst"))


def patterns(path: str) -> list[str]:
    """Regular expressions, one a line, without // comments."""
    return [x for x in Path(path).read_text().splitlines() if x.strip() and not x.startswith("//")]


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def event_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Unbounded rows of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def write_top(scores: DataFrame, path: str, column: str = "rank", k: int = 30) -> None:
    """Lines ``id: score`` of the k best, five significant digits."""
    best = scores.orderBy(F.desc(column), "id").limit(k)
    best.select(F.format_string("%s: %.5g", F.col("id").cast("string"), F.col(column))).coalesce(1).write.mode("overwrite").text(path)


def posting_lines(postings: DataFrame) -> DataFrame:
    """(line) ``term;doc;tf;places``."""
    return postings.select(F.concat_ws(";", "term", F.col("doc_id").cast("string"), F.col("tf").cast("string"), F.array_join(F.transform("positions", lambda p: p.cast("string")), " ")).alias("line"))


def parse_postings(lines: DataFrame) -> DataFrame:
    part = F.split("line", ";")
    return lines.select(part[0].alias("term"), part[1].cast("long").alias("doc_id"), part[2].cast("long").alias("tf"), F.transform(F.split(part[3], " "), lambda x: x.cast("int")).alias("positions"))


def latest_by_key(table: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return table.groupBy(*key).agg(F.max_by(F.struct(*[c for c in table.columns if c not in key]), order).alias("_s")).select(*key, "_s.*")


def write_lengths(lengths: DataFrame, path: str) -> None:
    """Lines ``id;length``."""
    lengths.select("id", "length").write.csv(path, sep=";")


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(id, length) of such lines."""
    return spark.read.csv(path, sep=";", schema="id long, length double")


def table_lines(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(key, line): numbers with two decimals and tabs between."""
    return rows.select(key, F.concat_ws("\t", *[F.format_string("%.2f", F.col(c).cast("double")) for c in columns]).alias("line"))


def best_run(spark: SparkSession, path: str) -> DataFrame:
    """(file, edge_cut): of files whose lines are (round, edge_cut, ...), the one whose last round has the least cut."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.try_element_at(part, F.lit(1)).try_cast("long").alias("round"), F.try_element_at(part, F.lit(2)).try_cast("long").alias("edge_cut")).filter("round IS NOT NULL AND edge_cut IS NOT NULL")
    last = rows.groupBy("file").agg(F.max_by("edge_cut", "round").alias("edge_cut"))
    return last.orderBy("edge_cut", "file").limit(1)
