"""Tables into files.  Every writer makes a folder of part files; none gathers rows in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.text import head_md5
from turnloom.sources.readers import read_json_array


def write_jsonl(df: DataFrame, path: str, append: bool = False, nulls: bool = False) -> None:
    """One object for each line, characters as they are.  Overwrites what is there, unless told to append."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", not nulls).json(path)


def json_array_to_jsonl(spark: SparkSession, source: str, target: str) -> int:
    """Returns how many records were written."""
    rows = read_json_array(spark, source)
    write_jsonl(rows, target)
    return spark.read.text(target).count()


def predictions(question: Column, answer: Column) -> list[Column]:
    return [question.alias("Input"), answer.alias("Output")]


def write_metrics(spark: SparkSession, metrics: dict[str, float], path: str) -> None:
    spark.createDataFrame([(k, float(v)) for k, v in metrics.items()], "metric string, value double").write.mode("overwrite").json(path)


def corpus_hash(files: DataFrame) -> DataFrame:
    """One row for each file: the hash of its beginning."""
    return files.select("path", head_md5("content").alias("hash"))


def save_embeddings(df: DataFrame, base: str, content_hash: str) -> str:
    path = f"{base}/hash={content_hash}"
    df.write.mode("overwrite").parquet(path)
    return path


def load_embeddings(spark: SparkSession, base: str, content_hash: str) -> DataFrame:
    return spark.read.parquet(f"{base}/hash={content_hash}")


def row_count_report(df: DataFrame) -> str:
    return f"Converted {df.agg(F.count('*')).first()[0]} samples"
