"""Files in and out: CSV, JSON lines, folders of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_END = "\x1e"
SUFFIXES = "*.{md,markdown,txt}"


def append_table(df: DataFrame, path: str) -> None:
    """IO2"""
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """IO3"""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """IO3: with the schema given, never inferred."""
    return spark.read.schema(schema).option("header", True).csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """IO5"""
    df.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """IO4: blank lines give no rows."""
    return spark.read.schema(schema).json(path)


def scan_folder(spark: SparkSession, path: str, suffixes: str = SUFFIXES) -> DataFrame:
    """IO6: one row per file with its text; a file that is no UTF-8 text gets
    the status 'failed' and stays in the result."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", suffixes)
             .option("recursiveFileLookup", True).load(path))
    text = F.col("content").cast("string")
    good = F.is_valid_utf8(text)
    return files.select(
        "path", F.when(good, text).alias("raw"), F.when(good, "ok").otherwise("failed").alias("status"))


def to_markdown(title, body, domain, models, effective, trust: str = "external"):
    """IO15: a document with its front matter."""
    safe = F.replace(title, F.lit('"'), F.lit("'"))
    return F.concat(
        F.lit('---\ntitle: "'), safe, F.lit('"\ndoc_type: kb_article\ndomain: '), domain,
        F.lit("\napplies_to_models: ["), models, F.lit("]\neffective_date: "), effective, F.lit(f"\ntrust: {trust}"),
        F.lit("\n---\n\n# "), title, F.lit("\n\n"), body, F.lit("\n"))


def write_documents(df: DataFrame, path: str, column: str = "document") -> None:
    """IO15: many documents per file, each closed by a record separator."""
    df.select(column).write.mode("overwrite").option("lineSep", RECORD_END).text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", RECORD_END).text(path).withColumnRenamed("value", "raw")
