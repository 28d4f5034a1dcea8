"""Readers of dictionaries and corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY_SCHEMA = "name string, entity_type string, aliases array<string>, metadata map<string,string>"


def read_entity_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """All JSON files of a folder: ``name, entity_type, aliases, metadata``."""
    return spark.read.schema(ENTITY_SCHEMA).json(path, multiLine=True).withColumn("file", F.input_file_name())


def read_news(spark: SparkSession, path: str, column: str = "content") -> DataFrame:
    """CSV news: a leading bracketed part is the title, else the first fifty characters."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    text = F.trim(F.coalesce(F.col(column), F.lit("")))
    bracketed = F.regexp_extract(text, r"(?s)^【([^】]*)】(.*)$", 1)
    body = F.when(bracketed != "", F.trim(F.regexp_extract(text, r"(?s)^【[^】]*】(.*)$", 1))).otherwise(text)
    return rows.select("*", F.when(bracketed != "", bracketed).otherwise(F.substring(text, 1, 50)).alias("title"), body.alias("body"))


def read_term_lists(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``term: a, b``; lines that start with # are comments: ``term, values``."""
    line = F.trim("value")
    rows = spark.read.text(path).where(~line.startswith("#") & line.contains(":"))
    values = F.filter(F.transform(F.split(F.substring(line, F.instr(line, ":") + 1, F.length(line)), ","), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select(F.trim(F.substring_index(line, ":", 1)).alias("term"), values.alias("values"))


def read_csv_backup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def rows_without(rows: DataFrame, column: str) -> DataFrame:
    """Rows that still lack a value, e.g. an embedding."""
    return rows.where(F.col(column).isNull())
